"""Token budgets: how a window is split, which questions exceed it, and what then takes the place of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions.ids import uuid5
from papyrite.operators.evidence import BETWEEN

#: Shares of a window of 10,000 tokens, and the window itself.
ALLOCATION = {"system_and_tools": 1200, "conversation": 1000, "question_and_plan": 500, "document_evidence": 5000, "answer_reserve": 2000, "miscellaneous": 300}
TOTAL = sum(ALLOCATION.values())
#: Characters of a token, about.
CHARS = 4
AGGREGATED = "aggregated_evidence"


def tokens(text: Column) -> Column:
    """A token for every four characters, one at least; none for an empty or missing text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / CHARS))).cast("long")


def split(window: Column) -> dict[str, Column]:
    """Tokens of each share of a window, whole ones; what rounding leaves goes to the evidence. A window of 0 or less has none."""
    scaled = {name: F.floor(window * (share / TOTAL)).cast("long") for name, share in ALLOCATION.items() if name != "document_evidence"}
    rest = window.cast("long")
    for value in scaled.values():
        rest = rest - value
    return {name: F.when(window > 0, rest if name == "document_evidence" else scaled[name]) for name in ALLOCATION}


def exceeded(questions: DataFrame, evidence: DataFrame, history: DataFrame) -> DataFrame:
    """``questions`` (``question, window, deep, goal, rationale``) with ``used, ceiling, overflow``.

    Used are the tokens of the evidence (``question, content``), of the turns (``question, text``) and of the plan; the
    ceiling is the window without the answer's reserve. In deep mode nothing overflows.
    """
    spent = evidence.select("question", tokens(F.col("content")).alias("n")).unionByName(history.select("question", tokens(F.col("text")).alias("n"))).groupBy("question").agg(F.sum("n").alias("spent"))
    used = F.coalesce("spent", F.lit(0)) + tokens(F.col("goal")) + tokens(F.col("rationale"))
    rows = questions.join(spent, "question", "left").withColumn("used", used).withColumn("ceiling", F.col("window") - split(F.col("window"))["answer_reserve"])
    return rows.withColumn("overflow", ~F.coalesce("deep", F.lit(False)) & (F.col("used") > F.col("ceiling"))).drop("spent")


def replace(evidence: DataFrame, overflowing: DataFrame, most_tokens: int) -> DataFrame:
    """Evidence of the questions in ``overflowing`` as one row for each document and section; that of others as it is.

    A section's row has the texts in order, cut to ``most_tokens``, all pages and the best score. Sections without a
    title are one group, by a null-safe comparison. Rows that were put together before stay, unless the new row has
    their id. Only texts that begin within the budget are gathered. Rows with an empty text add pages and score only.
    """
    keys = ["question", "document_id", "section"]
    most = most_tokens * CHARS
    mine = evidence.join(overflowing.select("question").distinct(), "question", "left_semi")
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = mine.withColumn("at", F.coalesce(F.sum(F.when(F.col("content") != "", F.length("content") + len(BETWEEN)).otherwise(0)).over(before), F.lit(0)))
    begins = F.when((F.col("at") - len(BETWEEN) < most) & (F.col("content") != ""), F.struct("seq", "content"))
    merged = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(begins)).alias("c"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.max("score").alias("score"), F.min("seq").alias("seq"))
    name = F.concat(F.lit("aggregate:"), F.col("document_id").cast("string"), F.lit(":"), F.coalesce("section", F.lit("")))
    content = F.left(F.array_join(F.transform("c", lambda x: x["content"]), BETWEEN), F.lit(most))
    new = merged.select("question", uuid5(name).alias("evidence_id"), F.lit(AGGREGATED).alias("source_type"), "document_id", "section", content.alias("content"), "page_start", "page_end", "score", "seq")
    groups = merged.select(*[F.col(k).alias(f"_{k}") for k in keys])
    covered = (F.col("question") == F.col("_question")) & F.col("document_id").eqNullSafe(F.col("_document_id")) & F.col("section").eqNullSafe(F.col("_section"))
    kept = evidence.where(F.col("source_type") != AGGREGATED).join(groups, covered, "left_anti")
    earlier = evidence.where(F.col("source_type") == AGGREGATED).join(new.select("question", "evidence_id"), ["question", "evidence_id"], "left_anti")
    return kept.select(*new.columns).unionByName(earlier.select(*new.columns)).unionByName(new)
