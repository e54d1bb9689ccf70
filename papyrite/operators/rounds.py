"""Retrieval in rounds for many questions at once: tools, what they found, what is still open, and what is asked next.

Only questions with open requirements go on. What a round leaves is written, so each round's plan is that of one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.stored import cut

#: Rounds for gaps behind the first.
GAP_ROUNDS = 2
#: Marks of gaps that a literal search may close, besides labels.
LITERAL_GAP = ("html", "<table", "row", "column", "formula", "equation", "expression", "literal", "exact", "ablation", "api", "token")
GAP_LABEL = r"\b(?:figure|table)\s+\d+\b"


def status(tokens: Column, most: Column | int) -> Column:
    """Status of a call by the tokens it found (null: none): empty, overflow or ok."""
    return F.when(tokens.isNull(), "empty").when(tokens > most, "overflow").otherwise("ok")


def score_of(native: Column, cross: Column, fusion: Column, final: Column) -> Column:
    """The first of the scores that is neither missing nor 0; if all are, the last as it is."""
    return F.coalesce(*[F.nullif(s, F.lit(0.0)) for s in (native, cross, fusion)], final)


def call_records(calls: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """``calls`` (``question, tool, query``) with ``tokens, sources, status`` of their ``hits``; a call without hits is empty."""
    keys = ["question", "tool", "query"]
    sums = hits.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("sources"))
    found = calls.join(sums, keys, "left").withColumn("status", status(F.col("tokens"), most))
    return found.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("sources", F.coalesce("sources", F.lit(0)))


def unseen(hits: DataFrame, workspace: DataFrame) -> DataFrame:
    """Of each question's pieces of evidence those that its workspace lacks, the first by ``place`` of each; null ids are one piece."""
    first = Window.partitionBy("question", "evidence_id").orderBy("place", "tool", "query")
    new = hits.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    there = workspace.select(F.col("question").alias("q"), F.col("evidence_id").alias("e"))
    return new.join(there, (F.col("question") == F.col("q")) & F.col("evidence_id").eqNullSafe(F.col("e")), "left_anti")


def literal_gap(text: Column) -> Column:
    """Whether a gap may be one of literal marks."""
    low = F.lower(text)
    found = low.rlike(GAP_LABEL)
    for mark in LITERAL_GAP:
        found = found | low.contains(mark)
    return found


def gap_calls(open_: DataFrame) -> DataFrame:
    """``question, tool, query``: a hybrid search for each open requirement (``question, description``), and a literal one too where a question's gaps have literal marks."""
    marked = open_.groupBy("question").agg(F.max(literal_gap(F.col("description"))).alias("literal"))
    tools = F.when(F.col("literal"), F.array(F.lit("grep_document_chunks"), F.lit("search_hybrid"))).otherwise(F.array(F.lit("search_hybrid")))
    return open_.join(marked, "question").select("question", F.explode(tools).alias("tool"), F.col("description").alias("query")).distinct()


def retrieve(calls: DataFrame, requirements: DataFrame, tool: Callable[[DataFrame], DataFrame], covered: Callable[[DataFrame, DataFrame], DataFrame], most_tokens: int, gap_rounds: int = GAP_ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the first ``calls`` (``question, tool, query``) and then rounds for what is open: records, workspace, requirements.

    ``tool`` answers calls with ``question, tool, query, evidence_id, place, tokens, ...``; ``covered`` gives the
    ``question, requirement`` that a workspace satisfies. Records and evidence carry their ``round``, requirements the
    round that satisfied them (null: none did). A call that was made for a question is not made again; the rounds end
    when no question has anything open, or nothing new to ask, or after ``gap_rounds`` rounds for gaps.
    """
    left, calls = cut(requirements.distinct()), cut(calls.distinct())
    records, workspace, satisfied = [], None, []
    for n in range(gap_rounds + 1):
        hits = cut(tool(calls))
        records.append(cut(call_records(calls, hits, most_tokens).withColumn("round", F.lit(n))))
        new = unseen(hits, hits.where("false") if workspace is None else workspace).withColumn("round", F.lit(n))
        workspace = cut(new if workspace is None else workspace.unionByName(new))
        done = covered(workspace, left).select("question", "requirement").distinct()
        satisfied.append(cut(left.join(done, ["question", "requirement"], "left_semi").withColumn("round", F.lit(n))))
        left = cut(left.join(done, ["question", "requirement"], "left_anti"))
        if n == gap_rounds or left.isEmpty():
            break
        made = records[0]
        for record in records[1:]:
            made = made.unionByName(record)
        calls = cut(gap_calls(left).join(made, ["question", "tool", "query"], "left_anti"))
        if calls.isEmpty():
            break
    every, all_done = records[0], satisfied[0]
    for record in records[1:]:
        every = every.unionByName(record)
    for part in satisfied[1:]:
        all_done = all_done.unionByName(part)
    return every, workspace, all_done.unionByName(left.withColumn("round", F.lit(None).cast("int")))
