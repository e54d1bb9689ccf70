"""A hit with its neighbours, as far as a budget of characters goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.operators.evidence import FORMULA

#: Neighbours on either side, characters that each costs besides its text, kinds that may have another parent.
REACH, COST = 5, 32
ELSEWHERE = ("equation", "table", "figure")
LABEL = r"(?i)\b(figure|table)\s+(\d+)\b"


def is_formula(query: Column) -> Column:
    low = F.lower(query)
    found = F.lit(False)
    for mark in FORMULA:
        found = found | low.contains(mark)
    return found


def expand(hits: DataFrame, nodes: DataFrame, most_chars: int) -> DataFrame:
    """``hits`` (``question, query, document_id, place``) with ``content, page_start, page_end`` of the node and what is near it.

    ``nodes``: ``document_id, place`` (dense), ``kind, parent_id, title, text, page_start, page_end``. Up to REACH nodes on
    either side are tried by distance, the one before first (behind first if a formula is asked for, or the hit says
    "as follows"), and taken while the budget lasts; it is at least the hit's own length. Nodes of another parent are
    passed over unless they are equations, tables or figures, nodes without text always, and those with another label of
    the kind that the query names. For a formula, equations are taken beyond the budget. Each hit meets its neighbours
    by their place, eleven rows at most, so a group is bounded. A hit whose node isn't there gives no row.
    """
    n = nodes.select("document_id", "place", F.struct("kind", "parent_id", "title", F.coalesce("text", F.lit("")).alias("text"), "page_start", "page_end").alias("n"))
    asked = hits.select("question", "query", "document_id", F.col("place").alias("at")).distinct()
    centre = asked.join(n.withColumnRenamed("place", "at").withColumnRenamed("n", "c"), ["document_id", "at"])
    steps = F.explode(F.sequence(F.lit(-REACH), F.lit(REACH)))
    near = centre.withColumn("step", steps).withColumn("place", F.col("at") + F.col("step")).join(n, ["document_id", "place"])
    formula, label = is_formula(F.col("query")), F.regexp_extract("query", LABEL, 1)
    number = F.regexp_extract("query", LABEL, 2)
    text = F.col("n.text")
    apart = F.col("c.parent_id").isNotNull() & F.col("n.parent_id").isNotNull() & (F.col("c.parent_id") != F.col("n.parent_id")) & ~F.col("n.kind").isin(*ELSEWHERE)
    same = F.when(F.lower(label) == "figure", text.rlike(r"(?i)\bfigure\s+\d+\b")).when(F.lower(label) == "table", text.rlike(r"(?i)\btable\s+\d+\b")).otherwise(F.lit(False))
    other = same & ~F.lower(text).contains(F.lower(F.concat(label, F.lit(" "), number)))
    near = near.where((F.col("step") == 0) | ~(apart | (text == "") | other))
    behind = formula | F.lower(F.col("c.text")).contains("as follows")
    turn = F.abs("step") * 2 + F.when((F.col("step") > 0) == behind, 0).otherwise(1)
    rows = near.groupBy("question", "query", "document_id", "at").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("step") == 0, 0).otherwise(turn).alias("turn"), "place", "n"))).alias("r"))
    own = F.length(F.get("r", 0)["n"]["text"])
    rows = rows.withColumn("budget", F.greatest(F.lit(most_chars), own)).withColumn("formula", formula)

    def take(state: Column, row: Column) -> Column:
        projected = state["total"] + F.length(row["n"]["text"]) + COST
        fits = (projected <= F.col("budget")) | (F.col("formula") & (row["n"]["kind"] == "equation")) | (row["turn"] == 0)
        total = F.when(row["turn"] == 0, F.length(row["n"]["text"])).when(fits, projected).otherwise(state["total"])
        # once the budget is reached by what was taken, nothing more is
        return F.struct(total.cast("int").alias("total"), (state["full"] | (fits & (total >= F.col("budget")) & (row["turn"] != 0))).alias("full"), F.when(fits & ~state["full"], F.concat(state["taken"], F.array(row["place"].cast("long")))).otherwise(state["taken"]).alias("taken"))

    begin = F.struct(F.lit(0).alias("total"), F.lit(False).alias("full"), F.array().cast("array<bigint>").alias("taken"))
    taken = rows.withColumn("taken", F.aggregate("r", begin, take, lambda s: s["taken"]))
    kept = F.filter("r", lambda x: F.array_contains(F.col("taken"), x["place"].cast("long")))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["place"].alias("place"), x["n"].alias("n"))))
    heading = lambda x: F.coalesce(F.nullif(x["n"]["title"], F.lit("")), x["n"]["kind"])
    part = lambda x: F.concat(F.lit("["), heading(x), F.lit("]\n"), x["n"]["text"])
    out = taken.withColumn("o", ordered).withColumn("content", F.array_join(F.transform(F.filter("o", lambda x: x["n"]["text"] != ""), part), "\n\n"))
    pages = lambda f, name: f(F.transform("o", lambda x: x["n"][name]))
    return out.select("question", "query", "document_id", F.col("at").alias("place"), "content", pages(F.array_min, "page_start").alias("page_start"), pages(F.array_max, "page_end").alias("page_end"))
