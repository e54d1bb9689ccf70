"""Measures of rankings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.stored import cut, if_small

#: Words of a text by which those that hold it are found; shorter texts are found by all theirs.
WINDOW = 8
#: Points of the categories, the least total, and shares at which a category passes or passes in part.
POINTS = {"backend": 10, "parsing": 15, "retrieval": 20, "agent_qa": 20, "isolation": 15, "provider": 10, "frontend": 10}
LEAST_TOTAL = 90


def holders(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``query, id`` of the documents (``id, text``) that hold a text (``query, text``) as it stands; blank and null texts are held by none.

    A text's first and last words aside, its words lie whole in what holds it; windows of as many words are joined by
    hash, and what meets is compared. A text of one or two words may lie anywhere, so those are looked for in every text.
    """
    blanks = r"[ \t\n\r]+"
    split = lambda c: F.filter(F.split(c, blanks), lambda w: w != "")
    asked = cut(texts.select("query", F.col("text").alias("held"), split("text").alias("w")).where(F.size("w") >= 1))
    short = asked.where(F.size("w") < 3).select("query", "held")
    asked = asked.where(F.size("w") >= 3).withColumn("n", F.least(F.size("w") - 2, F.lit(WINDOW))).select("query", "held", "n", F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("n")), " ")).alias("key"))
    sizes = asked.select("n").distinct()  # WINDOW rows at most
    words = docs.select("id", "text", split("text").alias("w")).join(F.broadcast(sizes), F.size("w") >= F.col("n"))
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.col("n")), " "))))
    # few windows are those of a text: they are told apart before anything is dealt out
    met = words.select("id", "n", F.explode(keys).alias("key")).join(if_small(cut(asked.select("n", "key").distinct())), ["n", "key"], "left_semi")
    met = met.join(asked, ["n", "key"]).select("query", "id", "held").distinct()
    found = met.join(docs.select("id", "text"), "id").where(F.col("text").contains(F.col("held"))).select("query", "id")
    if short.isEmpty():
        return found
    return found.unionByName(docs.select("id", "text").join(short, F.col("text").contains(F.col("held"))).select("query", "id"))


def pass_rates(cases: DataFrame, kind: str, passed: Column) -> DataFrame:
    """Cases, passed and failed, and the rate, by kind."""
    done = F.count_if(passed)
    return cases.groupBy(kind).agg(F.count("*").alias("total"), done.alias("passed"), (F.count("*") - done).alias("failed"), F.round(done / F.count("*"), 4).alias("pass_rate"))


def scorecard(reports: DataFrame, backend: bool = True, frontend: bool = True, chat_isolation: bool = True, session_isolation: bool = True, citation_scope: bool = True, provider: tuple[bool, bool, bool] = (True, True, True), graph: bool = True, hybrid: bool = True) -> DataFrame:
    """A row for each category of the one row ``parsing, math, recall, leakage, qa`` (null: that report is missing) and the flags.

    ``total`` is out of 100. Any leak takes all points of the retrieval. ``gates_passed``: every mandatory gate holds;
    ``passed``: they do and the total is LEAST_TOTAL at least.
    """
    share = lambda *flags: sum(flags) / len(flags)
    graded = lambda value, full, half: F.when(value >= full, "pass").when(value >= half, "partial").otherwise("fail")
    plain = lambda s: F.lit("pass" if s == 1 else "partial" if s > 0 else "fail")
    kept, ready = share(chat_isolation, session_isolation, citation_scope), share(*provider)
    clean = F.col("leakage") == 0
    said = {
        "backend": (F.lit(float(backend)), plain(float(backend))), "parsing": (0.7 * F.col("parsing") + 0.3 * F.coalesce("math", F.lit(0.0)), graded(F.col("parsing"), 1.0, 0.5)),
        "retrieval": (F.when(clean, F.col("recall")).otherwise(0.0), F.when(clean & (F.col("recall") >= 0.95), "pass").when(F.col("recall") >= 0.5, "partial").otherwise("fail")),
        "agent_qa": (F.col("qa"), graded(F.col("qa"), 0.85, 0.5)), "isolation": (F.lit(kept), plain(kept)), "provider": (F.lit(ready), plain(ready)), "frontend": (F.lit(float(frontend)), plain(float(frontend))),
    }
    each = F.array(*[F.struct(F.lit(name).alias("category"), F.lit(POINTS[name]).alias("most"), F.round(POINTS[name] * F.coalesce(value, F.lit(0.0)), 2).alias("earned"), status.alias("status")) for name, (value, status) in said.items()])
    gates = F.lit(chat_isolation and session_isolation and citation_scope and graph and hybrid and ready == 1) & (said["parsing"][1] != "fail") & (said["retrieval"][1] != "fail")
    rows = reports.select(each.alias("c"), gates.alias("gates_passed")).withColumn("total", F.round(F.aggregate("c", F.lit(0.0), lambda s, c: s + c["earned"]), 2))
    return rows.withColumn("passed", F.col("gates_passed") & (F.col("total") >= LEAST_TOTAL)).select(F.inline("c"), "total", "gates_passed", "passed")


def ranking_measures(found: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query, recall, rr, ndcg`` of ``found`` (``query, id, rank``) against ``relevant`` (``query, id``).

    Queries come from ``relevant``, whose rows with a null id mark queries without relevant documents: those score 1
    for recall and nDCG. Gains are binary.
    """
    asked = relevant.groupBy("query").agg(F.count("id").alias("n"))
    hits = found.where(F.col("rank") <= k).join(relevant.where("id is not null"), ["query", "id"], "left_semi")
    sums = hits.groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = asked.join(sums, "query", "left")
    none = F.col("n") == 0
    return out.select("query", F.when(none, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(none, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def set_scores(found: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """Precision, recall and F1 of sets by key; two empty sets agree."""
    f = found.select(key, item).distinct().withColumn("f", F.lit(1))
    e = expected.select(key, item).distinct().withColumn("e", F.lit(1))
    sums = f.join(e, [key, item], "full_outer").groupBy(key).agg(F.sum(F.col("f") * F.col("e")).alias("tp"), F.sum("f").alias("f"), F.sum("e").alias("e"))
    tp, nf, ne = (F.coalesce(c, F.lit(0)) for c in ("tp", "f", "e"))
    p = F.when(nf == 0, F.when(ne == 0, 1.0).otherwise(0.0)).otherwise(tp / nf)
    r = F.when(ne == 0, F.when(nf == 0, 1.0).otherwise(0.0)).otherwise(tp / ne)
    return sums.select(key, p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
