"""Corpus pipeline over ``documents``; each stage reads all that its predecessor kept.

Stages return the columns of documents and read no others. A document is a row: rows that share an id, or have none,
are judged by their own texts, and rows that repeat id and text are copies of one another.

- language_id: null and empty texts and those without a letter go, and those of which no language has ``LEAST_SHARE``.
- line_dedup: a document left without text goes; rows with a null id pass unchanged; n_chars follows the text.
- near_dedup: one row of each group stays, the least by id (null first), then by the hash of its text.
- decontamination: rows whose own text holds a benchmark item go.
- encoding: a row for each that is left; null texts would be empty.

Empty tables give empty tables. Null ``lang``, ``source`` and ``n_chars`` pass unchanged, but a changed text gets its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrite.llm import bpe, decontaminate, langid, linededup, neardup, registry
from papyrite.llm.shared import cut, drop, remainder, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a document's letters that its language must hold.
LEAST_SHARE = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``key``: the id and a hash of the text, never null."""
    return docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language (no letters), or of too many to tell, go."""
    ship(spark)
    rows = docs.select(*COLUMNS)
    model = langid.fit(rows, F.col("lang"), remainder(F.col("doc_id"), 4) != 2)
    # the text goes through as an own column, so that no join is needed
    named = langid.predict(rows, model, COLUMNS)
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays."""
    ship(spark)
    rows = docs.select(*COLUMNS)
    return linededup.remove(rows, linededup.find(rows)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship(spark)
    rows = _keyed(docs)
    gone = neardup.find(rows, "key").where("not kept").select("key").distinct()
    left = rows.join(gone, "key", "left_anti")
    # rows of one id and text are all kept or all gone; where ids repeat, one of such rows stays
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.struct("doc_id").alias("again")))
    if again.isEmpty():
        return left.select(*COLUMNS)
    own = F.struct("doc_id") == F.col("again")  # structs of null are equal
    return left.join(again, own, "left_anti").unionByName(left.join(again, own, "left_semi").dropDuplicates(["key"])).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    rows = _keyed(docs)
    gone = decontaminate.find(rows, table(spark, sf_dir, "benchmark"), "key").select("key").distinct()
    return rows.join(gone, "key", "left_anti").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    ship(spark)
    return bpe.encode_documents(docs.select(*COLUMNS), *registry.tokenizer_files())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: The first stage learns a model, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is a table in the shared folder until the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
