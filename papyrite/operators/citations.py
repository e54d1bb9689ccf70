"""Citation marks of answers and the evidence behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.operators.evidence import markers

#: Fixed value: characters of an excerpt.
EXCERPT = 500


def positions(evidence: DataFrame, shown: Column, order: str = "seq") -> DataFrame:
    """``evidence`` with ``place``, its number in the question's whole list, and ``mark``, its number among those ``shown`` (else null); both from 1."""
    upto = Window.partitionBy("question").orderBy(order)
    told = F.coalesce(shown, F.lit(False))
    return evidence.withColumn("place", F.row_number().over(upto)).withColumn("mark", F.when(told, F.count(F.when(told, 1)).over(upto.rowsBetween(Window.unboundedPreceding, 0))))


def cite(answers: DataFrame, numbered: DataFrame, number: str = "mark") -> DataFrame:
    """A row for each different mark of each answer (``question, answer``), in order: ``question, marker, nth, valid, document_id, place, section, page_start, page_end, excerpt``.

    ``number`` names the numbering of ``numbered`` that the marks mean; ``place`` says where the evidence stands in the
    whole list. A mark without evidence is there too, not ``valid``. Null answers have no marks.
    """
    marked = answers.select("question", F.posexplode(markers(F.col("answer"))).alias("nth", "marker"))
    known = numbered.where(F.col(number).isNotNull()).select("question", F.col(number).cast("int").alias("marker"), F.col("place").cast("int").alias("place"), "document_id", "section", "page_start", "page_end", F.left("content", F.lit(EXCERPT)).alias("excerpt"))
    return marked.join(known, ["question", "marker"], "left").withColumn("valid", F.col("place").isNotNull())


def documents_used(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """``question, document_id``: documents that are cited or give evidence, once each."""
    cited = citations.where("valid").select("question", "document_id")
    return cited.unionByName(evidence.select("question", "document_id")).where("document_id is not null").distinct()
