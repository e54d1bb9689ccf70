"""Layout JSON: pages of blocks of lines of spans, read with a fixed schema and flattened to typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrite.functions.ids import uuid5

_SPAN = "struct<bbox:array<double>,type:string,content:string,score:double,image_path:string,html:string>"
_LINE = f"struct<bbox:array<double>,spans:array<{_SPAN}>>"
_SUB = f"struct<type:string,bbox:array<double>,lines:array<{_LINE}>>"
_BLOCK = f"struct<type:string,bbox:array<double>,index:int,level:int,text_level:int,lines:array<{_LINE}>,blocks:array<{_SUB}>>"
SCHEMA = f"pdf_info array<struct<page_idx:int,page_size:array<double>,preproc_blocks:array<{_BLOCK}>,discarded_blocks:array<{_BLOCK}>>>"
#: Captions and footnotes that stand outside of their figure or table keep their type.
CAPTIONS = ("image_caption", "image_footnote", "table_caption", "table_footnote")
#: Discarded blocks come after all others of their page.
DISCARDED_FROM = 10_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """``document_id`` (the file's name) and ``pdf_info``; a file that is no JSON fails the read."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("document_id"), "pdf_info")


def _texts(lines: Column) -> Column:
    spans = F.flatten(F.transform(F.coalesce(lines, F.array().cast(f"array<{_LINE}>")), lambda x: x["spans"]))
    return F.filter(F.transform(spans, lambda s: F.trim(s["content"])), lambda c: c.isNotNull() & (c != ""))


def _sub(block: Column, kind: str, last: bool) -> Column:
    """The text of the first or last sub-block of a kind."""
    own = F.filter(F.coalesce(block["blocks"], F.array().cast(f"array<{_SUB}>")), lambda b: b["type"].endswith(kind))
    return F.array_join(_texts(F.get(own, F.size(own) - 1 if last else F.lit(0))["lines"]), " ")


def _inner(block: Column, field: str) -> Column:
    spans = F.flatten(F.flatten(F.transform(F.coalesce(block["blocks"], F.array().cast(f"array<{_SUB}>")), lambda b: F.transform(b["lines"], lambda x: x["spans"]))))
    return F.get(F.filter(F.transform(spans, lambda s: s[field]), lambda v: v.isNotNull()), 0)


def blocks(layout: DataFrame) -> DataFrame:
    """One row for each block: identity, page, order, type, level, text, caption, footnote, html, image, confidence, box."""
    pages = layout.select("document_id", F.explode("pdf_info").alias("p"))
    body = pages.select("document_id", "p", F.posexplode("p.preproc_blocks").alias("pos", "b")).withColumn("raw", F.lit(False))
    out = pages.select("document_id", "p", F.posexplode("p.discarded_blocks").alias("pos", "b")).withColumn("raw", F.lit(True))
    rows = body.unionByName(out)
    b = F.col("b")
    place = F.when(F.col("raw"), F.col("pos") + DISCARDED_FROM).otherwise(F.coalesce(b["index"], F.col("pos")))
    heading = (b["type"] == "title") | ((b["type"] == "text") & F.coalesce(b["level"], b["text_level"]).isin(1, 2))
    level = F.when(heading, F.when(F.coalesce(b["level"], b["text_level"]) == 1, 1).otherwise(2))
    kind = (
        F.when(F.col("raw"), "discarded").when(heading, "title").when(b["type"] == "ref_text", "reference").when(b["type"] == "interline_equation", "equation")
        .when(b["type"] == "image", "figure").when(b["type"] == "table", "table").when(b["type"] == "text", "paragraph").when(b["type"].isin(*CAPTIONS), b["type"]).otherwise("discarded")
    )
    joined = F.array_join(_texts(b["lines"]), " ")
    text = F.when(kind == "equation", F.concat(F.lit("$$"), F.coalesce(F.get(_texts(b["lines"]), 0), F.lit("")), F.lit("$$"))).otherwise(joined)
    scores = F.filter(F.flatten(F.transform(F.coalesce(b["lines"], F.array().cast(f"array<{_LINE}>")), lambda x: F.transform(x["spans"], lambda s: s["score"]))), lambda v: v.isNotNull())
    name = F.concat_ws(":", "document_id", F.col("p.page_idx").cast("string"), place.cast("string"), F.when(F.col("raw"), F.concat(F.lit("discarded:"), b["type"])).otherwise(kind))
    return rows.select(
        uuid5(name).alias("block_id"), "document_id", F.col("p.page_idx").alias("page"), place.alias("reading_order"), kind.alias("block_type"), level.alias("level"), text.alias("text"),
        _sub(b, "_caption", True).alias("caption"), _sub(b, "_footnote", True).alias("footnote"), _inner(b, "html").alias("html"), _inner(b, "image_path").alias("image_path"),
        F.array_min(scores).alias("confidence"), b["bbox"].alias("bbox"), F.coalesce("p.page_size", F.array(F.lit(612.0), F.lit(792.0))).alias("page_size"),
    )


def markdown(blocks_: DataFrame) -> DataFrame:
    """Pages joined to one text for each document, each page under its marker."""
    piece = F.when(F.col("block_type") == "title", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).when(F.col("block_type") == "table", F.coalesce("html", "text")).when(F.col("block_type") == "figure", F.concat(F.lit("!["), "caption", F.lit("]("), F.coalesce("image_path", F.lit("")), F.lit(")"))).otherwise(F.col("text"))
    rows = blocks_.where("block_type <> 'discarded'").select("document_id", "page", "reading_order", piece.alias("piece")).where("piece <> ''")
    pages = rows.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("reading_order", "piece"))).alias("p"))
    page = F.concat(F.lit("<Page "), F.col("page") + 1, F.lit(">\n"), F.array_join(F.transform("p", lambda x: x["piece"]), "\n"))
    return pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", page.alias("text")))).alias("t")).select("document_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("markdown"))
