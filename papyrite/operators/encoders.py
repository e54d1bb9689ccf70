"""Index rows of figures, tables and overviews: what is said of them, with the text around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions import text as T
from papyrite.functions.ids import uuid5
from papyrite.operators.hierarchy import strip
from papyrite.sources.layout import CAPTIONS

#: Blocks whose text is that of a page; characters of a page's text and of a narration; titles; overview lists.
PAGE_TEXT = ("paragraph", "title", "text", "reference", "equation", *CAPTIONS)
PAGE_CHARS, NARRATION_CHARS, TITLE_CHARS = 4000, 4000, 200
TOP_ENTITIES, TOP_METHODS = 20, 10


def _filled(text: Column) -> Column:
    """A text without white space at its ends; null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def page_text(blocks: DataFrame, most: int = PAGE_CHARS) -> DataFrame:
    """``document_id, page, page_text``: the texts of a page in order, a line each, cut behind ``most`` characters with " …".

    Only texts that begin within the limit are gathered, so a row is bounded. Pages without text are left out.
    """
    rows = blocks.where(F.col("block_type").isin(*PAGE_TEXT)).select("document_id", "page", "reading_order", "block_id", _filled(F.col("text")).alias("said")).where("said is not null")
    before = Window.partitionBy("document_id", "page").orderBy("reading_order", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.withColumn("at", F.coalesce(F.sum(F.length("said") + 1).over(before), F.lit(0))).where(F.col("at") <= most)
    joined = begins.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "said"))), lambda x: x["said"]), "\n").alias("t"))
    return joined.select("document_id", "page", F.when(F.length("t") > most, F.concat(F.left("t", F.lit(most)), F.lit(" …"))).otherwise(F.col("t")).alias("page_text"))


def table_embedding_text(caption: Column, footnote: Column, html: Column, page: Column) -> Column:
    """What of a table is embedded: caption, the text of its cells, footnote and page, those that there are, a blank line between them."""
    cells = F.nullif(T.table_text(F.coalesce(html, F.lit(""))), F.lit(""))
    parts = [_filled(caption), F.concat(F.lit("Natural-language table description: table rows and columns contain "), cells), F.concat(F.lit("Footnote: "), _filled(footnote)), F.concat(F.lit("Same-page context:\n"), _filled(page))]
    return F.concat_ws("\n\n", *parts)


def narration_text(caption: Column, narration: Column, footnote: Column, page: Column) -> Column:
    """What of a figure is embedded, cut behind NARRATION_CHARS characters."""
    whole = F.concat_ws("\n\n", _filled(caption), _filled(narration), F.concat(F.lit("Footnote: "), _filled(footnote)), F.concat(F.lit("Same-page context:\n"), _filled(page)))
    return F.when(F.length(whole) > NARRATION_CHARS, F.concat(F.left(whole, F.lit(NARRATION_CHARS)), F.lit(" …"))).otherwise(whole)


def chunk_id(document: Column, source_type: str | Column, node: Column, order: Column) -> Column:
    kind = F.lit(source_type) if isinstance(source_type, str) else source_type
    return uuid5(F.concat_ws(":", document.cast("string"), kind, node.cast("string"), order.cast("string")))


def narrations(told: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks of narrated figures and tables: ``id, document_id, source_type, title, heading_path, content, embedding_content, page_start, page_end, order_index``.

    ``told``: ``document_id, block_id, block_type, page, reading_order, caption, footnote, image_path, narration, error``.
    A table's content is its HTML, and what is embedded says it in words; a figure's says all at once. Failed and
    blank narrations give no chunk.
    """
    good = told.where(F.col("error").isNull() & _filled(F.col("narration")).isNotNull()).join(page_text(blocks), ["document_id", "page"], "left")
    table = F.col("block_type") == "table"
    page = F.coalesce("page_text", F.lit(""))
    content = F.when(table, strip(F.col("narration"))).otherwise(narration_text(F.col("caption"), F.col("narration"), F.col("footnote"), page))
    embedded = F.when(table, table_embedding_text(F.col("caption"), F.col("footnote"), F.col("narration"), page)).otherwise(content)
    kind = F.when(table, "table_record").otherwise("figure_caption")
    title = F.left(F.coalesce(F.nullif("caption", F.lit("")), "image_path", F.lit("")), F.lit(TITLE_CHARS))
    return good.select(
        chunk_id(F.col("document_id"), kind, F.col("block_id"), F.col("reading_order")).alias("id"), "document_id", kind.alias("source_type"), title.alias("title"), F.coalesce("caption", F.lit("")).alias("heading_path"),
        content.alias("content"), embedded.alias("embedding_content"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("reading_order").alias("order_index"),
    )


def overview_chunks(documents: DataFrame) -> DataFrame:
    """One or two chunks of each document (``document_id, overview, abstract, abstract_node``): the overview, and the abstract's summary if there is one."""
    name = lambda kind: uuid5(F.concat_ws(":", F.col("document_id").cast("string"), F.lit(kind)))
    row = lambda kind, node, title, content, order: F.struct(F.lit(kind).alias("source_type"), node.alias("node"), F.lit(title).alias("title"), content.alias("content"), F.lit(order).alias("order_index"))
    both = F.array(row("document_overview", name("document_overview"), "", F.coalesce("overview", F.lit("")), 0), F.when(F.col("abstract").isNotNull(), row("chapter_summary", F.coalesce("abstract_node", name("abstract")), "Abstract", F.col("abstract"), 1)))
    rows = documents.select("document_id", F.explode(F.array_compact(both)).alias("r")).select("document_id", "r.*")
    return rows.withColumn("id", chunk_id(F.col("document_id"), F.col("source_type"), F.col("node"), F.lit(0)))


def overview_tops(sections: DataFrame) -> DataFrame:
    """``document_id, entities, methods``: what a document's sections (``entities, methods`` as arrays) have, once each, sorted, the first TOP_ENTITIES and TOP_METHODS.

    Names are made different before they are gathered, and only the first of each part of a document go on.
    """

    def firsts(column: str, most: int) -> DataFrame:
        names = sections.select("document_id", F.explode(column).alias("x")).select("document_id", _filled(F.col("x")).alias("x")).where("x is not null").distinct()
        order = Window.partitionBy("document_id").orderBy("x")
        return names.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).groupBy("document_id").agg(F.array_sort(F.collect_list("x")).alias(column))

    every = sections.select("document_id").distinct()
    none = F.array().cast("array<string>")
    out = every.join(firsts("entities", TOP_ENTITIES), "document_id", "left").join(firsts("methods", TOP_METHODS), "document_id", "left")
    return out.select("document_id", F.coalesce("entities", none).alias("entities"), F.coalesce("methods", none).alias("methods"))
