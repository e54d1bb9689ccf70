"""Document trees from typed blocks: one ordered stream cut into phases, numbered so that subtrees are ranges.

A document's blocks are in the order of page and reading order. The phases are the title, the authors before the first
heading, the abstract between its heading and the next, and the body. In the body the last boundary (section, appendix
or references heading) and the last numbered subheading behind it say where a block belongs; so windows over one order
of one partitioning do all the work, and the tree's depth is three at most. Every node carries its path and an interval:
what is below it has numbers between its ``enter`` and its ``leave``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions.ids import uuid5
from papyrite.functions.text import STRIP
from papyrite.sources.layout import CAPTIONS

#: Patterns of headings, of authors and of the beginning of an abstract.
REFERENCES = r"(?i)^(references|bibliography)$"
APPENDIX = r"(?i)^appendix\b|^\d+\s+appendix\b|^[A-Z]\s+APPENDIX\b"
SUBSECTION = r"^(?:[A-Z]|\d+)(?:\.\d+)+(?:\s|$)"
AFFILIATION = r"(?i)<sup>[\d\*†‡§¶]+</sup>"
SENTENCE_END = r"\.\s+[A-Z]"
ABSTRACT = r"(?i)^abstract\s*[—\-–:]\s*"
#: Characters from which a text is no list of authors, and sentence ends likewise.
AUTHORS_UNDER, SENTENCES_UNDER = 400, 3


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP))


def looks_like_authors(text: Column) -> Column:
    """Short, with a mark of an affiliation or an address, and hardly any sentences."""
    return (F.length(text) < AUTHORS_UNDER) & (text.rlike(AFFILIATION) | text.contains("@")) & (F.size(F.regexp_extract_all(text, F.lit(SENTENCE_END), F.lit(0))) < SENTENCES_UNDER)


def heading_kind(title: Column) -> Column:
    """What a stripped heading opens."""
    return F.when(title.rlike(REFERENCES), "references").when(title.rlike(APPENDIX), "appendix").when(title.rlike(SUBSECTION), "subsection").otherwise("section")


def _content(kind: Column) -> Column:
    """What a body node says: captions of figures and tables, formulas, texts; headings say nothing."""
    said = F.array_join(F.filter(F.array("caption", "footnote"), lambda x: x.isNotNull() & (x != "")), "\n")
    return F.when(kind.isin("section", "subsection", "appendix"), "").when(kind.isin("figure", "table"), said).otherwise(F.coalesce("text", F.lit("")))


def derive(blocks: DataFrame) -> DataFrame:
    """The nodes of each document's tree, from the columns that ``layout.blocks`` gives; pages count from 1.

    Result: ``document_id, id, parent_id, kind, title, content, page_start, page_end, order_index, level, enter, leave,
    path, section_id, html, image_path, source_block_ids``. ``order_index`` is 0 for the root, then the authors, the
    abstract and the body in order; ids follow from it. ``path`` has the order of the node and of all above it, root
    first; ``section_id`` the nearest section, subsection or appendix, itself counted. Pages include all that is below.

    Headings of level 1 behind the first are dropped, as are discarded blocks, headings of further levels and blocks of
    unknown types. Null texts are empty. A document of dropped blocks alone has a root.
    """
    kind, text, level = F.col("block_type"), F.coalesce("text", F.lit("")), F.col("level")
    order = Window.partitionBy("document_id").orderBy("page", "reading_order", "block_id")
    upto, before, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("document_id")
    count = lambda said: F.count(F.when(said, 1)).over(upto)
    first, second = (kind == "title") & (level == 1), (kind == "title") & (level == 2)
    rows = blocks.withColumn("text", text).withColumn("heads", count(second)).withColumn("titles", count(first))
    abstract = second & (F.lower(strip(F.col("text"))) == "abstract")
    rows = rows.withColumn("abstracts", count(abstract)).withColumn("abstract_at", F.min(F.when(abstract, F.col("heads"))).over(whole))
    author = (kind == "paragraph") & (F.col("heads") == 0) & looks_like_authors(F.col("text"))
    begins = (kind == "paragraph") & (F.col("page") == 1) & ~author & F.col("text").rlike(ABSTRACT) & F.col("abstract_at").isNull()
    rows = rows.withColumn("author", author).withColumn("begins", count(begins))
    headed = (F.col("heads") == F.col("abstract_at")) & ((kind == "paragraph") | (abstract & (F.col("abstracts") == 1)))
    rows = rows.withColumn("in_abstract", F.coalesce(headed, F.lit(False)) | (begins & (F.col("begins") == 1)))
    known = second | kind.isin("reference", "figure", "table", "equation", "paragraph", *CAPTIONS)
    phase = F.when(first & (F.col("titles") == 1), 0).when(F.col("author"), 1).when(F.col("in_abstract"), 2).when(known, 3)
    rows = rows.withColumn("phase", phase)
    there = lambda n: F.coalesce(F.max((F.col("phase") == n).cast("int")).over(whole), F.lit(0))
    rows = rows.withColumn("at", there(1) + there(2) + count(F.col("phase") == 3))
    body_kind = F.when(second, heading_kind(strip(F.col("text")))).when(kind.isin(*CAPTIONS), "paragraph").otherwise(kind)
    rows = rows.withColumn("opens", F.when(F.col("phase") == 3, body_kind))
    last = lambda *kinds: F.last(F.when(F.col("opens").isin(*kinds) & second, F.struct("at", "opens")), ignorenulls=True).over(before)
    rows = rows.withColumn("b", last("section", "appendix", "references")).withColumn("s", last("subsection"))
    rows = rows.withColumn("s_at", F.when(F.col("b").isNull() | (F.col("s.at") > F.col("b.at")), F.col("s.at"))).withColumn("b_at", F.col("b.at"))
    opens, boundary = F.col("opens"), F.col("opens").isin("section", "appendix", "references") & second
    parent = (
        F.when(boundary, 0).when((opens == "subsection") & second, F.coalesce("b_at", F.lit(0)))
        .when(opens == "reference", F.when(F.col("b.opens") == "appendix", 0).otherwise(F.coalesce("b_at", F.lit(0)))).otherwise(F.coalesce("s_at", "b_at", F.lit(0)))
    )
    depth = F.when(boundary, 1).when(((opens == "subsection") & second) | (opens == "reference"), 2).otherwise(F.when(F.col("s_at").isNotNull(), 3).when(F.col("b_at").isNotNull(), 2).otherwise(1))
    above = F.when(parent == 0, F.array(F.lit(0))).when(parent == F.col("b_at"), F.array(F.lit(0), F.col("b_at"))).otherwise(F.array_compact(F.array(F.lit(0), F.col("b_at"), F.col("s_at"))))
    section = F.when(second, F.col("at")).otherwise(F.nullif(parent, F.lit(0)))
    at = lambda c: c.cast("int")
    body = rows.where("phase = 3").select(
        "document_id", at(parent).alias("parent"), F.when(opens == "references", "section").otherwise(opens).alias("kind"), F.when(second, strip(F.col("text"))).when(opens.isin("figure", "table"), F.col("caption")).alias("title"),
        _content(F.when(second & (opens == "references"), "section").otherwise(opens)).alias("content"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), at(F.col("at")).alias("order_index"), depth.alias("level"),
        F.transform(F.concat(above, F.array(F.col("at"))), at).alias("path"), at(section).alias("section"), "html", "image_path", F.array("block_id").alias("source_block_ids"),
    )
    ordered = lambda said, value: F.transform(F.array_sort(F.collect_list(F.when(said, F.struct("page", "reading_order", "block_id", F.col(value).alias("v"))))), lambda x: x["v"])
    in_phase = lambda n: F.col("phase") == n
    paged = lambda n: [f(F.when(in_phase(n), F.col("page"))).alias(f"{name}{n}") for f, name in ((F.min, "low"), (F.max, "high"))]
    heads = rows.groupBy("document_id").agg(
        F.max(F.when(in_phase(0), F.col("text"))).alias("title"), F.max(F.when(in_phase(0), F.col("block_id"))).alias("title_id"), *paged(0), *paged(1), *paged(2), F.max("abstracts").alias("headed"),
        ordered(in_phase(1), "text").alias("said1"), ordered(in_phase(1), "block_id").alias("ids1"), ordered(in_phase(2) & (kind == "paragraph"), "text").alias("said2"), ordered(in_phase(2), "block_id").alias("ids2"),
    )

    def front(name: str, title: Column, content: Column, low: Column, high: Column, place: Column, ids: Column) -> Column:
        root = F.lit(name == "document")
        values = {"parent": F.when(~root, 0), "kind": F.lit(name), "title": title, "content": content, "page_start": low, "page_end": high, "order_index": place.cast("int"), "level": F.when(root, 0).otherwise(1), "path": F.when(root, F.array(F.lit(0))).otherwise(F.array(F.lit(0), place.cast("int"))), "section": F.lit(None).cast("int"), "html": F.lit(None).cast("string"), "image_path": F.lit(None).cast("string"), "source_block_ids": ids}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    one = F.lit(1).cast(dict(blocks.dtypes)["page"])
    no_ids = F.array().cast("array<string>")
    fronts = F.array(
        front("document", F.col("title"), F.lit(""), F.coalesce("low0", one), F.coalesce("high0", one), F.lit(0), F.coalesce(F.array_compact(F.array("title_id")), no_ids)),
        F.when(F.size("ids1") > 0, front("authors", F.lit(None).cast("string"), F.array_join("said1", " "), F.col("low1"), F.col("high1"), F.lit(1), F.col("ids1"))),
        F.when(F.size("ids2") > 0, front("abstract", F.lit("Abstract"), F.array_join("said2", " "), F.col("low2"), F.col("high2"), (F.size("ids1") > 0).cast("int") + 1, F.col("ids2"))),
    )
    nodes = heads.select("document_id", F.explode(F.array_compact(fronts)).alias("n")).select("document_id", "n.*").unionByName(body)
    return _numbered(nodes)


def _numbered(nodes: DataFrame) -> DataFrame:
    """Interval, pages of all below, and ids, from paths of four nodes at most."""
    step = lambda i: F.coalesce(F.get("path", F.lit(i)), F.lit(-1))
    rows = nodes.withColumn("p1", step(1)).withColumn("p2", step(2)).withColumn("p3", step(3))
    windows = [Window.partitionBy("document_id", *[f"p{k}" for k in range(1, i + 1)]) for i in range(4)]
    own = F.size("path") - 1
    over = lambda f: F.when(own == 0, f.over(windows[0])).when(own == 1, f.over(windows[1])).when(own == 2, f.over(windows[2])).otherwise(f.over(windows[3]))
    rows = rows.withColumn("low", over(F.min("page_start"))).withColumn("high", over(F.max("page_end"))).withColumn("below", over(F.count("*")))
    rows = rows.withColumn("enter", (F.row_number().over(Window.partitionBy("document_id").orderBy("p1", "p2", "p3")) - 1).cast("int"))
    node_id = lambda place: uuid5(F.concat_ws(":", F.col("document_id").cast("string"), F.lit("node"), place.cast("string")))
    return rows.select(
        "document_id", node_id(F.col("order_index")).alias("id"), F.when(F.col("parent").isNotNull(), node_id(F.col("parent"))).alias("parent_id"), "kind", "title", "content", F.col("low").alias("page_start"), F.col("high").alias("page_end"),
        "order_index", "level", "enter", (F.col("enter") + F.col("below") - 1).cast("int").alias("leave"), "path", F.when(F.col("section").isNotNull(), node_id(F.col("section"))).alias("section_id"), "html", "image_path", "source_block_ids",
    )


def boundaries(nodes: DataFrame) -> DataFrame:
    """``document_id, references_start, appendix_start``: the order of the first reference and of the first appendix."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("order_index")))
    return nodes.groupBy("document_id").agg(first("reference").alias("references_start"), first("appendix").alias("appendix_start"))


def owners(nodes: DataFrame) -> DataFrame:
    """``document_id, block_id, id``: the node of each block, a row for each claim."""
    return nodes.select("document_id", F.explode("source_block_ids").alias("block_id"), "id")


def claimed_twice(nodes: DataFrame) -> DataFrame:
    """``block_id, claims`` of blocks that more than one node claims; empty for what ``derive`` gives."""
    return owners(nodes).groupBy("block_id").agg(F.count("*").alias("claims")).where("claims > 1")


def section_text(nodes: DataFrame, blocks: DataFrame, descendants: bool = False) -> DataFrame:
    """``document_id, id, text`` of sections, subsections and appendices: the texts of their own blocks, or of all below as well.

    A node gives its text to the nodes on its path, three at most, so no pair of nodes is compared. Blocks without text add nothing.
    """
    said = nodes.select("document_id", "id", "kind", "order_index", "path", F.posexplode("source_block_ids").alias("n", "block_id"))
    said = said.join(blocks.select("document_id", "block_id", F.coalesce("text", F.lit("")).alias("text")), ["document_id", "block_id"])
    to = F.explode("path") if descendants else F.explode(F.array("order_index"))
    parts = said.where("text <> ''").select("document_id", to.alias("at"), F.struct("order_index", "n", "text").alias("part"))
    texts = parts.groupBy("document_id", F.col("at").alias("order_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "\n").alias("text"))
    wanted = nodes.where(F.col("kind").isin("section", "subsection", "appendix")).select("document_id", "id", "order_index")
    return wanted.join(texts, ["document_id", "order_index"], "left").select("document_id", "id", F.coalesce("text", F.lit("")).alias("text"))


def source_nodes(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``facts`` (with ``document_id, block_id``) with ``node_id``, that of its block, and ``source_node_id``, its nearest section; null where there is none."""
    own = nodes.select("document_id", F.explode("source_block_ids").alias("block_id"), F.col("id").alias("node_id"), F.col("section_id").alias("source_node_id"))
    return facts.join(own, ["document_id", "block_id"], "left")


def within(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``top_id, id``: what is below each node of ``tops``, by its interval; each node looks up the nodes on its path."""
    wanted = tops.select("document_id", F.col("order_index").alias("at"), F.col("id").alias("top_id"), F.col("enter").alias("low"), F.col("leave").alias("high"))
    below = nodes.select("document_id", "id", "enter", F.explode("path").alias("at"))
    return below.join(wanted, ["document_id", "at"]).where((F.col("enter") > F.col("low")) & (F.col("enter") <= F.col("high"))).select("document_id", "top_id", "id")
