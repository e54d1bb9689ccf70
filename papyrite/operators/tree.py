"""Document trees from ordered blocks, and questions about trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.stored import cut

def place(blocks: DataFrame, document: str = "document_id", order: str = "pos", kind: str = "kind", node: str = "node_id") -> DataFrame:
    """Add ``parent`` and ``level`` by the last headings before each block.

    A boundary is a section, appendix or references heading. A block belongs to the last subsection if that is newer
    than the last boundary, else to the boundary, else to the root (null). Two windows over the order suffice.
    """
    before = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    boundary = F.when(F.col(kind).isin("section", "appendix", "references"), F.struct(F.col(order).alias("at"), F.col(node).alias("id"), F.col(kind).alias("kind")))
    sub = F.when(F.col(kind) == "subsection", F.struct(F.col(order).alias("at"), F.col(node).alias("id")))
    rows = blocks.withColumn("__b", F.last(boundary, ignorenulls=True).over(before)).withColumn("__s", F.last(sub, ignorenulls=True).over(before))
    inside = F.col("__s").isNotNull() & (F.col("__b").isNull() | (F.col("__s.at") > F.col("__b.at")))
    heading = F.col(kind).isin("section", "appendix", "references")
    parent = F.when(heading, F.lit(None)).when(F.col(kind) == "subsection", F.col("__b.id")).when((F.col(kind) == "reference") & F.col("__b.kind").eqNullSafe(F.lit("appendix")), F.lit(None)).when((F.col(kind) == "reference"), F.col("__b.id")).when(inside, F.col("__s.id")).otherwise(F.col("__b.id"))
    level = F.when(heading, 1).when(F.col(kind) == "subsection", F.when(F.col("__b.id").isNull(), 1).otherwise(2)).when(parent.isNull(), 1).when(inside & (F.col(kind) != "reference"), 3).otherwise(2)
    return rows.withColumn("parent", parent).withColumn("level", level).drop("__b", "__s")


def _rounds(n: int) -> int:
    """Rounds of doubling in which every chain of ``n`` nodes ends; what is left then is on a cycle, or leads to one."""
    return max(1, n).bit_length() + 1


def page_ranges(nodes: DataFrame) -> DataFrame:
    """``page_start, page_end`` widened to all descendants (``id, parent``), however deep.

    After each round a node knows all within twice the distance, so a few rounds serve any depth, each on written rows.
    Nodes of a cycle count as below one another. A parent that isn't there ends the way up; rows without id stay as they are.
    """
    known = nodes.where("id is not null").select("id", F.col("parent").alias("jump"), F.col("page_start").alias("lo"), F.col("page_end").alias("hi"))
    state = cut(known)
    for _ in range(_rounds(state.count())):
        if state.where("jump is not null").isEmpty():
            break
        below = state.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.min("lo").alias("below_lo"), F.max("hi").alias("below_hi"))
        further = state.select(F.col("id").alias("jump"), F.col("jump").alias("further"))
        wider = state.join(below, "id", "left").select("id", "jump", F.least("lo", "below_lo").alias("lo"), F.greatest("hi", "below_hi").alias("hi"))
        state = cut(wider.join(further, "jump", "left").select("id", F.col("further").alias("jump"), "lo", "hi"))
    found = state.select("id", "lo", "hi")
    return nodes.join(found, "id", "left").withColumn("page_start", F.coalesce("lo", "page_start")).withColumn("page_end", F.coalesce("hi", "page_end")).drop("lo", "hi")


def nearest_ancestor(nodes: DataFrame, kinds: list[str], titled: bool = False) -> DataFrame:
    """``id, found``: each node itself or its nearest ancestor of one of the kinds; ``titled``: with a ``title`` that isn't blank.

    Each round doubles the way that is looked at. Nodes without one, on a cycle or below one, have null.
    """
    fits = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    if titled:
        fits = fits & (F.trim(F.coalesce("title", F.lit(""))) != "")
    done = cut(nodes.select("id", F.when(fits, F.col("id")).alias("found"), F.when(~fits, F.col("parent")).alias("next")))
    for _ in range(_rounds(done.count())):
        if done.where("next is not null").isEmpty():
            break
        up = done.select(F.col("id").alias("next"), F.col("found").alias("hit"), F.col("next").alias("further"))
        done = cut(done.join(up, "next", "left").select("id", F.coalesce("found", "hit").alias("found"), "further").withColumnRenamed("further", "next"))
    return done.select("id", "found")
