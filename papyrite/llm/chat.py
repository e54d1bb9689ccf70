"""Chat formatting: reply trees become one training text for each chosen path, by DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.llm.shared import cut

#: What surrounds a turn: HEAD role COLON text TAIL.
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Free a text of control strings, reversibly: afterwards a backslash is always followed by 0, 1 or 2."""
    for found, put in (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2")):
        text = F.replace(text, F.lit(found), F.lit(put))
    return text


def unescape(text: Column) -> Column:
    for found, put in (("\\2", "</turn>"), ("\\1", "###"), ("\\0", "\\")):
        text = F.replace(text, F.lit(found), F.lit(put))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\3"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\3"), F.lit(":")))


def paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """Rows ``tree, leaf, rank, depth, id`` of the ``per_tree`` best root-to-leaf paths of each tree.

    ``nodes``: ``tree, id, parent`` (null or unknown: a root), ``score`` (null: 0). Ids are unique within a tree; of rows
    that repeat one, those with the least parent and score count (null first), once. A path's rank follows the mean
    score of its nodes, ties the smaller leaf. Each self-join doubles the reach of the links, so their number is the
    logarithm of the depth; only chosen leaves are then walked back. ``depth`` counts from the root. Rows without a tree
    or an id take no part. Nodes on a cycle have no root and no path. Without rows there are no paths.
    """
    once = nodes.where("tree is not null and id is not null").groupBy("tree", "id").agg(F.min(F.struct("parent", "score")).alias("n")).select("tree", "id", "n.parent", "n.score")
    parents = once.select("tree", F.col("id").alias("parent"))
    known = once.join(parents.withColumn("known", F.lit(True)), ["tree", "parent"], "left")
    link = cut(known.select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("n")))
    # rows whose walk has ended, and for each doubling those that go on; only those are joined again
    ended, levels = [link.where("up is null")], [link.where("up is not null")]
    size, total = 1, link.count()
    while size <= total and not levels[-1].isEmpty():
        known = reduce(DataFrame.unionByName, ended, levels[-1])
        above = known.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("n").alias("n2"))
        step = cut(levels[-1].join(above, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n")))
        ended.append(step.where("up is null"))
        levels.append(step.where("up is not null"))
        size *= 2
    inner = levels[0].select("tree", F.col("up").alias("id")).distinct()
    leaves = reduce(DataFrame.unionByName, ended).join(inner, ["tree", "id"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)
    walked = chosen.select("tree", F.col("id").alias("leaf"), "rank", F.col("n").alias("depth"), "id")
    for k, step in enumerate(levels):
        up = step.select("tree", "id", "up")
        higher = walked.join(up, ["tree", "id"]).select("tree", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("id"))
        walked = cut(walked.unionByName(higher))  # it is used twice, so without a table each step would double the plan
    return walked


def format_turns(turns: DataFrame, keys: list[str], order: str = "depth") -> DataFrame:
    """One text for each ``keys``: ``formatted`` and ``loss`` (array of start and end, code points, end exclusive).

    ``turns``: ``keys``, ``order``, ``role``, ``text``; nulls count as empty. The loss mask holds the texts of the role
    ``assistant``, empty ones too.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), _escape_role(role), F.lit(COLON))
    rows = turns.select(*keys, order, (role == "assistant").alias("learn"), head.alias("head"), escape(text).alias("body"))
    rows = rows.withColumn("size", (F.length("head") + F.length("body") + len(TAIL)).cast("long"))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct(F.col(order).alias("at"), F.concat("head", "body", F.lit(TAIL)).alias("turn"), "learn", "start", (F.col("start") + F.length("body")).alias("end"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    spans = F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.select(*keys, F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array of (role, text)."""
    parts = F.split(formatted, TAIL, -1)
    colon = lambda p: F.locate(COLON, p, len(HEAD) + 1)
    read = lambda p: F.struct(
        _unescape_role(F.substring(p, F.lit(len(HEAD) + 1), colon(p) - len(HEAD) - 1)).alias("role"),
        unescape(F.substring(p, colon(p) + len(COLON), F.length(p))).alias("text"),
    )
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), read)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def chain(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations as trees without branches: ``tree, id, parent, score, role, text``; rows by turn, ties by role and text."""
    tree = F.struct(F.col(conv_col).isNull().alias("none"), F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("conv"))
    order = Window.partitionBy("tree").orderBy(F.col(turn_col).asc_nulls_first(), "role", "text")
    rows = messages.select(tree.alias("tree"), turn_col, "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_trees(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """``tree, leaf, rank, formatted, loss`` of the chosen paths of ``nodes`` (``tree, id, parent, score, role, text``).

    Of rows that repeat an id within a tree the one with the least parent, score, role and text counts (null first); what
    ``paths`` says of nulls, ties, cycles and empty tables holds. Other columns are not read.
    """
    row = F.min(F.struct("parent", "score", "role", "text")).alias("n")
    nodes = cut(nodes.groupBy("tree", "id").agg(row).select("tree", "id", "n.*"))
    turns = paths(nodes, per_tree).join(nodes.select("tree", "id", "role", "text"), ["tree", "id"])
    return format_turns(turns, ["tree", "leaf", "rank"])
