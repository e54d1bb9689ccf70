"""Filter interaction audit: which of five filters removes what, in every order of applying them.

Duplicates are found by refining a partition of all texts: classes by length in code points first, then by the hash of
one block of the text after the other; classes of one go after every round. Texts that are left are compared whole. Then
every document has the set of filters that it fails, and the audit needs no more than the counts of those sets.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import WHITE, cut, drop, join_classes

LETTERS = "ABCDE"
#: Failure conditions of A to D: words under MIN_WORDS, different words under this share, capitals over this share, a symbol.
MIN_WORDS, DIFFERENT_PCT, CAPITALS_PCT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: Where the blocks of a text end, in code points; the last block runs to the end of the text.
BORDERS = (64, 512, 4096)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def blocks(text: Column) -> list[Column]:
    """The hash of each block of a text."""
    starts = (0, *BORDERS)
    return [F.xxhash64(F.substring(text, a + 1, b - a)) for a, b in zip(starts, BORDERS)] + [F.xxhash64(F.substring(text, starts[-1] + 1, 2**31 - 1))]


def _keys(text: Column) -> list[Column]:
    """The class of a text after each round: its length, then with the hash of one more block each."""
    keys = [F.length(text).cast("long")]
    for block in blocks(text):
        keys.append(F.xxhash64(keys[-1], block))
    return keys


def _failed(text: Column) -> Column:
    """The letters of the filters A to D that a text (not null) fails."""
    inner = F.btrim(text, F.lit(WHITE))
    words = F.split(inner, "[ \\t-\\r]+")
    n = F.when(inner == "", 0).otherwise(F.size(words))
    fails = {
        "A": n < MIN_WORDS,
        "B": (inner != "") & (100 * F.size(F.array_distinct(words)) < DIFFERENT_PCT * n),
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > CAPITALS_PCT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }
    return F.concat(*[F.when(fails[letter], letter).otherwise("") for letter in "ABCD"])


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id, failed`` and the columns ``keep`` of each document; ``failed`` has the letters of the filters it fails, in order.

    E: the text equals that of a smaller id, wherever in the table. Null texts are empty ones. A null id is smaller than
    none and greater than none, so its row never fails E; rows that share id and text don't fail it by each other.
    """
    keep = keep or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(name).alias(f"keep{i}") for i, name in enumerate(keep)]
    keys = [f"key{i}" for i in range(len(BORDERS) + 2)]
    rows = cut(docs.select(F.col(id_col).alias("id"), *kept, _failed(text).alias("failed"), *[key.alias(name) for name, key in zip(keys, _keys(text))]))
    total = rows.count()
    left, done = rows.where("id is not null").select("id", *keys), []
    for name in keys:  # classes of one go after every round
        classes = cut(left.groupBy(F.col(name).alias("class")).agg(F.count("*").alias("n")).where("n > 1"))
        left = cut(join_classes(left, classes, name, total).where("n is not null").drop("n"))
        done += [classes, left]
    # what is left is compared whole: copies meet on their text itself, and are counted before the shuffle
    last = keys[-1]
    alive = cut(left.groupBy(F.col(last).alias("class")).agg(F.count("*").alias("n")))
    whole = join_classes(docs.select(F.col(id_col).alias("id"), text.alias("text"), _keys(text)[-1].alias(last)).where("id is not null"), alive, last, total).where("n is not null")
    texts = whole.groupBy(last, "text").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    firsts = cut(texts.groupBy(F.col(last).alias("class")).agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.count("*").alias("texts")))
    again = F.when(F.col("id") > F.col("low"), "E").otherwise("")
    placed = join_classes(rows, firsts, last, total)
    told = placed.where("texts is null or texts = 1 or id is null").select("id", *[f"keep{i}" for i in range(len(keep))], F.concat("failed", F.coalesce(again, F.lit(""))).alias("failed"))
    if not firsts.where("texts > 1").isEmpty():
        # different texts whose lengths and hashes all agree: the class is the text itself
        shared = firsts.where("texts > 1").select("class", "n")
        own = join_classes(docs.select(F.col(id_col).alias("id"), *kept, text.alias("text"), _failed(text).alias("failed"), _keys(text)[-1].alias(last)).where("id is not null"), shared, last, total).where("n is not null").drop("n")
        lows = join_classes(whole.drop("n"), shared, last, total).where("n is not null").groupBy(last, "text").agg(F.min("id").alias("low"))
        told = told.unionByName(own.join(lows, [last, "text"]).select("id", *[f"keep{i}" for i in range(len(keep))], F.concat("failed", again).alias("failed")))
    out = cut(told)
    drop(rows, alive, firsts, *done)
    return out.select("id", *[F.col(f"keep{i}").alias(name) for i, name in enumerate(keep)], "failed")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: what the step's filter does there.

    ``part`` is the value of ``part_col``, null as the empty string. A document is good or toxic if a row of ``labels``
    with its id says so; labels of ids that aren't in ``docs``, of null ids and null marks count for nothing. An empty
    table has no parts and gives no rows.
    """
    marked = mark(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(part_col).alias("part")), "id", "text", ["part"])
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    part = F.coalesce("part", F.lit("")).alias("part")
    count = [F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")]
    sets = cut(marked.join(known, "id", "left").groupBy(part, "failed").agg(*count))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    each = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    each = each.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("before", F.expr("substring(filter_order, 1, step - 1)"))
    fails, passed = F.col("failed").contains(F.col("letter")), F.expr("translate(failed, before, '')") == F.col("failed")
    # of the orders, each filter that a document fails comes first among those in an equal share
    share = F.when(fails, F.col("n") * F.lit(120) / F.length("failed")).otherwise(0).cast("long")
    total = lambda said, value="n": F.sum(F.when(said, F.col(value)).otherwise(0)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(passed & ~fails).alias("kept"), total(passed & fails).alias("removed"), total(fails & ~passed).alias("redundant"), total(F.col("failed") == F.col("letter")).alias("unique_fails"),
        total(passed & fails, "good").alias("good_lost"), total(passed & fails, "toxic").alias("toxic_lost"), F.sum(share).alias("shapley"),
    )
