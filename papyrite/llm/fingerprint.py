"""Document fingerprints: threshold-scaled sketches of five-word shingles, by DataFrame functions only.

A sketch keeps every shingle hash under a fixed share of the hash range, so sketches of any two documents, however
unequal, can be compared and merged. A text none of whose hashes is that low keeps its lowest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.llm.shared import words

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
#: Ranges into which documents are dealt for finding each one's neighbour, for each shuffle partition; and at most.
RANGES_EACH, RANGES_MOST = 4, 8192

_LOWEST = -(1 << 63)


def _hashes(tokens: Column) -> Column:
    """A hash for each run of five words; of all words together if there are fewer."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", tokens)))).otherwise(F.array().cast("array<bigint>"))


def _low(hashes: Column) -> Column:
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(_LOWEST + (1 << 64) // SCALE))))
    return F.when((F.size(kept) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(kept)


def sketch(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the sketch of a text as a sorted array<long>."""
    steps = df.withColumn("__words", words(text)).withColumn("__hashes", _hashes(F.col("__words")))
    return steps.withColumn(name, _low(F.col("__hashes"))).drop("__words", "__hashes")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together (shingles across their border aside)."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit(_LOWEST + (1 << 64) // SCALE))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def text_of(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (``id, text, fp``) with ``next_text, next_fp``: those of the next lower id; the last one's next is the first.

    Documents are dealt by ranges of the id, which quantiles make even; each range also gets a copy of the next
    range's first row, so one window over each range is enough. Repeated ids go by the hash of the text.
    """
    spark = docs.sparkSession
    key, tie = F.coalesce(F.col("id").cast("long"), F.lit(_LOWEST)), F.xxhash64("text")
    count = min(RANGES_MOST, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(key.alias("key"))
    cuts = ids.agg(F.percentile_approx("key", [i / count for i in range(1, count)], 20 * count).alias("q")).first().q or []
    cuts = sorted(set(cuts), reverse=True)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    powers = F.array(*[F.lit(1 << p) for p in range(len(cuts).bit_length() - 1, -1, -1)]) if cuts else F.array(F.lit(1))
    # how many bounds lie above the key, by halving
    above = F.aggregate(powers, F.lit(0), lambda i, p: F.when(F.coalesce(F.get(bounds, i + p - 1) > F.col("key"), F.lit(False)), i + p).otherwise(i))
    dealt = docs.withColumn("key", key).withColumn("tie", tie).withColumn("range", above)
    # one row for each range
    heads = dealt.select("range", "key", "tie").groupBy("range").agg(F.max(F.struct("key", "tie")).alias("h")).orderBy("range").collect()
    firsts = [(heads[i - 1]["range"], h.h.key, h.h.tie) for i, h in enumerate(heads)]
    marks = F.broadcast(spark.createDataFrame(firsts, "before int, key long, tie long"))
    copies = dealt.join(marks, ["key", "tie"]).select(*[F.col(c) for c in docs.columns], "key", "tie", F.col("before").alias("range")).withColumn("copy", F.lit(1))
    rows = dealt.withColumn("copy", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("range").orderBy("copy", F.desc("key"), F.desc("tie"))
    paired = rows.withColumn("next", F.lead(F.struct("text", "fp")).over(order)).where("copy = 0")
    return paired.select(*docs.columns, F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edited text (its last half replaced by the beginning of the next document).

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited, contained_next``, one row per input row. Null texts count as empty; an empty text's fingerprint
    is the empty string. Ids are whole numbers; a null id comes after all others.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _with_next(sketch(rows, F.col("text"), "fp"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = sketch(rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited), F.col("edited"), "efp")
    fp, efp, nfp = F.col("fp"), F.col("efp"), F.coalesce("next_fp", F.array().cast("array<bigint>"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(fp).alias("fingerprint"), text_of(efp).alias("edited_fingerprint"),
        likeness(fp, efp).alias("near_edited"), likeness(fp, nfp).alias("near_next"), containment(fp, efp).alias("contained_edited"), containment(fp, nfp).alias("contained_next"),
    )
