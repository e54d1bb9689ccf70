"""Near-duplicates by MinHash bands with sequential Bayesian verification.

Every text becomes its set of five-word shingles. Texts of equal sets form a class, whose smallest id stands for it.
Classes that share a band of the MinHash signature are candidates; their signatures are compared batch by batch and a
pair is dropped as soon as the posterior probability of a similarity of 0.75 or more falls under ``MISS``. What
survives is verified on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrite.llm.graph import components
from papyrite.llm.shared import cut, drop, held, small

SHINGLE = 5
#: A pair at the threshold shares no band with probability (1 - 0.75**4)**30, about 1e-5.
BANDS, ROWS = 30, 4
#: Signature values that are compared at a time.
BATCH = 24
#: Posterior probability of a link under which a pair is dropped.
MISS = 1e-5
#: Least similarity as a fraction, in exact arithmetic.
OVER, UNDER = 75, 100
#: Shingles that are hashed at a time.
STRIP = 512
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
#: Shingles up to which a set goes into the comparison of a bucket's members as a whole, four bytes each.
WHOLE = 512
#: Partners that each member tries first, most alike first; those of members still apart are all tried after that.
FIRST = 2
#: Words that a worker remembers.
MEMO = 200_000

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)
_TIMES = (_rng.integers(0, 1 << 31, BANDS * ROWS, np.uint64) * 2 + 1).astype(np.uint32)
_MIX = _rng.integers(0, 1 << 62, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P[1]
    x = (x ^ (x >> np.uint64(27))) * _P[2]
    return x ^ (x >> np.uint64(31))


class _Shingler:
    """Sorted 64-bit hashes of the different shingles of texts."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 16, np.uint64)

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        import xxhash

        if len(self.code) > MEMO:
            self.clear()
        split = [(t or b"").lower().split() for t in texts]  # of bytes: A-Z only, ASCII white space only
        new = list(set().union(*split).difference(self.code))
        need = len(self.code) + len(new)
        if need > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(2 * need - len(self.hashes), np.uint64)])
        self.hashes[len(self.code) : need] = [xxhash.xxh64_intdigest(w) for w in new]
        self.code.update(zip(new, range(len(self.code), need), strict=True))
        get = self.code.__getitem__
        for words in split:
            n = len(words)
            if not n:
                yield np.zeros(0, np.uint64)
                continue
            h = self.hashes[np.fromiter(map(get, words), np.int64, n)]
            size = min(SHINGLE, n)
            total = np.full(n - size + 1, size, np.uint64)
            for k in range(size):
                total = _scramble(total * _P[0] + h[k : n - size + 1 + k])
            yield np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_XOR), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), STRIP):
        out = np.minimum(out, ((low[start : start + STRIP] ^ _XOR[:, None]) * _TIMES[:, None]).min(1))
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """The keys of each signature's bands."""
    mixed = (signatures.astype(np.uint64).reshape(-1, BANDS, ROWS) * _MIX).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _P[0]
    return _scramble(mixed).view(np.int64)


def least_matches() -> list[tuple[int, int]]:
    """After how many values how many must agree: with fewer, the posterior (uniform prior) of a link is under MISS."""
    out, grid = [], (np.arange(20000) + 0.5) / 20000
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            weight = np.exp(m * np.log(grid) + (n - m) * np.log1p(-grid) - m * math.log(max(m, 1e-9) / n) - (n - m) * math.log(max(n - m, 1e-9) / n))
            if weight[grid >= OVER / UNDER].sum() / weight.sum() >= MISS:
                out.append((n, m))
                break
    return out


_LEAST = least_matches()


def survive(left: np.ndarray, right: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``right`` (of those at ``at``) that no batch rules out, and how many values agree there.

    ``left`` is one signature, or as many as ``right`` has.
    """
    at = np.arange(len(right)) if at is None else at
    agreed = np.zeros(len(at), np.int32)
    done = 0
    for n, m in _LEAST:
        every = len(at) == len(right)
        one = left[done:n] if left.ndim == 1 else left[:, done:n] if every else left[at, done:n]
        same = (right[:, done:n] if every else right[at, done:n]) == one
        agreed = agreed + np.bitwise_count(np.packbits(same, axis=1)).sum(1, dtype=np.int32)
        keep = agreed >= m
        at, agreed, done = at[keep], agreed[keep], n
    return at, agreed


def _read(docs: DataFrame) -> DataFrame:
    """``id, n, same, sig`` of each ``id, text``: number and digest of the shingles; no signature where there is none."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        import xxhash

        for batch in small(batches):
            n, same, sig = [], [], []
            for s in held("shingles", _Shingler).sets(batch.column(1).to_pylist()):
                n.append(len(s))
                same.append(xxhash.xxh128_digest(s.tobytes()))
                sig.append(signature(s).astype(np.uint16).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "same", "sig"])

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, same binary, sig binary")


def _sets(texts: DataFrame) -> DataFrame:
    """``node, shingles`` of those ``node, same, text`` whose digest is ``same``."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        import xxhash

        for batch in small(batches):
            node, sets = [], []
            for k, same, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held("shingles", _Shingler).sets(batch.column(2).to_pylist()), strict=True):
                if xxhash.xxh128_digest(s.tobytes()) == same:
                    node.append(k)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "same", F.col("text").cast("binary")).mapInArrow(run, "node long, shingles array<long>")


def _signatures(column: Any) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def _buckets(classes: DataFrame) -> DataFrame:
    """``node, key``: a row for each band."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in small(batches, 4000):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(bands(_signatures(batch.column(1))).ravel())], ["node", "key"])

    return classes.select("node", "sig").mapInArrow(run, "node long, key long")


def _as_array(at: np.ndarray) -> Any:
    import pyarrow as pa

    return pa.array(at, pa.int64())


def _survivors(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that the signatures don't rule out. Many pairs may share an ``a``, so that is joined last."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sig").alias("s" + x), F.col("n").alias("n" + x))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(UNDER * F.least("na", "nb") >= OVER * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        for batch in small(batches, 4000):
            if batch.num_rows:
                yield batch.select(["a", "b"]).take(_as_array(survive(_signatures(batch.column(2)), _signatures(batch.column(3)))[0]))

    return both.mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets (``node, shingles``) are similar enough. The comparison runs row by row, so no batch of sets builds up."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("shared", shared).where(UNDER * F.col("shared") >= OVER * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def _within_blocks(placed: DataFrame, classes: DataFrame, sets: DataFrame, first: int | None) -> DataFrame:
    """``a, b, more``: surviving pairs between different components inside each bucket (``key, node, component``), block by block.

    A bucket's largest component and the rest of its members are cut into parts of BLOCK; each pair of parts that has
    one of the rest is a group, so no task holds more than two parts of a bucket, and members that are connected
    already are not compared. Only survivors leave: with ``first`` set, the so many most alike of each member in
    a group, and ``more`` tells where a member had more than those. Sets of WHOLE shingles at most are compared there too, by half of each hash, which can't make them look less alike; so
    of members that are somewhat alike, as those that share a passage, hardly any pair leaves in vain.
    """
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("m")).where("m > top.c")
    rest = placed.join(largest, "key").withColumn("main", F.col("component") == F.col("top.component"))
    few = F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int").alias("few")
    many = F.ceil(F.col("top.c") / BLOCK).cast("int").alias("many")
    part = F.when(F.col("main"), F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int")
    others = F.when(F.col("main"), F.col("few")).otherwise(F.col("few") + F.col("many"))
    dealt = rest.select("key", "node", "component", "main", few, many).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component")
    whole = F.when(F.size("shingles") <= WHOLE, F.transform("shingles", lambda h: F.shiftright(h, 32).cast("int")))
    dealt = dealt.join(classes.select("node", "n", "sig").join(sets.select("node", whole.alias("whole")), "node"), "node")

    def run(group: Any) -> Any:
        import pyarrow as pa

        part, comp, size = (group.column(c).to_numpy() for c in ("part", "component", "n"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sig, node = _signatures(group.column("sig")), group.column("node").to_numpy()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        block, other, length = sig[right], comp[right], size[right]
        lists = group.column("whole").combine_chunks()
        count = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)  # -1: not there
        code = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.cumsum(np.maximum(count, 0))
        place = np.full(len(node), -1)
        place[right] = np.arange(len(right))
        owner = place[np.repeat(np.arange(len(node)), np.maximum(count, 0))]
        own_code, owner = code[owner >= 0], owner[owner >= 0]
        marked = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
        found: list[tuple[np.ndarray, ...]] = []
        for x in left:
            # another component, a set of like size, and in one part each pair once
            fits = (other != comp[x]) & (UNDER * np.minimum(length, size[x]) >= OVER * np.maximum(length, size[x])) & ((right > x) | (i != j))
            if fits.any():
                at, agreed = survive(sig[x], block, np.flatnonzero(fits))
                if len(at) and count[x] >= 0:
                    mine = code[ends[x] - count[x] : ends[x]]
                    marked[mine] = True
                    shared = np.bincount(owner[marked[own_code]], minlength=len(right))[at]
                    marked[mine] = False
                    keep = (count[right[at]] < 0) | (UNDER * shared >= OVER * (size[x] + length[at] - shared))
                    at, agreed = at[keep], agreed[keep]
                best = np.argsort(-agreed, kind="stable")[:first]
                found.append((np.full(len(best), x), right[at[best]], np.full(len(best), len(best) < len(at))))
        a, b, more = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.Table.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(more)], ["a", "b", "more"])

    pairs = dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long, more boolean")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("more").alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept``: one row per input row.

    ``component_id`` is the smallest id reachable over links of similarity 0.75 or more, ``kept`` whether it is the
    row's own. Texts without words (null, empty, blank) have no shingles and no links; texts of fewer than five words
    are one shingle. Rows with a null id get a null component and are kept. Texts under one id are compared each for
    itself, as if their ids were equal only by chance. Ids may be of any type that has an order. Other columns are not
    read.

    In each bucket first every member is compared with the one that shares buckets with most others. Then members that
    ended in different components but share a bucket are compared with one another in blocks, the most alike first,
    so no candidate pair goes unexamined unless it is connected anyway.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    read = cut(_read(plain))
    alike = read.where("n > 0 and id is not null").groupBy("same").agg(F.min(F.struct("id", "sig", "n")).alias("r"), F.count("*").alias("copies"))
    # a number for each class; the table fixes it
    classes = cut(alike.select(F.monotonically_increasing_id().alias("node"), "same", "r.id", "r.sig", "r.n", "copies"))
    shared = cut(_buckets(classes).groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = cut(_buckets(classes).join(shared, "key"))
    reach = members.groupBy("node").agg(F.sum("m").alias("reach"))
    pivots = members.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node")).alias("p")).select("key", F.col("p.node").alias("a"))
    pairs = cut(members.join(pivots, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct())
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "id", "same")
    # one text for each id, or each of the different ones; the join has dealt them by id already
    texts = plain.join(wanted, "id").groupBy("id", "node", "same", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    sets = cut(_sets(texts))
    links = cut(_links(_survivors(pairs, classes), sets))
    found = components(links)
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for first in (FIRST, None):
        placed = members.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        every = cut(_within_blocks(placed, classes, sets, first))
        new = cut(_links(every.select("a", "b").join(tried, ["a", "b"], "left_anti"), sets))
        tried = tried.union(every.select("a", "b"))
        if not new.isEmpty():
            links = links.union(new)
            found = components(links)
        if every.where("more").isEmpty():
            break  # all that survive have been compared
    drop(members, shared, sets)
    grouped = classes.join(found.withColumnRenamed("id", "node"), "node", "left").where("component is not null or copies > 1").select("same", "id", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    joined = cut(grouped.join(least, "component").select("same", "component_id"))
    drop(classes)
    out = read.select("id", "n", "same").join(joined, "same", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
