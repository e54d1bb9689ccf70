"""Toxicity: a factorization machine over hashed terms; pairs of terms interact through learned factors."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import held, kept_names, small

#: Labelled documents of each class that training may use, at most.
PER_CLASS = 3000
#: Sampled documents that a term must be in.
SUPPORT = 2
#: Weight of the penalties that make weights and factors sparse.
SPARSE = 3e-3
#: Factors of each term.
FACTORS = 6
#: Terms of documents that training has in hand at a time.
ENTRIES = 400_000
#: Terms of which a worker remembers the weights.
MEMO = 200_000

_WORD = re.compile(r"[^\W\d_]+").findall


def _terms(token: str) -> list[int]:
    """Hashes (32 bits) of the words of a token and of their beginnings, so that unseen endings are recognised."""
    found = []
    for word in _WORD(token.casefold()):
        data = word.encode("utf-8", "replace")
        found.append(zlib.crc32(b"w" + data))
        found.extend(zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "replace")) for n in (4, 5, 6) if len(word) >= n)
    return found


class Model(NamedTuple):
    uid: str
    bias: float
    index: dict[int, int]
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, at: list[int]) -> float:
        """Log-odds of a set of terms: bias, weights and all pairwise interactions."""
        v = self.factors[at]
        return float(self.bias + self.linear[at].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _parts(owner: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Ranges of the documents 0 to ``n`` - 1 with about ENTRIES terms each; ``owner`` ascends."""
    marks = owner[ENTRIES::ENTRIES] if len(owner) else owner
    borders = [0, *sorted(set(marks.tolist()) - {0}), n]
    return [(a, b) for a, b in zip(borders, borders[1:]) if b > a]


def train(owner: np.ndarray, column: np.ndarray, terms: int, y: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.05, sparse: float = SPARSE) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by proximal Adam over all documents; document ``owner[i]`` has term ``column[i]``.

    ``sparse`` weighs the penalty on each weight and on the length of each term's factors, so terms that help neither
    alone nor in a pair come to nothing. After a quarter of the steps, and again after half, terms that are nothing are
    left out of what follows.
    """
    rng = np.random.default_rng(7)
    n = len(y)
    values = [np.zeros(1), np.zeros(terms), rng.normal(0, 0.01, (terms, FACTORS))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    weight = weight / weight.sum()
    alive = np.arange(terms)
    for step in range(1, steps + 1):
        bias, w, v = values
        linear, crossed, error = np.zeros(len(w)), np.zeros((len(w), FACTORS)), np.zeros(n)
        # some documents at a time, so that memory follows from ENTRIES
        for low, high in _parts(owner, n):
            begin, end = np.searchsorted(owner, (low, high))
            own, at = owner[begin:end] - low, column[begin:end]
            each = v[at]
            sums = np.stack([np.bincount(own, each[:, f], high - low) for f in range(FACTORS)], 1)
            margin = bias + np.bincount(own, w[at] - 0.5 * (each**2).sum(1), high - low) + 0.5 * (sums**2).sum(1)
            error[low:high] = (_sigmoid(margin) - y[low:high]) * weight[low:high]
            share = error[low:high][own]
            linear += np.bincount(at, share, len(w))
            for f in range(FACTORS):
                crossed[:, f] += np.bincount(at, share * sums[own, f], len(w))
        sizes = []
        for i, g in enumerate([error.sum(keepdims=True), linear, crossed - v * linear[:, None]]):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            sizes.append(rate / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-6))
            values[i] = values[i] - sizes[i] * (first[i] / (1 - 0.9**step))
        values[1] = np.sign(values[1]) * np.maximum(np.abs(values[1]) - sparse * sizes[1], 0)
        length = np.sqrt((values[2] ** 2).sum(1, keepdims=True))
        values[2] = values[2] * np.maximum(1 - sparse * sizes[2].mean(1, keepdims=True) / np.maximum(length, 1e-12), 0)
        if step in (steps // 4, steps // 2):
            keep = np.flatnonzero((values[1] != 0) | (values[2] != 0).any(1))
            place = np.full(len(values[1]), -1)
            place[keep] = np.arange(len(keep))
            used = place[column] >= 0
            owner, column, alive = owner[used], place[column[used]], alive[keep]
            for part in (values, first, second):
                part[1], part[2] = part[1][keep], part[2][keep]
    linear, factors = np.zeros(terms, np.float32), np.zeros((terms, FACTORS), np.float32)
    linear[alive], factors[alive] = values[1], values[2]
    return float(values[0][0]), linear, factors


def fit(docs: DataFrame, labels: DataFrame, trains: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most ``per_class`` labelled documents of each class, those of the lowest hash of their id.

    A document that is labelled more than once counts as toxic if one label says so; rows without label, or with a null
    id, are not used; rows that repeat an id each count. All terms that SUPPORT of the sampled documents have take
    part, however they are spread over the classes. The sample's terms come to the driver, four bytes each; their
    number is bounded by the sample.
    """
    spark = docs.sparkSession
    known = labels.where(trains & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = [row for y in (0, 1) for row in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    empty = Model(uuid.uuid4().hex, -30.0, {}, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    if not chosen:
        return empty
    sample = F.broadcast(spark.createDataFrame(chosen, f"id {dict(labels.dtypes)[id_col]}, y int"))  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "id").select("y", "text")

    def terms(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in small(batches):
            sets = [np.array(sorted({h for token in set(t.split()) for h in _terms(token)}), np.uint32).view(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["y", "terms"])

    rows = texts.mapInArrow(terms, "y int, terms array<int>").toArrow().combine_chunks()
    y = rows.column("y").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return empty._replace(bias=30.0 if len(y) and y[0] == 1 else -30.0)
    lists = rows.column("terms").combine_chunks()
    owner = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy())
    coded = lists.flatten().dictionary_encode()
    unique, column = coded.dictionary.to_numpy().view(np.uint32), coded.indices.to_numpy()
    del rows, lists, coded
    kept = np.flatnonzero(np.bincount(column, minlength=len(unique)) >= SUPPORT)
    kept = kept[np.argsort(unique[kept])]  # the first factors of a term don't depend on the order of rows
    place = np.full(len(unique), -1, np.int32)
    place[kept] = np.arange(len(kept))
    column = place[column]
    used = column >= 0
    owner, column = owner[used], column[used]
    bias, linear, factors = train(owner, column, len(kept), y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())))
    told = np.flatnonzero((linear != 0) | (factors != 0).any(1))
    return Model(uuid.uuid4().hex, bias, {int(h): i for i, h in enumerate(unique[kept[told]])}, linear[told], factors[told])


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), one row per input row.

    Null texts count as empty; a text without known terms gets the score of the bias alone. Repeated rows are scored
    each. A kept column named as one of these comes back with ``_kept`` behind its name.
    """
    own = ["score", "predicted"]
    names = kept_names(keep, own) + own
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        model = shared.value
        memo: dict[str, tuple[int, ...]] = held(model.uid, dict)
        index = model.index
        for batch in small(batches):
            if len(memo) > MEMO:
                memo.clear()
            scores = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                tokens = set((text or "").split())
                for token in tokens.difference(memo):
                    memo[token] = tuple(index[h] for h in _terms(token) if h in index)
                known = set()
                for token in tokens:
                    if at := memo[token]:
                        known.update(at)
                scores.append(float(_sigmoid(np.float64(model.margin(sorted(known))))))
            new = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + new, names)

    schema = ", ".join(f"`{name}` {docs.schema[c].dataType.simpleString()}" for c, name in zip(keep, names, strict=False)) + ", score double, predicted int"
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`")).mapInArrow(run, schema)
