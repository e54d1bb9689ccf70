"""Language-model scores: context-tree weighting over bytes, and a unigram baseline.

A text is its words, a blank after each, and a line feed as its end, coded byte by byte. A byte is eight binary
decisions; each decision has a tree of contexts - the last 0 to CONTEXT bytes of the text, across word borders - whose
nodes hold Krichevsky-Trofimov counts. The weighted probability of a node is half its own estimate and half the product
of its children's; the prediction mixes all depths by the weights that the training texts give. All nodes are rows of
distributed tables.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import cut, drop, held, kept_names, small

#: Bytes of context; with the next byte, a run of bytes is one number of 48 bits.
CONTEXT = 5
#: Words whose counts every worker holds; all others get theirs by a join.
HEAD = 200_000
#: Runs whose scores every worker holds; all others get theirs by a join.
HEAD_RUNS = 1 << 20
#: Different words, or bytes, that a task counts before it hands them on.
FLUSH, FLUSH_BYTES = 400_000, 1 << 21

#: Columns of a score.
OUT = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

_END = b"\n"


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over the texts of ``docs`` (``text`` as binary), the ends among them."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        def rows(counts: Counter) -> Any:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                counts.update((text or b"").lower().split())
            counts[_END] += batch.num_rows
            if len(counts) > FLUSH:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def _runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte to code: it and the ``depth`` before it as one number (0: before the text), and the text's place."""
    lengths = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    run = symbols.copy()
    for back in range(1, depth + 1):
        before = np.zeros(len(symbols), np.uint64)
        before[back:] = symbols[:-back] if back < len(symbols) else 0
        run |= np.where(place >= back, before, np.uint64(0)) << np.uint64(8 * back)
    return run, owner


def _different(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different runs, and which of them each is; by hashing, which is faster than sorting."""
    import pyarrow as pa

    coded = pa.array(runs.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy().view(np.uint64), coded.indices.to_numpy()


def _coded(text: bytes | None) -> bytes:
    """The bytes of a text that are coded."""
    return b"".join(w + b" " for w in (text or b"").lower().split()) + _END


def _run_counts(docs: DataFrame) -> DataFrame:
    """``run, n, seen`` over ``docs`` (``text`` as binary, ``trains``): occurrences in training texts, and in all."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        def rows() -> Any:
            keys, at = _different(np.concatenate(runs))
            n = np.bincount(at, np.concatenate(marks), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64))], ["run", "n", "seen"])

        runs, marks, size = [], [], 0
        for batch in small(batches):
            found, owner = _runs([_coded(t) for t in batch.column(0).to_pylist()], CONTEXT)
            runs.append(found)
            marks.append(np.array(batch.column(1).to_pylist(), bool)[owner])
            size += len(found)
            if size > FLUSH_BYTES:
                yield rows()
                runs, marks, size = [], [], 0
        if size:
            yield rows()

    return docs.select("text", "trains").mapInArrow(run, "run long, n long, seen long").groupBy("run").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up; from 0.5 on its error is under 1e-11."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - F.log(reduce(lambda a, k: a * (x + float(k)), range(1, 8), x))


def _estimate() -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of a node's counts; without counts it is 0 at any rounding."""
    zeros, ones = F.col("zeros"), F.col("ones")
    return F.when(zeros + ones == 0, 0.0).otherwise(_log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi))


def _decisions(runs: DataFrame) -> DataFrame:
    """A row for each of the eight bits of the last byte: ``key`` (context, then the bits before it after a leading one) and ``bit``."""
    each = runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    key = F.expr("(run - (run & 255L)) | shiftright(run & 255L, 8 - k) | shiftleft(1L, k)")
    return each.withColumn("key", key).withColumn("bit", F.expr("shiftright(run & 255L, 7 - k) & 1L")).drop("k")


def _run_scores(runs: DataFrame) -> DataFrame:
    """``run, seen, score``: log10 of the probability of each run's last byte after the bytes before it.

    Runs without training counts have nodes too; those predict one half and leave the weights as they are.
    """
    nodes = cut(_decisions(runs).groupBy("key").agg(F.sum(F.col("n") * (1 - F.col("bit"))).alias("zeros"), F.sum(F.col("n") * F.col("bit")).alias("ones")).withColumn("weighted", _estimate()).withColumn("own", F.lit(1.0)))
    levels = [nodes]
    for depth in range(CONTEXT - 1, -1, -1):
        parent = F.col("key").bitwiseAND(F.lit((1 << (8 * (depth + 1))) - 1).cast("long"))
        summed = levels[0].groupBy(parent.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("product")).withColumn("estimate", _estimate())
        apart = F.col("product") - F.col("estimate")
        own = 1 / (1 + F.exp(F.least(F.greatest(apart, F.lit(-700.0)), F.lit(700.0))))
        weighted = F.greatest("product", "estimate") + F.log1p(F.exp(-F.abs(apart))) - math.log(2)
        levels.insert(0, cut(summed.select("key", "zeros", "ones", weighted.alias("weighted"), own.alias("own"))))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    state = levels[0].select("key", (F.col("own") * one).alias("p"), (1 - F.col("own")).alias("w"))
    for depth in range(1, CONTEXT + 1):
        parent = F.col("key").bitwiseAND(F.lit((1 << (8 * depth)) - 1).cast("long"))
        below = levels[depth].select("key", parent.alias("parent"), "own", one.alias("one"))
        # a node has 256 children at most, so no key is hot
        state = below.join(state.select(F.col("key").alias("parent"), "p", "w"), "parent").select("key", (F.col("p") + F.col("w") * F.col("own") * F.col("one")).alias("p"), (F.col("w") * (1 - F.col("own"))).alias("w"))
    told = F.log10(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))
    scores = cut(_decisions(runs).join(state, "key").groupBy("run").agg(F.first("seen").alias("seen"), F.sum(told).alias("score")))
    drop(*levels)
    return scores


class Model(NamedTuple):
    uid: str
    #: the most frequent runs, ascending, and their scores
    runs: np.ndarray
    scores: np.ndarray
    head: list[bytes]
    head_counts: np.ndarray
    tokens: int
    kinds: int


def _most(rows: DataFrame, often: str, room: int) -> DataFrame:
    """The rows of the highest counts, by steps of a quarter of a power of two, as far as whole steps fit into ``room``."""
    step = F.floor(4 * F.log2(often))
    least = None
    for at, n in sorted(((r["at"], r["n"]) for r in rows.groupBy(step.alias("at")).agg(F.count("*").alias("n")).collect()), reverse=True):  # 4 * 64 rows at most
        room -= n
        if room < 0:
            break
        least = at
    return rows.where(F.lit(False) if least is None else step >= least)


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """What workers hold of the model of the texts that train; the tables ``word, c`` and ``run, score``, which are whole.

    ``docs`` has ``text`` as binary and ``trains``; ``run, score`` has all runs of all texts.
    """
    counts = cut(_word_counts(docs.where("trains")))
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, kinds = int(sums[0] or 0), int(sums[1])
    top = _most(counts, "c", HEAD).toArrow()  # HEAD rows at most
    runs = cut(_run_counts(docs))
    scores = _run_scores(runs)
    drop(runs)
    held_runs = _most(scores, "seen", HEAD_RUNS).select("run", "score").toArrow()  # HEAD_RUNS rows at most
    run, score = held_runs.column("run").to_numpy().astype(np.uint64), held_runs.column("score").to_numpy()
    order = np.argsort(run)
    return Model(uuid.uuid4().hex, run[order], score[order], top.column("word").to_pylist(), top.column("c").to_numpy(), tokens, kinds), counts, scores.select("run", F.col("score").alias("run_score"))


def score(docs: DataFrame, model: Model, counts: DataFrame, scores: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``, a row per input row.

    A kept column that has one of these names comes back with ``_kept`` behind it. Repeated rows are scored each.

    Null texts are empty, their one token is the end. Counts of frequent words and
    scores of frequent runs are in the model; the others' come by joins, so every token and every run is looked up in
    its whole table. The code length per byte counts one byte for each separator.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    inner = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        model = shared.value
        index = held(model.uid, lambda: {w: i for i, w in enumerate(model.head)})
        logs = np.log10(model.head_counts + 1.0)
        for batch in small(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            runs, owner = _runs([_coded(t) for t in texts], CONTEXT)
            unique, back = _different(runs)
            at = np.minimum(np.searchsorted(model.runs, unique), max(len(model.runs) - 1, 0))
            there = model.runs[at] == unique if len(model.runs) else np.zeros(len(unique), bool)
            each = np.where(there, model.scores[at], 0.0) if len(model.runs) else np.zeros(len(unique))
            sums = np.bincount(owner, each[back], len(texts))
            far = ~there[back]
            borders = np.searchsorted(owner[far], np.arange(len(texts) + 1))
            far_runs = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(runs[far].astype(np.int64)))
            rows: list[tuple] = []
            for text, known_sum in zip(texts, sums.tolist(), strict=True):
                words = (text or b"").lower().split() + [_END]
                code = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                head = code[code >= 0]
                tail = [words[i] for i in np.flatnonzero(code < 0)]
                rows.append((len(words), len(head), float(logs[head].sum()), known_sum, sum(map(len, words)) + len(words) - 1, tail))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()))
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + new + [far_runs], inner + ["n_tokens", "in_head", "head_sum", "head_score", "n_bytes", "tail", "far"])

    schema = ", ".join(f"{c} {kind}" for c, kind in zip(inner, kinds, strict=True)) + ", n_tokens long, in_head long, head_sum double, head_score double, n_bytes long, tail array<binary>, far array<long>"
    given = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)], F.col(f"`{text_col}`").cast("binary").alias("text"))
    read = cut(given.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()))
    tails = read.select("__row", F.explode("tail").alias("word")).join(counts, "word")
    sums = tails.groupBy("__row").agg(F.count("*").alias("in_tail"), F.sum(F.log10(F.col("c") + 1.0)).alias("tail_sum"))
    rare = read.select("__row", F.explode("far").alias("run")).join(scores, "run")
    far = rare.groupBy("__row").agg(F.sum("run_score").alias("far_score"))
    out = read.drop("tail", "far").join(sums, "__row", "left").join(far, "__row", "left")
    known = F.col("in_head") + F.coalesce("in_tail", F.lit(0))
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(model.tokens + model.kinds + 1))
    total = F.col("head_score") + F.coalesce("far_score", F.lit(0.0))
    bits = -total / math.log10(2) / F.col("n_bytes")
    named = [F.col(c).alias(name) for c, name in zip(inner, kept_names(keep, OUT), strict=True)]
    return out.select(*named, "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"), F.when(F.col("n_bytes") > 0, bits).alias("bits_per_byte"))


def score_documents(docs: DataFrame, trains: Column, keep: list[str], text_col: str = "text") -> DataFrame:
    """Learn from the rows that ``trains`` marks and score all rows."""
    model, counts, scores = fit(docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains")))
    return score(docs, model, counts, scores, keep, text_col)
