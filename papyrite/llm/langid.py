"""Language identification: scripts narrow the candidates, trigram scores rate each word, and Viterbi with a penalty
for each switch labels the spans of mixed texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import held, kept_names, small

#: First code points of the scripts' main ranges; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x323B0, "other"),
)
_STARTS = np.array([start for start, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])

BUCKETS = 1 << 17
#: A share of trigrams under which a language counts as never having one.
FLOOR = 1e-6
#: Cost of a change of language between two words, in nats.
SWITCH = 16.0
#: Nats that a word costs in a language that does not use the scripts of most of its letters, if another one does: as good as out.
FOREIGN = 1e5
#: A language uses a script that holds this share of its letters.
USES = 0.02
#: Words of which a worker remembers the scores.
MEMO = 200_000

_LETTERS = re.compile(r"[^\W\d_]+").findall


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of the words, borders included; the word of each; the script of each middle letter."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    blank = points == 32
    middle = np.flatnonzero(~blank[1:-1]) + 1
    mixed = points[middle - 1] * np.uint64(0x9E3779B97F4A7C15) ^ points[middle] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[middle + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
    return bucket, np.cumsum(blank)[middle] - 1, _SCRIPT[np.searchsorted(_STARTS, points[middle].astype(np.int64), "right") - 1]


def _plain(token: str) -> str:
    """The letters of a token, lower case; numerals such as superscripts and fractions are none."""
    found = "".join(_LETTERS(token))
    return (found if found.isalpha() else "".join(filter(str.isalpha, found))).lower()


class Model(NamedTuple):
    uid: str
    languages: list[str]
    #: by bucket and language
    table: np.ndarray
    #: by language and script
    uses: np.ndarray


def fit(docs: DataFrame, lang: Column, trains: Column, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from a bounded sample: about ``per_language`` documents of each language, those of the lowest hash of their id.

    ``trains`` marks the rows that may be used; rows without text or language are not. Whole texts of the sample count.
    Only ids go through the choice of the sample; what comes to the driver are counts by language and bucket.
    """
    spark = docs.sparkSession
    rows = docs.where(trains & lang.isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("id"), lang.alias("lang"))
    counts = ids.groupBy("lang").count().collect()  # a row for each language
    # the ids whose hash is under a bound that about per_language of each language's ids stay below
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(per_language / r["count"]))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    low = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < share[F.col("lang")] * (1 << 31)
    sample = ids.where(low).distinct().toPandas()
    if not len(sample):
        return Model(uuid.uuid4().hex, [], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, len(_NAMES)), bool))
    kind = dict(docs.dtypes)[id_col]
    chosen = F.broadcast(spark.createDataFrame(sample, f"id {kind}, lang string"))  # about per_language rows a language
    texts = rows.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text")).join(chosen, ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in small(batches):
            langs = np.array(batch.column(0).to_pylist(), object)
            texts_ = batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                words = [w for i in np.flatnonzero(langs == name) for w in map(_plain, texts_[i].split()) if w]
                bucket, _, script = _trigrams(words) if words else (np.zeros(0, np.int64),) * 3
                key = np.concatenate([bucket, BUCKETS + script])
                keys, counts = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(counts, pa.int64())], ["lang", "key", "n"])

    counts = texts.mapInArrow(count, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    sums = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    np.add.at(sums, (counts["key"].to_numpy(), counts["lang"].map(languages.index).to_numpy()), counts["n"].to_numpy())
    total = np.maximum(sums[:BUCKETS].sum(0), 1)
    table = np.log(sums[:BUCKETS] / total + FLOOR)
    table -= table.max(1, keepdims=True)
    return Model(uuid.uuid4().hex, languages, table.astype(np.float32), (sums[BUCKETS:] / total >= USES).T)


class _Scorer:
    """Scores of words by language, remembered from batch to batch."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int32)
        self.used = 0

    def learn(self, tokens: list[str]) -> None:
        plain = {token: _plain(token) for token in tokens}
        words = sorted({w for w in plain.values() if w})
        at = {w: self.used + i for i, w in enumerate(words)}
        self.code.update((token, at[w] if w else -1) for token, w in plain.items())
        if not words:
            return
        need = self.used + len(words)
        if need > len(self.rows):
            grown = max(need, 2 * len(self.rows))
            self.rows = np.concatenate([self.rows[: self.used], np.zeros((grown - self.used, self.rows.shape[1]), np.float32)])
            self.letters = np.concatenate([self.letters[: self.used], np.zeros(grown - self.used, np.int32)])
        bucket, word, script = _trigrams(words)
        for k in range(len(self.model.languages)):
            self.rows[self.used : need, k] = np.bincount(word, self.model.table[bucket, k], len(words))
        letters = np.bincount(word, minlength=len(words))
        # the languages that use the scripts of most letters are the candidates
        uses = np.array([2 * np.bincount(word, own[script], len(words)) >= letters for own in self.model.uses.astype(float)], bool).reshape(-1, len(words)).T
        self.rows[self.used : need] -= np.where(uses | ~uses.any(1, keepdims=True), 0, FOREIGN).astype(np.float32)
        self.letters[self.used : need] = [len(w) for w in words]
        self.used = need


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best label of each row of each array when a change of label costs ``switch``; all arrays go step by step together."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = np.concatenate([scores[i] for i in order]).astype(np.float64)
    came = np.zeros(flat.shape, np.int16)
    k = flat.shape[1]
    best = flat[starts].copy()
    for step in range(1, int(lengths[0])):
        m = int(np.searchsorted(-lengths, -step, "left"))  # arrays longer than step
        now = best[:m]
        top = now.argmax(1)
        jump = now[np.arange(m), top] - switch
        stays = now >= jump[:, None]
        rows = starts[:m] + step
        came[rows] = np.where(stays, np.arange(k), top[:, None])
        best[:m] = np.maximum(now, jump[:, None]) + flat[rows]
    labels = np.zeros(len(flat), np.int16)
    state = best.argmax(1)
    for step in range(int(lengths[0]) - 1, -1, -1):
        m = int(np.searchsorted(-lengths, -step, "left"))
        rows = starts[:m] + step
        labels[rows] = state[:m]
        state[:m] = came[rows, state[:m]]
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(scores)
    for place, i in enumerate(order):
        out[i] = labels[starts[place] : starts[place] + lengths[place]]
    return out


def _one_language(scores: np.ndarray, switch: float) -> int | None:
    """The label that Viterbi gives to every row, if no stretch favours another by more than half a switch.

    A path with m >= 2 stretches in other languages has m - 1 switches at least, and one with a single stretch either
    has a switch or is wholly in that language; so none can gain over the best single language.
    """
    best = int(scores.sum(0, dtype=np.float64).argmax())
    ahead = np.cumsum(scores - scores[:, best : best + 1], 0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, ahead.shape[1])), ahead[:-1]]), 0), 0)
    return best if (ahead - low).max() <= switch / 2 else None


def _label(texts: list[str | None], scorer: _Scorer, switch: float) -> list[tuple[str, float, str]]:
    if scorer.used > MEMO or len(scorer.code) > 2 * MEMO:
        scorer.clear()
    split = [(t or "").split() for t in texts]
    if new := set().union(*split).difference(scorer.code):
        scorer.learn(sorted(new))
    get, languages = scorer.code.__getitem__, scorer.model.languages
    codes, mixed, labels = [], [], {}
    for i, tokens in enumerate(split):
        code = np.fromiter(map(get, tokens), np.int64, len(tokens))
        code = code[code >= 0]
        codes.append(code)
        if len(code) and languages:
            one = _one_language(scorer.rows[code], switch)
            if one is None:
                mixed.append(i)
            else:
                labels[i] = np.full(len(code), one, np.int16)
    labels |= dict(zip(mixed, viterbi([scorer.rows[codes[i]] for i in mixed], switch), strict=True))
    out = []
    for i, code in enumerate(codes):
        if i not in labels:
            out.append(("und", 0.0, ""))
            continue
        path = labels[i]
        letters = np.bincount(path, scorer.letters[code], len(languages))
        best = int(letters.argmax())
        ends = np.append(np.flatnonzero(np.diff(path)) + 1, len(path))
        spans = ",".join(f"{languages[path[e - 1]]}:{n}" for e, n in zip(ends, np.diff(ends, prepend=0), strict=True))
        out.append((languages[best], float(letters[best] / letters.sum()), spans))
    return out


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` (share of letters in that language) and ``spans`` (``language:words``
    in order). One row per input row, repeated ones too. Texts that are null or have no letter: ``und``, 0.0, no spans.
    A kept column named as one of these comes back with ``_kept`` behind its name."""
    own = ["lang_pred", "score", "spans"]
    names = kept_names(keep, own) + own
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        scorer = held(shared.value.uid, lambda: _Scorer(shared.value))
        for batch in small(batches):
            found = _label(batch.column(batch.num_columns - 1).to_pylist(), scorer, switch)
            new = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + new, names)

    schema = ", ".join(f"`{name}` {docs.schema[c].dataType.simpleString()}" for c, name in zip(keep, names, strict=False)) + ", lang_pred string, score double, spans string"
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`")).mapInArrow(run, schema)
