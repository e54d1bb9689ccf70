"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, windows of the resulting templates are joined by hash with
those of the benchmark, and the values behind the placeholders must map consistently along a match. Windows of the
plain words are joined too, so verbatim passages are found whatever they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import cut, held, small

#: Words of a window.
WINDOW = 8
#: Items of fewer words are matched whole; templates of fewer tokens say too little and are not used.
SHORTEST = 5
#: Different windows of an item (or all it has of a kind) that a document must hold.
NEEDED = 3
#: Kinds of windows: plain words; the template; the template in which capitalised words that begin a sentence are names too.
PLAIN, TEMPLATE, OPEN = range(3)
#: Parts over which the documents that hold a window are dealt.
SALTS = 16
#: Bits of the filter of benchmark windows; its size does not depend on the data.
FILTER_BITS = 1 << 22
#: Tokens that a worker remembers.
MEMO = 200_000
#: Units that may follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s ms sec min h hr hrs hour hours day days week weeks month months year years % percent usd eur gbp dollars euros cents kb mb gb tb hz khz mhz ghz w kw mw v kv a ma j kj kcal c f k mph kmh degrees meters metres miles feet inches pounds grams kilograms liters litres minutes seconds".split())

_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_GLUED = re.compile(r"(\d)(?=[^\W\d_])")
_BREAK = "\x01"
_NAME, _NUM, _UNIT = (np.uint64(0x9E3779B97F4A7C15 + i) for i in range(3))
_BASE = 0xD6E8FEB86659FD93
#: Tokens of texts that are read together, about; a longer text is read alone.
TOGETHER = 100_000


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


class Kind(NamedTuple):
    """The tokens of texts, one text after another."""

    #: hashes
    tokens: np.ndarray
    #: word hashes behind the placeholders, else 0
    slots: np.ndarray
    #: places of the words in their text
    place: np.ndarray
    #: number of the text
    owner: np.ndarray


class _Reader:
    """Turns texts into arrays of word hashes, with the template's placeholders beside them."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {_BREAK: 0}
        #: hash; flags: 1 empty, 2 ends a sentence, 4 number, 8 unit, 16 capitalised
        self.hashes, self.flags = [0], [1 | 2]
        self.arrays: tuple[np.ndarray, np.ndarray] | None = None

    def learn(self, token: str) -> None:
        word = "".join(filter(str.isalnum, token))
        flag = 2 if token.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":", ";", "…") else 0
        if token.rstrip(".,:;!?") == "%":
            flag, word = flag | 8, "%"
        elif not word:
            flag |= 1
        elif _NUMBER.fullmatch(token.strip("()[]$€£.,:;!?'\"%")):
            flag |= 4
        elif word.lower() in UNITS:
            flag |= 8
        if len(word) > 1 and word[0].isupper() and word[1:].islower():
            flag |= 16
        self.code[token] = len(self.hashes)
        self.hashes.append(_hash(word.lower()))
        self.flags.append(flag)
        self.arrays = None

    def read(self, texts: list[str | None]) -> Iterator[tuple[int, list[Kind]]]:
        """Texts in groups: the number of the first, and by kind the tokens of all."""
        if len(self.code) > MEMO:
            self.clear()
        split = []
        for text in texts:
            text = text or ""
            if _GLUED.search(text):
                text = _GLUED.sub(r"\1 ", text)
            split.append(text.replace("\n", f" {_BREAK} ").split())
        for token in set().union(*split).difference(self.code):
            self.learn(token)
        if self.arrays is None:
            self.arrays = np.array(self.hashes, np.uint64), np.array(self.flags, np.uint8)
        first, size = 0, 0
        for i, tokens in enumerate(split):
            size += len(tokens)
            if size > TOGETHER or i == len(split) - 1:
                yield first, self._kinds(split[first : i + 1])
                first, size = i + 1, 0

    def _kinds(self, split: list[list[str]]) -> list[Kind]:
        assert self.arrays is not None
        hashes, flags = self.arrays
        lengths = np.array([len(t) for t in split], np.int64)
        code = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(split)), lengths)
        flag = flags[code]
        starts = _first(owner)
        starts[1:] |= (flag[:-1] & 2) > 0
        whole = (flag & 1) == 0
        # an empty token between a sentence's end and the next word hands the start on
        starts[1:] |= starts[:-1] & ~whole[:-1]
        code, flag, starts, owner = code[whole], flag[whole], starts[whole], owner[whole]
        words, head = hashes[code], _first(owner)
        place = np.arange(len(code)) - np.searchsorted(owner, owner)
        number = (flag & 4) > 0
        unit = (flag & 8) > 0
        unit[1:] &= number[:-1]
        unit &= ~head
        capital = ((flag & 16) > 0) & ~number & ~unit
        kinds = [Kind(words, np.zeros(len(code), np.uint64), place, owner)]
        for name in (capital & ~starts, capital):
            template = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, words)))
            once = np.ones(len(code), bool)
            once[1:] = ~(name[1:] & name[:-1]) | head[1:]  # names in a row are one
            slots = np.where(number | unit | name, words, np.uint64(0))
            kinds.append(Kind(template[once], slots[once], place[once], owner[once]))
        return kinds


def _first(owner: np.ndarray) -> np.ndarray:
    """Where a text begins."""
    out = np.ones(len(owner), bool)
    out[1:] = owner[1:] != owner[:-1]
    return out


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and their inverses modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, inverse))  # type: ignore[return-value]


def _windows(tokens: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of all windows of ``length`` tokens: polynomials modulo 2^64, from differences of their running sum."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << (len(tokens) - 1).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * up[: len(tokens)], dtype=np.uint64)])
    total = (sums[length:] - sums[:-length]) * down[:n] + np.uint64((seed * 0x2545F4914F6CDD1D + length) & (2**64 - 1))
    total ^= total >> np.uint64(31)
    return total * np.uint64(0x94D049BB133111EB)


def _own(kinds: list[Kind]) -> list[tuple[int, int]]:
    """The (kind, length) of a benchmark item's windows; a template that says the same as another kind is left out."""
    if len(kinds[PLAIN].tokens) < SHORTEST:
        return [(PLAIN, len(kinds[PLAIN].tokens))] if len(kinds[PLAIN].tokens) else []  # matched whole, as it stands
    used = [PLAIN]
    if kinds[TEMPLATE].slots.any():
        used.append(TEMPLATE)
    if not np.array_equal(kinds[OPEN].tokens, kinds[TEMPLATE].tokens):
        used.append(OPEN)
    return [(k, min(len(kinds[k].tokens), WINDOW)) for k in used if len(kinds[k].tokens) >= SHORTEST]


def _found(kinds: list[Kind], shapes: list[tuple[int, int]], passes: np.ndarray | None) -> Iterator[tuple[int, int, int, int, int, int, int, list[int]]]:
    """Rows (text, length, windows of the shape, hash, kind, position, first word, slots) of the windows that the filter lets through.

    Windows of placeholders alone have no word of the item and are none. An item's windows, and plain ones, count once.
    """
    for kind, length in shapes:
        tokens, slots, place, owner = kinds[kind]
        h = _windows(tokens, length, kind)
        if not len(h):
            continue
        keep = owner[length - 1 :] == owner[: len(h)]
        if passes is not None:
            keep &= passes[(h & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
        if kind and keep.any():
            filled = np.concatenate([[0], np.cumsum(slots != 0)])
            keep &= filled[length:] - filled[:-length] < length
        at = np.flatnonzero(keep)
        if len(at) and (passes is None or kind == PLAIN):
            at = np.sort(at[np.unique(np.stack([owner[at], h[at].view(np.int64)]), axis=1, return_index=True)[1]])
        for i, begin in zip(at.tolist(), np.searchsorted(owner, owner[at]).tolist(), strict=True):
            yield int(owner[i]), length, len(at), int(h[i].astype(np.int64)), kind, i - begin, int(place[i]), slots[i : i + length].astype(np.int64).tolist() if kind else []


def _hits(df: DataFrame, id_col: str, text_col: str, shapes: list[tuple[int, int]] | None, passes: Any) -> DataFrame:
    """The windows of all texts (``shapes`` None: those of a benchmark item) as rows."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        mask = None if passes is None else passes.value
        for batch in small(batches):
            out: list[tuple] = []
            texts = batch.column(1).to_pylist()
            reader = held("templates", _Reader)
            if shapes is None:
                for k, text in enumerate(texts):
                    for _, kinds in reader.read([text]):
                        out.extend((k, *row[1:]) for row in _found(kinds, _own(kinds), None))
            else:
                for first, kinds in reader.read(texts):
                    out.extend((first + row[0], *row[1:]) for row in _found(kinds, shapes, mask))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids] + [pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)], ["id", "length", "n", "h", "kind", "pos", "start", "slots"])

    schema = f"id {dict(df.dtypes)[id_col]}, length int, n int, h long, kind int, pos int, start int, slots array<long>"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item it holds: ``doc_id, item_id, n_windows, n_template``.

    ``n_windows``: different windows of the item that the document has; ``n_template``: those found only by a
    template. A window that several items share counts for each of them. A document is reported if it has three windows
    of the item, or all of one kind (plain, template, template with sentence beginnings as names) if the item has fewer.
    Items under five words are matched whole, as they stand; null texts are empty and empty items are in no document;
    rows with the same id are one document, as are those without; a null id is reported as null. A template or window of
    placeholders alone says nothing of an item (any table of numbers would be it), so only the plain words count there.
    A text of any length is read whole. Names of other columns don't matter.
    """
    spark = docs.sparkSession
    windows = cut(_hits(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text_col, None, None))
    items = windows.groupBy("h", "kind", F.col("id").alias("item")).agg(F.min(F.struct("pos", "start", "n", "slots")).alias("i"))
    marks = windows.select((F.pmod(F.col("h"), F.lit(FILTER_BITS))).cast("int").alias("bit"), "kind", "length")
    small = marks.distinct().toArrow()  # at most FILTER_BITS times the few kinds and lengths
    mask = np.zeros(FILTER_BITS, bool)
    mask[small.column("bit").to_numpy()] = True
    shapes = sorted(set(zip(small.column("kind").to_pylist(), small.column("length").to_pylist(), strict=True)))
    hits = _hits(docs, id_col, text_col, shapes, spark.sparkContext.broadcast(mask)).drop("length", "n", "start")
    # a window that many documents hold is dealt over SALTS parts
    dealt = hits.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = cut(dealt.join(spread, ["h", "kind", "salt"]).select("id", "kind", "pos", "slots", "item", F.col("i.pos").alias("at"), F.col("i.start").alias("start"), F.least("i.n", F.lit(NEEDED)).alias("needed"), F.col("i.slots").alias("item_slots")))  # both uses below read it again
    met = met.withColumn("shift", F.col("pos") - F.col("at"))
    # along one match, a value of the item stands for one value of the document
    match = ["doc", "item", "kind", "shift"]
    met = met.withColumn("doc", F.struct("id"))  # structs of null are equal
    pairs = met.where(F.col("kind") != PLAIN).select(*match, F.explode(F.arrays_zip("item_slots", "slots")).alias("z")).where("z.item_slots != 0")
    odd = pairs.groupBy(*match, "z.item_slots").agg((F.min("z.slots") != F.max("z.slots")).alias("odd")).groupBy(*match).agg(F.max("odd").alias("odd"))
    kept = met.drop("slots", "item_slots").join(odd.where("odd"), match, "left").where("odd is null")
    different = lambda c, kind: F.size(F.collect_set(F.when(F.col("kind") == kind, F.col(c))))
    whole = [F.coalesce(different("at", k) >= F.max(F.when(F.col("kind") == k, F.col("needed"))), F.lit(False)) for k in (PLAIN, TEMPLATE, OPEN)]
    found = kept.groupBy("id", "item").agg(F.size(F.collect_set("start")).cast("long").alias("n_windows"), different("start", PLAIN).cast("long").alias("n_plain"), (whole[0] | whole[1] | whole[2]).alias("whole")).where(F.col("whole") | (F.col("n_windows") >= NEEDED))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", (F.col("n_windows") - F.col("n_plain")).alias("n_template"))
