"""Chunks: sentences packed to a token target, and the rows that an index takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrite.functions import text as T


def pack(text: Column, target: int = 350) -> Column:
    """Array of chunks: sentences are added until their estimated tokens reach the target."""

    def step(state: Column, count: Column) -> Column:
        words, n = state["words"] + count, state["n"] + 1
        full = F.greatest(F.lit(1), F.floor(words / F.lit(0.75)).cast("int")) >= target
        return F.struct(n.alias("n"), F.when(full, 0).otherwise(words).alias("words"), F.when(full, F.concat(state["ends"], F.array(n))).otherwise(state["ends"]).alias("ends"))

    def cut(sentences: Column) -> Column:
        """Where chunks end is found first, from numbers alone; then each is taken as one slice."""
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("ends"))
        ends = F.aggregate(F.transform(sentences, T.word_count), begin, step, lambda s: F.when(F.coalesce(F.try_element_at(s["ends"], F.lit(-1)), F.lit(0)) == s["n"], s["ends"]).otherwise(F.concat(s["ends"], F.array(s["n"]))))
        return F.get(F.transform(F.array(F.struct(sentences.alias("s"), F.concat(F.array(F.lit(0)), ends).alias("e"))), lambda b: F.transform(F.sequence(F.lit(1), F.size(b["e"]) - 1), lambda k: F.array_join(F.slice(b["s"], F.get(b["e"], k - 1) + 1, F.get(b["e"], k) - F.get(b["e"], k - 1)), ". "))), 0)

    packed = F.get(F.transform(F.array(T.sentences(text)), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array().cast("array<string>"))), 0)
    return packed
