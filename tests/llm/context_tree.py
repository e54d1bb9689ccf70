"""Context-tree weighting on arrays of one machine, to compare the tables with."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from papyrite.llm.lmscore import _END, _runs

#: Bytes of context of the runs of single words.
DEPTH = 3


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of single words."""
    run, owner = _runs([w if w == _END else w + b" " for w in words], DEPTH)
    return run.astype(np.uint32), owner


_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    g = lambda x: _LGAMMA(x).astype(np.float64)
    return g(a + 0.5) + g(b + 0.5) - g(a + b + 1.0) - math.log(math.pi)


class Level(NamedTuple):
    """The nodes of one depth, by ascending key (context, then the bits so far after a leading one)."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    #: counts of the children that have no node of their own
    rest_zeros: np.ndarray
    rest_ones: np.ndarray
    #: weight of the node's own estimate against its children's
    own: np.ndarray


def _bits(gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits of the last byte: the bits before it after a leading one, and the bit."""
    symbol = gram & np.uint32(255)
    for k in range(8):
        yield (symbol >> np.uint32(8 - k)) | np.uint32(1 << k), (symbol >> np.uint32(7 - k)) & np.uint32(1)


def build(grams: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """Levels from the (run, count) arrays of each depth."""
    levels: list[Level] = []
    for depth, (gram, n) in enumerate(grams):
        context = (gram >> np.uint32(8)).astype(np.uint64) << np.uint64(8)
        keys, bits = (np.concatenate(x) for x in zip(*((context | prefix, bit) for prefix, bit in _bits(gram)), strict=True))
        unique, at = np.unique(keys, return_inverse=True)
        times = np.tile(n, 8)
        ones = np.bincount(at, times * bits, len(unique))
        zeros = np.bincount(at, times * (1 - bits.astype(np.int64)), len(unique))
        levels.append(Level(unique, zeros, ones, np.zeros(len(unique)), np.zeros(len(unique)), np.ones(len(unique))))
    weighted = np.zeros(0)
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        estimate = _log_kt(level.zeros, level.ones)
        if depth == len(levels) - 1:
            weighted = estimate
            continue
        below = levels[depth + 1]
        parent = _parent(below.keys, depth + 1)
        at = np.searchsorted(level.keys, parent)
        at = np.where((at < len(level.keys)) & (level.keys[np.minimum(at, len(level.keys) - 1)] == parent), at, -1)
        there = at >= 0
        product = np.bincount(at[there], weighted[there], len(level.keys))
        rest_zeros = np.maximum(level.zeros - np.bincount(at[there], below.zeros[there], len(level.keys)), 0)
        rest_ones = np.maximum(level.ones - np.bincount(at[there], below.ones[there], len(level.keys)), 0)
        product += _log_kt(rest_zeros, rest_ones)
        own = 1 / (1 + np.exp(np.clip(product - estimate, -700, 700)))
        weighted = np.logaddexp(estimate, product) - math.log(2)
        levels[depth] = level._replace(rest_zeros=rest_zeros, rest_ones=rest_ones, own=own)
    return levels


def _parent(keys: np.ndarray, depth: int) -> np.ndarray:
    """The keys without the farthest byte of a context of ``depth`` bytes."""
    return keys & np.uint64((1 << (8 * depth)) - 1)


def log10_of(levels: list[Level], gram: np.ndarray) -> np.ndarray:
    """log10 of the probability of each run's last byte after the bytes before it; without training all are alike."""
    if not levels:
        return np.full(len(gram), -8 * math.log10(2))
    total = np.zeros(len(gram))
    context = (gram >> np.uint32(8)).astype(np.uint64) << np.uint64(8)
    for prefix, bit in _bits(gram):
        one = bit == 1
        mixed = np.zeros(len(gram))
        weight = np.ones(len(gram))
        rest = np.zeros((2, len(gram)))
        alive = np.ones(len(gram), bool)
        for depth, level in enumerate(levels):
            key = _parent(context | prefix, depth + 1)
            at = np.minimum(np.searchsorted(level.keys, key), max(len(level.keys) - 1, 0))
            here = alive & (level.keys[at] == key) if len(level.keys) else np.zeros(len(gram), bool)
            gone = alive & ~here
            # no node: the estimate of the rest ends the mixture
            mixed[gone] += weight[gone] * (np.where(one, rest[1], rest[0])[gone] + 0.5) / (rest.sum(0)[gone] + 1)
            a, b = level.zeros[at], level.ones[at]
            own = np.where(here, level.own[at] if depth < len(levels) - 1 else 1.0, 0)
            mixed += np.where(here, weight * own * (np.where(one, b, a) + 0.5) / (a + b + 1), 0)
            weight = np.where(here, weight * (1 - own), 0)
            rest = np.stack([level.rest_zeros[at], level.rest_ones[at]])
            alive = here
        total += np.log10(mixed)
    return total
