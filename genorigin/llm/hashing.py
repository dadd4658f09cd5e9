"""Vectorised words, rolling hashes and anchors over the bytes of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: ASCII white space, which separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers and byte values of two independent 64-bit polynomial hashes.
MULS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_RNG = np.random.default_rng(20240229)
VALUES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in MULS]


@lru_cache(maxsize=8)
def _powers(k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mul = np.uint64(MULS[k])
    inverse = np.uint64(pow(MULS[k], -1, 1 << 64))
    up, down = np.full(1 << bits, mul, np.uint64), np.full(1 << bits, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mul ** i and its inverse modulo 2 ** 64, for i < n at least."""
    return _powers(k, max(20, int(n).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (n + 1 numbers)."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = solid[bounds]
    last = solid[:-1] & (~solid[1:] | first[1:])
    if len(bounds):
        inner = offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= len(data))] - 1
        last[inner] = solid[:-1][inner]
    starts, ends = np.flatnonzero(first[:-1]), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    solid = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    at = np.cumsum(sizes) - sizes
    up, _ = powers(k, int(sizes.max()) + 1)
    values = VALUES[k][data[solid]] * up[solid - np.repeat(starts, sizes)]
    return mixed(np.add.reduceat(values, at) + sizes.astype(np.uint64))


class Rolling:
    """Hashes of any run of symbols, each in constant time."""

    def __init__(self, symbols: np.ndarray, k: int = 0):
        self.up, self.down = powers(k, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=self.sums[1:])

    def of(self, starts: np.ndarray, sizes) -> np.ndarray:
        return mixed((self.sums[starts + sizes] - self.sums[starts]) * self.down[starts] + np.asarray(sizes).astype(np.uint64))


def anchored_paths(grams: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share their anchor: the text, first window, count and anchor of each run.

    A window of so many symbols is anchored at the leftmost of its smallest k-grams (grams: a hash for every start, where
    the last ones of each text are never looked at). first: the first symbol of each text, n + 1 numbers. Equal windows have equal
    anchors, whatever text they are in.
    """
    none = np.zeros(0, np.int64)
    width = window - k + 1
    n = int(first[-1])
    if n < window:
        return none, none, none, none
    at = _leftmost_least(grams, width)[: n - window + 1]
    counts = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(text):
        return none, none, none, none
    windows = first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    anchors = at[windows]
    new = np.ones(len(text), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], windows[begin], np.diff(np.append(begin, len(text))), anchors[begin]


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every start, the place of the leftmost least of so many values from there; doubling spans, then two that overlap."""
    place = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        a, b = place[:-span], place[span:]
        place = np.where(values[b] < values[a], b, a)
        span *= 2
    if span < width:
        step = width - span
        a, b = place[:-step], place[step:]
        place = np.where(values[b] < values[a], b, a)
    return place
