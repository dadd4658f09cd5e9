"""Keyed randomness: draws depend on a seed and the row's own keys, never on partitions or the order of rows."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(key) -> Column:
    return (key if isinstance(key, Column) else F.col(key) if isinstance(key, str) else F.lit(key)).cast("string")


def digest(seed, *keys) -> Column:
    """md5 of the seed and the keys joined by bars; to order by it is to shuffle. Strings name columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *map(_text, keys)))


def uniform(seed, *keys) -> Column:
    """A double in [0, 1) from the first 52 bits of the digest."""
    return F.conv(F.substring(digest(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def binomial2(p: Column, seed, *keys) -> Column:
    """A draw from Binomial(2, p): how many of two uniforms are below p."""
    return ((uniform(f"{seed}/0", *keys) < p).cast("int") + (uniform(f"{seed}/1", *keys) < p).cast("int")).cast("int")


def binomial1(p: Column, seed, *keys) -> Column:
    """A draw from Binomial(1, p), for haploid calls."""
    return (uniform(f"{seed}/0", *keys) < p).cast("int")


def uniforms(seed, key, n: int) -> np.ndarray:
    """``uniform`` of the seed, the key and each of the numbers 0 to n - 1, within a task."""
    first = f"{seed}|{key}|".encode()
    return np.array([int(hashlib.md5(first + b"%d" % i).hexdigest()[:13], 16) for i in range(n)], float) / float(1 << 52)
