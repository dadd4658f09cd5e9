"""Product codes of vectors in exact integers, with equal-average nearest neighbour search.

A vector's components become integers and are cut into equal consecutive parts, each with a codebook of its own. The codebooks are refined in rounds: every part is given to its nearest entry, and
each entry becomes the mean of its parts, rounded down. By the inequality of Cauchy and Schwarz, the squared distance of a part to an entry times their dimension is at least the squared
difference of their component sums. So entries are sorted by their sums, the search starts at the place of the part's sum and goes outward, always to the entry of the nearer sum, and ends for
a part when the squared gap over the dimension is strictly above its best distance; entries at an equal distance are all seen, and the lower index wins.

A round reads the vectors once. A task hands on a sum and a count for each entry, which are added up in Spark; only the codebooks, whose size is fixed by the parameters, come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sums travel in pieces of so many bits, so that any sum of any size is exact; a task's pieces can be added a few million times.
LIMB = 40
#: Where magnitude times dimension stays below, numpy's 64-bit integers hold every distance; vectors beyond are worked out in Python's integers.
SMALL = 1 << 29


@dataclass
class Codebooks:
    """books: for each part an array of entries x components (Python integers); width: the length of vectors; scale: components are floor(scale x)."""

    books: list[np.ndarray]
    width: int
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book.tolist() for x in entry).encode()).hexdigest()


def usable(vector: str) -> F.Column:
    """Vectors that are not null and have no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x), exactly: 64-bit integers where all are small, else Python integers."""
    if not values.size or float(np.abs(values).max()) * scale * values.shape[-1] < SMALL:
        return np.floor(values * scale).astype(np.int64)
    whole = [math.floor(Fraction(x) * scale) for x in values.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(values.shape)


def cuts(width: int, parts: int) -> list[int]:
    """Where the parts begin and end; if they cannot be equal, the first ones are longer by one."""
    sizes = [width // parts + (k < width % parts) for k in range(parts)]
    return np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each part's nearest entry, ties to the lower, and the squared distance."""
    n, dim = parts.shape
    if parts.dtype != object and book.dtype == object and all(abs(x) * dim < SMALL for x in book.ravel().tolist()):
        book = book.astype(np.int64)
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ranked, own = sums[order], parts.sum(axis=1)
    high = np.searchsorted(ranked, own)
    low = high - 1
    best, index = np.zeros(n, parts.dtype if parts.dtype == book.dtype else object), np.full(n, -1)
    rows = np.arange(n)
    while len(rows):
        a, b, t = low[rows], high[rows], own[rows]
        below, above = t - ranked[np.maximum(a, 0)], ranked[np.minimum(b, len(book) - 1)] - t
        down = (a >= 0) & ((b >= len(book)) | (below <= above))
        gap = np.where(down, below, above)
        going = (index[rows] < 0) | ~(gap * gap > best[rows] * dim).astype(bool)
        rows, down, at = rows[going], down[going], np.where(down, a, b)[going]
        entry = order[at]
        off = parts[rows] - book[entry]
        distance = (off * off).sum(axis=1)
        better = (index[rows] < 0) | (distance < best[rows]).astype(bool) | ((distance == best[rows]).astype(bool) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = distance[better], entry[better]
        low[rows[down]] -= 1
        high[rows[~down]] += 1
        rows = rows[(low[rows] >= 0) | (high[rows] < len(book))]
    return index, best


def _vectors(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have this width, and their integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = np.asarray(pa.compute.list_value_length(column).fill_null(-1)) == width
    flat = column.filter(pa.array(fits)).flatten().cast(pa.float64())
    return np.flatnonzero(fits), integers(np.asarray(flat).reshape(int(fits.sum()), width), scale)


def _codes(x: np.ndarray, found: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    at = cuts(found.width, len(found.books))
    pairs = [nearest(x[:, a:b], book) for a, b, book in zip(at, at[1:], found.books, strict=False)]
    return np.stack([i for i, _ in pairs], axis=1), np.stack([e for _, e in pairs], axis=1)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    k = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        value, low = divmod(value, 1 << LIMB)
        yield k, low
        k += 1
    yield k, value


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """The codebooks of vectors (vec_id, embedding; others are not read) after so many rounds, from those of the smallest ids (null last, equal ids by their vectors) that are usable.

    The length of vectors is that of the first of these; vectors of another length take no part. An empty table has empty codebooks.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding"))
    order = (F.col("vec_id").asc_nulls_last(), F.col("embedding"))
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return Codebooks([np.zeros((0, 0), object)] * parts, 0, scale)
    width = len(first[0]["embedding"])
    rows = rows.where(F.size("embedding") == width)
    start = rows.orderBy(*order).limit(entries).collect()  # so many rows
    x = integers(np.array([r["embedding"] for r in start], float).reshape(len(start), width), scale).astype(object)
    at = cuts(width, parts)
    found = Codebooks([x[:, a:b] for a, b in zip(at, at[1:], strict=False)], width, scale)
    for _ in range(rounds):
        found = _round(rows.select("embedding"), found)
    return found


def _round(rows: DataFrame, found: Codebooks) -> Codebooks:
    at = cuts(found.width, len(found.books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), object) for b in found.books]  # the last column counts
        for batch in batches:
            _, x = _vectors(batch.column("embedding"), found.width, found.scale)
            if not len(x):
                continue
            codes, _ = _codes(x, found)
            for p, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                for e in np.unique(codes[:, p]).tolist():
                    mine = x[codes[:, p] == e, a:b]
                    sums[p][e, :-1] += mine.sum(axis=0).astype(object)
                    sums[p][e, -1] += len(mine)
        out = [(p, e, c, k, v) for p, s in enumerate(sums) for e in range(len(s)) if s[e, -1] for c in range(s.shape[1]) for k, v in _limbs(int(s[e, c]))]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns[:4]], pa.array(columns[4], pa.int64())], ["part", "entry", "at", "limb", "value"])

    summed = rows.mapInArrow(run, "part int, entry int, at int, limb int, value long").groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value"))
    total = [np.zeros((len(b), b.shape[1] + 1), object) for b in found.books]
    for r in summed.collect():  # parts x entries x components
        total[r["part"]][r["entry"], r["at"]] += r["value"] << LIMB * r["limb"]
    books = []
    for s, old in zip(total, found.books, strict=True):
        new = old.copy()
        for e in range(len(s)):
            if s[e, -1]:
                new[e] = [v // s[e, -1] for v in s[e, :-1]]
        books.append(new)
    return Codebooks(books, found.width, found.scale)


def encode(vectors: DataFrame, found: Codebooks) -> DataFrame:
    """The usable rows of vectors (embedding and any other columns) with codes (array of the entry of each part) and error (the squared distances, summed), in place of columns of these names.

    Rows whose vector has another length than the codebooks' get null in both; an error beyond 64 bits is null.
    """
    keep = [f for f in vectors.schema.fields if f.name not in ("codes", "error")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if len(found.books[0]):
                which, x = _vectors(batch.column("embedding"), found.width, found.scale)
                if len(which):
                    c, e = _codes(x, found)
                    for i, code, error in zip(which.tolist(), c.tolist(), e.sum(axis=1).tolist(), strict=True):
                        codes[i], errors[i] = code, error if error < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(codes, pa.list_(pa.int32())), pa.array(errors, pa.int64())], [*names, "codes", "error"])

    return vectors.where(usable("embedding")).select(*names).mapInArrow(run, schema)
