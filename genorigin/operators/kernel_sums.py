"""Sums of Gaussian kernels over many points, in time that grows with the points, and exactly over all pairs in blocks.

Kernel sums (``kernel_sums``): space is cut into square cells of half a kernel's width. A cell's points are told as moments about its centre (ORDER a side); the moments of all cells in reach become, for each
cell, one polynomial in the place within it, which gives the sum at each of its points. Both series are cut where their terms, and kernels where their values, are below 1e-14 for each point summed over.
Tasks make the moments of what they read, which are then added; tiles of cells meet the moments of the cells in their reach, a bounded number; and points meet the polynomial of their cell in parts of a bounded size.

Pairs (``block_pairs``): points are dealt into blocks, and every pair of blocks is a group of its own, joined by its key.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of the series along each axis; the side of a cell and how far kernels reach, in kernel widths times the square root of 2; cells a side of a tile; points of a cell that a task holds.
ORDER, SIDE, REACH, TILE, PART = 16, 0.5, 6.5, 32, 1 << 19
FAR = int(np.ceil(REACH / SIDE)) + 1


def _powers(at: np.ndarray) -> np.ndarray:
    """1, t, t^2, ... of each place."""
    return at[:, None] ** np.arange(ORDER)


def _hermite(d: float) -> np.ndarray:
    """exp(-d^2) times the Hermite polynomials of orders 0 to 2 ORDER - 2 at d."""
    h = np.zeros(2 * ORDER)
    h[0], h[1] = np.exp(-d * d), 2 * d * np.exp(-d * d)
    for k in range(1, 2 * ORDER - 1):
        h[k + 1] = 2 * d * h[k] - 2 * k * h[k - 1]
    return h


def shifts() -> np.ndarray:
    """For each distance in cells from -FAR to FAR, what turns moments along an axis into terms of the polynomial."""
    m = np.arange(ORDER)
    sign = (-1.0) ** m / np.array([factorial(k) for k in m], float)
    return np.stack([sign[:, None] * _hermite(k * SIDE)[m[:, None] + m[None, :]] for k in range(-FAR, FAR + 1)])


def _cells(points: DataFrame, h: float) -> DataFrame:
    """Points with their cell and their place about its centre."""
    scaled = points.select("sampleid", *[(F.col(c) / F.lit(float(np.sqrt(2) * h * SIDE))).alias(f"u{c}") for c in "xy"])
    cell = scaled.select("sampleid", *[F.floor(f"u{c}").alias(f"i{c}") for c in "xy"], "ux", "uy")
    return cell.select("sampleid", "ix", "iy", *[((F.col(f"u{c}") - F.col(f"i{c}") - 0.5) * SIDE).alias(f"d{c}") for c in "xy"])


def _moments(cells: DataFrame) -> DataFrame:
    scale = np.array([1 / factorial(k) for k in range(ORDER)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c)) for c in ("ix", "iy")], axis=1)
            some, which = np.unique(place, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            ends = np.cumsum(np.bincount(which.ravel(), minlength=len(some)))
            px, py = (_powers(np.asarray(batch.column(c))[order]) * scale for c in ("dx", "dy"))
            data = [(px[a:b].T @ py[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(data, pa.binary())], ["ix", "iy", "data"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["ix", "iy"]].iloc[:1].copy()
        out["data"] = [sum(np.frombuffer(d) for d in rows["data"]).tobytes()]
        return out

    schema = "ix long, iy long, data binary"
    parts = cells.select("ix", "iy", "dx", "dy").mapInArrow(run, schema).withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = parts.groupBy("ix", "iy", "some").applyInPandas(add, schema)
    return once.groupBy("ix", "iy").applyInPandas(add, schema)


def _polynomials(moments: DataFrame) -> DataFrame:
    """(ix, iy, data): for each cell with points the coefficients of its polynomial."""
    tiles = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + k) / TILE) for k in (-FAR, 0, FAR)]))
    sent = moments.withColumn("tx", F.explode(tiles("ix"))).withColumn("ty", F.explode(tiles("iy")))

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = (int(k) * TILE for k in key)
        x, y = rows["ix"].to_numpy() - tx, rows["iy"].to_numpy() - ty
        own = np.flatnonzero((x >= 0) & (x < TILE) & (y >= 0) & (y < TILE))
        if not len(own):
            return pd.DataFrame([], columns=["ix", "iy", "data"])
        given = np.stack([np.frombuffer(d).reshape(ORDER, ORDER) for d in rows["data"]])
        turn = shifts()
        columns = {}  # (x of a source, y of a target): the moments along x of all sources there, turned along y
        for column in np.unique(x):
            at = np.flatnonzero(x == column)
            for target in np.unique(y[own]):
                near = at[np.abs(target - y[at]) <= FAR]
                if len(near):
                    columns[column, target] = np.einsum("kab,knb->an", given[near], turn[target - y[near] + FAR])
        out = []
        for k in own:
            near = [c for c in range(x[k] - FAR, x[k] + FAR + 1) if (c, y[k]) in columns]
            total = sum(turn[x[k] - c + FAR] @ columns[c, y[k]] for c in near)
            out.append((x[k] + tx, y[k] + ty, total.tobytes()))
        return pd.DataFrame(out, columns=["ix", "iy", "data"])

    return sent.groupBy("tx", "ty").applyInPandas(tile, "ix long, iy long, data binary")


def kernel_sums(points: DataFrame, h: float) -> DataFrame:
    """At each point the sum over all points of exp(-d^2 / (2 h^2)): (sampleid, total). points: sampleid, x, y, none null. Its own term is 1."""
    cells = _cells(points, h)
    parts = -(-points.count() // PART) or 1
    polynomials = _polynomials(_moments(cells)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = cells.withColumn("part", F.pmod(F.xxhash64("sampleid", "dx", "dy"), F.lit(parts)).cast("int"))

    def work(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame([], columns=["sampleid", "total"])
        terms = np.frombuffer(told["data"].iloc[0]).reshape(ORDER, ORDER)
        total = ((_powers(mine["dx"].to_numpy()) @ terms) * _powers(mine["dy"].to_numpy())).sum(axis=1)
        return pd.DataFrame({"sampleid": mine["sampleid"], "total": total})

    by = ["ix", "iy", "part"]
    return dealt.groupBy(*by).cogroup(polynomials.groupBy(*by)).applyInPandas(work, f"sampleid {points.schema['sampleid'].dataType.simpleString()}, total double")


def block_pairs(points: DataFrame, n: int, columns: list[str], size: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Points, and points with their columns renamed other_<name>, each with bi and bj: joined by these, every point meets every other, block by block. n: how many points there are."""
    blocks = max(1, -(-n // size))
    block, every = F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = points.select(*columns, block.alias("bi"), every.alias("bj"))
    right = points.select(*[F.col(c).alias(f"other_{c}") for c in columns], every.alias("bi"), block.alias("bj"))
    return left, right
