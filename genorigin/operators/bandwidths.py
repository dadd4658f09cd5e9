"""Held-out log densities of points for many bandwidths, in work that grows with the points where they are dense and is exact pair by pair where they are not.

Of each point i and bandwidth h the sum over the points j of other folds of exp(-d_ij^2 / (2 h^2)) is needed. Three things keep that from being all pairs times all bandwidths:

- Bandwidths (``Nodes``). As a function of log h the sum, times exp(near / (2 h^2)) for the nearest such point, is bounded by the number of points in a strip about the real axis, so a polynomial through some 130
  Chebyshev nodes gives it at every bandwidth to 1e-14 of that number.
- Grids. Bandwidths are cut into octaves [H, 2H). Space is cut into cells of 3H, whose points of a fold are told as weights at 24 by 24 Chebyshev points; kernels are products of both axes', so a tile of 16 by 16
  cells turns the weights in its reach into values by two matrix products a bandwidth, which are interpolated at its points. A tile is worked out so if it has DENSE points a cell with points, or more.
- Pairs. Down to the bandwidth where a grid's value is above TRUST times the number of points, it is taken (its error is some 1e-15 of that number). It also bounds the distance of the nearest point,
  and so how far away others can matter for the smaller bandwidths: these are summed pair by pair over the points in the 3 by 3 squares about the point, whose side is that distance (all points if there is no grid).

Points come in parts of a bounded number to every task, sums of parts are put together by point.
"""

from __future__ import annotations

from math import ceil, log, pi

import numpy as np
import pandas as pd
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genorigin.shared import stored

#: Chebyshev points a side of a cell; its side over the octave's least bandwidth; cells a side of a tile; cells that kernels reach; points a cell from which tiles are worked out by grid.
ORDER, SIDE, TILE, FAR, DENSE = 24, 3.0, 16, 6, 32
#: The least value over the number of points at which a grid's value is taken; what is left out of the sum of a point, over that sum, in powers of e; points of a tile that a task holds.
TRUST, LEFT, PART = 1e-5, 37.0, 1 << 18
PLACES = np.cos((2 * np.arange(ORDER) + 1) * pi / (2 * ORDER))
BASIS = chebvander(PLACES, ORDER - 1).T * np.r_[1, np.full(ORDER - 1, 2)][:, None] / ORDER


class Nodes:
    """The bandwidths at which sums are worked out, and the matrix that turns them into those of the grid of bandwidths: the grid itself if it has no more."""

    def __init__(self, low: float, high: float, steps: int, n: int):
        self.grid = np.linspace(low, high, steps)
        wide = log(high / low)
        b = pi / 2 / wide if wide > 0 else 1e9
        many = ceil(log(max(n, 2) * 1e14) / log(b + np.sqrt(1 + b * b))) + 1
        if many >= steps:
            self.h, self.turn = np.sort(self.grid), None
            return
        at = -np.cos((2 * np.arange(many) + 1) * pi / (2 * many))
        self.h = low * np.exp((at + 1) / 2 * wide)
        basis = chebvander(at, many - 1).T * np.r_[1, np.full(many - 1, 2)][:, None] / many
        self.turn = (chebvander(np.clip(2 * np.log(self.grid / low) / wide - 1, -1, 1), many - 1) @ basis).T

    def levels(self) -> list[tuple[float, int, int]]:
        """Octaves: the least bandwidth, and the range of its nodes."""
        at = np.floor(np.log2(self.h / self.h[0]) + 1e-12).astype(int)
        return [(float(self.h[0] * 2.0**k), int(np.searchsorted(at, k)), int(np.searchsorted(at, k, "right"))) for k in np.unique(at)]


def _inside(x: np.ndarray, cell: np.ndarray, a: float) -> np.ndarray:
    """The values of the basis of a cell at each place."""
    return chebvander((x / a - cell - 0.5) * 2, ORDER - 1) @ BASIS


def _in_cells(rows: pd.DataFrame) -> list[np.ndarray]:
    """The places of rows of equal cells."""
    order = np.lexsort((rows["iy"], rows["ix"]))
    c = rows[["ix", "iy"]].to_numpy()[order]
    return np.split(order, np.flatnonzero((c[1:] != c[:-1]).any(axis=1)) + 1)


def _weights(points: DataFrame, levels: list, folds: int) -> DataFrame:
    """(level, ix, iy, data): for each cell and part of its points the weights of each fold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = levels[rows["level"].iloc[0]][0] * SIDE
        bx, by = (_inside(rows[c].to_numpy(), rows[f"i{c}"].to_numpy(), a) for c in "xy")
        fold, out = rows["fold"].to_numpy(), []
        for at in _in_cells(rows):
            data = np.stack([bx[own].T @ by[own] for f in range(folds) for own in [at[fold[at] == f]]])
            out.append((*rows[["level", "ix", "iy"]].iloc[at[0]], data.tobytes()))
        return pd.DataFrame(out, columns=["level", "ix", "iy", "data"])

    return points.groupBy("level", "tx", "ty", "part").applyInPandas(run, "level int, ix long, iy long, data binary")


def _by_grid(points: DataFrame, weights: DataFrame, levels: list, nodes: np.ndarray, folds: int) -> DataFrame:
    """(r, level, sums) of points, with the weights of cells that reach their tile."""

    def run(key: tuple, mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame([], columns=["r", "level", "sums"])
        level, tx, ty = (int(k) for k in key[:3])
        low, first, last = levels[level]
        a, side = low * SIDE, TILE + 2 * FAR
        w = np.zeros((folds, side, ORDER, side, ORDER))
        for i, j, data in zip(told["ix"] - tx * TILE + FAR, told["iy"] - ty * TILE + FAR, told["data"], strict=True):
            w[:, i, :, j, :] += np.frombuffer(data).reshape(folds, ORDER, ORDER)
        w = w.reshape(folds, side * ORDER, side * ORDER)
        others = [sum(w[g] for g in range(folds) if g != f) + np.zeros(w.shape[1:]) for f in range(folds)]
        place = ((np.arange(-FAR, TILE + FAR)[:, None] + 0.5 + PLACES / 2) * a).ravel()
        apart = place[FAR * ORDER : (FAR + TILE) * ORDER, None] - place
        bx, by = (_inside(mine[c].to_numpy(), mine[f"i{c}"].to_numpy(), a) for c in "xy")
        x, y, fold = (mine["ix"] - tx * TILE).to_numpy(), (mine["iy"] - ty * TILE).to_numpy(), mine["fold"].to_numpy()
        groups = [(f, x[at[0]], y[at[0]], own) for at in _in_cells(mine) for f in range(folds) for own in [at[fold[at] == f]] if len(own)]
        found = np.zeros((len(mine), last - first))
        for k in range(first, last):
            kernel = np.exp(-0.5 * (apart / nodes[k]) ** 2)
            value = [(kernel @ o @ kernel.T).reshape(TILE, ORDER, TILE, ORDER) for o in others]
            for f, i, j, own in groups:
                found[own, k - first] = ((bx[own] @ value[f][i, :, j, :]) * by[own]).sum(axis=1)
        return pd.DataFrame({"r": mine["r"], "level": level, "sums": [v.tobytes() for v in found]})

    by = ["level", "tx", "ty", "part"]
    return points.groupBy(*by).cogroup(weights.groupBy(*by)).applyInPandas(run, "r long, level int, sums binary")


def grid_sums(dealt: DataFrame, n: int, nodes: Nodes, folds: int) -> DataFrame:
    """(r, level, sums): of the points (r, x, y, fold) in dense tiles of an octave the sums at its nodes."""
    levels = nodes.levels()
    side = F.element_at(F.array(*[F.lit(low * SIDE) for low, _, _ in levels]), F.col("level") + 1)
    parts = -(-n // PART) or 1
    points = dealt.select("r", "x", "y", "fold", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))).alias("level"))
    points = points.select("*", *[F.floor(F.col(c) / side).alias(f"i{c}") for c in "xy"], F.pmod(F.xxhash64("r"), F.lit(parts)).cast("int").alias("part"))
    points = points.select("*", *[F.floor(F.col(f"i{c}") / TILE).alias(f"t{c}") for c in "xy"])
    tile, cell = ["level", "tx", "ty"], ["level", "tx", "ty", "ix", "iy"]
    dense = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).groupBy(*tile).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).where(F.col("n") >= DENSE * F.col("cells"))
    dense = stored(dense.select(*tile), "dense")
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    needed = dense.select("level", near("tx"), "ty").select("level", "tx", near("ty")).distinct()
    reach = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(f"i{c}") + k) / TILE) for k in (-FAR, 0, FAR)]))).alias(f"t{c}")
    sent = _weights(points.join(needed, tile, "left_semi"), levels, folds).select("*", reach("x")).select("*", reach("y")).join(dense, tile, "left_semi")
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return _by_grid(points.join(dense, tile, "left_semi"), sent, levels, nodes.h, folds)


def _told(dealt: DataFrame, sums: DataFrame, n: int, nodes: Nodes) -> DataFrame:
    """Points with their sums by grid at all nodes, from which node on these hold (first), and how far others matter below (far; infinite without any)."""
    levels, h = nodes.levels(), nodes.h
    by_point = sums.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("level", "sums"))).alias("sums"))

    @F.pandas_udf("sums binary, first int, far double")
    def told(found: pd.Series) -> pd.DataFrame:
        out = []
        for some in found:
            v = np.zeros(len(h))
            for level, data in ([] if some is None else some.items() if isinstance(some, dict) else some):
                v[levels[level][1] : levels[level][2]] = np.frombuffer(data)
            poor = np.flatnonzero(v < TRUST * n)
            first = poor[-1] + 1 if len(poor) else 0
            far = np.inf if first == len(h) else h[first] * np.sqrt(2 * (log(n / v[first]) + LEFT + log(n)))
            out.append((v.tobytes(), first, far))
        return pd.DataFrame(out, columns=["sums", "first", "far"])

    rows = dealt.join(by_point, "r", "left").select("r", "x", "y", "fold", told("sums").alias("t"))
    return rows.select("r", "x", "y", "fold", "t.*")


def _by_pairs(told: DataFrame, dealt: DataFrame, n: int, h: np.ndarray, size: int) -> DataFrame:
    """(r, near, sums): of points with nodes below their first, for each part of the others, the nearest of these and the sums at those nodes relative to it."""
    # squares of all reaches are told by their power of two; 2,000 is that of all points
    square = F.when(F.col("far") < float("inf"), F.ceil(F.log2("far")).cast("int")).otherwise(2000)
    at = lambda c: F.when(F.col("square") < 2000, F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("square")))).otherwise(0).cast("long")
    asked = told.where("first > 0").withColumn("square", square)
    asked = asked.select("r", "x", "y", "fold", "first", "square", at("x").alias("cx"), at("y").alias("cy"))
    cells = stored(asked.groupBy("square", "cx", "cy").agg(F.count(F.lit(1)).alias("n")), "cells")
    squares = [r["square"] for r in cells.select("square").distinct().collect()]  # a few numbers
    if not squares:
        return dealt.sparkSession.createDataFrame([], "r long, near double, sums binary")
    around = lambda c: F.explode(F.when(F.col("square") < 2000, F.sequence(at(c) - 1, at(c) + 1)).otherwise(F.array(F.lit(0).cast("long")))).alias(f"c{c}")
    others = dealt.select("r", "x", "y", "fold", F.explode(F.array(*map(F.lit, squares))).alias("square")).select("*", around("x")).select("*", around("y"))
    by = ["square", "cx", "cy"]
    there = others.join(cells, by, "left_semi")
    counts = cells.join(there.groupBy(*by).agg(F.count(F.lit(1)).alias("m")), by)
    counts = stored(counts.select(*by, F.ceil(F.col("n") / size).cast("int").alias("p"), F.ceil(F.col("m") / (8 * size)).cast("int").alias("q")), "counts")
    own = lambda c: F.pmod(F.xxhash64("r"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(counts, by).select(*by, own("p").alias("bi"), every("q").alias("bj"), "r", "x", "y", "fold", "first")
    right = there.join(counts, by).select(*by, every("p").alias("bi"), own("q").alias("bj"), "x", "y", "fold")
    s = 1 / (2 * h * h)
    octave = np.floor(np.log2(h / h[0]) + 1e-12).astype(int)

    def run(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        ox, oy, of = (others[c].to_numpy() for c in ("x", "y", "fold"))
        found = []
        by_fold = {f: (ox[of != f], oy[of != f]) for f in mine["fold"].unique()}
        for r, x, y, f, first in mine[["r", "x", "y", "fold", "first"]].itertuples(index=False):
            px, py = by_fold[f]
            if not len(px):
                continue
            d2 = (px - x) ** 2 + (py - y) ** 2
            near, sums = d2.min(), np.zeros(first)
            d2 -= near
            for k in range(octave[first - 1], -1, -1):  # from wide to narrow: fewer points matter
                some = np.flatnonzero(octave[:first] == k)
                if len(some):
                    d2 = d2[d2 <= (LEFT + log(n)) / s[some[-1]]]
                    sums[some] = np.exp(-d2[:, None] * s[some]).sum(axis=0) if len(d2) < 20_000 else [np.exp(-d2 * t).sum() for t in s[some]]
            found.append((r, near, sums.tobytes()))
        return pd.DataFrame(found, columns=["r", "near", "sums"])

    key = [*by, "bi", "bj"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "r long, near double, sums binary")


def log_densities(dealt: DataFrame, n: int, low: float, high: float, steps: int, folds: int, size: int) -> DataFrame:
    """(k, v): the sum over the points (r, x, y, fold) of the log of their density by the points of other folds, for the bandwidth k of an even grid. dealt: stored, n rows."""
    nodes = Nodes(low, high, steps, n)
    h, grid, turn = nodes.h, nodes.grid, nodes.turn
    told = stored(_told(dealt, grid_sums(dealt, n, nodes, folds), n, nodes), "told")
    shares = _by_pairs(told, dealt, n, h, size)
    slices = max(1, -(-n // 1024))
    slot = F.pmod(F.xxhash64("r"), F.lit(slices)).alias("slice")
    s, at = 1 / (2 * h * h), 1 / (2 * grid * grid)

    def whole(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        """Log densities of the points of a slice, summed."""
        own = {r: some for r, some in parts.groupby("r", sort=True)}
        total, seen = np.zeros(steps), False
        for r, f, first, data in rows.sort_values("r")[["r", "fold", "first", "sums"]].itertuples(index=False):
            m = n - (n // folds + (f < n % folds))
            if not m:
                continue
            value, near, seen = np.frombuffer(data).copy(), 0.0, True
            if first:
                near = own[r]["near"].min()
                value[first:] *= np.exp(near * s[first:])
                value[:first] = sum(np.frombuffer(v) * np.exp((near - d) * s[:first]) for v, d in zip(own[r]["sums"], own[r]["near"], strict=True))
            total += np.log(value if turn is None else value @ turn) - near * at - np.log(m * 2 * pi * grid**2)
        return pd.DataFrame({"k": np.arange(steps), "v": total} if seen else [], columns=["k", "v"])

    left, right = told.select("r", "fold", "first", "sums", slot), shares.select("*", slot)
    return left.groupBy("slice").cogroup(right.groupBy("slice")).applyInPandas(whole, "k int, v double")
