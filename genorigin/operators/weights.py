"""Weights of training samples by how dense their neighbourhood is. points: sampleid, x, y, all known."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genorigin.functions.geo import digitize
from genorigin.shared import stored

from .bandwidths import log_densities
from .kernel_sums import block_pairs, kernel_sums
from .ranks import ranked


def hist2d_bins(points: DataFrame, xbins: int = 10, ybins: int = 10) -> DataFrame:
    """Points with xbin and ybin among equal, right-closed bins over their range."""
    extent = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = points.crossJoin(F.broadcast(extent))  # one row
    return rows.select(
        *points.columns, digitize(F.col("x"), F.col("x0"), F.col("x1"), xbins).alias("xbin"), digitize(F.col("y"), F.col("y0"), F.col("y1"), ybins).alias("ybin")
    )


def hist2d_weights(points: DataFrame, xbins: int = 10, ybins: int = 10) -> DataFrame:
    """One over the number of points in the bin, divided by the least such weight: (sampleid, sample_weight)."""
    binned = hist2d_bins(points, xbins, ybins)
    counts = binned.groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))
    largest = F.broadcast(counts.agg(F.max("n").alias("most")))  # one row
    rows = binned.join(counts, ["xbin", "ybin"]).crossJoin(largest)
    return rows.select("sampleid", (F.col("most") / F.col("n")).alias("sample_weight"))


def kde_pairs(points: DataFrame) -> DataFrame:
    """All pairs of points with their squared distance: (sampleid, other, d2). Blocks of points meet by the key of their pair."""
    p = points.select("sampleid", "x", "y")
    left, right = block_pairs(p, p.count(), ["sampleid", "x", "y"])
    d = lambda c: (F.col(c) - F.col(f"other_{c}")) * (F.col(c) - F.col(f"other_{c}"))
    return left.join(right, ["bi", "bj"]).select("sampleid", F.col("other_sampleid").alias("other"), (d("x") + d("y")).alias("d2"))


def kde_pair_totals(points: DataFrame, most: int = 1 << 16) -> DataFrame:
    """By sample the number of its pairs of ``kde_pairs`` and the sum of their squared distances: (sampleid, pairs, total).

    Every pair is worked out, but added up in the task of its blocks, which gives a row a point. There are some 32 blocks, so that points are sent so often and no more, or more blocks if these would have
    over ``most`` points; a task holds two of them, and distances of a few points at a time.
    """
    n = points.count()
    size = max(1024, min(most, -(-n // 32)))
    left, right = block_pairs(points.select("sampleid", "x", "y"), n, ["sampleid", "x", "y"], size)
    spark = points.sparkSession
    tasks = min(max(1, -(-n // size)) ** 2, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))  # few bytes, long work
    left, right = (rows.repartition(tasks, "bi", "bj") for rows in (left, right.drop("other_sampleid")))

    def run(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        x, y, ox, oy = (c.to_numpy(float) for c in (mine["x"], mine["y"], others["other_x"], others["other_y"]))
        total = np.zeros(len(x))
        step = max(1, (1 << 18) // max(1, len(ox)))
        for at in range(0, len(x), step):
            dx, dy = x[at : at + step, None] - ox, y[at : at + step, None] - oy
            dx *= dx
            dy *= dy
            dx += dy
            total[at : at + step] = dx.sum(axis=1)
        return pd.DataFrame({"sampleid": mine["sampleid"], "pairs": len(ox), "total": total})

    kind = points.schema["sampleid"].dataType.simpleString()
    sums = left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInPandas(run, f"sampleid {kind}, pairs long, total double")
    return sums.groupBy("sampleid").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))


def kde_weights(points: DataFrame, lam: float = 1.0, bandwidth: float | None = None) -> DataFrame:
    """One over the Gaussian kernel density at each point, divided by the least, to the power lam, divided by the sum. The density's constant cancels."""
    h = bandwidth or bandwidth_argmax(bandwidth_scores(points))
    density = stored(kernel_sums(points.select("sampleid", "x", "y"), h), "density")
    raw = density.crossJoin(F.broadcast(density.agg(F.max("total").alias("most")))).select(  # one row
        "sampleid", F.pow(F.col("most") / F.col("total"), F.lit(float(lam))).alias("w")
    )
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("w").alias("total")))).select("sampleid", (F.col("w") / F.col("total")).alias("sample_weight"))


def bandwidth_scores(points: DataFrame, low: float = 0.1, high: float = 10.0, steps: int = 1000, folds: int = 5, size: int = 4096) -> DataFrame:
    """The summed held-out log density for every bandwidth of an even grid: (bandwidth, score).

    Folds are contiguous in order of id, the first n % folds of them one larger. How the sums are worked out is told in ``bandwidths``; size: points of a block where they are summed pair by pair.
    """
    numbered = ranked(points.select("sampleid", "x", "y"), F.col("sampleid"))
    many, extra = F.floor(F.col("n") / folds), F.col("n") % folds
    fold = F.when(F.col("r") < extra * (many + 1), F.floor(F.col("r") / (many + 1))).otherwise(extra + F.floor(F.try_divide(F.col("r") - extra * (many + 1), many)))
    dealt = stored(numbered.select("r", "x", "y", fold.cast("int").alias("fold")), "folds")
    found = log_densities(dealt, dealt.count(), low, high, steps, folds, size)
    step = (high - low) / (steps - 1)
    return found.groupBy("k").agg(F.sum("v").alias("score")).select((F.lit(low) + F.col("k") * F.lit(step)).alias("bandwidth"), "score")


def bandwidth_argmax(scores: DataFrame) -> float:
    """The bandwidth of the best score, the smallest on ties."""
    row = scores.orderBy(F.desc("score"), "bandwidth").first()
    if row is None:
        raise ValueError("No points to choose a bandwidth from")
    return row["bandwidth"]


def first_weight(weights: DataFrame, order: str | None = None) -> DataFrame:
    """One weight per sample: that of the first row by the order column (by the weight itself without one)."""
    return weights.groupBy("sampleid").agg(F.min_by("sample_weight", F.col(order or "sample_weight")).alias("sample_weight"))


def join_weights(points: DataFrame, weights: DataFrame, order: str | None = None) -> DataFrame:
    """Given weights of the points; a ValueError if a point has none."""
    one = first_weight(weights, order)
    if points.join(one, "sampleid", "left_anti").limit(1).count():
        raise ValueError("Some training samples have no weight")
    return points.join(one, "sampleid").select("sampleid", "sample_weight")


def weight_samples(points: DataFrame, method: str, weights: DataFrame | None = None, **options) -> DataFrame:
    """Weights by ``KD``, ``histogram`` or ``load``."""
    if method == "KD":
        return kde_weights(points, **options)
    if method == "histogram":
        return hist2d_weights(points, **options)
    if method == "load" and weights is not None:
        return join_weights(points, weights, **options)
    raise ValueError(f"Unknown weighting method {method!r}, or no weights given")
