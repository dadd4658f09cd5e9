"""Summaries of predictions: errors, centroids, densities, reshaping. predictions: sampleid, x, y and run keys such as replicate."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from genorigin.functions.geo import digitize, euclid_error
from genorigin.functions.genotype import clean_sample_id

from .quantiles import exact_quantiles

#: Rows of a grid that a task works out at once.
ROWS = 10


def join_predictions_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with x_true and y_true of known samples; ids are cleaned of quotes."""
    known = truth.where(F.col("x").isNotNull()).select(clean_sample_id(F.col("sampleid")).alias("sampleid"), F.col("x").alias("x_true"), F.col("y").alias("y_true"))
    return predictions.withColumn("sampleid", clean_sample_id(F.col("sampleid"))).join(known, "sampleid")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The rows; a ValueError if there are none."""
    if not df.limit(1).count():
        raise ValueError(what)
    return df


def with_error(joined: DataFrame) -> DataFrame:
    return joined.withColumn("err", euclid_error(F.col("x"), F.col("y"), F.col("x_true"), F.col("y_true")))


def error_summary(errors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number, mean, median and largest error, and R² of each axis; keys give a row per group. The median is exact, and no task holds all values."""
    by = keys or []
    sums = errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("err").alias("mean_error"), F.max("err").alias("max_error"),
        F.pow(F.corr("x", "x_true"), F.lit(2.0)).alias("r2_x"), F.pow(F.corr("y", "y_true"), F.lit(2.0)).alias("r2_y"),
    )
    middle = exact_quantiles(errors, "err", [0.5], by).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("q")[0].alias("median_error"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or [F.lit(True)]
    joined = sums.join(middle if by else F.broadcast(middle), same, "left")  # without keys one row on either side
    return joined.select(*by, "n", "mean_error", "median_error", "max_error", "r2_x", "r2_y")


def error_quantiles(errors: DataFrame, column: str = "err") -> DataFrame:
    """One row: the mean, and exactly the median and the 5th and 95th percentile."""
    q = exact_quantiles(errors, column, [0.5, 0.05, 0.95]).select(*[F.col("q")[k].alias(c) for k, c in enumerate(("median_error", "q05", "q95"))])
    return errors.agg(F.avg(column).alias("mean_error")).join(F.broadcast(q), F.lit(True), "left")  # one row on either side


def error_histogram(errors: DataFrame, bins: int = 10) -> DataFrame:
    """Counts of errors in equal bins over their range: (bin, n)."""
    extent = F.broadcast(errors.agg(F.min("err").alias("lo"), F.max("err").alias("hi")))  # one row
    rows = errors.crossJoin(extent)
    return rows.groupBy(digitize(F.col("err"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def error_by_location(errors: DataFrame) -> DataFrame:
    return errors.groupBy("x_true", "y_true").agg(F.avg("err").alias("mean_error"))


def count_by_location(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("x").isNotNull()).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def location_stats_join(errors: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean error at each true location with the number of samples there."""
    counts = count_by_location(samples).withColumnsRenamed({"x": "x_true", "y": "y_true"})
    return error_by_location(errors).join(counts, ["x_true", "y_true"])


def replicate_centroid(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("sampleid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def ensemble_mean(predictions: DataFrame) -> DataFrame:
    """The mean over models of each unknown sample's predictions, and each validation row by its own fold's model: (sampleid, x, y, role)."""
    mean = predictions.where("role = 'pred'").groupBy("sampleid").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("role", F.lit("pred"))
    return mean.unionByName(predictions.where("role = 'val'").select("sampleid", "x", "y", "role"))


def ensemble_val_loss(history: DataFrame, key: str = "fold") -> DataFrame:
    last = history.groupBy(key).agg(F.max_by("val_loss", "epoch").alias("last"))
    return last.agg(F.avg("last").alias("mean_val_loss"), F.stddev_pop("last").alias("sd_val_loss"))


def best_epoch(history: DataFrame, key: str) -> DataFrame:
    return history.groupBy(key).agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"))


def union_predictions(*parts: DataFrame) -> DataFrame:
    """Predictions one below the other, by name; columns that some lack are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pivot_replicates(predictions: DataFrame, key: str, values: list, suffix: str = "") -> DataFrame:
    """Long to wide: x_<key>, y_<key> per sample. values: the keys, which become columns."""
    wide = predictions.groupBy("sampleid").pivot(key, values).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    return wide.select("sampleid", *[F.col(f"`{v}_{c}`").alias(f"{c}_{suffix}{v}") for v in values for c in "xy"])


def unpivot_replicates(wide: DataFrame) -> DataFrame:
    """Wide to long: (sampleid, replicate, x, y) from columns x_<replicate> and y_<replicate>."""
    names = [c[2:] for c in wide.columns if c.startswith("x_") and f"y_{c[2:]}" in wide.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("replicate"), F.col(f"`x_{r}`").alias("x"), F.col(f"`y_{r}`").alias("y")) for r in names]))
    return wide.select("sampleid", rows.alias("r")).select("sampleid", "r.replicate", "r.x", "r.y").where("x is not null and y is not null")


def _checked_grid(n: int) -> int:
    if n < 1:
        raise ValueError("Grids have a point a side at least")
    return n


def _grid_sums(px: np.ndarray, py: np.ndarray, a: float, b: float, c: float, x0: float, x1: float, y0: float, y1: float, n: int, first: int, rows: int) -> np.ndarray:
    """The sums of a sample's kernels over some rows of its grid, gx by gx: a, b, c of the quadratic form, the grid's limits and points a side, the first row and how many. One row of cells by all points is
    held at a time."""
    dy = (y0 + np.arange(n) * ((y1 - y0) / max(n - 1, 1)))[:, None] - py
    flat, cross = c * dy * dy, 2 * b * dy
    sums = []
    for i in range(first, min(n, first + rows)):
        dx = x0 + i * ((x1 - x0) / max(n - 1, 1)) - px
        sums.append(np.exp(-0.5 * (a * dx * dx + cross * dx + flat)).sum(axis=1))
    return np.concatenate(sums)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _densities(xs: pd.Series, ys: pd.Series, shape: pd.DataFrame) -> pd.Series:
    return pd.Series([_grid_sums(px, py, *form, int(n), int(first), int(rows)) for px, py, (*form, n, first, rows) in zip(xs, ys, shape.itertuples(index=False), strict=True)])


def _tasks(df: DataFrame) -> int:
    """Into how many tasks long work on few bytes is dealt, at least."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _kernels(predictions: DataFrame, n: int, limits: DataFrame | None) -> DataFrame:
    """Samples that have a surface, a row each: their points, number of points, quadratic form (a, b, c), norm and the limits of the grid."""
    from genorigin.operators.samples import map_extent

    _checked_grid(n)
    box = F.broadcast(limits if limits is not None else map_extent(predictions))  # one row
    stats = predictions.groupBy("sampleid").agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"),
        F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"),
    )
    h = F.pow(F.col("n").cast("double"), F.lit(-1 / 3))
    usable = stats.withColumn("det", F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")).where("n > 2 and det > 0 and det > 1e-12 * vx * vy")
    return usable.select(
        "sampleid", "points", "n", (F.col("vy") / F.col("det") / h).alias("a"), (-F.col("vxy") / F.col("det") / h).alias("b"), (F.col("vx") / F.col("det") / h).alias("c"),
        (2 * F.lit(3.141592653589793) * F.sqrt(F.col("det")) * h).alias("norm"),
    ).crossJoin(box)


def kde_surface(predictions: DataFrame, n: int = 100, limits: DataFrame | None = None) -> DataFrame:
    """The density of each sample's replicate predictions on an n by n grid: (sampleid, gx, gy, density).

    A Gaussian kernel with the sample's own covariance times Scott's factor squared, count ** (-1/3). limits: one row (xmin, xmax, ymin, ymax), by default the extent
    of all predictions. Samples with fewer than three predictions, or a covariance that cannot be inverted, have no surface. Points are gathered by sample (they are replicates); a sample and some
    rows of its grid are a piece of work, and pieces are dealt to a given number of tasks, as they have few bytes before they are unfolded and many after.
    """
    scaled = _kernels(predictions, n, limits)
    pieces = scaled.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(ROWS)))).repartition(4 * _tasks(predictions), "sampleid", "first")
    sums = _densities(F.col("points")["x"], F.col("points")["y"], F.struct("a", "b", "c", "xmin", "xmax", "ymin", "ymax", F.lit(n).alias("side"), "first", F.lit(ROWS).alias("rows")))
    cells = pieces.select("sampleid", "n", "norm", "xmin", "xmax", "ymin", "ymax", "first", F.posexplode(sums).alias("at", "total")).withColumn("k", F.col("at") + F.col("first") * n)
    at = lambda low, high, i: F.col(low) + i * ((F.col(high) - F.col(low)) / F.lit(max(n - 1, 1)))
    gx, gy = at("xmin", "xmax", F.floor(F.col("k") / n)), at("ymin", "ymax", F.col("k") % n)
    return cells.select("sampleid", gx.alias("gx"), gy.alias("gy"), (F.col("total") / F.col("n") / F.col("norm")).alias("density"))


def kde_contour_levels(surface: DataFrame) -> DataFrame:
    """The 85th, 90th, 95th and 99th percentile of positive densities of each sample."""
    q = F.percentile("density", F.array(*[F.lit(p) for p in (0.85, 0.9, 0.95, 0.99)]))
    levels = surface.where("density > 0").groupBy("sampleid").agg(q.alias("q"))
    return levels.select("sampleid", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((85, 90, 95, 99))])


def peak_cell(px: np.ndarray, py: np.ndarray, gx: np.ndarray, gy: np.ndarray, hx: float, hy: float) -> tuple[int, int]:
    """The cell of the largest sum of products of both axes' kernels; of equal ones (to 9 places) the one with the least x, then y.

    Branch and bound: no cell of a rectangle has a larger sum than the sum of every point's kernel at the rectangle's nearest place. Rectangles are split in four, those with the largest bounds first, down to
    single cells, and a rectangle is left out once its bound is below a sum already found by more than the rounding. So only cells near the peak are worked out, and memory is that of the points.
    """
    nx, ny = len(gx), len(gy)

    def axis(g: np.ndarray, p: np.ndarray, h: float, a: int, b: int) -> np.ndarray:
        off = np.maximum(np.maximum(g[a] - p, p - g[b - 1]), 0)
        return np.exp(-0.5 * (off / h) ** 2)

    best, cells, heap = -np.inf, {}, [(-np.inf, 0, nx, 0, ny)]
    while heap:
        bound, a, b, c, d = heapq.heappop(heap)
        if -bound < best - 2e-9:
            break
        if b - a == 1 and d - c == 1:
            value = float(axis(gx, px, hx, a, b) @ axis(gy, py, hy, c, d))
            cells[a, c] = round(value, 9)
            best = max(best, value)
            continue
        for x in ((a, (a + b) // 2), ((a + b) // 2, b)) if b - a > 1 else ((a, b),):
            kx = axis(gx, px, hx, *x)
            for y in ((c, (c + d) // 2), ((c + d) // 2, d)) if d - c > 1 else ((c, d),):
                heapq.heappush(heap, (-float(kx @ axis(gy, py, hy, *y)), *x, *y))
    return min(cells, key=lambda k: (-cells[k], *k))


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def _peaks(xs: pd.Series, ys: pd.Series, shape: pd.DataFrame) -> pd.DataFrame:
    out = []
    for px, py, (x0, x1, y0, y1, hx, hy, n) in zip(xs, ys, shape.itertuples(index=False), strict=True):
        n = int(n)
        gx, gy = (a + np.arange(n) * ((b - a) / max(n - 1, 1)) for a, b in ((x0, x1), (y0, y1)))
        i, j = peak_cell(np.asarray(px), np.asarray(py), gx, gy, hx, hy)
        out.append((gx[i], gy[j]))
    return pd.DataFrame(out, columns=["x", "y"])


def kde_peak(predictions: DataFrame, n: int = 500) -> DataFrame:
    """The cell of highest density of each sample's predictions: (sampleid, x, y).

    A product kernel on an n by n grid over the sample's own range, with a normal-reference bandwidth per axis: 1.06 times the smaller of the standard
    deviation and the interquartile range over 1.34, times count ** (-1/5); the kernel's deviation is that bandwidth. The cell is found by branch and bound (``peak_cell``), a sample at a time; samples are
    dealt to a given number of tasks. Samples without a positive bandwidth get their mean.
    """
    _checked_grid(n)
    q = lambda c, p: F.percentile(c, F.lit(p))
    stats = predictions.groupBy("sampleid").agg(
        F.count(F.lit(1)).alias("n"), *[f for c in "xy" for f in (
            F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"), F.avg(c).alias(f"m{c}"), F.stddev_samp(c).alias(f"s{c}"), (q(c, 0.75) - q(c, 0.25)).alias(f"i{c}"),
        )], F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"),
    )
    for c in "xy":
        stats = stats.withColumn(f"h{c}", 1.06 * F.least(F.col(f"s{c}"), F.col(f"i{c}") / 1.34) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    fine = F.coalesce((F.col("hx") > 0) & (F.col("hy") > 0), F.lit(False))
    poor = stats.where(~fine).select("sampleid", F.col("mx").alias("x"), F.col("my").alias("y"))
    peak = _peaks(F.col("points")["x"], F.col("points")["y"], F.struct("x0", "x1", "y0", "y1", "hx", "hy", F.lit(n).alias("side")))
    return stats.where(fine).repartition(4 * _tasks(predictions), "sampleid").select("sampleid", peak.alias("p")).select("sampleid", "p.x", "p.y").unionByName(poor)


def hdr_cumulative(surface: DataFrame) -> DataFrame:
    """Cells of each sample with the share of the mass at or above them, in falling order of density to 9 places, then of gx and gy."""
    order = Window.partitionBy("sampleid").orderBy(F.desc(F.round("density", 9)), "gx", "gy").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("sampleid")
    return surface.withColumn("mass", F.sum("density").over(order) / F.sum("density").over(total))


def hdr_levels(surface: DataFrame, masses: tuple[float, ...] = (0.95, 0.5, 0.1)) -> DataFrame:
    """The density above which so much of the mass lies: (sampleid, mass, level).

    With the cells of a sample in rising order of density, the mass up to each is the running sum of densities times the area of a cell; the level is interpolated
    between the two cells around 1 - mass. Masses that lie outside the grid's own give null. A sample's cells form an even grid.
    """
    by = Window.partitionBy("sampleid").orderBy("density", "gx", "gy")
    side = lambda c: (F.max(c) - F.min(c)) / (F.size(F.collect_set(c)) - 1)
    grids = surface.groupBy("sampleid").agg((side("gx") * side("gy")).alias("area"))
    cells = surface.join(grids, "sampleid").withColumn("m1", F.sum("density").over(by.rowsBetween(Window.unboundedPreceding, 0)) * F.col("area"))
    cells = cells.withColumn("m0", F.lag("m1").over(by)).withColumn("d0", F.lag("density").over(by))
    want = cells.withColumn("mass", F.explode(F.array(*[F.lit(m) for m in masses]))).withColumn("t", 1 - F.col("mass"))
    hit = want.where((F.col("m0") < F.col("t")) & (F.col("m1") >= F.col("t")))
    level = F.col("d0") + (F.col("density") - F.col("d0")) * (F.col("t") - F.col("m0")) / (F.col("m1") - F.col("m0"))
    every = grids.select("sampleid", F.explode(F.array(*[F.lit(m) for m in masses])).alias("mass"))
    return every.join(hit.select("sampleid", "mass", level.alias("level")), ["sampleid", "mass"], "left")


def _on_grids(predictions: DataFrame, n: int, limits: DataFrame | None, told: Callable[[pa.Scalar, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """What is told of each sample's surface, from its id and the gx, gy and densities of its cells in order of gx and gy. A sample's grid is made, used and dropped in one place, so cells are never shuffled."""
    form = ["a", "b", "c", "xmin", "xmax", "ymin", "ymax"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(*[batch.column(c).to_numpy() for c in [*form, "n", "norm"]], strict=True)
            for k, (*own, many, norm) in enumerate(shapes):
                gx, gy = (low + np.arange(n) * ((high - low) / max(n - 1, 1)) for low, high in (own[3:5], own[5:7]))
                sums = _grid_sums(*[batch.column(c)[k].values.to_numpy() for c in ("xs", "ys")], *own, n, 0, n)
                yield told(batch.column("sampleid")[k], np.repeat(gx, n), np.tile(gy, n), sums / many / norm)

    rows = _kernels(predictions, n, limits).repartition(4 * _tasks(predictions), "sampleid")
    return rows.select("sampleid", F.col("points")["x"].alias("xs"), F.col("points")["y"].alias("ys"), *form, "n", "norm").mapInArrow(run, schema)


def _fields(predictions: DataFrame, *names: str) -> T.StructType:
    return T.StructType([predictions.schema["sampleid"], *[T.StructField(c, T.DoubleType()) for c in names]])


def kde_hdr_cumulative(predictions: DataFrame, n: int = 100, limits: DataFrame | None = None) -> DataFrame:
    """``hdr_cumulative`` of ``kde_surface``, worked out sample by sample: (sampleid, gx, gy, density, mass). Where all cells have a density of 0, mass is null."""

    def told(i: pa.Scalar, gx: np.ndarray, gy: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(-np.round(d, 9), kind="stable")
        mass = np.cumsum(d[order])
        share = pa.array(mass / mass[-1]) if mass[-1] > 0 else pa.nulls(len(d), pa.float64())
        return pa.RecordBatch.from_arrays([pa.repeat(i, len(d)), *map(pa.array, (gx[order], gy[order], d[order])), share], ["sampleid", "gx", "gy", "density", "mass"])

    return _on_grids(predictions, n, limits, told, _fields(predictions, "gx", "gy", "density", "mass"))


def kde_hdr_levels(predictions: DataFrame, masses: tuple[float, ...] = (0.95, 0.5, 0.1), n: int = 100, limits: DataFrame | None = None) -> DataFrame:
    """``hdr_levels`` of ``kde_surface``, worked out sample by sample: (sampleid, mass, level)."""

    def told(i: pa.Scalar, gx: np.ndarray, gy: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        side = [(g[-1] - g[0]) / max(n - 1, 1) for g in (gx, gy)]
        d = np.sort(d)
        m = np.cumsum(d) * (side[0] * side[1])
        levels = []
        for t in (1 - mass for mass in masses):
            k = int(np.searchsorted(m, t))
            levels.append(float(d[k - 1] + (d[k] - d[k - 1]) * (t - m[k - 1]) / (m[k] - m[k - 1])) if 0 < k < len(m) else None)
        return pa.RecordBatch.from_arrays([pa.repeat(i, len(masses)), pa.array(masses, pa.float64()), pa.array(levels, pa.float64())], ["sampleid", "mass", "level"])

    return _on_grids(predictions, n, limits, told, _fields(predictions, "mass", "level"))
