"""Species ranges: rings of polygons, their raster, and look-up of places in it.

rings: poly, ring, seq, x, y, each ring closed by going back to its first point. A cell or place is inside if it has an odd number of edges to its right.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def ring_edges(rings: DataFrame) -> DataFrame:
    """The edges of the rings: x, y, x2, y2."""
    by = Window.partitionBy("poly", "ring").orderBy("seq")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole)).alias(f"{c}2")
    return rings.select("poly", "ring", "x", "y", following("x"), following("y"))


def rasterize_range(rings: DataFrame, resolution: float) -> DataFrame:
    """Cells (row, col, valid) of the bounding box, int(extent / resolution) a side, row 0 at the top; valid is 1 where the cell's centre is in any polygon, else 0.

    Scanline fill: each edge is unfolded to the rows whose centres it crosses, and there to how many cells lie left of it. A row's crossings of a polygon are sorted, and the cells between an odd number
    of crossings and the next are inside. Only edges' own rows and inside cells are ever made, and all meet by their keys.
    """
    box = rings.agg(F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"))
    rows, cols = (((F.col(b) - F.col(a)) / resolution).cast("int") for a, b in (("by0", "by1"), ("bx0", "bx1")))
    size = F.broadcast(box.select("*", rows.alias("rows"), cols.alias("cols")))  # one row
    cells = (
        size.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        .repartition(F.col("row"))
        .select("row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    )
    level = ring_edges(rings).where("y <> y2").crossJoin(size)  # level edges are never crossed
    at = lambda y, shift: F.floor((F.col("by1") - y) / resolution).cast("int") + shift
    first, last = F.greatest(F.lit(0), at(F.greatest("y", "y2"), -1)), F.least(F.col("rows") - 1, at(F.least("y", "y2"), 1))
    unfolded = level.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    py = F.col("by1") - (F.col("row") + 0.5) * resolution
    crossed = unfolded.withColumn("py", py).where((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py")))
    crossed = crossed.withColumn("cross", (F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x"))
    guess = F.greatest(F.lit(0), F.least(F.col("cols"), F.floor((F.col("cross") - F.col("bx0")) / resolution).cast("int")))
    left_of = lambda k: F.col("bx0") + (k + 0.5) * resolution < F.col("cross")
    near = [F.when((guess + d >= 0) & (guess + d < F.col("cols")) & left_of(guess + d), guess + d + 1) for d in (-1, 0, 1)]
    cell = F.coalesce(near[2], near[1], near[0], F.least(guess, F.lit(0)))  # how many cells lie left of the crossing
    by = Window.partitionBy("row", "poly").orderBy("cell")
    runs = crossed.select("row", "poly", cell.alias("cell")).withColumn("before", F.coalesce(F.lag("cell").over(by), F.lit(0)))
    runs = runs.withColumn("right", F.count(F.lit(1)).over(Window.partitionBy("row", "poly")) - F.row_number().over(by) + 1)
    inside = runs.where("right % 2 = 1 and before < cell").select("row", F.explode(F.sequence(F.col("before"), F.col("cell") - 1)).alias("col")).distinct()
    return cells.join(inside.withColumn("hit", F.lit(1.0)), ["row", "col"], "left").select("row", "col", F.coalesce("hit", F.lit(0.0)).alias("valid"))


def raster_shape(rings: DataFrame, resolution: float) -> DataFrame:
    """One row: left and upper edge of the raster and its last row and column."""
    box = rings.agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("low"), F.max("y").alias("top"))
    cells = lambda a, b: ((F.col(b) - F.col(a)) / resolution).cast("int") - 1
    return box.select("left", "top", cells("low", "top").alias("last_row"), cells("left", "right").alias("last_col"))


def mask_lookup(places: DataFrame, mask: DataFrame, shape: DataFrame, resolution: float) -> DataFrame:
    """places (sampleid, x, y) with valid of their nearest cell: indexes are rounded half to even and clipped to the raster."""
    at = lambda v, last: F.greatest(F.lit(0), F.least(F.rint(v).cast("int"), F.col(last)))
    rows = places.crossJoin(F.broadcast(shape))  # one row
    keyed = rows.withColumn("row", at((F.col("top") - F.col("y")) / resolution, "last_row")).withColumn("col", at((F.col("x") - F.col("left")) / resolution, "last_col"))
    return keyed.join(mask, ["row", "col"]).select(*places.columns, "row", "col", "valid")


#: The most cells of a raster that tasks hold as an array.
MOST_CELLS = 25_000_000


class RangeScore:
    """weight * (1 - valid) ** 2 of places (n, 2): a term of the score of a model, as it has no gradient. Held by tasks that fit models."""

    def __init__(self, mask: np.ndarray, left: float, top: float, resolution: float, weight: float):
        self.mask, self.left, self.top, self.resolution, self.weight = mask, left, top, resolution, weight

    def __call__(self, places: np.ndarray) -> np.ndarray:
        row = np.clip(np.rint((self.top - places[:, 1]) / self.resolution), 0, self.mask.shape[0] - 1).astype(int)
        col = np.clip(np.rint((places[:, 0] - self.left) / self.resolution), 0, self.mask.shape[1] - 1).astype(int)
        return self.weight * (1.0 - self.mask[row, col]) ** 2


def range_score(rings: DataFrame, resolution: float, weight: float = 1.0) -> RangeScore:
    """The penalty for places outside the range, to be given to models; its raster is checked to be of a bounded size."""
    shape = raster_shape(rings, resolution).first()
    size = shape["last_row"] + 1, shape["last_col"] + 1
    if size[0] * size[1] > MOST_CELLS:
        raise ValueError(f"A raster for models may have {MOST_CELLS} cells")
    mask = np.zeros(size)
    inside = rasterize_range(rings, resolution).where("valid > 0").select("row", "col").toPandas()  # at most MOST_CELLS rows
    mask[inside["row"], inside["col"]] = 1.0
    return RangeScore(mask, shape["left"], shape["top"], resolution, weight)
