"""Samples: validation, alignment, coordinates and roles. samples: sampleid, x, y and any other columns; null x is unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genorigin.functions.keyed import digest

from .ranks import ranked


def known_filter(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("x").isNotNull())


def unknown_filter(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("x").isNull())


def coord_moments(samples: DataFrame) -> DataFrame:
    """One row: mean and population standard deviation of each axis over known samples."""
    return samples.agg(
        F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("sd_x"), F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("sd_y")
    )


def normalize_coords(samples: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """x and y as z-scores; unknown stays unknown, and a spread of 0 gives null. moments: one row, by default of these samples."""
    m = F.broadcast(moments if moments is not None else coord_moments(samples))  # one row
    z = samples.crossJoin(m)
    for c in "xy":
        z = z.withColumn(c, F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"sd_{c}")))
    return z.select(*samples.columns)


def denormalize_coords(rows: DataFrame, moments: DataFrame) -> DataFrame:
    z = rows.crossJoin(F.broadcast(moments))  # one row
    for c in "xy":
        z = z.withColumn(c, F.col(c) * F.col(f"sd_{c}") + F.col(f"mean_{c}"))
    return z.select(*rows.columns)


def map_extent(samples: DataFrame, pad: float = 0.1) -> DataFrame:
    """One row: the range of each axis, widened by a tenth of its length on each side."""
    low_high = samples.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = lambda c: F.lit(pad) * (F.col(f"{c}1") - F.col(f"{c}0"))
    return low_high.select(
        (F.col("x0") - side("x")).alias("xmin"), (F.col("x1") + side("x")).alias("xmax"), (F.col("y0") - side("y")).alias("ymin"), (F.col("y1") + side("y")).alias("ymax")
    )


def join_samples(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Calls with their sample's metadata. Catalyst chooses the join; it broadcasts the samples when they are small enough."""
    return calls.join(samples, "sampleid")


def unmatched_samples(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Ids in calls that have no metadata."""
    return calls.select("sampleid").distinct().join(samples, "sampleid", "left_anti")


def check_sample_alignment(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """The calls; a ValueError if any sample has no metadata."""
    if unmatched_samples(calls, samples).limit(1).count():
        raise ValueError("Sample ordering failed! Some genotyped samples have no metadata.")
    return calls


def sample_order(samples: DataFrame) -> DataFrame:
    """Number the samples by id from 0."""
    return ranked(samples.select("sampleid"), F.col("sampleid")).select("sampleid", F.col("r").alias("i"))


def pick_samples(rows: DataFrame, n: int = 9, seed: int = 0, ids: list[str] | None = None) -> DataFrame:
    """n distinct sample ids at random, or those of the list that are there."""
    found = rows.select("sampleid").distinct()
    if ids is not None:
        return found.where(F.col("sampleid").isin(*ids))
    return found.orderBy(digest(seed, "sampleid"), "sampleid").limit(n)


def training_locations(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Samples that are not among the predictions."""
    return samples.join(predictions.select("sampleid").distinct(), "sampleid", "left_anti")


def prediction_set(samples: DataFrame, training_ids: DataFrame) -> DataFrame:
    """Ids to predict: all that are not in the training set, and those in it without coordinates."""
    others = samples.select("sampleid").join(training_ids, "sampleid", "left_anti")
    unknown = unknown_filter(samples).select("sampleid").join(training_ids, "sampleid", "left_semi")
    return others.union(unknown).distinct()
