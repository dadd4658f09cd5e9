"""Splits, folds, windows, bootstraps and jackknife masks. All draws are keyed (see ``functions.keyed``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genorigin.functions.keyed import binomial2, digest, uniform

from .ranks import ranked
from .samples import known_filter, unknown_filter
from .sites import SITE


def _ranked(samples: DataFrame, seed) -> DataFrame:
    """Samples with rank r from 0 in shuffled order and their number n."""
    return ranked(samples.select("sampleid"), digest(seed, "sampleid"), F.col("sampleid"))


def _roles(samples: DataFrame, role, seed) -> DataFrame:
    numbered = _ranked(known_filter(samples), seed).select("sampleid", role.alias("role"))
    return numbered.union(unknown_filter(samples).select("sampleid", F.lit("pred").alias("role")))


def train_test_split(samples: DataFrame, train_split: float = 0.9, seed: int = 0) -> DataFrame:
    """Roles (sampleid, role): of the n known samples round-half-even((1 - train_split) n) are val, the rest train; unknown ones are pred."""
    held = F.bround((1 - F.lit(float(train_split))) * F.col("n"), 0)
    return _roles(samples, F.when(F.col("r") < held, "val").otherwise("train"), seed)


def phased_split(samples: DataFrame, train_split: float = 0.9, seed: int = 0, cv: bool = False) -> DataFrame:
    """Roles of haplotypes ``_h0`` and ``_h1``: both follow their sample. With cv, the validation samples are predicted too."""
    roles = train_test_split(samples, train_split, seed)
    both = roles.select("sampleid", "role", F.explode(F.array(F.lit("_h0"), F.lit("_h1"))).alias("h")).select(F.concat("sampleid", "h").alias("sampleid"), "role")
    return both.withColumn("predicted", (F.col("role") == "pred") | (F.lit(cv) & (F.col("role") == "val")))


def holdout_split(samples: DataFrame, k: int = 10, train_split: float = 0.9, seed: int = 0, ids: list[str] | None = None) -> DataFrame:
    """Roles with k known samples, drawn or given, as holdout; the others are split into val and train. A ValueError if k is not below the number of
    known samples, or a given id is not known."""
    known = known_filter(samples)
    n = known.count()
    if ids is not None:
        found = known.where(F.col("sampleid").isin(*ids)).select("sampleid").distinct().count()
        if found < len(set(ids)):
            raise ValueError("Some holdout samples are not among those with known locations")
        k = found
    if k >= n:
        raise ValueError(f"Cannot hold out {k} of {n} samples")
    first = F.lit(0) if ids is None else F.when(F.col("sampleid").isin(*ids), 0).otherwise(1)
    numbered = ranked(known.select("sampleid"), first, digest(seed, "sampleid"), F.col("sampleid"))
    held = F.bround((1 - F.lit(float(train_split))) * F.lit(n - k), 0)
    role = F.when(F.col("r") < k, "holdout").when(F.col("r") < k + held, "val").otherwise("train")
    return numbered.select("sampleid", role.alias("role")).union(unknown_filter(samples).select("sampleid", F.lit("pred").alias("role")))


def systematic_holdouts(samples: DataFrame, k: int = 10, seed: int | None = None) -> DataFrame:
    """Chunks of k known samples in order of id (shuffled if a seed is given): (sampleid, holdout_id). Every known sample is in one."""
    order = [F.col("sampleid")] if seed is None else [digest(seed, "sampleid"), F.col("sampleid")]
    return ranked(known_filter(samples).select("sampleid"), *order).select("sampleid", F.floor(F.col("r") / k).cast("int").alias("holdout_id"))


def kfold_split(samples: DataFrame, k: int = 5, seed: int = 0, training_ids: DataFrame | None = None) -> DataFrame:
    """Folds (sampleid, fold) over known samples: n // k each, the last takes what is left. A ValueError if there are fewer samples than folds or a
    training id is unknown."""
    known = known_filter(samples)
    if training_ids is not None:
        if training_ids.join(samples, "sampleid", "left_anti").limit(1).count():
            raise ValueError("Training set has samples without metadata")
        known = known.join(training_ids, "sampleid", "left_semi")
    if known.limit(k).count() < k:
        raise ValueError(f"Fewer known samples than {k} folds")
    fold = F.least(F.floor(F.col("r") / F.floor(F.col("n") / k)), F.lit(k - 1)).cast("int")
    return _ranked(known, seed).select("sampleid", fold.alias("fold"))


def fold_roles(folds: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """For every fold its roles: (fold, sampleid, role)."""
    model = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = folds.select(model.alias("m"), "sampleid", "fold").select(
        F.col("m").alias("fold"), "sampleid", F.when(F.col("fold") == F.col("m"), "val").otherwise("train").alias("role")
    )
    rest = unknown_filter(samples).select(model.alias("fold"), "sampleid", F.lit("pred").alias("role"))
    return own.union(rest)


#: What tells windows apart.
WINDOW = ["chrom", "window_start"]


def window_starts(start: int, stop: int, size: int) -> list[int]:
    return list(range(start, stop, size))


def window_assign(sites: DataFrame, size: int, start: int = 0, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Each site with the start of every window [window_start, window_start + size) of its chromosome that it is in. A window is (chrom, window_start).

    Windows start every step (by default size, so they do not overlap) from start on, below stop if given. Tumbling windows are a division, sliding ones
    an explode of the few starts that cover a position; there is no range join.
    """
    step = step or size
    p = F.col("position") - start
    last = F.floor(p / step)
    first = F.greatest(F.floor((p - size) / step) + 1, F.lit(0))
    inside = sites.where(p >= 0)
    k = last if step == size else F.explode(F.when(last >= first, F.sequence(first, last)))
    out = inside.withColumn("__k", k).withColumn("window_start", (start + F.col("__k") * step).cast("long")).drop("__k")
    return out if stop is None else out.where(F.col("window_start") < stop)


def sites_per_window(sites: DataFrame, size: int, start: int = 0, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Windows (chrom, window_start) with at least one site, and how many they have."""
    return window_assign(sites, size, start, stop, step).groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n_sites"))


def bootstrap_sites(sites_indexed: DataFrame, n_sites: int, replicates: int, seed: int = 0) -> DataFrame:
    """Per replicate n draws with replacement: (replicate, draw, chrom, position)."""
    spark = sites_indexed.sparkSession
    draws = spark.range(replicates * n_sites).select(
        F.floor(F.col("id") / n_sites).cast("int").alias("replicate"), (F.col("id") % n_sites).alias("draw")
    )
    picked = draws.withColumn("site", F.floor(uniform(seed, "replicate", "draw") * n_sites).cast("long"))
    return picked.join(sites_indexed, "site").select("replicate", "draw", *SITE)


def bootstrap_indices(replicate, n_sites, seed: int = 0):
    """The draws of one replicate as an array of positions in the feature vector (1-based), for use on assembled vectors. n_sites: a number or a column."""
    n_sites = n_sites if isinstance(n_sites, Column) else F.lit(n_sites)
    return F.transform(F.sequence(F.lit(0), n_sites - 1), lambda i: F.floor(uniform(seed, replicate, i) * n_sites).cast("int") + 1)


def jackknife_sites(sites: DataFrame, replicates: int, prop: float = 0.05, seed: int = 0, n_sites: int | None = None) -> DataFrame:
    """Per replicate int(n prop) sites without replacement: (replicate, chrom, position). All replicates are ranked at once, as each has as many sites."""
    n = n_sites if n_sites is not None else sites.count()
    rows = sites.select(*SITE, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    numbered = ranked(rows, F.col("replicate"), digest(seed, "replicate", *SITE), *map(F.col, SITE))
    return numbered.where(F.col("r") - F.col("replicate") * F.lit(n) < int(n * prop)).select("replicate", *SITE)


def jackknife_mask(dosages: DataFrame, masked: DataFrame, freq: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Dosages of every replicate, where those at masked sites are drawn from Binomial(2, freq) of the site: (replicate, sampleid, chrom, position, dosage).

    Calls meet the list of replicates that mask their site, and are unfolded into replicates after that join, so they are shuffled once and not for every replicate.
    """
    lists = masked.groupBy(*SITE).agg(F.collect_set("replicate").alias("hit")).join(freq, SITE)
    rows = dosages.join(lists, SITE, "left").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = binomial2(F.col("freq"), seed, "replicate", "chrom", "position", "sampleid")
    redrawn = F.coalesce(F.array_contains("hit", F.col("replicate")), F.lit(False)) & F.col("freq").isNotNull()
    return rows.select("replicate", "sampleid", *SITE, F.when(redrawn, draw).otherwise(F.col("dosage")).cast("int").alias("dosage"))
