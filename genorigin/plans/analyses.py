"""Whole analyses: windows, bootstraps, jackknife, holdouts and ensembles, each one DataFrame with a key for the repeated part.

dosages: sampleid, chrom, position, dosage; samples: sampleid, x, y; weights, if given: sampleid, sample_weight. All raise a ValueError if a sample of the dosages has no
metadata, or a training sample no weight. Coordinates are normalised by all known samples in single runs, windows, bootstraps and jackknife, and by the training samples in holdouts and ensembles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genorigin.functions.keyed import binomial2, digest, uniforms
from genorigin.operators import resample, samples as S, sites
from genorigin.operators.ranks import ranked
from genorigin.shared import stored

from .models import ROLES_PREDICTED, fit_groups, fit_predict_chunks, fit_predict_groups, history, predict_overlays, predict_with, training_table
from .network import Loss, Options, loss_and_gradient
from .wide import fit_wide, predict_wide


@dataclass(frozen=True)
class Split:
    """How to spread a single network over tasks, see ``wide.fit_wide``; without one it is trained in one task, as the networks of groups are."""

    block: int = 4096
    part_rows: int = 1024
    batches: int = 1


def _one_model(table: DataFrame, options: Options, moments_from: str = "train", score=None, loss: Loss = loss_and_gradient) -> DataFrame:
    rows = table.where(F.col("role").isin("train", "val")).withColumn("run", F.lit(0))
    return stored(fit_groups(rows, ["run"], options, moments_from, score, loss), "model")


def _one(table: DataFrame, asked: list[str], options: Options, moments_from: str, score=None, loss: Loss = loss_and_gradient, split: Split | None = None) -> DataFrame:
    """Train one network and predict the rows of these roles: sampleid, role, x, y."""
    rows = table.where(F.col("role").isin(*asked)).select("sampleid", "role", "x")
    if split is None:
        return predict_with(rows.withColumn("run", F.lit(0)), _one_model(table, options, moments_from, score, loss), ["run"], options).drop("run")
    model = fit_wide(table, options, split.block, split.part_rows, split.batches, moments_from, score, loss)
    return predict_wide(rows, model, options, split.part_rows).join(rows.select("sampleid", "role"), "sampleid").select("sampleid", "role", "x", "y")


def _features(dosages: DataFrame, samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return sites.feature_assembly(S.check_sample_alignment(dosages, samples), keys)


def run_single(
    dosages: DataFrame, samples: DataFrame, options: Options = Options(), train_split: float = 0.9, seed: int = 0, weights: DataFrame | None = None, score=None, loss: Loss = loss_and_gradient,
    split: Split | None = None,
) -> DataFrame:
    """One model: predictions of unknown and validation samples: sampleid, role, x, y. score: a term of the validation loss by predicted places, such as ``ranges.range_score``; loss: the training
    loss, see ``network.Loss``; split: spread the network over tasks."""
    table = stored(training_table(_features(dosages, samples), samples, resample.train_test_split(samples, train_split, seed), weights), "table")
    return _one(table, list(ROLES_PREDICTED), options, "known", score, loss, split)


def run_windows(
    dosages: DataFrame, samples: DataFrame, size: int, start: int = 0, stop: int | None = None, step: int | None = None, options: Options = Options(), seed: int = 0, reference_stop: bool = False,
    weights: DataFrame | None = None,
) -> DataFrame:
    """One model per genome window: chrom, window_start, sampleid, role, x, y. Windows without sites are left out. With reference_stop the last window of a chromosome starts
    below its largest position, so a last site on a boundary is lost."""
    roles = resample.train_test_split(samples, seed=seed)
    S.check_sample_alignment(dosages, samples)
    cells = resample.window_assign(dosages, size, start, stop, step)
    if reference_stop and stop is None:
        last = dosages.groupBy("chrom").agg(F.max("position").alias("last"))
        cells = cells.join(last, "chrom").where("window_start < last").drop("last")
    features = sites.feature_assembly(cells, resample.WINDOW)
    return fit_predict_groups(stored(training_table(features, samples, roles, weights), "table"), resample.WINDOW, options, "known")


def bootstrap_picks(seed: int = 0) -> Callable[[tuple, int], np.ndarray]:
    """The draws of ``resample.bootstrap_sites`` for a replicate, as places in the feature vector (from 0): worked out once a replicate, in the task that trains it."""
    return lambda keys, n: np.floor(uniforms(seed, keys[0], n) * n).astype(np.int64)


def run_bootstraps(dosages: DataFrame, samples: DataFrame, replicates: int = 50, options: Options = Options(), seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """One model per replicate on sites drawn with replacement, with the same split: replicate, sampleid, role, x, y. Vectors are stored once; each replicate's task picks its sites from them."""
    table = stored(training_table(_features(dosages, samples), samples, resample.train_test_split(samples, seed=seed), weights), "table")
    every = table.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return fit_predict_groups(every, ["replicate"], options, "known", picks=bootstrap_picks(seed))


def run_jackknife(
    dosages: DataFrame, samples: DataFrame, n_replicates: int = 50, prop: float = 0.05, options: Options = Options(), seed: int = 0, weights: DataFrame | None = None
) -> DataFrame:
    """One model, and predictions with a part of the sites redrawn in each replicate: replicate, sampleid, x, y (unknown samples)."""
    table = stored(training_table(_features(dosages, samples), samples, resample.train_test_split(samples, seed=seed), weights), "table")
    model = _one_model(table, options, "known")
    return _jackknife_predict(table.where("role = 'pred'"), dosages, sites.allele_freq_all(dosages), model, n_replicates, prop, options, seed)


def jackknife_changes(asked: DataFrame, dosages: DataFrame, freq: DataFrame, replicates: int, prop: float = 0.05, seed: int = 0) -> DataFrame:
    """A replicate as what it changes, as ``resample.jackknife_mask`` draws it: (replicate, places), the masked sites of each replicate by their number, and (replicate, sampleid, draws), the new
    dosages of each sample there. For ``models.predict_overlays``."""
    index = stored(sites.site_index(dosages.select("chrom", "position")), "sites")
    masked = resample.jackknife_sites(index.select("chrom", "position"), replicates, prop, seed).join(freq, sites.SITE).join(index, sites.SITE)
    lists = masked.groupBy("replicate").agg(F.array_sort(F.collect_list(F.struct("site", "chrom", "position", "freq"))).alias("masked"))
    none = F.array().cast(lists.schema["masked"].dataType)
    every = dosages.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    lists = stored(every.join(lists, "replicate", "left").select("replicate", F.coalesce("masked", none).alias("masked")), "masked")
    rows = asked.select("sampleid", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).join(lists, "replicate")
    draws = F.transform("masked", lambda m: binomial2(m["freq"], seed, F.col("replicate"), m["chrom"], m["position"], F.col("sampleid")).cast("tinyint"))
    places = lists.select("replicate", F.transform("masked", lambda m: m["site"].cast("int")).alias("places"))
    return places.unionByName(rows.select("replicate", "sampleid", draws.alias("draws")), allowMissingColumns=True)


def _jackknife_predict(asked: DataFrame, dosages: DataFrame, freq: DataFrame, model: DataFrame, replicates: int, prop: float, options: Options, seed: int) -> DataFrame:
    changes = stored(jackknife_changes(asked, dosages, freq, replicates, prop, seed), "changes")
    return predict_overlays(asked, changes, model, options)


def train_holdout(
    dosages: DataFrame, samples: DataFrame, k: int = 10, options: Options = Options(), seed: int = 0, ids: list[str] | None = None, weights: DataFrame | None = None,
    split: Split | None = None,
) -> DataFrame:
    """Train without k known samples and predict them: sampleid, x, y (true), x_pred, y_pred."""
    table = stored(training_table(_features(dosages, samples), samples, resample.holdout_split(samples, k, seed=seed, ids=ids), weights), "table")
    found = _one(table, ["holdout"], options, "train", split=split)
    return found.select("sampleid", F.col("x").alias("x_pred"), F.col("y").alias("y_pred")).join(samples.select("sampleid", "x", "y"), "sampleid")


def holdout_roles(samples: DataFrame, k: int, seed: int = 0, train_split: float = 0.9) -> DataFrame:
    """For every chunk of k known samples the roles of all known samples: (holdout_id, sampleid, role). Of the others round-half-even((1 - train_split) n) are val, drawn for
    each chunk. All chunks are ranked at once, as each has all known samples."""
    chunks = stored(resample.systematic_holdouts(samples, k), "chunks")
    n = chunks.count()
    pairs = chunks.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // k) - 1)))))
    own = F.col("holdout_id") == F.col("h")
    numbered = ranked(pairs, F.col("h"), F.when(own, 0).otherwise(1), digest(seed, "h", "sampleid"), F.col("sampleid"))
    size = F.least(F.lit(k), F.lit(n) - F.col("h") * k)
    place = F.col("r") - F.col("h") * F.lit(n) - size  # among the others
    val = F.bround((1 - F.lit(float(train_split))) * (F.lit(n) - size), 0)
    return numbered.select(F.col("h").alias("holdout_id"), "sampleid", F.when(own, "holdout").when(place < val, "val").otherwise("train").alias("role"))


def _chunked(features: DataFrame, samples: DataFrame, k: int, weights: DataFrame | None) -> DataFrame:
    """Features of known samples with coordinates, weight and chunk. A ValueError if a known sample has no weight: each trains the models of other chunks."""
    chunks = resample.systematic_holdouts(samples, k).withColumn("role", F.lit("train"))
    return training_table(features, samples, chunks, weights).drop("role")


def run_holdouts(dosages: DataFrame, samples: DataFrame, k: int = 10, options: Options = Options(), seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """Every known sample predicted once, by a model trained without its chunk of k: holdout_id, sampleid, x, y. Roles are those of ``holdout_roles``."""
    return fit_predict_chunks(stored(_chunked(_features(dosages, samples), samples, k, weights), "table"), [], options, seed)


def run_jackknife_holdouts(
    dosages: DataFrame, samples: DataFrame, k: int = 10, n_replicates: int = 100, prop: float = 0.05, options: Options = Options(), seed: int = 0, weights: DataFrame | None = None
) -> DataFrame:
    """One model without k known samples, and their predictions under each jackknife replicate; frequencies are those of the training samples."""
    roles = stored(resample.holdout_split(samples, k, seed=seed), "roles")
    table = stored(training_table(_features(dosages, samples), samples, roles, weights), "table")
    freq = sites.allele_freq_train(dosages, roles)
    return _jackknife_predict(table.where("role = 'holdout'"), dosages, freq, _one_model(table, options), n_replicates, prop, options, seed)


def run_windows_holdouts(
    dosages: DataFrame, samples: DataFrame, size: int, k: int = 10, step: int | None = None, options: Options = Options(), seed: int = 0, weights: DataFrame | None = None
) -> DataFrame:
    """A model per window and chunk of held-out samples: chrom, window_start, holdout_id, sampleid, x, y. Vectors are stored once; roles are those of ``holdout_roles``."""
    S.check_sample_alignment(dosages, samples)
    features = sites.feature_assembly(resample.window_assign(dosages, size, step=step), resample.WINDOW)
    return fit_predict_chunks(stored(_chunked(features, samples, k, weights), "table"), resample.WINDOW, options, seed)


def _fold_table(dosages: DataFrame, samples: DataFrame, k: int, seed: int, weights: DataFrame | None) -> DataFrame:
    roles = resample.fold_roles(resample.kfold_split(samples, k, seed), samples, k)
    return training_table(_features(dosages, samples), samples, roles, weights)


def ensemble(dosages: DataFrame, samples: DataFrame, k: int = 5, options: Options = Options(), seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """A model per fold: predictions of unknown samples by all, of known ones by the model of their own fold: fold, sampleid, role, x, y."""
    return fit_predict_groups(stored(_fold_table(dosages, samples, k, seed, weights), "table"), ["fold"], options)


def ensemble_pred_only(dosages: DataFrame, samples: DataFrame, k: int = 5, options: Options = Options(), seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """The mean over the models of all folds of the predictions of unknown samples: sampleid, x, y."""
    found = ensemble(dosages, samples, k, options, seed, weights).where("role = 'pred'")
    return found.groupBy("sampleid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def ensemble_history(dosages: DataFrame, samples: DataFrame, k: int = 5, options: Options = Options(), seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    return history(fit_groups(_fold_table(dosages, samples, k, seed, weights).where(F.col("role").isin("train", "val")), ["fold"], options), ["fold"])


#: The analyses by name, and the names under which their predictions are written.
ANALYSES = {
    "single": run_single, "windows": run_windows, "bootstrap": run_bootstraps, "jackknife": run_jackknife, "holdout": train_holdout, "all_holdouts": run_holdouts, "ensemble": ensemble,
    "ensemble_pred_only": ensemble_pred_only,
}


def from_calls(calls: DataFrame, samples: DataFrame, analysis: str = "single", min_mac: int = 2, max_snps: int | None = None, impute: bool = False, seed: int = 0, **options) -> DataFrame:
    """From calls to predictions: sites are filtered, drawn and imputed once, then the analysis of that name runs on their dosages with the other options."""
    if analysis not in ANALYSES:
        raise ValueError(f"Unknown analysis {analysis!r}; there are {sorted(ANALYSES)}")
    S.check_sample_alignment(calls, samples)
    dosages = stored(sites.filter_snps(calls, min_mac, max_snps, impute, seed), "dosages")
    return ANALYSES[analysis](dosages, samples, seed=seed, **options)
