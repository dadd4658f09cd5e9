"""Command line: ``python -m genorigin --vcf calls.vcf.gz --samples samples.txt --out out/run``, or by spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from genorigin.operators.weights import first_weight
from genorigin.plans.analyses import ANALYSES, Split, from_calls
from genorigin.plans.network import Options
from genorigin.shared import ship, stored
from genorigin.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="genorigin", description="Predict where samples come from by their genotypes.")
    source = p.add_mutually_exclusive_group(required=True)
    for name in ("vcf", "matrix", "lake"):
        source.add_argument(f"--{name}")
    p.add_argument("--samples", required=True, help="sampleID, x, y; NA where unknown")
    p.add_argument("--weights", help="sampleID, sample_weight of the training samples")
    p.add_argument("--out", required=True, help="what the names of the files written begin with")
    p.add_argument("--analysis", choices=sorted(ANALYSES), default="single")
    p.add_argument("--min-mac", type=int, default=2)
    p.add_argument("--max-snps", type=int)
    p.add_argument("--impute", action="store_true")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--window-size", type=int, default=500_000)
    p.add_argument("--window-start", type=int, default=0)
    p.add_argument("--window-stop", type=int)
    p.add_argument("--window-step", type=int, help="by default the size, so that windows do not overlap")
    p.add_argument("--train-split", type=float, default=0.9, help="share of the known samples that train a single model")
    p.add_argument("--jackknife-prop", type=float, default=0.05, help="share of the sites that a jackknife replicate redraws")
    p.add_argument("--split-block", type=int, help="spread a single model over tasks, by blocks of so many sites")
    p.add_argument("--keep-bootstraps", action="store_true", help="a file for each bootstrap replicate as well")
    p.add_argument("--replicates", type=int, default=50)
    p.add_argument("--k", type=int, default=10, help="samples of a holdout, or folds")
    defaults = Options()
    for name in ("width", "layers", "batch", "epochs", "patience"):
        p.add_argument(f"--{name}", type=int, default=getattr(defaults, name))
    p.add_argument("--dropout", type=float, default=defaults.dropout)
    return p


def run(spark: SparkSession, arguments: list[str] | None = None) -> str:
    """Run an analysis and write its predictions; returns their path."""
    a = parser().parse_args(arguments)
    calls = io.load_genotypes(spark, vcf=a.vcf, matrix=a.matrix, lake=a.lake)
    samples = io.scan_sample_data(spark, a.samples)
    network = Options(width=a.width, layers=a.layers, batch=a.batch, epochs=a.epochs, patience=a.patience, dropout=a.dropout, seed=a.seed)
    windows = {"size": a.window_size, "start": a.window_start, "stop": a.window_stop, "step": a.window_step}
    extra = {
        "single": {"train_split": a.train_split}, "windows": windows, "bootstrap": {"replicates": a.replicates}, "jackknife": {"n_replicates": a.replicates, "prop": a.jackknife_prop},
    }.get(a.analysis, {})
    if a.split_block and a.analysis in ("single", "holdout"):
        extra["split"] = Split(a.split_block)
    if a.analysis in ("holdout", "all_holdouts", "ensemble", "ensemble_pred_only"):
        extra["k"] = a.k
    if a.weights:
        extra["weights"] = first_weight(io.scan_sample_weights(spark, a.weights))
    found = from_calls(calls, samples, a.analysis, a.min_mac, a.max_snps, a.impute, a.seed, options=network, **extra)
    if a.analysis == "bootstrap" and a.keep_bootstraps:
        found = stored(found, "bootstraps")
        io.sink_bootstraps(found, a.out)
    return io.sink_predictions(found, a.out, a.analysis)


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    ship(session)
    print(run(session))
