"""Holdouts and groups are trained from rows that are held once, with no table of samples by chunks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from genorigin.operators import resample, sites
from genorigin.plans import analyses, fixtures, models, network
from genorigin.plans.network import Options

QUICK = Options(width=8, layers=1, epochs=3, patience=2, batch=64, rate=3e-3)


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return fixtures.samples(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def dosages(spark, sf_dir):
    return sites.to_dosage(fixtures.calls_cline(spark, sf_dir)).where("position <= 64000").cache()


def test_roles_in_the_task_are_those_of_the_table(spark, samples):
    roles = {}
    for r in analyses.holdout_roles(samples, 40, 3).collect():
        roles.setdefault(r.holdout_id, {})[r.sampleid] = r.role
    assert len(roles) == 12
    for chunk, own in roles.items():
        ids = sorted(own)
        held = np.array([own[i] == "holdout" for i in ids])
        assert models.split_roles(ids, held, chunk, 3, 0.9).tolist() == [own[i] == "val" for i in ids]


@pytest.mark.parametrize("windows", [False, True])
def test_chunks_are_models_of_groups(spark, dosages, samples, windows):
    """The predictions are those of a model for each chunk, trained as a group of a table of samples by chunks."""
    keys = resample.WINDOW if windows else []
    cells = resample.window_assign(dosages, 32_000) if windows else dosages
    table = models.training_table(sites.feature_assembly(cells, keys), samples, analyses.holdout_roles(samples, 100))
    want = {tuple(r[:-2]): r[-2:] for r in models.fit_predict_groups(table, [*keys, "holdout_id"], QUICK).where("role = 'holdout'").drop("role").collect()}
    got = analyses.run_windows_holdouts(dosages, samples, 32_000, 100, options=QUICK) if windows else analyses.run_holdouts(dosages, samples, 100, QUICK)
    assert got.columns == [*keys, "holdout_id", "sampleid", "x", "y"]
    got = {tuple(r[:-2]): r[-2:] for r in got.collect()}
    assert got.keys() == want.keys() and len(got) == (3 if windows else 1) * 450
    assert all(np.allclose(got[k], want[k], atol=1e-3) for k in got)


def test_no_table_of_samples_by_chunks(spark, dosages, samples):
    """What holdouts store grows with the samples, not with the chunks."""
    sizes = []
    for k in (225, 15):
        spark.sparkContext._genorigin_stored = []
        analyses.run_holdouts(dosages, samples, k, QUICK)
        folders = [p.removeprefix("file:") for p in spark.sparkContext._genorigin_stored]
        sizes.append(sum(spark.read.parquet(p).count() for p in folders if os.path.isdir(p.replace("///", "/", 1))))
    assert 0 < sizes[1] < sizes[0] + 200


def test_scale_in_pieces():
    x = np.random.default_rng(1).integers(0, 3, (20_000, 7)).astype(np.int8)
    x[:, 2] = 1
    mean, spread = network.input_scale(x)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(spread, np.sqrt(x.var(axis=0, dtype=float) + 1e-3))


def test_jobs_in_one_partition(spark, samples, dosages):
    """Rows of a job come sorted by sample to a task that holds them once; groups of rows of no training samples are an error, weights that are null count as 0."""
    table = models.training_table(sites.feature_assembly(dosages), samples, resample.train_test_split(samples)).where("role <> 'pred'")
    two = table.withColumn("run", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit(None)))).withColumn("weight", F.when(F.col("sampleid") != "s1", F.col("weight")))
    found = models.fit_groups(two, ["run"], QUICK)
    rows = found.collect()
    assert sorted(r.run or "" for r in rows) == ["", "a", "b"] and len({r.model for r in rows}) == 1
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="no training samples"):
        models.fit_groups(two.where("role = 'val'"), ["run"], QUICK).collect()
