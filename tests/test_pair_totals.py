"""Pairs are added up where their blocks meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genorigin.operators import weights


@pytest.mark.parametrize("most", [1 << 16, 1024])
def test_totals_are_those_of_the_pairs(spark, most):
    """In one block and in three, with a repeated id and points on one place."""
    xy = np.random.default_rng(3).normal(0, 20, (2500, 2))
    xy[:40] = xy[0]
    points = spark.createDataFrame([(f"s{max(k, 5)}", float(x), float(y)) for k, (x, y) in enumerate(xy)], "sampleid string, x double, y double")
    want = {r.sampleid: (r.pairs, r.total) for r in weights.kde_pairs(points).groupBy("sampleid").agg(F.count(F.lit(1)).alias("pairs"), F.sum("d2").alias("total")).collect()}
    found = weights.kde_pair_totals(points, most)
    got = {r.sampleid: (r.pairs, r.total) for r in found.collect()}
    assert got.keys() == want.keys() and got["s5"][0] == 6 * 2500
    assert all(got[k][0] == want[k][0] and abs(got[k][1] / want[k][1] - 1) < 1e-12 for k in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan


def test_no_points(spark):
    assert weights.kde_pair_totals(spark.createDataFrame([], "sampleid string, x double, y double")).count() == 0
