"""Kernel sums against all pairs."""

import numpy as np
import pytest

from genorigin.operators import weights
from genorigin.operators.kernel_sums import kernel_sums


def table(spark, xy):
    return spark.createDataFrame([(f"s{k}", float(x), float(y)) for k, (x, y) in enumerate(xy)], "sampleid string, x double, y double")


@pytest.mark.parametrize("h", [0.3, 2.0, 50.0])
def test_sums_are_those_of_all_pairs(spark, h):
    """5,000 points: clusters, many on one place, negative coordinates, points far from all others."""
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(0, 8, (2500, 2)), rng.normal((30, -20), 0.4, (1490, 2)), np.full((1000, 2), 3.25), rng.uniform(-4000, 4000, (10, 2))])
    got = {r.sampleid: r.total for r in kernel_sums(table(spark, xy), h).collect()}
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    want = np.exp(-d2 / (2 * h * h)).sum(axis=1)
    assert len(got) == 5000
    assert max(abs(got[f"s{k}"] - want[k]) / want[k] for k in range(5000)) < 1e-9


def test_no_cross_join_of_points(spark):
    p = table(spark, np.random.default_rng(1).normal(size=(50, 2)))
    for df in (weights.kde_pairs(p), kernel_sums(p, 1.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scores_in_blocks(spark):
    """Blocks of any size give the scores of all pairs, for tiny bandwidths too."""
    xy = np.random.default_rng(4).uniform(0, 30, (83, 2))
    xy[:5] = xy[5]
    ids = sorted(range(83), key=lambda k: f"s{k}")
    sizes = [17, 17, 17, 16, 16]
    fold = np.empty(83, int)
    fold[ids] = np.repeat(range(5), sizes)
    grid = np.linspace(0.1, 10, 7)
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    want = np.zeros(7)
    for k in range(83):
        v = d2[k, fold != fold[k]]
        e = -v[:, None] / (2 * grid**2)
        want += np.log(np.exp(e - e.max(axis=0)).sum(axis=0)) + e.max(axis=0) - np.log(len(v) * 2 * np.pi * grid**2)
    for size in (1000, 20):
        got = weights.bandwidth_scores(table(spark, xy), steps=7, size=size).orderBy("bandwidth").collect()
        assert np.allclose([r.score for r in got], want, rtol=1e-12) and np.allclose([r.bandwidth for r in got], grid)
