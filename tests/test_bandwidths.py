"""The bandwidth search by grids and near pairs against all pairs."""

import numpy as np
import pytest

from genorigin.operators import bandwidths, weights
from genorigin.operators.bandwidths import Nodes


def table(spark, xy):
    return spark.createDataFrame([(f"s{k:05}", float(x), float(y)) for k, (x, y) in enumerate(xy)], "sampleid string, x double, y double")


def all_pairs(xy, grid, folds=5):
    n = len(xy)
    fold = np.repeat(range(folds), [n // folds + (f < n % folds) for f in range(folds)])
    want = np.zeros(len(grid))
    for k in range(n):
        d2 = ((xy[fold != fold[k]] - xy[k]) ** 2).sum(axis=1)
        near = d2.min()
        want += np.log(np.exp((near - d2)[:, None] / (2 * grid**2)).sum(axis=0)) - near / (2 * grid**2) - np.log(len(d2) * 2 * np.pi * grid**2)
    return want


def test_few_nodes_give_every_bandwidth():
    """About 130 sums of a point, however far apart the others are, give those at 1,000 bandwidths."""
    nodes = Nodes(0.1, 10.0, 1000, 100_000)
    assert len(nodes.h) < 140 and nodes.levels()[0][1] == 0 and nodes.levels()[-1][2] == len(nodes.h)
    for d2 in (np.zeros(3), np.r_[0, np.random.default_rng(1).exponential(300, 5000)], np.r_[0, np.geomspace(1e-6, 1e5, 3000)], np.r_[0, np.full(4000, 0.3)]):
        at = lambda h: np.exp(-d2[:, None] / (2 * h**2)).sum(axis=0)  # noqa: B023, E731
        assert np.allclose(at(nodes.h) @ nodes.turn, at(nodes.grid), rtol=1e-10, atol=0)
    assert np.array_equal(Nodes(0.1, 10.0, 7, 83).h, np.linspace(0.1, 10, 7))


@pytest.mark.parametrize("dense", [8, 10**9])
def test_scores_are_those_of_all_pairs(spark, monkeypatch, dense):
    """Clusters, many on one place, points far from all others and negative coordinates; with grids where it is dense, and nowhere."""
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal((-20, 15), 6, (700, 2)), rng.normal((30, -20), 0.3, (450, 2)), np.full((60, 2), 3.25), rng.uniform(-900, 900, (8, 2))])
    xy = xy[rng.permutation(len(xy))]
    monkeypatch.setattr(bandwidths, "DENSE", dense)
    seen, by_pairs = [], bandwidths._by_pairs

    def watched(told, *rest):
        seen.extend(told.select("first").toPandas()["first"])
        return by_pairs(told, *rest)

    monkeypatch.setattr(bandwidths, "_by_pairs", watched)
    got = weights.bandwidth_scores(table(spark, xy), steps=200, size=500).orderBy("bandwidth").collect()
    grid = np.linspace(0.1, 10, 200)
    assert np.allclose([r.bandwidth for r in got], grid) and np.allclose([r.score for r in got], all_pairs(xy, grid), rtol=1e-9)
    nodes = len(Nodes(0.1, 10.0, 200, len(xy)).h)
    assert nodes < 140 and len(seen) == len(xy)
    assert (min(seen) == nodes) if dense > 32 else (min(seen) < nodes)


def test_points_without_others(spark):
    for n in (0, 1):
        assert weights.bandwidth_scores(table(spark, np.zeros((n, 2))), steps=5).count() == 0
    assert weights.bandwidth_scores(table(spark, np.zeros((2, 2))), steps=5).count() == 5
