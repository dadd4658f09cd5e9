"""Order statistics, rasters and peaks against plain computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genorigin.operators import ranges, summarize
from genorigin.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0]


@pytest.mark.parametrize("kind", ["even", "ties", "one value", "tail"])
def test_quantiles_in_passes(spark, kind):
    """With few values held, brackets narrow over several passes; the result is that of all values at once."""
    rng = np.random.default_rng(5)
    made = {"even": rng.normal(size=30_000), "ties": rng.integers(0, 4, 30_000).astype(float), "one value": np.full(5000, 2.5), "tail": np.concatenate([np.zeros(29_000), rng.exponential(size=1000) ** 8])}
    v = made[kind]
    df = spark.createDataFrame([(float(x),) for x in v], "v double").union(spark.createDataFrame([(None,)] * 3, "v double"))
    got = exact_quantiles(df, "v", SHARES, few=50).first()
    assert got.n == len(v) and np.allclose(got.q, np.quantile(v, SHARES), rtol=1e-12, atol=0)


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(x)) for k, n in ((None, 700), ("a", 1), ("b", 2), ("c", 4000)) for x in rng.normal(size=n)] + [("d", None)]
    got = {r.k: r.q for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", [0.05, 0.5, 0.99], ["k"], few=100).collect()}
    assert got.keys() == {None, "a", "b", "c"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([x for name, x in rows if name == k], [0.05, 0.5, 0.99]))
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0
    empty = spark.createDataFrame([], "err double, x double, x_true double, y double, y_true double")
    assert summarize.error_summary(empty).first().n == 0 and summarize.error_quantiles(empty).first().q95 is None


def inside(rings, px, py):
    odd = set()
    for poly in {r[0] for r in rings}:
        n = 0
        for ring in {r[1] for r in rings if r[0] == poly}:
            p = [r[3:] for r in sorted(r for r in rings if r[:2] == (poly, ring))]
            for (x, y), (x2, y2) in zip(p, p[1:] + p[:1]):
                n += (y > py) != (y2 > py) and px < (x2 - x) * (py - y) / (y2 - y) + x
        odd.add(n % 2)
    return float(1 in odd)


def test_raster_by_scanlines(spark):
    """Polygons with holes, overlaps, slivers, crossings on cell centres, rings of one and two points."""
    rng = random.Random(8)
    rings = [(p, 0, k, rng.uniform(0, 20), rng.uniform(0, 12)) for p in range(4) for k in range(7)]
    rings += [(0, 1, k, x, y) for k, (x, y) in enumerate([(5.0, 5.0), (8.0, 5.0), (8.0, 9.0), (5.0, 9.0)])]
    rings += [(5, 0, 0, 1.0, 1.0), (6, 0, 0, 2.0, 1.0), (6, 0, 1, 3.0, 11.0), (7, 0, 0, 0.0, 0.0), (7, 0, 1, 20.0, 0.0), (7, 0, 2, 20.0, 12.0), (8, 0, 0, 2.5, 0.0), (8, 0, 1, 2.5, 12.0), (8, 0, 2, 7.25, 6.0)]
    df = spark.createDataFrame(rings, "poly int, ring int, seq int, x double, y double")
    for resolution in (0.5, 1.0, 0.77):
        raster = ranges.rasterize_range(df, resolution)
        rows = raster.collect()
        assert len(rows) == int(20 / resolution) * int(12 / resolution) == len({(r.row, r.col) for r in rows})
        for r in rows:
            assert r.valid == inside(rings, (r.col + 0.5) * resolution, 12 - (r.row + 0.5) * resolution), r
        plan = raster._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        assert "CartesianProduct" not in final and final.count("NestedLoop") <= 1  # with one row: the box


def test_peak_is_that_of_the_whole_grid():
    rng = np.random.default_rng(9)
    for case in range(60):
        n = int(rng.integers(1, 40))
        px, py = rng.normal(size=n), rng.normal(size=n) * rng.choice([0.1, 1, 5])
        if case % 5 == 0:
            px, py = np.round(px), np.round(py)
        hx, hy = rng.uniform(0.05, 1.5, 2)
        gx, gy = np.linspace(px.min(), px.max(), int(rng.integers(1, 70))), np.linspace(py.min(), py.max(), int(rng.integers(1, 70)))
        kx, ky = (np.exp(-0.5 * ((g[:, None] - p) / h) ** 2) for g, p, h in ((gx, px, hx), (gy, py, hy)))
        best = np.round(kx @ ky.T, 9).argmax()
        assert summarize.peak_cell(px, py, gx, gy, hx, hy) == (best // len(gy), best % len(gy))


def test_surfaces_are_dealt(spark):
    """Rows of the grid are pieces of work in several tasks, and together the grid."""
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(f"s{k % 3}", float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(60, 2)))], "sampleid string, x double, y double")
    surface = summarize.kde_surface(p, 23)
    assert surface.rdd.getNumPartitions() >= 8
    assert surface.groupBy("sampleid").count().where("count = 529").count() == 3
    assert surface.select("sampleid", F.round("gx", 9), F.round("gy", 9)).distinct().count() == 3 * 529
