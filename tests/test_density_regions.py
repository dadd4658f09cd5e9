"""Density regions worked out sample by sample are those of the long table of cells."""

import numpy as np
import pytest

from genorigin.operators import summarize


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", float(x), float(y)) for k, n in enumerate((3, 10, 40)) for x, y in rng.normal((k, 0), (1, 0.2), (n, 2))] + [("two", 1.0, 1.0), ("two", 2.0, 1.0)]
    rows += [("far", 90.0 + k % 2, 90.0 + k // 2) for k in range(4)]  # most cells have a density of 0
    return spark.createDataFrame(rows, "sampleid string, x double, y double").cache()


@pytest.mark.parametrize("n", [25, 40])
def test_regions_are_those_of_the_surface(predictions, n):
    surface = summarize.kde_surface(predictions, n).cache()
    want = {(r.sampleid, r.mass): r.level for r in summarize.hdr_levels(surface, (0.999, 0.95, 0.5, 0.1)).collect()}
    got = {(r.sampleid, r.mass): r.level for r in summarize.kde_hdr_levels(predictions, (0.999, 0.95, 0.5, 0.1), n).collect()}
    assert got.keys() == want.keys() and len(got) == 16
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-12) for k in got)
    want = {(r.sampleid, round(r.gx, 9), round(r.gy, 9)): (r.density, r.mass) for r in summarize.hdr_cumulative(surface).collect()}
    got = {(r.sampleid, round(r.gx, 9), round(r.gy, 9)): (r.density, r.mass) for r in summarize.kde_hdr_cumulative(predictions, n).collect()}
    assert got.keys() == want.keys() and len(got) == 4 * n * n and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in got)


@pytest.mark.parametrize("name", ["hdr_levels", "hdr_cumulative"])
def test_cells_are_not_shuffled(spark, sf_dir, name):
    """Between the grids and the result is no exchange, sort or window."""
    from genorigin.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not any(x in above for x in ("Exchange", "Sort", "Window")) and "Window" not in plan
