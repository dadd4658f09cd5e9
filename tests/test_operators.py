"""Properties of splits, resampling, weights, densities, distances and ranges."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genorigin.functions import geo, keyed
from genorigin.operators import ranges, resample, samples as S, sites, summarize, weights
from genorigin.plans import fixtures


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return fixtures.samples(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def dosages(spark, sf_dir):
    return sites.to_dosage(fixtures.calls_cline(spark, sf_dir)).cache()


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(keyed.uniform(3, "id").alias("u"), "id")
    a, b = (sorted(map(tuple, r.collect())) for r in (rows, spark.range(0, 1000, 1, 7).select(keyed.uniform(3, "id"), "id")))
    assert a == b and 0.45 < np.mean([u for u, _ in a]) < 0.55
    b2 = spark.range(4000).agg(F.avg(keyed.binomial2(F.lit(0.3), 1, "id"))).first()[0]
    assert 0.55 < b2 < 0.65


def test_roles(samples):
    n = Counter(r.role for r in resample.train_test_split(samples).collect())
    assert n == {"val": 45, "train": 405, "pred": 50}
    both = resample.phased_split(samples, cv=True).collect()
    assert len(both) == 1000 and all(r.predicted == (r.role != "train") for r in both)
    assert len({(r.sampleid[:-3], r.role) for r in both}) == 500


def test_holdouts(samples, spark):
    n = Counter(r.role for r in resample.holdout_split(samples, 20).collect())
    assert n == {"holdout": 20, "val": 43, "train": 387, "pred": 50}
    given = resample.holdout_split(samples, ids=["s1", "s2"]).where("role = 'holdout'").collect()
    assert {r.sampleid for r in given} == {"s1", "s2"}
    with pytest.raises(ValueError, match="not among"):
        resample.holdout_split(samples, ids=["s0"])
    with pytest.raises(ValueError, match="Cannot hold out"):
        resample.holdout_split(samples, 450)
    chunks = resample.systematic_holdouts(samples, 20).collect()
    sizes = Counter(r.holdout_id for r in chunks)
    assert len(chunks) == len({r.sampleid for r in chunks}) == 450 and sizes[22] == 10 and set(sizes.values()) == {20, 10}


def test_folds(samples, spark):
    folds = resample.kfold_split(samples, 4)
    assert Counter(r.fold for r in folds.collect()) == {0: 112, 1: 112, 2: 112, 3: 114}
    roles = Counter((r.fold, r.role) for r in resample.fold_roles(folds, samples, 4).collect())
    assert roles[3, "val"] == 114 and roles[0, "pred"] == 50 and roles[0, "train"] == 338
    with pytest.raises(ValueError, match="Fewer"):
        resample.kfold_split(samples.limit(3), 5)
    with pytest.raises(ValueError, match="without metadata"):
        resample.kfold_split(samples, 2, training_ids=spark.createDataFrame([("nobody",)], ["sampleid"]))


def test_windows(spark):
    s = spark.createDataFrame([("1", p) for p in (0, 99, 100, 250, 300)], ["chrom", "position"])
    got = Counter((r.position, r.window_start) for r in resample.window_assign(s, 100).collect())
    assert got == Counter([(0, 0), (99, 0), (100, 100), (250, 200), (300, 300)])
    assert (300, 300) not in {(r.position, r.window_start) for r in resample.window_assign(s, 100, stop=300).collect()}
    sliding = {(r.position, r.window_start) for r in resample.window_assign(s, 100, step=50).collect()}
    assert sliding == {(0, 0), (99, 0), (99, 50), (100, 50), (100, 100), (250, 200), (250, 250), (300, 250), (300, 300)}
    assert {r.window_start: r.n_sites for r in resample.sites_per_window(s, 100).collect()} == {0: 2, 100: 1, 200: 1, 300: 1}
    assert resample.window_starts(0, 300, 100) == [0, 100, 200]


def test_bootstrap_and_jackknife(spark, dosages):
    all_sites = dosages.select("chrom", "position").distinct()
    indexed = sites.site_index(all_sites)
    draws = resample.bootstrap_sites(indexed, 512, 3)
    assert [r["count"] for r in draws.groupBy("replicate").count().collect()] == [512] * 3
    masked = resample.jackknife_sites(all_sites, 3)
    assert {r["count"] for r in masked.groupBy("replicate").count().collect()} == {int(512 * 0.05)}
    drawn = resample.jackknife_mask(dosages, masked, sites.allele_freq_all(dosages), 3)
    rest = drawn.join(masked, ["replicate", "chrom", "position"], "left_anti").join(dosages.withColumnRenamed("dosage", "was"), ["sampleid", "chrom", "position"])
    assert rest.where("dosage <> was").count() == 0 and drawn.count() == 3 * dosages.count()


def test_sites(spark):
    rows = [("a", 0, 0, 1), ("b", 0, 1, 1), ("c", 0, -1, -1), ("a", 1, 0, 0), ("b", 1, 0, 0), ("c", 1, 0, 0), ("a", 2, 0, 1), ("b", 2, 2, 2), ("c", 2, 0, 0)]
    calls = spark.createDataFrame([(s, "1", p, [x, y]) for s, p, x, y in rows], "sampleid string, chrom string, position long, alleles array<tinyint>")
    counts = {r.position: (r.n0, r.n1, r.n2) for r in sites.allele_counts(calls).collect()}
    assert counts == {0: (1, 3, 0), 1: (6, 0, 0), 2: (3, 1, 2)}
    long = {(r.position, r.allele): r.n for r in sites.allele_counts_long(calls).collect()}
    assert long == {(0, 0): 1, (0, 1): 3, (1, 0): 6, (2, 0): 3, (2, 1): 1, (2, 2): 2}
    kept = {(r.sampleid, r.position): r.dosage for r in sites.filter_snps(calls).collect()}
    assert kept == {("a", 0): 1, ("b", 0): 2, ("c", 0): 0}
    assert sites.filter_snps(calls, min_mac=2, folded=True).count() == 0 and sites.filter_snps(calls, min_mac=3).count() == 3
    imputed = {(r.sampleid, r.position): r.dosage for r in sites.filter_snps(calls, impute=True).collect()}
    assert imputed["a", 0] == 1 and imputed["b", 0] == 2 and imputed["c", 0] in (0, 1, 2)
    with pytest.raises(ValueError, match="Cannot draw"):
        sites.cap_snps(calls.select("chrom", "position").distinct(), 4)
    x = {r.sampleid: list(r.x) for r in sites.feature_assembly(sites.to_dosage(calls)).collect()}
    assert x == {"a": [1, 0, 1], "b": [2, 0, 0], "c": [0, 0, 0]}


def test_coordinates(spark, samples):
    back = S.denormalize_coords(S.normalize_coords(samples), S.coord_moments(samples)).join(samples.selectExpr("sampleid", "x as x0"), "sampleid")
    assert back.where("abs(x - x0) > 1e-9 or (x is null) <> (x0 is null)").count() == 0
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, None)], "sampleid string, x double, y double")
    assert {r.x for r in S.normalize_coords(flat).collect()} == {None}
    assert S.pick_samples(samples, 3).count() == 3 and S.pick_samples(samples, ids=["s1", "nobody"]).count() == 1


def test_histogram_weights(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 10.0, 10.0), ("d", 5.0, 5.0)], "sampleid string, x double, y double")
    w = {r.sampleid: r.sample_weight for r in weights.hist2d_weights(points).collect()}
    assert w == {"a": 1.0, "b": 1.0, "c": 2.0, "d": 2.0}
    assert {r.xbin for r in weights.hist2d_bins(points.where("sampleid in ('a', 'b')")).collect()} == {0}


def test_kde_weights(samples):
    known = S.known_filter(samples)
    w = [r.sample_weight for r in weights.weight_samples(known, "KD", bandwidth=1.0, lam=0.5).collect()]
    assert math.isclose(sum(w), 1) and min(w) > 0
    with pytest.raises(ValueError, match="Unknown"):
        weights.weight_samples(known, "df")
    h = weights.bandwidth_argmax(weights.bandwidth_scores(known, steps=50))
    assert 0.1 <= h <= 10


def test_loaded_weights(spark):
    points = spark.createDataFrame([("a",), ("b",)], ["sampleid"])
    given = spark.createDataFrame([("a", 2.0, 1), ("a", 1.0, 2), ("b", 3.0, 3)], ["sampleid", "sample_weight", "ord"])
    got = {r.sampleid: r.sample_weight for r in weights.weight_samples(points, "load", given, order="ord").collect()}
    assert got == {"a": 2.0, "b": 3.0}
    with pytest.raises(ValueError, match="no weight"):
        weights.join_weights(points, given.where("sampleid = 'a'"))


def test_distances(spark):
    pairs = [(48 + 50 / 60 + 11 / 3600, 2 + 20 / 60 + 14 / 3600, 38 + 55 / 60 + 17 / 3600, -77 - 3 / 60 - 56 / 3600), (0.0, 0.0, 0.0, 90.0), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.5, 179.7), (0.0, 0.0, 90.0, 0.0), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double, c double, d double")
    got = {r.i: r.km for r in geo.with_geodesic_km(df, "a", "b", "c", "d").collect()}
    assert abs(got[0] - 6181.63) < 0.01 and abs(got[1] - 10018.754) < 0.001 and got[2] == 0 and got[5] is None
    assert abs(got[3] - 19944.127) < 0.01 and abs(got[4] - 10001.966) < 0.001
    circle = {r.i: r.km for r in df.select("i", geo.great_circle_km(F.col("b"), F.col("a"), F.col("d"), F.col("c")).alias("km")).collect()}
    assert abs(circle[0] - got[0]) < 0.02 and circle[2] == 0


def test_surfaces(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)))] + [("flat", i, 1.0, float(i)) for i in range(5)]
    pred = spark.createDataFrame(rows, ["sampleid", "replicate", "x", "y"])
    surface = summarize.kde_surface(pred, 40).cache()
    box = S.map_extent(pred).first()
    cell = (box.xmax - box.xmin) * (box.ymax - box.ymin) / 39**2
    mass = surface.groupBy("sampleid").agg(F.sum("density").alias("d")).collect()
    assert [r.sampleid for r in mass] == ["a"] and abs(mass[0].d * cell - 1) < 0.05
    peak = {r.sampleid: (r.x, r.y) for r in summarize.kde_peak(pred, 40).collect()}
    assert math.hypot(*peak["a"]) < 0.8 and peak["flat"] == (1.0, 2.0)
    levels = {r.mass: r.level for r in summarize.hdr_levels(surface).collect()}
    assert levels[0.95] < levels[0.5] < levels[0.1]
    with pytest.raises(ValueError, match="Grids"):
        summarize.kde_surface(pred, 0)
    with pytest.raises(ValueError, match="nothing"):
        summarize.require_rows(pred.limit(0), "nothing")


def test_range(spark):
    square = [(0, 0, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)])]
    hole = [(0, 1, k, x, y) for k, (x, y) in enumerate([(20.0, 20.0), (30.0, 20.0), (30.0, 30.0), (20.0, 30.0)])]
    rings = spark.createDataFrame(square + hole, "poly int, ring int, seq int, x double, y double")
    mask = ranges.rasterize_range(rings, 5.0)
    assert mask.count() == 100 and mask.where("valid = 0").count() == 4
    places = spark.createDataFrame([("in", 5.0, 5.0), ("hole", 24.0, 26.0), ("far", 500.0, -9.0)], "sampleid string, x double, y double")
    got = {r.sampleid: r.valid for r in ranges.mask_lookup(places, mask, ranges.raster_shape(rings, 5.0), 5.0).collect()}
    assert got == {"in": 1.0, "hole": 0.0, "far": 1.0}
