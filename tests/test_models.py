"""The network and the analyses on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genorigin.operators import ranges, resample, sites, summarize
from genorigin.plans import analyses, fixtures, models, network, wide
from genorigin.plans.network import Options

QUICK = Options(width=24, layers=2, epochs=12, patience=6, batch=64, rate=3e-3)


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return fixtures.samples(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def dosages(spark, sf_dir):
    return sites.to_dosage(fixtures.calls_cline(spark, sf_dir)).cache()


def test_gradient():
    o = Options(width=5, layers=3, dropout=0.0)
    rng = np.random.default_rng(0)
    w = [x.astype(np.float64) for x in network.initial(4, o)]
    x, y, wt = rng.normal(size=(6, 4)), rng.normal(size=(6, 2)), rng.random(6)
    loss = lambda ws: network.loss_and_gradient(network.forward(ws, x, o)[0], y, wt)[0]
    pred, kept = network.forward(w, x, o)
    grads = network.backward(w, kept, network.loss_and_gradient(pred, y, wt)[1].astype(float), o)[0]
    for k, g in enumerate(grads):
        up, down = [[a.copy() for a in w] for _ in range(2)]
        up[k].flat[0] += 1e-5
        down[k].flat[0] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g.flat[0]) < 1e-4


def test_control():
    c = network.Control(Options(patience=12, rate=1.0))
    assert c.seen(5.0, [np.zeros(1)]) and c.seen(4.0, [np.ones(1)])
    go = [c.seen(9.0, [np.full(1, 7.0)]) for _ in range(12)]
    assert go == [True] * 11 + [False] and c.rate == 2**-6 and c.weights[0][0] == 1
    with pytest.raises(ValueError, match="optimizer"):
        Options(algorithm="sgd")


def test_quality(dosages, samples):
    """Scored on a holdout that neither training nor the choice of epoch sees."""
    o = Options(width=64, layers=4, epochs=60, patience=30, batch=32, rate=2e-3)
    found = analyses.train_holdout(dosages, samples, 60, o)
    e = found.select("sampleid", F.col("x").alias("x_true"), F.col("y").alias("y_true"), F.col("x_pred").alias("x"), F.col("y_pred").alias("y"))
    s = summarize.error_summary(summarize.with_error(e)).first()
    assert s.n == 60 and s.r2_x > 0.5 and s.r2_y > 0.5


def test_holdouts_cover_all_known(dosages, samples):
    got = analyses.run_holdouts(dosages, samples, 150, QUICK).collect()
    assert len(got) == 450 == len({r.sampleid for r in got})


def test_windows_and_ensemble(dosages, samples):
    got = analyses.run_windows(dosages, samples, 256_000, options=QUICK).collect()
    assert {r.window_start for r in got} == {0, 256_000, 512_000} and len(got) == 3 * 95
    ref = analyses.run_windows(dosages, samples, 256_000, options=QUICK, reference_stop=True).collect()
    assert {r.window_start for r in ref} == {0, 256_000}
    half = dosages.where("position <= 256000").withColumn("chrom", F.when(F.col("position") % 2000 == 0, "2").otherwise("1"))
    both = analyses.run_windows(half, samples, 300_000, options=QUICK).collect()
    assert {(r.chrom, r.window_start) for r in both} == {("1", 0), ("2", 0)} and len(both) == 2 * 95
    fold = analyses.ensemble(dosages, samples, 3, QUICK)
    mean = summarize.ensemble_mean(fold).collect()
    assert sum(r.role == "pred" for r in mean) == 50 and sum(r.role == "val" for r in mean) == 450


def test_same_seed_same_result(dosages, samples):
    a, b = (sorted(map(tuple, analyses.run_single(d, samples, QUICK).collect())) for d in (dosages, dosages.repartition(3)))
    assert a == b


def test_jackknife_and_weights(dosages, samples, spark):
    got = analyses.run_jackknife(dosages, samples, 3, options=QUICK).collect()
    assert len(got) == 150 and len({(r.sampleid, r.x) for r in got}) > 50
    table = models.training_table(sites.feature_assembly(dosages), samples, resample.train_test_split(samples), samples.select("sampleid", F.lit(2.0).alias("sample_weight")))
    assert models.fit_predict_groups(table.withColumn("run", F.lit(0)), ["run"], QUICK).count() == 95
    with pytest.raises(ValueError, match="not been trained"):
        models.require_models(spark.createDataFrame([], "model binary"))


def by_hand(table, o, epochs):
    """The first losses of the unsplit network, trained on all rows at once in one place."""
    rows = sorted(table.collect(), key=lambda r: r.sampleid)
    train, val = ([r for r in rows if r.role == role] for role in ("train", "val"))
    x, xv = (np.array([r.x for r in some], np.float32) for some in (train, val))
    y, yv = (np.array([(r.cx, r.cy) for r in some]) for some in (train, val))
    mean, sd = y.mean(axis=0), y.std(axis=0)
    scale = x.mean(axis=0), np.sqrt(x.var(axis=0) + 1e-3)
    w = [wide.initial_block(0, x.shape[1], x.shape[1], o), *wide.initial_head(o)]
    adam, out = network.Adam(w, o), []
    for _ in range(epochs + 1):
        pred, kept = network.forward(w, (x - scale[0]) / scale[1], o)
        loss, grad = network.loss_and_gradient(pred, (y - mean) / sd, np.ones(len(x)))
        held = network.forward(w, (xv - scale[0]) / scale[1], o)[0]
        out.append((loss / len(x), network.loss_and_gradient(held, (yv - mean) / sd, np.ones(len(xv)))[0] / len(xv)))
        adam.step(w, network.backward(w, kept, grad / len(x), o)[0], o.rate)
    return out


def test_split_network_is_the_unsplit_one(dosages, samples):
    """Eight blocks of sites and parts of 100 rows give the losses of one network in one place, and with dropout and flips those of one block; predictions agree."""
    table = models.training_table(sites.feature_assembly(dosages), samples, resample.holdout_split(samples, 60)).cache()
    o = Options(width=16, layers=2, epochs=4, rate=1e-2, dropout=0.0)
    model = wide.fit_wide(table, o, block=64, part_rows=100)
    assert model.state.where("kind = 'block'").count() == 8
    assert np.allclose([h[1:3] for h in model.history], by_hand(table, o, 4), atol=1e-5)
    noisy = Options(width=16, layers=2, epochs=3, rate=1e-2, dropout=0.25, algorithm="adamw")
    one, many = wide.fit_wide(table, noisy, block=512), wide.fit_wide(table, noisy, block=70, part_rows=90)
    assert np.allclose(one.history, many.history, atol=1e-5)
    asked = table.where("role = 'holdout'").select("sampleid", "x")
    a, b = ({r.sampleid: (r.x, r.y) for r in wide.predict_wide(asked, m, noisy, part_rows=n).collect()} for m, n in ((one, 1000), (many, 25)))
    assert len(a) == 60 and all(np.allclose(a[k], b[k], atol=1e-3) for k in a)


def test_split_network_learns(dosages, samples):
    """In batches of parts; samples that no part has seen are placed."""
    o = Options(width=32, layers=2, epochs=14, rate=3e-2, dropout=0.0)
    found = analyses.train_holdout(dosages, samples, 60, o, split=analyses.Split(128, 256, 2))
    e = found.select("sampleid", F.col("x").alias("x_true"), F.col("y").alias("y_true"), F.col("x_pred").alias("x"), F.col("y_pred").alias("y"))
    s = summarize.error_summary(summarize.with_error(e)).first()
    assert s.n == 60 and s.r2_x > 0.5 and s.r2_y > 0.5


def test_a_loss_of_the_user(dosages, samples):
    """Checked against differences; it trains groups and split networks."""

    def huber(pred, y, w):
        """Squares near, distances far, by coordinate."""
        d = pred - y
        a = np.abs(d)
        value = np.where(a < 1, d * d / 2, a - 0.5)
        return float((value.sum(axis=1) * w).sum()), np.clip(d, -1, 1) * w[:, None]

    loss = network.checked_loss(huber)
    with pytest.raises(ValueError, match="gradient of the loss"):
        network.checked_loss(lambda p, y, w: (huber(p, y, w)[0], 2 * huber(p, y, w)[1]))
    table = models.training_table(sites.feature_assembly(dosages), samples, resample.train_test_split(samples)).withColumn("run", F.lit(0)).cache()
    a, b = (models.history(models.fit_groups(table, ["run"], QUICK, loss=x), ["run"]).orderBy("epoch").collect() for x in (network.loss_and_gradient, loss))
    assert a[0].loss != b[0].loss and b[-1].loss < b[0].loss
    history = wide.fit_wide(table, Options(width=8, layers=1, epochs=3, rate=1e-2), block=256, loss=loss).history
    assert history[-1][1] < history[0][1]


def test_alignment_and_weights(dosages, samples):
    fewer = samples.where("sampleid <> 's17'")
    for f in (analyses.run_windows, analyses.run_windows_holdouts):
        with pytest.raises(ValueError, match="no metadata"):
            f(dosages, fewer, 256_000, options=QUICK)
    for f in (analyses.run_single, analyses.run_bootstraps, analyses.run_jackknife, analyses.run_holdouts, analyses.run_jackknife_holdouts, analyses.train_holdout, analyses.ensemble):
        with pytest.raises(ValueError, match="no metadata"):
            f(dosages, fewer, options=QUICK)
        with pytest.raises(ValueError, match="no weight"):
            f(dosages, samples, options=QUICK, weights=samples.where("x < 25").select("sampleid", F.lit(1.0).alias("sample_weight")))


def test_holdout_roles_by_count(samples):
    roles = analyses.holdout_roles(samples, 40).groupBy("holdout_id", "role").count().collect()
    got = {(r.holdout_id, r.role): r["count"] for r in roles}
    assert all(got[h, "holdout"] == 40 and got[h, "val"] == 41 and got[h, "train"] == 369 for h in range(11))
    assert (got[11, "holdout"], got[11, "val"], got[11, "train"]) == (10, 44, 396)


def test_jackknife_changes_are_the_masked_calls(dosages, samples, spark):
    """A replicate's changes are the calls that ``jackknife_mask`` redraws, and predictions from them are those of whole vectors."""
    freq = sites.allele_freq_all(dosages).cache()
    some = dosages.where("sampleid in ('s0', 's10', 's21')").cache()
    masked = resample.jackknife_sites(dosages.select("chrom", "position").distinct(), 3)
    whole = sites.feature_assembly(resample.jackknife_mask(some, masked, freq, 3), ["replicate"]).cache()
    asked = sites.feature_assembly(some).cache()
    changes = analyses.jackknife_changes(asked, dosages, freq, 3).cache()
    places = {r.replicate: r.places for r in changes.where("places is not null").collect()}
    vectors = {r.sampleid: r.x for r in asked.collect()}
    got = {}
    for r in changes.where("draws is not null").collect():
        x = list(vectors[r.sampleid])
        for k, d in zip(places[r.replicate], r.draws, strict=True):
            x[k] = d
        got[r.replicate, r.sampleid] = x
    assert got == {(r.replicate, r.sampleid): r.x for r in whole.collect()} and len(got) == 9
    table = models.training_table(sites.feature_assembly(dosages), samples, resample.train_test_split(samples))
    model = analyses._one_model(table, QUICK)
    want = models.predict_with(whole.withColumn("run", F.lit(0)), model, ["run"], QUICK).collect()
    overlaid = {(r.replicate, r.sampleid): (r.x, r.y) for r in models.predict_overlays(asked, changes, model, QUICK, part_rows=2).collect()}
    assert len(want) == 9 and all(np.allclose(overlaid[r.replicate, r.sampleid], (r.x, r.y), atol=1e-3) for r in want)


def test_bootstrap_picks_are_the_drawn_sites(spark):
    index = spark.createDataFrame([("1", 10 * (k + 1), k) for k in range(40)], "chrom string, position long, site long")
    drawn = {(r.replicate, r.draw): r.position // 10 - 1 for r in resample.bootstrap_sites(index, 40, 3, 5).collect()}
    for replicate in range(3):
        assert analyses.bootstrap_picks(5)((replicate,), 40).tolist() == [drawn[replicate, k] for k in range(40)]


def test_range_is_a_term_of_the_score(spark, dosages, samples):
    """The penalty agrees with the look-up of places, and raises the validation loss by its mean without changing the first epoch's training."""
    rings = spark.createDataFrame([(0, 0, k, x, y) for k, (x, y) in enumerate([(10.0, 10.0), (40.0, 10.0), (40.0, 40.0), (10.0, 40.0)])], "poly int, ring int, seq int, x double, y double")
    rings = rings.union(spark.createDataFrame([(0, 1, k, x, y) for k, (x, y) in enumerate([(20.0, 20.0), (30.0, 20.0), (30.0, 30.0), (20.0, 30.0)])], rings.schema))
    score = ranges.range_score(rings, 2.0, 7.0)
    places = samples.where("x is not null").select("sampleid", "x", "y")
    valid = {r.sampleid: r.valid for r in ranges.mask_lookup(places, ranges.rasterize_range(rings, 2.0), ranges.raster_shape(rings, 2.0), 2.0).collect()}
    rows = places.collect()
    assert np.allclose(score(np.array([[r.x, r.y] for r in rows])), [7 * (1 - valid[r.sampleid]) ** 2 for r in rows]) and 0 < sum(valid.values()) < len(rows)
    table = models.training_table(sites.feature_assembly(dosages), samples, resample.train_test_split(samples)).withColumn("run", F.lit(0))
    a, b = (models.history(models.fit_groups(table, ["run"], QUICK, score=s), ["run"]).where("epoch = 0").first() for s in (None, score))
    assert a.loss == b.loss and b.val_loss > a.val_loss
    assert analyses.run_single(dosages, samples, QUICK, score=score).count() == 95


def test_command_line(spark, sf_dir, samples, tmp_path):
    from genorigin.__main__ import run
    from genorigin.sources import io

    io.write_matrix(sites.to_dosage(fixtures.calls_cline(spark, sf_dir)), f"{tmp_path}/matrix")
    raw = samples.select(F.col("sampleid").alias("sampleID"), *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in "xy"])
    raw.write.csv(f"{tmp_path}/samples", sep="\t", header=True)
    quick = ["--width", "16", "--layers", "2", "--epochs", "4", "--samples", f"{tmp_path}/samples", "--matrix", f"{tmp_path}/matrix/*/*", "--max-snps", "200"]
    single = run(spark, [*quick, "--out", f"{tmp_path}/one"])
    assert single.endswith("one_predlocs.txt") and spark.read.csv(single, header=True).count() == 95
    fold = run(spark, [*quick, "--out", f"{tmp_path}/two", "--analysis", "ensemble", "--k", "3"])
    assert fold.endswith("two_ensemble_predlocs.csv") and spark.read.csv(fold, header=True).count() == 3 * 50 + 450
    boot = run(spark, [*quick, "--out", f"{tmp_path}/three", "--analysis", "bootstrap", "--replicates", "2", "--keep-bootstraps"])
    assert spark.read.csv(boot, header=True).count() == 190 and all(spark.read.csv(f"{tmp_path}/three_boot{b}_predlocs.txt", header=True).count() == 95 for b in (0, 1))
    only = run(spark, [*quick, "--out", f"{tmp_path}/four", "--analysis", "ensemble_pred_only", "--k", "2"])
    assert only.endswith("four_ensemble_predlocs_pred_only.csv") and spark.read.csv(only, header=True).count() == 50
    with pytest.raises(ValueError, match="Unknown analysis"):
        analyses.from_calls(spark.createDataFrame([], "sampleid string"), samples, "other")
