"""The sample of the language model has every label."""

import zlib

import numpy as np

from genorigin.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def words(label, n, rng):
    """Texts of a made-up language: words over letters of its own."""
    letters = [chr(0x4E00 + 40 * label + k) for k in range(12)]
    return [" ".join("".join(rng.choice(letters, 4)) for _ in range(8)) for _ in range(n)]


def test_rare_labels_are_learned_beside_frequent_ones(spark, monkeypatch):
    rng = np.random.default_rng(0)
    sizes = [4000] * 4 + [60] * 20
    rows = [(t, f"l{k:02}") for k, n in enumerate(sizes) for t in words(k, n, rng)]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], SCHEMA)
    seen = {}
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.update({x: labels.count(x) for x in set(labels)}) or train(texts, labels))
    model = langid.fit(docs, per_language=100, most=600)
    assert len(seen) == 24 and min(seen.values()) >= 10 and max(seen.values()) <= 50 and 350 < sum(seen.values()) < 700
    asked = [(f"l{k:02}", t) for k in range(24) for t in words(k, 5, rng)]
    assert model.weights is not None and np.mean([p == x for p, (x, _) in zip(langid.predict_batch(model, [t for _, t in asked])[0], asked)]) > 0.9


def test_more_than_a_thousand_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 1200}") for i in range(7200)], SCHEMA)
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.extend(labels))
    langid.fit(docs)
    assert set(seen) == {f"l{i % 1200}" for i in range(7200) if zlib.crc32(str(i).encode()) % 3 != 1} and len(set(seen)) > 1100


def test_wide_models_predict_as_narrow_ones():
    rng = np.random.default_rng(1)
    texts, labels = zip(*[(t, f"l{k}") for k in range(3) for t in words(k, 40, rng)])
    narrow, wide = (langid.train(list(texts), list(labels), width=w) for w in (16, 2))
    assert narrow.weights is None and wide.weights is not None
    folded = langid.Model(wide.languages, wide.table @ wide.weights, wide.bias, wide.temperatures, wide.thresholds)
    a, b = (langid.predict_batch(m, [*texts, None, "123"]) for m in (wide, folded))
    assert a[0] == b[0] and np.allclose(a[1], b[1], atol=1e-5)
