"""Rejection follows the held-back scores, for each length of text."""

import numpy as np
import pytest

from genorigin.llm import langid


def words(letters, n, rng, size=40):
    return [" ".join("".join(rng.choice(list(letters), 5)) for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("languages", [("abcdefg", "hijklmn"), ("abcdefg", "hijklmn", "opqrst", "éèêëàâ")])
def test_unlearned_languages_are_rejected_and_short_texts_kept(languages):
    rng = np.random.default_rng(0)
    rows = [(t, f"l{k}") for k, x in enumerate(languages) for t in words(x, 300, rng)]
    model = langid.train([t for t, _ in rows], [x for _, x in rows])
    assert langid.predict_batch(model, words("漢字書道茶花", 50, rng))[2].mean() > 0.9  # scores from 1 / languages up
    for size in (40, 4, 1):
        asked = [t for x in languages for t in words(x, 100, rng, size)]
        assert langid.predict_batch(model, asked)[2].mean() < 0.05


def test_one_language_and_few_rows():
    model = langid.train(["some words"] * 3, ["en"] * 3)
    assert langid.predict_batch(model, ["some words", "other", "", "12"])[2].tolist() == [False, False, True, True]


def test_letters_and_junk(spark):
    """Digits and signs are no letters, and junk is rejected with scores calibrated on the given table."""
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    none = ["1234 ! ²", "½", "①", "Ⅷ", "٣", "_"]
    assert langid.predict_batch(model, none)[0] == ["und"] * len(none) and langid.predict_batch(model, ["ª"])[0] != ["und"]
    rng = np.random.default_rng(2)
    made = words("abcdefghijklmnopqrstuvwxyz", 100, rng) + words("漢字書道茶花", 100, rng)
    assert langid.predict_batch(model, made)[2].mean() > 0.9 and model.caught > 0.8


def test_short_texts_and_their_junk(spark):
    """Texts of 20 to 200 characters: junk of each kind goes at 0.8 or more, right predictions of pieces of held-out documents stay at 0.98; the model tells what it caught by length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null")
    model = langid.fit(docs)
    rng = np.random.default_rng(7)
    held = docs.where(langid.fold_of("doc_id") == 1).select("text", "lang").collect()
    pieces = [(r.text[a : a + n], r.lang) for r in held for n in rng.integers(20, 201, 3).tolist() for a in [int(rng.integers(0, max(1, len(r.text) - n)))]]
    pieces = [p for p in pieces if len(p[0]) >= 20]
    names, _, gone = langid.predict_batch(model, [t for t, _ in pieces])
    right = np.array([a == b for a, (_, b) in zip(names, pieces)])
    assert right.mean() > 0.95 and 1 - gone[right].mean() >= 0.97
    shuffled = [langid.junk(t, 0, rng) for t, _ in pieces]
    code = ["def f(x):\n    return {k: v for k, v in x.items() if v is not None}", "for (int i = 0; i < n; ++i) { sum += a[i] * b[i]; }", "import os, sys\nfrom json import loads, dumps\nprint(os.getcwd())"]
    json = ['{"id": 17, "name": "x", "tags": ["a", "b"], "ok": true, "next": null}', '[{"k":1,"v":2.5},{"k":2,"v":3.5},{"k":3,"v":null}]']
    script = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "Широкая электрификация южных губерний даст мощный толчок"] * 3
    for what in (shuffled, script):
        assert langid.predict_batch(model, what)[2].mean() >= 0.8
    assert langid.predict_batch(model, code + json)[2].mean() >= 0.6
    assert model.caught > 0.8 and len(model.caught_by) > 5
