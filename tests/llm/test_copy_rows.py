"""Near copies are judged by row: exactly one row of each component stays."""

from collections import Counter

from genorigin.llm import jaccard

SCHEMA = "doc_id long, text string, source string"


def test_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda t: f"{t} end"
    rows = [
        (1, a, "x"), (1, a, "x"), (1, a, "y"), (None, near(a), "x"),  # repeated rows, and a copy without id
        (None, b, "x"), (None, b, "x"), (None, near(b), "y"),  # no id in the group
        (5, c, "x"), (6, near(c), "x"), (6, d, "x"), (5, "short", "x"),  # an id on a copy and on a clean text
        (None, None, "x"), (None, None, "x"), (3, " ", "x"), (3, " ", "x"),  # no words: no copies
    ]
    kept = jaccard.one_row_of_each(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    group = lambda t: (t or "").split(" ")[0][:1]
    assert Counter((r.doc_id, group(r.text)) for r in kept if group(r.text) != "b") == Counter(
        {(1, "a"): 1, (5, "c"): 1, (6, "d"): 1, (5, "s"): 1, (None, ""): 2, (3, ""): 2}
    )
    assert [r.doc_id for r in kept if group(r.text) == "b"] == [None] and next(r.text for r in kept if r.doc_id == 5 and group(r.text) == "c") == c
    twice = spark.createDataFrame([(i, " ".join(f"{i}w{k}" for k in range(9)), "x") for i in range(20)] * 2, SCHEMA)
    assert sorted(r.doc_id for r in jaccard.one_row_of_each(twice).collect()) == list(range(20))


def test_near_copies_stage_judges_rows(spark, sf_dir):
    import corpus_pipeline

    rows = [(None, "clean words", "en", "a", 1), (None, "token = abcdefgh123", "en", "a", 1), (2, "one two three", "en", "a", 1), (2, "one two three", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, sf_dir).count() == 3


def test_chains_compare_within_buckets(spark):
    """A chain of 1,200 documents, each near the next few only, beside a dense group of 700: links and components are those of comparing all with all."""
    words = [f"w{i}" for i in range(12_000)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 200])) for i in range(1200)]
    rows += [(2000 + i, " ".join([f"d{k}" for k in range(300)] + [f"own{i}"])) for i in range(700)]
    got = {r.doc_id: r for r in jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [d for d in range(1, 25) if (196 - 8 * d) / (196 + 8 * d) >= 0.8]  # shingles in common at a distance of d
    for i in range(1200):
        assert got[i].n_links == sum((i - d >= 0) + (i + d < 1200) for d in near) and got[i].component_id == 0
    assert all(got[2000 + i].n_links == 699 and got[2000 + i].component_id == 2000 for i in range(700))
