"""Vector codes, collocations and main text of pages against brute force, and on edge tables."""

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from genorigin.llm import collocations, page_diff, page_lines, queries, vector_codes

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_entry_is_that_of_all(kind):
    rng = np.random.default_rng(3)
    for dim in (0, 1, 3, 8):
        parts, book = (rng.integers(-4, 5, (n, dim)).astype(kind) for n in (500, 16))
        index, error = vector_codes.nearest(parts, book)
        every = ((parts[:, None] - book[None]) ** 2).sum(axis=2).astype(int)
        assert (every.argmin(axis=1) == index).all() and (every.min(axis=1) == error).all()


def codes_by_hand(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    at = vector_codes.cuts(len(kept[0][1]), parts)
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in kept if len(v) == at[-1]]
    books = [[v[a:b] for _, v in kept[:entries]] for a, b in zip(at, at[1:])]
    near = lambda x, book: min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for (a, b), book in zip(zip(at, at[1:]), books):
            held = [[] for _ in book]
            for _, v in kept:
                held[near(v[a:b], book)[1]].append(v[a:b])
            new.append([[sum(c) // len(x) for c in zip(*x)] if x else old for x, old in zip(held, book)])
        books = new
    out = [(i, [near(v[a:b], book) for (a, b), book in zip(zip(at, at[1:]), books)]) for i, v in kept]
    return books, [(i, [k for _, k in x], sum(d for d, _ in x)) for i, x in out]


def test_codes_on_edges(spark):
    """Nulls, non-finite components, other lengths, repeated ids and rows, huge components, a clashing column; parts that are not equal."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=5)], "c") for i in rng.integers(0, 30, 60)]
    rows += [(None, [0.5] * 5, None), (None, None, "a"), (3, [1.0, None, 0.0, 0.0, 0.0], "a"), (4, [float("nan")] * 5, "a"), (5, [float("inf")] * 5, "a"), (7, [1e15, -1e15, 3.5e10, 0.0, -0.25], "b"), (90, [1.0], "b"), (91, [], "b")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, codes string")
    found = vector_codes.fit(table, parts=2, entries=4, rounds=3)
    books, want = codes_by_hand([r[:2] for r in rows], 2, 4, 3)
    assert [b.tolist() for b in found.books] == books
    got = vector_codes.encode(table, found).collect()
    key = lambda r: (r[0] is None, r[0], r[1], r[2] or 0)
    assert sorted(((r.vec_id, r.codes, r.error) for r in got if r.codes is not None), key=key) == sorted(((i, c, e if e < 2**63 else None) for i, c, e in want), key=key)
    assert sorted(r.vec_id for r in got if r.codes is None) == [90, 91]


def test_codes_of_nothing(spark):
    table = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    found = vector_codes.fit(table)
    assert found.width == 0 and vector_codes.encode(table, found).count() == 0


def phrases_by_hand(rows, least, most):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    wanted = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    inner = {(lang, w[i : i + k]) for (lang, w), v in wanted.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * v >= 80 * f[lang, w[i : i + k]]}
    by = {}
    for (lang, w), a in wanted.items():
        if (lang, w) not in inner:
            s, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in by.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:most], 1))


@pytest.mark.parametrize("bits", [collocations.MOST_BITS, 1 << 16])
def test_collocations_of_a_corpus(spark, sf_dir, bits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    got = collocations.collocations(docs, 5, 60, bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(docs.collect(), 5, 60)


def test_collocations_in_small_batches(spark, monkeypatch):
    """Many equal words, subtrees that cross batches, odd white space, empty and null lang."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["A", "b", "the", "é x", "z\x01"]) for _ in range(rng.randrange(60))) + rng.choice(["", ".", "\t, x"]), rng.choice(["en", None, "und", ""])) for _ in range(400)]
    rows += [(None, "en"), ("", None), ("x " * 3000, "en"), ("...,,\n", "fr")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "lang", "1 as phrase", "2 as a"), 10, 40)
        assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 10, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0


def test_filter_never_loses_a_hash():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    words = np.zeros(1 << 9, np.uint64)
    made = collocations.Filter(words)
    for at in made.places(hashes, made.mask):
        np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    assert made.has(hashes).all()


def test_common_lines_are_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = page_diff.common(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


PAGES = {
    '<body><nav><a href=x>Home</a></nav><header><h1>Site</h1></header><div id="content"><p>One&nbsp; two<br>thr<b>ee</b></p><p>&lt;four&gt; &amp;c</p></div><div class="cookie-notice">c</div><form>f</form></body>': ("content", ["One two", "three", "<four> &c"]),
    '<article><header><h1>T</h1><p>By me</p></header><p>a<script>var x="</p>"</script>b<!-- <p>c --><div class="ad">x</div><p class="promo">y<p>next<section id="comments"><article>z</article></section></article>after': ("article", ["T", "ab", "next"]),
    '<body class="has-sidebar"><main><table><tr><td>x<td>y</table></main><div>q</div>': ("main", ["x", "y"]),
    '<p hidden>a</p><p style="display: none">b</p><p aria-hidden="true">c</p><div role="navigation">d</div>e': ("body", ["e"]),
    "<div><a href=x>whole link</a></div><p>text with a <a href=x>link</a></p>": ("body", ["text with a link"]),
    "": ("body", []), "a < b & c": ("body", ["a < b & c"]), "<p>end in <b": ("body", ["end in"]), '<a "b>c</a> d <i': ("body", ["c d"]),
}


@pytest.mark.parametrize("page", PAGES)
def test_lines_of_markup(page):
    assert page_lines.main_lines(page) == PAGES[page]


def test_main_text_of_the_table(spark, sf_dir):
    """The pages of the table name their article, which has headings, paragraphs and bold runs only."""
    got = {r.page_id: r for r in queries.op13_main_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body))
        want = " ".join(x for x in blocks if x)
        assert tuple(got[r.page_id]) == (r.page_id, r.url, want, len(want))


def test_template_lines_go_by_differencing(spark):
    """Pages whose markup says nothing: what neighbours share goes, whatever the number of pages; copies of a page and passages in one neighbour stay."""
    rng = random.Random(6)
    words = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(999)) for _ in range(12))
    rows, want = [], {}
    for i in range(200):
        folder = ("news", "sport")[i % 2]
        own = [words() for _ in range(rng.randrange(1, 6))]
        if i in (50, 51):
            own.append("a passage that two pages of the site have in common")
        body = ["Top of the site", f"All about {folder}", *own, "Write to us", "All rights"]
        rows.append((i, f"http://a.example/{folder}/{i:04}?q={i}", "".join(f"<div>{x}</div>" for x in body)))
        want[i] = " ".join(own)
    rows += [(1000 + i, f"http://b.example/x/{i}", "<div>Same</div><div>text</div>") for i in range(30)]
    rows += [(2000, None, "<div>Top of the site</div>"), (2001, "no host", "<div>Top of the site</div>"), (2002, "http://a.example/news/zz", None), (None, "http://c.example/", "<p>x</p>"), (None, "http://c.example/", "<p>x</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as block")
    got = page_diff.main_text(table).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert {i: texts[i] for i in want} == want
    assert all(texts[1000 + i] == "Same text" for i in range(30))
    assert texts[2000] == texts[2001] == "Top of the site" and texts[2002] == "" and [r.text for r in got if r.page_id is None] == ["x", "x"]
    assert page_diff.main_text(table.limit(0)).count() == 0


def test_template_lines_within_articles(spark):
    """At the ends of articles, what all of four neighbours or more share goes (the first and the last page have three); in the middle it stays."""
    page = "<article><h1>Head {0}</h1><p>Share this</p><p>text {0} a</p><p>a line in all</p><p>text {0} b</p><p>Read more here</p></article>"
    rows = [(i, f"http://a.example/{i:03}", page.format(f"{i} " + "word " * (i + 20))) for i in range(40)]
    got = {r.page_id: r.text for r in page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(1, 39)} == {i: " ".join(f"Head {i} {'word ' * (i + 20)} text {i} {'word ' * (i + 20)} a a line in all text {i} {'word ' * (i + 20)} b".split()) for i in range(1, 39)}
    assert got[0].startswith("Head 0 word") and "Share this" in got[0] and "Read more here" in got[39]
