"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is lowered, everything but letters becomes a space, and every run of 2 to 4 bytes within a word (with the space before or after it)
is hashed to a bucket. Each bucket has a vector; their mean over the text goes through a linear softmax. Training is
stochastic gradient descent in numpy on a sample of labelled rows: at most ``per_language`` rows of each language (in expectation), and with many languages
an even share of ``most`` rows, drawn by a hash of the id from the whole table. Tasks tell of each drawn text the buckets of the whole of it, with counts, and PIECES short pieces from places all over it.
Training sees whole texts and pieces. The softmax has one more class, for what is no language: it learns from pieces with their letters shuffled, or in their place random ones of a few alphabets, or
tokens as of code. A tenth of the sample is held back: by length, its texts and pieces and junk of the same lengths fit the temperature of the scores and the scores below which predictions are rejected, and
the share of held-back junk that these reject is kept with the model.
Prediction covers every whole text: as all is linear, each bucket's vector is multiplied with the softmax weights beforehand where that makes the table no wider.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_batches, pieces, ragged, release

SIZES = (2, 3, 4)
UNKNOWN = "und"
#: Part of the probability that the fitted temperature leaves to all languages alike, so a perfect sample does not make every score 1.
SMOOTHING = 0.02
#: Rows of each language in the sample (in expectation, or all it has), however many languages there are.
FEWEST = 20
#: Pieces of each text of the sample, and their longest size in characters.
PIECES, LONGEST = 12, 512
#: Texts up to this bit length of their number of subwords are short (some 170 characters): a larger share of good predictions may be rejected.
SHORT = 9
#: The share of held-back junk that is to be rejected.
JUNK = 0.99
#: That of a word or two.
WORD = 6
#: ASCII bytes other than letters become spaces; bytes of other characters stay.
FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """languages; table (buckets x classes): each bucket's scores, or with weights (width x classes) each bucket's vector; bias; the last class is no language; temperatures and
    thresholds: by the bit length of a text's number of subwords, what scores are divided by, and the score below which it is rejected; caught: the share of held-back junk that is rejected, and by
    that length."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperatures: np.ndarray
    thresholds: np.ndarray
    weights: np.ndarray | None = None
    caught: float = 0.0
    caught_by: dict[int, float] | None = None


@dataclass
class Drawn:
    """A text of the sample: the buckets of the whole of it with their counts, and pieces of it."""

    ids: np.ndarray
    counts: np.ndarray
    pieces: list[str]


def features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords of the texts one after the other, and the text of each."""
    folded = [b"  " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    data = FOLD[np.frombuffer(b"".join(folded), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, folded), np.int64, len(folded)))
    blank = data == 32
    found, whose = [], []
    for size in SIZES:
        n = len(data) - size + 1
        code, bad = np.zeros(n, np.uint32), np.zeros(n, bool)
        for k in range(size):
            code = (code ^ data[k : k + n]) * np.uint32(16777619)
            if k and k + 1 < size:
                bad |= blank[k : k + n]  # a space may only be first or last
        bad |= blank[:n] & blank[size - 1 :]
        at = np.flatnonzero(~bad)
        code = code[at]
        found.append((code ^ (code >> np.uint32(15))) % np.uint32(buckets))
        whose.append(owner[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(whose)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def draw(text: str, seed: int, buckets: int) -> Drawn:
    """Pieces have sizes from 2 characters on, evenly by their logarithm, from even places; a text that is shorter is its own piece."""
    rng = np.random.default_rng(seed & (2**63 - 1))
    sizes = np.exp(rng.uniform(np.log(2), np.log(LONGEST + 1), PIECES)).astype(int)
    places = [int(rng.integers(0, max(1, len(text) - n + 1))) for n in sizes]
    ids, counts = np.unique(features([text], buckets)[0], return_counts=True)
    return Drawn(ids.astype(np.int32), counts.astype(np.int32), [text[a : a + n] for a, n in zip(places, sizes.tolist(), strict=True)])


def junk(text: str, kind: int, rng: np.random.Generator) -> str:
    """The text with its letters shuffled (kind 0), or replaced by random ones of a to z (1) or of 24 letters from anywhere below U+A000 (2), other characters as they are; or as many characters of
    tokens and signs as code has (3)."""
    if kind == 3:
        names = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 7))))) for _ in range(12)]
        out = ""
        while len(out) < len(text):
            out += names[int(rng.integers(12))] + ("(", ")", "{", "}", '":', ",", "=", "_", ".", "/", " ", "0")[int(rng.integers(12))]
        return out[: max(1, len(text))]
    out = np.array([*map(ord, text)], np.int64)
    at = np.flatnonzero([c.isalpha() for c in text])
    letters = out[at] if kind == 0 else np.arange(97, 123) if kind == 1 else rng.integers(0xC0, 0xA000, 24)
    out[at] = rng.permutation(letters) if kind == 0 else rng.choice(letters, len(at))
    return "".join(map(chr, out.tolist()))


class Bags:
    """Bags of buckets, one after the other: ids with their parts of the bag, and where each bag starts."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]]):
        none = (np.zeros(1, np.int32), np.zeros(1, np.int32))
        bags = [b if len(b[0]) else none for b in bags]
        self.sizes = np.array([len(b[0]) for b in bags], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate([b[0].astype(np.int32) for b in bags])
        self.parts = np.concatenate([(b[1] / max(1, b[1].sum())).astype(np.float32) for b in bags])
        self.total = np.array([b[1].sum() for b in bags])

    def some(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of these bags the ids, parts, the number of each one's bag among them, and where they start."""
        sizes = self.sizes[which]
        at = ragged(self.starts[which], sizes)
        return self.ids[at], self.parts[at], np.repeat(np.arange(len(which)), sizes), np.cumsum(sizes) - sizes


def train(
    texts: list[str] | list[Drawn], labels: list[str], buckets: int = 1 << 16, width: int = 16, epochs: int = 6, rate: float = 0.5, keep: float = 0.998, keep_short: float = 0.985, seed: int = 1
) -> Model:
    """Fit on texts, or what ``draw`` tells of them, and their labels, in memory. keep, keep_short: the share of good predictions of long and short texts that the rejection thresholds let through."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), np.ones(1), np.zeros(1))
    rng = np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(languages)}
    drawn = [t if isinstance(t, Drawn) else draw(t, seed + k, buckets) for k, t in enumerate(texts)]
    n, width_out = len(drawn), len(languages) + 1
    order = rng.permutation(n)
    held, fit = order[: n // 10], order[n // 10 :]
    audit = held if len(held) else order

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(features([text], buckets)[0], return_counts=True)

    def made(rows: np.ndarray, pieces_each: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
        """Whole texts, some pieces of each, and junk of a third of as many, in turn of every kind."""
        bags, y = [(drawn[i].ids, drawn[i].counts) for i in rows], [number[labels[i]] for i in rows]
        for k, i in enumerate(rows):
            some = [p for p in rng.permutation(np.array(drawn[i].pieces, object))[:pieces_each] if LETTER.search(p)]
            bags += [bag(p) for p in some]
            y += [number[labels[i]]] * len(some)
            bad = [*some[k % 3 :: 3], *(["".join(drawn[i].pieces)] if k % 3 == 0 else [])]
            bags += [bag(junk(p, (k + j) % 4, rng)) for j, p in enumerate(bad)]
            y += [len(languages)] * len(bad)
        return bags, y

    bags, y = made(fit, 3)
    told, y = Bags(bags), np.array(y)
    del bags
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width))
    weights, bias = np.zeros((width, width_out)), np.zeros(width_out)

    def hidden_of(told: Bags, which: np.ndarray):
        ids, part, owner, first = told.some(which)
        return ids, part, owner, np.add.reduceat(vectors[ids] * part[:, None], first, axis=0)

    batches = max(1, -(-len(y) // 16))
    speed = np.minimum(20, 0.5 / np.add.reduceat(told.parts**2 + 1e-12, told.starts))  # a text of few subwords moves each of them more
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), batches):
            lr = rate * (1 - done / steps)
            done += 1
            ids, part, owner, hidden = hidden_of(told, batch)
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            back = ((error @ weights.T) * speed[batch, None])[owner] * part[:, None]
            weights -= lr * hidden.T @ error
            bias -= lr / 10 * error.mean(axis=0)
            used, where = np.unique(ids, return_inverse=True)
            for k in range(width):
                vectors[used, k] -= lr * np.bincount(where, back[:, k], len(used))
    del told
    bags, y = made(audit, PIECES)
    told, y = Bags(bags), np.array(y)
    del bags
    logits = np.concatenate([hidden_of(told, some)[3] for some in np.array_split(np.arange(len(y)), max(1, len(y) // 256))]) @ weights + bias
    bits = np.frexp(told.total.astype(float))[1].astype(np.int64)
    temperatures, thresholds = calibrated(logits, y, bits, width_out - 1, keep, keep_short)
    score = _softmax(logits / temperatures[bits, None])[:, :-1].max(axis=1)
    bad, gone = y == width_out - 1, score < thresholds[bits]
    wide = width_out > width
    return Model(
        languages, (vectors if wide else vectors @ weights).astype(np.float32), bias, temperatures, thresholds, weights if wide else None, float(gone[bad].mean()) if bad.any() else 0.0,
        {int(b): float(gone[bad & (bits == b)].mean()) for b in np.unique(bits[bad])},
    )


def _pooled(bits: np.ndarray, b: int, mine: np.ndarray, enough: float) -> np.ndarray:
    """Which of the rows are of this bit length, or, if they are too few, of the next shorter ones as well, as far as that needs."""
    low = b
    while low and (mine & (bits >= low) & (bits <= b)).sum() < enough:
        low -= 1
    return mine & (bits >= low) & (bits <= b)


def calibrated(logits: np.ndarray, y: np.ndarray, bits: np.ndarray, none: int, keep: float, keep_short: float) -> tuple[np.ndarray, np.ndarray]:
    """By bit length of the number of subwords: the temperature under which held-back texts and junk of that length are likeliest, and the score below which predictions are rejected:
    the quantile 1 - keep of the scores of good predictions, or that which rejects the share JUNK of the junk if this is lower.

    A length with too few of them takes in shorter ones; if there are still too few, nothing of that length is rejected for its score. Texts of a word or two are judged no harder than somewhat longer ones.
    """
    lengths = int(bits.max()) + 1 if len(bits) else 1
    temperatures, thresholds = np.ones(lengths), np.zeros(lengths)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    goal = np.full(logits.shape, SMOOTHING / logits.shape[1])
    goal[np.arange(len(y)), y] += 1 - SMOOTHING
    for b in range(lengths):
        some = _pooled(bits, b, np.ones(len(y), bool), 100)
        if some.any():
            loss = [-(goal[some] * np.log(_softmax(logits[some] / t) + 1e-300)).sum(axis=1).mean() for t in grid]
            temperatures[b] = grid[int(np.argmin(loss))]
    scores = _softmax(logits / temperatures[bits, None])[:, :none]
    good = (y != none) & (scores.argmax(axis=1) == y)
    for b in range(lengths):
        share = 1 - (keep_short if b <= SHORT else keep)
        some, bad = _pooled(bits, b, good, 1 / share), _pooled(bits, b, y == none, 50)
        if some.sum() >= 1 / share:
            thresholds[b] = np.quantile(scores[some].max(axis=1), share)
            if bad.any():  # no higher than rejecting junk needs
                thresholds[b] = min(thresholds[b], np.quantile(scores[bad].max(axis=1), JUNK))
    for b in range(min(WORD, lengths)):
        thresholds[b] = thresholds[b : WORD + 1].min()
    return temperatures, thresholds


def _judged(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, whether it has letters, and the bit length of its number of subwords, for each text."""
    n = len(texts)
    readable = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
    ids, owner = features([t or "" for t in texts], len(model.table))
    counts = np.bincount(owner, minlength=n)
    sums = np.stack([np.bincount(owner, model.table[ids, k], n) for k in range(model.table.shape[1])], axis=1)
    mean = sums / np.maximum(counts, 1)[:, None]
    best, score = np.zeros(n, np.int64), np.zeros(n)
    bits = np.frexp(counts.astype(float))[1].astype(np.int64)
    heat = model.temperatures[np.minimum(bits, len(model.temperatures) - 1)]
    width = max(1, (1 << 22) // len(model.languages))
    for at in range(0, n, width):  # in parts, for memory
        part = mean[at : at + width]
        scores = _softmax(((part if model.weights is None else part @ model.weights) + model.bias) / heat[at : at + width, None])
        scores = scores[:, : len(model.languages)]  # without the class that is no language
        best[at : at + width], score[at : at + width] = scores.argmax(axis=1), scores.max(axis=1)
    score[~readable] = 0.0
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), readable.tolist(), strict=True)]
    return names, score, readable, bits


def predict_batch(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, for each text."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    names, score, readable, bits = _judged(model, texts)
    return names, score, ~readable | (score < model.thresholds[np.minimum(bits, len(model.thresholds) - 1)])


def fold_of(doc_id: str, folds: int = 3) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def fit(docs: DataFrame, label: str = "lang", held_out: int = 1, folds: int = 3, per_language: int = 600, most: int = 6000, buckets: int = 1 << 16) -> Model:
    """Learn from text and label of docs (doc_id, text, label) outside the held-out fold; rows without id, text or label are left out.

    All labels are languages. Each has the same share of the sample: ``per_language`` rows, or with more labels ``most`` divided by their number, but never under FEWEST;
    a label with fewer rows gives all it has. So the sample is at most ``most`` or FEWEST rows a label, of each of which at most ``buckets`` counts and a few short pieces are held in memory, whatever the
    text's size; they are worked out in tasks, over whole texts.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", folds) != held_out))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return train([], [])
    share = min(per_language, max(most // len(counts), FEWEST))
    schema = T.StructType([T.StructField(label, docs.schema[label].dataType), T.StructField("__rate", T.DoubleType())])
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, share / n)) for k, n in counts.items()], schema)
    draw_ = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.select("doc_id", "text", F.col(label).alias("label"), F.xxhash64(F.lit(18), "doc_id", "text").alias("seed"), draw_.alias("__u"))
    drawn = drawn.join(F.broadcast(rates.withColumnRenamed(label, "label")), "label").where("__u < __rate").select("__u", "doc_id", "text", "label", "seed").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 18):
            got = [draw(t, s, buckets) for t, s in zip(piece.column("text").to_pylist(), piece.column("seed").to_pylist(), strict=True)]
            made = [pa.array([d.ids for d in got], pa.list_(pa.int32())), pa.array([d.counts for d in got], pa.list_(pa.int32())), pa.array([d.pieces for d in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in ("__u", "doc_id", "label", "seed")], *made], ["__u", "doc_id", "label", "seed", "ids", "counts", "pieces"])

    fields = [drawn.schema[c] for c in ("__u", "doc_id", "label", "seed")]
    extra = [T.StructField(c, T.ArrayType(k)) for c, k in (("ids", T.IntegerType()), ("counts", T.IntegerType()), ("pieces", T.StringType()))]
    got = map_batches(drawn, run, T.StructType([*fields, *extra])).toArrow().combine_chunks()
    keys = got.select(["__u", "doc_id", "label", "seed"]).to_pandas()
    order = keys.sort_values([*keys.columns], kind="stable").index.to_numpy()
    ids, counts, texts = (got.column(c).chunk(0) if got.num_rows else pa.array([], got.schema.field(c).type) for c in ("ids", "counts", "pieces"))
    at = [np.asarray(x.offsets) for x in (ids, counts)]
    flat = [x.values.to_numpy() for x in (ids, counts)]  # rows of the sample are views of these
    sample = [Drawn(*(f[o[k] : o[k + 1]] for f, o in zip(flat, at, strict=True)), texts[int(k)].as_py()) for k in order]
    del got
    release()
    model = train(sample, keys["label"].iloc[order].tolist())
    del sample, ids, counts, texts, at, flat
    release()  # the driver keeps no memory of the training for what comes after
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1) and rejected; columns of these names are replaced.

    A null text, or one without any letter, is ``und`` with score 0 and rejected. Every other text gets a learned language; it is rejected if its score is below
    the model's threshold for its length. A model that has learned nothing rejects all. Rows are judged one by one, with no other column read.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    keep = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, 1 << 18):
            lang, score, rejected = predict_batch(model, piece.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, *[x.name for x in new]]
            )

    return map_batches(docs, run, T.StructType([*keep, *new]))
