"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every document becomes its set of word shingles, with a 128-bit digest of the set and a MinHash signature. Documents with the same
   set form a class; only one signature of each goes on.
2. Classes that agree on any band of their signatures share a bucket. All pairs within buckets are compared value by value: after each step the
   pair is dropped if the posterior probability that its similarity reaches the threshold, given the matches so far and a uniform prior, is below
   ``tolerance``. What a bucket hands on is a spanning forest of the survivors, never its pairs.
3. The components of these links are groups that hold, with their texts, every pair that can be similar. Within each, all pairs go through
   the same pruning, and the rest are verified exactly on their shingles. Counts of links per class come out, and again a spanning forest. In groups that are long chains rather than dense,
   where that compares over CHAIN times as many pairs as share a bucket, only pairs within buckets are compared, each in the first band it agrees on.

Buckets and groups of any size are dealt into blocks, so no task holds one as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, pieces, ragged, raw
from .blocks import block_pairs, forest, run_blocks
from .common import stored
from .components import connected
from .hashing import Rolling, word_hashes, word_spans
from .sifted import sifted

ROWS, BANDS, STEP = 4, 24, 16
#: Pairs of a group for each pair within its buckets, and members, from which on only buckets are compared.
CHAIN, MEMBERS = 4, 512
HASHES = ROWS * BANDS
_RNG = np.random.default_rng(42)
A = _RNG.integers(1, 2**62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def posterior(matches: int, n: int, threshold: float) -> float:
    """The probability that the similarity is at least the threshold, given matches of n values and a uniform prior: the upper tail of Beta(matches + 1, n - matches + 1),
    as a binomial sum."""
    return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(matches + 1))


def fewest_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """For every step, the least matches that keep a pair: (values compared, matches)."""
    return [(n, next((m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance), n + 1)) for n in range(STEP, HASHES + 1, STEP)]


def prune(signatures: np.ndarray, i: np.ndarray, j: np.ndarray, rule: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that survive the incremental comparison; signatures: (members, HASHES)."""
    if len(i) > 1 << 17:  # in parts, for memory
        parts = [prune(signatures, i[k : k + (1 << 17)], j[k : k + (1 << 17)], rule) for k in range(0, len(i), 1 << 17)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    matches, done = np.zeros(len(i), np.int64), 0
    for n, least in rule:
        matches += (signatures[i, done:n] == signatures[j, done:n]).sum(axis=1)
        keep = matches >= least
        i, j, matches, done = i[keep], j[keep], matches[keep], n
    return i, j


def in_first_band(signatures: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group as a whole (band -1), and those of a bucket that agree on no band before that of the bucket, so each pair counts once."""
    keep = band[i] < 0
    for at in range(0, len(i), 1 << 14):
        part = np.arange(at, min(at + (1 << 14), len(i)))
        part = part[~keep[part]]
        same = (signatures[i[part]] == signatures[j[part]]).reshape(-1, BANDS, ROWS).all(axis=2)
        keep[part] = same.argmax(axis=1) == band[i[part]]
    return i[keep], j[keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text in order, one text after the other, and each text's count.

    A text of fewer words has one shingle, of all its words; a text without words has none.
    """
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = np.diff(first)
    size = np.minimum(n, words)
    counts = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), counts)
    at = ragged(first[:-1], counts)
    code = Rolling(hashes).of(at, size[owner])
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code[new], np.bincount(owner[new], minlength=len(n))


def minhash(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The signatures of the sets that are not empty."""
    full = counts[counts > 0]
    at = np.cumsum(full) - full
    out = np.empty((len(full), HASHES), np.uint32)
    if len(full):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((codes * A[k] + B[k]) >> np.uint64(32), at)
    return out


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 18):
            codes, counts = shingle_sets(*raw(piece.column("text")), words)
            full = np.flatnonzero(counts)
            at = np.cumsum(counts[full]) - counts[full]
            one = np.add.reduceat(codes * A[0], at) if len(full) else np.zeros(0, np.uint64)
            two = np.add.reduceat((codes ^ (codes >> np.uint64(29))) * A[1], at) if len(full) else one
            digest = np.stack([one, two], axis=1).astype("<u8").tobytes()
            signature = minhash(codes, counts).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(pa.array(full)), piece.column("tie").take(pa.array(full)),
                    pa.array([digest[k * 16 : k * 16 + 16].hex() for k in range(len(full))], pa.string()),
                    pa.array([signature[k * 4 * HASHES : (k + 1) * 4 * HASHES] for k in range(len(full))], pa.binary()),
                ], ["doc_id", "tie", "class", "signature"],
            )

    return run


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)


def _survivors(rule):
    def work(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        i, j = prune(_signatures(table), i, j, rule)
        names = table.column("class").combine_chunks()
        a, b = forest(i, j, table.num_rows)
        return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], ["a", "b"])

    return work


def common_counts(codes: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The size of the intersection of each pair of sets, by products of incidence matrices over slices of the shingles that several sets have."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    names, column, times = np.unique(codes, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = int(column[-1]) + 1 if len(column) else 0, 4096
    common = np.zeros((n, n), np.float32)
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, min(width, total - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    return common[i, j]


def _verified(rule, threshold: float):
    def work(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        sets = table.column("shingles").combine_chunks()
        sizes = table.column("size").to_numpy()
        names = table.column("class").combine_chunks()
        n = table.num_rows
        signatures = _signatures(table)
        i, j = prune(signatures, i, j, rule)
        i, j = in_first_band(signatures, np.asarray(table.column("band")), i, j)
        if len(i):
            used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
            some = sets.take(pa.array(used))
            counts = np.diff(np.asarray(some.offsets))
            codes = np.asarray(some.flatten()).view(np.uint64)
            a, b = where[: len(i)], where[len(i) :]
            common = np.empty(len(i))
            root_i, root_j = forest(a, b, len(used))  # sets of different groups share no pair: each group on its own
            root = np.arange(len(used))
            root[root_i] = root_j
            place = np.cumsum(counts) - counts
            for r in np.unique(root[a]).tolist():
                mine = np.flatnonzero(root == r)
                at = np.flatnonzero(root[a] == r)
                local = np.searchsorted(mine, [a[at], b[at]])
                common[at] = common_counts(codes[ragged(place[mine], counts[mine])], counts[mine], *local)
            linked = common >= threshold * (counts[a] + counts[b] - common) - 1e-9
            i, j = i[linked], j[linked]
        links = np.bincount(i, sizes[j], n) + np.bincount(j, sizes[i], n)
        a, b = forest(i, j, n)
        to = np.full(n, -1)
        to[a] = b
        hit = np.flatnonzero(links > 0)
        other = names.take(pa.array([None if x < 0 else x for x in to[hit].tolist()], pa.int64()))
        return pa.RecordBatch.from_arrays([names.take(pa.array(hit)), pa.array(links[hit].astype(np.int64)), other], ["class", "links", "other"])

    return work


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 18):
            codes, counts = shingle_sets(*raw(piece.column("text")), words)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(c) for c in ("meets", "class", "size", "signature")], pa.ListArray.from_arrays(offsets, pa.array(codes.view(np.int64)))],
                ["meets", "class", "size", "signature", "shingles"],
            )

    return run


MEETS = "meets array<struct<block: string, side: int, band: int>>"


def _keys_to_compare(grouped: DataFrame, crowded: DataFrame) -> DataFrame:
    """(class, key, band): under which keys a class meets the others of its group: the group (band -1), or, where that is a chain, its buckets with their bands."""
    pairs = lambda: F.count(F.lit(1)).cast("double") * F.count(F.lit(1))
    inside = crowded.join(grouped.select("class", "group"), "class")
    buckets = inside.groupBy("group", "bucket").agg(pairs().alias("pairs")).groupBy("group").agg(F.sum("pairs").alias("in_buckets"))
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEMBERS)
    chains = sizes.join(buckets, "group").where(F.col("n").cast("double") * F.col("n") > CHAIN * F.col("in_buckets"))
    chains = stored(chains.select("group"), "chains")
    whole = grouped.join(chains, "group", "left_anti").select("class", F.col("group").alias("key"), F.lit(-1).alias("band"))
    key = F.concat_ws("/", "group", F.col("bucket").cast("string"))
    return whole.unionByName(inside.join(chains, "group", "left_semi").select("class", key.alias("key"), F.col("band").cast("int").alias("band")))


def _linked(docs: DataFrame, words: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (doc_id, tie, text); prints (doc_id, tie, class, signature) of the rows with words; and classes: (class, least, first, size, links, root).

    tie is the md5 of the text; first the first row of a class (none, doc_id, tie), rows without id after all others; root a name of its component.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("tie"), "text")
    prints = stored(map_batches(texts, _prints(words), "doc_id long, tie string, class string, signature binary"), "prints")
    classes = stored(
        prints.groupBy("class").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.min("signature").alias("signature"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first"),
        ), "classes",
    )
    bands = F.posexplode(
        F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    )
    keys = classes.select("class", bands.alias("band", "bucket"))
    full = stored(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "full")
    crowded = stored(sifted(keys, F.col("bucket"), full.select(F.col("bucket").alias("hash"))).join(full, "bucket"), "crowded")
    members = block_pairs(crowded, "bucket", "class").join(classes.select("class", "signature"), "class")  # names are dealt into blocks; what they compare is joined last, and moves once
    rule = fewest_matches(threshold, tolerance)
    near = run_blocks(members, "class", _survivors(rule), "a string, b string")
    groups = connected(near, "candidates").select(F.col("node").alias("class"), F.col("root").alias("group"))
    grouped = stored(sifted(classes.drop("first"), F.xxhash64("class"), groups.select(F.xxhash64("class").alias("hash"))).join(groups, "class"), "grouped")
    compared = block_pairs(stored(_keys_to_compare(grouped, crowded), "keys"), "key", "class", 256)
    compared = compared.groupBy("class").agg(F.collect_list(F.struct("block", "side", "band")).alias("meets"))
    heads = prints.drop("signature").join(grouped.join(compared, "class"), "class").where(F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["class"])
    heads = stored(heads, "heads")
    same = texts["doc_id"].eqNullSafe(heads["doc_id"]) & (texts["tie"] == heads["tie"])
    named = F.xxhash64("doc_id", "tie")  # only texts that are compared are shuffled
    with_text = sifted(texts, named, heads.select(named.alias("hash"))).join(heads, same).select("meets", "class", "size", "signature", "text").dropDuplicates(["class"])
    sets = map_batches(with_text, _shingles(words), f"{MEETS}, class string, size long, signature binary, shingles array<long>")
    sets = sets.select(F.explode("meets").alias("m"), "class", "size", "signature", "shingles").select("m.*", "class", "size", "signature", "shingles")
    found = stored(run_blocks(sets, "class", _verified(rule, threshold), "class string, links long, other string", 512), "links")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = connected(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")), "groups")
    labelled = classes.join(counts, "class", "left").join(parts, classes["class"] == parts["node"], "left").select(
        "class", "least", "first", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("root")
    )
    return texts, prints, labelled


def join_similar(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id, n_links, component_id.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least the threshold. class_id is the
    smallest doc_id with the same set, n_links the number of other documents linked to this one, copies included, and component_id
    the smallest doc_id reachable by links. A text of fewer words is a single shingle; a text without words (or null) links with nothing and is a class of its own, also when its id is
    null. Null ids count as documents but are never the smallest unless a class has no other. Rows that share an id are rows all the same. An empty table gives no rows; other columns are not read.
    """
    texts, prints, labelled = _linked(docs, words, threshold, tolerance)
    labelled = stored(labelled, "labelled")
    lowest = stored(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")  # so that a root of many can be split in the join
    result = labelled.join(lowest, "root").select("class", F.col("least").alias("class_id"), (F.col("size") - 1 + F.col("links")).alias("n_links"), "component_id")
    judged = prints.select("doc_id", "class").join(result, "class").select("doc_id", "class_id", "n_links", "component_id")
    bare = texts.where(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0)
    alone = bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return judged.unionAll(alone)


def one_row_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Exactly one row of each component of docs (doc_id, text), with all its columns: one with the smallest id, or of a component without ids any one by its text.

    Rows are judged by id and text: repeated rows leave one (the least by a hash of their columns), rows without id are rows like others, and an id on different
    texts is judged for each text. A text without words (or null) is a component of its own, so each such row stays. An empty table gives no rows.
    """
    firsts = _linked(docs, words, threshold, tolerance)[2].groupBy("root").agg(F.min("first").alias("first"))
    key = lambda doc, tie: F.concat_ws("|", F.coalesce(doc.cast("long").cast("string"), F.lit("-")), tie)
    kept = firsts.select(key(F.col("first.doc_id"), F.col("first.tie")).alias("__key"))
    bare = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.where(~bare).select(key(F.col("doc_id"), F.md5("text")).alias("__key"), F.struct("*").alias("__row"), order.alias("__order"))
    one = rows.groupBy("__key").agg(F.min_by("__row", "__order").alias("__row"))  # partial aggregation: no task holds all rows of a key
    chosen = one.join(kept, "__key", "left_semi").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    return chosen.unionAll(docs.where(bare))
