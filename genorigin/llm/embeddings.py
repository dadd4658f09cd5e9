"""Embedding near-dedup over navigable small-world graphs.

Identical vectors form a class, and classes are dealt to shards by a hash. One task builds the graph of a shard; then every class queries
every shard. The queries between two shards go both ways in one task, so a link that one side finds counts for both. Every such task audits a fixed number of its queries by
comparing them with the whole shard, and widens the beam until the audit's recall passes. Links are verified by their cosine in double precision.

A query whose whole beam is above the threshold lies in a dense core, and its links may be as many as the shard. Cores are settled without widening: vectors within half
the threshold's angle of a core vector form a ball, all of whose pairs are linked; only vectors within one and a half times that angle
can have links into the ball, and these are compared with it exactly. So a cluster of near copies costs in proportion to its size, and all its links count.
What a task hands on are counts and a spanning forest, never pairs. Components are joined over the forests.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import release
from .blocks import forest
from .common import stored
from .components import connected
from .hnsw import BATCH, Graph

INDEX = "shard int, first int, last int, graph binary, names binary, sizes binary, raw binary"
#: kind: links (n of class), forest (class and other), audit (n links found of the links wanted, in class).
FOUND = "kind string, class string, other string, n long"
#: Comparisons at once.
CELLS = 1 << 22


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so very large and very small ones neither overflow nor vanish."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _packed(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def _unpacked(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("class")  # a digest: any order, but the same each time
    raw = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    graph = Graph.build(unit(raw))
    small = raw.astype(np.float32)
    out = [*rows.iloc[0][["shard", "first", "last"]], graph.to_bytes(), _packed(rows["class"].to_numpy().astype("U")), _packed(rows["size"].to_numpy()), _packed(small if (small == raw).all() else raw)]
    release()
    return pd.DataFrame([out], columns=["shard", "first", "last", "graph", "names", "sizes", "raw"])


class Shard:
    """A graph with its vectors in double precision, the names and sizes of its classes, and the links counted for each."""

    def __init__(self, row: pd.Series):
        self.vectors = unit(_unpacked(row["raw"]).astype(np.float64))
        self.graph = Graph.from_bytes(row["graph"], self.vectors)
        self.names, self.sizes = _unpacked(row["names"]), _unpacked(row["sizes"])
        self.links = np.zeros(len(self.names), np.int64)


def probe(a: Shard, b: Shard, at: np.ndarray, ef: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries of these classes of a to the graph of b: the links found (of a, of b), and which classes have a whole beam above the threshold."""
    n = len(b.vectors)
    batch = max(16, min(BATCH, (1 << 23) // (n + 1)))
    near = threshold - 1e-4  # single precision may err a little
    rows, nodes, dense = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(at), batch):
        mine = at[k : k + batch]
        ids, likes = b.graph.search(a.vectors[mine], ef)
        full = (likes[:, -1] >= near) & (ids.shape[1] < n)
        r, c = np.nonzero((likes >= near) & ~full[:, None])
        x, y = mine[r], ids[r, c]
        true = np.einsum("id,id->i", a.vectors[x], b.vectors[y]) >= threshold
        rows.append(x[true])
        nodes.append(y[true])
        dense.append(mine[full])
    return np.concatenate(rows), np.concatenate(nodes), np.concatenate(dense)


def audited(a: Shard, b: Shard, ef: int, threshold: float, audit: int, recall: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Links of all classes of a in b, by the least beam whose audit passes; and the links of the audited queries that were wanted and found."""
    n = len(a.vectors)
    asked = np.sort(np.random.default_rng(seed).choice(n, min(n, audit), replace=False))
    step = max(1, CELLS // len(b.vectors))
    wanted: set[tuple[int, int]] = set()
    for k in range(0, len(asked), step):
        r, c = np.nonzero(a.vectors[asked[k : k + step]] @ b.vectors.T >= threshold)
        wanted |= {*zip(asked[k + r].tolist(), c.tolist(), strict=True)}
    while True:
        rows, nodes, dense = probe(a, b, asked, ef, threshold)
        settled = {*dense.tolist()}  # exact anyway
        want = {x for x in wanted if x[0] not in settled}
        got = len(want & {*zip(rows.tolist(), nodes.tolist(), strict=True)})
        if got >= recall * len(want) or ef >= len(b.vectors):
            rows, nodes, dense = probe(a, b, np.arange(n), ef, threshold)
            return rows, nodes, dense, len(want), got
        ef *= 2


def settle(a: Shard, b: Shard, core: np.ndarray, others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Count all links between the classes ``core`` of a and ``others`` of b (a mask) for both sides, exactly; returns enough of them to connect what they connect: (of a, of b).

    With a and b the same shard, every link within core counts from both of its ends, and links to itself do not count.
    """
    same = a is b
    angle = math.acos(threshold)
    ball, rim = math.cos(angle / 2 - 1e-6), math.cos(min(math.pi, 1.5 * angle + 1e-6))
    inner = np.zeros(len(a.vectors), bool)
    inner[core] = True
    left = np.flatnonzero(others)
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def count(mine: np.ndarray, theirs: np.ndarray, weight_mine, weight_theirs) -> None:
        a.links[mine] += weight_theirs
        if same:  # the other end counts here only if it is no core class, which counts for itself
            outer = ~inner[theirs]
            b.links[theirs[outer]] += weight_mine if np.isscalar(weight_mine) else weight_mine[outer]
        else:
            b.links[theirs] += weight_mine

    while len(core):
        centre = a.vectors[core[0]]
        likes = b.vectors[left] @ centre
        inside = likes[core] >= ball if same else a.vectors[core] @ centre >= ball  # within a shard, others are all classes
        inside[0] = True
        members, core = core[inside], core[~inside]
        close, edge = left[likes >= ball], left[(likes < ball) & (likes >= rim)]
        if len(close):
            count(members, close, int(a.sizes[members].sum()), int(b.sizes[close].sum()))
            if same:
                a.links[members] -= a.sizes[members]  # each is in close itself
            x += [members, np.full(len(close), members[0])]
            y += [np.full(len(members), close[0]), close]
        step = max(1, CELLS // max(1, len(edge)))
        for k in range(0, len(members) if len(edge) else 0, step):
            part = members[k : k + step]
            hit = a.vectors[part] @ b.vectors[edge].T >= threshold
            count(part, edge, a.sizes[part] @ hit, hit @ b.sizes[edge])
            r = np.flatnonzero(hit.any(axis=1))
            c = np.flatnonzero(hit.any(axis=0))
            x += [part[r], part[hit[:, c].argmax(axis=0)]]
            y += [edge[hit[r].argmax(axis=1)], c if not len(c) else edge[c]]
    return np.concatenate(x), np.concatenate(y)


def compare(a: Shard, b: Shard, threshold: float, ef: int, audit: int, recall: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Count the links between two shards (or within one) for both; returns links that connect what they connect, and the audit's links wanted and found."""
    same = a is b
    x, y, dense_a, wanted, got = audited(a, b, ef, threshold, audit, recall, 1)
    if same:
        x, y, dense_b = np.minimum(x, y), np.maximum(x, y), dense_a
    else:
        back, to, dense_b, more, found = audited(b, a, ef, threshold, audit, recall, 2)
        x, y, wanted, got = np.concatenate([x, to]), np.concatenate([y, back]), wanted + more, got + found
    plain_a, plain_b = np.ones(len(a.vectors), bool), np.ones(len(b.vectors), bool)
    plain_a[dense_a], plain_b[dense_b] = False, False
    keep = plain_a[x] & plain_b[y] & ((x != y) | (not same))
    both = np.unique(x[keep] * len(b.vectors) + y[keep])
    x, y = both // len(b.vectors), both % len(b.vectors)
    np.add.at(a.links, x, b.sizes[y])
    np.add.at(b.links, y, a.sizes[x])
    p, q = settle(a, b, dense_a, np.ones(len(b.vectors), bool), threshold)
    x, y = np.concatenate([x, p]), np.concatenate([y, q])
    if not same:
        q, p = settle(b, a, dense_b, plain_a, threshold)
        x, y = np.concatenate([x, p]), np.concatenate([y, q])
    return x, y, wanted, got


def _pair(threshold: float, ef: int, audit: int, recall: float):
    def run(key: tuple[int, int], index: pd.DataFrame) -> pd.DataFrame:
        if len(index) < len({*key}):  # the other shard is empty
            return pd.DataFrame([], columns=["kind", "class", "other", "n"])
        index = index.sort_values("shard")
        shards = [Shard(row) for _, row in index.iterrows()]
        a, b = shards[0], shards[-1]
        x, y, wanted, got = compare(a, b, threshold, ef, audit, recall)
        first = 0 if a is b else len(a.names)
        names = np.concatenate([s.names for s in shards])
        p, q = forest(x, y + first, len(names))
        links = np.concatenate([s.links for s in shards])
        some = np.flatnonzero(links)
        out = pd.concat([
            pd.DataFrame({"kind": "links", "class": names[some], "other": None, "n": links[some]}),
            pd.DataFrame({"kind": "forest", "class": names[p], "other": names[q], "n": 0}),
            pd.DataFrame({"kind": ["audit"], "class": [str(wanted)], "other": [None], "n": [got]}),
        ])
        release()
        return out

    return run


def _found(vectors: DataFrame, threshold: float, shards: int, shard_values: int, ef: int, audit: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their class, the classes (class, vector, size, least), and what the pairs of shards hand on."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, vector).alias("vector"))
    digest = F.concat(F.size("vector"), F.lit("/"), F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary")))
    named = rows.withColumn("class", F.when(F.col("vector").isNotNull(), digest))
    good = named.where("class is not null")
    classes = stored(good.groupBy("class").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least")), "vectors")
    length = F.substring_index("class", "/", 1).cast("int")
    # graphs hold vectors of one length; as many shards for a length as keep them below shard_values components
    counts = classes.groupBy(length.alias("length")).agg(F.greatest(F.lit(shards), F.ceil(F.count(F.lit(1)) * length / F.lit(shard_values))).cast("int").alias("shards"))
    counts = counts.withColumn("first", F.coalesce(F.sum("shards").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    counts = stored(counts, "lengths")
    sized = classes.withColumn("length", length).join(counts, "length")
    dealt = sized.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("class"), F.col("shards"))).cast("int"))
    dealt = dealt.withColumn("last", F.col("first") + F.col("shards") - 1)
    index = stored(dealt.select("shard", "first", "last", "class", "vector", "size").groupBy("shard").applyInPandas(_build, INDEX), "graphs")
    spread = index.withColumn("partner", F.explode(F.sequence("first", "last")))
    pair = [F.least("shard", "partner").alias("low"), F.greatest("shard", "partner").alias("high")]
    cells = spread.select(*pair, "shard", "graph", "names", "sizes", "raw").groupBy("low", "high")
    return named, classes, stored(cells.applyInPandas(_pair(threshold, ef, audit, recall), FOUND), "found")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, shards: int = 6, shard_values: int = 1 << 23, ef: int = 48, audit: int = 128, recall: float = 0.99
) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two vectors are linked if their cosine, in double precision, is at least the threshold; n_links counts the other rows linked to
    this one, copies included, component_id is the smallest vec_id reachable by links, and kept tells whether that is this one. Links count for both ends or for none. There are ``shards`` shards, or
    as many as keep them below ``shard_values`` components of vectors. Between two shards ``audit`` queries each way are audited at the given recall. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Rows of equal ids are rows all the same; a null id is never the
    smallest, and such a row is kept only if it has no link to another id. An empty table gives no rows.
    """
    named, classes, found = _found(vectors, threshold, shards, shard_values, ef, audit, recall)
    links = found.where("kind = 'links'").groupBy("class").agg(F.sum("n").alias("links"))
    parts = connected(found.where("kind = 'forest'").select(F.col("class").alias("a"), F.col("other").alias("b")), "near")
    labelled = classes.drop("vector").join(links, "class", "left").join(parts, classes["class"] == parts["node"], "left").select(
        "class", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")
    )
    labelled = stored(labelled, "labelled")
    lowest = stored(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    result = labelled.join(lowest, "root").select(F.col("class").alias("key"), "n_links", "component_id")
    joined = named.select("vec_id", "class").join(result, F.col("class") == F.col("key"), "left")
    root = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))


def audit_report(vectors: DataFrame, threshold: float = 0.9, shards: int = 6, shard_values: int = 1 << 23, ef: int = 48, audit: int = 128, recall: float = 0.99) -> DataFrame:
    """One row: wanted and found, the links of all audited queries outside dense cores, by comparison with whole shards and by the beams."""
    found = _found(vectors, threshold, shards, shard_values, ef, audit, recall)[2].where("kind = 'audit'")
    return found.agg(F.coalesce(F.sum(F.col("class").cast("long")), F.lit(0)).alias("wanted"), F.coalesce(F.sum("n"), F.lit(0)).alias("found"))
