"""Hierarchical navigable small-world graphs in numpy.

Searches and insertions run in lockstep over batches of vectors: every step expands the best few open candidates of every
query at once. Vectors are unit length, and likeness is the dot product.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

BATCH, WIDTH = 256, 4


def _search(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the ef best nodes found and their likeness, best first. links: (n, m), padded with n; entries: (queries, some), padded with n."""
    n, m = links.shape
    q, k = len(queries), WIDTH * m
    ef = max(ef, entries.shape[1], WIDTH)
    table = np.vstack([links, np.full((1, m), n, links.dtype)])
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
    seen = np.zeros((q, n + 1), bool)
    stamp = np.zeros((q, n + 1), np.int16)
    rows = np.arange(q)[:, None]
    seen[rows, entries] = True
    seen[:, n] = True
    ids = np.full((q, ef), n, np.int64)
    likes = np.full((q, ef), -np.inf, np.float32)
    open_ = np.zeros((q, ef), bool)
    e = entries.shape[1]
    ids[:, :e] = entries
    likes[:, :e] = np.where(entries < n, np.einsum("qd,qed->qe", queries, padded[entries]), -np.inf)
    open_[:, :e] = entries < n
    active = np.arange(q)
    place = np.arange(k, dtype=np.int16)
    while True:
        score = np.where(open_[active], likes[active], -np.inf)
        pick = np.argpartition(-score, WIDTH - 1, axis=1)[:, :WIDTH]
        has = np.take_along_axis(score, pick, 1) > -np.inf
        go = has.any(axis=1)
        active, pick, has = active[go], pick[go], has[go]
        if not len(active):
            break
        at = active[:, None]
        open_[at, pick] = False
        near = table[np.where(has, ids[at, pick], n)].reshape(len(active), k)
        fresh = ~seen[at, near]
        stamp[at, near] = place
        fresh &= stamp[at, near] == place
        seen[at, near] = True
        r, c = np.nonzero(fresh)
        like = np.full((len(active), k), -np.inf, np.float32)
        like[r, c] = np.einsum("id,id->i", padded[near[r, c]], queries[active[r]])
        all_likes = np.concatenate([likes[active], like], axis=1)
        top = np.argpartition(-all_likes, ef - 1, axis=1)[:, :ef]
        likes[active] = np.take_along_axis(all_likes, top, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), top, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], axis=1), top, 1)
    order = np.argsort(-likes, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(likes, order, 1)


def _select(vectors: np.ndarray, candidates: np.ndarray, likes: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours of each row from its candidates, best first: one is taken if it is nearer to the row than to all taken before, and free
    places go to the best that were passed over. Candidates that are no nodes have a likeness of minus infinity."""
    n = len(vectors)
    order = np.argsort(-likes, axis=1, kind="stable")[:, : 2 * m + 16]
    candidates, likes = np.take_along_axis(candidates, order, 1), np.take_along_axis(likes, order, 1)
    real = likes > -np.inf
    x = vectors[np.where(real, candidates, 0)]
    between = np.matmul(x, x.transpose(0, 2, 1))
    rows, width = candidates.shape
    closest = np.full((rows, width), -np.inf, np.float32)
    taken, count = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    for k in range(width):
        take = real[:, k] & (likes[:, k] > closest[:, k]) & (count < m)
        taken[:, k] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, k]), closest)
    rank = np.where(taken, 0, np.where(real, 1, 2)) * width + np.arange(width)
    best = np.argsort(rank, axis=1)[:, :m]
    out = np.where(np.take_along_axis(real, best, 1), np.take_along_axis(candidates, best, 1), n)
    return np.pad(out, ((0, 0), (0, max(0, m - out.shape[1]))), constant_values=n)


def _layer(vectors: np.ndarray, m: int, ef: int, start: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Links of a layer over all its vectors, inserted in batches in their order. start: for each vector, nodes to enter at (padded with n)."""
    n = len(vectors)
    links = np.full((n, m), n, np.int32)
    done = 0
    while done < n:
        size = min(BATCH, max(32, done), n - done)
        new = np.arange(done, done + size)
        q = vectors[new]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        inner[np.triu_indices(size)] = -np.inf  # earlier ones of the batch only
        keep = min(size, m)
        top = np.argpartition(-inner, keep - 1, axis=1)[:, :keep]
        cand, like = new[top], np.take_along_axis(inner, top, 1)
        if done:
            entries = np.zeros((size, 1), np.int64)
            if start is not None:
                entries = np.where(start[new] < done, start[new], done)
                entries[(entries >= done).all(axis=1), 0] = 0
            local = np.where(links[:done] < done, links[:done], done)
            found, likes = _search(local, vectors[:done], q, np.sort(entries, axis=1), ef)
            cand, like = np.concatenate([cand, found], axis=1), np.concatenate([like, likes], axis=1)
        chosen = _select(vectors, cand, like, m // 2)
        links[new, : m // 2] = chosen
        a, b = np.repeat(new, m // 2), chosen.ravel()  # the way back: b gets a
        real = b < n
        a, b = a[real], b[real]
        score = np.einsum("id,id->i", vectors[a], vectors[b])
        order = np.lexsort((-score, b))
        a, b, score = a[order], b[order], score[order]
        targets, first, counts = np.unique(b, return_index=True, return_counts=True)
        rank = np.arange(len(b)) - np.repeat(first, counts)
        a, b, rank = a[rank < m], b[rank < m], rank[rank < m]
        extra = np.full((len(targets), m), n, np.int64)
        extra[np.searchsorted(targets, b), rank] = a
        cand = np.concatenate([links[targets], extra], axis=1)
        like = np.einsum("td,tcd->tc", vectors[targets], vectors[np.where(cand < n, cand, 0)])
        like[cand >= n] = -np.inf
        links[targets] = _select(vectors, cand, like, m)
        done += size
    return links


@dataclass
class Graph:
    """vectors in insertion order; layers: their links from the bottom up; the first ``counts[k]`` vectors are in layer k."""

    vectors: np.ndarray
    layers: list[np.ndarray]
    counts: list[int]

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = 32, ef: int = 64) -> Graph:
        """Vectors are taken to be in random order, so each layer is a prefix an m-th as long as the one below."""
        vectors = np.ascontiguousarray(vectors, np.float32)
        counts = [len(vectors)]
        while counts[-1] > 4 * m:
            counts.append(counts[-1] // (m // 2))
        layers: list[np.ndarray] = []
        start = None
        for count in reversed(counts):
            layers.insert(0, _layer(vectors[:count], m, ef, start))
            if count < len(vectors):
                below = counts[len(counts) - len(layers) - 1]
                graph = cls(vectors[:count], layers[:], counts[-len(layers) :])
                start = np.concatenate([graph.search(vectors[a : min(a + BATCH, below)], 4)[0][:, :4] for a in range(0, below, BATCH)])
        return cls(vectors, layers, counts)

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ef nodes of each query, from the top layer down."""
        queries = np.ascontiguousarray(queries, np.float32)
        entries = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            n = self.counts[k]
            ids, likes = _search(self.layers[k], self.vectors[:n], queries, entries, ef if k == 0 else 16)
            entries = np.where(likes > -np.inf, ids, self.counts[max(k - 1, 0)])[:, :8]
        return ids, likes

    def to_bytes(self) -> bytes:
        """The links, without the vectors."""
        out = io.BytesIO()
        np.savez(out, counts=np.array(self.counts), **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, vectors: np.ndarray) -> Graph:
        x = np.load(io.BytesIO(data))
        counts = x["counts"].tolist()
        return cls(np.ascontiguousarray(vectors, np.float32), [x[f"layer{k}"] for k in range(len(counts))], counts)
