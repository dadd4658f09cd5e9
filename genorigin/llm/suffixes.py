"""Removal of long repeated byte strings with a suffix order built column by column.

A window is a string of ``window`` bytes of one document. Windows of a document that follow each other and share their anchor (the leftmost of the
smallest 64-byte hashes in them) form a path; equal windows have equal anchors, so a window can repeat only among the paths of
its anchor. Paths that are alone at their anchor are unique; paths that are equal as a whole repeat as a whole. What is left are anchors with
several different paths, of each of which one copy is kept: a collection of strings, each a little longer than a window. For these the
collection's Burrows-Wheeler transform is built column-wise: every round inserts one more symbol of every string, from their ends to their
starts, merges the new suffixes into the sorted ones by counting, and updates the common prefixes of neighbours from those of the round before. Transform and
common prefixes are files that each round reads from front to back and writes anew. A symbol is a run of bytes up to a delimiter, so a round inserts a word rather than a
byte; where a collection has long runs without one, more byte values become delimiters, down to single bytes. As delimiters end symbols, no symbol begins another but at
a string's end, and symbols sort as their bytes do. A window may start within a symbol: windows are sorted by the rest of that symbol and the rank of the suffix behind it, and
common prefixes of neighbours in that order tell which windows repeat.

Tasks take whole anchors, a bounded number of strings at a time. Anchors with more than ``most`` different paths (a passage in thousands of contexts)
are not held by any task: their windows are compared one by one in a Spark aggregation, with the same result.

Documents are known by a 128-bit digest of their text, so copies of a text are worked on once, whatever their ids, and count as often as they stand.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces, ragged, raw, release
from .common import shuffle_width, stored
from .hashing import SPACE, VALUES, Rolling, anchored_paths
from .rows import TIES, least_rows, tied

GRAM, SLACK, RUN = 64, 16, 96
#: Bytes of a symbol at most, rows of a block of common prefixes, and rows that are compared at once.
LONGEST, BLOCK, AT_ONCE = 48, 32, 1 << 14
PATHS = "tie1 long, tie2 long, anchor long, path1 long, path2 long, start int, windows int, offset int"
STRINGS = "tie1 long, tie2 long, anchor long, hot boolean, start int, offset int, string binary"
SPANS = "tie1 long, tie2 long, start int, stop int"


def _rolled(data: np.ndarray) -> list[Rolling]:
    return [Rolling(VALUES[k][data], k) for k in (0, 1)]


def _paths(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 19):
            data, first = raw(piece.column("text"))
            one, two = _rolled(data)
            grams = one.of(np.arange(max(0, len(data) - GRAM + 1)), GRAM)
            text, start, windows, anchor = anchored_paths(grams, first, window, GRAM)
            size = windows + window - 1
            salt = (anchor - start).astype(np.uint64) << np.uint64(32)
            tie1, tie2 = (np.asarray(piece.column(c)) for c in TIES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tie1[text]), pa.array(tie2[text]), pa.array(grams[anchor].view(np.int64)),
                    pa.array((one.of(start, size) ^ salt).view(np.int64)), pa.array((two.of(start, size) ^ salt).view(np.int64)),
                    pa.array((start - first[text]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array((anchor - start).astype(np.int32)),
                ], [*TIES, "anchor", "path1", "path2", "start", "windows", "offset"],
            )

    return run


def _strings(window: int):
    """The bytes of every listed path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 19):
            data, first = raw(piece.column("text"))
            lists = piece.column("paths")
            flat = lists.flatten()
            owner = np.repeat(np.arange(piece.num_rows), np.asarray(pa.compute.list_value_length(lists)))
            start, windows = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "windows"))
            size = windows + window - 1
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            joined = data[ragged(first[owner] + start, size)]
            strings = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.tobytes())])
            tie1, tie2 = (np.asarray(piece.column(c)) for c in TIES)
            columns = [pa.array(tie1[owner]), pa.array(tie2[owner]), flat.field("anchor"), flat.field("hot"), pa.array(start.astype(np.int32)), flat.field("offset"), strings]
            table = pa.RecordBatch.from_arrays(columns, [*TIES, "anchor", "hot", "start", "offset", "string"])
            for at in range(0, table.num_rows, 4096):
                yield table.slice(at, 4096)

    return run


def _hot_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                strings = piece.column("string")
                data = np.frombuffer(b"".join(strings.to_pylist()), np.uint8)
                size = np.asarray(pa.compute.binary_length(strings)).astype(np.int64)
                counts = size - window + 1
                owner = np.repeat(np.arange(len(size)), counts)
                begin = np.cumsum(size) - size
                here = ragged(begin, counts)
                one, two = _rolled(data)
                tie1, tie2, start = (np.asarray(piece.column(c)) for c in (*TIES, "start"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tie1[owner]), pa.array(tie2[owner]), pa.array((start[owner] + here - begin[owner]).astype(np.int32)),
                        pa.array(one.of(here, window).view(np.int64)), pa.array(two.of(here, window).view(np.int64)),
                    ], [*TIES, "start", "window1", "window2"],
                )
        release()

    return run


class Column:
    """An array in a file, read from front to back and written anew over what was there."""

    def __init__(self, folder: str, name: str, kind: type):
        self.file, self.kind, self.size = open(os.path.join(folder, name), "w+b", buffering=0), kind, 0  # noqa: SIM115

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.kind, self.size)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        left = memoryview(np.ascontiguousarray(values, self.kind)).cast("B")
        while left:
            left = left[self.file.write(left) :]
        self.size = len(values)

    def close(self) -> None:
        self.file.close()


def _merged(old: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """old with new at the places ``at`` (sorted) of the result."""
    out = np.empty(len(old) + len(new), old.dtype)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[at] = new
    out[keep] = old
    return out


@dataclass
class Symbols:
    """The strings as symbols: where each starts and ends, its code (from 1, in order of bytes), and each string's number of symbols; size and bytes (padded) by code."""

    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray
    table: np.ndarray

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bytes that two different symbols have in common at their start."""
        out = np.empty(len(a), np.int64)
        for at in range(0, len(a), AT_ONCE):
            x, y = a[at : at + AT_ONCE], b[at : at + AT_ONCE]
            differ = self.table[x] != self.table[y]  # the last byte is the size, so some byte does
            out[at : at + AT_ONCE] = np.minimum(differ.argmax(axis=1), np.minimum(self.sizes[x], self.sizes[y]))
        return out


def split_symbols(data: np.ndarray, sizes: np.ndarray, longest: int) -> Symbols:
    """Cut every string behind each delimiter. Delimiters are white space and, until no symbol has over ``longest`` bytes, the most frequent byte of those that do."""
    delimiter = SPACE.copy()
    last = np.cumsum(sizes) - 1
    while True:
        stop = delimiter[data]
        stop[last] = True
        ends = np.flatnonzero(stop) + 1
        starts = np.concatenate([[0], ends[:-1]])
        length = ends - starts
        long = length > longest
        if not long.any():
            break
        inside = data[ragged(starts[long], length[long] - 1)]
        delimiter[np.bincount(inside, minlength=256).argmax()] = True
    padded = np.zeros((len(starts), longest + 1), np.uint8)
    padded[np.repeat(np.arange(len(starts)), length), ragged(np.zeros(len(starts), np.int64), length)] = data
    padded[:, longest] = length
    names, codes = np.unique(padded.view(np.dtype((np.void, longest + 1))).ravel(), return_inverse=True)
    table = np.concatenate([np.zeros((1, longest + 1), np.uint8), names.view(np.uint8).reshape(-1, longest + 1)])
    counts = np.diff(np.concatenate([[0], np.searchsorted(ends, last + 1, "right")]))
    return Symbols(starts, ends, (codes + 1).astype(np.uint16 if len(names) < 65535 else np.uint32), counts, table[:, longest].astype(np.int64), table)


class RangeMin:
    """The least of values[low] to values[high], by blocks, for many ranges at once."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.values = np.full(blocks * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        self.values[: len(values)] = values
        self.levels = [self.values.reshape(blocks, BLOCK).min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= blocks:
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), self.values.dtype)
        for at in range(0, len(low), AT_ONCE):
            out[at : at + AT_ONCE] = self._of(low[at : at + AT_ONCE], high[at : at + AT_ONCE])
        return out

    def _of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        within = np.arange(BLOCK)
        a, b = low // BLOCK, high // BLOCK
        left = np.minimum(low[:, None] + within, np.minimum(high, a * BLOCK + BLOCK - 1)[:, None])
        right = np.maximum(high[:, None] - within, np.maximum(low, b * BLOCK)[:, None])
        out = np.minimum(self.values[left].min(axis=1), self.values[right].min(axis=1))
        wide = np.flatnonzero(b - a > 1)
        if len(wide):
            first, count = a[wide] + 1, b[wide] - a[wide] - 1
            level = np.frexp(count.astype(float))[1] - 1
            for k in np.unique(level).tolist():
                mine = level == k
                w, f, c, row = wide[mine], first[mine], count[mine], self.levels[k]
                out[w] = np.minimum(out[w], np.minimum(row[f], row[f + c - (1 << k)]))
        return out


def suffix_order(symbols: Symbols, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The rank of the suffix from every symbol on among all suffixes of these strings, and the bytes each rank has in common with the one before.

    Round t inserts the suffix of t symbols of every string that has one. With the rows' preceding symbols at hand, the new row of a suffix
    c + s is the number of suffixes with a first symbol before c, and of the rows before that of s whose preceding symbol is c. So rows that follow each other there and begin with the same
    symbol come from rows of the old order, and have that symbol and the least common prefix between those in common.
    Strings' ends are different and in the strings' order. Ranks come from the finished transform, by the same step for all strings at once.
    """
    codes, counts, sizes = symbols.codes, symbols.counts, symbols.sizes
    n, ends = len(counts), np.cumsum(counts)
    transform, prefixes = Column(folder, "transform", codes.dtype.type), Column(folder, "prefixes", np.uint32)
    transform.write(codes[ends - 1])  # rows of the empty suffixes
    prefixes.write(np.zeros(n, np.uint32))
    row, active = np.arange(n), np.arange(n)
    for t in range(1, int(counts.max()) + 1):
        longer = counts[active] >= t
        active, row = active[longer], row[longer]
        old, common = transform.read(), prefixes.read()
        order = np.argsort(old, kind="stable")[np.count_nonzero(old == 0) :]
        place = np.empty(len(old), np.int64)
        place[order] = np.arange(len(order))
        sort = np.argsort(place[row])
        active, new = active[sort], place[row[sort]]
        asked = np.union1d(new, new + 1)  # the new rows and those that follow them
        asked = asked[(asked > 0) & (asked < len(order))]
        p, q = order[asked - 1], order[asked]
        value, same = np.zeros(len(asked), np.uint32), old[p] == old[q]
        value[same] = sizes[old[q[same]]] + RangeMin(common).of(p[same] + 1, q[same])
        value[~same] = symbols.common(old[p[~same]], old[q[~same]])
        row = n + new
        previous = np.where(counts[active] > t, codes[np.maximum(ends[active] - t - 1, 0)], 0)
        transform.write(_merged(old, row, previous.astype(old.dtype)))
        common = _merged(common, row, np.zeros(len(row), np.uint32))
        common[n + asked] = value
        prefixes.write(common)
    step = np.empty(len(codes) + n, np.int64)
    step[np.argsort(transform.read(), kind="stable")] = np.arange(len(step))
    common = prefixes.read()
    transform.close()
    prefixes.close()
    rank = np.empty(len(codes), np.int64)
    row, active = np.arange(n), np.arange(n)
    for t in range(1, int(counts.max()) + 1):
        longer = counts[active] >= t
        active, row = active[longer], step[row[longer]]
        rank[ends[active] - t] = row
    return rank, common


def likely(data: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of strings in which a window may be shared: the string, its first byte there, and its size.

    anchors: the place of each string's anchor in it. Windows are taken in ranges of SLACK by how far they reach to the left of the anchor; all windows of a range have the bytes around
    the anchor in common that even the least of them has. Only ranges where another string has the same such bytes can share a window.
    Parts of more than RUN windows are cut into several, so no collection has rounds for a few long strings only.
    """
    rolled = Rolling(VALUES[0][data])
    begin = np.cumsum(sizes) - sizes
    furthest = np.minimum(anchors, window - GRAM)  # of the first window to the left
    nearest = np.maximum(anchors - (sizes - window), 0)  # of the last window
    lo, hi = nearest // SLACK, furthest // SLACK
    owner = np.repeat(np.arange(len(sizes)), hi - lo + 1)
    k = ragged(lo, hi - lo + 1)
    right = np.maximum(window - GRAM - (k + 1) * SLACK + 1, 0)
    core = rolled.of(begin[owner] + anchors[owner] - k * SLACK, k * SLACK + GRAM + right) ^ k.astype(np.uint64)
    _, where, times = np.unique(core, return_inverse=True, return_counts=True)
    keep = times[where] > 1
    owner, k = owner[keep], k[keep]
    if not len(owner):
        return owner, owner, owner
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (k[1:] != k[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    who = owner[first]
    start = anchors[who] - np.minimum((k[last] + 1) * SLACK - 1, furthest[who])
    stop = anchors[who] - np.maximum(k[first] * SLACK, nearest[who]) + window
    windows = stop - start - window + 1
    parts = -(-windows // RUN)
    again = np.repeat(np.arange(len(who)), parts)
    at = ragged(np.zeros(len(who), np.int64), parts) * RUN
    return who[again], start[again] + at, np.minimum(windows[again] - at, RUN) + window - 1


def repeated_windows(data: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """The places of windows that also start elsewhere in these strings, none of which is shorter than a window."""
    symbols = split_symbols(data, sizes, max(1, min(LONGEST, window // 4)))
    with tempfile.TemporaryDirectory() as folder:
        rank, common = suffix_order(symbols, folder)
    at = ragged(np.cumsum(sizes) - sizes, sizes - window + 1)
    symbol = np.searchsorted(symbols.starts, at, "right") - 1
    tail = symbols.ends[symbol] - at  # less than a window, so another symbol follows
    key, behind = Rolling(VALUES[0][data]).of(at, tail), rank[symbol + 1]
    order = np.lexsort((behind, key))
    at, tail, key, behind = at[order], tail[order], key[order], behind[order]
    near = np.flatnonzero((key[1:] == key[:-1]) & (tail[1:] == tail[:-1]))
    near = near[tail[near] + RangeMin(common).of(behind[near] + 1, behind[near + 1]) >= window]
    hit = np.zeros(len(at), bool)
    for k in range(0, len(near), AT_ONCE):  # the tails were compared by hash; now by their bytes
        a = near[k : k + AT_ONCE]
        within = np.minimum(np.arange(int(tail[a].max())), tail[a][:, None] - 1)
        a = a[(data[at[a][:, None] + within] == data[at[a + 1][:, None] + within]).all(axis=1)]
        hit[a] = hit[a + 1] = True
    return np.sort(at[hit])


def _by_columns(window: int, budget: int):
    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        tie1, tie2, start, offset = (np.asarray(table.column(c)) for c in (*TIES, "start", "offset"))
        strings = table.column("string").combine_chunks()
        sizes = np.asarray(pa.compute.binary_length(strings)).astype(np.int64)
        first = np.frombuffer(strings.buffers()[1], np.int32, 1, strings.offset * 4)[0]
        data = np.frombuffer(strings.buffers()[2], np.uint8, int(sizes.sum()), int(first))
        again = np.zeros(len(start), bool)  # the same string, of a row that stands more than once
        again[1:] = (tie1[1:] == tie1[:-1]) & (tie2[1:] == tie2[:-1]) & (start[1:] == start[:-1])
        if again.any():
            data, keep = data[ragged((np.cumsum(sizes) - sizes)[~again], sizes[~again])], ~again
            tie1, tie2, start, offset, sizes = tie1[keep], tie2[keep], start[keep], offset[keep], sizes[keep]
        who, first, size = likely(data, sizes, offset.astype(np.int64), window)
        tie1, tie2, start = tie1[who], tie2[who], start[who] + first
        begin = np.cumsum(size) - size
        at = np.zeros(0, np.int64)
        if len(who):
            at = repeated_windows(data[ragged((np.cumsum(sizes) - sizes)[who] + first, size)], size, window)
        owner = np.searchsorted(begin, at, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(at))[: len(head)] - 1
        who = owner[head]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(tie1[who], pa.int64()), pa.array(tie2[who], pa.int64()), pa.array((start[who] + at[head] - begin[who]).astype(np.int32)),
                pa.array((start[who] + at[last] - begin[who] + window).astype(np.int32)),
            ], [*TIES, "start", "stop"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = np.asarray(batch.column("anchor"))
            ends = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("string"))).astype(np.int64))
            new = np.ones(len(anchors), bool)
            new[1:] = anchors[1:] != anchors[:-1]
            new[0] = last is not None and anchors[0] != last
            at, done = 0, 0
            for head in np.flatnonzero(new).tolist():  # where another anchor begins
                here = int(ends[head - 1]) if head else 0
                if size + here - done >= budget:
                    if head > at:
                        held.append(batch.slice(at, head - at))
                    yield finish(held)
                    release()
                    held, size, at, done = [], 0, head, here
            held.append(batch.slice(at))
            size, last = size + int(ends[-1]) - done, anchors[-1]
        if held:
            yield finish(held)
        release()

    return run


def repeated_spans(docs: DataFrame, window: int = 400, most: int = 2000, budget: int = 1 << 20) -> DataFrame:
    """Spans of bytes covered by windows that also start anywhere else: (tie1, tie2, start, stop), by text; spans of one text may overlap."""
    texts = docs.select(*tied("text"), "text")
    paths = stored(texts.mapInArrow(_paths(window), PATHS), "all-paths")
    path = F.struct("path1", "path2")
    anchors = paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("p"), F.max(path).alias("q")).where("n > 1")
    anchors = stored(anchors.select("anchor", (F.col("p") < F.col("q")).alias("branches")), "anchors")
    found = paths.join(anchors, "anchor")
    same = [F.first(c).alias(c) for c in found.columns if c not in (*TIES, "start")]
    repeated = stored(found.groupBy(*TIES, "start").agg(*same, F.count(F.lit(1)).alias("rows")), "paths")
    branching = repeated.where("branches")
    classes = stored(
        branching.groupBy("anchor", "path1", "path2").agg(F.sum("rows").alias("copies"), F.min(F.struct(*TIES, "start", "windows", "offset")).alias("one")), "classes"
    )
    large = stored(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("anchor", F.lit(True).alias("hot")), "large")
    copied = branching.join(classes.where("copies > 1").select("anchor", "path1", "path2"), ["anchor", "path1", "path2"])
    whole = repeated.where("not branches").unionByName(copied.select(*repeated.columns))
    span = whole.select(*TIES, "start", (F.col("start") + F.col("windows") + F.lit(window - 1)).alias("stop"))
    hot = F.coalesce("hot", F.lit(False)).alias("hot")
    ones = classes.join(large, "anchor", "left").select("one.tie1", "one.tie2", F.struct("one.start", "one.windows", "one.offset", "anchor", hot).alias("path"))
    listed = ones.groupBy(*TIES).agg(F.collect_list("path").alias("paths"))
    sources = least_rows(docs, listed).select(*TIES, "text", "paths")
    strings = stored(sources.mapInArrow(_strings(window), STRINGS), "strings")
    dealt = strings.where("not hot").drop("hot").repartition(shuffle_width(docs.sparkSession), "anchor").sortWithinPartitions("anchor", *TIES, "start")
    by_columns = dealt.mapInArrow(_by_columns(window, budget), SPANS)
    hot = strings.where("hot").mapInArrow(_hot_windows(window), "tie1 long, tie2 long, start int, window1 long, window2 long")
    place = F.struct(*TIES, "start")
    shared = hot.groupBy("window1", "window2").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p < q").select("window1", "window2")
    by_window = hot.join(shared, ["window1", "window2"]).select(*TIES, "start", (F.col("start") + window).alias("stop"))
    return span.unionAll(by_columns).unionAll(by_window)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        data, first = raw(piece.column("text"))
        lists = piece.column("spans")
        flat, sizes = lists.flatten(), np.asarray(pa.compute.list_value_length(lists).fill_null(0))
        begin = first[:-1][np.repeat(np.arange(piece.num_rows), sizes)]
        cover = np.zeros(len(data) + 1, np.int64)
        for field, by in (("start", 1), ("stop", -1)):
            np.add.at(cover, begin + np.asarray(flat.field(field)), by)
        gone = np.cumsum(cover[:-1]) > 0
        edge = gone.copy()  # first bytes of removed runs
        edge[1:] &= ~gone[:-1]
        starts = first[:-1][first[:-1] < len(data)]
        edge[starts] = gone[starts]
        total, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
        removed = np.diff(total[first])
        n_bytes = np.diff(first)
        offsets = np.concatenate([[0], np.cumsum(n_bytes - removed)]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~gone].tobytes())])
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), kept, pa.array(n_bytes), pa.array(removed), pa.array(np.diff(runs[first]))], CUT.names
        )


CUT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("kept", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
)


def cut_repeats(docs: DataFrame, window: int = 400, most: int = 2000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, kept, n_bytes, n_removed, n_spans.

    Every byte that a ``window``-byte string covers which also starts anywhere else, in the same document too, is removed, the first place included; strings are judged on
    the input and never cross rows. kept has the bytes that stay, which may end within a character. Null texts count as empty. Every row is a document of its
    own, whatever its id, so of repeated rows each repeats the others. Other columns are not read; an empty table gives no rows.
    """
    spans = repeated_spans(docs, window, most).groupBy(*TIES).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *tied("text"), "text").join(spans, [*TIES], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut, CUT)
