"""All pairs within groups, in blocks of bounded size.

A group is dealt into blocks of about ``most`` members by a hash; every two of its blocks, and each with itself, are
a block pair with a key of its own, so a group of any size is spread over many tasks and none holds more than two blocks at once.
Tasks stream over block pairs sorted by key, and compare the members of many small ones together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, release
from .common import shuffle_width


def block_pairs(rows: DataFrame, group: str, member: str, most: int = 512) -> DataFrame:
    """rows with the columns block (the key of a block pair) and side (0: first block, 1: second, 2: both are the same), for groups of two or more."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    n = F.ceil(F.col("__n") / F.lit(most)).cast("int")
    dealt = rows.join(sizes, group).withColumn("__blocks", n).withColumn("__mine", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    low, high = F.least("__mine", "__other"), F.greatest("__mine", "__other")
    side = F.when(F.col("__mine") == F.col("__other"), 2).when(F.col("__mine") == low, 0).otherwise(1)
    key = F.concat_ws("/", F.col(group).cast("string"), low, high)
    return dealt.withColumn("block", key).withColumn("side", side).drop("__n", "__blocks", "__mine", "__other")


def pairs_of(codes: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by block code, all i < j to compare: of one block if it is paired with itself, else across the two sides.

    A block pair of two different blocks also has its rows within one side left out here, as the pair of that block with itself has them.
    """
    n = len(codes)
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if n else np.zeros(0, np.int64)
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    counts = np.arange(n) - begin
    j = np.repeat(np.arange(n), counts)
    i = np.arange(len(j)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    keep = (sides[i] == 2) | (sides[i] != sides[j])
    return i[keep], j[keep]


def run_blocks(rows: DataFrame, member: str, work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, width: int = 2048) -> DataFrame:
    """Apply work(members, i, j) to the rows of whole block pairs, some ``width`` rows at a time, with the pairs to compare.

    The rows of a block pair come in order of member, so forests of overlapping groups agree on the members that they choose as roots.
    """
    n = shuffle_width(rows.sparkSession)
    dealt = rows.repartition(n, "block").sortWithinPartitions("block", member)

    def finish(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        codes = np.asarray(table.column("block").combine_chunks().dictionary_encode().indices) if table.num_rows else np.zeros(0, int)
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        stops = np.append(starts[1:], table.num_rows)
        at = 0
        while at < len(starts):  # whole blocks, until their rows or pairs are enough
            to, cost = at, 0
            while to < len(starts) and (to == at or (stops[to] - starts[at] <= width and cost + (stops[to] - starts[to]) ** 2 <= 500_000)):
                cost += (stops[to] - starts[to]) ** 2
                to += 1
            part = table.slice(int(starts[at]), int(stops[to - 1] - starts[at])).combine_chunks()
            i, j = pairs_of(codes[starts[at] : stops[to - 1]], np.asarray(part.column("side")))
            if len(i):
                yield work(part, i, j)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, width)
                at += piece.num_rows
                if size >= width:  # give out all blocks that have ended before this piece's last one began
                    last = held[-1].column("block")[held[-1].num_rows - 1].as_py()
                    blocks = piece.column("block")
                    more = 0
                    while more < piece.num_rows and blocks[more].as_py() == last:
                        more += 1
                    if more:
                        held.append(piece.slice(0, more))
                        size += more
                    if more < piece.num_rows:
                        yield from finish(held)
                        held, size = [], 0
                    piece = piece.slice(more)
                if piece.num_rows:
                    held.append(piece)
                    size += piece.num_rows
        if held:
            yield from finish(held)
        release()

    return map_batches(dealt, run, schema)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of these links: each member and the least member it is linked to, directly or not."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (step := root[root]).tolist() != root.tolist():
            root = step
    mine = np.flatnonzero(root != np.arange(n))
    return mine, root[mine]
