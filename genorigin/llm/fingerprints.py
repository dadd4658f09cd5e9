"""Document fingerprints by content-defined chunking.

A 32-bit gear hash (each step shifts by one bit and adds the byte's fixed number) depends on the last 32 bytes only. A chunk ends where the hash has
``strict`` leading zero bits, before the normal size, or ``loose`` ones after it (normalised chunking), and at ``largest`` bytes
at the latest. No chunk is shorter than 32 bytes, so the hash at a boundary depends on the chunk alone, and text
inserted or cut moves the boundaries near it only. The fingerprint is the set of chunk digests with their lengths, as fixed-width hex in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow import pieces
from .common import shuffle_width
from .hashing import VALUES, Rolling

WINDOW, NORMAL, LARGEST, STRICT, LOOSE = 32, 96, 256, 7, 5
GEAR = (VALUES[1] >> np.uint64(32)).astype(np.uint32)
#: Hex digits of one chunk: 12 of its digest, 2 of its length less one.
WIDTH = 14
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: A row without an id counts as the one with the smallest.
NO_ID = -(2**63)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At every byte, the sum over the last 32 bytes of their numbers, each shifted by its distance; five doubling steps."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def chunk(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start of every chunk of the texts, and the first chunk of each text (n + 1 numbers)."""
    n = len(data)
    h = gear_hash(data)

    def following(bits: int) -> np.ndarray:
        """For every place, the first place from there on where the hash allows an end."""
        at = np.full(n + LARGEST + 2, n + LARGEST, np.int64)
        hit = np.flatnonzero(h < np.uint32(1 << (32 - bits)))
        at[hit] = hit
        return np.minimum.accumulate(at[::-1])[::-1]

    strict, loose, here = following(STRICT), following(LOOSE), np.arange(n)
    a, b = strict[here + WINDOW - 1], loose[here + NORMAL - 1]
    end = np.where(a < here + NORMAL - 1, a + 1, np.minimum(b + 1, here + LARGEST))
    starts, first = [], [0]
    for at, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while at < stop:
            starts.append(at)
            at = end.item(at)
        first.append(len(starts))
    return np.array(starts, np.int64), np.array(first, np.int64)


def fingerprint_batch(texts: list[str]) -> list[str]:
    """The fingerprint of each text; equal texts have equal ones, and an empty text an empty one."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    starts, first = chunk(data, offsets)
    if not len(starts):
        return [""] * len(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    stops = np.append(starts[1:], len(data))
    stops = np.minimum(stops, offsets[1:][owner])
    size = stops - starts
    code = (Rolling(VALUES[0][data]).of(starts, size) >> np.uint64(16)) << np.uint64(8) | (size - 1).astype(np.uint64)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[new], owner[new]
    digits = (code[:, None] >> (np.arange(WIDTH - 1, -1, -1, dtype=np.uint64) * np.uint64(4))) & np.uint64(15)
    out = HEX[digits.astype(np.uint8)].tobytes().decode()
    ends = np.cumsum(np.bincount(owner, minlength=len(texts))) * WIDTH
    return [out[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def likeness(a: str, b: str) -> float:
    """How much of the first text is in the second: the length of its chunks that both have, over that of all its chunks.

    1 if the fingerprints are equal, else 0 if either is empty.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    other = {b[i : i + WIDTH] for i in range(0, len(b), WIDTH)}
    total = shared = 0
    for i in range(0, len(a), WIDTH):
        x = a[i : i + WIDTH]
        size = int(x[-2:], 16) + 1
        total += size
        shared += size * (x in other)
    return shared / total


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the column fingerprint (replaced if there); null counts as empty."""
    keep = [f for f in docs.schema.fields if f.name != "fingerprint"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            prints = fingerprint_batch([x or "" for x in piece.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(prints, pa.string())], [*names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the row with the next smaller doc_id, for the smallest that of the largest.

    Rows are in order of id, then of a hash of their text (rows equal in both in any order), and dealt by ranges of that order, four for each shuffle partition; an id that fills several ranges is split among them by
    the hash. The last row of each range is also dealt to the range above, so a window within each range finds every neighbour.
    """
    keyed = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tie"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    ranges = 4 * shuffle_width(docs.sparkSession)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    cuts = ids.agg(F.percentile_approx("doc", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    times = {b: cuts.count(b) for b in sorted(set(cuts))}
    bounds = list(times)
    if bounds:  # binary search: the number of bounds below the id
        table = F.array(*[F.lit(b) for b in bounds])
        steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
        below = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(0),
            lambda at, s: F.when((at + s <= len(bounds)) & (F.element_at(table, F.least(at + s, F.lit(len(bounds)))) < F.col("doc")), at + s).otherwise(at),
        )
        parts = F.element_at(F.array(*map(F.lit, times.values())), F.least(F.col("below") + 1, F.lit(len(bounds))))
        on = (F.col("below") < len(bounds)) & (F.element_at(table, F.least(F.col("below") + 1, F.lit(len(bounds)))) == F.col("doc")) & (parts > 1)
        place = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * parts), parts - 1)
        here = F.col("below").cast("long") * 2 * (ranges + 1) + F.when(on, ranges + 1 + place).otherwise(0)
        keyed = keyed.withColumn("below", below).withColumn("range", here.cast("long")).drop("below")
    else:
        keyed = keyed.withColumn("range", F.lit(0).cast("long"))
    last = keyed.groupBy("range").agg(F.max(F.struct("doc", "tie", "salt")).alias("last"))
    everything = Window.orderBy("range")  # a row for each range
    above = F.coalesce(F.lead("range").over(everything), F.first("range").over(everything))
    sent = last.select(above.alias("to"), "last.doc", "last.tie", "last.salt")
    copies = keyed.drop("range").join(F.broadcast(sent), ["doc", "tie", "salt"]).select("doc_id", "text", "doc", "tie", "salt", F.col("to").alias("range"), F.lit(0).alias("own"))
    rows = keyed.withColumn("own", F.lit(1)).unionByName(copies)
    order = Window.partitionBy("range").orderBy("own", "doc", "tie", "salt")
    return rows.withColumn("next_text", F.lag("text").over(order)).where("own = 1").select("doc_id", "text", "next_text")


EDITED = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): its fingerprint, an edited text with its fingerprint, and how much of the text is in that and in the next document.

    The edited text replaces the last third of the code points (rounded down) by as many of the first of the next document, or all it
    has. Null texts count as empty, a null id as the smallest; a table of one row is its own next. An empty table gives no rows, other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 19):
            texts, following = piece.column("text").to_pylist(), [x or "" for x in piece.column("next_text").to_pylist()]
            edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts, following, strict=True)]
            distinct = list({*texts, *following, *edited})
            known = dict(zip(distinct, fingerprint_batch(distinct), strict=True))
            own, changed, other = ([known[x] for x in xs] for xs in (texts, edited, following))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(edited, pa.string()), pa.array(own, pa.string()), pa.array(changed, pa.string()),
                    pa.array(map(likeness, own, changed), pa.float64()), pa.array(map(likeness, own, other), pa.float64()),
                ], ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, EDITED)
