"""Main text of web pages by differencing with the pages of the nearest URLs.

Each page becomes the lines that its markup does not exclude (``page_lines``). Pages of a host are ordered by their path, segment by segment, so pages under one
folder are neighbours; of pages of a host with the same lines one is compared. A page is paired with the nearest three on either side, the lines of each pair are aligned by
their longest common subsequence, and lines that are shared are the site's template and are deleted:

- where the markup names no article or main element, lines shared with half or more of the three nearest by path; a pair that shares nine tenths of a page is one of copies and says nothing;
- within an article or main element, only lines at its end, or at its start (the headline aside), shared with every one of the pairs, four at least, so that a passage that articles have in common
  stays; a pair that shares half of a page says nothing.

Pages are numbered in that order over all hosts and dealt into blocks of neighbours with the three before and behind, so a host of any size is spread, and a task holds one block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genorigin.operators.ranks import ranked

from .arrow import pieces, release
from .common import shuffle_width, stored
from .page_lines import main_lines
from .url_rules import url_host, url_path

#: Pages that a task compares at once, and how many before and behind each are its neighbours.
BLOCK, SIDE = 64, 3


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of a with each beginning of b, by adding whole rows as bits of one number."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list, b: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of two lists, in memory that grows with the lists (halves of a are split at the best place in b)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                out.append((i, b.index(a[i], k, m)))
            continue
        half = (i + j) // 2
        split = k + int((_lengths(a[i:half], b[k:m]) + _lengths(a[half:j][::-1], b[k:m][::-1])[::-1]).argmax())
        todo += [(i, half, k, split), (half, j, split, m)]
    return sorted(out)


def shared_lines(a: list, b: list) -> tuple[list[int], list[int]]:
    """The places of the shared lines in a and in b."""
    both = {*a} & {*b}
    at, bt = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    pairs = common([a[i] for i in at], [b[j] for j in bt])
    return [at[i] for i, _ in pairs], [bt[j] for _, j in pairs]


def packed(text: str) -> bytes:
    """Text as it is dealt: better compressed than an exchange would do."""
    return zlib.compress(text.encode("utf-8", "replace"), 6)


def unpacked(data: bytes) -> str:
    return zlib.decompress(data).decode()


def digest_of(host: str, kind: str, lines: list[str]) -> str | None:
    """Tells apart pages of different hosts or lines; null without lines."""
    return hashlib.blake2b("\0".join([host, kind, *lines]).encode("utf-8", "replace"), digest_size=16).hexdigest() if lines else None


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def fingerprints(pages: DataFrame) -> DataFrame:
    """host, path, kind, digest (see ``digest_of``), and a hash and the length of each line, of the pages with any line; row is a number of its own for each."""
    rows = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            got = [main_lines(x) for x in piece.column("html").to_pylist()]
            hosts = piece.column("host").to_pylist()
            made = [
                pa.array([k for k, _ in got], pa.string()), pa.array([digest_of(h, k, x) for h, (k, x) in zip(hosts, got, strict=True)], pa.string()),
                pa.array([[_line_hash(y) for y in x] for _, x in got], pa.list_(pa.int64())), pa.array([[len(y) for y in x] for _, x in got], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([piece.column("host"), piece.column("path"), *made], ["host", "path", "kind", "digest", "hashes", "sizes"])

    found = rows.mapInArrow(run, "host string, path string, kind string, digest string, hashes array<long>, sizes array<int>")
    return found.where("digest is not null").withColumn("row", F.monotonically_increasing_id())


def _near(a: list[str], b: list[str]) -> int:
    """How many segments two paths have in common from the start."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def differenced(block: list[dict]) -> Iterator[tuple[str, list[int]]]:
    """digest and places of the deleted lines of those of the block's own pages that have any; block: rows in order with host, path, kind, hashes, sizes and own."""
    shares: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    paths = [x["path"].split("/") for x in block]

    def pair(i: int, j: int) -> list[int]:
        low, high = min(i, j), max(i, j)
        if (low, high) not in shares:
            shares[low, high] = shared_lines(block[low]["hashes"], block[high]["hashes"])
        return shares[low, high][i > j]

    def told(i: int, j: int, most: float) -> bool:
        return all(sum(block[x]["sizes"][k] for k in pair(x, y)) < most * sum(block[x]["sizes"]) for x, y in ((i, j), (j, i)))

    for i, page in enumerate(block):
        if not page["own"]:
            continue
        marked = page["kind"] in ("article", "main")
        near = [j for j in range(max(0, i - SIDE), min(len(block), i + SIDE + 1)) if j != i and page["host"] and block[j]["host"] == page["host"]]
        near = [j for j in near if told(i, j, 0.5 if marked else 0.9)]
        near = near if marked else sorted(near, key=lambda j: (-_near(paths[i], paths[j]), abs(i - j), j))[:3]
        seen = np.zeros(len(page["hashes"]), int)
        for j in near:
            seen[pair(i, j)] += 1
        if marked:
            every = (seen == len(near)) & (len(near) >= 4)
            gone = np.minimum.accumulate(every[::-1])[::-1]
            gone[1:] |= np.minimum.accumulate(every[1:])
        else:
            gone = (2 * seen >= len(near)) & bool(near)
        if gone.any():
            yield page["digest"], np.flatnonzero(gone).tolist()


def template_lines(pages: DataFrame) -> DataFrame:
    """digest, cut: of every distinct page that shares template lines with its neighbours, the places of these lines. Only hashes and lengths of lines are compared."""
    found = stored(fingerprints(pages), "pages")
    distinct = found.groupBy("host", "digest").agg(F.min(F.struct("path", "row")).alias("first")).select("host", "digest", "first.path", "first.row")
    placed = ranked(distinct, F.col("host"), F.split("path", "/"), F.col("digest")).drop("n")
    block, at = F.floor(F.col("r") / BLOCK), F.col("r") % BLOCK
    near = F.when(at < SIDE, F.array(block, block - 1)).when(at >= BLOCK - SIDE, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = placed.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == block)
    rows = dealt.join(found.select("row", "kind", "hashes", "sizes"), "row").select("block", "r", "host", "path", "digest", "own", "kind", "hashes", "sizes")
    sorted_rows = rows.repartition(shuffle_width(pages.sparkSession), "block").sortWithinPartitions("block", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            cuts = list(differenced(held))
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in cuts], pa.string()), pa.array([c for _, c in cuts], pa.list_(pa.int32()))], ["digest", "cut"])

        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                for row in batch.slice(k, BLOCK).to_pylist():
                    if held and row["block"] != held[0]["block"]:
                        yield done()
                        held = []
                    held.append(row)
        if held:
            yield done()
        release()

    return sorted_rows.mapInArrow(run, "digest string, cut array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html; other columns are not read).

    Null and empty pages, and pages without a line outside of what is left out, have an empty text. A url without host is paired with none. Equal pages of a host have equal texts, and rows that are
    repeated come as often. An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    ids = list(rows.schema.fields[:2])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            got = [main_lines(x) for x in piece.column("html").to_pylist()]
            digests = [digest_of(h, k, x) for h, (k, x) in zip(piece.column("host").to_pylist(), got, strict=True)]
            made = [pa.array(digests, pa.string()), pa.array([packed("\n".join(x)) for _, x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), *made], ["page_id", "url", "digest", "data"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                some, texts = batch.slice(k, BLOCK), []
                for data, cut in zip(some.column("data").to_pylist(), some.column("cut").to_pylist(), strict=True):
                    lines, gone = unpacked(data).split("\n"), {*(cut or ())}
                    texts.append(" ".join(x for i, x in enumerate(lines) if i not in gone))
                made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), *made], ["page_id", "url", "text", "n_chars"])

    packed_rows = rows.mapInArrow(read, T.StructType([*ids, T.StructField("digest", T.StringType()), T.StructField("data", T.BinaryType())]))
    both = packed_rows.join(template_lines(pages), "digest", "left").select("page_id", "url", "data", "cut")
    return both.mapInArrow(kept, T.StructType([*ids, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
