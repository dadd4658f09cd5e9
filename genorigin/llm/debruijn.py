"""Substring dedup by De Bruijn compaction over tokens.

Every ``window`` (50) words in a row are an edge of the De Bruijn graph of the corpus, from the node of its first 49 words to that of its last 49. Keeping an
edge per word would shuffle the corpus many times over, so edges are dealt by a minimizer and compacted before the first shuffle: consecutive
edges of a document that share their anchor (the leftmost of the smallest 16-word hashes in them) form one piece, known
by the hash of its whole word sequence and by the nodes at its two ends. Equal edges have equal anchors wherever they stand, so an edge can only repeat among pieces with its anchor:

* an anchor with one piece everywhere does not branch: all its occurrences repeat as a whole;
* at an anchor that branches, each piece is first compared as a whole with the same piece elsewhere. Only in the
  document that has a piece first can single edges still be repeats of an edge of another piece; for these the source
  coordinates are joined to their document, the piece is expanded into its edges, and a join compares edges with edges.

What repeats is then a graph of pieces. A join of the pieces that end in a node with those that begin in it gives the nodes where exactly one comes in and one goes out; along
these, pieces are compacted into unitigs by joins that double their way every round. The occurrences of a unitig in a document that follow
each other, with the same source, are one span with source coordinates. Hashes propose these spans and words confirm them: a digest of the words at the span's place is compared with one of the words at its source.

Rows are known by id and a 128-bit digest of the text, so rows without id and ids on several texts are told apart, and repeated rows are worked on once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow import pieces, ragged, raw, release
from .common import drop_stored, stored
from .hashing import Rolling, anchored_paths, word_hashes, word_spans
from .rows import TIES, ordered_ids, tied

KEY = ("doc", *TIES)
PLACE = "doc long, tie1 long, tie2 long, start int"
PIECES = f"{PLACE}, edges int, anchor long, path1 long, path2 long, node1 long, node2 long"
EDGES = f"{PLACE}, path1 long, path2 long, node1 long, node2 long"
PRINTS = f"{PLACE}, stop int, print binary"


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs if "__doc" in docs.columns else ordered_ids(docs.select("doc_id", "text"))
    return docs.select(F.col("__doc").alias("doc"), *tied("text"), "text")


def _rolled(piece: pa.RecordBatch) -> tuple[np.ndarray, list[Rolling]]:
    data, offsets = raw(piece.column("text"))
    starts, ends, first = word_spans(data, offsets)
    return first, [Rolling(word_hashes(data, starts, ends, k), k) for k in (0, 1)]


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64)) for c in columns]


def _pieces(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            first, (one, two) = _rolled(piece)
            n = int(first[-1])
            grams = one.of(np.arange(max(0, n - k + 1)), k)
            text, start, edges, anchor = anchored_paths(grams, first, window, k)
            size = edges + window - 1
            salt = (anchor - start).astype(np.uint64) << np.uint64(32)
            key = [pa.array(np.asarray(piece.column(c))[text]) for c in KEY]
            places = [pa.array((start - first[text]).astype(np.int32)), pa.array(edges.astype(np.int32))]
            hashes = _longs(grams[anchor], one.of(start, size) ^ salt, two.of(start, size) ^ salt, one.of(start, window - 1), one.of(start + edges, window - 1))
            yield pa.RecordBatch.from_arrays([*key, *places, *hashes], [*KEY, "start", "edges", "anchor", "path1", "path2", "node1", "node2"])

    return run


def _edges(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            first, (one, two) = _rolled(piece)
            lists = piece.column("pieces")
            flat = lists.flatten()
            owner = np.repeat(np.arange(piece.num_rows), np.asarray(pa.compute.list_value_length(lists)))
            start, edges = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "edges"))
            owner = np.repeat(owner, edges)
            at = ragged(start, edges)
            here = at + first[owner]
            key = [pa.array(np.asarray(piece.column(c))[owner]) for c in KEY]
            hashes = _longs(one.of(here, window), two.of(here, window), one.of(here, window - 1), one.of(here + 1, window - 1))
            yield pa.RecordBatch.from_arrays([*key, pa.array(at.astype(np.int32)), *hashes], [*KEY, "start", "path1", "path2", "node1", "node2"])

    return run


def _joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each with a space behind, and where each begins there (one number more)."""
    size = ends - starts + 1
    begins = np.concatenate([[0], np.cumsum(size)])
    at = ragged(starts, size)
    at[begins[1:] - 1] = len(data)
    return np.append(data, np.uint8(0x20))[at], begins


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of the words of every span asked for."""
    for piece in pieces(batches, "text"):
        data, offsets = raw(piece.column("text"))
        starts, ends, first = word_spans(data, offsets)
        words, begins = _joined_words(data, starts, ends)
        lists = piece.column("spans")
        flat = lists.flatten()
        owner = np.repeat(np.arange(piece.num_rows), np.asarray(pa.compute.list_value_length(lists)))
        start, stop = (np.asarray(flat.field(c)) for c in ("start", "stop"))
        a, b = begins[first[owner] + start].tolist(), begins[first[owner] + stop].tolist()
        view = memoryview(np.ascontiguousarray(words))
        prints = pa.array([hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(a, b, strict=True)], pa.binary())
        key = [pa.array(np.asarray(piece.column(c))[owner]) for c in KEY]
        yield pa.RecordBatch.from_arrays([*key, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), prints], [*KEY, "start", "stop", "print"])
    release()


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row of each key, whose text goes on; rows come sorted by the key from the join before."""
    return rows.dropDuplicates([*KEY])


def repeated_pieces(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """The pieces that also start in a document with a smaller id: doc, tie1, tie2, start, edges, path1, node1, node2, and source, the place (doc, tie1, tie2, start) where the piece
    starts first."""
    keyed = _keyed(docs)
    found = keyed.mapInArrow(_pieces(window, k), PIECES)
    place = F.struct(*KEY, "start").alias("source")
    path = F.struct("path1", "path2")
    anchors = found.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(path).alias("p"), F.max(path).alias("q")).where("least < most")
    anchors = stored(anchors.select("anchor", (F.col("p") < F.col("q")).alias("branches")), "anchors")
    several = stored(found.join(anchors, "anchor"), "pieces")
    firsts = stored(several.groupBy("anchor", "path1", "path2").agg(F.min(place).alias("source")), "firsts")
    known = stored(several.join(firsts, ["anchor", "path1", "path2"]), "known")
    drop_stored(docs.sparkSession, anchors, several, firsts)
    columns = [*KEY, "start", "edges", "path1", "node1", "node2", "source"]
    whole = known.where("doc > source.doc").select(columns)
    own = known.where("branches and doc = source.doc")
    sources = own.groupBy(*KEY).agg(F.collect_set(F.struct("start", "edges")).alias("pieces"))
    edges = stored(_one_of_each(keyed.join(sources, [*KEY])).mapInArrow(_edges(window), EDGES), "edges")
    shared = edges.groupBy("path1", "path2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(place).alias("source")).where("least < most")
    shared = stored(shared.select("path1", "path2", "source"), "shared")
    single = edges.join(shared, ["path1", "path2"]).where("doc > source.doc").withColumn("edges", F.lit(1))
    repeated = stored(whole.unionByName(single.select(columns)), "repeated")
    drop_stored(docs.sparkSession, known, edges, shared)
    return repeated


def unitigs(repeated: DataFrame, rounds: int = 60) -> DataFrame:
    """(piece, unitig): the unitig of every repeated piece that others continue without a branch, known by its first piece, or by the least if it is a circle.

    Pieces are the edges of a graph over the nodes at their ends. Two pieces are joined where one alone ends in a node and one alone begins in it. In every round a piece takes over the
    way of the piece that it points to, so ways double; pieces whose way has reached the first piece are settled and not written again.
    """
    distinct = repeated.groupBy(F.col("path1").alias("piece")).agg(F.first("node1").alias("node1"), F.first("node2").alias("node2"))
    outgoing = distinct.groupBy(F.col("node1").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.first("piece").alias("piece"))
    incoming = distinct.groupBy(F.col("node2").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.first("piece").alias("before"))
    links = stored(incoming.join(outgoing, "node").where("n_in = 1 and n_out = 1 and piece <> before").select("piece", "before"), "links")
    first = links.select(F.col("before").alias("piece")).join(links.select("piece"), "piece", "left_anti")
    done = stored(first.select("piece", F.lit(None).cast("long").alias("next"), F.col("piece").alias("least"), F.col("piece").alias("head")), "unitigs")
    left = links.select("piece", F.col("before").alias("next"), F.least("piece", "before").alias("least"), F.col("before").alias("head"))
    n = None
    for _ in range(rounds):
        to = done.unionByName(left).select(F.col("piece").alias("to"), F.col("next").alias("further"), F.col("least").alias("lower"), F.col("head").alias("end"))
        new = left.join(to, left["next"] == to["to"]).select("piece", F.col("further").alias("next"), F.least("least", "lower").alias("least"), F.col("end").alias("head"), (F.col("lower") < F.col("least")).alias("fell"))
        new = stored(new, "unitigs")
        counts = new.agg(F.count("next").alias("n"), F.count_if(F.col("fell")).alias("fell")).first()
        done, left = done.unionByName(new.where("next is null").drop("fell")), new.where("next is not null").drop("fell")
        if not counts["n"] or (counts["n"] == n and not counts["fell"]):
            return done.select("piece", F.col("head").alias("unitig")).unionByName(left.select("piece", F.col("least").alias("unitig")))
        n = counts["n"]
    raise RuntimeError("unitigs did not settle")


def compacted(repeated: DataFrame, window: int) -> DataFrame:
    """Spans of words (doc, tie1, tie2, start, stop) and the place of the same words in their source: consecutive occurrences of a unitig's pieces with one source and one distance from it."""
    tigs = unitigs(repeated)
    placed = repeated.join(tigs, repeated["path1"] == tigs["piece"], "left").withColumn("unitig", F.coalesce("unitig", "path1"))
    placed = placed.select(*KEY, "start", (F.col("start") + F.col("edges")).alias("end"), "unitig", F.struct("source.doc", "source.tie1", "source.tie2").alias("source"), (F.col("start") - F.col("source.start")).alias("off"))
    by = Window.partitionBy(*KEY, "unitig", "source", "off").orderBy("start")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    parted = placed.withColumn("new", F.when(F.col("start") <= F.max("end").over(past), 0).otherwise(1))
    parted = parted.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parted.groupBy(*KEY, "unitig", "source", "off", "run").agg(F.min("start").alias("start"), (F.max("end") + F.lit(window - 1)).alias("stop"))
    return runs.select(*KEY, "start", "stop", "source", (F.col("start") - F.col("off")).alias("at")).distinct()


def verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words are the words at their source."""
    source: list[Column] = [F.col(f"source.{c}").alias(c) for c in KEY]
    length = F.col("stop") - F.col("start")
    asked = spans.select(*KEY, "start", "stop").union(spans.select(*source, F.col("at").alias("start"), (F.col("at") + length).alias("stop")))
    lists = asked.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    prints = stored(_one_of_each(_keyed(docs).join(lists, [*KEY])).mapInArrow(_prints, PRINTS), "prints")
    mine = spans.join(prints, [*KEY, "start", "stop"]).select(*KEY, "start", "stop", F.struct(*source, F.col("at").alias("start"), (F.col("at") + length).alias("stop"), "print").alias("p"))
    theirs = prints.select(F.struct(*KEY, "start", "stop", "print").alias("p"))
    return mine.join(theirs, "p").select(*KEY, "start", "stop")


def repeated_spans(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """Spans of words that also start in a document with a smaller id: (doc, tie1, tie2, start, stop), spans of one document may overlap."""
    return verified(docs, stored(compacted(repeated_pieces(docs, window, k), window), "spans"))


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, offsets = raw(piece.column("text"))
            starts, ends, first = word_spans(data, offsets)
            lists = piece.column("spans")
            flat, sizes = lists.flatten(), np.asarray(pa.compute.list_value_length(lists).fill_null(0))
            begin = first[:-1][np.repeat(np.arange(piece.num_rows), sizes)]
            cover = np.zeros(len(starts) + 1, np.int64)
            for field, by in (("start", 1), ("stop", -1)):
                np.add.at(cover, begin + np.asarray(flat.field(field)), by)
            kept = np.cumsum(cover[:-1]) == 0
            n_words = np.diff(first)
            total = np.concatenate([[0], np.cumsum(kept)])
            n_kept = np.diff(total[first])
            out, begins = _joined_words(data, starts[kept], ends[kept])
            begins = begins[np.concatenate([[0], np.cumsum(n_kept)])]
            keep = np.ones(len(out), bool)
            keep[begins[1:][n_kept > 0] - 1] = False
            bounds = begins - np.concatenate([[0], np.cumsum(n_kept > 0)])
            text = pa.Array.from_buffers(
                pa.string(), piece.num_rows, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(out[keep].tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), text, pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64))], names
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, k: int = 16) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, kept, n_words, n_removed.

    kept has the words of the text, joined by single spaces, without those in a run of ``window`` words that also starts
    in a document with a smaller id; windows are judged on the input. Null and empty texts, and texts of white space, have no words and keep an
    empty string. A null id counts as the largest. Rows that share an id are never repeats of each other, and each is cut by its own text. Other columns
    are not read; an empty table gives no rows.
    """
    docs = ordered_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = repeated_spans(docs, window, k).groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = docs.select("doc_id", F.col("__doc").alias("doc"), *tied("text"), "text").join(spans, [*KEY], "left")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    )
    rows = cut.select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(schema.names), schema)
