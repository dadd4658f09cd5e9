"""Collocations of two to four words, from count streams in prefix and in suffix order.

Counting. Tasks number the words of a piece of text exactly, count phrases as numbers, and hand on distinct phrases with their counts, which Spark adds up. A phrase is no more frequent than any part
of it, so words below the least count, and then pairs below it, take all phrases with them. What passes is told to the tasks by filters of bounded size, which may let a
phrase through that is too rare, but never stop one that is not; counts of what passes are exact.

Estimation. All phrases with enough occurrences stand in one stream sorted by their words from the first to the last, and in one sorted from the last to the first. Counts of single words are
merge-joined to each stream. In prefix order a phrase comes behind its beginnings and right before its extensions, so one pass that holds a row for each length gives the count of every first part of it
and of its most frequent extension to the right; the same pass in suffix order gives those of its last parts and to the left. Streams are dealt by ranges of the first (last) two words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow import map_batches, pieces, raw
from .common import shuffle_width, stored
from .hashing import mixed, word_hashes

#: Bytes of text that a task counts at once.
PIECE = 1 << 22
#: Bits of a filter for each phrase that is to pass, and at most in all.
BITS, MOST_BITS = 16, 1 << 27
#: Classes of bytes: 0 in words, 1 between words, 2 between pieces in which phrases lie.
CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, 0x09]] = 1
CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LEFT, RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Words:
    """The words of a piece of text in order: row (its number among the distinct pairs of lang and word), place (the piece in which it lies), and of each distinct pair lang, word and count."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, offsets = raw(text)
        kind = CLASS[data]
        solid = kind == 0
        first = np.append(solid, False)
        first[1:-1] &= ~solid[:-1]
        bounds = offsets[:-1][offsets[:-1] < len(data)]
        first[bounds] = np.append(solid, False)[bounds]
        starts = np.flatnonzero(first)
        last = np.append(~solid[1:], True)[: len(solid)] | first[1:]
        ends = np.flatnonzero(solid & last) + 1
        broken = kind == 2
        broken[bounds] = True
        self.place = np.cumsum(broken, dtype=np.int32)[starts]
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(LOWER[data[solid]])).dictionary_encode()
        langs = lang.fill_null("und").dictionary_encode()
        of = np.repeat(np.asarray(langs.indices).astype(np.int64), np.diff(np.searchsorted(starts, offsets)))
        size = max(1, len(words.dictionary))
        code, self.row, self.count = np.unique(of * size + np.asarray(words.indices), return_inverse=True, return_counts=True)
        self.lang, self.word = langs.dictionary.take(pa.array(code // size)), words.dictionary.take(pa.array(code % size))

    def hashes(self) -> np.ndarray:
        return hashes_of(self.lang, self.word)

    def runs(self, ok: np.ndarray, size: int) -> np.ndarray:
        """Where so many words in a row start that lie in one piece; ok holds for each start of a run of one word, or of two, whether it may be in one."""
        n = len(self.row) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        good = self.place[:n] == self.place[size - 1 :]
        for k in range(size - (len(self.row) - len(ok))):
            good &= ok[k : k + n]
        return np.flatnonzero(good)


def hashes_of(lang: pa.Array, word: pa.Array) -> np.ndarray:
    a, b = (word_hashes(data, offsets[:-1], offsets[1:]) if len(data) and (np.diff(offsets) > 0).all() else _any_hashes(x) for x in (lang, word) for data, offsets in [raw(x)])
    return mixed(a * LEFT + b * RIGHT)


def _any_hashes(column: pa.Array) -> np.ndarray:
    """For columns with empty values (a lang may be empty; a word never is)."""
    data, offsets = raw(column)
    out = np.zeros(len(column), np.uint64)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = word_hashes(data, offsets[:-1][full], offsets[1:][full])
    return out


class Filter:
    """A set of hashes in bits: says yes for all it was made of, and seldom for others."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        yield hashes & mask
        yield (hashes >> np.uint64(32) | hashes << np.uint64(32)) & mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.mask):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def build_filter(hashes: DataFrame, n: int, most_bits: int = MOST_BITS) -> Filter:
    """The filter of a table of n hashes (column hash, long). Its bits are set in tasks and united in Spark; at most so many bits come to the driver, whatever n is."""
    bits = 1 << min(most_bits.bit_length() - 1, max(16, (n * BITS).bit_length()))
    mask = np.uint64(bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column("hash")).astype(np.int64).view(np.uint64)
            at = np.concatenate([*Filter.places(h, mask)])
            value = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(value.view(np.int64))], ["at", "value"])

    set_bits = hashes.mapInArrow(run, "at long, value long").groupBy("at").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(set_bits.column("at"))] = np.asarray(set_bits.column("value")).astype(np.int64).view(np.uint64)
    return Filter(words)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (one word), a: how often each word occurs in the texts of each lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            w = Words(piece.column("text"), piece.column("lang"))
            yield pa.RecordBatch.from_arrays([w.lang.cast(pa.string()), w.word.cast(pa.string()), pa.array(w.count, pa.int64())], ["lang", "phrase", "n"])

    return map_batches(docs.select("text", "lang"), run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _pairs(w: Words, passes: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of words that both pass: where they start, which distinct pair each is, and of each distinct pair its hash and count."""
    h = w.hashes()
    at = w.runs(passes.has(h)[w.row], 2)
    code, which, count = np.unique(w.row[at] << 32 | w.row[at + 1], return_inverse=True, return_counts=True)
    return at, which, mixed(h[code >> 32] * LEFT + h[code & 0xFFFFFFFF] * RIGHT), count


def pair_hashes(docs: DataFrame, words: Filter, least: int) -> DataFrame:
    """hash: of the pairs of words that pass, those with so many occurrences at least (or that share their hash with others)."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            _, _, h, count = _pairs(Words(piece.column("text"), piece.column("lang")), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count, pa.int64())], ["hash", "n"])

    counted = map_batches(docs.select("text", "lang"), run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("hash")


def phrase_counts(docs: DataFrame, words: Filter, pairs: Filter) -> DataFrame:
    """lang, phrase, size, a: phrases of two to four words all of whose pairs pass, with their occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            w = Words(piece.column("text"), piece.column("lang"))
            at, which, h, _ = _pairs(w, sent.value[0])
            good = sent.value[1].has(h)[which] if len(at) else np.zeros(0, bool)
            pair, ok = np.zeros(max(0, len(w.row) - 1), np.int64), np.zeros(max(0, len(w.row) - 1), bool)
            pair[at], ok[at] = which, good
            for size in (2, 3, 4):
                starts = w.runs(ok, size)
                code = pair[starts] << 32 | pair[starts + size - 2]
                _, place, count = np.unique(code, return_index=True, return_counts=True)
                here = starts[place]
                parts = [w.word.take(pa.array(w.row[here + k])) for k in range(size)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                lang = w.lang.take(pa.array(w.row[here])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(here), size), pa.int32()), pa.array(count, pa.int64())], ["lang", "phrase", "size", "n"])

    rows = map_batches(docs.select("text", "lang"), run, "lang string, phrase string, size int, n long")
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"))


def frequent(docs: DataFrame, least: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: words (lang, phrase, a) and phrases (lang, phrase, size, a) of so many occurrences at least, and the number of all words of each lang (lang, n)."""
    everything = stored(word_counts(docs), "words")
    totals = everything.groupBy("lang").agg(F.sum("a").alias("n"))
    words = everything.where(F.col("a") >= least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of(batch.column("lang"), batch.column("phrase")).view(np.int64))], ["hash"])

    passes = build_filter(words.mapInArrow(hashed, "hash long"), words.count(), most_bits)
    pairs = stored(pair_hashes(docs, passes, least), "pairs")
    phrases = phrase_counts(docs, passes, build_filter(pairs, pairs.count(), most_bits)).where(F.col("a") >= least)
    return words, stored(phrases, "phrases"), totals


def _merged(rows: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """One pass over the stream of rows (order: words in reading order or from the last; two: the first two of these): {name}1 to {name}3, the counts of the first one to three of them, and
    {name}more, the highest count of a phrase longer by one."""
    order = F.col("order")
    single = words.select("lang", F.col("phrase").alias("head"), F.col("a").alias(f"{name}1"))
    dealt = rows.withColumn("head", order[0]).join(single.hint("merge"), ["lang", "head"]).withColumn("two", F.concat_ws(" ", order[0], order[1])).drop("head")
    stream = dealt.repartitionByRange(shuffle_width(rows.sparkSession), "lang", "two").sortWithinPartitions("lang", "order").drop("two", "order")
    made = [f"{name}2", f"{name}3", f"{name}more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row of two words, and of three below it: their extensions may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.zeros(batch.num_rows, np.int64)
            if held is not None:
                more = np.concatenate([np.asarray(held.column(made[2])), more])
                table = pa.Table.from_batches([held.select(batch.schema.names), batch]).combine_chunks()
                batch = table.to_batches()[0]
            size, a, here = np.asarray(batch.column("size")), np.asarray(batch.column("a")), np.arange(batch.num_rows)
            two, three = (np.maximum.accumulate(np.where(size == k, here, 0)) for k in (2, 3))
            np.maximum.at(more, two[size == 3], a[size == 3])
            np.maximum.at(more, three[size == 4], a[size == 4])
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(size > 2, a[two], 0)), pa.array(np.where(size > 3, a[three], 0)), pa.array(more)], [*batch.schema.names, *made])
            open_rows = [int(two[-1]), *([int(three[-1])] if size[three[-1]] == 3 and three[-1] > two[-1] else [])]
            rest = np.ones(batch.num_rows, bool)
            rest[open_rows] = False
            held = out.take(pa.array(open_rows))
            yield out.filter(pa.array(rest))
        if held is not None:
            yield held

    return stream.mapInArrow(run, T.StructType([*stream.schema.fields, *[T.StructField(c, T.LongType()) for c in made]]))


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases with a, l, r and score of their lowest-scoring cut (the first of equal ones), and inner: whether a longer phrase has four fifths of their occurrences."""
    forward = _merged(phrases.withColumn("order", F.split("phrase", " ")), words, "l")
    both = _merged(forward.withColumn("order", F.reverse(F.split("phrase", " "))), words, "r")
    wide = lambda c: F.col(c).cast("decimal(20,0)")

    def cut(k: int, size: int) -> F.Column:
        l, r = f"l{k}", f"r{size - k}"
        score = F.expr(f"cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast({l} as decimal(20,0)) + cast({r} as decimal(20,0))) as bigint)")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))

    best = F.when(F.col("size") == 2, cut(1, 2)).when(F.col("size") == 3, F.least(cut(1, 3), cut(2, 3))).otherwise(F.least(cut(1, 4), cut(2, 4), cut(3, 4)))
    inner = F.greatest(wide("lmore"), wide("rmore")) * 5 >= wide("a") * 4
    return both.select("lang", "phrase", "a", best.alias("best"), inner.alias("inner")).select("lang", "phrase", "a", "best.l", "best.r", "best.score", "inner")


def first_of_each(rows: DataFrame, group: str, most: int, *order: F.Column) -> DataFrame:
    """The first rows of each group in this order, with their rank from 1. Groups are dealt at random twice before, so none is sorted whole by one task."""
    width = shuffle_width(rows.sparkSession)
    rows = rows.withColumn("__deal", F.pmod(F.xxhash64(*rows.columns), F.lit(width)))
    for some in (width, math.isqrt(width)):
        rows = rows.withColumn("__deal", F.pmod("__deal", F.lit(some)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group, "__deal").orderBy(*order))).where(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.drop("__deal").withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, most_bits: int = MOST_BITS) -> DataFrame:
    """Per lang the first phrases by score: lang, rank, phrase, a, l, r, n, score.

    docs: text, lang; other columns are not read. A null text has no words, a null lang is und, repeated rows count each. Texts are lower-cased (A-Z) and split as the module's classes say; an empty
    table, or one without any phrase of so many occurrences, gives no rows.
    """
    docs = docs.select(F.col("text"), F.col("lang").cast("string").alias("lang"))
    words, phrases, totals = frequent(docs, least, most_bits)
    kept = scored(words, phrases).where("not inner").drop("inner")
    top = first_of_each(kept, "lang", most, F.desc("score"), F.desc("a"), F.asc("phrase"))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
