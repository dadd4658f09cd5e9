"""Mixing sources to target weights as a time-varying curriculum.

Each source has a target number of words and a weight schedule over training time t in [0, 1]: its weight at t is
``target * (1 + lean * (1 - 2 t))``. A source with a positive lean falls, one with a negative lean rises. Leans go from the first source to the last in equal steps, are shifted so that
the targets weighted by them cancel, and scaled so that the steepest has the size ``ramp``: so the weights of all sources add up to the same at any
time, and t is the share of all words that come before. The integral of a schedule up to t is the words of the source due by then; inverting it turns a
document's place in its source's cumulative words into a training position, and documents are range-sorted by that.

Places come from a keyed order (a digest of id and text), never from the order of rows, so reruns agree. The running sum is in three levels:
documents fall into buckets by the leading bits of their key, bucket sums are summed over per source in two steps of half the bits each, and
only the documents of one bucket meet in a window. So a source that holds a third of all rows is spread over as many buckets
as any other range of keys. Rows that are equal in id, text and source are counted before, and are one row with a number in that window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_width, stored, word_count

#: Weights repeat over the sources in order.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, ramp: float = 0.5) -> DataFrame:
    """Targets and schedules for sizes (source, size): (source, source_size, target, lean).

    Sources are ordered by code point with null last, and get the weights in turn. They share ``share`` times all
    words by weight; none gets more than ``most`` times its size, and the excess is shared again by weight until none is above.
    That fixed point has a closed form: with the sources in order of cap / weight, those before the first whose cap
    exceeds its part of what is left are at their caps. The windows here run once over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    number = F.row_number().over(named)
    ranked = by_source.select(
        "*", F.element_at(cycle, F.pmod(number - 1, F.lit(len(weights))).cast("int") + 1).alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"),
        (F.count(F.lit(1)).over(everything) + 1 - 2 * number).alias("turn"),
    )
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    place = F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("none"), "source", "level")
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), place)).over(everything)
    shared = level.withColumn("shared", first["level"])
    cap = F.col("cap").cast("double")
    final = shared.withColumn("target", F.when(F.col("shared").isNull(), cap).otherwise(F.least(cap, F.col("shared") * F.col("weight"))))
    exact = lambda c: c.cast("decimal(38,0)")
    due = F.floor("target")
    off = F.col("turn").cast("double") * F.sum(exact(due)).over(everything).cast("double") - F.sum(exact(due * F.col("turn"))).over(everything).cast("double")
    leaning = final.withColumn("off", off)
    steepest = F.max(F.abs("off")).over(everything)
    lean = F.when(steepest > 0, F.lit(float(ramp)) * F.col("off") / steepest).otherwise(F.lit(0.0))
    return leaning.select("source", "source_size", "target", lean.alias("lean"))


def schedule_time(share: Column, lean: Column) -> Column:
    """The time t at which a schedule that goes from 1 + lean to 1 - lean has handed out this share of its target: share = t (1 + lean) - lean t²."""
    a = F.lit(1.0) + lean
    return F.lit(2.0) * share / (a + F.sqrt(F.greatest(a * a - F.lit(4.0) * lean * share, F.lit(0.0))))


def words_due(time: Column, target: Column, lean: Column) -> Column:
    """The integral of a schedule from 0 to this time."""
    return target * (time * (F.lit(1.0) + lean) - lean * time * time)


def _keys() -> list[Column]:
    """key: a digest of id and text, which orders a source's documents; named: the source, never null."""
    text = F.md5(F.coalesce("text", F.lit("")))
    return [F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)).alias("key"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named")]


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, ramp: float = 0.5, key_bits: int = 16) -> DataFrame:
    """One row for the rows of docs that are equal in id, text and source: key, named, doc_id, source, size, n (rows), source_size, target, due, lean, begin (words of the source before the first of them)."""
    rows = docs.select(*_keys(), "doc_id", "source", word_count(F.col("text")).alias("size"))
    slim = rows.groupBy("key", "named").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count(F.lit(1)).alias("n"))
    slim = stored(slim.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - key_bits)), "sizes")
    words = F.col("size") * F.col("n")
    buckets = slim.groupBy("named", "bucket").agg(F.first("source").alias("source"), F.sum(words).alias("size"))
    past = (Window.unboundedPreceding, -1)
    high = F.shiftright("bucket", key_bits // 2)
    upper = buckets.groupBy("named", high.alias("high")).agg(F.sum("size").alias("size"))
    upper = upper.select("named", "high", F.coalesce(F.sum("size").over(Window.partitionBy("named").orderBy("high").rowsBetween(*past)), F.lit(0)).alias("above"))
    run = Window.partitionBy("named", "high").orderBy("bucket").rowsBetween(*past)
    lower = buckets.withColumn("high", high).select("named", "high", "bucket", F.coalesce(F.sum("size").over(run), F.lit(0)).alias("within"))
    starts = lower.join(upper, ["named", "high"]).select("named", "bucket", (F.col("above") + F.col("within")).alias("start"))
    targets = source_targets(buckets, weights, share, most, ramp).withColumn("named", _keys()[1]).drop("source")
    placed = slim.join(starts.join(targets, "named"), ["named", "bucket"])
    within = Window.partitionBy("named", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("start") + F.coalesce(F.sum(words).over(within), F.lit(0))
    return placed.withColumn("begin", begin).withColumn("due", F.floor("target")).drop("bucket", "start")


def _passes(begin: Column, most: int) -> Column:
    """An array of (number, time, words) for each pass over its source in which words of a document are due: the time of its first word, and the integral of the source's schedule from there to the time of
    its last word, or of the last word due. Both times invert the schedule at whole words, so the integral is a whole number, up to some 10^14 words of a source."""
    lean, target = F.col("lean"), F.col("target")

    def used(k: int) -> Column:
        first = begin + F.lit(k) * F.col("source_size")
        time = lambda words: schedule_time(words / target, lean)
        words = words_due(time(F.least(first + F.col("size"), F.col("due"))), target, lean) - words_due(time(first), target, lean)
        use = F.struct(F.lit(k).alias("number"), time(first).alias("time"), F.rint(words).cast("long").alias("words"))
        return F.when((F.col("size") > 0) & (first < F.col("due")), use)

    return F.array_compact(F.array(*[used(k) for k in range(most)]))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, ramp: float = 0.5) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, lean, taken, position, begin; range-sorted by position, documents that are not used at the end.

    docs: (doc_id, text, source). taken counts words, repeats included: each source runs through its documents in keyed order up to
    ``most`` times until its target (rounded down) is met, so only the document at the end is taken in part: they are what the source's schedule hands out between the times at which the document's
    first and last words are due, in every pass. position is the training time of a document's first use, null if it is not used. Sizes of null and empty texts are 0 and take 0. A null source is a
    source. Null or repeated ids are told apart by a digest of the text; rows that are equal in id, text and source follow each other, and each is taken by itself.
    An empty table gives no rows. Other columns are not read.
    """
    each = plan(docs, weights, share, most, ramp).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    placed = each.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size")).withColumn("passes", _passes(F.col("begin"), most))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    placed = placed.withColumn("taken", taken).withColumn("position", F.try_element_at("passes", F.lit(1))["time"])
    order = [F.col("position").asc_nulls_last(), "key", "named", "copy"]
    dealt = placed.drop("passes").repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "size", "source", "source_size", "target", "lean", "taken", "position", "begin")


def curriculum(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, ramp: float = 0.5) -> DataFrame:
    """The documents in training order, once for every pass in which they are used, with all their columns.

    A later pass is placed by its own words in the cumulative demand. Rows that are equal in id, text and source are used as
    often as the mix takes words of each of them, and have the other columns of the one among them with the least hash; a document of which only a part is due is used whole.
    """
    cols = docs.columns
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    rows = docs.select(*_keys(), F.struct("*").alias("__row"), order.alias("__order")).groupBy("key", "named").agg(F.min_by("__row", "__order").alias("__row"))
    each = plan(docs, weights, share, most, ramp).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    uses = each.withColumn("use", F.explode(_passes(F.col("begin") + F.col("copy") * F.col("size"), most)))
    timed = uses.select("key", "named", F.col("use.time").alias("time"), F.col("use.number").alias("pass"), "copy")
    order = ["time", "key", "named", "pass", "copy"]
    dealt = rows.join(timed, ["key", "named"]).repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select(*[F.col(f"__row.`{c}`").alias(c) for c in cols])
