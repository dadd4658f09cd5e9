"""What a step leaves on disk: no shuffle files of tables that are stored, and no tables that nothing reads any more."""

import os

from pyspark.sql import functions as F

from genorigin import shared
from genorigin.llm import debruijn


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_stored(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    before = shuffle_files(spark)
    table = shared.stored(rows.join(rows.groupBy("k").count().hint("merge"), "k"), "joined")
    assert not shuffle_files(spark) - before and table.count() == 1000
    assert spark.conf.get(shared.CLEANUP) == "false"
    assert rows.groupBy("k").count().count() == 7  # other queries keep theirs until they are collected


def test_one_stored_table_is_dropped_alone(spark):
    one, two = shared.stored(spark.range(3), "one"), shared.stored(spark.range(4), "two")
    assert shared.drop_stored(spark, one) == 1
    assert not os.path.exists(one._genorigin_path.removeprefix("file://")) and two.count() == 4


def test_substring_dedup_keeps_no_pieces(spark):
    """Pieces and edges are read for the last time when repeats are known; spans are right without them."""
    passage = " ".join(f"p{i}" for i in range(120))
    docs = spark.createDataFrame([(1, "a b c " + passage), (2, passage + " d e"), (3, "x " + passage + " y")], "doc_id long, text string")
    spark.sparkContext._genorigin_stored = []
    cut = {r.doc_id: (r.n_removed, r.kept) for r in debruijn.dedup_substrings(docs).collect()}
    assert cut == {1: (0, "a b c " + passage), 2: (120, "d e"), 3: (120, "x y")}
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in spark.sparkContext._genorigin_stored}
    assert "repeated" in left and not left & {"anchors", "pieces", "firsts", "known", "edges", "shared"}
