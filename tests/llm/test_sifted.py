"""Rows without a partner in a join are not shuffled for it."""

from pyspark.sql import functions as F

from genorigin.llm import jaccard
from genorigin.llm.sifted import sifted


def test_sifted_loses_no_row_and_keeps_few_others(spark):
    rows = spark.range(-5000, 5000).withColumn("v", F.xxhash64("id"))
    wanted = rows.where("id % 50 = 0").select(F.col("v").alias("hash"))
    kept = {r.id for r in sifted(rows, F.col("v"), wanted).collect()}
    assert kept >= {k for k in range(-5000, 5000) if k % 50 == 0} and len(kept) < 400
    assert sifted(rows, F.col("v"), wanted.where("false")).count() == 0 and sifted(rows, F.col("v"), wanted).columns == ["id", "v"]


def test_texts_that_are_compared_with_none_are_not_dealt(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard, "sifted", lambda rows, value, hashes: seen.append((set(rows.columns), sifted(rows, value, hashes))) or seen[-1][1])
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, text + " more"), (None, text + " more"), (3, text)] + [(k, f"alone {k} " + " ".join(f"x{k}y{i}" for i in range(20))) for k in range(4, 200)]
    got = {r.doc_id: (r.class_id, r.n_links, r.component_id) for r in jaccard.join_similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == got[3] == (1, 3, 1) and got[2] == got[None] == (2, 3, 1) and all(got[k] == (k, 0, k) for k in range(4, 200))
    dealt = [rows for columns, rows in seen if "text" in columns]
    assert len(dealt) == 1 and dealt[0].count() < 20
