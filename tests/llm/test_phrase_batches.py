"""Collocations count texts in small batches, with the same result whatever their size."""

from genorigin.llm import arrow, collocations


def test_phrases_are_counted_in_small_batches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    spark.conf.unset(arrow.BATCH_BYTES)
    want = sorted(map(tuple, collocations.collocations(docs, least=5, most=50).collect()))
    assert spark.conf.get(arrow.BATCH_BYTES) == arrow.SMALL
    spark.conf.set(arrow.BATCH_BYTES, "2k")
    got = sorted(map(tuple, collocations.collocations(docs, least=5, most=50).collect()))
    spark.conf.unset(arrow.BATCH_BYTES)
    assert want and got == want
