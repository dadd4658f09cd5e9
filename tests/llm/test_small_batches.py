"""Tasks get texts in small batches, and what the Jaccard join compares moves once."""

import pyarrow as pa

from genorigin.llm import arrow, bpe, jaccard, langid


def test_batches_are_small(spark):
    """8,000 texts of 3,000 characters in one partition come in batches of some 4 MB; a limit that has been set stays."""
    docs = spark.range(8000, numPartitions=1).selectExpr("id", "repeat('x', 3000) text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    spark.conf.unset(arrow.BATCH_BYTES)
    sizes = [r.n for r in arrow.map_batches(docs, run, "n long").collect()]
    assert sum(sizes) == 8000 and max(sizes) * 3000 < 5_000_000
    spark.conf.unset(arrow.BATCH_BYTES)
    langid.identify(docs, langid.train(["one two"], ["en"]))
    assert spark.conf.get(arrow.BATCH_BYTES) == arrow.SMALL
    spark.conf.set(arrow.BATCH_BYTES, "1m")
    bpe.encode(docs, "")
    assert spark.conf.get(arrow.BATCH_BYTES) == "1m"
    spark.conf.unset(arrow.BATCH_BYTES)


def test_only_names_are_dealt_into_blocks(spark, monkeypatch):
    """Signatures and shingles are joined once the blocks are known, so they are not shuffled for the sizes of groups."""
    dealt, seen = jaccard.block_pairs, []

    def watched(rows, *args):
        seen.append(set(rows.columns))
        return dealt(rows, *args)

    monkeypatch.setattr(jaccard, "block_pairs", watched)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, text), (4, "other words")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.component_id) for r in jaccard.join_similar(docs).collect()}
    assert got == {1: (1, 2, 1), 2: (2, 2, 1), 3: (1, 2, 1), 4: (4, 0, 4)}
    assert len(seen) == 2 and not any({"signature", "shingles"} & s for s in seen)
