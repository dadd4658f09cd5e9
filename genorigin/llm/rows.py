"""Names for rows that hold whatever their ids are: null, repeated, or on different texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genorigin.operators.ranks import ranked

TIES = ("tie1", "tie2")


def tied(text: str) -> list[Column]:
    """tie1 and tie2: a 128-bit digest of a text; null is the same as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.lit(k), value).alias(name) for k, name in enumerate(TIES, 1)]


def ordered_ids(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs with __doc, a long in order of the ids, where null is above all others: the id itself and 2^63 - 1 for null. If the table has both null and that id, ids are numbered instead."""
    top, none = F.lit(2**63 - 1), F.col(doc_id).isNull()
    ends = docs.agg(F.max(F.col(doc_id).cast("long")).alias("most"), F.count_if(none).alias("none")).first()
    if ends["most"] != 2**63 - 1 or not ends["none"]:
        return docs.withColumn("__doc", F.coalesce(F.col(doc_id).cast("long"), top))
    numbered = ranked(docs.select(F.col(doc_id).cast("long").alias("__id")).where("__id is not null").distinct(), F.col("__id")).select("__id", F.col("r").alias("__doc"))
    return docs.join(numbered, F.col(doc_id).cast("long") == F.col("__id"), "left").withColumn("__doc", F.coalesce("__doc", top)).drop("__id")


def least_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the columns of wanted (tie1, tie2, ...; one row each) for the rows of the least id (null last) of each wanted text.

    Only ids are compared to choose, and texts are dealt by text and id, so a text that a third of all rows have is not gathered
    anywhere. Of rows equal in id and text one comes; they are sorted by both from the join before.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__doc"), *tied("text"), "text")
    chosen = rows.drop("text").groupBy(*TIES).agg(F.min("__doc").alias("__doc"))
    return rows.join(chosen.join(wanted, [*TIES]), [*TIES, "__doc"]).dropDuplicates([*TIES, "__doc"]).drop("__doc")
