"""Numbering rows in an order with no window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from genorigin.shared import stored


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with r, their number from 0 in this order (of rows that differ in it), and n, the number of all rows.

    Rows are dealt by ranges of the order and written, so each part is ranked by itself; the offsets of the parts are summed over a row for each part.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", *[c.alias(f"__order{k}") for k, c in enumerate(order)])
    names = [f"__order{k}" for k in range(len(order))]
    dealt = stored(keyed.repartitionByRange(parts, *names).withColumn("__part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.sum("__n").over(everything).alias("n"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*names)) - 1
    out = dealt.withColumn("__within", within).join(F.broadcast(offsets), "__part")  # a row for each part
    return out.select(*rows.columns, (F.col("__offset") + F.col("__within")).cast("long").alias("r"), "n")
