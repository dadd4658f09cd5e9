"""Rows sifted by a filter of hashes before a join, so that those without a partner are not shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collocations import build_filter


def sifted(rows: DataFrame, value: Column, hashes: DataFrame) -> DataFrame:
    """The rows whose value (a long, not null) is in hashes (column hash, long), and seldom others: a join with hashes must follow.

    The bits of the filter are bounded and broadcast; hashes should be a stored table, as it is read twice.
    """
    words = build_filter(hashes, hashes.count()).words.view(np.int64)
    mask = len(words) * 64 - 1
    bits = F.broadcast(rows.sparkSession.createDataFrame([(words.tolist(),)], "__bits array<long>"))
    turned = F.shiftrightunsigned("__value", 32).bitwiseOR(F.shiftleft("__value", 32))
    held = rows.withColumn("__value", value).withColumn("__one", F.col("__value").bitwiseAND(F.lit(mask))).withColumn("__two", turned.bitwiseAND(F.lit(mask)))
    has = lambda at: F.expr(f"(shiftrightunsigned(__bits[cast(shiftrightunsigned({at}, 6) as int)], cast({at} & 63 as int)) & 1) = 1")
    return held.join(bits, has("__one") & has("__two"), "left_semi").drop("__value", "__one", "__two")
