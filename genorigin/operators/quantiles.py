"""Exact order statistics in passes over the rows, none of which gathers all values.

A pass summarises the values that are still in question by a mergeable sketch (approximate percentiles, a hundred of them) and so narrows the bracket of values around each wanted rank; the next one counts
what lies below and within. When few values lie strictly within the bracket, they are counted by value and the rank is looked up. Values that are repeated any number of times are one value with a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genorigin.shared import stored

#: Steps of the sketch, its accuracy (one over the error of a rank), and the values strictly within a bracket that a task may hold.
STEPS, ACCURACY, FEW = 100, 10_000, 100_000


def exact_quantiles(rows: DataFrame, column: str, shares: list[float], keys: list[str] | None = None, few: int = FEW) -> DataFrame:
    """For each group of keys: keys, n and q, an array of the quantiles at these shares, interpolated between the two values around share x (n - 1). Nulls are not counted; a group of only nulls is left out.

    The keys may be null. Values are doubles; NaN is larger than all others.
    """
    by = [f"__key{k}" for k in range(len(keys or []))] or ["__key"]
    named = [F.col(c).alias(b) for c, b in zip(keys or [], by, strict=False)] or [F.lit(0).alias("__key")]
    values = rows.select(*named, F.col(column).cast("double").alias("__v")).where("__v is not null")
    every = values.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    share = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("__p", "__share")
    state = every.select(*by, "__n", "__lo", "__hi", share).withColumn("__rank", F.col("__share") * (F.col("__n") - 1))
    state = stored(state.select("*", F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__within"), F.col("__n").alias("__inner")), "brackets")

    def bracketed(state: DataFrame) -> DataFrame:
        """The values that lie in each bracket."""
        told = state.select(*[F.col(b).alias(f"{b}s") for b in by], "__p", "__lo", "__hi")
        same = [F.col(b).eqNullSafe(F.col(f"{b}s")) for b in by]
        told = told if keys else F.broadcast(told)  # a row for each share
        return values.join(told, [*same, F.col("__v") <= F.col("__hi")]).select(*by, "__p", "__v", "__lo", "__hi")

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        told = b.select(*[F.col(c).alias(f"{c}s") for c in [*by, "__p"]], *[c for c in b.columns if c not in (*by, "__p")])
        return a.join(told, [F.col(c).eqNullSafe(F.col(f"{c}s")) for c in [*by, "__p"]]).drop(*[f"{c}s" for c in [*by, "__p"]])

    while state.where((F.col("__inner") > few) & (F.col("__lo") < F.col("__hi"))).limit(1).count():
        inside = bracketed(state).where("__v >= __lo")
        sketch = inside.groupBy(*by, "__p").agg(F.percentile_approx("__v", [k / STEPS for k in range(STEPS + 1)], ACCURACY).alias("__q"))
        at = lambda what: (F.col("__rank") - F.col("__below")) / F.col("__within") * STEPS if what == "low" else (F.col("__rank") + 1 - F.col("__below")) / F.col("__within") * STEPS
        low, high = F.floor(at("low")) - 1, F.ceil(at("high")) + 1
        lo = F.when(low >= 0, F.get("__q", low.cast("int"))).otherwise(F.col("__lo"))
        hi = F.when(high <= STEPS, F.get("__q", high.cast("int"))).otherwise(F.col("__hi"))
        narrowed = joined(state, sketch).withColumns({"__lo": lo, "__hi": hi}).drop("__q", "__below", "__within", "__inner")
        counts = bracketed(narrowed).groupBy(*by, "__p").agg(
            F.count_if(F.expr("__v < __lo")).alias("__below"), F.count_if(F.expr("__v >= __lo")).alias("__within"), F.count_if(F.expr("__v > __lo and __v < __hi")).alias("__inner")
        )
        after = stored(joined(narrowed, counts).select(*state.columns), "brackets")
        if after.agg(F.sum("__inner")).first()[0] >= state.agg(F.sum("__inner")).first()[0]:
            raise RuntimeError("brackets do not narrow")  # cannot be: a step leaves at most a few hundredths of what is inside
        state = after

    counted = bracketed(state).where("__v >= __lo").groupBy(*by, "__p", "__v").agg(F.count(F.lit(1)).alias("__c"))
    listed = counted.groupBy(*by, "__p").agg(F.array_sort(F.collect_list(F.struct("__v", "__c"))).alias("__list"))
    found = joined(state, listed)

    def value(rank: F.Column) -> F.Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda acc, x: F.struct((acc["seen"] + x["__c"]).alias("seen"), F.when(acc["v"].isNull() & (acc["seen"] + x["__c"] > rank), x["__v"]).otherwise(acc["v"]).alias("v"))
        return F.aggregate("__list", start, step, lambda acc: acc["v"])

    index = lambda f: (f("__rank") - F.col("__below")).cast("long")
    found = found.withColumns({"__a": value(index(F.floor)), "__b": value(index(F.ceil))})
    part = F.col("__rank") - F.floor("__rank")
    quantile = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") + part * (F.col("__b") - F.col("__a")))
    out = found.select(*by, "__n", "__p", quantile.alias("__value")).groupBy(*by, "__n").agg(F.array_sort(F.collect_list(F.struct("__p", "__value"))).alias("q"))
    return out.select(*[F.col(b).alias(c) for b, c in zip(by, keys or [], strict=False)], F.col("__n").alias("n"), F.col("q")["__value"].alias("q"))
