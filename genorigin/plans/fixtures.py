"""Genotype-like tables derived from the embeddings table: samples with coordinates, and calls.

Each has a Spark form, with no join or shuffle, and the same definition as DuckDB SQL in ``genorigin.sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as doubles. A small table comes in a file or two; its rows are dealt to all cores, as each makes many calls."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cores = spark.sparkContext.defaultParallelism
    if e.rdd.getNumPartitions() < cores:
        e = e.repartition(cores)
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.concat(F.lit("s"), "vec_id").alias("sampleid"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sampleid, x, y; every tenth has no coordinates."""
    known = F.col("vec_id") % 10 != 0
    axis = lambda k: F.when(known, 25 + 60 * F.col("e")[k])
    return _vectors(spark, sf_dir).select("sampleid", axis(0).alias("x"), axis(1).alias("y"))


def _alleles(a0: Column, a1: Column) -> Column:
    return F.array(a0.cast("int"), a1.cast("int"))


def calls_wide(spark: SparkSession, sf_dir: str, many: bool = False) -> DataFrame:
    """2,080 sites with missing calls, sites of one allele and of three: sampleid, chrom, position, alleles. With many, also alleles up to 5, allele 200 and half calls."""
    pairs = F.array(*[F.lit(i * WIDTH + j) for i in range(WIDTH) for j in range(i, WIDTH)])
    rows = _vectors(spark, sf_dir).select("vec_id", "sampleid", "e", F.explode(pairs).alias("k"))
    k = F.col("k")
    v = F.col("e")[(k / WIDTH).cast("int")] * F.col("e")[k % WIDTH] * 8
    drawn = lambda what: F.substring(F.md5(F.concat(F.lit(f"{what}|"), "vec_id", F.lit("|"), "k")), 1, 2) == "00"
    rows = rows.select("sampleid", "k", v.alias("v"), drawn("miss").alias("missing"), (drawn("half") if many else F.lit(False)).alias("half"))
    v = F.col("v")
    a0 = F.when(F.col("missing"), -1).when(F.lit(many) & (k % 19 == 0) & (v > 0.15), F.when(k % 38 == 0, 200).otherwise(3 + k % 3))
    a0 = a0.when(k % 13 == 0, 0).when(v > 0.1, F.when((k % 17 == 0) & (v > 0.2), 2).otherwise(1)).otherwise(0)
    a1 = F.when(F.col("missing") | F.col("half"), -1).when(k % 13 == 0, 0).when(v > 0.02, 1).otherwise(0)
    return rows.select("sampleid", F.lit("1").alias("chrom"), ((k + 1) * 1000).cast("long").alias("position"), _alleles(a0, a1).alias("alleles"))


def calls_cline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """512 sites whose alleles follow the components of the vectors, so that coordinates can be learned; none missing."""
    rows = _vectors(spark, sf_dir).select("sampleid", F.posexplode("e").alias("pos", "v"))
    rows = rows.select("sampleid", "pos", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    thr = (F.col("t") - 4) * F.lit(4e-2)
    a0, a1 = (F.col("v") > thr).cast("int"), (F.col("v") > thr + F.lit(5e-2)).cast("int")
    position = ((F.col("pos") * 8 + F.col("t") + 1) * 1000).cast("long")
    return rows.select("sampleid", F.lit("1").alias("chrom"), position.alias("position"), _alleles(a0, a1).alias("alleles"))
