"""Alleles and dosages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genorigin.shared import stored


def alleles_from_dosage(dosage: Column) -> Column:
    """0, 1, 2 copies of allele 1 as a pair of alleles; null otherwise."""
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return F.when(dosage == 0, pair(0, 0)).when(dosage == 1, pair(1, 0)).when(dosage == 2, pair(1, 1))


def dosage_from_alleles(alleles: Column) -> Column:
    """Copies of the allele with index 1 (other alternatives do not count); a missing call has none."""
    return allele_copies(alleles, 1)


def allele_copies(alleles: Column, allele: int) -> Column:
    """How often an allele is in a call. Removing it and comparing sizes stays in generated code, which a lambda would leave."""
    return F.size(alleles) - F.size(F.array_remove(alleles, F.lit(allele)))


def is_missing_call(alleles: Column) -> Column:
    """Whether any allele is negative (or null, or the call itself is)."""
    odd = F.array_contains(alleles, F.lit(-127))  # null if the call holds a null
    return F.coalesce((F.array_min(alleles) < 0) | odd, F.lit(True))


def clean_sample_id(sample: Column) -> Column:
    return F.trim(F.regexp_replace(sample.cast("string"), '^"+|"+$', ""))


def haplotype_explode(calls: DataFrame) -> DataFrame:
    """One row for each allele, of sample ``<id>_h0`` or ``<id>_h1``; the other columns stay."""
    keep = [c for c in calls.columns if c not in ("alleles", "sampleid")]
    rows = calls.select(*keep, "sampleid", F.posexplode("alleles").alias("h", "allele"))
    return rows.select(*keep, F.concat("sampleid", F.lit("_h"), F.col("h")).alias("sampleid"), "allele")


def haplotype_samples(samples: DataFrame) -> DataFrame:
    """Sample metadata repeated for both haplotypes, with the base id."""
    return samples.withColumn("base", F.col("sampleid")).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "sampleid", F.concat("base", F.lit("_h"), F.col("h"))
    ).drop("h")


def validate_dosage(rows: DataFrame, dosage: str = "dosage") -> DataFrame:
    """The rows whose dosage is not 0, 1 or 2."""
    return rows.where(F.col(dosage).isNull() | ~F.col(dosage).isin(0, 1, 2))


def require_dosage(rows: DataFrame, dosage: str = "dosage") -> DataFrame:
    """The rows themselves; a ValueError if any dosage is not 0, 1 or 2.

    The check is part of the projection, and the rows are written to the shared folder as they are checked: their source is read once, and what follows reads columns.
    """
    message = "Genotype values must be 0, 1, or 2"
    good = F.when(F.col(dosage).isin(0, 1, 2), F.col(dosage)).otherwise(F.raise_error(F.lit(message)).cast(rows.schema[dosage].dataType))
    try:
        return stored(rows.withColumn(dosage, good), "dosages")
    except Exception as e:
        if message in str(e):
            raise ValueError(message) from None
        raise


def flip_augment(rows: DataFrame, rate: float = 0.05, seed: int = 0, epoch: int = 0, symmetric: bool = False) -> DataFrame:
    """Replace the dosage g of some calls by 1 - g (or 2 - g if symmetric), each with the given probability."""
    from .keyed import uniform

    g = F.col("dosage")
    flip = uniform(seed, F.lit(epoch), "sampleid", "chrom", "position") < rate
    return rows.withColumn("dosage", F.when(flip, F.lit(2 if symmetric else 1) - g).otherwise(g).cast("int"))
