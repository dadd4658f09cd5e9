"""Sites: counts, filters, frequencies, imputation, order and feature vectors.

calls: sampleid, chrom, position, alleles. dosages: sampleid, chrom, position, dosage (null where missing). A site is (chrom, position).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from genorigin.functions.genotype import dosage_from_alleles, is_missing_call
from genorigin.functions.keyed import binomial1, binomial2, digest

SITE = ["chrom", "position"]


def allele_counts(calls: DataFrame, most: int = 3) -> DataFrame:
    """Per site: n0, n1, ... up to allele ``most``, how often each allele is called, and others: how many alleles beyond are called at all, of any index.

    Alleles count one by one, so of a half call such as (0, -1) the called one does. Equal calls of a site are counted first, where the rows are; only these few counts are unfolded into alleles.
    """
    equal = calls.groupBy(*SITE, "alleles").agg(F.count(F.lit(1)).alias("n"))
    each = equal.select(*SITE, "n", F.explode_outer("alleles").alias("allele")).groupBy(*SITE, "allele").agg(F.sum("n").alias("n"))
    count = lambda k: F.coalesce(F.sum(F.when(F.col("allele") == k, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(*SITE).agg(*[count(k).alias(f"n{k}") for k in range(most + 1)], F.count_if(F.col("allele") > most).alias("others"))


def allele_counts_long(calls: DataFrame) -> DataFrame:
    """Per site and allele, any number of alleles: chrom, position, allele, n."""
    rows = calls.select(*SITE, F.explode("alleles").alias("allele")).where("allele >= 0")
    return rows.groupBy(*SITE, "allele").agg(F.count(F.lit(1)).alias("n"))


def _count_columns(counts: DataFrame) -> list[str]:
    return [c for c in counts.columns if c[0] == "n" and c[1:].isdigit()]


def biallelic_filter(counts: DataFrame) -> DataFrame:
    """Sites with exactly two alleles, of any index; sites of one allele go as well. Without the column others, the counts are all alleles."""
    seen = sum(((F.col(c) > 0).cast("int") for c in _count_columns(counts)), F.col("others") if "others" in counts.columns else F.lit(0))
    return counts.where(seen == 2)


def mac_filter(counts: DataFrame, min_mac: int = 1, folded: bool = False) -> DataFrame:
    """Sites with at least min_mac copies of allele 1 (of the rarer allele if folded); all sites for min_mac up to 1."""
    if min_mac <= 1:
        return counts
    copies = F.least("n0", "n1") if folded else F.col("n1")
    return counts.where(copies >= min_mac)


def allele_freq_called(calls: DataFrame) -> DataFrame:
    """Per site: n1, called (samples), freq: copies of allele 1 over twice the called samples; null if none is called.

    Copies in half calls count, samples with them do not count as called.
    """
    copies = F.coalesce(F.sum(dosage_from_alleles(F.col("alleles"))), F.lit(0)).cast("long")
    rows = calls.groupBy(*SITE).agg(copies.alias("n1"), F.count_if(~is_missing_call(F.col("alleles"))).alias("called"))
    return rows.withColumn("freq", F.try_divide(F.col("n1").cast("double"), 2 * F.col("called")))


def allele_freq_all(dosages: DataFrame) -> DataFrame:
    """Per site: the sum of dosages over twice all samples, missing ones counted as 0."""
    return dosages.groupBy(*SITE).agg((F.coalesce(F.sum("dosage"), F.lit(0)).cast("double") / (2 * F.count(F.lit(1)))).alias("freq"))


def allele_freq_train(dosages: DataFrame, roles: DataFrame) -> DataFrame:
    """The same over the training samples of roles (sampleid, role) only."""
    return allele_freq_all(dosages.join(roles.where("role = 'train'").select("sampleid"), "sampleid", "left_semi"))


def missingness(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls and missing calls by site, or by the columns given (such as the sample)."""
    keys = by or SITE
    gone = is_missing_call(F.col("alleles"))
    return calls.groupBy(*keys).agg(F.count_if(~gone).alias("called"), F.count_if(gone).alias("missing"))


def to_dosage(calls: DataFrame, missing: int | None = 0) -> DataFrame:
    """Calls to dosages; calls with no allele get the value given, or null, and half calls the copies that are called."""
    copies = dosage_from_alleles(F.col("alleles"))
    none = ~F.coalesce(F.array_max("alleles") >= 0, F.lit(False))
    d = F.when(none, F.lit(missing)).otherwise(copies)
    return calls.select("sampleid", *SITE, d.cast("int").alias("dosage"))


def impute_binomial(calls: DataFrame, seed: int = 0, haploid: bool = False) -> DataFrame:
    """Dosages where each missing call is drawn from Binomial(2, frequency among the called) of its site, or Binomial(1, ...) for haploid calls."""
    freq = allele_freq_called(calls).select(*SITE, "freq")
    draw = (binomial1 if haploid else binomial2)(F.col("freq"), seed, "chrom", "position", "sampleid")
    rows = calls.join(freq, SITE)
    d = F.when(is_missing_call(F.col("alleles")), F.coalesce(draw, F.lit(0))).otherwise(dosage_from_alleles(F.col("alleles")))
    return rows.select("sampleid", *SITE, d.cast("int").alias("dosage"))


def cap_snps(sites: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k sites at random without replacement (a distributed top-k by digest); a ValueError if there are fewer."""
    picked = sites.orderBy(digest(seed, "chrom", "position"), *SITE).limit(k)
    have = sites.limit(k).count()
    if have < k:
        raise ValueError(f"Cannot draw {k} sites from {have}")
    return picked


def filter_snps(calls: DataFrame, min_mac: int = 1, max_snps: int | None = None, impute: bool = False, seed: int = 0, folded: bool = False) -> DataFrame:
    """Dosages of the sites that are biallelic, common enough and, if capped, drawn; missing calls are imputed or 0."""
    sites = mac_filter(biallelic_filter(allele_counts(calls)), min_mac, folded).select(*SITE)
    if max_snps is not None:
        sites = cap_snps(sites, max_snps, seed)
    kept = calls.join(sites, SITE, "left_semi")
    return impute_binomial(kept, seed) if impute else to_dosage(kept)


def site_index(sites: DataFrame, bucket: int = 1_000_000) -> DataFrame:
    """Number the sites from 0 in order of (chrom, position), with no window over all of them.

    Sites are ranked within buckets of positions; the offsets come from a window over one row per bucket.
    """
    keyed = sites.select(*SITE).distinct().withColumn("bucket", F.floor(F.col("position") / bucket))
    counts = keyed.groupBy("chrom", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("chrom", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chrom", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("chrom", "bucket").orderBy("position")) - 1
    ranked = keyed.withColumn("rank", rank)
    return ranked.join(offsets, ["chrom", "bucket"]).select(*SITE, (F.col("offset") + F.col("rank")).cast("long").alias("site"))


def feature_assembly(dosages: DataFrame, keys: list[str] | None = None, bucket: int = 1_000_000) -> DataFrame:
    """One row per sample (and key): x, its dosages in order of site. Missing ones count as 0.

    Dosages are gathered and sorted by sample and bucket of positions, where each is a byte after that; then a sample's buckets are joined in order. So a row holds
    a byte for each site and never its names and positions.
    """
    by = [*(keys or []), "sampleid"]
    cell = F.struct("position", F.coalesce("dosage", F.lit(0)).cast("tinyint").alias("d"))
    parts = dosages.groupBy(*by, *[c for c in ("chrom",) if c not in by], F.floor(F.col("position") / bucket).alias("bucket")).agg(F.array_sort(F.collect_list(cell))["d"].alias("part"))
    place = [c for c in ("chrom", "bucket") if c not in by]
    rows = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*place, "part"))).alias("parts"))
    return rows.select(*by, F.flatten(F.col("parts")["part"]).alias("x"))
