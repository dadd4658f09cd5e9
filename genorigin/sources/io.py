"""Readers and writers for genotypes, samples, weights, predictions and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genorigin.functions.genotype import alleles_from_dosage, clean_sample_id, require_dosage
from genorigin.shared import stored

from . import bgzf


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file; compressed files cannot be split, so their lines are dealt out again."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return rows.repartition(spark.sparkContext.defaultParallelism) if path.endswith((".gz", ".bgz")) else rows


def _vcf_lines(spark: SparkSession, path: str, region: tuple[str, int, int] | None, size: int) -> tuple[DataFrame, DataFrame]:
    """The lines of variant files, and their #CHROM lines. Block-gzip files are read in ranges of so many bytes, other gzip files whole."""
    if not path.endswith((".gz", ".bgz")):
        lines = _lines(spark, path)
        return lines, lines.where(F.col("value").startswith("#CHROM"))
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # a name for each file; no content is read
    blocks = [f for f in files if bgzf.is_block_gzip(f)]
    plain = [f for f in files if f not in blocks]
    lines = heads = None
    if blocks:
        span = {"region": f"{region[0]}:{region[1]}-{region[2]}"} if region else {}
        lines = bgzf.read_lines(spark, blocks, range=str(size), **span)
        heads = bgzf.read_lines(spark, blocks, head="true").where(F.col("value").startswith("#CHROM"))
    if plain:
        rows = spark.read.text(plain).select(F.col("_metadata.file_path").alias("file"), "value").repartition(spark.sparkContext.defaultParallelism)
        first = rows.where(F.col("value").startswith("#CHROM"))
        lines, heads = (rows, first) if lines is None else (lines.union(rows), heads.union(first))
    return lines, heads


def scan_vcf(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, range_bytes: int = bgzf.RANGE) -> DataFrame:
    """Calls (sampleid, chrom, position, alleles) of VCF files. Each file's own header gives the samples of its columns.

    Block-gzip files are read by a task for each range_bytes of them. region: (chrom, start, stop), the calls with start <= position < stop; of block-gzip files, which must then be sorted by position,
    ranges that cannot have any are not read. The genotype is found by its place in FORMAT; separators are ``/`` and ``|``; a ``.`` is a missing allele, -1, and a call without genotype has two. A ValueError if no header is found.
    """
    lines, heads = _vcf_lines(spark, path, region, range_bytes)
    split = F.split("value", "\t")
    heads = stored(heads.select("file", F.slice(split, 10, 1_000_000_000).alias("names")), "heads")  # a row for each file: its size is known to the join
    if not heads.limit(1).count():
        raise ValueError(f"Could not read a VCF at {path}")
    body = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(
        "file", split[0].alias("chrom"), split[1].cast("long").alias("position"), F.split(split[8], ":").alias("format"), F.slice(split, 10, 1_000_000_000).alias("cells")
    )
    if region:
        body = body.where((F.col("chrom") == region[0]) & (F.col("position") >= region[1]) & (F.col("position") < region[2]))
    both = F.explode(F.arrays_zip(F.col("names").alias("sampleid"), F.col("cells").alias("cell")))
    cells = body.join(heads, "file").select("chrom", "position", F.array_position("format", "GT").cast("int").alias("gt"), both.alias("c"))
    cells = cells.select("chrom", "position", "gt", "c.sampleid", "c.cell").where("sampleid is not null")
    return _with_alleles(cells).select("sampleid", "chrom", "position", "alleles")


def _with_alleles(cells: DataFrame) -> DataFrame:
    """Cells with the alleles of their genotype, the field gt (from 1; null: none). Two alleles of a digit or a point, which most genotypes are, are read by place; all others are split."""
    field = F.when(F.col("gt") == 1, F.substring_index("cell", ":", 1)).when(F.col("gt") > 0, F.get(F.split("cell", ":"), F.col("gt") - 1))
    at = lambda k: F.ascii(F.substring("text", k, 1))
    rows = cells.withColumn("text", F.coalesce(field, F.lit("./.")))
    rows = rows.withColumns({"a0": at(1), "a1": at(3)})
    plain = lambda c: F.col(c).between(48, 57) | (F.col(c) == 46)
    digit = lambda c: F.when(F.col(c) == 46, -1).otherwise(F.col(c) - 48)
    split = F.transform(F.split("text", r"[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1)))
    short = (F.length("text") == 3) & at(2).isin(47, 124) & plain("a0") & plain("a1")
    return rows.withColumn("alleles", F.when(short, F.array(digit("a0"), digit("a1"))).otherwise(split))


def scan_matrix(spark: SparkSession, path: str, chrom: str = "1") -> DataFrame:
    """Calls of tab-separated dosage files with a ``sampleID`` column and a column per position. A ValueError without that column, or for a value other than 0, 1, 2.

    Lines are split and unfolded against the file's header, so the number of sites is not bound by a reader's columns.
    """
    lines = _lines(spark, path)
    head = lines.where(F.col("value").rlike(r'^"?sampleID"?\t'))
    if not head.limit(1).count():
        raise ValueError("Genotype matrix must contain a 'sampleID' column")
    clean = lambda c: F.regexp_replace(c, '^"|"$', "")
    names = F.slice(F.split("value", "\t"), 2, 1_000_000_000)
    heads = stored(head.select("file", F.transform(names, lambda c: clean(c).cast("double").cast("long")).alias("positions")), "heads")
    body = lines.where(~F.col("value").rlike(r'^"?sampleID"?\t') & (F.length("value") > 0))
    split = F.split("value", "\t")
    cells = body.select("file", clean_sample_id(split[0]).alias("sampleid"), F.slice(split, 2, 1_000_000_000).alias("cells")).join(heads, "file")
    rows = cells.select("sampleid", F.explode(F.arrays_zip(F.col("positions").alias("position"), F.col("cells").alias("cell"))).alias("c")).where("c.position is not null")
    rows = rows.select("sampleid", F.lit(chrom).alias("chrom"), "c.position", F.col("c.cell").try_cast("double").alias("dosage"))
    return require_dosage(rows).select("sampleid", "chrom", "position", alleles_from_dosage(F.col("dosage")).alias("alleles"))


def scan_genotype_frame(wide: DataFrame, chrom: str = "1") -> DataFrame:
    """Calls of a wide frame: sampleid, and a column per position whose name is a number. ValueErrors for other names, or values other than 0, 1, 2."""
    columns = [c for c in wide.columns if c != "sampleid"]
    for c in columns:
        try:
            float(c)
        except ValueError:
            raise ValueError("Column names must be numeric positions") from None
    rows = wide.unpivot(["sampleid"], columns, "position", "dosage")
    rows = rows.select(clean_sample_id(F.col("sampleid")).alias("sampleid"), F.lit(chrom).alias("chrom"), F.col("position").cast("double").cast("long").alias("position"), "dosage")
    return require_dosage(rows).select("sampleid", "chrom", "position", alleles_from_dosage(F.col("dosage")).alias("alleles"))


def load_genotypes(spark: SparkSession, vcf: str | None = None, matrix: str | None = None, lake: str | None = None, frame: DataFrame | None = None) -> DataFrame:
    """Calls from whichever source is given; a ValueError if none is."""
    if frame is not None:
        return scan_genotype_frame(frame)
    if vcf:
        return scan_vcf(spark, vcf)
    if matrix:
        return scan_matrix(spark, matrix)
    if lake:
        return spark.read.parquet(lake).drop("pos_bucket")
    raise ValueError("No genotype data provided")


def write_lake(calls: DataFrame, path: str, bucket: int = 1_000_000, overwrite: bool = False) -> None:
    """Calls as Parquet by chromosome and bucket of positions, sorted by position within files."""
    rows = calls.withColumn("pos_bucket", F.floor(F.col("position") / bucket))
    dealt = rows.repartition("chrom", "pos_bucket", F.pmod(F.xxhash64("sampleid"), F.lit(4))).sortWithinPartitions("chrom", "pos_bucket", "position")
    dealt.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("chrom", "pos_bucket").parquet(path)


def read_region(spark: SparkSession, path: str, chrom: str, start: int, stop: int, bucket: int = 1_000_000) -> DataFrame:
    """Calls with start <= position < stop: other buckets are not listed, and row groups are skipped by position."""
    inside = F.col("pos_bucket").between(start // bucket, (stop - 1) // bucket)
    rows = spark.read.parquet(path).where((F.col("chrom") == chrom) & inside & (F.col("position") >= start) & (F.col("position") < stop))
    return rows.drop("pos_bucket").withColumn("chrom", F.col("chrom").cast("string"))


def position_range_filter(rows: DataFrame, start: int, stop: int) -> DataFrame:
    return rows.where((F.col("position") >= start) & (F.col("position") < stop))


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))


def _require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{what} must contain columns {columns}; missing {lost}")
    return df


def scan_sample_data(spark: SparkSession, path: str) -> DataFrame:
    """Samples of tab-separated files with header sampleID, x, y; NA and NaN are unknown, other columns are kept. A ValueError if a column is missing."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return sample_frame(raw)


def sample_frame(raw: DataFrame) -> DataFrame:
    """The same checks and types for a frame."""
    _require(raw, ["sampleID", "x", "y"], "Sample data")
    rest = [c for c in raw.columns if c not in ("sampleID", "x", "y")]
    return raw.select(clean_sample_id(F.col("sampleID")).alias("sampleid"), _number("x").alias("x"), _number("y").alias("y"), *rest)


def scan_sample_weights(spark: SparkSession, path: str) -> DataFrame:
    raw = _require(spark.read.csv(path, sep="\t", header=True), ["sampleID", "sample_weight"], "Sample weights")
    return raw.select(clean_sample_id(F.col("sampleID")).alias("sampleid"), _number("sample_weight").alias("sample_weight"))


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of one file or of every ``*predlocs*`` file in a folder, by column name, with the file as run key."""
    files = path if "predlocs" in path.rsplit("/", 1)[-1] else f"{path}/*predlocs*"
    raw = _require(spark.read.option("recursiveFileLookup", True).csv(files, header=True), ["sampleID", "x", "y"], "Predictions")
    return raw.select(F.regexp_extract("_metadata.file_path", r"([^/]*predlocs[^/]*)", 1).alias("run"), clean_sample_id(F.col("sampleID")).alias("sampleid"), _number("x").alias("x"), _number("y").alias("y"))


def scan_range_polygon(rings: DataFrame) -> DataFrame:
    """Edges of the rings (poly, ring, seq, x, y) of a species range."""
    from genorigin.operators.ranges import ring_edges

    return ring_edges(_require(rings, ["poly", "ring", "seq", "x", "y"], "Range"))


#: What each analysis's file of predictions is called after its prefix. Fixed values.
OUTPUTS = {
    "single": "predlocs.txt", "windows": "windows_predlocs.csv", "jackknife": "jacknife_predlocs.csv", "bootstrap": "bootstrap_predlocs.csv",
    "holdout": "holdout_predlocs.csv", "all_holdouts": "allholdouts_predlocs.csv", "ensemble": "ensemble_predlocs.csv", "ensemble_pred_only": "ensemble_predlocs_pred_only.csv",
}


def sink_predictions(predictions: DataFrame, prefix: str, analysis: str) -> str:
    """Write predictions, with their run keys as columns, as CSV to ``<prefix>_<name of the analysis>``; returns the path."""
    path = f"{prefix}_{OUTPUTS[analysis]}"
    predictions.withColumnRenamed("sampleid", "sampleID").write.mode("overwrite").csv(path, header=True)
    return path


def sink_bootstraps(predictions: DataFrame, prefix: str) -> list[str]:
    """Write the predictions of each replicate to ``<prefix>_boot<replicate>_predlocs.txt``; returns the paths. predictions should be a stored table: it is read once for each."""
    paths = []
    for r in sorted(row["replicate"] for row in predictions.select("replicate").distinct().collect()):  # a number for each replicate
        paths.append(f"{prefix}_boot{r}_predlocs.txt")
        predictions.where(F.col("replicate") == r).drop("replicate").withColumnRenamed("sampleid", "sampleID").write.mode("overwrite").csv(paths[-1], header=True)
    return paths


def sink_history(history: DataFrame, prefix: str) -> str:
    path = f"{prefix}_history.txt"
    history.write.mode("overwrite").csv(path, sep="\t", header=True)
    return path


def write_vcf(calls: DataFrame, path: str, parts: int = 4, blocks: bool = False) -> None:
    """Calls as VCF text, one folder per part of the sites, each with a header of its own, or with blocks as one block-gzip file per part. Sites are lines sorted by position, samples columns in order
    of id."""
    spark = calls.sparkSession
    names = calls.select("sampleid").distinct().agg(F.array_join(F.array_sort(F.collect_list("sampleid")), "\t").alias("names"))
    part = F.pmod(F.xxhash64("chrom", "position"), F.lit(parts)).cast("int")
    allele = lambda a: F.when(a < 0, ".").otherwise(a.cast("string"))
    pair = F.concat_ws("/", *[allele(F.col("alleles")[k]) for k in (0, 1)])  # what most calls are; the same as below
    cell = F.when(F.size("alleles") == 2, pair).otherwise(F.array_join(F.transform("alleles", allele), "/"))
    lines = calls.groupBy("chrom", "position").agg(F.sort_array(F.collect_list(F.struct("sampleid", cell.alias("gt")))).alias("cells"))
    fixed = F.concat_ws("\t", "chrom", F.col("position").cast("string"), *map(F.lit, (".", "A", "C,G", ".", ".", ".", "GT")))
    body = lines.select(part.alias("part"), "chrom", F.col("position").alias("ord"), F.concat_ws("\t", fixed, F.array_join(F.col("cells")["gt"], "\t")).alias("value"))
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
    each = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    head = each.crossJoin(F.broadcast(names)).select("part", F.lit("").alias("chrom"), F.lit(-1).cast("long").alias("ord"), F.concat_ws("\t", F.lit(columns), "names").alias("value"))
    first = each.select("part", F.lit("").alias("chrom"), F.lit(-2).cast("long").alias("ord"), F.lit("##fileformat=VCFv4.2").alias("value"))
    rows = body.unionByName(head).unionByName(first).repartition(parts, "part").sortWithinPartitions("part", "chrom", "ord")
    if blocks:
        bgzf.write_lines(rows, path)
        return
    rows.select("part", "value").write.partitionBy("part").text(path)


def write_matrix(dosages: DataFrame, path: str) -> None:
    """Dosages as a tab-separated matrix: the header in a file of its own folder part, rows of samples below."""
    cells = dosages.groupBy("sampleid").agg(F.array_sort(F.collect_list(F.struct("position", "dosage"))).alias("cells"))
    line = F.concat_ws("\t", "sampleid", F.array_join(F.transform("cells", lambda c: c["dosage"].cast("string")), "\t"))
    sites = dosages.select("position").distinct().agg(F.array_join(F.array_sort(F.collect_list("position")).cast("array<string>"), "\t").alias("names"))
    parts = 4
    head = dosages.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")).crossJoin(F.broadcast(sites))
    head = head.select("part", F.lit("").alias("ord"), F.concat_ws("\t", F.lit("sampleID"), "names").alias("value"))
    rows = cells.select(F.pmod(F.xxhash64("sampleid"), F.lit(parts)).cast("int").alias("part"), F.col("sampleid").alias("ord"), line.alias("value"))
    rows.unionByName(head).repartition(parts, "part").sortWithinPartitions("part", "ord").select("part", "value").write.partitionBy("part").text(path)
