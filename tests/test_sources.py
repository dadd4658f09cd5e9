"""Readers and their errors."""

import gzip

import pytest
from pyspark.sql import functions as F

from genorigin.operators import samples as S
from genorigin.sources import io


def alleles(df):
    return {(r.sampleid, r.chrom, r.position): list(r.alleles) for r in df.collect()}


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{}\n{}\n"


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF.format("s1\ts2", "1\t10\t.\tA\tC,G\t.\t.\t.\tGT:DP\t0/1:3\t./.\n2\t20\t.\tA\tC\t.\t.\t.\tDP:GT\t4:0|1\t7:2/2"))
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(VCF.format("s2\ts1", "1\t30\t.\tA\tC\t.\t.\t.\tGT\t1\t0/0"))
    assert alleles(io.scan_vcf(spark, str(tmp_path / "*.vcf*"))) == {
        ("s1", "1", 10): [0, 1], ("s2", "1", 10): [-1, -1], ("s1", "2", 20): [0, 1], ("s2", "2", 20): [2, 2], ("s2", "1", 30): [1], ("s1", "1", 30): [0, 0],
    }


def test_unreadable_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("nothing\n")
    with pytest.raises(ValueError, match="VCF"):
        io.scan_vcf(spark, str(tmp_path / "a.vcf"))


def test_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("sampleID\t1001\t2005\ns1\t0\t1\ns2\t2\t0\n")
    got = alleles(io.scan_matrix(spark, str(tmp_path / "m.txt")))
    assert got == {("s1", "1", 1001): [0, 0], ("s1", "1", 2005): [1, 0], ("s2", "1", 1001): [1, 1], ("s2", "1", 2005): [0, 0]}


@pytest.mark.parametrize(("text", "what"), [("id\t1001\ns1\t0\n", "sampleID"), ("sampleID\t1001\ns1\t3\n", "0, 1, or 2"), ("sampleID\t1001\ns1\tNA\n", "0, 1, or 2")])
def test_bad_matrix(spark, tmp_path, text, what):
    (tmp_path / "m.txt").write_text(text)
    with pytest.raises(ValueError, match=what):
        io.scan_matrix(spark, str(tmp_path / "m.txt"))


def test_frame(spark):
    wide = spark.createDataFrame([("s1", 0, 1, 2), ("s2", 2, 0, 1)], ["sampleid", "1001", "2001", "3005"])
    got = alleles(io.load_genotypes(spark, frame=wide))
    assert len(got) == 6 and got["s1", "1", 3005] == [1, 1]
    with pytest.raises(ValueError, match="0, 1, or 2"):
        io.scan_genotype_frame(spark.createDataFrame([("s1", 3, -1)], ["sampleid", "1", "2"]))
    with pytest.raises(ValueError, match="0, 1, or 2"):
        io.scan_genotype_frame(spark.createDataFrame([("s1", 1, None)], "sampleid string, `1` int, `2` int"))
    with pytest.raises(ValueError, match="numeric"):
        io.scan_genotype_frame(spark.createDataFrame([("s1", 0)], ["sampleid", "SNP1"]))


def test_no_source(spark):
    with pytest.raises(ValueError, match="No genotype data"):
        io.load_genotypes(spark)


def test_sample_data(spark, tmp_path):
    (tmp_path / "s.txt").write_text('"x"\t"y"\t"sampleID"\tother\nNA\tNA\t"a"\t1\nNaN\tNaN\tb\t2\n1.5\t2.5\tc\t3\n')
    got = {r.sampleid: (r.x, r.y, r.other) for r in io.scan_sample_data(spark, str(tmp_path / "s.txt")).collect()}
    assert got == {"a": (None, None, "1"), "b": (None, None, "2"), "c": (1.5, 2.5, "3")}
    with pytest.raises(ValueError, match="sampleID"):
        io.sample_frame(spark.createDataFrame([("a", 1.0, 2.0)], ["sampleID", "longitude", "latitude"]))


def test_lake_prunes(spark, tmp_path):
    calls = spark.range(100).select(F.lit("s").alias("sampleid"), F.lit("1").alias("chrom"), (F.col("id") * 50_000).alias("position"), F.array(F.lit(0), F.lit(1)).alias("alleles"))
    path = str(tmp_path / "lake")
    io.write_lake(calls, path)
    region = io.read_region(spark, path, "1", 900_000, 1_100_000)
    assert sorted(r.position for r in region.collect()) == [900_000, 950_000, 1_000_000, 1_050_000]
    assert "pos_bucket" in region._jdf.queryExecution().executedPlan().toString()
    io.write_lake(calls, path, overwrite=True)
    assert io.load_genotypes(spark, lake=path).count() == 100
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_lake(calls, path)


def test_alignment(spark):
    calls = spark.createDataFrame([("a",), ("b",)], ["sampleid"])
    samples = spark.createDataFrame([("a", 1.0, 2.0)], ["sampleid", "x", "y"])
    assert S.check_sample_alignment(calls.where("sampleid = 'a'"), samples).count() == 1
    with pytest.raises(ValueError, match="Sample ordering failed"):
        S.check_sample_alignment(calls, samples)


def test_predictions_of_two_files(spark, tmp_path):
    for name, x in (("a_predlocs.txt", 1), ("b_predlocs.txt", 2)):
        (tmp_path / name).write_text(f"x,y,sampleID\n{x},5,s1\n" if x == 1 else f"sampleID,x,y\ns1,{x},5\n")
    got = [tuple(io.scan_predictions(spark, str(tmp_path / n)).first()) for n in ("a_predlocs.txt", "b_predlocs.txt")]
    assert got == [("a_predlocs.txt", "s1", 1.0, 5.0), ("b_predlocs.txt", "s1", 2.0, 5.0)]
