"""Block-gzip files: the lines of the plain file, whatever the ranges, and regions."""

import gzip
import random

import pytest

from genorigin.sources import bgzf, io


def write(path, text, sizes):
    with open(path, "wb") as f:
        while text:
            n = next(sizes)
            f.write(bgzf.member(text[:n]))
            text = text[n:]
        f.write(bgzf.END)


def test_lines_are_those_of_the_plain_file(spark, tmp_path):
    """Members of any size, lines longer than members and than ranges, empty lines, a break at the end of a member, no break at the end of the file."""
    rng = random.Random(3)
    lines = ["x" * rng.choice([0, 1, 5, 40, 3000]) + str(k) for k in range(800)] + ["", "y" * 200_000, "end"]
    text = "\n".join(lines).encode()
    path = f"{tmp_path}/a.gz"
    write(path, text, iter(lambda: rng.choice([1, 7, 500, 9000, bgzf.MOST]), None))
    assert gzip.open(path).read() == text and bgzf.is_block_gzip(path)
    for size in (100, 1000, 4097, 1 << 20):
        rows = bgzf.read_lines(spark, [path], range=str(size))
        got = [r.value for r in rows.collect()]
        assert got == lines
    assert bgzf.read_lines(spark, [path], range="1000").rdd.getNumPartitions() > 5


def test_line_breaks_at_member_ends(spark, tmp_path):
    path, lines = f"{tmp_path}/b.gz", [f"line {k}" for k in range(300)]
    with open(path, "wb") as f:
        f.writelines(bgzf.member(x.encode() + b"\n") for x in lines)
        f.write(bgzf.END)
    for size in (10, 37, 500):
        assert [r.value for r in bgzf.read_lines(spark, [path], range=str(size)).collect()] == lines


@pytest.fixture(scope="module")
def variants(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("vcf")
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n"
    rows = [(c, 10 * k) for c in ("1", "2", "10") for k in range(1, 900)]
    text = (head + "".join(f"{c}\t{p}\t.\tA\tC\t.\t.\t.\tGT\t0/{p % 300}\t.|1\n" for c, p in rows)).encode()
    (folder / "plain.vcf").write_bytes(text)
    (folder / "one.gz").write_bytes(gzip.compress(text))
    write(folder / "blocks.vcf.gz", text, iter(lambda: 700, None))
    return folder, rows


def test_scan_of_blocks(spark, variants):
    folder, rows = variants
    want = sorted(map(str, io.scan_vcf(spark, f"{folder}/plain.vcf").collect()))
    assert len(want) == 2 * len(rows) and any("[0, 290]" in x for x in want)
    for name in ("one.gz", "blocks.vcf.gz"):
        assert sorted(map(str, io.scan_vcf(spark, f"{folder}/{name}", range_bytes=2000).collect())) == want
    both = io.scan_vcf(spark, f"{folder}/*.gz", range_bytes=2000)
    assert both.count() == 2 * len(want)


def test_a_region_reads_its_ranges_only(spark, variants):
    folder, rows = variants
    path = f"{folder}/blocks.vcf.gz"
    for region in (("2", 4000, 4500), ("10", 1, 60), ("1", 8000, 99999), ("3", 1, 99)):
        got = io.scan_vcf(spark, path, region, 500)
        want = sorted((p, s) for c, p in rows if c == region[0] and region[1] <= p < region[2] for s in "ab")
        assert sorted((r.position, r.sampleid) for r in got.collect()) == want
        lines = bgzf.read_lines(spark, [path], range="500", region=f"{region[0]}:{region[1]}-{region[2]}").count()
        assert lines < len(rows) / 4
