"""Genotypes read by place are those that are split."""

import re

from genorigin.sources import io


def by_hand(gt, cell):
    text = "./."
    if gt and cell is not None:
        fields = cell.split(":")
        text = fields[gt - 1] if gt <= len(fields) else "./."
    return [int(a) if re.fullmatch(r"\s*[+-]?\d+\s*", a) else -1 for a in re.split(r"[/|]", text)]


def test_genotypes_of_all_shapes(spark):
    texts = ["0/0", "0|1", "./.", ".|2", "9/8", "10/2", "1", ".", "", "0/1/2", "/01", "a/1", "1/b", "0-1", "1//", "-/1", "200/.", "0/é", " /1", "0/1 "]
    cells = [*texts, *[f"{t}:12:x" for t in texts], *[f"7:{t}" for t in texts], None]
    rows = [(gt, c) for gt in (None, 0, 1, 2) for c in cells]
    df = spark.createDataFrame(rows, "gt int, cell string")
    got = io._with_alleles(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.alleles == by_hand(r.gt, r.cell), r
