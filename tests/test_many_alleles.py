"""Sites with alleles beyond the counted ones are judged by all their alleles."""

import pytest

from genorigin.operators import sites


@pytest.mark.parametrize("most", [1, 3])
def test_biallelic_whatever_the_index(spark, most):
    found = {
        1: [(0, 1), (0, 4)], 2: [(0, 4), (0, 0)], 3: [(4, 5), (5, 5)], 4: [(4, 5), (9, 5)], 5: [(4, 4), (4, 4)], 6: [(0, 1), (1, 1)], 7: [(0, 1), (-1, 4)],
        8: [(0, 2), (2, 7)], 9: [(0, 127), (127, 127)], 10: [(0, 0), (0, 0)], 11: [(63, 64), (64, 63)], 12: [(4, 68), (5, 5)],
    }
    rows = [(f"s{k}", "1", p, list(a)) for p, calls in found.items() for k, a in enumerate(calls)]
    calls = spark.createDataFrame(rows, "sampleid string, chrom string, position long, alleles array<tinyint>")
    want = {2, 3, 6, 9, 11}  # at 7 the half call has a third allele
    assert {r.position for r in sites.biallelic_filter(sites.allele_counts(calls, most)).collect()} == want
    kept = {(r.sampleid, r.position): r.dosage for r in sites.filter_snps(calls).collect()}
    assert {p for _, p in kept} == want and kept["s0", 6] == 1 and kept["s1", 6] == 2 and kept["s0", 2] == 0


def test_half_calls_count_what_is_called(spark):
    """Alleles count one by one; a half call keeps its copies as dosage unless missing calls are imputed, and its sample is not called."""
    rows = [("a", "1", 5, [1, -1]), ("b", "1", 5, [0, 1]), ("c", "1", 5, [-1, -1]), ("d", "1", 5, [-1, 0]), ("e", "1", 5, [1, 1])]
    calls = spark.createDataFrame(rows, "sampleid string, chrom string, position long, alleles array<tinyint>")
    assert tuple(sites.allele_counts(calls).select("n0", "n1", "n2", "n3", "others").first()) == (2, 4, 0, 0, 0)
    assert {(r.allele, r.n) for r in sites.allele_counts_long(calls).collect()} == {(0, 2), (1, 4)}
    assert tuple(sites.allele_freq_called(calls).select("n1", "called", "freq").first()) == (4, 2, 1.0)
    assert {r.sampleid: r.dosage for r in sites.filter_snps(calls).collect()} == {"a": 1, "b": 1, "c": 0, "d": 0, "e": 2}
    assert {r.sampleid: r.dosage for r in sites.to_dosage(calls, None).collect()} == {"a": 1, "b": 1, "c": None, "d": 0, "e": 2}
    assert {r.sampleid: r.dosage for r in sites.filter_snps(calls, impute=True).collect()} == {"a": 2, "b": 1, "c": 2, "d": 2, "e": 2}
