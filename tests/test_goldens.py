"""Published small cases: selections by cutoff, filter and query rate, and common ancestors."""

import pytest
from pyspark.sql import functions as F

from taxaloom.functions import bloom
from taxaloom.operators import matching, resolve, taxonomy

# Reads, references (by the changes in the forward and the reverse read), trees.
READS = {"F": "CTCGTGTTTCCT", "R": "ACCAAGAGGCCC"}
REFS = {
    "e0": "CTCGTGTTTCCT----GGGCCTCTTGGT",
    "e1F": "CTC-TGTTTCCT----GGGCCTCTTGGT",
    "e1F_e1R": "CTC-TGTTTCCT----GGG-CTCTTGGT",
    "e1F_e2R": "CTC-TGTTTCCT----GGG-CTCT-GGT",
    "e2F_e1R": "CTC-TGTT-CCT----GGG-CTCTTGGT",
    "e2F_e2R": "CTC-TGTT-CCT----GGG-CTCT-GGT",
}
LETTERS = "1:0 A0:1 A1:1 B0:A0 B1:A0 B2:A0 C0:B0 C1:B0 C2:B1 C3:B2 D0:C0 D1:C1 D2:C2 D3:C2 D4:C3 D5:C3 E0:D0 E1:D0 E2:C1 E3:D3 E4:D4 F0:E1 F1:E2 F2:E2 F3:D2 F4:E4 G0:F0 G1:E3 G2:F4 G3:F4 G4:A1 G5:150"
NCBI = (
    "2025595:2585030 2585030:2559587 2559587:10239 10239:1 1:0 491893:102294 102294:28883 28883:10239 1930510:12429 12429:10239 64280:11051 11051:11050 11050:2559587 51589:2237 2237:1963268 1963268:2235 2235:183963 "
    "183963:2290931 2290931:28890 28890:2157 2157:131567 131567:1 366602:2648921 2648921:75 75:76892 76892:204458 204458:28211 28211:1224 1224:2 2:131567 1406:44249 44249:186822 186822:1385 1385:91061 91061:1239 "
    "1239:1783272 1783272:2 470:909768 909768:469 469:468 468:72274 72274:1236 1236:1224 2223:2222 2222:143067 143067:94695 94695:224756 224756:2290931"
)


def matches(spark, w, paired, cutoff, share, threshold, reads=READS):
    refs = spark.createDataFrame([(t, t, s) for t, s in REFS.items()], "file string, target string, seq string")
    index, sizes = matching.build_index(refs, 4, w)
    best = bloom.best_layout(bloom.layouts(sizes, fp=0.01)).first()
    rates = bloom.target_rates(sizes, best["n_hashes"], best["bin_bits"], best["n_functions"])
    h = matching.read_hashes(spark.createDataFrame([("r", reads["F"], reads["R"] if paired else None)], "read string, seq string, seq2 string"), 4, w, ["read"])
    rows = matching.hierarchy(h, [("H", [(index, rates, cutoff)], share, threshold)], ["read"])
    return {x["target"]: x["kmer_count"] for x in rows.collect()}


@pytest.mark.parametrize(
    "w,paired,want",
    [
        (4, False, {"e0": 9, "e1F": 5, "e1F_e1R": 5, "e1F_e2R": 5, "e2F_e1R": 1, "e2F_e2R": 1}),
        (4, True, {"e0": 18, "e1F": 14, "e1F_e1R": 10, "e1F_e2R": 6, "e2F_e1R": 6, "e2F_e2R": 2}),
        (6, False, {"e0": 4, "e1F": 2, "e1F_e1R": 2, "e1F_e2R": 2}),
        (6, True, {"e0": 8, "e1F": 6, "e1F_e1R": 4, "e1F_e2R": 2, "e2F_e1R": 2}),
    ],
)
def test_counts(spark, w, paired, want):
    assert matches(spark, w, paired, 0.0, 1.0, 1.0) == want


@pytest.mark.parametrize(
    "cutoff,share,threshold,single,paired",
    [
        (0.45, 0.0, 1.0, "e0", "e0"),
        (0.2, 0.8, 1.0, "e0 e1F e1F_e1R e1F_e2R", "e0 e1F e1F_e1R"),
        (0.2, 0.8, 1e-10, "e0 e1F_e2R", "e0 e1F e1F_e1R"),
        (0.6, 1.0, 1.0, "e0", "e0 e1F"),
        (0.0, 0.3, 1.0, "e0", "e0 e1F"),
        (0.0, 1.0, 1e-10, "e0 e1F_e2R", "e0 e1F e1F_e1R"),
    ],
)
def test_selections(spark, cutoff, share, threshold, single, paired):
    assert set(matches(spark, 4, False, cutoff, share, threshold)) == set(single.split())
    assert set(matches(spark, 4, True, cutoff, share, threshold)) == set(paired.split())


def test_windows_and_damaged_reads(spark):
    assert matches(spark, 6, False, 1.0, 0.0, 1.0) == {"e0": 4} and matches(spark, 6, True, 1.0, 0.0, 1.0) == {"e0": 8}
    damaged = {"F": "CTCGTGTTTCC-", "R": "ACCAAGAGGCC-"}
    assert matches(spark, 4, False, 0.7, 0.0, 1.0, damaged) == {"e0": 8} and matches(spark, 4, True, 0.7, 0.0, 1.0, damaged) == {"e0": 16}


@pytest.mark.parametrize(
    "tree,cases",
    [
        (LETTERS, {"E0 E1": "D0", "C3 F4": "C3", "G0 C3 D5": "A0", "G0 G5": "1", "B1 C2": "B1", "C2 B1": "B1", "C0 E1 F2": "B0", "F2 E1 C0": "B0", "E1 F2 C0": "B0"}),
        (NCBI, {"366602 470": "1224", "366602 470 1406": "2", "2223 51589": "2290931", "2025595 491893": "10239", "366602 2223": "131567", "51589 2025595": "1", "366602 470 1406 2223 51589 2025595 491893": "1"}),
    ],
)
def test_common_ancestors(spark, tree, cases):
    tax = spark.createDataFrame([(*e.split(":"), "r", "n") for e in tree.split()], "node string, parent string, rank string, name string")
    line = taxonomy.kept_lineages(taxonomy.rooted(tax))
    groups = spark.createDataFrame([(c, n) for c in cases for n in c.split()], "read string, target string")
    assert {x["read"]: x["lca"] for x in resolve.lca(groups, line, ["read"]).collect()} == cases


def test_reverse_complements_and_missing_targets(spark):
    """Poly-A reads meet poly-T references; a target outside the taxonomy has the root."""
    refs = spark.createDataFrame([(b, b, b * 20) for b in "ACGT"], "file string, target string, seq string")
    tax = spark.createDataFrame([("A", "AT"), ("T", "AT"), ("C", "CG"), ("G", "CG"), ("AT", "ATCG"), ("CG", "ATCG"), ("ATCG", "1"), ("1", "0")], "node string, parent string").withColumn("rank", F.lit("x")).withColumn("name", F.lit("y"))
    for w, single, paired in ((10, 5, 10), (12, 1, 2)):
        index, _ = matching.build_index(refs, 10, w)
        reads = spark.createDataFrame([("s", "A" * 14, None), ("p", "A" * 14, "A" * 14)], "read string, seq string, seq2 string")
        m = matching.count_matches(matching.read_hashes(reads, 10, w, ["read"]), index, ["read"])
        assert {(x["read"], x["target"], x["kmer_count"]) for x in m.collect()} == {("s", "A", single), ("s", "T", single), ("p", "A", paired), ("p", "T", paired)}
        for t, want in ((tax, "AT"), (tax.filter("node <> 'A'"), "1")):
            line = taxonomy.kept_lineages(t)
            assert {x["target"] for x in resolve.resolve(m, ["read"], "lca", line).collect()} == {want}
