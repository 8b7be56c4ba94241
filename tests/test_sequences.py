import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaloom.functions import bloom, dna
from taxaloom.operators import matching, resolve
from taxaloom.sources import sequences

E0 = ["CTCGTGTTTCCT", "ACCAAGAGGCCC"]


def naive(s, k, w):
    h = dna.hashes([s], k, k)[0].tolist()
    width, out, p = w - k + 1, [], None
    for e in range(width - 1, len(h)):
        a = e - width + 1
        if p is None or p < a:
            m = min(h[a : e + 1])
            p = max(i for i in range(a, e + 1) if h[i] == m)
            out.append(h[p])
        elif h[e] < h[p]:
            p = e
            out.append(h[p])
    return out


def test_minimizers_against_definition():
    r = random.Random(5)
    for _ in range(150):
        k = r.randint(1, 6)
        w = k + r.randint(0, 6)
        texts = ["".join(r.choice("ACGTN" if r.random() < 0.3 else "AC") for _ in range(r.randint(0, 40))) for _ in range(4)]
        values, counts = dna.hashes(texts, k, w)
        at = 0
        for s, n in zip(texts, counts, strict=True):
            assert values[at : at + n].tolist() == (naive(s, k, w) if len(s) >= w else [])
            at += n


def test_repeats_are_given_again_when_a_window_moves_on():
    assert [len(dna.hashes(["A" * n], k, w)[0]) for n, k, w in ((14, 10, 10), (14, 10, 12), (20, 10, 12))] == [5, 1, 3]


def test_column_and_array_forms_agree(spark):
    df = spark.createDataFrame([("ACGTNacgtRACCA",), ("AC",), ("",), (None,)], "seq string")
    got = df.select(dna.kmer_hashes(F.col("seq"), 4).alias("a"), dna.minimizer_hashes(4, 4)(F.col("seq")).alias("b")).collect()
    assert all((x["a"] or []) == x["b"] for x in got)
    with pytest.raises(ValueError):
        dna.seed(32)


def test_counts_of_damaged_reads(spark):
    """Counts of two reads against a reference that holds both, w = k and w > k."""
    ref = "".join([E0[0], "AAAA", E0[1]]).replace("-", "A")
    for w, single, both in ((4, 9, 18), (6, 4, 8)):
        index, _ = matching.build_index(spark.createDataFrame([("f", "e0", ref)], "file string, target string, seq string"), 4, w)
        reads = spark.createDataFrame([(1, E0[0], None), (2, E0[0], E0[1])], "read int, seq string, seq2 string")
        h = matching.read_hashes(reads, 4, w, ["read"])
        got = dict((x["read"], x["kmer_count"]) for x in matching.count_matches(h, index, ["read"]).collect())
        assert got == {1: single, 2: both}


def test_skips_and_filters(spark):
    reads = spark.createDataFrame([(1, "ACG", "ACGTACGT"), (2, "ACGTACGT", "AC"), (3, None, "ACGTACGT"), (4, "A" * 40, None)], "read int, seq string, seq2 string")
    h = {x["read"]: (x["n_hashes"], x["skipped"]) for x in matching.read_hashes(reads, 4, 4, ["read"], most=10).collect()}
    assert h == {1: (0, "small"), 2: (5, None), 3: (0, "small"), 4: (0, "big")}
    m = spark.createDataFrame([(1, "a", 10, 9), (1, "b", 10, 5), (1, "c", 10, 2), (2, "a", 4, 1)], "read int, target string, n_hashes int, kmer_count long")
    assert {(x["read"], x["target"]) for x in matching.rel_cutoff(m, 0.3).collect()} == {(1, "a"), (1, "b")}
    assert {(x["read"], x["target"]) for x in matching.rel_filter(m, 0.5, ["read"]).collect()} == {(1, "a"), (1, "b"), (2, "a")}
    assert matching.fpr_query(m, m.select("target").limit(0).withColumn("fpr", F.lit(0.1)), 1.0).count() == 4
    low = matching.merge_databases([m.filter("target = 'c'"), m.filter("target = 'c'").withColumn("kmer_count", F.lit(8).cast("long"))], ["read"]).collect()
    assert [(x["kmer_count"], x["low"]) for x in low] == [(8, 2)]


def test_tail_probability_against_direct_sum(spark):
    from math import comb

    data = [(c, n, f) for n in (5, 40) for c in (0, 1, 4) for f in (0.0, 0.01, 0.3)]
    df = spark.createDataFrame(data, "c long, n long, f double")
    for x in df.withColumn("q", bloom.tail_probability(F.col("c"), F.col("n"), F.col("f"))).collect():
        want = 1 - sum(comb(x["n"], i) * x["f"] ** i * (1 - x["f"]) ** (x["n"] - i) for i in range(x["c"] + 1))
        assert abs(x["q"] - want) < 1e-9


def test_layout_modes(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 5000), ("z", 0)], "target string, n_hashes long")
    c = bloom.layouts(sizes, fp=0.05, functions=4)
    best = {m: bloom.best_layout(c, m).first() for m in bloom.MODES}
    assert best["smallest"]["size_bits"] <= best["avg"]["size_bits"] <= best["fastest"]["size_bits"]
    assert best["fastest"]["n_bins"] <= best["avg"]["n_bins"] <= best["smallest"]["n_bins"]
    assert bloom.layouts(sizes.limit(0), fp=0.05).count() == 0
    fixed = bloom.layouts(sizes, total_bits=8 << 20)
    assert 0 < bloom.best_layout(fixed, "avg", "fp").first()["fp"] < 1


def test_two_levels_stop_classified_reads(spark):
    ref = spark.createDataFrame([("f", "A", "A" * 20), ("g", "T", "T" * 20)], "file string, target string, seq string")
    two = spark.createDataFrame([("f", "CG", "CG" * 10), ("g", "A2", "A" * 20)], "file string, target string, seq string")
    reads = spark.createDataFrame([("readA", "A" * 14), ("readCG", "CG" * 7), ("readX", "ACACACACACACAC")], "read string, seq string")
    h = matching.read_hashes(reads, 10, 10, ["read"])
    rate = lambda s: s.select("target", F.lit(0.0).alias("fpr"))
    (i1, s1), (i2, s2) = matching.build_index(ref, 10, 10), matching.build_index(two, 10, 10)
    m = matching.hierarchy(h, [("2", [(i2, rate(s2), 0.5)], 0.0, 1.0), ("1", [(i1, rate(s1), 0.5)], 0.0, 1.0)], ["read"])
    got = {(x["hierarchy"], x["read"], x["target"], x["kmer_count"]) for x in m.collect()}
    assert got == {("1", "readA", "A", 5), ("1", "readA", "T", 5), ("2", "readCG", "CG", 5)}
    assert [x["read"] for x in matching.unclassified(reads, m, ["read"]).collect()] == ["readX"]


def test_em_prefers_unique_targets_and_keeps_reads(spark):
    m = [(f"u{i}", "a", 5) for i in range(4)] + [("u9", "b", 5)] + [(f"m{i}", t, 5) for i in range(6) for t in ("a", "b", "c")]
    df = spark.createDataFrame(m, "read string, target string, kmer_count int")
    got, one, rounds = resolve.em(df, ["read"])
    res = {x["target"]: (x["unique"], x["assigned"]) for x in got.collect()}
    assert res == {"a": (4, 6), "b": (1, 0), "c": (0, 0)} and rounds <= 3
    assert one.count() == 11 and one.filter("target = 'a'").count() == 10
    empty, one, _ = resolve.em(df.limit(0), ["read"])
    assert empty.count() == 0 and one.count() == 0


@pytest.mark.parametrize("end", ["", ".gz"])
def test_sequence_files(spark, tmp_path, end):
    pack = gzip.compress if end else (lambda b: b)
    (tmp_path / f"a.fa{end}").write_bytes(pack(b">x 1\nACGT\nAC\n>y\nGG\n"))
    (tmp_path / f"b.fq{end}").write_bytes(pack(b"@r1\nACG\n+\nIII\n@r2\nAC\n"))
    (tmp_path / f"c.fa{end}").write_bytes(b"")
    at = [str(tmp_path / f"{n}{end}") for n in ("a.fa", "b.fq", "c.fa")]
    got = sorted((x["pos"], x["id"], x["seq"]) for x in sequences.read_sequences(spark, at).collect())
    assert got == [(0, "x 1", "ACGTAC"), (1, "y", "GG")]
    assert sequences.read_sequences(spark, at, keep_partial=True).count() == 3
    assert sequences.list_files(spark, str(tmp_path), f".fq{end}").count() == 1


def test_manifests(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("p1\ta.fq\np1\tb.fq\tc.fq\n")
    assert [tuple(x) for x in sequences.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == [("p1", "a.fq", None), ("p1", "b.fq", "c.fq")]
    (tmp_path / "b.tsv").write_text("x/y.fa\n")
    assert [tuple(x) for x in sequences.read_build_manifest(spark, str(tmp_path / "b.tsv")).collect()] == [("x/y.fa", "y.fa")]
    (tmp_path / "i.tsv").write_text("x/y.fa\nz.fa\t\tn1\n")
    assert [x["target"] for x in sequences.read_input_file(spark, str(tmp_path / "i.tsv")).orderBy("file").collect()] == ["y.fa", "z.fa"]


def test_index_round_trip(spark, tmp_path):
    ref = spark.createDataFrame([("f", "A", "ACGTTGCA" * 4), ("g", "B", "GGGTACCA" * 4)], "file string, target string, seq string")
    index, sizes = matching.build_index(ref, 5, 8)
    matching.save_index(index, sizes, str(tmp_path / "ix"), 2, k=5, w=8)
    a, b, c = matching.load_index(spark, str(tmp_path / "ix"))
    assert a.exceptAll(index).count() == 0 and b.count() == 2 and c.first()["k"] == 5
    assert np.all(np.array([x["n_hashes"] for x in b.collect()]) > 0)


def fastq(n, width=30):
    r = random.Random(n)
    out = []
    for i in range(n):
        seq = "".join(r.choice("ACGT") for _ in range(r.randint(1, width)))
        # qualities that begin like a header or like the third line
        out.append((f"r{i}", seq, "@+I"[i % 3] + "I" * (len(seq) - 1)))
    return out


@pytest.mark.parametrize("split", [0, 17, 64, 1000])
def test_splits_give_every_record_once(spark, tmp_path, split):
    reads = fastq(120)
    (tmp_path / "r.fq").write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in reads))
    (tmp_path / "g.fa").write_text("".join(f">{i} x>y\r\n" + "\r\n".join(s[j : j + 7] for j in range(0, len(s), 7)) + "\r\n" for i, s, _ in reads))
    for name, ids in (("r.fq", [i for i, _, _ in reads]), ("g.fa", [f"{i} x>y" for i, _, _ in reads])):
        got = sequences.read_sequences(spark, str(tmp_path / name), split_bytes=split).orderBy("pos").collect()
        assert [(x["id"], x["seq"]) for x in got] == list(zip(ids, [s for _, s, _ in reads], strict=True))


def test_bounded_batches_of_a_long_file(tmp_path, monkeypatch):
    """Records come before the file is read to its end, in batches of bounded size."""
    monkeypatch.setattr(sequences, "BATCH", 1 << 16)
    monkeypatch.setattr(sequences, "CHUNK", 1 << 12)
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        for i in range(20_000):
            f.write(f"@r{i}\n{'ACGT' * 25}\n+\n{'I' * 100}\n")
    rows = ((str(tmp_path), i, a, b, False) for i, (a, b) in enumerate(sequences.records(str(tmp_path / "a.fq.gz"))))
    sizes = [b.num_rows for b in sequences._batches(rows, sequences._RECORDS)]
    assert sum(sizes) == 20_000 and max(sizes) < 600


def test_pairs_and_totals(spark, tmp_path):
    one, two = fastq(50), fastq(40, 12)
    with gzip.open(tmp_path / "1.fq.gz", "wt") as f:
        f.write("".join(f"@{i}/1\n{s}\n+\n{q}\n" for i, s, q in one))
    (tmp_path / "2.fq").write_text("".join(f"@{i}/2\n{s}\n+\n{q}\n" for i, s, q in two) + "@broken\nACG\n")
    (tmp_path / "m.tsv").write_text(f"p\t{tmp_path}/1.fq.gz\t{tmp_path}/2.fq\nq\t{tmp_path}/2.fq\n")
    got = sequences.read_batches(spark, sequences.read_manifest(spark, str(tmp_path / "m.tsv"))).orderBy("pos").collect()
    assert [(x["prefix"], x["id"], x["seq"], x["seq2"]) for x in got if x["prefix"] == "p"] == [("p", f"{a[0]}/1", a[1], b[1] if b else None) for a, b in zip(one, two + [None] * 10, strict=True)]
    assert [x["seq"] for x in got if x["prefix"] == "q"] == [s for _, s, _ in two]
    assert len({(x["file"], x["pos"]) for x in got}) == 90
    rows = sequences.scan(spark, [str(tmp_path / "1.fq.gz"), str(tmp_path / "2.fq")])
    listed = rows.select("file").distinct().unionByName(spark.createDataFrame([("gone.fq",)], "file string"))
    letters = [len(s) for _, s, _ in one + two]
    total = sequences.totals(rows, 5, listed).first()
    assert tuple(total) == (1, 2, sum(x >= 5 for x in letters), sum(x < 5 for x in letters), sum(x for x in letters if x >= 5))
    with pytest.raises(Exception, match="No such file|not find|does not exist"):
        sequences.read_batches(spark, spark.createDataFrame([("p", str(tmp_path / "none.fq"), None)], "prefix string, file1 string, file2 string")).collect()
