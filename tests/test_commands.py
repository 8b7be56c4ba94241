import random

import pytest
from pyspark.sql import functions as F

from taxaloom.operators import matching, taxonomy
from taxaloom.plans import commands, options
from taxaloom.sources import sequences, tables as io

R = random.Random(8)
DNA = {t: "".join(R.choice("ACGT") for _ in range(400)) for t in ("t1", "t2", "t3")}
TAX = [("1", "0", "root", "root", 0), ("G", "1", "genus", "genus G", 0), ("S1", "G", "species", "sp 1", 100), ("S2", "G", "species", "sp 2", 200), ("S3", "1", "species", "sp 3", 300)]


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("db") / "a")
    info = spark.createDataFrame([("f1", "t1", "S1", None, None), ("f2", "t2", "S2", None, None), ("f3", "t3", "S3", None, None), ("f9", "t9", "gone", None, None)], "file string, target string, node string, specialization string, specialization_name string")
    seqs = spark.createDataFrame([(f"f{t[1]}", s) for t, s in DNA.items()], "file string, seq string")
    tax = spark.createDataFrame(TAX, "node string, parent string, rank string, name string, genome_size long")
    o = options.Build(kmer=11, window=15, partitions=2, hash_functions=0)
    commands.build_custom(spark, info, seqs, out, tax, o)
    commands.build_custom(spark, info, seqs, out, tax, o)  # nothing is left to do
    return out, info, seqs, tax


def reads(spark):
    common = "".join(random.Random(1).choice("ACGT") for _ in range(60))
    data = [("p", f"u{i}", DNA["t1"][i * 20 : i * 20 + 80], i) for i in range(6)] + [("p", "x", common, 90), ("q", "v", DNA["t3"][:100], 91), ("q", "short", "ACGT", 92)]
    return spark.createDataFrame(data, "prefix string, id string, seq string, pos long")


@pytest.mark.parametrize("how", ["em", "lca", "skip"])
def test_classify_keeps_the_counts(spark, db, tmp_path, how):
    out = str(tmp_path / "run")
    o = options.Classify(how, True, True, True, True)
    rep = commands.classify(spark, reads(spark), [options.Level("H1", [db[0]], fpr_query=1.0)], out, o)
    tot = {x["prefix"]: (x["classified"], x["unclassified"]) for x in spark.read.parquet(f"{out}/totals").collect()}
    assert tot == {"p": (6, 1), "q": (1, 1)}
    assert {(x["prefix"], x["target"]): (x["matches"], x["unique"], x["lca"]) for x in rep.collect()} == {("p", "t1"): (6, 6, 0), ("q", "t3"): (1, 1, 0)}
    assert spark.read.text(f"{out}/all").count() == 7 == spark.read.text(f"{out}/one").count()
    assert spark.read.text(f"{out}/unc").count() == 2
    sta = {x["prefix"]: x for x in spark.read.option("header", True).option("sep", "\t").csv(f"{out}/sta").collect()}
    assert sta["-total-"]["skipped_small"] == "1" and sta["q"]["unclassified"] == "0"


def test_report_of_a_run(spark, db, tmp_path):
    out = str(tmp_path / "run")
    rep = commands.classify(spark, reads(spark), [options.Level("H1", [db[0]], fpr_query=1.0)], out)
    tot = spark.read.parquet(f"{out}/totals").agg(F.sum("classified").alias("classified"), F.sum("unclassified").alias("unclassified"))
    tax = spark.read.parquet(f"{db[0]}/tax")
    assert {x["node"] for x in tax.collect()} == {"1", "G", "S1", "S2", "S3", "t1", "t2", "t3"}
    for kind in ("reads", "abundance", "matches", "dist", "corr"):
        rows = commands.report(rep, tot, tax, options.Report(kind)).collect()
        assert rows[0]["target"] == "1" and rows[0]["cumulative"] == 7
    text = commands.report(rep, tot, tax, options.Report("reads", output_format="text", ranks=None))
    assert text.columns == ["value"]
    box = commands.report(rep, tot, tax, options.Report("reads", output_format="bioboxes"))
    assert "1" not in {x["node"] for x in box.collect()}
    assert set(commands.split_reports(rep, tot, tax, options.Report("reads"))) == {"H1"}
    tre = commands.report(rep, tot, tax, options.Report("reads")).withColumn("label", F.lit("s"))
    wide = commands.table(tre, options.Table(rank="species"))
    assert {x["taxon"]: x["s"] for x in wide.collect()} == {"sp 1": 6, "sp 3": 1}
    assert commands.table(tre, options.Table(no_root=True)).agg(F.sum("s")).first()[0] == 7


BROKEN = [("1", "0", "root"), ("G", "absent", "genus"), ("S1", "G", "species"), ("N", None, "species"), ("B", "C", "genus"), ("C", "B", "genus"), ("S2", "C", "species"), ("I", "I", "species"), ("T", "0", "species")]


@pytest.mark.parametrize("has_root", [True, False])
def test_report_counts_what_the_root_does_not_reach(spark, has_root):
    tax = spark.createDataFrame([(n, p, r, n) for n, p, r in BROKEN if has_root or n != "1"], "node string, parent string, rank string, name string")
    counts = {"S1": 1, "N": 2, "S2": 4, "I": 8, "T": 16, "new": 32}
    rep = spark.createDataFrame([("H", t, n, n, 0) for t, n in counts.items()], "hierarchy string, target string, matches long, unique long, lca long")
    tot = spark.createDataFrame([(63, 0)], "classified long, unclassified long")
    for kind in ("reads", "matches"):
        rows = {x["target"]: (x["lineage"], x["cumulative"]) for x in commands.report(rep, tot, tax, options.Report(kind, ranks=None)).collect()}
        assert rows == {"1": ("1", 63), "G": ("1|G", 1), "S1": ("1|G|S1", 1), "N": ("1|N", 2), "B": ("1|B", 4), "C": ("1|B|C", 4), "S2": ("1|B|C|S2", 4), "I": ("1|I", 8), "T": ("1|T", 16), "new": ("1|new", 32)}


def test_build_keeps_what_the_root_does_not_reach(spark, tmp_path):
    tax = spark.createDataFrame([(n, p, r, n, 0) for n, p, r in BROKEN], "node string, parent string, rank string, name string, genome_size long")
    info = spark.createDataFrame([("f1", "t1", "S1", None, None), ("f2", "t2", "S2", None, None), ("f3", "t3", "I", None, None)], "file string, target string, node string, specialization string, specialization_name string")
    seqs = spark.createDataFrame([(f"f{t[1]}", s) for t, s in DNA.items()], "file string, seq string")
    out = str(tmp_path / "db")
    commands.build_custom(spark, info, seqs, out, tax, options.Build(kmer=11, window=15, partitions=2, hash_functions=0))
    got = {(x["node"], x["parent"]) for x in spark.read.parquet(f"{out}/tax").collect()}
    assert got == {("1", "0"), ("G", "1"), ("S1", "G"), ("t1", "S1"), ("B", "1"), ("C", "B"), ("S2", "C"), ("t2", "S2"), ("I", "1"), ("t3", "I")}


def test_update_replays_the_options(spark, db, tmp_path):
    old, info, seqs, tax = db
    more = spark.createDataFrame([("f4", "t4", "S3")], "file string, target string, node string")
    with pytest.raises(ValueError):
        commands.update(spark, old, more, seqs, str(tmp_path / "no"), tax)
    extra = spark.createDataFrame([("f4", DNA["t1"][::-1])], "file string, seq string")
    commands.update(spark, old, more, seqs.union(extra), str(tmp_path / "new"), tax)
    index, targets, config = matching.load_index(spark, str(tmp_path / "new"))
    assert {x["target"] for x in targets.collect()} == {"t1", "t2", "t3", "t4"} and config.first()["kmer"] == 11
    assert targets.filter("fpr > 0.06").count() == 0


def test_reassign_rewrites_the_counts(spark):
    m = [("H", f"u{i}", "a", 5) for i in range(3)] + [("H", "m", t, 5) for t in ("b", "a")]
    all_ = spark.createDataFrame(m, "hierarchy string, readid string, target string, kmer_count int")
    rep = spark.createDataFrame([("H", "a", 4, 3, 0), ("H", "b", 1, 0, 0), ("H", "G", 0, 0, 1)], "hierarchy string, target string, matches long, unique long, lca long")
    for single in (False, True):
        one, new = commands.reassign(all_, rep, single=single)
        assert one.count() == 4
        assert {(x["target"], x["unique"], x["lca"]) for x in new.collect()} == {("a", 3, 1), ("b", 0, 0)}


def test_inputs_by_file_and_by_sequence(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">s1 x\nACGT\n>s2\nAC\n")
    info, seqs = commands.read_inputs(spark, str(tmp_path), ".fna")
    assert [x["target"] for x in info.collect()] == ["a.fna"] and seqs.count() == 2
    info, seqs = commands.read_inputs(spark, str(tmp_path), ".fna", by_sequence=True)
    assert {x["target"] for x in info.collect()} == {"s1", "s2"}


@pytest.mark.parametrize("bad", [options.Build(kmer=32), options.Build(window=3), options.Build(mode="x"), options.Build(max_fp=2), options.Build(hash_functions=9), options.Classify("x"), options.Report("x"), options.Report(top_percentile=2), options.Table(top_all=1, top_sample=1)])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        bad.check()


def test_files_of_a_profile(spark, db, tmp_path):
    out = str(tmp_path / "run")
    levels = [options.Level("H2", [db[0]], fpr_query=1.0), options.Level("H1", [db[0]], [1.0], fpr_query=1.0)]
    o = options.Classify("em", output_all=True, output_single=True, ranks=None)
    got = commands.profile(spark, reads(spark), levels, out, o)
    assert set(got) == {"p", "q"}
    rows = {x["target"]: x for x in got["p"].collect()}
    assert rows["-"]["rank"] == "unclassified" and rows["-"]["cumulative"] == 1 and rows["1"]["cumulative"] == 6 and rows["t1"]["lineage"] == "1|G|S1|t1"
    lines = [x["value"] for x in spark.read.text(f"{out}/rep_text/prefix=q").collect()]
    assert lines[-2:] == ["#total_classified\t1", "#total_unclassified\t1"] and lines[0].startswith("H1\tt3\t1\t1\t0\ttarget\t")
    body, totals = io.read_rep(spark, f"{out}/rep_text/prefix=p")
    assert body.count() == 1 and tuple(totals.first()) == (6, 1)
    sta = [tuple(x) for x in spark.read.csv(f"{out}/sta_levels", sep="\t", header=True).collect()]
    assert len(sta[0]) == 18 and [x[:6] for x in sta if x[0] == "q"] == [("q", "-total-", "1", "0", "1", "100.0"), ("q", "H1", "1", "0", "1", "100.0"), ("q", "H2", "1", "0", "0", "0.0")]
    assert spark.read.text(f"{out}/all").columns == ["value", "prefix"]
    few, counts = options.binning(levels)
    assert few[0].rel_cutoff == [0.25] and counts.report_type == "reads" and counts.min_count == 0
    assert commands.profile(spark, reads(spark), few, out, options.Classify("skip", report=False)) == {}
    for wrong in (options.Level("H", []), options.Level("H", ["x"], [1.5]), options.Level("H", ["x"], rel_filter=-1)):
        with pytest.raises(ValueError):
            commands.classify(spark, reads(spark), [wrong], out)
    with pytest.raises(ValueError):
        options.Classify(min_count=-1).check()


def test_discards_and_pairs(spark, db, tmp_path):
    """Both mates of files are one read; what the filters discard is counted."""
    a, b = DNA["t1"][:90], DNA["t2"][:40]
    (tmp_path / "1.fa").write_text(f">r1\n{a}\n>r2\n{DNA['t3'][:90]}\n")
    (tmp_path / "2.fa").write_text(f">r1\n{b}\n")
    (tmp_path / "m.tsv").write_text(f"s\t{tmp_path}/1.fa\t{tmp_path}/2.fa\n")
    rows = sequences.read_batches(spark, sequences.read_manifest(spark, str(tmp_path / "m.tsv")))
    rep = commands.classify(spark, rows, [options.Level("H", [db[0]], [0.1], 0.0, 1.0)], str(tmp_path / "run"), options.Classify("lca"))
    got = {x["target"]: (x["matches"], x["unique"], x["dis_matches_rel_filter"]) for x in rep.collect()}
    assert got == {"t1": (1, 1, 0), "t3": (1, 1, 0)}
    sta = spark.read.csv(str(tmp_path / "run" / "sta_levels"), sep="\t", header=True).first()
    assert (sta["seq_processed"], sta["seq_classified"], sta["dis_matches_rel_filter"]) == ("2", "2", "1")


def test_text_sinks(spark, db, tmp_path):
    out = str(tmp_path / "run")
    rep = commands.classify(spark, reads(spark), [options.Level("H1", [db[0]], fpr_query=1.0)], out)
    tot = spark.read.parquet(f"{out}/totals").agg(F.sum("classified").alias("classified"), F.sum("unclassified").alias("unclassified"))
    tax = spark.read.parquet(f"{db[0]}/tax")
    box = commands.report(rep, tot, tax, options.Report("reads", output_format="bioboxes", ranks=["genus", "species"]))
    commands.write_bioboxes(box, f"{out}/box", "s1 H1", ["genus", "species"], "own")
    lines = [x["value"] for x in spark.read.text(f"{out}/box").collect()]
    assert lines[:5] == ["@Version:0.10.0", "@SampleID:s1 H1", "@Ranks:genus|species", "@Taxonomy:own", "@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE"]
    assert {x.split("\t")[0]: x.split("\t")[4] for x in lines[5:]} == {"G": "66.6667", "S1": "66.6667", "S3": "11.1111"}
    tre = commands.report(rep, tot, tax, options.Report("reads")).withColumn("label", F.lit("s"))
    commands.write_table(commands.table(tre, options.Table(rank="species")), f"{out}/table")
    assert [x["value"] for x in spark.read.text(f"{out}/table").collect()] == ["taxon\ts", "sp 1\t6", "sp 3\t1"]
    values = [0.0, 100.0, 66.66666667, 1e-5, 0.00012345678, 123456.7, 1234567.0, 0.5, 99.9999999, -2.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", io.significant(F.col("v")).alias("t"))
    assert [x["t"] for x in df.orderBy("i").collect()] == ["%g" % v for v in values]
    for n in ("a.rep", "ab.rep", "a.tre", "c.rep"):
        (tmp_path / n).write_text("")
    assert [x.rsplit("/", 1)[1] for x in io.find_reps(spark, str(tmp_path))] == ["a.rep", "ab.rep", "c.rep"]
    assert [x.rsplit("/", 1)[1] for x in io.find_reps(spark, f"{tmp_path}/a")] == ["a.rep", "ab.rep"]


def test_conversion_between_taxonomies(spark, tmp_path):
    own = spark.createDataFrame([("1", "0", "root", "root"), ("10", "1", "genus", "g"), ("11", "10", "species", "a"), ("12", "10", "species", "b")], "node string, parent string, rank string, name string")
    other = spark.createDataFrame([("1", "0", "root", "root"), ("g__X", "1", "genus", "X"), ("s__A", "g__X", "species", "A"), ("s__B", "g__X", "species", "B"), ("s__C", "1", "species", "C")], "node string, parent string, rank string, name string")
    (tmp_path / "merged.dmp").write_text("9\t|\t11\t|\n")
    merged = io.read_merged(spark, str(tmp_path / "merged.dmp"))
    (tmp_path / "meta.tsv").write_text("accession\tncbi_taxid\tgtdb_taxonomy\nx\t11\td__D;g__X;s__A\ny\t11\td__D;g__X;s__B\nz\t12\td__D;s__C\n")
    info = spark.createDataFrame([("f1", "t1", "9", None, None), ("f2", "t2", "12", None, None), ("f3", "t3", "77", None, None)], "file string, target string, node string, specialization string, specialization_name string")

    def moved(**k):
        rows, tax, ranks = taxonomy.translate_info(info, own, merged, **k)
        return {x["target"]: x["node"] for x in rows.collect()}, {(x["step"], x["rank"]): x["n"] for x in ranks.collect()}

    assert moved() == ({"t1": "11", "t2": "12", "t3": "77"}, {("from", "species"): 2, ("from", "-INVALID-"): 1})
    to = io.read_gtdb_translation(spark, str(tmp_path / "meta.tsv"))
    nodes, ranks = moved(mapping=to, other=other)
    assert nodes == {"t1": "g__X", "t2": "s__C", "t3": None} and ranks[("to", "genus")] == 1 == ranks[("to", "-INVALID-")]
    # the other way: several names of one node, then within the other kind and within this one
    back = io.read_gtdb_translation(spark, str(tmp_path / "meta.tsv"), to_gtdb=False)
    rows = taxonomy.translate_info(info.withColumn("node", F.lit("s__B")), other, None, back, own)[0]
    assert {x["node"] for x in rows.collect()} == {"11"}
    versions = spark.createDataFrame([("s__A", "s__B"), ("s__A", "s__C")], "node string, other string")
    assert {x["node"] for x in taxonomy.translate_info(info.withColumn("node", F.lit("s__A")), other, None, versions, other)[0].collect()} == {"1"}
    newer = spark.createDataFrame([("12", "13")], "old string, new string")
    assert moved(other=own, other_merged=newer)[0] == {"t1": "11", "t2": "13", "t3": "77"}
    seqs = spark.createDataFrame([(f"f{t[1]}", s) for t, s in DNA.items()], "file string, seq string")
    out = str(tmp_path / "db")
    commands.build_custom(spark, info, seqs, out, own, options.Build(kmer=11, window=15, partitions=2), conversion={"merged": merged, "mapping": to, "other": other})
    assert {(x["node"], x["parent"]) for x in spark.read.parquet(f"{out}/tax").collect()} == {("1", "0"), ("g__X", "1"), ("s__C", "1"), ("t1", "g__X"), ("t2", "s__C")}
    assert spark.read.json(f"{out}/totals").first().asDict() == {"files": 2, "invalid_files": 0, "sequences": 2, "skipped_sequences": 0, "length_bp": 800}
    (tmp_path / "sizes.tsv").write_text("#species_taxid\tmin\tmax\texpected\n11\t1\t9\t5\n11\t1\t9\t7\n")
    assert [tuple(x) for x in io.read_genome_sizes(spark, str(tmp_path / "sizes.tsv")).collect()] == [("11", 7)]
    assert {(x["node"], x["parent"]) for x in io.dummy_tax(info).collect()} == {("1", "0"), ("t1", "1"), ("t2", "1"), ("t3", "1")}
