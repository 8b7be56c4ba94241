import random
from math import floor

import pytest
from pyspark.sql import functions as F

from taxaloom.operators import report, resolve, table, taxonomy
from taxaloom.plans import profile_queries
from taxaloom.sources import tables as io

TREE = [("1", "0", "root"), ("AB", "1", "genus"), ("A", "AB", "species"), ("B", "AB", "species"), ("C", "1", "species"), ("A1", "A", "strain"), ("A2", "A", "strain")]


@pytest.fixture(scope="module")
def line(spark):
    tax = spark.createDataFrame([(n, p, r, f"name {n}") for n, p, r in TREE], "node string, parent string, rank string, name string")
    return taxonomy.kept_lineages(tax)


def test_lineages_and_ancestors(spark, line):
    got = {x["node"]: x for x in line.withColumn("sp", taxonomy.parent_rank("species")).withColumn("near", taxonomy.closest_parent(["genus", "species"])).collect()}
    assert got["A1"]["path"] == ["1", "AB", "A", "A1"] and got["A1"]["depth"] == 3
    assert (got["A1"]["sp"], got["AB"]["sp"], got["A1"]["near"], got["1"]["near"]) == ("A", None, "A", "1")
    tips = {}
    for x in taxonomy.leaves(line).collect():
        tips.setdefault(x["anc"], set()).add(x["leaf"])
    assert tips["AB"] == {"A1", "A2", "B"} and tips["C"] == {"C"}
    few = spark.createDataFrame([("A1",)], "node string")
    assert {x["node"] for x in taxonomy.keep_with_ancestors(line, few).collect()} == {"1", "AB", "A", "A1"}


def test_lineages_have_no_limit_of_depth(spark):
    deep = [("1", "1", "root")] + [(f"d{i}", f"d{i - 1}" if i else "1", f"r{i}") for i in range(150)]
    off = [("x", "y", "s"), ("y", "x", "s"), ("z", "x", "s"), ("q", "gone", "s"), ("p", "q", "s"), ("n", None, "s"), ("m", "n", "s"), (None, "1", "s"), ("d0", "1", "r9"), ("d0", None, "a")]
    tax = spark.createDataFrame([(n, p, r, f"name {n}") for n, p, r in deep + off], "node string, parent string, rank string, name string")
    got = {x["node"]: x for x in taxonomy.lineages(tax).collect()}
    path = [n for n, _, _ in deep]
    assert set(got) == set(path)
    for i, n in enumerate(path):
        assert (got[n]["depth"], got[n]["path"], got[n]["ranks"]) == (i, path[: i + 1], [r for _, _, r in deep[: i + 1]])
        assert got[n]["rank"] == deep[i][2] and got[n]["names"][-1] == got[n]["name"] == f"name {n}"
    assert taxonomy.lineages(tax.filter("node <> '1'")).count() == 0


@pytest.mark.parametrize("nodes,want", [(["A1", "A2"], "A"), (["A1", "B", "A2"], "AB"), (["A", "A1"], "A"), (["A1", "C"], "1"), (["A1", "gone"], "1"), (["B"], "B")])
def test_lca(spark, line, nodes, want):
    df = spark.createDataFrame([(7, n) for n in nodes + nodes[:1]], "read int, target string")
    assert [tuple(x) for x in resolve.lca(df, line, ["read"]).collect()] == [(7, want)]


def test_first_taxonomy_wins_and_orphans_are_added(spark):
    a = spark.createDataFrame([("x", "1", "s", "first")], "node string, parent string, rank string, name string")
    b = spark.createDataFrame([("x", "2", "s", "second"), ("y", "9", "s", "y"), (None, "1", "s", "z")], a.schema)
    m = taxonomy.merge_taxonomies([a, b])
    assert {(x["node"], x["name"]) for x in m.collect()} == {("x", "first"), ("y", "y")}
    t = spark.createDataFrame([("x",), ("q",), ("q",)], "target string")
    assert {(x["node"], x["parent"]) for x in taxonomy.add_orphans(a, t).collect()} == {("x", "1"), ("q", "1")}
    assert {(x["node"], x["parent"]) for x in taxonomy.attach_unreachable(m).collect()} == {("x", "1"), ("y", "1")}


def test_all_labels_of_tax_are_merged(spark, tmp_path):
    rows = [("a", "1", "fungal"), ("a", "0", "arcvir"), ("b", "2", "envmix"), ("c", "3", "arcvir"), ("c", "0", "new"), ("c", "0", None), ("d", "4", "new"), ("e", "5", None), (None, "6", None)]
    df = spark.createDataFrame(rows, "node string, parent string, db_label string")
    df.select("node", "parent", F.lit("r").alias("rank"), F.lit("n").alias("name"), "db_label").write.parquet(str(tmp_path / "tax.parquet"))
    got = [tuple(x) for x in profile_queries.joi7_merge_taxonomies(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")]


def _loop_redistribute(rep, tips):
    rep = {t: list(v) for t, v in rep.items()}
    gain = {}
    for t, (m, u, s) in rep.items():
        leaves = [x for x in tips.get(t, []) if x != t]
        if not s or not leaves:
            continue
        field = 1 if any(rep.get(x, [0, 0, 0])[1] for x in leaves) else 0
        has = [x for x in leaves if x in rep and rep[x][field] > 0]
        if not has:
            continue
        total = sum(rep[x][field] for x in has)
        given = {x: floor(s * (rep[x][field] / total)) for x in has}
        left = s - sum(given.values())
        for x in sorted(has, key=lambda x: (-rep[x][1], -rep[x][0], x))[:left]:
            given[x] += 1
        for x, g in given.items():
            gain[x] = gain.get(x, 0) + g
        gain[t] = gain.get(t, 0) - s
    return {t: (v[0], v[1], v[2] + gain.get(t, 0)) for t, v in rep.items()}


@pytest.mark.parametrize("seed", range(4))
def test_redistribution_against_a_loop(spark, line, seed):
    r = random.Random(seed)
    rep = {n: (r.randrange(9), r.choice([0, 0, r.randrange(5)]), 0 if n[-1] in "12BC" else r.randrange(12)) for n, _, _ in TREE if r.random() < 0.9}
    tips = {}
    for x in taxonomy.leaves(line).collect():
        tips.setdefault(x["anc"], []).append(x["leaf"])
    df = spark.createDataFrame([(k, *v) for k, v in rep.items()], "target string, matches long, unique long, lca long")
    got = {x["target"]: (x["matches"], x["unique"], x["lca"]) for x in report.redistribute(df, line).collect()}
    assert got == _loop_redistribute(rep, tips)
    assert sum(v[2] for v in got.values()) == sum(v[2] for v in rep.values())


@pytest.mark.parametrize("kind", report.TYPES)
def test_report_invariants(spark, line, kind):
    rep = spark.createDataFrame([("A1", 9, 5, 0), ("A2", 3, 1, 0), ("B", 4, 0, 0), ("AB", 0, 0, 7), ("C", 2, 2, 0)], "target string, matches long, unique long, lca long")
    tot = spark.createDataFrame([(15, 5)], "classified long, unclassified long")
    sizes = spark.createDataFrame([("A1", 10), ("A", 10), ("B", 20), ("C", 40), ("1", 20)], "node string, genome_size long")
    rows = {x["node"]: x for x in report.build(rep, tot, line, kind, sizes).collect()}
    root = rows["1"]
    assert root["cumulative"] == (18 if kind == "matches" else 15)
    assert abs(root["share"] - (1.0 if kind == "matches" else 0.75)) < 1e-9
    for n, p, _ in TREE[1:]:
        if n in rows:
            assert rows[n]["cumulative"] <= rows[p]["cumulative"] and rows[n]["children"] >= 0
    text = report.tre(report.order(report.build(rep, tot, line, kind, sizes)))
    assert text.first()["target"] == "1" and text.columns == io.TRE.replace("string", "").replace("bigint", "").replace("double", "").replace(" ", "").split(",")


def test_report_filters(spark, line):
    rep = spark.createDataFrame([("A1", 9, 5, 0), ("A2", 3, 1, 0), ("B", 4, 2, 0), ("C", 2, 2, 0)], "target string, matches long, unique long, lca long")
    tot = spark.createDataFrame([(10, 0)], "classified long, unclassified long")
    rows = report.build(rep, tot, line, "reads")
    kept = lambda **k: {x["node"] for x in report.select(rows, **k).collect()}
    assert kept(min_count=1) == kept(max_count=1) == kept() == {"1", "AB", "A", "B", "C", "A1", "A2"}
    assert kept(min_count=2) == {"1", "AB", "A", "B", "C", "A1"}
    assert kept(max_count=0.25) == {"1", "B", "C", "A2"}
    assert kept(taxids=["A"]) == {"1", "A", "A1", "A2"}
    assert kept(names=["name B"]) == {"1", "B"} and kept(names_with=["A"]) == {"1", "AB", "A", "A1", "A2"}
    assert kept(ranks=["species"], percentile=0.5) == {"1", "A"}  # the two with the share at the cut go together
    assert report.order(rows, "count").first()["node"] == "1"
    wide = [x["value"] for x in report.text_lines(rows.select("node", "rank")).collect()]
    assert len({len(x) for x in wide}) == 1
    with pytest.raises(ValueError):
        report.select_hierarchies(rep, ["a"], ["b"])


def test_genome_sizes_fall_back_to_ancestors(spark, line):
    known = spark.createDataFrame([("A1", 10), ("A2", 21)], "node string, genome_size long")
    got = {x["node"]: x["genome_size"] for x in taxonomy.estimate_genome_sizes(line, known, line.select("node")).collect()}
    assert got == {"A1": 10, "A2": 21, "A": 15, "AB": 15, "B": 15, "1": 15, "C": 15}
    none = taxonomy.estimate_genome_sizes(line, known.limit(0), line.select("node")).collect()
    assert {x["genome_size"] for x in none} == {1}


def test_null_sizes_are_unknown_and_all_customers_are_read(spark, line, tmp_path):
    known = spark.createDataFrame([("A1", None), ("A", 10), ("C", 30)], "node string, genome_size long")
    got = {x["node"]: x["genome_size"] for x in taxonomy.estimate_genome_sizes(line, known, line.select("node")).collect()}
    assert got == {"A1": 10, "A2": 10, "A": 10, "AB": 10, "B": 10, "C": 30, "1": 16}
    spark.range(1, 8).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    sizes = {x["node"]: x["genome_size"] for x in profile_queries.sizes(spark, str(tmp_path)).collect()}
    assert sizes == {"c1": 1500, "c2": 2000, "c3": None, "c4": 3000, "c5": 3500, "c6": None, "c7": 1000}


def _loop_uncumulate(count, path):
    count = dict(count)
    for t in sorted(path, key=lambda k: len(path[k]), reverse=True):
        for p in path[t][:-1]:
            if p in count:
                count[p] -= count[t]
    return count


@pytest.mark.parametrize("seed", range(3))
def test_uncumulate_against_a_loop(spark, seed):
    r = random.Random(seed)
    parent = {"1": None}
    for i in range(40):
        parent[f"n{i}"] = r.choice(list(parent))
    path = {}
    for n in parent:
        line, x = [n], n
        while parent[x]:
            x = parent[x]
            line.append(x)
        path[n] = line[::-1]
    own = {n: r.randrange(5) for n in parent}
    cum = {n: sum(own[m] for m in parent if n in path[m]) for n in parent}
    shown = {n: cum[n] for n in parent if n == "1" or r.random() < 0.6}
    df = spark.createDataFrame([("s", n, n, path[n], c) for n, c in shown.items()], "label string, taxid string, name string, path array<string>, count long")
    got = {x["taxid"]: x["count"] for x in table.uncumulate(df).collect()}
    assert got == _loop_uncumulate(shown, {n: path[n] for n in shown}) and sum(got.values()) == cum["1"]


@pytest.fixture()
def tre(spark):
    data = [("s1", "unclassified", "-", "-", "unclassified", 5), ("s1", "root", "1", "1", "root", 10), ("s1", "species", "a", "1|a", "a", 6), ("s1", "species", "b", "1|b", "b", 3),
            ("s2", "root", "1", "1", "root", 4), ("s2", "species", "b", "1|b", "b", 0)]
    return spark.createDataFrame(data, "label string, rank string, target string, lineage string, name string, cumulative long")


def test_table_steps(spark, tre):
    rows, tot = table.parse(tre, "species")
    assert {(x["label"], x["total"], x["unclassified"]) for x in tot.collect()} == {("s1", 15, 5), ("s2", 4, 0)}
    kept, t2 = table.top_sample(rows, tot, 1)
    assert {(x["label"], x["taxid"]) for x in kept.collect()} == {("s1", "a"), ("s2", "b")}
    assert {(x["label"], x["filtered"]) for x in t2.collect()} == {("s1", 3), ("s2", 0)}
    kept, _ = table.min_frequency(rows, tot, 2)
    assert {x["taxid"] for x in kept.collect()} == {"b"}
    kept, _ = table.top_all(rows, tot, 1)
    assert {x["taxid"] for x in kept.collect()} == {"a"}
    long = table.values(rows, tot, "counts", "taxid", "u", "u")
    assert {tuple(x) for x in table.skip_zeros(long).collect()} == {("s1", "a", 6), ("s1", "b", 3), ("s1", "u", 5)}
    wide = table.pivot(table.values(rows, tot, "percentage", "name"))
    assert wide.columns == ["taxon", "s1", "s2"] and wide.count() == 2
    with pytest.raises(ValueError):
        table.pivot(long, most=1)
    all_rows, all_tot = table.parse(tre)
    cut, t3 = table.no_root(table.uncumulate(all_rows), all_tot)
    assert {x["unclassified"] for x in t3.filter("label = 's1'").collect()} == {6}
    assert cut.filter("taxid = 'a'").first()["path"] == ["a"]


def test_text_relations(spark, tmp_path):
    (tmp_path / "x.rep").write_text("H1\ta\t5\t2\t1\tspecies\tname a\nH1\ta\t1\t1\t0\tspecies\tname a\n#total_classified\t4\n#total_unclassified\t6\n")
    body, tot = io.read_rep(spark, str(tmp_path / "x.rep"))
    assert [tuple(x)[:5] for x in body.collect()] == [("H1", "a", 6, 3, 1)] and tuple(tot.first()) == (4, 6)
    assert io.read_rep(spark, str(tmp_path / "x.rep"), True)[1].first()["unclassified"] == 0
    assert [x["value"] for x in io.rep_lines(body, tot).orderBy("part").collect()] == ["H1\ta\t6\t3\t1\tspecies\tname a", "#total_classified\t4", "#total_unclassified\t6"]
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tx y\t|\t\t|\tscientific name\t|\n2\t|\tz\t|\t\t|\tsynonym\t|\n")
    got = {tuple(x) for x in io.read_dmp(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp")).collect()}
    assert got == {("1", "0", "root", "root"), ("2", "1", "species", "x y")}
    (tmp_path / "g.tsv").write_text("RS_GCF_1.1\td__B;p__P;s__S x\n")
    g = io.read_gtdb(spark, str(tmp_path / "g.tsv"))
    assert tuple(g.first())[:2] == ("GCF_1.1", "s__S x")
    assert {(x["node"], x["parent"], x["rank"]) for x in io.gtdb_edges(g).collect()} == {("1", "0", "root"), ("d__B", "1", "domain"), ("p__P", "d__B", "phylum"), ("s__S x", "p__P", "species")}
    (tmp_path / "a.tsv").write_text("accession\taccession.version\ttaxid\tgi\nA\tA.1\t7\t0\nB\tB.1\t0\t0\nC\tC.1\t8\t0\n")
    known = spark.createDataFrame([("A.1",), ("B.1",)], "accession string")
    assert [tuple(x) for x in io.read_accession2taxid(spark, str(tmp_path / "a.tsv"), known).collect()] == [("A.1", "7")]
    io.write_tsv(g.select("accession", "node"), str(tmp_path / "out"), single=True)
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "GCF_1.1\ts__S x"


def test_conversion_takes_the_lca_of_images(spark, line):
    nodes = spark.createDataFrame([("t1", "x"), ("t2", "y"), ("t3", "none")], "target string, node string")
    mapping = spark.createDataFrame([("x", "A1"), ("x", "A2"), ("y", "C")], "node string, other string")
    assert {tuple(x) for x in taxonomy.convert(nodes, mapping, line).collect()} == {("t1", "A"), ("t2", "C"), ("t3", None)}


def test_conversion_maps_all_customers(spark, tmp_path):
    frames = {
        "region": spark.range(2).selectExpr("id AS r_regionkey", "'r' AS r_name"),
        "nation": spark.range(4).selectExpr("id AS n_nationkey", "id % 2 AS n_regionkey", "'n' AS n_name"),
        "customer": spark.range(1, 301).selectExpr("id AS c_custkey", "CASE WHEN id <= 120 THEN 0 WHEN id % 60 = 1 THEN 2 WHEN id % 60 = 2 THEN 1 ELSE 0 END AS c_nationkey", "'c' AS c_name"),
        "supplier": spark.range(1, 53).selectExpr("id AS s_suppkey"),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {x["target"]: x["node"] for x in profile_queries.tre11_convert(spark, str(tmp_path)).collect()}
    assert got == {f"s{i}": {1: "r0", 2: "1"}.get(i % 50, "n0") for i in range(1, 53)}


def test_conversion_of_targets_with_several_nodes(spark, line):
    nodes = spark.createDataFrame([("t1", "x"), ("t1", "y"), ("t2", "x"), ("t3", "y"), ("t3", "none"), ("t4", "gone")], "target string, node string")
    mapping = spark.createDataFrame([("x", "A1"), ("x", "A2"), ("y", "B"), ("y", "B"), ("gone", "q"), ("gone", "C")], "node string, other string")
    assert {tuple(x) for x in taxonomy.convert(nodes, mapping, line).collect()} == {("t1", "AB"), ("t2", "A"), ("t3", "B"), ("t4", "1")}


def test_specializations_and_levels(spark, line):
    info = spark.createDataFrame([("t1", "A", "s1", "S one"), ("t2", "B", "s1", None), ("t3", "B", None, None), ("t4", "C", "s4", "four")], "target string, node string, specialization string, specialization_name string")
    ok = taxonomy.validate_specializations(info)
    assert {(x["target"], x["specialization"]) for x in ok.collect()} == {("t1", "t1"), ("t2", "t2"), ("t3", "t3"), ("t4", "s4")}
    tax = line.select("node", F.get("path", F.size("path") - 2).alias("parent"), "rank", "name", F.lit(5).cast("bigint").alias("genome_size"))
    built = taxonomy.build_tax(tax, ok, "specialization")
    assert {(x["node"], x["parent"], x["genome_size"]) for x in built.filter("rank = 'specialization'").collect()} == {("t1", "A", 5), ("t2", "B", 5), ("t3", "B", 5), ("s4", "C", 5)}
    assert {tuple(x) for x in taxonomy.user_bins(info, "genus", line).collect()} == {("t1", "AB"), ("t2", "AB"), ("t3", "AB"), ("t4", "C")}
    assert taxonomy.collisions(info.withColumn("target", F.lit("A")), tax).count() == 1


def test_choice_of_genomes(spark, tmp_path):
    def row(acc, cat, node, species, level, group):
        f = [""] * 25
        f[0], f[4], f[5], f[6], f[11], f[24] = acc, cat, node, species, level, group
        return "\t".join(f)

    (tmp_path / "s.txt").write_text("# x\n" + "\n".join([row("G1", "na", "n1", "sp", "Scaffold", "bacteria"), row("G2", "reference genome", "n2", "sp", "Scaffold", "bacteria"), row("G3", "na", "n3", "sp", "Complete Genome", "fungi"), row("G4", "na", "n4", "sq", "Contig", "fungi")]) + "\n")
    rows = io.read_assemblies(spark, str(tmp_path / "s.txt"))
    pick = lambda **k: {x["accession"] for x in io.select_assemblies(rows, **k).collect()}
    assert pick() == {"G1", "G2", "G3", "G4"} and pick(groups=["fungi"]) == {"G3", "G4"}
    assert pick(complete=True) == {"G3"} and pick(reference=True) == {"G2"} and pick(top=1) == {"G2", "G4"}
    assert pick(nodes=spark.createDataFrame([("n1",), ("n1",)], "node string")) == {"G1"}
    with pytest.raises(ValueError):
        pick(groups=["x"], nodes=rows)
    got = io.fill_lookups(rows.select("accession", "node"), spark.createDataFrame([("G1", "7"), ("G1", "8")], "accession string, node string"), ["node"])
    assert {tuple(x) for x in got.collect()} == {("G1", "7"), ("G2", "na"), ("G3", "na"), ("G4", "na")}
    sizes = spark.createDataFrame([("d;s__A", 10), ("d;s__A", 13), (None, 5)], "lineage string, genome_size long")
    assert [tuple(x) for x in io.sizes_from_lineages(sizes).collect()] == [("s__A", 11)]
