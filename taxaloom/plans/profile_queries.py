"""Queries of the taxonomy, report and table operators over the test tables.

The taxonomy is root, region, nation, customer (every second customer is a strain, which
is no default rank). Orders stand for reads: finished ones are unique reads of customers,
open ones are shared reads of nations, all are matches; priorities are hierarchies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import report, table as samples, taxonomy
from ..sources import tables as io
from .tables import table


def tax(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, node: str, parent, rank, label: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(node[0]), F.col(node[1:])).alias("node"), parent.alias("parent"), rank.alias("rank"), F.col(label).alias("name"))

    root = spark.createDataFrame([("1", "0", "root", "root")], "node string, parent string, rank string, name string")
    regions = of("region", "rr_regionkey", F.lit("1"), F.lit("domain"), "r_name")
    nations = of("nation", "nn_nationkey", F.concat(F.lit("r"), "n_regionkey"), F.lit("phylum"), "n_name")
    strain = F.when(F.col("c_custkey") % 2 == 0, "species").otherwise("strain")
    customers = of("customer", "cc_custkey", F.concat(F.lit("n"), "c_nationkey"), strain, "c_name")
    return root.unionByName(regions).unionByName(nations).unionByName(customers)


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every third customer has no known size."""
    size = F.when(F.col("c_custkey") % 3 != 0, 1000 + F.col("c_custkey") % 7 * 500)
    return table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), size.alias("genome_size"))


def rep(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    own = o.groupBy(F.col("o_orderpriority").alias("hierarchy"), F.concat(F.lit("c"), "o_custkey").alias("target")).agg(
        F.count(F.lit(1)).alias("matches"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("unique"), F.lit(0).cast("bigint").alias("lca")
    )
    up = o.filter("o_orderstatus = 'O'").join(c, F.col("o_custkey") == F.col("c_custkey"))
    shared = up.groupBy(F.col("o_orderpriority").alias("hierarchy"), F.concat(F.lit("n"), "c_nationkey").alias("target")).agg(F.count(F.lit(1)).alias("lca"))
    zero = F.lit(0).cast("bigint")
    return own.unionByName(shared.select("hierarchy", "target", zero.alias("matches"), zero.alias("unique"), "lca"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("o_orderstatus") == "P").cast("long")
    return table(spark, d, "orders").agg((F.count(F.lit(1)) - F.sum(p)).alias("classified"), F.sum(p).alias("unclassified"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return report.merge(rep(spark, d)).filter("matches > 0 OR lca > 0")


def _report(spark: SparkSession, d: str, kind: str) -> DataFrame:
    line = taxonomy.kept_lineages(tax(spark, d))
    known = taxonomy.estimate_genome_sizes(line, sizes(spark, d), line.select("node")) if kind in ("abundance", "corr") else None
    return report.build(_merged(spark, d), totals(spark, d), line, kind, known)


def _short(rows: DataFrame) -> DataFrame:
    return rows.select("node", "rank", "unique", "shared", "children", "cumulative", F.round("share", 7).alias("share"))


def src15_genome_sizes(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.genome_sizes(table(spark, d, "tax"))


def joi7_merge_taxonomies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tax").select("node", "parent", "rank", "name", "db_label")
    first = ["fungal", "bacset", "envmix"]
    found = [r[0] for r in t.select("db_label").distinct().collect()]  # the taxonomies' labels
    labels = [*first, *sorted(x for x in found if x is not None and x not in first), None]
    parts = [t.filter(F.col("db_label").eqNullSafe(F.lit(x))).drop("db_label") for x in labels]
    return taxonomy.merge_taxonomies(parts).select("node", "parent")


def joi8_orphans(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "db_info").filter(F.col("node").isNotNull()).select(F.col("node").alias("target"))
    base = taxonomy.genome_sizes(table(spark, d, "tax")).select("node")
    return taxonomy.add_orphans(base.withColumn("parent", F.lit(None).cast("string")).withColumn("rank", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string")), targets).filter(F.col("parent").isNotNull())


def tre1_lineages(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.lineages(tax(spark, d)).select("node", "rank", "depth", F.array_join("path", "|").alias("path"), F.array_join("names", "|").alias("names"))


def tre2_lineage_at(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.lineages(tax(spark, d)).select("node", F.array_join(taxonomy.lineage_at(["domain", "class", "species"]), "|").alias("path"))


def tre4_leaves(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.leaves(taxonomy.kept_lineages(tax(spark, d))).groupBy("anc").agg(F.count("leaf").alias("n_leaves"), F.min("leaf").alias("first_leaf"))


def tre5_keep(spark: SparkSession, d: str) -> DataFrame:
    few = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("node")).distinct()
    return taxonomy.keep_with_ancestors(taxonomy.kept_lineages(tax(spark, d)), few).select("node", "depth")


def tre6_parent_rank(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.lineages(tax(spark, d)).select("node", taxonomy.parent_rank("phylum").alias("at"))


def tre7_closest(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.lineages(tax(spark, d)).select("node", taxonomy.closest_parent(["domain", "species"]).alias("near"))


def tre11_convert(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("target"), F.concat(F.lit("k"), F.col("s_suppkey") % 50).alias("node"))
    mapping = table(spark, d, "customer").select(F.concat(F.lit("k"), F.col("c_custkey") % 60).alias("node"), F.concat(F.lit("c"), "c_custkey").alias("other"))
    return taxonomy.convert(nodes, mapping, taxonomy.kept_lineages(tax(spark, d)))


def tre8_latest(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the latest node of their customer; some customers are merged nodes."""
    merged = table(spark, d, "supplier").select(F.concat(F.lit("c"), "s_suppkey").alias("old"), F.concat(F.lit("n"), "s_nationkey").alias("new"))
    nodes = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("node"))
    return taxonomy.latest(nodes, merged).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def joi11_gtdb_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by the genome that the specialization names, else the own ones."""
    info = table(spark, d, "db_info").select("file", "target", "node", "specialization")
    genomes = table(spark, d, "db_info").filter(F.col("specialization").isNotNull() & F.col("file").isNotNull()).select(F.col("specialization").alias("accession"), F.col("file").alias("node"))
    return io.gtdb_nodes(info, genomes).groupBy("target", "node").agg(F.count(F.lit(1)).alias("n"))


def agg16_ranks(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.rank_counts(table(spark, d, "db_info").select("node"), table(spark, d, "tax"))


def tre15_genome_sizes(spark: SparkSession, d: str) -> DataFrame:
    line = taxonomy.kept_lineages(tax(spark, d))
    return taxonomy.estimate_genome_sizes(line, sizes(spark, d), line.select("node"))


def flt9_hierarchies(spark: SparkSession, d: str) -> DataFrame:
    return report.merge(report.select_hierarchies(rep(spark, d), skip=["1-URGENT", "5-LOW"]))


def agg9_merge(spark: SparkSession, d: str) -> DataFrame:
    return report.merge(rep(spark, d))


def agg11_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.cumulative(report.target_counts(_merged(spark, d), "reads"), taxonomy.kept_lineages(tax(spark, d)))


def tre13_redistribute(spark: SparkSession, d: str) -> DataFrame:
    return report.redistribute(_merged(spark, d), taxonomy.kept_lineages(tax(spark, d)))


def tre14_correct(spark: SparkSession, d: str) -> DataFrame:
    line = taxonomy.kept_lineages(tax(spark, d))
    known = taxonomy.estimate_genome_sizes(line, sizes(spark, d), line.select("node"))
    return report.correct(report.target_counts(_merged(spark, d), "reads"), line, known).select("node", F.round("n", 4).alias("n"))


def rpt_reads(spark: SparkSession, d: str) -> DataFrame:
    return _short(_report(spark, d, "reads"))


def rpt_matches(spark: SparkSession, d: str) -> DataFrame:
    return _short(_report(spark, d, "matches"))


def rpt_dist(spark: SparkSession, d: str) -> DataFrame:
    return _short(_report(spark, d, "dist"))


def rpt_abundance(spark: SparkSession, d: str) -> DataFrame:
    return report.tre(_report(spark, d, "abundance"), None)


def flt13_percentile(spark: SparkSession, d: str) -> DataFrame:
    return report.select(_report(spark, d, "reads"), percentile=0.4).select("node", "rank", "cumulative")


def flt14_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.select(_report(spark, d, "reads"), min_count=5, max_count=0.2).select("node", "rank", "cumulative")


def flt16_taxids(spark: SparkSession, d: str) -> DataFrame:
    return report.select(_report(spark, d, "reads"), ranks=["domain", "phylum", "species"], taxids=["r1", "n3"]).select("node", "rank", "cumulative")


def flt18_names(spark: SparkSession, d: str) -> DataFrame:
    return report.select(_report(spark, d, "reads"), names_with=["A", "9"]).select("node", "rank", "cumulative")


def srt1_order(spark: SparkSession, d: str) -> DataFrame:
    rows = report.order(report.select(_report(spark, d, "reads"), ranks=["domain", "phylum"]), "", ["domain", "phylum"])
    return report.tre(rows, ["domain", "phylum"])


def snk12_bioboxes(spark: SparkSession, d: str) -> DataFrame:
    return report.bioboxes(report.select(_report(spark, d, "reads"), ranks=["domain", "phylum"])).select("node", "rank", "path", "names", F.round("perc", 5).alias("perc"))


def agg13_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.rank_summary(_report(spark, d, "reads"))


def _tre(spark: SparkSession, d: str) -> DataFrame:
    """Report rows of one sample per year: finished orders at nations, open at regions."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.select(F.year("o_orderdate").cast("string").alias("label"), "o_orderstatus", F.concat(F.lit("r"), "r_regionkey").alias("r"), F.concat(F.lit("n"), "n_nationkey").alias("n"), "r_name", "n_name")
    s = F.col("o_orderstatus")
    steps = F.array(
        F.when(s == "P", F.struct(F.lit("unclassified").alias("rank"), F.lit("-").alias("target"), F.lit("-").alias("lineage"), F.lit("unclassified").alias("name"))),
        F.when(s != "P", F.struct(F.lit("root").alias("rank"), F.lit("1").alias("target"), F.lit("1").alias("lineage"), F.lit("root").alias("name"))),
        F.when(s != "P", F.struct(F.lit("domain").alias("rank"), F.col("r").alias("target"), F.concat_ws("|", F.lit("1"), "r").alias("lineage"), F.col("r_name").alias("name"))),
        F.when(s == "F", F.struct(F.lit("phylum").alias("rank"), F.col("n").alias("target"), F.concat_ws("|", F.lit("1"), "r", "n").alias("lineage"), F.col("n_name").alias("name"))),
    )
    rows = o.select("label", F.explode(steps).alias("x")).filter("x IS NOT NULL").select("label", "x.*")
    return rows.groupBy("label", "rank", "target", "lineage", "name").agg(F.count(F.lit(1)).alias("cumulative"))


def _sums(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows and totals of a table step in one relation."""
    rows, tot = pair
    extra = tot.select("label", F.explode(F.array(F.struct(F.lit("~unclassified").alias("taxid"), F.col("unclassified").alias("count")), F.struct(F.lit("~filtered").alias("taxid"), F.col("filtered").alias("count")), F.struct(F.lit("~total").alias("taxid"), F.col("total").alias("count")))).alias("x")).select("label", "x.*")
    return rows.select("label", "taxid", "count").unionByName(extra)


def src21_parse(spark: SparkSession, d: str) -> DataFrame:
    return _sums(samples.parse(_tre(spark, d)))


def flt20_table_filters(spark: SparkSession, d: str) -> DataFrame:
    return _sums(samples.select(*samples.parse(_tre(spark, d)), min_count=0.05, names_with=["A", "I"]))


def flt22_rank(spark: SparkSession, d: str) -> DataFrame:
    return _sums(samples.parse(_tre(spark, d), "phylum"))


def win1_top_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sums(samples.top_sample(*samples.parse(_tre(spark, d), "phylum"), 4))


def win2_top_all(spark: SparkSession, d: str) -> DataFrame:
    return _sums(samples.top_all(*samples.parse(_tre(spark, d), "phylum"), 5))


def flt21_frequency(spark: SparkSession, d: str) -> DataFrame:
    pair = samples.select(*samples.parse(_tre(spark, d), "phylum"), min_count=0.02)
    return _sums(samples.min_frequency(*pair, 0.8))


def tre16_uncumulate(spark: SparkSession, d: str) -> DataFrame:
    return samples.uncumulate(samples.parse(_tre(spark, d))[0]).select("label", "taxid", "count")


def tre17_no_root(spark: SparkSession, d: str) -> DataFrame:
    rows, tot = samples.parse(_tre(spark, d))
    return _sums(samples.no_root(samples.uncumulate(rows), tot))


def rsh5_fractions(spark: SparkSession, d: str) -> DataFrame:
    rows, tot = samples.parse(_tre(spark, d), "phylum")
    return samples.values(rows, tot, "percentage", "lineage", "others", "others").select("label", "taxon", F.round("value", 9).alias("value"))


def flt23_skip_zeros(spark: SparkSession, d: str) -> DataFrame:
    rows, tot = samples.parse(_tre(spark, d))
    return samples.skip_zeros(samples.values(samples.uncumulate(rows), tot, "counts", "taxid"))


def rsh1_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows, tot = samples.parse(_tre(spark, d), "domain")
    return samples.pivot(samples.values(rows, tot, "counts", "taxid"), transpose=True)


def flt25_targets(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.first_targets(table(spark, d, "db_info").select("target", "added_at", "node", "file"), "added_at").select("target", "added_at")


def flt26_valid(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "db_info").select("file", "target", "node")
    return taxonomy.drop_invalid(i, table(spark, d, "tax"), keep=True).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def flt27_specializations(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "db_info").select("target", "node", F.coalesce("specialization_name", "specialization").alias("specialization"))
    return taxonomy.validate_specializations(i).groupBy("specialization").agg(F.count(F.lit(1)).alias("n"))


def flt28_collisions(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.collisions(table(spark, d, "db_info").select(F.col("node").alias("target")), table(spark, d, "tax"))


def joi10_enrich(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "db_info").select("file", "target", F.col("node"), "specialization")
    found = table(spark, d, "tax").groupBy(F.col("node").alias("key")).agg(F.min("name").alias("specialization"))
    return taxonomy.enrich(i.withColumnRenamed("node", "key"), found, "key", ["specialization"]).groupBy("specialization").agg(F.count(F.lit(1)).alias("n"))


def str2_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", text.organism_name(F.col("c_name"), F.concat(F.lit("strain="), F.substring("c_name", -3, 3))).alias("a"), text.organism_name(F.col("c_name"), F.concat(F.lit("isolate="), "c_mktsegment")).alias("b"), text.decode_target(F.concat("c_mktsegment", F.lit("|||1---x.minimiser"))).alias("c"))


FUNCTIONS = (
    src15_genome_sizes, joi7_merge_taxonomies, joi8_orphans, tre1_lineages, tre2_lineage_at, tre4_leaves, tre5_keep, tre6_parent_rank, tre7_closest, tre11_convert, tre8_latest, joi11_gtdb_nodes, agg16_ranks, tre15_genome_sizes,
    flt9_hierarchies, agg9_merge, agg11_cumulative, tre13_redistribute, tre14_correct, rpt_reads, rpt_matches, rpt_dist, rpt_abundance,
    flt13_percentile, flt14_counts, flt16_taxids, flt18_names, srt1_order, snk12_bioboxes, agg13_summary,
    src21_parse, flt20_table_filters, flt22_rank, win1_top_sample, win2_top_all, flt21_frequency, tre16_uncumulate, tre17_no_root, rsh5_fractions, flt23_skip_zeros, rsh1_pivot,
    flt25_targets, flt26_valid, flt27_specializations, flt28_collisions, joi10_enrich, str2_names,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_TAX = """WITH tree AS (SELECT '1' AS node, '0' AS parent, 'root' AS rank, 'root' AS name
UNION ALL SELECT 'r' || r_regionkey, '1', 'domain', r_name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'phylum', n_name FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'species' ELSE 'strain' END, c_name FROM customer),
line AS (SELECT node, rank, name, 0 AS depth, [node] AS path, [name] AS names FROM tree WHERE node = '1'
UNION ALL SELECT t.node, t.rank, t.name, 1, ['1', t.node], ['root', t.name] FROM tree t WHERE t.parent = '1'
UNION ALL SELECT t.node, t.rank, t.name, 2, ['1', p.node, t.node], ['root', p.name, t.name] FROM tree t JOIN tree p ON t.parent = p.node AND p.parent = '1'
UNION ALL SELECT t.node, t.rank, t.name, 3, ['1', g.node, p.node, t.node], ['root', g.name, p.name, t.name] FROM tree t JOIN tree p ON t.parent = p.node JOIN tree g ON p.parent = g.node AND g.parent = '1'),
clo AS (SELECT node, unnest(path) AS anc FROM line),
rnk AS (SELECT c.node, c.anc, l.rank AS anc_rank, l.depth AS anc_depth FROM clo c JOIN line l ON l.node = c.anc),
leaf AS (SELECT anc, c.node AS leaf FROM clo c WHERE c.node NOT IN (SELECT parent FROM tree))"""
_REP = (
    _TAX
    + """, rep AS (SELECT o_orderpriority AS hierarchy, 'c' || o_custkey AS target, count(*) AS matches, count(*) FILTER (WHERE o_orderstatus = 'F') AS u, 0 AS lca FROM orders GROUP BY 1, 2
UNION ALL SELECT o_orderpriority, 'n' || c_nationkey, 0, 0, count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1, 2),
tot AS (SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS c, count(*) FILTER (WHERE o_orderstatus = 'P') AS u FROM orders),
mer AS (SELECT target, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(u) AS BIGINT) AS u, CAST(sum(lca) AS BIGINT) AS lca FROM rep GROUP BY target)"""
)
_GS = """, known AS (SELECT 'c' || c_custkey AS node, 1000 + c_custkey % 7 * 500 AS g FROM customer WHERE c_custkey % 3 <> 0),
mean AS (SELECT anc, CAST(floor(avg(g)) AS BIGINT) AS m FROM leaf LEFT JOIN known ON known.node = leaf.leaf GROUP BY anc),
gs AS (SELECT r.node, coalesce(arg_max(m, anc_depth) FILTER (WHERE m > 0), 1) AS g FROM rnk r LEFT JOIN mean USING (anc) GROUP BY r.node)"""
_DIST = """, sh AS (SELECT m.target AS anc, m.lca AS s, l.leaf, x.u, x.matches FROM mer m JOIN leaf l ON l.anc = m.target AND l.leaf <> l.anc JOIN mer x ON x.target = l.leaf WHERE m.lca > 0),
su AS (SELECT *, sum(u) OVER (PARTITION BY anc) AS tu FROM sh), sw AS (SELECT *, CASE WHEN tu > 0 THEN u ELSE matches END AS w FROM su),
st AS (SELECT *, sum(w) OVER (PARTITION BY anc) AS t FROM sw WHERE w > 0), sg AS (SELECT *, floor(s * (w / CAST(t AS DOUBLE))) AS g FROM st),
sl AS (SELECT *, s - sum(g) OVER (PARTITION BY anc) AS left_over, row_number() OVER (PARTITION BY anc ORDER BY u DESC, matches DESC, leaf) AS n FROM sg),
dis AS (SELECT m.target, m.matches, m.u, CAST(CASE WHEN m.target IN (SELECT anc FROM sl) THEN 0 ELSE m.lca END + coalesce((SELECT sum(g + CASE WHEN n <= left_over THEN 1 ELSE 0 END) FROM sl WHERE sl.leaf = m.target), 0) AS BIGINT) AS lca FROM mer m)"""
_CORR = """, near AS (SELECT node, arg_max(anc, anc_depth) FILTER (WHERE anc_rank IN ('root', 'domain', 'phylum', 'species')) AS near FROM rnk GROUP BY node),
cnt AS (SELECT target AS node, u + lca AS n FROM {0} WHERE u + lca > 0 AND target IN (SELECT node FROM line)),
pn AS (SELECT near, CAST(sum(n) AS DOUBLE) AS c FROM cnt JOIN near USING (node) GROUP BY near),
pr AS (SELECT pn.near, c, l.rank, c / gs.g AS ratio FROM pn JOIN line l ON l.node = near JOIN gs ON gs.node = near),
fx AS (SELECT near, c, sum(c) OVER (PARTITION BY rank) * ratio / sum(ratio) OVER (PARTITION BY rank) AS f FROM pr),
cor AS (SELECT node, sum(n) AS n FROM (SELECT anc AS node, f AS n FROM fx JOIN clo ON clo.node = fx.near
UNION ALL SELECT cnt.node, n * f / c FROM cnt JOIN near USING (node) JOIN fx ON fx.near = near.near WHERE cnt.node <> near.near) GROUP BY node)"""


def _rows(rep: str, kind: str = "reads") -> str:
    n, sh = ("matches", "matches - u") if kind == "matches" else ("u + lca", "lca")
    total = "(SELECT sum(matches) FROM mer)" if kind == "matches" else "(SELECT c + u FROM tot)"
    return f""", cum AS (SELECT anc AS node, CAST(sum({n}) AS BIGINT) AS n FROM {rep} JOIN clo ON clo.node = {rep}.target WHERE {n} > 0 GROUP BY anc),
rows AS (SELECT l.node, l.rank, l.name, l.path, l.names, l.depth, coalesce(r.u, 0) AS u, coalesce(r.{sh.replace(' - u', '')}{' - r.u' if kind == 'matches' else ''}, 0) AS shared, cum.n AS cumulative, cum.n / CAST({total} AS DOUBLE) AS share FROM cum JOIN line l USING (node) LEFT JOIN {rep} r ON r.target = cum.node)"""


_SHORT = ' SELECT node, rank, u AS "unique", shared, cumulative - u - shared AS children, cumulative, round(share, 7) AS share FROM rows'
_NRC = " SELECT node, rank, cumulative FROM rows WHERE node = '1' OR "
_TRE = """WITH o AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS label, o_orderstatus AS s, 'r' || r_regionkey AS r, 'n' || n_nationkey AS n, r_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t0 AS (SELECT label, '1' AS taxid, 'root' AS rank, 'root' AS name, ['1'] AS path, count(*) AS count FROM o WHERE s <> 'P' GROUP BY label
UNION ALL SELECT label, r, 'domain', r_name, ['1', r], count(*) FROM o WHERE s <> 'P' GROUP BY label, r, r_name
UNION ALL SELECT label, n, 'phylum', n_name, ['1', r, n], count(*) FROM o WHERE s = 'F' GROUP BY label, r, n, n_name),
tot AS (SELECT label, count(*) AS total, count(*) FILTER (WHERE s = 'P') AS unc FROM o GROUP BY label)"""
_PH = ", t AS (SELECT * FROM t0 WHERE rank = 'phylum')"
_UNC = ", un AS (SELECT t.*, CASE rank WHEN 'phylum' THEN count WHEN 'domain' THEN count - coalesce((SELECT sum(x.count) FROM t0 x WHERE x.label = t.label AND x.rank = 'phylum' AND x.path[2] = t.taxid), 0) ELSE count - coalesce((SELECT sum(x.count) FROM t0 x WHERE x.label = t.label AND x.rank = 'domain'), 0) END AS own FROM t0 t)"


def _pack(rows: str, before: str, unc: str = "tot.unc") -> str:
    """Rows, and totals whose filtered is what `before` has more than `rows`."""
    return f""" SELECT label, taxid, CAST(count AS BIGINT) AS count FROM {rows}
UNION ALL SELECT tot.label, x.k, CAST(CASE x.k WHEN '~total' THEN total WHEN '~unclassified' THEN {unc} ELSE coalesce((SELECT sum(count) FROM {before} b WHERE b.label = tot.label), 0) - coalesce((SELECT sum(count) FROM {rows} b WHERE b.label = tot.label), 0) END AS BIGINT) FROM tot, (VALUES ('~total'), ('~unclassified'), ('~filtered')) x(k)"""


ORACLES = {
    "src15_genome_sizes": "SELECT node, max(genome_size) AS genome_size FROM tax WHERE node IS NOT NULL GROUP BY node",
    "joi7_merge_taxonomies": """WITH l AS (SELECT db_label, row_number() OVER (ORDER BY CASE db_label WHEN 'fungal' THEN 0 WHEN 'bacset' THEN 1 WHEN 'envmix' THEN 2 ELSE 3 END, db_label NULLS LAST) AS i FROM (SELECT DISTINCT db_label FROM tax)),
t AS (SELECT tax.*, i FROM tax JOIN l ON l.db_label IS NOT DISTINCT FROM tax.db_label)
SELECT node, parent FROM (SELECT node, parent, row_number() OVER (PARTITION BY node ORDER BY i, parent NULLS FIRST, rank NULLS FIRST, name NULLS FIRST) AS r FROM t WHERE node IS NOT NULL) WHERE r = 1""",
    "joi8_orphans": "SELECT DISTINCT node, '1' AS parent, 'no rank' AS rank, node AS name FROM db_info WHERE node IS NOT NULL AND node NOT IN (SELECT node FROM tax WHERE node IS NOT NULL)",
    "tre1_lineages": _TAX + " SELECT node, rank, depth, array_to_string(path, '|') AS path, array_to_string(names, '|') AS names FROM line",
    "tre2_lineage_at": _TAX + " SELECT node, coalesce(min(anc) FILTER (WHERE anc_rank = 'domain'), '') || '||' || coalesce(min(anc) FILTER (WHERE anc_rank = 'species'), '') AS path FROM rnk GROUP BY node",
    "tre4_leaves": _TAX + " SELECT anc, count(*) AS n_leaves, min(leaf) AS first_leaf FROM leaf GROUP BY anc",
    "tre5_keep": _TAX + " SELECT node, depth FROM line WHERE node IN (SELECT anc FROM clo WHERE node IN (SELECT 'n' || s_nationkey FROM supplier))",
    "tre6_parent_rank": _TAX + " SELECT node, min(anc) FILTER (WHERE anc_rank = 'phylum') AS at FROM rnk GROUP BY node",
    "tre7_closest": _TAX + " SELECT node, coalesce(arg_max(anc, anc_depth) FILTER (WHERE anc_rank IN ('domain', 'species')), '1') AS near FROM rnk GROUP BY node",
    "tre11_convert": _TAX
    + """, s AS (SELECT 's' || s_suppkey AS target, 'k' || (s_suppkey % 50) AS k FROM supplier), m AS (SELECT 'k' || (c_custkey % 60) AS k, 'c' || c_custkey AS node FROM customer),
i AS (SELECT DISTINCT s.target, m.node FROM s JOIN m USING (k)), n AS (SELECT target, count(*) AS n FROM i GROUP BY target),
a AS (SELECT i.target, r.anc, r.anc_depth, count(*) AS c FROM i JOIN rnk r ON r.node = i.node GROUP BY 1, 2, 3)
SELECT s.target, (SELECT arg_max(anc, anc_depth) FROM a JOIN n USING (target) WHERE a.target = s.target AND c = n.n) AS node FROM s""",
    "tre8_latest": "SELECT coalesce('n' || s_nationkey, 'c' || o_custkey) AS node, count(*) AS n FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey GROUP BY 1",
    "joi11_gtdb_nodes": "WITH g AS (SELECT specialization AS a, min(file) AS g FROM db_info WHERE specialization IS NOT NULL AND file IS NOT NULL GROUP BY 1) SELECT target, coalesce(g, node) AS node, count(*) AS n FROM db_info LEFT JOIN g ON a = specialization GROUP BY ALL",
    "agg16_ranks": "WITH r AS (SELECT node AS k, min(rank) AS rank FROM tax WHERE node IS NOT NULL GROUP BY node) SELECT CASE WHEN k IS NULL THEN '-INVALID-' ELSE rank END AS rank, count(*) AS n FROM db_info LEFT JOIN r ON k = node GROUP BY 1",
    "tre15_genome_sizes": _TAX + _GS + " SELECT node, CAST(g AS BIGINT) AS genome_size FROM gs",
    "flt9_hierarchies": _REP + " SELECT target, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(u) AS BIGINT) AS \"unique\", CAST(sum(lca) AS BIGINT) AS lca FROM rep WHERE hierarchy NOT IN ('1-URGENT', '5-LOW') GROUP BY target",
    "agg9_merge": _REP + ' SELECT target, matches, u AS "unique", lca FROM mer',
    "agg11_cumulative": _REP + _rows("mer") + " SELECT node, n FROM cum",
    "tre13_redistribute": _REP + _DIST + ' SELECT target, matches, u AS "unique", lca FROM dis',
    "tre14_correct": _REP + _GS + _CORR.format("mer") + " SELECT node, round(n, 4) AS n FROM cor",
    "rpt_reads": _REP + _rows("mer") + _SHORT,
    "rpt_matches": _REP + _rows("mer", "matches") + _SHORT,
    "rpt_dist": _REP + _DIST + _rows("dis") + _SHORT,
    "rpt_abundance": _REP
    + _DIST
    + _GS
    + _CORR.format("dis")
    + _rows("dis")
    + " SELECT rank, node AS target, array_to_string(path, '|') AS lineage, name, u AS \"unique\", shared, cumulative - u - shared AS children, cumulative, printf('%.5f', cor.n / (SELECT c + u FROM tot) * 100) AS perc FROM rows JOIN cor USING (node)",
    "flt13_percentile": _REP
    + _rows("mer")
    + ", p AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY share DESC, node) AS r, count(*) OVER (PARTITION BY rank) AS n FROM rows), q AS (SELECT rank, max(share) AS cut FROM p WHERE r = ceil(0.4 * n) + 1 AND rank <> 'strain' GROUP BY rank) SELECT node, p.rank, cumulative FROM p LEFT JOIN q ON q.rank = p.rank WHERE node = '1' OR cut IS NULL OR share > cut",
    "flt14_counts": _REP + _rows("mer") + _NRC + "(cumulative >= 5 AND share <= 0.2)",
    "flt16_taxids": _REP + _rows("mer") + _NRC + "(rank IN ('domain', 'phylum', 'species') AND list_has_any(path, ['r1', 'n3']))",
    "flt18_names": _REP + _rows("mer") + _NRC + "(contains(name, 'A') OR contains(name, '9'))",
    "srt1_order": _REP + _rows("mer") + " SELECT rank, node AS target, array_to_string(path, '|') AS lineage, name, u AS \"unique\", shared, cumulative - u - shared AS children, cumulative, printf('%.5f', share * 100) AS perc FROM rows WHERE rank IN ('root', 'domain', 'phylum')",
    "snk12_bioboxes": _REP + _rows("mer") + " SELECT node, rank, array_to_string(path[2:], '|') AS path, array_to_string(names[2:], '|') AS names, round(share * 100, 5) AS perc FROM rows WHERE rank IN ('domain', 'phylum')",
    "agg13_summary": _REP + _rows("mer") + ' SELECT rank, CAST(sum(u) AS BIGINT) AS "unique", CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(cumulative - u - shared) AS BIGINT) AS children, CAST(sum(cumulative) AS BIGINT) AS cumulative FROM rows GROUP BY rank',
    "src21_parse": _TRE + _pack("t0", "t0"),
    "flt20_table_filters": _TRE + ", k AS (SELECT t0.* FROM t0 JOIN tot USING (label) WHERE taxid = '1' OR (count / CAST(total AS DOUBLE) >= 0.05 AND (contains(name, 'A') OR contains(name, 'I'))))" + _pack("k", "t0"),
    "flt22_rank": _TRE + _PH + _pack("t", "t"),
    "win1_top_sample": _TRE + _PH + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY count DESC, taxid) AS r FROM t) WHERE r <= 4)" + _pack("k", "t"),
    "win2_top_all": _TRE + _PH + ", b AS (SELECT taxid FROM t JOIN tot USING (label) GROUP BY taxid ORDER BY round(sum(count / CAST(total AS DOUBLE)), 12) DESC, taxid LIMIT 5), k AS (SELECT * FROM t WHERE taxid IN (SELECT taxid FROM b))" + _pack("k", "t"),
    "flt21_frequency": _TRE
    + _PH
    + ", j AS (SELECT t.* FROM t JOIN tot USING (label) WHERE count / CAST(total AS DOUBLE) >= 0.02), k AS (SELECT * FROM j WHERE taxid IN (SELECT taxid FROM j GROUP BY taxid HAVING count(*) >= floor((SELECT count(*) FROM tot) * 0.8)))"
    + _pack("k", "t"),
    "tre16_uncumulate": _TRE + _UNC + " SELECT label, taxid, CAST(own AS BIGINT) AS count FROM un",
    "tre17_no_root": _TRE
    + _UNC
    + ", k AS (SELECT label, taxid, own AS count FROM un WHERE taxid <> '1')"
    + _pack("k", "k", "unc + coalesce((SELECT max(own) FROM un WHERE un.label = tot.label AND taxid = '1'), 0)"),
    "rsh5_fractions": _TRE + _PH + " SELECT t.label, array_to_string(path, '|') AS taxon, round(count / CAST(total AS DOUBLE), 9) AS value FROM t JOIN tot USING (label) UNION ALL SELECT label, 'others', round(unc / CAST(total AS DOUBLE), 9) FROM tot",
    "flt23_skip_zeros": _TRE + _UNC + ", l AS (SELECT * FROM un WHERE label IN (SELECT label FROM un GROUP BY label HAVING max(own) > 0)) SELECT label, taxid AS taxon, CAST(own AS BIGINT) AS value FROM l WHERE taxid IN (SELECT taxid FROM l GROUP BY taxid HAVING max(own) > 0)",
    "rsh1_pivot": _TRE + " SELECT label, " + ", ".join(f"coalesce(sum(count) FILTER (WHERE taxid = 'r{i}'), 0)::BIGINT AS r{i}" for i in range(5)) + " FROM t0 WHERE rank = 'domain' GROUP BY label",
    "flt25_targets": "SELECT target, min(added_at) AS added_at FROM db_info WHERE target IS NOT NULL GROUP BY target",
    "flt26_valid": "SELECT CASE WHEN node IN (SELECT node FROM tax WHERE node IS NOT NULL) THEN node ELSE '1' END AS node, count(*) AS n FROM db_info GROUP BY 1",
    "flt27_specializations": """WITH i AS (SELECT target, node, coalesce(specialization_name, specialization) AS s FROM db_info), m AS (SELECT s FROM i WHERE s IS NOT NULL GROUP BY s HAVING count(DISTINCT node) > 1)
SELECT CASE WHEN s IS NULL OR s IN (SELECT s FROM m) THEN target ELSE s END AS specialization, count(*) AS n FROM i GROUP BY 1""",
    "flt28_collisions": "SELECT DISTINCT node FROM db_info WHERE node IN (SELECT node FROM tax WHERE node IS NOT NULL)",
    "joi10_enrich": "WITH f AS (SELECT node, min(name) AS name FROM tax GROUP BY node) SELECT coalesce(f.name, i.specialization) AS specialization, count(*) AS n FROM db_info i LEFT JOIN f ON f.node = i.node GROUP BY 1",
    "str2_names": "SELECT c_custkey, c_name AS a, c_name || ' ' || c_mktsegment AS b, c_mktsegment || '.1 x' AS c FROM customer",
}
