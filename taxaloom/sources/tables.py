"""Scans and sinks of the text relations: taxonomies, matches, reports and auxiliaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import gtdb_accession, gtdb_node

TAX = "node string, parent string, rank string, name string, genome_size bigint"
ALL = "readid string, target string, kcount int"
REP = "hierarchy string, target string, matches bigint, unique bigint, lca bigint, rank string, name string"
TRE = "rank string, target string, lineage string, name string, unique bigint, shared bigint, children bigint, cumulative bigint, perc double"


def read_tax(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=TAX)


def read_dmp(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """`node, parent, rank, name` of a taxonomy dump; the name is the scientific one."""
    def fields(path: str) -> DataFrame:
        return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t?\|\s*$", ""), r"\t\|\t").alias("f"))

    n = fields(nodes).select(F.col("f")[0].alias("node"), F.col("f")[1].alias("parent"), F.col("f")[2].alias("rank"))
    m = fields(names).filter(F.col("f")[3] == "scientific name").select(F.col("f")[0].alias("__n"), F.col("f")[1].alias("name"))
    root = F.col("node") == F.col("parent")
    return n.join(m, F.col("node") == F.col("__n"), "left").select("node", F.when(root, F.lit("0")).otherwise(F.col("parent")).alias("parent"), F.when(root, F.lit("root")).otherwise(F.col("rank")).alias("rank"), "name")


def read_gtdb(spark: SparkSession, path: str) -> DataFrame:
    """`accession, node` and the lineage's edges come from (accession, d__..;..;s__..)."""
    rows = spark.read.csv(path, sep="\t", schema="accession string, lineage string")
    return rows.select(gtdb_accession(F.col("accession")).alias("accession"), gtdb_node(F.col("lineage")).alias("node"), "lineage")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """`old, new` of a taxonomy dump's merged nodes."""
    f = F.split(F.regexp_replace("value", r"\t?\|\s*$", ""), r"\t\|\t")
    return spark.read.text(path).select(f[0].alias("old"), f[1].alias("new"))


def dummy_tax(info: DataFrame) -> DataFrame:
    """A taxonomy for inputs without one: every target below the root."""
    root = info.sparkSession.createDataFrame([("1", "0", "root", "root")], "node string, parent string, rank string, name string")
    targets = info.filter(F.col("target").isNotNull()).select(F.col("target").alias("node"), F.lit("1").alias("parent"), F.lit("target").alias("rank"), F.col("target").alias("name")).distinct()
    return root.unionByName(targets.filter("node <> '1'"))


def read_genome_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`node, genome_size` of a species size file: the expected length in the fourth
    column; the first line is a header. Of repeated nodes the largest."""
    rows = spark.read.csv(path, sep="\t", header=True)
    node, size = rows.columns[0], rows.columns[3]
    return rows.select(F.col(f"`{node}`").alias("node"), F.col(f"`{size}`").cast("bigint").alias("genome_size")).groupBy("node").agg(F.max("genome_size").alias("genome_size"))


def read_gtdb_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`node, genome_size` of a metadata file with the size in column 17 and the lineage in
    column 20: the whole-number mean of each last rank."""
    rows = spark.read.csv(path, sep="\t", header=True)
    c = rows.columns
    return sizes_from_lineages(rows.select(F.col(f"`{c[19]}`").alias("lineage"), F.col(f"`{c[16]}`").cast("bigint").alias("genome_size")))


def read_gtdb_translation(spark: SparkSession, path: str | list[str], to_gtdb: bool = True) -> DataFrame:
    """`node, other` of a metadata file that names the lineage (column 20, `gtdb_taxonomy`)
    and the other taxonomy's node (`ncbi_taxid`) of every genome, in either direction."""
    rows = spark.read.csv(path, sep="\t", header=True).filter(F.col("ncbi_taxid").isNotNull() & F.col("gtdb_taxonomy").isNotNull())
    pair = rows.select(F.col("ncbi_taxid").alias("a"), gtdb_node(F.col("gtdb_taxonomy")).alias("b")).distinct()
    return pair.select(F.col("a").alias("node"), F.col("b").alias("other")) if to_gtdb else pair.select(F.col("b").alias("node"), F.col("a").alias("other"))


def gtdb_nodes(info: DataFrame, accessions: DataFrame) -> DataFrame:
    """Sequences joined with their genome's node by the specialization (the assembly
    accession). accessions: `accession, node` without prefixes. Rows without one keep
    their node."""
    right = accessions.groupBy(F.col("accession").alias("__a")).agg(F.min("node").alias("__g"))
    return info.join(right, F.col("specialization") == F.col("__a"), "left").withColumn("node", F.coalesce("__g", "node")).drop("__a", "__g")


#: Ranks by the prefixes of lineage names.
GTDB_RANKS = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}


def gtdb_edges(lineages: DataFrame, lineage: str = "lineage") -> DataFrame:
    """`node, parent, rank, name` of ;-separated lineages, the root included."""
    parts = F.split(F.col(lineage), ";")
    e = lineages.select(F.posexplode(parts).alias("i", "node"), parts.alias("p")).select("node", F.when(F.col("i") == 0, F.lit("1")).otherwise(F.expr("p[i - 1]")).alias("parent"))
    rank = F.create_map(*[F.lit(x) for kv in GTDB_RANKS.items() for x in kv])[F.substring("node", 1, 1)]
    rows = e.distinct().select("node", "parent", rank.alias("rank"), F.substring("node", F.lit(4), F.length("node")).alias("name"))
    root = lineages.sparkSession.createDataFrame([("1", "0", "root", "root")], "node string, parent string, rank string, name string")
    return rows.unionByName(root)


def read_all(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=ALL)


def read_rep(spark: SparkSession, path: str | list[str], normalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """The body, summed per (hierarchy, target), and one row of totals (`classified,
    unclassified`; `normalize` makes the latter 0). `unique` and `lca` are reads."""
    rows = spark.read.csv(path, sep="\t", schema=REP.replace("bigint", "string"))
    body = rows.filter(~F.startswith("hierarchy", F.lit("#"))).groupBy("hierarchy", "target").agg(
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("matches", "unique", "lca")], F.first("rank", True).alias("rank"), F.first("name", True).alias("name")
    )

    def total(label: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("hierarchy") == label, F.col("target").cast("bigint"))), F.lit(0))

    totals = rows.agg(total("#total_classified").alias("classified"), (F.lit(0).cast("bigint") if normalize else total("#total_unclassified")).alias("unclassified"))
    return body, totals


def find_reps(spark: SparkSession, prefix: str) -> list[str]:
    """The .rep files in a folder, or those whose path begins with `prefix`."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(prefix).getFileSystem(spark._jsc.hadoopConfiguration())
    is_folder = files.exists(path(prefix)) and files.getFileStatus(path(prefix)).isDirectory()
    found = files.globStatus(path(prefix, "*.rep") if is_folder else path(f"{prefix}*.rep"))
    return sorted(x.getPath().toString() for x in found or [])


def read_tre(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Report rows with their file's name as `label`."""
    return spark.read.csv(path, sep="\t", schema=TRE).withColumn("label", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_accession2taxid(spark: SparkSession, path: str | list[str], known: DataFrame) -> DataFrame:
    """`accession, node` of known accessions; the version is in the second column, taxid 0
    means none."""
    rows = spark.read.csv(path, sep="\t", header=True).toDF("base", "accession", "node", "gi")
    return rows.select("accession", "node").filter(F.col("node") != "0").join(known.select("accession").distinct(), "accession", "left_semi")


def read_assembly_summary(spark: SparkSession, path: str | list[str], known: DataFrame | None = None) -> DataFrame:
    """`accession, node, organism, infraspecific`; lines that begin with # are skipped."""
    cols = [f"c{i} string" for i in range(20)]
    rows = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(cols), quote="")
    got = rows.select(F.col("c0").alias("accession"), F.col("c5").alias("node"), F.col("c7").alias("organism"), F.col("c8").alias("infraspecific"))
    return got if known is None else got.join(known.select("accession").distinct(), "accession", "left_semi")


def read_assemblies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of an assembly summary by which genomes are chosen: `accession,
    category, node, species, level, group, url`."""
    cols = [f"c{i} string" for i in range(25)]
    rows = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(cols), quote="")
    at = {"accession": 0, "category": 4, "node": 5, "species": 6, "level": 11, "url": 19, "group": 24}
    return rows.select(*[F.col(f"c{i}").alias(n) for n, i in at.items()])


def select_assemblies(
    rows: DataFrame,
    groups: list[str] | None = None,
    nodes: DataFrame | None = None,
    complete: bool = False,
    reference: bool = False,
    top: int = 0,
) -> DataFrame:
    """The choice of genomes that a download makes, over local summaries: by organism
    groups or by nodes (column node, with their descendants), complete and reference
    genomes, and the first `top` of each species (reference, then complete, then
    accession). Null fields never match a filter."""
    if groups and nodes is not None:
        raise ValueError("groups and nodes exclude each other")
    if groups:
        rows = rows.filter(F.col("group").isin(groups))
    if nodes is not None:
        rows = rows.join(nodes.select("node").distinct(), "node", "left_semi")
    is_complete = F.coalesce(F.col("level") == "Complete Genome", F.lit(False))
    is_reference = F.coalesce(F.lower("category").isin("reference genome", "representative genome"), F.lit(False))
    if complete:
        rows = rows.filter(is_complete)
    if reference:
        rows = rows.filter(is_reference)
    if top:
        w = Window.partitionBy("species").orderBy(is_reference.desc(), is_complete.desc(), "accession")
        rows = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= top).drop("__r")
    return rows


def sizes_from_lineages(rows: DataFrame) -> DataFrame:
    """`node, genome_size`: the whole-number mean size per last rank of `lineage,
    genome_size` rows."""
    node = F.element_at(F.split("lineage", ";"), -1)
    return rows.filter(F.col("lineage").isNotNull()).groupBy(node.alias("node")).agg(F.floor(F.avg("genome_size")).alias("genome_size"))


def fill_lookups(info: DataFrame, found: DataFrame, columns: list[str], missing: str = "na") -> DataFrame:
    """The join of a record lookup over local results: every row of `info` with the found
    `columns` by accession, `missing` where there is none. Of several results of one
    accession the least row is taken."""
    least = found.groupBy(F.col("accession").alias("__a")).agg(F.min(F.struct(*columns)).alias("__f"))
    rows = info.join(least, F.col("accession") == F.col("__a"), "left")
    return rows.select(*[c for c in info.columns if c not in columns], *[F.coalesce(F.col(f"__f.{c}").cast("string"), F.lit(missing)).alias(c) for c in columns])


def write_tsv(df: DataFrame, path: str, sep: str = "\t", single: bool = False, partition_by: list[str] | None = None, header: bool = False) -> None:
    """Fields are written as they are. `single` is for reports, whose rows are taxa;
    `header` writes the columns' names, which a matrix needs."""
    w = (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", sep).option("quote", "").option("emptyValue", "").option("header", header)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_lines(lines: DataFrame, path: str, by: str | None = None) -> None:
    """One text file of the lines (`part, value`) in the order of their parts, or below
    `path` one folder for each value of `by`."""
    one = lines.coalesce(1).sortWithinPartitions("part") if by is None else lines.repartition(F.col(by)).sortWithinPartitions(by, "part")
    w = one.select(*([by] if by else []), "value").write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def rep_lines(body: DataFrame, totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`[by...,] part, value`: the lines of a .rep file: rows with any count, then the two
    totals."""
    by = by or []
    rows = body.filter((F.col("matches") > 0) | (F.col("lca") > 0) | (F.col("unique") > 0))
    more = [F.coalesce(F.col(c), F.lit("")) for c in ("rank", "name") if c in body.columns]
    lines = rows.select(*by, F.lit(0).alias("part"), F.concat_ws("\t", "hierarchy", "target", *[F.col(c).cast("string") for c in ("matches", "unique", "lca")], *more).alias("value"))

    def end(part: int, name: str):
        return F.struct(F.lit(part).alias("part"), F.concat(F.lit(f"#total_{name}\t"), F.col(name)).alias("value"))

    return lines.unionByName(totals.select(*by, F.explode(F.array(end(1, "classified"), end(2, "unclassified"))).alias("x")).select(*by, "x.*"))


#: The version and the columns of a profile.
BIOBOXES = ("0.10.0", "TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE")


def bioboxes_lines(rows: DataFrame, sample: str, ranks: list[str], source: str = "") -> DataFrame:
    """`part, value` of a profile: five lines of header, then `node, rank, path, names,
    perc` in order, with six significant digits."""
    head = [f"@Version:{BIOBOXES[0]}", f"@SampleID:{sample}", "@Ranks:" + "|".join(ranks), f"@Taxonomy:{source}", "@@" + BIOBOXES[1]]
    first = rows.sparkSession.createDataFrame(list(enumerate(head)), "part bigint, value string")
    body = rows.select((F.monotonically_increasing_id() + len(head)).alias("part"), F.concat_ws("\t", "node", "rank", "path", "names", significant(F.col("perc"))).alias("value"))
    return first.unionByName(body)


def significant(x: Column, digits: int = 6) -> Column:
    """A number in general form: rounded to significant digits, without closing zeros, with
    an exponent where it is below 1e-4 or has more digits."""
    size = F.abs(x.cast("double"))
    exponent = F.regexp_extract(F.format_string(f"%.{digits - 1}e", size), r"e([+-][0-9]+)$", 1).cast("int")

    def bare(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)

    fixed = F.lit(None).cast("string")
    for e in range(-4, digits):
        fixed = F.when(exponent == e, bare(F.format_string(f"%.{digits - 1 - e}f", x.cast("double")))).otherwise(fixed)
    parts = F.split(F.format_string(f"%.{digits - 1}e", x.cast("double")), "e")
    return F.when(size == 0, F.lit("0")).when((exponent < -4) | (exponent >= digits), F.concat(bare(parts[0]), F.lit("e"), parts[1])).otherwise(fixed)
