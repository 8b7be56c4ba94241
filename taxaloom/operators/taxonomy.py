"""Taxonomy operators on an edge list: lineages, closures, ancestors, leaves, conversion.

A taxonomy is `node, parent, rank, name[, genome_size]`. Its lineage table, one row per
node with root-first arrays, is made once per query by doubling joins over written tables
(each round is one equi-join) and every operator below is a projection, an explode or a
join on it. Size and depth have no limit of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import forest

ROOT = "1"
#: No parent ends a chain by its name here; only absent and null ones do.
NO_END = "\0"


def merge_taxonomies(parts: list[DataFrame]) -> DataFrame:
    """One row per node; of several the first taxonomy's (then the least row) wins."""
    rows = parts[0].withColumn("__i", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("__i", F.lit(i)), allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in ("__i", "node")]
    first = F.min(F.struct("__i", *cols))
    return rows.filter(F.col("node").isNotNull()).groupBy("node").agg(first.alias("f")).select("node", *[F.col(f"f.{c}").alias(c) for c in cols])


def genome_sizes(tax: DataFrame) -> DataFrame:
    """`node, genome_size`: of repeated nodes the largest."""
    return tax.filter(F.col("node").isNotNull()).groupBy("node").agg(F.max("genome_size").alias("genome_size"))


def add_orphans(tax: DataFrame, targets: DataFrame, root: str = ROOT, rank: str = "no rank") -> DataFrame:
    """Adds targets that the taxonomy lacks below the root, named as themselves."""
    missing = targets.select(F.col("target").alias("node")).distinct().join(tax.select("node"), "node", "left_anti")
    return tax.unionByName(missing.select("node", F.lit(root).alias("parent"), F.lit(rank).alias("rank"), F.col("node").alias("name")), allowMissingColumns=True)


def attach_unreachable(tax: DataFrame, root: str = ROOT) -> DataFrame:
    """Nodes whose parent is unknown hang below the root, and so does the smallest node of
    every loop of parents. Of several parents of a node the smallest is taken."""
    pointers = tax.select("node", F.when(F.col("node") != root, F.col("parent")).alias("parent"))
    cuts = forest.looped(forest.solve(pointers, end=NO_END, paths=False)).select(F.col("loop_node").alias("__c")).distinct()
    one = forest.edges(pointers, end=NO_END).select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
    rows = tax.join(one, F.col("node") == F.col("__n"), "left").join(cuts, F.col("node") == F.col("__c"), "left")
    above = F.when(F.col("__c").isNull(), F.coalesce("__p", F.lit(root))).otherwise(F.lit(root))
    return rows.withColumn("parent", F.when(F.col("node") == root, F.col("parent")).otherwise(above)).drop("__n", "__p", "__c")


def rooted(tax: DataFrame, root: str = ROOT) -> DataFrame:
    """The taxonomy with all nodes below the root, which is added if it has no row."""
    row = tax.sparkSession.createDataFrame([(root, "0", "root", "root")], "node string, parent string, rank string, name string")
    missing = row.join(tax.select("node"), "node", "left_anti")
    return attach_unreachable(tax, root).unionByName(missing, allowMissingColumns=True)


def lineages(tax: DataFrame, root: str = ROOT) -> DataFrame:
    """`node, rank, name, depth, path, ranks, names`, arrays root first, one row per node,
    read from a table in the shared folder. The root has depth 0. Nodes that the root does
    not reach have no row. Repeated nodes take their smallest parent (and row).

    Round after round each node takes over the line of where its own line stands, so r
    rounds cover 2**r parents, whatever the size or depth. A round that changes no node
    leaves only loops."""
    scratch = Scratch(tax.sparkSession, "lineage")
    up = F.when(F.col("node") != root, F.col("parent"))
    one = tax.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(up.isNull().alias("none"), up.alias("at"), "rank", "name")).alias("f"))
    start = one.select("node", "f.at", F.array(F.struct("node", "f.rank", "f.name")).alias("line")).filter(F.col("at").isNotNull() | (F.col("node") == root))
    state, path, left = scratch.cut_and_count(start, F.col("at").isNotNull())
    before = -1
    while left and left != before:
        other = state.select(F.col("node").alias("__n"), F.col("at").alias("__at"), F.col("line").alias("__line"))
        moved = state.filter(F.col("at").isNotNull()).join(other, F.col("at") == F.col("__n")).select("node", F.col("__at").alias("at"), F.concat("line", "__line").alias("line"))
        last, before = path, left
        state, path, left = scratch.cut_and_count(state.filter(F.col("at").isNull()).unionByName(moved), F.col("at").isNotNull())
        scratch.drop(last)
    own = F.get("line", F.lit(0))
    arrays = [F.reverse(F.col(f"line.{c}")).alias(n) for c, n in (("node", "path"), ("rank", "ranks"), ("name", "names"))]
    return state.filter(F.col("at").isNull()).select("node", own["rank"].alias("rank"), own["name"].alias("name"), (F.size("line") - 1).alias("depth"), *arrays)


def kept_lineages(tax: DataFrame, root: str = ROOT) -> DataFrame:
    """As `lineages`, for plans that read it often: it is a written table already."""
    return lineages(tax, root)


def closure(lineage: DataFrame) -> DataFrame:
    """`node, anc, anc_depth, anc_rank, depth`: every node with each ancestor-or-self."""
    zipped = F.arrays_zip("path", "ranks")
    return lineage.select("node", "depth", F.posexplode(zipped).alias("anc_depth", "z")).select("node", F.col("z.path").alias("anc"), "anc_depth", F.col("z.ranks").alias("anc_rank"), "depth")


def lineage_at(ranks: list[str]) -> Column:
    """The path restricted to `ranks`; ranks that it lacks give empty texts."""
    wanted = F.array(*[F.lit(r) for r in ranks])
    return F.transform(wanted, lambda r: F.coalesce(F.get(F.transform(F.filter(F.arrays_zip("path", "ranks"), lambda z: z["ranks"] == r), lambda z: z["path"]), F.lit(0)), F.lit("")))


def leaves(lineage: DataFrame) -> DataFrame:
    """`anc, leaf`: the leaves below each node; a leaf is its own."""
    inner = lineage.filter("depth > 0").select(F.get("path", F.col("depth") - 1).alias("node")).distinct()
    ends = lineage.join(inner, "node", "left_anti")
    return ends.select(F.explode("path").alias("anc"), F.col("node").alias("leaf"))


def keep_with_ancestors(lineage: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lineage rows of `nodes` (column node) and of all their ancestors."""
    used = lineage.join(nodes.select("node").distinct(), "node", "left_semi").select(F.explode("path").alias("node")).distinct()
    return lineage.join(used, "node", "left_semi")


def parent_rank(rank: str) -> Column:
    """The ancestor-or-self at a rank, null if there is none."""
    return F.get(F.transform(F.filter(F.arrays_zip("path", "ranks"), lambda z: z["ranks"] == rank), lambda z: z["path"]), F.lit(0))


def closest_parent(ranks: list[str], root: str = ROOT) -> Column:
    """The nearest ancestor-or-self whose rank is in `ranks`, else the root."""
    wanted = F.array(*[F.lit(r) for r in ranks])
    hits = F.transform(F.filter(F.arrays_zip("path", "ranks"), lambda z: F.array_contains(wanted, z["ranks"])), lambda z: z["path"])
    return F.coalesce(F.get(hits, F.size(hits) - 1), F.lit(root))


def latest(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """Replaces merged nodes (`old, new`) in column node."""
    return nodes.join(merged.select(F.col("old").alias("node"), F.col("new").alias("__new")), "node", "left").withColumn("node", F.coalesce("__new", "node")).drop("__new")


def cumulative(counts: DataFrame, lineage: DataFrame, value: str = "n") -> DataFrame:
    """`node, n`: each count is added to all ancestors-or-self. counts: `node, n`.
    Combined map-side, so the root receives one partial sum per task."""
    rows = counts.join(lineage.select("node", "path"), "node")
    return rows.select(F.explode("path").alias("node"), value).groupBy("node").agg(F.sum(value).alias(value))


def estimate_genome_sizes(lineage: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """`node, genome_size` for the nodes and their ancestors: the whole-number mean of the
    known sizes of the leaves below; without any, that of the nearest ancestor with one;
    without any at all 1. known: `node, genome_size`, given to all leaves below a node; a
    null size is none."""
    known = known.filter(F.col("genome_size").isNotNull())
    tips = leaves(lineage)
    own = lineage.select("node", F.col("path").alias("__path"))
    given = tips.join(known.select(F.col("node").alias("anc"), "genome_size"), "anc").join(own.select(F.col("node").alias("anc"), F.size("__path").alias("d")), "anc")
    size = given.groupBy("leaf").agg(F.max_by("genome_size", "d").alias("genome_size"))
    used = keep_with_ancestors(lineage, nodes)
    mean = tips.join(size, "leaf").groupBy("anc").agg(F.floor(F.avg("genome_size")).alias("mean"))
    line = used.select("node", F.posexplode("path").alias("i", "anc")).join(mean, "anc", "left")
    near = F.max_by(F.col("mean"), F.when(F.coalesce(F.col("mean"), F.lit(0)) > 0, F.col("i")))
    return line.groupBy("node").agg(near.alias("g")).select("node", F.coalesce("g", F.lit(1)).cast("bigint").alias("genome_size"))


def convert(nodes: DataFrame, mapping: DataFrame, lineage: DataFrame, key: str = "target") -> DataFrame:
    """`target, node`: nodes translated to another taxonomy; several images of one node
    become their LCA there; nodes without an image become null.

    nodes: `target, node`; mapping: `node, other`; lineage of the other taxonomy. Images
    are brought together once per node, however many targets it has."""
    from .resolve import lca

    images = mapping.join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("__k"), F.col("other").alias("node"))
    one = lca(images, lineage, ["__k"], "node")
    own = nodes.select(key, "node").join(one, F.col("node") == F.col("__k")).select(key, F.col("lca").alias("node"))
    found = lca(own, lineage, [key], "node")
    return nodes.select(key).join(found, key, "left").select(key, F.col("lca").alias("node"))


#: The rank of a node that is not in the taxonomy.
INVALID = "-INVALID-"


def rank_counts(nodes: DataFrame, tax: DataFrame) -> DataFrame:
    """`rank, n`: how many rows of `nodes` (column node) have which rank."""
    ranks = tax.groupBy(F.col("node").alias("__n")).agg(F.min("rank").alias("rank"), F.lit(True).alias("__known"))
    rows = nodes.join(ranks, F.col("node") == F.col("__n"), "left")
    rank = F.when(F.col("__known"), F.col("rank")).otherwise(F.lit(INVALID))
    return rows.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def translate_info(info: DataFrame, tax: DataFrame, merged: DataFrame | None = None, mapping: DataFrame | None = None, other: DataFrame | None = None, other_merged: DataFrame | None = None, root: str = ROOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`info` on the latest nodes of its taxonomy, and with `other` on those of another one.

    Four directions: within one taxonomy with merged nodes (`other`, `other_merged`, no
    mapping: nodes stay, replaced by the latest), and by a `mapping` (node, other) between
    or within the two kinds, where several images become their LCA. Returns the new info,
    the taxonomy that it stands on, and the counts of ranks by step (`step, rank, n`)."""
    rows = latest(info, merged) if merged is not None else info
    steps = [rank_counts(rows, tax).withColumn("step", F.lit("from"))]
    target = tax
    if other is not None:
        target = other
        if mapping is None:
            rows = latest(rows, other_merged) if other_merged is not None else rows
        else:
            images = mapping.join(rows.select("node").distinct(), "node", "left_semi").select("other").distinct()
            line = kept_lineages(rooted(other, root), root)
            line = keep_with_ancestors(line, images.select(F.col("other").alias("node")).join(other.select("node"), "node", "left_semi"))
            new = convert(rows.select("target", "node").distinct(), mapping, line)
            rows = rows.drop("node").join(new, "target", "left").select(*info.columns)
        steps.append(rank_counts(rows, target).withColumn("step", F.lit("to")))
    return rows, target, steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])


def validate_specializations(info: DataFrame) -> DataFrame:
    """A specialization that is null, or that stands under several nodes, is replaced by
    the target. info: `target, node, specialization, ...`."""
    many = info.filter(F.col("specialization").isNotNull()).groupBy("specialization").agg(F.count_distinct("node").alias("c")).filter("c > 1").select(F.col("specialization").alias("__s"))
    rows = info.join(many, F.col("specialization") == F.col("__s"), "left")
    return rows.withColumn("specialization", F.when(F.col("specialization").isNull() | F.col("__s").isNotNull(), F.col("target")).otherwise(F.col("specialization"))).drop("__s")


def collisions(info: DataFrame, tax: DataFrame, column: str = "target") -> DataFrame:
    """Targets or specializations that are also nodes."""
    return info.select(F.col(column).alias("node")).distinct().join(tax.select("node"), "node", "left_semi")


def build_tax(tax: DataFrame, info: DataFrame, level: str) -> DataFrame:
    """The taxonomy with the level's own nodes added: by `target` (leaf below its node) or
    `specialization`. A new node has the genome size of its node."""
    base = tax.select("node", "parent", "rank", "name", "genome_size")
    if level not in ("target", "specialization"):
        return base
    label = F.col("specialization_name") if level == "specialization" else F.col("target")
    new = info.select(F.col(level).alias("node"), F.col("node").alias("parent"), F.lit(level).alias("rank"), label.alias("name")).filter(F.col("node").isNotNull()).dropDuplicates(["node"])
    sized = new.join(tax.select(F.col("node").alias("parent"), "genome_size"), "parent", "left")
    return base.unionByName(sized.select("node", "parent", "rank", F.coalesce("name", "node").alias("name"), "genome_size"))


def user_bins(info: DataFrame, level: str, lineage: DataFrame | None = None) -> DataFrame:
    """`target, bin`: what a target is reported as: itself, its specialization, its node,
    or the ancestor of its node at a rank (else the node)."""
    if level in ("target", "specialization"):
        return info.select("target", F.coalesce(F.col(level), F.col("target")).alias("bin"))
    if level == "node" or lineage is None:
        return info.select("target", F.col("node").alias("bin"))
    return info.join(lineage.select("node", parent_rank(level).alias("__b")), "node", "left").select("target", F.coalesce("__b", "node").alias("bin"))


def first_targets(info: DataFrame, order: str) -> DataFrame:
    """One row per non-null target, the first by `order` (then by the whole row)."""
    rest = [c for c in info.columns if c not in ("target", order)]
    w = Window.partitionBy("target").orderBy(order, *rest)
    return info.filter(F.col("target").isNotNull()).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def enrich(info: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrites `columns` by key where `found` has a value."""
    right = found.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    rows = info.join(right, F.col(key) == F.col("__k"), "left")
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)))
    return rows.select(*info.columns)


def drop_invalid(info: DataFrame, tax: DataFrame, keep: bool = False, root: str = ROOT) -> DataFrame:
    """Rows without a valid node go, or with `keep` point to the root."""
    ok = tax.select(F.col("node").alias("__n")).distinct()
    rows = info.join(ok, F.col("node") == F.col("__n"), "left")
    if keep:
        return rows.withColumn("node", F.coalesce("__n", F.lit(root))).drop("__n")
    return rows.filter(F.col("__n").isNotNull()).drop("__n")
