"""Per-sample reports: counts of targets become counts and shares of a taxonomy's nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import taxonomy

#: The ranks that are reported and corrected by default.
RANKS = ["domain", "phylum", "class", "order", "family", "genus", "species", "assembly"]
TYPES = ("reads", "matches", "dist", "corr", "abundance")


def select_hierarchies(rep: DataFrame, skip: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    if skip and keep:
        raise ValueError("skip and keep exclude each other")
    if skip:
        return rep.filter(~F.col("hierarchy").isin(skip))
    return rep.filter(F.col("hierarchy").isin(keep)) if keep else rep


def merge(rep: DataFrame) -> DataFrame:
    """`target, matches, unique, lca` summed over hierarchies."""
    return rep.groupBy("target").agg(*[F.sum(c).alias(c) for c in ("matches", "unique", "lca")])


def redistribute(rep: DataFrame, lineage: DataFrame) -> DataFrame:
    """Moves each inner node's lca reads to the leaves below it, in proportion to their
    unique reads, or to their matches where none has unique reads. Shares are rounded
    down; what is left goes one by one to the leaves by most unique reads, most matches
    and name. Nodes with no such leaf keep their reads. rep: `target, matches, unique, lca`.
    """
    tips = taxonomy.leaves(lineage)
    shared = rep.filter("lca > 0").select(F.col("target").alias("anc"), F.col("lca").alias("__s"))
    leaf = rep.select(F.col("target").alias("leaf"), "unique", "matches")
    rows = shared.join(tips.filter(F.col("anc") != F.col("leaf")), "anc").join(leaf, "leaf")
    of = Window.partitionBy("anc")
    rows = rows.withColumn("__u", F.sum("unique").over(of))
    rows = rows.withColumn("__w", F.when(F.col("__u") > 0, F.col("unique")).otherwise(F.col("matches"))).filter("__w > 0")
    rows = rows.withColumn("__t", F.sum("__w").over(of)).withColumn("__g", F.floor(F.col("__s") * (F.col("__w") / F.col("__t"))))
    order = of.orderBy(F.desc("unique"), F.desc("matches"), "leaf")
    rows = rows.withColumn("__left", F.col("__s") - F.sum("__g").over(of)).withColumn("__n", F.row_number().over(order))
    given = rows.withColumn("g", F.col("__g") + (F.col("__n") <= F.col("__left")).cast("long"))
    gain = given.groupBy(F.col("leaf").alias("target")).agg(F.sum("g").alias("gain"))
    lost = given.select(F.col("anc").alias("target"), F.lit(True).alias("gone")).distinct()
    out = rep.join(gain, "target", "left").join(lost, "target", "left")
    own = F.when(F.col("gone"), F.lit(0)).otherwise(F.col("lca"))
    return out.select("target", "matches", "unique", (own + F.coalesce("gain", F.lit(0))).alias("lca"))


def target_counts(rep: DataFrame, kind: str) -> DataFrame:
    """`node, n`: the matches of a matches report, else unique and lca reads; above 0."""
    n = F.col("matches") if kind == "matches" else F.col("unique") + F.col("lca")
    return rep.select(F.col("target").alias("node"), n.alias("n")).filter("n > 0")


def correct(counts: DataFrame, lineage: DataFrame, sizes: DataFrame, ranks: list[str] | None = None, root: str = "1") -> DataFrame:
    """`node, n`: cumulative counts corrected by genome size.

    Counts go to the nearest default rank. Within a rank, the reads are shared anew in
    proportion to count / genome size. Nodes between default ranks receive their share
    of the corrected count again. A node without a size takes the root's.
    """
    wanted = ["root", *(ranks or RANKS)]
    size_of = sizes.select(F.col("node").alias("near"), F.col("genome_size").cast("double").alias("g"))
    root_size = sizes.filter(F.col("node") == root).agg(F.max("genome_size").cast("double").alias("g")).select("g").scalar()
    line = lineage.select("node", "path", taxonomy.closest_parent(wanted, root).alias("near"))
    rows = counts.join(line, "node")
    rank_of = lineage.select(F.col("node").alias("near"), F.col("rank").alias("near_rank"))
    per = rows.groupBy("near").agg(F.sum("n").alias("c")).join(rank_of, "near").join(size_of, "near", "left")
    per = per.withColumn("ratio", F.col("c") / F.coalesce("g", root_size, F.lit(1.0)))
    of = Window.partitionBy("near_rank")
    per = per.withColumn("fixed", F.sum("c").over(of) * F.col("ratio") / F.sum("ratio").over(of))
    tree = taxonomy.cumulative(per.select(F.col("near").alias("node"), F.col("fixed").alias("n")), lineage)
    lost = rows.filter(F.col("near") != F.col("node")).join(per.select("near", "c", "fixed"), "near")
    between = lost.select(F.explode(F.expr("slice(path, array_position(path, near) + 1, size(path))")).alias("node"), (F.col("n") * F.col("fixed") / F.col("c")).alias("n"))
    return tree.unionByName(between).groupBy("node").agg(F.sum("n").alias("n"))


def build(rep: DataFrame, totals: DataFrame, lineage: DataFrame, kind: str = "abundance", sizes: DataFrame | None = None, ranks: list[str] | None = None, orphans: DataFrame | None = None) -> DataFrame:
    """`node, rank, name, path, ranks, names, unique, shared, children, cumulative, share,
    orphan`: a row for every node with a count. totals: one row `classified, unclassified`;
    the share is of both, or of all matches in a matches report."""
    if kind not in TYPES:
        raise ValueError(f"no report type {kind}")
    merged = redistribute(rep, lineage) if kind in ("abundance", "dist") else rep
    counts = target_counts(merged, kind)
    cum = taxonomy.cumulative(counts, lineage)
    if kind == "matches":
        total = rep.agg(F.sum("matches").alias("t")).select("t").scalar()
    else:
        total = totals.select((F.col("classified") + F.col("unclassified")).alias("t")).scalar()
    if kind in ("abundance", "corr"):
        if sizes is None:
            raise ValueError("a corrected report needs genome sizes")
        fixed = correct(counts, lineage, sizes, ranks)
        cum = cum.join(fixed.select("node", F.col("n").alias("f")), "node").withColumn("share", F.col("f") / total)
    else:
        cum = cum.withColumn("share", F.col("n") / total)
    shared = F.col("matches") - F.col("unique") if kind == "matches" else F.col("lca")
    own = merged.select(F.col("target").alias("node"), "unique", shared.alias("shared"))
    rows = cum.join(lineage, "node").join(own, "node", "left")
    rows = rows.select(
        "node", "rank", "name", "path", "ranks", "names", "depth",
        F.coalesce("unique", F.lit(0)).alias("unique"), F.coalesce("shared", F.lit(0)).alias("shared"), F.col("n").alias("cumulative"), "share",
    ).withColumn("children", F.col("cumulative") - F.col("unique") - F.col("shared"))
    if orphans is None:
        return rows.withColumn("orphan", F.lit(False))
    return rows.join(orphans.select("node", F.lit(True).alias("__o")).distinct(), "node", "left").withColumn("orphan", F.coalesce("__o", F.lit(False))).drop("__o")


def _bound(value: float, count: Column, share: Column, least: bool) -> Column:
    """Bounds above 1 are counts, below 1 shares; 0 and exactly 1 bound nothing."""
    if not value or value == 1:
        return F.lit(True)
    of = count if value > 1 else share
    return of >= value if least else of <= value


def top_percentile(rows: DataFrame, share: float, ranks: list[str] | None = None) -> DataFrame:
    """Adds `above`: within each default rank, whether the share lies above the one at
    place ceil(share * entries) in descending order; equal ones at the cut all go. Ranks
    with no entry beyond the cut, and other ranks, keep all."""
    wanted = ["root", *(ranks or RANKS)]
    of = Window.partitionBy("rank")
    r = rows.withColumn("__n", F.count(F.lit(1)).over(of)).withColumn("__r", F.row_number().over(of.orderBy(F.desc("share"), "node")))
    cut = F.max(F.when(F.col("__r") == F.ceil(F.lit(share) * F.col("__n")) + 1, F.col("share"))).over(of)
    return r.withColumn("above", F.coalesce(F.col("share") > cut, F.lit(True)) | ~F.col("rank").isin(wanted)).drop("__n", "__r")


def select(
    rows: DataFrame,
    ranks: list[str] | None = None,
    no_orphan: bool = False,
    percentile: float = 0.0,
    min_count: float = 0.0,
    max_count: float = 0.0,
    taxids: list[str] | None = None,
    names: list[str] | None = None,
    names_with: list[str] | None = None,
    root: str = "1",
) -> DataFrame:
    """The report's filters; the root always stays. `ranks` None means all ranks."""
    keep = F.lit(True)
    if no_orphan:
        keep = keep & ~F.col("orphan")
    if ranks is not None:
        keep = keep & F.coalesce(F.col("rank").isin(["root", *ranks]), F.lit(False))
    if percentile:
        rows = top_percentile(rows, percentile)
        keep = keep & F.col("above")
    keep = keep & _bound(min_count, F.col("cumulative"), F.col("share"), True) & _bound(max_count, F.col("cumulative"), F.col("share"), False)
    if taxids:
        keep = keep & F.arrays_overlap("path", F.array(*[F.lit(t) for t in taxids]))
    if names:
        keep = keep & F.coalesce(F.col("name").isin(names), F.lit(False))
    if names_with:
        some = F.lit(False)
        for n in names_with:
            some = some | F.contains(F.col("name"), F.lit(n))
        keep = keep & F.coalesce(some, F.lit(False))
    return rows.filter((F.col("node") == root) | keep).drop("above")


def order(rows: DataFrame, by: str = "", ranks: list[str] | None = None, root: str = "1") -> DataFrame:
    """Sorted rows, the root first. Default: by rank (as listed) and share, or by lineage
    when all ranks are shown. by: lineage, rank, unique or count."""
    first = F.col("node") != root
    listed = F.array_position(F.array(*[F.lit(r) for r in ["root", *(ranks or [])]]), F.col("rank"))
    place = F.when(listed == 0, F.lit(10_000)).otherwise(listed)
    if by == "lineage" or (not by and ranks is None):
        keys = [F.col("path")]
    elif by in ("", "rank"):
        keys = [place if ranks is not None else F.col("rank"), F.desc("share")]
    elif by == "unique":
        keys = [F.desc("unique"), F.desc("share")]
    elif by == "count":
        keys = [F.desc("cumulative")]
    else:
        raise ValueError(f"no order {by}")
    return rows.orderBy(first, *keys, "node")


def tre(rows: DataFrame, ranks: list[str] | None = None) -> DataFrame:
    """The nine columns of a .tre: rank, target, lineage, name, unique, shared, children,
    cumulative, perc."""
    if ranks is None:
        line = F.array_join("path", "|")
    else:
        upto = F.array(*[F.lit(r) for r in ["root", *ranks]])
        wanted = F.slice(upto, F.lit(1), F.greatest(F.array_position(upto, F.col("rank")), F.lit(1)).cast("int"))
        zipped = F.arrays_zip("path", "ranks")
        line = F.array_join(F.transform(wanted, lambda r: F.coalesce(F.get(F.transform(F.filter(zipped, lambda z: z["ranks"] == r), lambda z: z["path"]), F.lit(0)), F.lit(""))), "|")
    return rows.select("rank", F.col("node").alias("target"), line.alias("lineage"), "name", "unique", "shared", "children", "cumulative", F.format_string("%.5f", (F.col("share") * 100).cast("double")).alias("perc"))


def unclassified_row(totals: DataFrame) -> DataFrame:
    """The first line of a report, where reads are unclassified."""
    n = F.col("unclassified")
    share = n / (n + F.col("classified")) * 100
    zero = F.lit(0).cast("bigint")
    return totals.filter("unclassified > 0").select(
        F.lit("unclassified").alias("rank"), F.lit("-").alias("target"), F.lit("-").alias("lineage"), F.lit("unclassified").alias("name"), zero.alias("unique"), zero.alias("shared"), zero.alias("children"), n.cast("bigint").alias("cumulative"), F.format_string("%.5f", share.cast("double")).alias("perc")
    )


def text_lines(table: DataFrame) -> DataFrame:
    """`value`: the columns as text, padded to the widest entry of each."""
    cols = table.columns
    text = table.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    width = text.agg(*[F.max(F.length(c)).alias(c) for c in cols]).first()
    return text.select(F.concat_ws("\t", *[F.rpad(c, int(width[c] or 0), " ") for c in cols]).alias("value"))


def bioboxes(rows: DataFrame, root: str = "1") -> DataFrame:
    """`node, rank, path, names, perc` without the root, its entry cut from the paths."""
    return rows.filter(F.col("node") != root).select("node", "rank", F.array_join(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))), "|").alias("path"), F.array_join(F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0))), "|").alias("names"), (F.col("share") * 100).alias("perc"))


def rank_summary(rows: DataFrame) -> DataFrame:
    """Sums per rank of unique, shared, children and cumulative counts."""
    return rows.groupBy("rank").agg(*[F.sum(c).alias(c) for c in ("unique", "shared", "children", "cumulative")])
