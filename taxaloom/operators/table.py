"""Many reports to one table of samples by taxa, in long form until the sink.

Long rows are `label, taxid, name, path, count`; per label there is one row of totals
`label, total, unclassified, filtered`. Every step is a window or an aggregation over
these, so the number of samples and taxa is not bounded by a driver or a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "1"


def parse(tre: DataFrame, rank: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Long rows and totals of report rows (`label` and the nine report columns). With a
    rank only its rows are kept, and not the root's."""
    is_root, is_unc = F.col("rank") == "root", F.col("rank") == "unclassified"
    totals = tre.groupBy("label").agg(F.coalesce(F.sum(F.when(is_unc, F.col("cumulative"))), F.lit(0)).alias("unclassified"), F.coalesce(F.sum(F.when(is_root, F.col("cumulative"))), F.lit(0)).alias("__c"))
    totals = totals.select("label", (F.col("unclassified") + F.col("__c")).alias("total"), "unclassified", F.lit(0).cast("bigint").alias("filtered"))
    kept = tre.filter(~is_unc) if not rank else tre.filter(F.col("rank") == rank)
    rows = kept.select("label", F.col("target").alias("taxid"), "name", F.split("lineage", r"\|").alias("path"), F.col("cumulative").alias("count"))
    return rows, totals


def _drop(rows: DataFrame, totals: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and totals to whose `filtered` the counts of the others are added."""
    flagged = rows.withColumn("__keep", F.coalesce(keep, F.lit(False)))
    lost = flagged.groupBy("label").agg(F.sum(F.when(~F.col("__keep"), F.col("count"))).alias("__f"))
    totals = totals.join(lost, "label", "left").withColumn("filtered", F.col("filtered") + F.coalesce("__f", F.lit(0))).drop("__f")
    return flagged.filter("__keep").select(*rows.columns), totals


def _bound(value: float, count: Column, total: Column, least: bool) -> Column:
    if not value or value == 1:
        return F.lit(True)
    of = count if value > 1 else count / total
    return of >= value if least else of <= value


def select(
    rows: DataFrame,
    totals: DataFrame,
    min_count: float = 0.0,
    max_count: float = 0.0,
    taxids: list[str] | None = None,
    names: list[str] | None = None,
    names_with: list[str] | None = None,
    root: str = ROOT,
) -> tuple[DataFrame, DataFrame]:
    """The table's filters; the root is exempt. Of taxids, names and names_with the first
    that is given decides."""
    r = rows.join(totals.select("label", "total"), "label")
    keep = _bound(min_count, F.col("count"), F.col("total"), True) & _bound(max_count, F.col("count"), F.col("total"), False)
    if taxids:
        keep = keep & F.arrays_overlap("path", F.array(*[F.lit(t) for t in taxids]))
    if names:
        keep = keep & F.col("name").isin(names)
    if names_with:
        some = F.lit(False)
        for n in names_with:
            some = some | F.contains(F.col("name"), F.lit(n))
        keep = keep & some
    kept, totals = _drop(r, totals, (F.col("taxid") == root) | keep)
    return kept.select(*rows.columns), totals


def top_sample(rows: DataFrame, totals: DataFrame, n: int, root: str = ROOT) -> tuple[DataFrame, DataFrame]:
    """The n taxa of each sample with the highest counts; ties by taxid; the root stays
    and is not counted."""
    w = Window.partitionBy("label").orderBy((F.col("taxid") == root).cast("int"), F.desc("count"), "taxid")
    ranked = rows.withColumn("__r", F.row_number().over(w))
    kept, totals = _drop(ranked, totals, (F.col("taxid") == root) | (F.col("__r") <= n))
    return kept.select(*rows.columns), totals


def taxon_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """`taxid, sum_share, frequency`: summed share of samples, and samples with the taxon."""
    r = rows.join(totals.select("label", "total"), "label")
    return r.groupBy("taxid").agg(F.sum(F.col("count") / F.col("total")).alias("sum_share"), F.count(F.lit(1)).alias("frequency"))


def top_all(rows: DataFrame, totals: DataFrame, n: int, root: str = ROOT) -> tuple[DataFrame, DataFrame]:
    """The n taxa with the highest summed share over all samples; ties by taxid."""
    best = taxon_totals(rows, totals).filter(F.col("taxid") != root).orderBy(F.desc(F.round("sum_share", 12)), "taxid").limit(n).select("taxid", F.lit(True).alias("__in"))
    flagged = rows.join(best, "taxid", "left")
    kept, totals = _drop(flagged, totals, (F.col("taxid") == root) | F.col("__in"))
    return kept.select(*rows.columns), totals


def min_frequency(rows: DataFrame, totals: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Taxa in at least `least` samples; below 1 that share of all samples, rounded down."""
    files = totals.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    need = F.lit(least) if least >= 1 else F.floor(files * F.lit(least))
    often = rows.groupBy("taxid").agg(F.count(F.lit(1)).alias("__n"))
    flagged = rows.join(often, "taxid")
    kept, totals = _drop(flagged, totals, F.col("__n") >= need)
    return kept.select(*rows.columns), totals


def uncumulate(rows: DataFrame) -> DataFrame:
    """Counts of several ranks made to add up: from each count the counts of the nearest
    reported nodes below it are taken off. One join finds every row's nearest reported
    ancestor; the rest is a sum per ancestor."""
    line = rows.select("label", "taxid", "count", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "anc"))
    known = rows.select(F.col("label").alias("__l"), F.col("taxid").alias("__t"))
    up = line.join(known, (F.col("label") == F.col("__l")) & (F.col("anc") == F.col("__t")))
    near = up.groupBy("label", "taxid", "count").agg(F.max_by("anc", "i").alias("anc"))
    below = near.groupBy("label", F.col("anc").alias("taxid")).agg(F.sum("count").alias("__below"))
    return rows.join(below, ["label", "taxid"], "left").withColumn("count", F.col("count") - F.coalesce("__below", F.lit(0))).select(*rows.columns)


def no_root(rows: DataFrame, totals: DataFrame, root: str = ROOT) -> tuple[DataFrame, DataFrame]:
    """Takes the root off: its own count becomes unclassified, its place in paths goes."""
    left = rows.filter(F.col("taxid") == root).select("label", F.col("count").alias("__r"))
    totals = totals.join(left, "label", "left").withColumn("unclassified", F.col("unclassified") + F.coalesce("__r", F.lit(0))).drop("__r")
    return rows.filter(F.col("taxid") != root).withColumn("path", F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))), totals


def values(rows: DataFrame, totals: DataFrame, output: str = "counts", header: str = "name", unclassified: str | None = None, filtered: str | None = None) -> DataFrame:
    """`label, taxon, value` in long form, extra columns included. Equal labels for the
    unclassified and the filtered make one summed column."""
    title = {"name": F.col("name"), "taxid": F.col("taxid"), "lineage": F.array_join("path", "|")}[header]
    r = rows.join(totals.select("label", "total"), "label").select("label", title.alias("taxon"), F.col("count").alias("value"), "total")
    extra = []
    if unclassified:
        extra.append(F.struct(F.lit(unclassified).alias("taxon"), F.col("unclassified").alias("value")))
    if filtered:
        extra.append(F.struct(F.lit(filtered).alias("taxon"), F.col("filtered").alias("value")))
    if extra:
        more = totals.select("label", F.explode(F.array(*extra)).alias("x"), "total").select("label", "x.taxon", "x.value", "total")
        r = r.unionByName(more)
    r = r.groupBy("label", "taxon", "total").agg(F.sum("value").alias("value"))
    value = F.col("value") / F.col("total") if output == "percentage" else F.col("value")
    return r.select("label", "taxon", value.alias("value"))


def skip_zeros(long: DataFrame) -> DataFrame:
    """Without labels, then taxa, whose values are all 0."""
    for key in ("label", "taxon"):
        long = long.withColumn("__m", F.max("value").over(Window.partitionBy(key))).filter("__m > 0").drop("__m")
    return long


def pivot(long: DataFrame, transpose: bool = False, most: int = 20_000) -> DataFrame:
    """The matrix: taxa as rows and labels as columns, or with `transpose` the other way.
    What becomes columns is a sink's concern and bounded by `most`; missing values are 0."""
    rows, cols = ("label", "taxon") if transpose else ("taxon", "label")
    names = [r[0] for r in long.select(cols).distinct().orderBy(cols).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns; write the long form instead")
    return long.groupBy(rows).pivot(cols, names).agg(F.sum("value")).na.fill(0).orderBy(rows)
