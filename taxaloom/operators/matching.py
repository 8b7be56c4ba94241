"""Index of hashes per target, matches of reads against it, and their filters.

The index is exact: one row per distinct (hash, target), so a read's count for a target is
a join and a count, which Catalyst plans with map-side aggregation; false positives of the
modelled filter enter through each target's rate only. A hash that many targets share
spreads over its targets' rows after the join, which adaptive skew handling splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bloom, dna
from ..functions.text import decode_target

#: Fixed value: more hashes than a 16-bit counter holds are not counted.
MOST_HASHES = 65_535


def hashed(seqs: DataFrame, k: int, w: int, seq: str = "seq", name: str = "hashes") -> DataFrame:
    """Adds the minimizer hashes of `seq`, in order and with repeats."""
    return seqs.withColumn(name, dna.minimizer_hashes(k, w)(F.col(seq)))


def build_index(refs: DataFrame, k: int, w: int, min_length: int = 0, keep=None) -> tuple[DataFrame, DataFrame]:
    """From `file, target, seq`: the distinct `hash, target` rows, and `target, n_hashes`,
    the distinct hashes of each file summed over a target's files. Sequences shorter than
    `min_length` are skipped; targets without hashes have no rows. `keep` may cut the plan
    behind the hashes, for those who read both results."""
    sets = hashed(refs.filter(F.length("seq") >= min_length), k, w).select("file", "target", F.array_distinct("hashes").alias("hashes"))
    rows = (keep(sets) if keep else sets).select("file", "target", F.explode("hashes").alias("hash"))
    sizes = rows.distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n_hashes"))
    return rows.select("hash", "target").distinct(), sizes


def relevant(index: DataFrame, reads: DataFrame) -> DataFrame:
    """The index rows whose hash some read has. For an index that is made on the fly from
    many references for few reads: the semi-join moves below the index's distinct, so
    what no read asks for is never shuffled. Not for a stored index and many reads."""
    return index.join(reads.select(F.explode("hashes").alias("hash")).distinct(), "hash", "left_semi")


def save_index(index: DataFrame, sizes: DataFrame, path: str, partitions: int, **config: object) -> None:
    """The index sorted by hash within hash partitions, so that row groups prune, with the
    targets' sizes and a one-row configuration beside it."""
    index.repartition(partitions, "hash").sortWithinPartitions("hash").write.mode("overwrite").parquet(f"{path}/hashes")
    sizes.write.mode("overwrite").parquet(f"{path}/targets")
    index.sparkSession.createDataFrame([{k: v for k, v in config.items()}]).write.mode("overwrite").json(f"{path}/config")


def load_index(spark, path: str, decode: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the targets' sizes and the configuration. With `decode` the targets'
    names hold placeholders of special characters."""
    index, targets = spark.read.parquet(f"{path}/hashes"), spark.read.parquet(f"{path}/targets")
    if decode:
        index, targets = (x.withColumn("target", decode_target(F.col("target"))) for x in (index, targets))
    return index, targets, spark.read.json(f"{path}/config")


def read_hashes(reads: DataFrame, k: int, w: int, key: list[str], most: int = MOST_HASHES) -> DataFrame:
    """`key..., hashes, n_hashes, skipped`: the hashes of both mates (`seq`, optional
    `seq2`) as one bag. Reads whose first mate is shorter than a window are skipped as
    `small` even if the second is long; a second mate below a window is not used; reads
    with more than `most` hashes are skipped as `big`."""
    fn = dna.minimizer_hashes(k, w)
    empty = F.array().cast("array<bigint>")
    first = fn(F.col("seq"))
    bag = F.concat(first, fn(F.col("seq2"))) if "seq2" in reads.columns else first
    small = F.coalesce(F.length("seq") < w, F.lit(True))
    rows = reads.select(*key, small.alias("__small"), bag.alias("hashes"))
    rows = rows.withColumn("hashes", F.when(F.col("__small"), empty).otherwise(F.col("hashes")))
    n = F.size("hashes")
    skipped = F.when(F.col("__small"), "small").when(n > most, "big")
    return rows.select(*key, F.when(n > most, empty).otherwise(F.col("hashes")).alias("hashes"), F.when(n > most, 0).otherwise(n).alias("n_hashes"), skipped.alias("skipped"))


def count_matches(reads: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """`key..., target, n_hashes, kmer_count` for every read and target that share a hash.
    A hash that a read has twice counts twice."""
    bag = reads.select(*key, "n_hashes", F.explode("hashes").alias("hash")).groupBy(*key, "n_hashes", "hash").agg(F.count(F.lit(1)).alias("__c"))
    joined = bag.join(index.select("hash", "target"), "hash")
    return joined.groupBy(*key, "target", "n_hashes").agg(F.sum("__c").alias("kmer_count"))


def rel_cutoff(matches: DataFrame, cutoff: float) -> DataFrame:
    """Counts of at least max(1, ceil(n_hashes * cutoff))."""
    return matches.filter(F.col("kmer_count") >= F.greatest(F.lit(1), F.ceil(F.col("n_hashes") * F.lit(float(cutoff)))))


def merge_databases(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Matches of one level's databases, in order: a target keeps its highest count, and
    `low` is the least count of the read that was accepted on the way, even if a later
    database raised it."""
    rows = parts[0].withColumn("__db", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("__db", F.lit(i)))
    before = Window.partitionBy(*key, "target").orderBy("__db").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__ok", F.coalesce(F.col("kmer_count") > F.max("kmer_count").over(before), F.lit(True)))
    per = rows.filter("__ok").groupBy(*key, "target", "n_hashes").agg(F.max("kmer_count").alias("kmer_count"), F.min("kmer_count").alias("__low"))
    return per.withColumn("low", F.min("__low").over(Window.partitionBy(*key))).drop("__low")


def rel_filter(matches: DataFrame, share: float, key: list[str]) -> DataFrame:
    """Counts of at least max - ceil((max - min) * share) of the read's counts."""
    of = Window.partitionBy(*key)
    low = F.col("low") if "low" in matches.columns else F.min("kmer_count").over(of)
    rows = matches.withColumn("__top", F.max("kmer_count").over(of)).withColumn("__low", low)
    kept = rows.filter(F.col("kmer_count") >= F.col("__top") - F.ceil((F.col("__top") - F.col("__low")) * F.lit(float(share))))
    return kept.drop("__top", "__low", "low")


def fpr_query(matches: DataFrame, rates: DataFrame, threshold: float) -> DataFrame:
    """Matches whose chance of being false by the target's rate is at most `threshold`;
    1 or more keeps all. rates: `target, fpr`; a target without rate has none."""
    if threshold >= 1:
        return matches
    rows = matches.join(rates.select("target", "fpr"), "target", "left")
    q = bloom.tail_probability(F.col("kmer_count"), F.col("n_hashes").cast("bigint"), F.coalesce("fpr", F.lit(0.0)))
    return rows.filter(q <= threshold).select(*matches.columns)


def judge(matches: DataFrame, share: float, rates: DataFrame, threshold: float, key: list[str]) -> DataFrame:
    """Adds `verdict`: `kept`, or by what a match that passed its cutoff is discarded, the
    relative filter (`filter`) or then the query filter (`fpr`)."""
    of = Window.partitionBy(*key)
    low = F.col("low") if "low" in matches.columns else F.min("kmer_count").over(of)
    rows = matches.withColumn("__top", F.max("kmer_count").over(of)).withColumn("__low", low)
    verdict = F.when(F.col("kmer_count") < F.col("__top") - F.ceil((F.col("__top") - F.col("__low")) * F.lit(float(share))), "filter")
    if threshold < 1:
        rows = rows.join(rates.select("target", "fpr"), "target", "left")
        q = bloom.tail_probability(F.col("kmer_count"), F.col("n_hashes").cast("bigint"), F.coalesce("fpr", F.lit(0.0)))
        verdict = verdict.when(q > threshold, "fpr")
    return rows.withColumn("verdict", verdict.otherwise("kept")).select(*[c for c in matches.columns if c != "low"], "verdict")


Levels = list[tuple[str, list[tuple[DataFrame, DataFrame, float]], float, float]]


def judged(reads: DataFrame, levels: Levels, key: list[str], keep=None) -> DataFrame:
    """`hierarchy, key..., target, n_hashes, kmer_count, verdict`: levels in order of their
    labels; only reads without a kept match so far go on. A level is (label, [(index,
    rates, cutoff)], filter, threshold). Values belong to levels by first appearance,
    labels run sorted. `keep` may cut each level's plan, which is read twice."""
    out: DataFrame | None = None
    left = reads
    for label, databases, share, threshold in sorted(levels, key=lambda x: x[0]):
        parts = [rel_cutoff(count_matches(left, index, key), cutoff) for index, _, cutoff in databases]
        rates = databases[0][1].select("target", "fpr")
        for _, r, _ in databases[1:]:
            rates = rates.unionByName(r.select("target", "fpr"))
        rates = rates.groupBy("target").agg(F.max("fpr").alias("fpr"))
        got = judge(merge_databases(parts, key), share, rates, threshold, key).select(F.lit(label).alias("hierarchy"), *key, "target", "n_hashes", "kmer_count", "verdict")
        got = keep(got) if keep else got
        out = got if out is None else out.unionByName(got)
        left = left.join(got.filter("verdict = 'kept'").select(*key).distinct(), key, "left_anti")
    assert out is not None
    return out


def hierarchy(reads: DataFrame, levels: Levels, key: list[str]) -> DataFrame:
    """`hierarchy, key..., target, kmer_count`: the kept matches of `judged`."""
    return judged(reads, levels, key).filter("verdict = 'kept'").select("hierarchy", *key, "target", "kmer_count")


def discarded(rows: DataFrame, by: list[str]) -> DataFrame:
    """`by..., dis_matches_rel_filter, dis_matches_fpr_query` of judged matches."""
    return rows.groupBy(*by).agg(F.count(F.when(F.col("verdict") == "filter", 1)).alias("dis_matches_rel_filter"), F.count(F.when(F.col("verdict") == "fpr", 1)).alias("dis_matches_fpr_query"))


def sta(reads: DataFrame, rows: DataFrame, key: list[str], labels: list[str], prefix: str = "prefix") -> DataFrame:
    """The 18 columns of a .sta: one row per prefix and level, and with several levels one
    of their sums (`-total-`). Reads that were skipped are not processed. A classified
    read counts with its highest count and all its hashes, in the level that kept it.

    reads: `key..., prefix, n_hashes, skipped`; rows: judged matches with `prefix`."""
    held = F.col("verdict") == "kept"
    per = rows.groupBy(prefix, "hierarchy", *[k for k in key if k != prefix]).agg(
        F.count(F.when(held, 1)).alias("c"), F.count(F.when(F.col("verdict") == "filter", 1)).alias("f"), F.count(F.when(F.col("verdict") == "fpr", 1)).alias("q"), F.max("kmer_count").alias("best"), F.max("n_hashes").alias("n")
    )
    done = F.col("c") > 0
    sums = [
        F.count(F.when(done, 1)).alias("seq_classified"), F.count(F.when(F.col("c") == 1, 1)).alias("seq_unique_matches"), F.sum("c").alias("matches"), F.sum("f").alias("dis_matches_rel_filter"),
        F.sum("q").alias("dis_matches_fpr_query"), F.sum(F.when(done, F.col("best"))).alias("kmers_matched"), F.sum(F.when(done, F.col("n"))).alias("kmers_from_classified_seqs"),
    ]
    level = per.groupBy(prefix, "hierarchy").agg(*sums)
    whole = reads.groupBy(prefix).agg(F.count(F.when(F.col("skipped").isNull(), 1)).alias("seq_processed"), F.coalesce(F.sum("n_hashes"), F.lit(0)).alias("kmers_processed"))
    names = sorted(labels)
    grid = whole.withColumn("hierarchy", F.explode(F.array(*[F.lit(x) for x in names]))).join(level, [prefix, "hierarchy"], "left")
    counts = ["seq_classified", "seq_unique_matches", "matches", "dis_matches_rel_filter", "dis_matches_fpr_query", "kmers_matched", "kmers_from_classified_seqs"]
    grid = grid.select(prefix, F.col("hierarchy").alias("hierarchy_label"), "seq_processed", "kmers_processed", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    total = grid.groupBy(prefix).agg(F.lit("-total-").alias("hierarchy_label"), F.max("seq_processed").alias("seq_processed"), F.max("kmers_processed").alias("kmers_processed"), *[F.sum(c).alias(c) for c in counts])
    both = grid.unionByName(total)
    unclassified = (F.col("seq_processed") - F.col("seq_classified")) if len(names) == 1 else F.col("__u")
    if len(names) == 1:
        both = grid
    else:
        open_ = total.select(F.col(prefix).alias("__p"), (F.col("seq_processed") - F.col("seq_classified")).alias("__u"))
        both = both.join(open_, F.col(prefix).eqNullSafe(F.col("__p")))

    def share(c: Column) -> Column:
        return F.round(c / F.greatest(F.col("seq_processed"), F.lit(1)) * 100, 6)

    def ratio(a: str, b: str, by: float = 1.0) -> Column:
        return F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b) * by).otherwise(0.0), 6)

    several = F.col("seq_classified") - F.col("seq_unique_matches")
    return both.select(
        F.col(prefix).cast("string").alias("prefix"), "hierarchy_label", "seq_processed", unclassified.alias("seq_unclassified"), "seq_classified", share(F.col("seq_classified")).alias("seq_classified_perc"),
        "seq_unique_matches", share(F.col("seq_unique_matches")).alias("seq_unique_matches_perc"), several.alias("seq_multiple_matches"), share(several).alias("seq_multiple_matches_perc"),
        "matches", ratio("matches", "seq_classified").alias("avg_matches_ref_seq"), "dis_matches_rel_filter", "dis_matches_fpr_query",
        F.col("kmers_processed").alias("kmers_proccessed"),  # so spelled in the file
        "kmers_matched", "kmers_from_classified_seqs", ratio("kmers_matched", "kmers_from_classified_seqs", 100.0).alias("kmers_matched_perc"),
    )


def unclassified(reads: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """Reads without a match, the skipped ones included."""
    return reads.select(*key).join(matches.select(*key).distinct(), key, "left_anti")


def stats(reads: DataFrame, matches: DataFrame, key: list[str], prefix: str) -> DataFrame:
    """Per prefix, and once for all (`-total-`): reads, classified, unclassified (of those
    that were not skipped), skipped small and big, hashes, matches and their means."""
    per = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("__m"), F.max("kmer_count").alias("__best"))
    rows = reads.join(per, key, "left")
    total = rows.rollup(prefix).agg(
        F.grouping(prefix).alias("__all"),
        F.count(F.lit(1)).alias("reads"),
        F.count("__m").alias("classified"),
        F.sum((F.col("__m").isNull() & F.col("skipped").isNull()).cast("long")).alias("unclassified"),
        F.sum(F.coalesce((F.col("skipped") == "small").cast("long"), F.lit(0))).alias("skipped_small"),
        F.sum(F.coalesce((F.col("skipped") == "big").cast("long"), F.lit(0))).alias("skipped_big"),
        F.sum(F.col("n_hashes").cast("bigint")).alias("hashes"),
        F.coalesce(F.sum("__m"), F.lit(0)).alias("matches"),
        F.sum((F.col("__m") == 1).cast("long")).alias("unique_reads"),
    )
    share = F.when(F.col("reads") > 0, F.col("classified") / F.col("reads") * 100).otherwise(0.0)
    mean = F.when(F.col("classified") > 0, F.col("matches") / F.col("classified")).otherwise(0.0)
    return total.select(
        F.when(F.col("__all") == 1, F.lit("-total-")).otherwise(F.col(prefix).cast("string")).alias("prefix"),
        "reads", "classified", "unclassified", "skipped_small", "skipped_big", "hashes", "matches",
        F.coalesce("unique_reads", F.lit(0)).alias("unique_reads"), F.round(share, 6).alias("classified_pct"), F.round(mean, 6).alias("matches_avg"),
    )


def best_per_read(matches: DataFrame, key: list[str]) -> DataFrame:
    """The match with the highest count of each read; ties by target."""
    top = F.max_by(F.struct("target", "kmer_count"), F.struct(F.col("kmer_count"), _descending(F.col("target"))))
    return matches.groupBy(*key).agg(top.alias("b")).select(*key, "b.target", "b.kmer_count")


def _descending(text: Column) -> Column:
    """A key that orders texts backwards: complemented bytes, closed by the highest."""
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
