"""The commands: build, update, classify, reassign, report and table.

A database is a folder of tables (hashes, targets, tax, info) with a configuration as
JSON. A finished stage leaves a marker, so that a run that was stopped goes on behind it.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..operators import matching, report as rp, resolve, table as tb, taxonomy
from ..session import Scratch
from ..sources import sequences, tables as io
from . import options as opt


class Folder:
    """Small files and markers of a database or a run, on any file system of Spark's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._p(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self.fs.exists(self._p(f"{self.path}/{name}"))

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self._p(f"{self.path}/{name}"), True)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def read(self, name: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def done(self, stage: str) -> bool:
        return self.has(f"_{stage}")

    def mark(self, stage: str) -> None:
        self.write(f"_{stage}", "")

    def drop(self, *names: str) -> None:
        for n in names:
            self.fs.delete(self._p(f"{self.path}/{n}"), True)


def prepare_info(info: DataFrame, tax: DataFrame | None, o: opt.Build) -> DataFrame:
    """The input relation, checked: one row per target, valid nodes, unambiguous
    specializations, no label that is also a node."""
    rows = taxonomy.first_targets(info, "file")
    if tax is not None:
        rows = taxonomy.drop_invalid(rows, tax, o.keep_invalid_taxa)
        if o.level in ("target", "specialization"):
            if o.level == "specialization":
                rows = taxonomy.validate_specializations(rows)
            if not taxonomy.collisions(rows, tax, o.level).isEmpty():
                raise ValueError(f"some {o.level} is also a node of the taxonomy")
    return rows


def build_custom(
    spark: SparkSession, info: DataFrame, seqs: DataFrame, out: str, tax: DataFrame | None = None, o: opt.Build | None = None, restart: bool = False, conversion: dict[str, DataFrame] | None = None
) -> None:
    """Makes a database of `info` (file, target, node, specialization,
    specialization_name) and `seqs` (file, seq; optionally target, for targets by
    sequence). Stages that a former run finished are not run again unless `restart`.

    `conversion` holds the tables of `taxonomy.translate_info` (merged, mapping, other,
    other_merged): the nodes are moved to their latest or to the other taxonomy, which
    the database then has, and the counts of ranks by step are written to `ranks`."""
    o = o or opt.Build()
    o.check()
    at = Folder(spark, out)
    if restart:
        at.drop("_parse", "_run")
    if not at.done("parse"):
        if conversion and tax is not None:
            info, tax, ranks = taxonomy.translate_info(info, tax, **conversion)
            ranks.coalesce(1).write.mode("overwrite").parquet(f"{out}/ranks")
            if "genome_size" not in tax.columns:
                tax = tax.withColumn("genome_size", F.lit(None).cast("bigint"))
        rows = prepare_info(info, tax, o)
        rows.write.mode("overwrite").parquet(f"{out}/info")
        if tax is not None:
            full = Scratch(spark, "tax").cut(taxonomy.rooted(taxonomy.build_tax(tax, rows, o.level)))[0]
            line = taxonomy.kept_lineages(full)
            used = taxonomy.user_bins(rows, o.level, line).select(F.col("bin").alias("node"))
            kept = taxonomy.keep_with_ancestors(line, used).select("node")
            full.join(kept, "node", "left_semi").write.mode("overwrite").parquet(f"{out}/tax")
        at.write("config.json", json.dumps(opt.plain(o)))
        at.mark("parse")
    if not at.done("run"):
        rows = spark.read.parquet(f"{out}/info")
        line = taxonomy.kept_lineages(taxonomy.rooted(spark.read.parquet(f"{out}/tax"))) if at.has("tax") else None
        bins = taxonomy.user_bins(rows, o.level, line)
        on = "target" if "target" in seqs.columns else "file"
        named = seqs.join(rows.join(bins, "target").select(F.col(on).alias("__on"), "bin", *(["target"] if on == "file" else [])), F.col(on) == F.col("__on"))
        refs = named.select("file", F.col("bin").alias("target"), "seq")
        scratch = Scratch(spark, "build")
        index, sizes = matching.build_index(refs, o.kmer, o.window, o.min_length, lambda x: scratch.cut(x)[0])
        kept, _ = scratch.cut(sizes)
        fixed = dict(total_bits=int(o.filter_size_mb * 8388608)) if o.filter_size_mb else dict(fp=o.max_fp)
        best = bloom.best_layout(bloom.layouts(kept, functions=o.hash_functions, **fixed), o.mode, "fp" if o.filter_size_mb else "size_bits").first()
        if best is None:
            raise ValueError("no sequence gave a hash")
        least = F.length("seq") >= o.min_length
        counts = [F.count_distinct("file").alias("files"), F.count(F.when(least, 1)).alias("sequences"), F.count(F.when(~least, 1)).alias("skipped_sequences"), F.coalesce(F.sum(F.when(least, F.length("seq"))), F.lit(0)).alias("length_bp")]
        listed = rows.agg(F.count_distinct("file").alias("n")).select("n").scalar()
        refs.agg(*counts).withColumn("invalid_files", listed - F.col("files")).coalesce(1).write.mode("overwrite").json(f"{out}/totals")
        rates = bloom.target_rates(kept, best["n_hashes"], best["bin_bits"], best["n_functions"])
        layout = {k: best[k] for k in ("n_hashes", "n_bins", "n_functions", "bin_bits")}
        matching.save_index(index, rates, out, o.partitions, kmer=o.kmer, window=o.window, **layout)
        scratch.drop(scratch.root)
        at.mark("run")


def update(spark: SparkSession, db: str, more_info: DataFrame, seqs: DataFrame, out: str, tax: DataFrame | None = None) -> None:
    """A database with the saved options over the old and new inputs. `seqs` must hold the
    sequences of every file of both; otherwise nothing is written."""
    at = Folder(spark, db)
    o = opt.Build(**json.loads(at.read("config.json")))
    old = spark.read.parquet(f"{db}/info")
    both = old.unionByName(more_info, allowMissingColumns=True)
    missing = both.select("file").distinct().join(seqs.select("file").distinct(), "file", "left_anti")
    if not missing.isEmpty():
        raise ValueError("sequences of some files are missing")
    base = tax if tax is not None else (spark.read.parquet(f"{db}/tax").filter(~F.col("rank").isin("target", "specialization")) if at.has("tax") else None)
    build_custom(spark, both, seqs, out, base, o)


def classify(spark: SparkSession, reads: DataFrame, levels: list[opt.Level], out: str, o: opt.Classify | None = None) -> DataFrame:
    """Classifies `reads` (prefix, id, seq[, seq2]) and writes below `out` the relations
    rep and totals, the .rep of each prefix as text (`rep_text`), and as asked for all,
    one, unc, the levels' statistics (`sta_levels`, the 18 columns of a .sta) and their
    summary with skipped reads (`sta`). With `output_single` all and one are not divided
    by level. Returns the rep, whose discarded matches stand in two further columns.
    Values of levels bind by first appearance; levels run in the order of their labels.
    """
    o = o or opt.Classify()
    o.check()
    for lv in levels:
        lv.check()
    key = ["prefix", "read"]
    rows = reads.withColumn("read", F.struct("id", F.xxhash64("seq"), F.monotonically_increasing_id()).cast("string") if "pos" not in reads.columns else F.concat_ws("\x01", F.col("file") if "file" in reads.columns else F.lit(""), "pos"))
    kw, plan, taxes = None, [], []
    for lv in levels:
        parts = []
        for db, cutoff in zip(lv.databases, lv.cutoffs(), strict=True):
            index, rates, config = matching.load_index(spark, db)
            c = config.first()
            if kw is not None and kw != (c["kmer"], c["window"]):
                raise ValueError("databases need equal k-mers and windows")
            kw = (c["kmer"], c["window"])
            parts.append((index, rates, cutoff))
            if Folder(spark, db).has("tax"):
                taxes.append(spark.read.parquet(f"{db}/tax"))
        plan.append((lv.label, parts, lv.rel_filter, lv.fpr_query))
    if kw is None:
        raise ValueError("no database")
    scratch = Scratch(spark, "classify")
    hashed, _ = scratch.cut(matching.read_hashes(rows, *kw, [*key, "id"], o.most_hashes))
    found = matching.judged(hashed, plan, key, lambda x: scratch.cut(x)[0])
    matches = found.filter("verdict = 'kept'").select("hierarchy", *key, "target", "kmer_count").join(hashed.select(*key, "id"), key)
    matches, _ = scratch.cut(matches)
    group = [*key, "id", "hierarchy"]
    if o.multiple_matches == "lca":
        targets = matches.select("target").distinct()
        tax = taxonomy.rooted(taxonomy.add_orphans(taxonomy.merge_taxonomies(taxes), targets), o.root) if taxes else None
        if tax is None:
            raise ValueError("lca needs databases with a taxonomy")
        resolved = resolve.resolve(matches, group, "lca", taxonomy.kept_lineages(tax, o.root), o.root)
    elif o.multiple_matches == "skip":
        resolved = resolve.resolve(matches, group, "skip", root=o.root)
    else:
        labels = [r[0] for r in matches.select("hierarchy").distinct().orderBy("hierarchy").collect()]  # the levels' labels
        single = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
        parts = []
        for label in labels:
            _, one, _ = resolve.em(matches.filter(F.col("hierarchy") == label), group, o.max_iter, o.threshold)
            parts.append(one)
        one = parts[0] if parts else matches.select(*group, "target", "kmer_count").limit(0)
        for p in parts[1:]:
            one = one.unionByName(p)
        resolved = one.join(single, key).withColumn("kind", F.when(F.col("__n") == 1, "unique").otherwise("lca")).drop("__n")
    resolved, _ = scratch.cut(resolved)
    rep = resolve.counters(matches, resolved, ["prefix", "hierarchy"], matching.discarded(found, ["prefix", "hierarchy", "target"]))
    if taxes:
        names = taxonomy.merge_taxonomies(taxes).select(F.col("node").alias("target"), "rank", "name")
        rep = rep.join(names, "target", "left")
    rep.write.mode("overwrite").parquet(f"{out}/rep")
    done = resolved.groupBy("prefix").agg(F.count(F.lit(1)).alias("classified"))
    total = hashed.groupBy("prefix").agg(F.count(F.lit(1)).alias("__all")).join(done, "prefix", "left")
    classified = F.coalesce("classified", F.lit(0))
    total.select("prefix", classified.alias("classified"), (F.col("__all") - classified).alias("unclassified")).write.mode("overwrite").parquet(f"{out}/totals")
    body, sums = spark.read.parquet(f"{out}/rep"), spark.read.parquet(f"{out}/totals")
    io.write_lines(io.rep_lines(body, sums, ["prefix"]), f"{out}/rep_text", "prefix")
    parts = ["prefix"] if o.output_single else ["prefix", "hierarchy"]
    columns = [*parts, "id", "target", "kmer_count"]
    if o.output_all:
        io.write_tsv(matches.select(*columns), f"{out}/all", partition_by=parts)
    if o.output_one:
        io.write_tsv(resolved.select(*columns), f"{out}/one", partition_by=parts)
    if o.output_unclassified:
        io.write_tsv(matching.unclassified(hashed, matches, [*key, "id"]).select("prefix", "id"), f"{out}/unc", partition_by=["prefix"])
    if o.output_stats:
        io.write_tsv(matching.stats(hashed, matches, key, "prefix"), f"{out}/sta", single=True, header=True)
        io.write_tsv(matching.sta(hashed, found, key, [lv.label for lv in levels]).orderBy("prefix", "hierarchy_label"), f"{out}/sta_levels", single=True, header=True)
    return body


def profile(spark: SparkSession, reads: DataFrame, levels: list[opt.Level], out: str, o: opt.Classify | None = None) -> dict[str, DataFrame]:
    """`classify`, then a report of each prefix where the databases have a taxonomy, written
    as text to `out`/tre/prefix=... and returned by prefix. `o.report` False leaves the
    reports out; `options.binning` gives the settings for counting reads."""
    o = o or opt.Classify()
    rep = classify(spark, reads, levels, out, o)
    taxes = [spark.read.parquet(f"{db}/tax") for lv in levels for db in lv.databases if Folder(spark, db).has("tax")]
    if not o.report or not taxes:
        return {}
    tax = taxonomy.merge_taxonomies(taxes)
    totals = spark.read.parquet(f"{out}/totals")
    got = {}
    for prefix in [r[0] for r in totals.select("prefix").orderBy("prefix").collect()]:  # the runs of a manifest
        of = F.col("prefix").eqNullSafe(F.lit(prefix))
        rows = report(rep.filter(of), totals.filter(of), tax, opt.Report(o.report_type, o.ranks, min_count=o.min_count))
        got[prefix] = write_tre(rows, totals.filter(of), f"{out}/tre/prefix={prefix}")
    return got


def write_tre(rows: DataFrame, totals: DataFrame, path: str, normalize: bool = False) -> DataFrame:
    """A .tre file: the unclassified, then the rows in their order. Returns what it holds."""
    spark = rows.sparkSession
    body, _ = Scratch(spark, "tre").cut(rows.withColumn("__i", F.monotonically_increasing_id() + 1))
    both = body if normalize else body.unionByName(rp.unclassified_row(totals).withColumn("__i", F.lit(0).cast("bigint")))
    columns = [c for c in both.columns if c != "__i"]
    io.write_lines(both.select(F.col("__i").alias("part"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")), path)
    return io.read_tre(spark, path)


def reassign(all_matches: DataFrame, rep: DataFrame, max_iter: int = 10, threshold: float = 0.0, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """The one-match relation and the rewritten rep of `hierarchy, readid, target,
    kmer_count` matches. One EM per hierarchy, or with `single` one over all, whose
    assigned reads then stand on every row of a target. Reads are merged by their id."""
    labels = [None] if single else [r[0] for r in all_matches.select("hierarchy").distinct().orderBy("hierarchy").collect()]
    ones, reps = [], []
    for label in labels:
        m = all_matches if label is None else all_matches.filter(F.col("hierarchy") == label)
        r = rep if label is None else rep.filter(F.col("hierarchy") == label)
        m = m.groupBy("readid", "target").agg(F.max("kmer_count").alias("kmer_count"))
        probs, one, _ = resolve.em(m, ["readid"], max_iter, threshold)
        ones.append(one if label is None else one.withColumn("hierarchy", F.lit(label)))
        reps.append(resolve.reassign_rep(r, probs))
    one, new = ones[0], reps[0]
    for x in ones[1:]:
        one = one.unionByName(x)
    for x in reps[1:]:
        new = new.unionByName(x)
    return one, new


def write_bioboxes(rows: DataFrame, path: str, sample: str, ranks: list[str] | None = None, source: str = "") -> None:
    """A profile with its header, of a report in the bioboxes format."""
    kept, _ = Scratch(rows.sparkSession, "profile").cut(rows.withColumn("__i", F.monotonically_increasing_id()))
    io.write_lines(io.bioboxes_lines(kept.coalesce(1).sortWithinPartitions("__i"), sample, ranks or list(rp.RANKS), source), path)


def write_table(matrix: DataFrame, path: str, output_format: str = "tsv") -> None:
    """The matrix with its labels, as tsv or csv."""
    io.write_tsv(matrix, path, "\t" if output_format == "tsv" else ",", single=True, header=True)


def report(rep: DataFrame, totals: DataFrame, tax: DataFrame, o: opt.Report | None = None, sizes: DataFrame | None = None, root: str = "1") -> DataFrame:
    """The rows of one sample's report, sorted, in the columns of its format. rep:
    `hierarchy, target, matches, unique, lca`; totals: one row."""
    o = o or opt.Report()
    o.check()
    body = rp.merge(rp.select_hierarchies(rep, o.skip_hierarchy, o.keep_hierarchy))
    if o.normalize:
        totals = totals.withColumn("unclassified", F.lit(0).cast("bigint"))
    known = tax.select("node", "parent", "rank", "name")
    orphans = body.select(F.col("target").alias("node")).join(known.select("node"), "node", "left_anti")
    line = taxonomy.kept_lineages(taxonomy.rooted(taxonomy.add_orphans(known, body.select("target"), root, "na"), root), root)
    if o.report_type in ("abundance", "corr") and sizes is None:
        given = taxonomy.genome_sizes(tax).filter("genome_size > 0") if "genome_size" in tax.columns else None
        sizes = taxonomy.estimate_genome_sizes(line, given, line.select("node")) if given is not None else line.select("node", F.lit(1).alias("genome_size"))
    rows = rp.build(body, totals, line, o.report_type, sizes, None, orphans)
    rows = rp.select(rows, o.ranks, o.no_orphan, o.top_percentile, o.min_count, o.max_count, o.taxids, o.names, o.names_with, root)
    rows = rp.order(rows, o.sort, o.ranks, root)
    if o.output_format == "bioboxes":
        return rp.bioboxes(rows, root)
    body = rp.tre(rows, o.ranks)
    return rp.text_lines(body) if o.output_format == "text" else body


def split_reports(rep: DataFrame, totals: DataFrame, tax: DataFrame, o: opt.Report, sizes: DataFrame | None = None) -> dict[str, DataFrame]:
    """One report per hierarchy; shares still refer to all reads."""
    labels = [r[0] for r in rep.select("hierarchy").distinct().orderBy("hierarchy").collect()]
    return {x: report(rep.filter(F.col("hierarchy") == x), totals, tax, replace(o, split_hierarchy=False), sizes) for x in labels}


def table(tre: DataFrame, o: opt.Table | None = None, root: str = "1") -> DataFrame:
    """The matrix of many samples' report rows (`label` and the report's columns)."""
    o = o or opt.Table()
    o.check()
    rows, totals = tb.parse(tre, o.rank)
    rows, totals = tb.select(rows, totals, o.min_count, o.max_count, o.taxids, o.names, o.names_with, root)
    if o.top_sample:
        rows, totals = tb.top_sample(rows, totals, o.top_sample, root)
    elif o.top_all:
        rows, totals = tb.top_all(rows, totals, o.top_all, root)
    if o.min_frequency:
        rows, totals = tb.min_frequency(rows, totals, o.min_frequency)
    if not o.rank:
        rows = tb.uncumulate(rows)
        if o.no_root:
            rows, totals = tb.no_root(rows, totals, root)
    elif o.no_root:
        rows = rows.withColumn("path", F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))))
    long = tb.values(rows, totals, o.output_value, o.header, o.unclassified_label, o.filtered_label)
    if o.skip_zeros:
        long = tb.skip_zeros(long)
    return tb.pivot(long, o.transpose)


def read_inputs(spark: SparkSession, paths: str | list[str], extension: str = ".fna.gz", recursive: bool = False, by_sequence: bool = False) -> tuple[DataFrame, DataFrame]:
    """`info` and `seqs` of sequence files: a target per file (its name), or per sequence
    (its header up to the first blank)."""
    from ..functions.text import basename, sequence_id

    seqs = sequences.read_sequences(spark, paths, recursive=recursive, extension=extension)
    none = F.lit(None).cast("string")
    extra = [none.alias(c) for c in ("node", "specialization", "specialization_name")]
    if by_sequence:
        seqs = seqs.withColumn("target", sequence_id(F.col("id")))
        return seqs.select("file", "target", *extra).distinct(), seqs
    files = sequences.list_files(spark, paths, extension, recursive)
    return files.select("file", basename(F.col("file")).alias("target"), *extra), seqs
