"""Queries of the index, matching and resolution operators over the test tables.

The tables hold no sequences; letters of the texts stand for nucleotides. Held-out items
are the reads and documents the references, since a long text never reaches a cutoff
against a short one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, dna, text
from ..operators import matching, resolve, taxonomy
from ..session import Scratch, spread
from .tables import table

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
K = 11
CUTOFF, FILTER, FPR = 0.3, 0.5, 1e-5
FIXED_BITS = 4_000_000
LAYOUT = {"max_hashes": 2000, "bits": 16384, "functions": 3}


def nucleotides(column: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(column), "[^a-z]", ""), ALPHABET, BASES)


def reads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_items").filter(F.col("text").isNotNull())
    return rows.select(F.col("item_id").alias("read"), (F.col("item_id") % 3).alias("prefix"), nucleotides(F.col("text")).alias("seq"))


def references(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents")).filter(F.col("text").isNotNull())
    return rows.select(F.col("doc_id").alias("file"), F.concat(F.lit("d"), F.col("doc_id")).alias("target"), (F.col("doc_id") % 2).alias("db"), "lang", "source", nucleotides(F.col("text")).alias("seq"))


def doc_tax(spark: SparkSession, d: str) -> DataFrame:
    """Documents below source within language below the root."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("node"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"))
    mid = F.concat(F.lit("l"), "lang", F.lit("/"), "source")
    top = F.concat(F.lit("l"), "lang")
    leaf = docs.select("node", mid.alias("parent"), F.lit("assembly").alias("rank"), F.col("node").alias("name"))
    inner = docs.select(mid.alias("node"), top.alias("parent"), F.lit("species").alias("rank"), F.col("source").alias("name")).distinct()
    langs = docs.select(top.alias("node"), F.lit("1").alias("parent"), F.lit("genus").alias("rank"), F.col("lang").alias("name")).distinct()
    root = spark.createDataFrame([("1", "0", "root", "root")], leaf.schema)
    return root.unionByName(langs).unionByName(inner).unionByName(leaf)


def _index(spark: SparkSession, d: str, db: int | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    refs = references(spark, d)
    cut = (lambda x: Scratch(spark, "hashes").cut(x)[0]) if keep else None
    return matching.build_index(refs if db is None else refs.filter(F.col("db") == db), K, K, keep=cut)


def _read_hashes(spark: SparkSession, d: str, paired: bool = False) -> DataFrame:
    rows = reads(spark, d)
    if paired:
        half = F.floor(F.length("seq") / 2).cast("int")
        rows = rows.select("read", "prefix", F.substring("seq", F.lit(1), half).alias("seq"), F.substring("seq", half + 1, F.length("seq")).alias("seq2"))
    return matching.read_hashes(rows, K, K, ["read", "prefix"])


def _counts(spark: SparkSession, d: str) -> DataFrame:
    h = _read_hashes(spark, d)
    return matching.count_matches(h, matching.relevant(_index(spark, d)[0], h), ["read"])


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return bloom.target_rates(_index(spark, d)[1], LAYOUT["max_hashes"], LAYOUT["bits"], LAYOUT["functions"])


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.rel_filter(matching.rel_cutoff(_counts(spark, d), CUTOFF), FILTER, ["read"])


def seq1_encode(spark: SparkSession, d: str) -> DataFrame:
    s = dna.encode(F.col("text"))
    rows = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return rows.select("doc_id", *[(F.length(s) - F.length(F.replace(s, F.lit(c)))).alias(f"n_{c.lower()}") for c in "CGT"])


def seq2_kmers(spark: SparkSession, d: str) -> DataFrame:
    k = dna.kmers(F.col("seq"), K)
    return references(spark, d).select("target", F.size(k).alias("n_kmers"), F.size(F.array_distinct(k)).alias("n_distinct"))


def seq3_canonical(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select(F.explode(dna.kmers(F.col("seq"), 5)).alias("m")).groupBy(dna.canonical(F.col("m")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def seq3_hashes(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select(F.explode(dna.kmer_hashes(F.col("seq"), 5)).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def seq4_minimizers(spark: SparkSession, d: str) -> DataFrame:
    h = matching.hashed(references(spark, d), 19, 31)
    return h.select("target", F.size("hashes").alias("n_minimizers"), F.size(F.array_distinct("hashes")).alias("n_distinct"))


def agg1_target_sizes(spark: SparkSession, d: str) -> DataFrame:
    refs = references(spark, d).withColumn("target", F.coalesce("source", F.lit("?")))
    return matching.build_index(refs, K, K)[1]


def agg19_bins(spark: SparkSession, d: str) -> DataFrame:
    sizes = _index(spark, d)[1]
    return sizes.agg(F.max("n_hashes").alias("max_hashes"), F.sum(F.ceil(F.col("n_hashes") / 500)).alias("n_bins"))


def mth7_target_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).select("target", "n_hashes", "n_bins", F.round("fpr", 9).alias("fpr"))


def agg18_true_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).agg(F.round(F.max("fpr"), 9).alias("highest"), F.round(F.avg("fpr"), 9).alias("average"))


def mth10_layouts(spark: SparkSession, d: str) -> DataFrame:
    got = bloom.layouts(_index(spark, d)[1], fp=0.05, functions=4)
    return got.select("n_hashes", "n_bins", "n_functions", F.round(F.col("bin_bits") / 1000, 1).alias("kbits"))


def mth10_best(spark: SparkSession, d: str) -> DataFrame:
    sizes = _index(spark, d)[1]
    return bloom.best_layout(bloom.layouts(sizes, fp=0.05, functions=4), "avg").select("n_hashes", "n_bins")


def mth10_modes(spark: SparkSession, d: str) -> DataFrame:
    """The layout that each mode chooses."""
    cand = bloom.layouts(_index(spark, d)[1], fp=0.05, functions=4)
    parts = [bloom.best_layout(cand, m).select(F.lit(m).alias("mode"), "n_hashes", "n_bins") for m in bloom.MODES]
    return reduce(DataFrame.unionByName, parts)


def mth10_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a filter of a given size."""
    got = bloom.layouts(_index(spark, d)[1], total_bits=FIXED_BITS, functions=4)
    return got.select("n_hashes", "n_bins", "bin_bits", F.round("fp", 9).alias("fp"))


def mth5_functions(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose sizes choose the number of functions."""
    got = bloom.layouts(_index(spark, d)[1], fp=0.05)
    return got.select("n_hashes", "n_functions", F.round(F.col("bin_bits") / 1000, 1).alias("kbits"))


def mth11_bin_map(spark: SparkSession, d: str) -> DataFrame:
    return bloom.bin_map(_index(spark, d)[1], 500)


def flt1_min_length(spark: SparkSession, d: str) -> DataFrame:
    return matching.build_index(references(spark, d), K, K, min_length=600)[1]


def flt3_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Reads below a window and reads with more hashes than are counted."""
    return matching.read_hashes(reads(spark, d), K, K, ["read"], most=200).select("read", "n_hashes", F.coalesce("skipped", F.lit("-")).alias("skipped"))


def joi1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def flt4_rel_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return matching.rel_cutoff(_counts(spark, d), CUTOFF)


def flt5_rel_filter(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


def flt6_fpr_query(spark: SparkSession, d: str) -> DataFrame:
    index, sizes = _index(spark, d, keep=True)
    h = _read_hashes(spark, d)
    counts = matching.count_matches(h, matching.relevant(index, h), ["read"])
    rates = bloom.target_rates(sizes, LAYOUT["max_hashes"], LAYOUT["bits"], LAYOUT["functions"])
    return matching.fpr_query(matching.rel_cutoff(counts, 0.1), rates, FPR).select("read", "target", "kmer_count")


def joi3_databases(spark: SparkSession, d: str) -> DataFrame:
    h = _read_hashes(spark, d)
    parts = [matching.rel_cutoff(matching.count_matches(h, matching.relevant(_index(spark, d, db)[0], h).withColumn("target", F.concat(F.lit("t"), F.substring("target", 6, 3))).distinct(), ["read"]), 0.2) for db in (0, 1)]
    return matching.merge_databases(parts, ["read"])


def flt7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = _read_hashes(spark, d)
    levels = []
    for label, db in (("B", 1), ("A", 0)):
        index, sizes = _index(spark, d, db)
        levels.append((label, [(matching.relevant(index, h), sizes.select("target", F.lit(0.0).alias("fpr")), CUTOFF)], FILTER, 1.0))
    return matching.hierarchy(h, levels, ["read"])


def joi6_mates(spark: SparkSession, d: str) -> DataFrame:
    h = _read_hashes(spark, d, paired=True)
    return matching.count_matches(h, matching.relevant(_index(spark, d)[0], h), ["read"])


def snk4_unclassified(spark: SparkSession, d: str) -> DataFrame:
    return matching.unclassified(reads(spark, d), _matches(spark, d), ["read"])


def snk7_stats(spark: SparkSession, d: str) -> DataFrame:
    h = _read_hashes(spark, d)
    return matching.stats(h, matching.rel_filter(matching.rel_cutoff(matching.count_matches(h, matching.relevant(_index(spark, d)[0], h), ["read"]), CUTOFF), FILTER, ["read"]), ["read"], "prefix")


def _judged(spark: SparkSession, d: str, h: DataFrame) -> DataFrame:
    levels = []
    for label, db in (("B", 1), ("A", 0)):
        index, sizes = _index(spark, d, db, keep=True)
        rates = bloom.target_rates(sizes, LAYOUT["max_hashes"], LAYOUT["bits"], LAYOUT["functions"])
        levels.append((label, [(matching.relevant(index, h), rates, 0.1)], FILTER, FPR))
    return matching.judged(h, levels, ["prefix", "read"], lambda x: Scratch(spark, "judged").cut(x)[0])


def agg5_discarded(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each level and target that its filters discard."""
    rows = matching.discarded(_judged(spark, d, _read_hashes(spark, d)), ["hierarchy", "prefix", "target"])
    return rows.filter("dis_matches_rel_filter > 0 OR dis_matches_fpr_query > 0")


def snk7_sta(spark: SparkSession, d: str) -> DataFrame:
    """The 18 columns of a .sta over two levels."""
    h = _read_hashes(spark, d)
    return matching.sta(h, _judged(spark, d, h), ["prefix", "read"], ["A", "B"])


def win4_best(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_per_read(_matches(spark, d), ["read"])


def res1_unique(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(_matches(spark, d), ["read"], "skip").filter("kind = 'unique'").select("read", "target", "kmer_count")


def res2_lca(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(Scratch(spark, "matches").cut(_matches(spark, d))[0], ["read"], "lca", taxonomy.kept_lineages(doc_tax(spark, d)))


def res3_skip(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(_matches(spark, d), ["read"], "skip")


def agg5_counters(spark: SparkSession, d: str) -> DataFrame:
    m, _ = Scratch(spark, "matches").cut(_matches(spark, d).join(reads(spark, d).select("read", "prefix"), "read"))
    r = resolve.resolve(m, ["read", "prefix"], "lca", taxonomy.kept_lineages(doc_tax(spark, d)))
    return resolve.counters(m, r, ["prefix"])


def _em_input(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "read_matches").filter(F.col("readid").isNotNull() & F.col("target").isNotNull() & F.col("kcount").isNotNull())
    return rows.groupBy("run_label", "readid", "target").agg(F.max("kcount").alias("kmer_count"))


def res4_em_round(spark: SparkSession, d: str) -> DataFrame:
    got, _, _ = resolve.em(_em_input(spark, d), ["run_label", "readid"], max_iter=1)
    return got.select("target", "unique", "assigned", F.round("p", 9).alias("p"))


def res4_em(spark: SparkSession, d: str) -> DataFrame:
    got, _, _ = resolve.em(_em_input(spark, d), ["run_label", "readid"])
    return got.select("target", "unique", "assigned", F.round("p", 9).alias("p"))


def res5_one(spark: SparkSession, d: str) -> DataFrame:
    return resolve.em(_em_input(spark, d), ["run_label", "readid"], max_iter=1)[1]


def src4_batches(spark: SparkSession, d: str) -> DataFrame:
    """Matches per batch of the manifest, whose prefixes may repeat."""
    batch = table(spark, d, "run_manifest").groupBy("prefix").agg(F.count(F.lit(1)).alias("n_files"), F.count("file2").alias("n_paired"))
    per = table(spark, d, "read_matches").groupBy("run_label").agg(F.count(F.lit(1)).alias("n_rows"))
    return batch.join(per, F.col("prefix") == F.col("run_label"), "left").select("prefix", "n_files", "n_paired", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def src8_accessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "db_info").filter(F.col("file").isNotNull())
    return rows.select("file", text.file_accession(F.regexp_replace("file", "GX", "GC")).alias("accession"), text.stem(F.col("file")).alias("stem"))


FUNCTIONS = (
    seq1_encode, seq2_kmers, seq3_canonical, seq3_hashes, seq4_minimizers, agg1_target_sizes, agg19_bins, mth7_target_rates, agg18_true_rates, mth10_layouts, mth10_best,
    mth10_modes, mth10_fixed, mth5_functions, mth11_bin_map, flt1_min_length, flt3_skipped, agg5_discarded, snk7_sta,
    joi1_counts, flt4_rel_cutoff, flt5_rel_filter, flt6_fpr_query, joi3_databases, flt7_hierarchy, joi6_mates, snk4_unclassified, snk7_stats, win4_best,
    res1_unique, res2_lca, res3_skip, agg5_counters, res4_em_round, res4_em, res5_one, src4_batches, src8_accessions,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_DNA = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{ALPHABET}', '{BASES}')"


def _kmers(name: str, source: str, keep: str, k: int = K, seq: str = "seq") -> str:
    """A relation of `keep` and kmer, the canonical k-mers of source."""
    return f"""{name} AS (SELECT {keep}, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS kmer FROM (
    SELECT {keep}, substr(s, i, {k}) AS m FROM (SELECT {keep}, {seq} AS s, unnest(range(1, length({seq}) - {k} + 2)) AS i FROM {source} WHERE length({seq}) >= {k})))"""


_BASE = f"""WITH reads AS (SELECT item_id AS read, item_id % 3 AS prefix, {_DNA} AS seq FROM eval_items WHERE text IS NOT NULL),
refs AS (SELECT doc_id AS file, 'd' || doc_id AS target, doc_id % 2 AS db, coalesce(source, '?') AS src, {_DNA} AS seq FROM documents WHERE text IS NOT NULL)"""
_INDEX = _BASE + ", " + _kmers("ref_k", "refs", "file, target, db, src") + ", ix AS (SELECT DISTINCT kmer, target, db FROM ref_k), sizes AS (SELECT target, count(*) AS n_hashes FROM (SELECT DISTINCT file, target, kmer FROM ref_k) GROUP BY target)"
_COUNTS = (
    _INDEX
    + ", "
    + _kmers("read_k", "reads", "read, prefix")
    + ", n AS (SELECT read, count(*) AS n_hashes FROM read_k GROUP BY read), counts AS (SELECT r.read, x.target, n.n_hashes, count(*) AS kmer_count FROM read_k r JOIN ix x USING (kmer) JOIN n ON n.read = r.read GROUP BY 1, 2, 3)"
)
_CUT = _COUNTS + f", cut AS (SELECT * FROM counts WHERE kmer_count >= greatest(1, ceil(n_hashes * {CUTOFF})))"
_MATCH = (
    _CUT
    + f", m AS (SELECT read, target, n_hashes, kmer_count FROM (SELECT *, max(kmer_count) OVER (PARTITION BY read) AS hi, min(kmer_count) OVER (PARTITION BY read) AS lo FROM cut) WHERE kmer_count >= hi - ceil((hi - lo) * {FILTER}))"
)
_RES = (
    _MATCH
    + """, docs AS (SELECT 'd' || doc_id AS target, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source FROM documents),
res AS (SELECT read, CASE WHEN count(*) = 1 THEN min(m.target)
  WHEN count(DISTINCT lang || '/' || source) = 1 THEN 'l' || min(lang || '/' || source)
  WHEN count(DISTINCT lang) = 1 THEN 'l' || min(lang) ELSE '1' END AS target, max(kmer_count) AS kmer_count,
  CASE WHEN count(*) = 1 THEN 'unique' ELSE 'lca' END AS kind FROM m JOIN docs USING (target) GROUP BY read)"""
)
_EM = """WITH m AS (SELECT run_label, readid, target, max(kcount) AS k FROM read_matches WHERE readid IS NOT NULL AND target IS NOT NULL AND kcount IS NOT NULL GROUP BY ALL),
c AS (SELECT run_label, readid, count(*) AS n FROM m GROUP BY ALL),
u AS (SELECT target, count(*) FILTER (WHERE n = 1) AS u FROM m JOIN c USING (run_label, readid) GROUP BY target),
p0 AS (SELECT target, u, u / greatest(1, (SELECT sum(u) FROM u)) AS p FROM u),
a AS (SELECT target, count(*) AS g FROM (SELECT m.*, row_number() OVER (PARTITION BY run_label, readid ORDER BY p DESC, k DESC, m.target) AS r
  FROM m JOIN c USING (run_label, readid) JOIN p0 ON p0.target = m.target WHERE n > 1) WHERE r = 1 GROUP BY target),
p1 AS (SELECT p0.target, u AS "unique", coalesce(g, 0) AS assigned, (u + coalesce(g, 0)) / (SELECT count(*) FROM c) AS p FROM p0 LEFT JOIN a ON a.target = p0.target)"""
_FP = f"CASE WHEN n_hashes = 0 THEN 0.0 ELSE 1 - pow(1 - pow(1 - exp(-{LAYOUT['functions']} / ({LAYOUT['bits']}.0 / ceil(n_hashes / ceil(n_hashes / {LAYOUT['max_hashes']}.0)))), {LAYOUT['functions']}), ceil(n_hashes / {LAYOUT['max_hashes']}.0)) END"
_NUM = "+".join(f"(strpos('ACGT', substr({{0}}, {i}, 1)) - 1) * {4 ** (5 - i)}" for i in range(1, 6))
_SEED5 = dna.seed(5)
_TOP = "(SELECT max(n_hashes) AS top FROM sizes)"
_BITS = "ceil(cap * (-4.0 / ln(1 - exp(ln({0}) / 4.0))))"
_LAYOUTS = (
    _INDEX
    + f""", cand AS (SELECT top, unnest(range(top, least(100, top) - 1, -least(100, top))) AS cap FROM {_TOP}),
per AS (SELECT cap, any_value(top) AS top, sum(ceil(n_hashes / cap)) AS n_bins, ceil(any_value(top) / cap) AS split FROM cand, sizes GROUP BY cap),
raw AS (SELECT *, {_BITS.format("0.05")} AS raw FROM per),
near AS (SELECT *, least(pow(1 - exp(-4.0 / (raw / ceil(top / split))), 4.0), 0.05) AS fp FROM raw),
lay AS (SELECT cap, n_bins, floor(raw * ({_BITS.format("(1 - exp(ln(1 - fp) / split))")} / {_BITS.format("fp")})) AS bits FROM near),
done AS (SELECT *, bits * ceil(n_bins / 64) * 64 AS size FROM lay)"""
)

_ROUNDS = 10
_EM_ALL = """WITH m AS MATERIALIZED (SELECT run_label, readid, target, max(kcount) AS k FROM read_matches WHERE readid IS NOT NULL AND target IS NOT NULL AND kcount IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT run_label, readid, count(*) AS n FROM m GROUP BY ALL),
u AS (SELECT target, count(*) FILTER (WHERE n = 1) AS u FROM m JOIN c USING (run_label, readid) GROUP BY target),
p0 AS MATERIALIZED (SELECT target, u, 0 AS g, u / greatest(1, (SELECT sum(u) FROM u)) AS p FROM u)""" + "".join(
    f""",
a{i} AS (SELECT target, count(*) AS g FROM (SELECT m.target, row_number() OVER (PARTITION BY m.run_label, m.readid ORDER BY p DESC, k DESC, m.target) AS r
  FROM m JOIN c USING (run_label, readid) JOIN p{i - 1} q ON q.target = m.target WHERE n > 1) WHERE r = 1 GROUP BY target),
p{i} AS MATERIALIZED (SELECT q.target, u, coalesce(a{i}.g, 0) AS g, (u + coalesce(a{i}.g, 0)) / (SELECT count(*) FROM c) AS p FROM p{i - 1} q LEFT JOIN a{i} ON a{i}.target = q.target)"""
    for i in range(1, _ROUNDS + 1)
)
_K, _W = 19, 31
_N = _W - _K + 1
_MINIMIZERS = f"""WITH RECURSIVE refs AS (SELECT 'd' || doc_id AS target, {_DNA} AS seq FROM documents WHERE text IS NOT NULL),
letters AS (SELECT target, i, l, CAST(strpos('ACGT', substr(seq, i + 1, 1)) - 1 AS BIGINT) AS c FROM (SELECT target, seq, length(seq) AS l, unnest(range(0, length(seq))) AS i FROM refs WHERE length(seq) >= {_W})),
rolled AS (SELECT target, i, l, {" + ".join(f"lead(c, {j}) OVER w * {4 ** (_K - 1 - j)}" for j in range(_K))} AS f, {" + ".join(f"(3 - lead(c, {j}) OVER w) * {4 ** j}" for j in range(_K))} AS b
  FROM letters WINDOW w AS (PARTITION BY target ORDER BY i)),
hashed AS (SELECT target, i, l - {_K} AS last, least(xor(f, {dna.seed(_K)}), xor(b, {dna.seed(_K)})) AS h FROM rolled WHERE i <= l - {_K}),
placed AS (SELECT *, 1048575 - min(h * 1048576 + 1048575 - i) OVER (PARTITION BY target ORDER BY i ROWS BETWEEN CURRENT ROW AND {_N - 1} FOLLOWING) % 1048576 AS place,
  coalesce({", ".join(f"CASE WHEN lead(h, {j}) OVER w < h THEN i + {j} END" for j in range(1, _N))}) AS lesser FROM hashed WINDOW w AS (PARTITION BY target ORDER BY i)),
step AS MATERIALIZED (SELECT target, i, h, place, coalesce(lesser, CASE WHEN i + {_N} <= last THEN lead(place) OVER (PARTITION BY target ORDER BY i) END) AS nxt FROM placed),
walk AS (SELECT target, place AS i FROM step WHERE i = 0 UNION ALL SELECT walk.target, step.nxt FROM walk JOIN step ON step.target = walk.target AND step.i = walk.i WHERE step.nxt IS NOT NULL)
SELECT refs.target, count(x.h) AS n_minimizers, count(DISTINCT x.h) AS n_distinct FROM refs LEFT JOIN (SELECT step.target, h FROM walk JOIN step ON step.target = walk.target AND step.i = walk.i) x ON x.target = refs.target GROUP BY refs.target"""
_H2 = f"ceil(cap * ln(0.05) / ln(1 / pow(2.0, {bloom.LN2})))"
_CHOSEN = (
    _INDEX
    + f""", cand AS (SELECT top, unnest(range(top, least(100, top) - 1, -least(100, top))) AS cap FROM {_TOP}),
per AS (SELECT cap, any_value(top) AS top, sum(ceil(n_hashes / cap)) AS n_bins, ceil(any_value(top) / cap) AS split FROM cand, sizes GROUP BY cap),
raw AS (SELECT *, {_H2} AS raw FROM per),
chosen AS (SELECT *, CASE WHEN floor({bloom.LN2} * raw / cap) IN (0) OR floor({bloom.LN2} * raw / cap) > 5 THEN 5.0 ELSE floor({bloom.LN2} * raw / cap) END AS h FROM raw),
near AS (SELECT *, least(pow(1 - exp(-h / (raw / ceil(top / split))), h), 0.05) AS fp FROM chosen)
SELECT cap AS n_hashes, CAST(h AS INTEGER) AS n_functions, round(floor(raw * (ceil(cap * (-h / ln(1 - exp(ln(1 - exp(ln(1 - fp) / split)) / h)))) / ceil(cap * (-h / ln(1 - exp(ln(fp) / h)))))) / 1000, 1) AS kbits FROM near"""
)
_JUDGED = (
    _INDEX
    + ", "
    + _kmers("read_k", "reads", "read, prefix")
    + f""", n AS (SELECT read, count(*) AS n_hashes FROM read_k GROUP BY read), f AS (SELECT target, {_FP} AS f FROM sizes),
c AS (SELECT r.prefix, r.read, x.target, x.db, n.n_hashes, count(*) AS k FROM read_k r JOIN ix x USING (kmer) JOIN n ON n.read = r.read GROUP BY ALL),
e AS (SELECT c.*, f, max(k) OVER w AS hi, min(k) OVER w AS lo FROM c JOIN f USING (target) WHERE k >= greatest(1, ceil(n_hashes * 0.1)) WINDOW w AS (PARTITION BY read, db)),
g AS (SELECT *, CASE WHEN k < hi - ceil((hi - lo) * {FILTER}) THEN 'filter' WHEN k < n_hashes AND 1 - list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n_hashes + 1.0) - lgamma(i + 1.0) - lgamma(n_hashes - i + 1.0) + i * ln(f) + (n_hashes - i) * ln(1 - f)))) > {FPR} THEN 'fpr' ELSE 'kept' END AS verdict FROM e),
j AS (SELECT CASE WHEN db = 0 THEN 'A' ELSE 'B' END AS hierarchy, * FROM g WHERE db = 0 OR read NOT IN (SELECT read FROM g WHERE db = 0 AND verdict = 'kept'))"""
)
_STA_SUMS = ["seq_classified", "seq_unique_matches", "matches", "dis_matches_rel_filter", "dis_matches_fpr_query", "kmers_matched", "kmers_from_classified_seqs"]

ORACLES = {
    "seq4_minimizers": _MINIMIZERS,
    "res4_em": _EM_ALL + f' SELECT target, u AS "unique", g AS assigned, round(p, 9) AS p FROM p{_ROUNDS}',
    "mth10_modes": _LAYOUTS
    + ", s AS (SELECT cap, n_bins, size / min(size) OVER () AS a, n_bins / min(n_bins) OVER () AS b FROM done WHERE size > 0), modes(mode, dev, fs, fb) AS (VALUES "
    + ", ".join(f"('{m}', {x}, {y}, {z})" for m, (x, y, z) in bloom.MODES.items())
    + ") SELECT mode, cap AS n_hashes, CAST(n_bins AS BIGINT) AS n_bins FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY round((1 + dev * dev) * (a * b) / (fs * a + fb * b), 12), cap DESC) AS r FROM s, modes) WHERE r = 1",
    "mth10_fixed": _LAYOUTS
    + f", x AS (SELECT *, floor({FIXED_BITS}.0 / (ceil(n_bins / 64) * 64)) AS bits FROM per) SELECT cap AS n_hashes, CAST(n_bins AS BIGINT) AS n_bins, CAST(bits AS BIGINT) AS bin_bits, round(1 - pow(1 - pow(1 - exp(-4.0 / (bits / cap)), 4.0), split), 9) AS fp FROM x WHERE bits > 0",
    "mth5_functions": _CHOSEN,
    "mth11_bin_map": _INDEX
    + """, b AS (SELECT target, n_hashes, CAST(ceil(n_hashes / 500.0) AS BIGINT) AS bins FROM sizes), e AS (SELECT *, least(CAST(ceil(n_hashes / bins) AS BIGINT), 500) AS each, unnest(range(0, bins)) AS bin FROM b)
SELECT target, bin, bin * each AS "first", least(bin * each + each - 1, n_hashes - 1) AS "last" FROM e WHERE bin * each < n_hashes""",
    "flt1_min_length": _BASE + ", " + _kmers("ref_k", "(SELECT * FROM refs WHERE length(seq) >= 600)", "file, target") + " SELECT target, count(*) AS n_hashes FROM (SELECT DISTINCT file, target, kmer FROM ref_k) GROUP BY target",
    "flt3_skipped": _BASE
    + f", n AS (SELECT read, length(seq) AS l, greatest(length(seq) - {K} + 1, 0) AS n FROM reads) SELECT read, CAST(CASE WHEN n > 200 THEN 0 ELSE n END AS INTEGER) AS n_hashes, CASE WHEN l < {K} THEN 'small' WHEN n > 200 THEN 'big' ELSE '-' END AS skipped FROM n",
    "agg5_discarded": _JUDGED
    + " SELECT hierarchy, prefix, target, count(*) FILTER (WHERE verdict = 'filter') AS dis_matches_rel_filter, count(*) FILTER (WHERE verdict = 'fpr') AS dis_matches_fpr_query FROM j WHERE verdict <> 'kept' GROUP BY ALL",
    "snk7_sta": _JUDGED
    + f""", per AS (SELECT prefix, hierarchy, read, count(*) FILTER (WHERE verdict = 'kept') AS c, count(*) FILTER (WHERE verdict = 'filter') AS f, count(*) FILTER (WHERE verdict = 'fpr') AS q, max(k) AS best, max(n_hashes) AS n FROM j GROUP BY ALL),
lev AS (SELECT prefix, hierarchy, count(*) FILTER (WHERE c > 0) AS seq_classified, count(*) FILTER (WHERE c = 1) AS seq_unique_matches, sum(c) AS matches, sum(f) AS dis_matches_rel_filter, sum(q) AS dis_matches_fpr_query,
  coalesce(sum(best) FILTER (WHERE c > 0), 0) AS kmers_matched, coalesce(sum(n) FILTER (WHERE c > 0), 0) AS kmers_from_classified_seqs FROM per GROUP BY ALL),
proc AS (SELECT prefix, count(*) FILTER (WHERE length(seq) >= {K}) AS seq_processed, coalesce(sum(n.n_hashes), 0) AS kmers FROM reads LEFT JOIN n USING (read) GROUP BY prefix),
grid AS (SELECT proc.prefix, x.hierarchy, seq_processed, kmers, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _STA_SUMS)} FROM proc CROSS JOIN (VALUES ('A'), ('B')) x(hierarchy) LEFT JOIN lev ON lev.prefix = proc.prefix AND lev.hierarchy = x.hierarchy),
tot AS (SELECT prefix, '-total-' AS hierarchy, max(seq_processed) AS seq_processed, max(kmers) AS kmers, {", ".join(f"sum({c}) AS {c}" for c in _STA_SUMS)} FROM grid GROUP BY prefix),
al AS (SELECT * FROM grid UNION ALL SELECT * FROM tot), z AS (SELECT al.*, tot.seq_processed - tot.seq_classified AS un, greatest(al.seq_processed, 1) AS of_ FROM al JOIN tot USING (prefix))
SELECT CAST(prefix AS VARCHAR) AS prefix, hierarchy AS hierarchy_label, seq_processed, CAST(un AS BIGINT) AS seq_unclassified, CAST(seq_classified AS BIGINT) AS seq_classified, round(seq_classified / of_ * 100, 6) AS seq_classified_perc,
CAST(seq_unique_matches AS BIGINT) AS seq_unique_matches, round(seq_unique_matches / of_ * 100, 6) AS seq_unique_matches_perc, CAST(seq_classified - seq_unique_matches AS BIGINT) AS seq_multiple_matches,
round((seq_classified - seq_unique_matches) / of_ * 100, 6) AS seq_multiple_matches_perc, CAST(matches AS BIGINT) AS matches, round(CASE WHEN seq_classified > 0 THEN matches / seq_classified ELSE 0.0 END, 6) AS avg_matches_ref_seq,
CAST(dis_matches_rel_filter AS BIGINT) AS dis_matches_rel_filter, CAST(dis_matches_fpr_query AS BIGINT) AS dis_matches_fpr_query, CAST(kmers AS BIGINT) AS kmers_proccessed, CAST(kmers_matched AS BIGINT) AS kmers_matched,
CAST(kmers_from_classified_seqs AS BIGINT) AS kmers_from_classified_seqs, round(CASE WHEN kmers_from_classified_seqs > 0 THEN kmers_matched / kmers_from_classified_seqs * 100 ELSE 0.0 END, 6) AS kmers_matched_perc FROM z""",
    "seq1_encode": "SELECT doc_id, " + ", ".join(f"length(text) - length(replace(upper(text), '{c}', '')) AS n_{c.lower()}" for c in "CGT") + " FROM documents WHERE text IS NOT NULL",
    "seq2_kmers": _BASE + f", s AS (SELECT target, substr(seq, i, {K}) AS m FROM (SELECT target, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM refs WHERE length(seq) >= {K})) SELECT r.target, count(s.m) AS n_kmers, count(DISTINCT s.m) AS n_distinct FROM refs r LEFT JOIN s ON s.target = r.target GROUP BY r.target",
    "seq3_canonical": _BASE + ", " + _kmers("k", "reads", "read", 5) + " SELECT kmer, count(*) AS n FROM k GROUP BY kmer",
    "seq3_hashes": _BASE + ", " + _kmers("k", "reads", "read", 5) + f", t AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT CAST(least(xor({_NUM.format('kmer')}, {_SEED5}), xor({_NUM.format('reverse(translate(kmer, $$ACGT$$, $$TGCA$$))')}, {_SEED5})) AS BIGINT) AS hash, n FROM t".replace("$$", "'"),
    "agg1_target_sizes": _INDEX + " SELECT src AS target, count(*) AS n_hashes FROM (SELECT DISTINCT file, src, kmer FROM ref_k) GROUP BY src",
    "agg19_bins": _INDEX + " SELECT max(n_hashes) AS max_hashes, CAST(sum(ceil(n_hashes / 500)) AS BIGINT) AS n_bins FROM sizes",
    "mth7_target_rates": _INDEX + f" SELECT target, n_hashes, CAST(ceil(n_hashes / {LAYOUT['max_hashes']}.0) AS BIGINT) AS n_bins, round({_FP}, 9) AS fpr FROM sizes",
    "agg18_true_rates": _INDEX + f" SELECT round(max({_FP}), 9) AS highest, round(avg({_FP}), 9) AS average FROM sizes",
    "mth10_layouts": _LAYOUTS + " SELECT cap AS n_hashes, CAST(n_bins AS BIGINT) AS n_bins, CAST(4 AS INTEGER) AS n_functions, round(bits / 1000, 1) AS kbits FROM done WHERE size > 0",
    "mth10_best": _LAYOUTS + ", s AS (SELECT cap, n_bins, size / min(size) OVER () AS a, n_bins / min(n_bins) OVER () AS b FROM done WHERE size > 0) SELECT cap AS n_hashes, CAST(n_bins AS BIGINT) AS n_bins FROM s ORDER BY round(2 * a * b / (a + b), 12), cap DESC LIMIT 1",
    "joi1_counts": _COUNTS + " SELECT read, target, CAST(n_hashes AS INTEGER) AS n_hashes, kmer_count FROM counts",
    "flt4_rel_cutoff": _CUT + " SELECT read, target, CAST(n_hashes AS INTEGER) AS n_hashes, kmer_count FROM cut",
    "flt5_rel_filter": _MATCH + " SELECT read, target, CAST(n_hashes AS INTEGER) AS n_hashes, kmer_count FROM m",
    "flt6_fpr_query": _COUNTS
    + f""", f AS (SELECT target, {_FP} AS f FROM sizes), c AS (SELECT counts.*, f FROM counts JOIN f USING (target) WHERE kmer_count >= greatest(1, ceil(n_hashes * 0.1))),
q AS (SELECT read, target, kmer_count, CASE WHEN kmer_count >= n_hashes THEN 0 ELSE 1 - list_sum(list_transform(range(0, kmer_count + 1), lambda i: exp(lgamma(n_hashes + 1.0) - lgamma(i + 1.0) - lgamma(n_hashes - i + 1.0) + i * ln(f) + (n_hashes - i) * ln(1 - f)))) END AS q FROM c)
SELECT read, target, kmer_count FROM q WHERE q <= {FPR}""",
    "joi3_databases": _INDEX
    + ", "
    + _kmers("read_k", "reads", "read, prefix")
    + """, n AS (SELECT read, count(*) AS n_hashes FROM read_k GROUP BY read), y AS (SELECT DISTINCT kmer, 't' || substr(target, 6, 3) AS target, db FROM ix),
c AS (SELECT r.read, y.target, y.db, n.n_hashes, count(*) AS k FROM read_k r JOIN y USING (kmer) JOIN n ON n.read = r.read GROUP BY 1, 2, 3, 4),
d AS (SELECT * FROM c WHERE k >= greatest(1, ceil(n_hashes * 0.2))),
e AS (SELECT *, max(k) OVER (PARTITION BY read, target ORDER BY db ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
g AS (SELECT read, target, n_hashes, max(k) AS kmer_count, min(k) AS lo FROM e WHERE before IS NULL OR k > before GROUP BY 1, 2, 3)
SELECT read, target, CAST(n_hashes AS INTEGER) AS n_hashes, kmer_count, min(lo) OVER (PARTITION BY read) AS low FROM g""",
    "flt7_hierarchy": _INDEX
    + ", "
    + _kmers("read_k", "reads", "read, prefix")
    + f""", n AS (SELECT read, count(*) AS n_hashes FROM read_k GROUP BY read),
c AS (SELECT r.read, x.target, x.db, n.n_hashes, count(*) AS k FROM read_k r JOIN ix x USING (kmer) JOIN n ON n.read = r.read GROUP BY 1, 2, 3, 4),
d AS (SELECT * FROM c WHERE k >= greatest(1, ceil(n_hashes * {CUTOFF}))),
e AS (SELECT *, max(k) OVER (PARTITION BY read, db) AS hi, min(k) OVER (PARTITION BY read, db) AS lo FROM d),
g AS (SELECT * FROM e WHERE k >= hi - ceil((hi - lo) * {FILTER}))
SELECT CASE WHEN db = 0 THEN 'A' ELSE 'B' END AS hierarchy, read, target, k AS kmer_count FROM g WHERE db = 0 OR NOT EXISTS (SELECT 1 FROM g h WHERE h.db = 0 AND h.read = g.read)""",
    "joi6_mates": _INDEX
    + ", two AS (SELECT read, unnest([substr(seq, 1, length(seq) // 2), substr(seq, length(seq) // 2 + 1)]) AS s, length(seq) // 2 AS l FROM reads), "
    + _kmers("read_k", "(SELECT * FROM two WHERE l >= 11)", "read", seq="s")
    + ", n AS (SELECT read, count(*) AS n_hashes FROM read_k GROUP BY read) SELECT r.read, x.target, CAST(n.n_hashes AS INTEGER) AS n_hashes, count(*) AS kmer_count FROM read_k r JOIN ix x USING (kmer) JOIN n ON n.read = r.read GROUP BY 1, 2, 3",
    "snk4_unclassified": _MATCH + " SELECT read FROM reads WHERE read NOT IN (SELECT read FROM m)",
    "snk7_stats": _MATCH
    + """, per AS (SELECT read, count(*) AS c FROM m GROUP BY read), x AS (SELECT r.prefix, r.read, per.c, coalesce(n.n_hashes, 0) AS h, length(r.seq) < 11 AS small FROM reads r LEFT JOIN per USING (read) LEFT JOIN n USING (read)),
g AS (SELECT prefix, grouping(prefix) AS a, count(*) AS reads, count(c) AS classified, count(*) FILTER (WHERE c IS NULL AND NOT small) AS unclassified, count(*) FILTER (WHERE small) AS skipped_small, 0 AS skipped_big, sum(h) AS hashes, coalesce(sum(c), 0) AS matches, count(*) FILTER (WHERE c = 1) AS unique_reads FROM x GROUP BY ROLLUP (prefix))
SELECT CASE WHEN a = 1 THEN '-total-' ELSE CAST(prefix AS VARCHAR) END AS prefix, reads, classified, unclassified, skipped_small, CAST(skipped_big AS BIGINT) AS skipped_big, CAST(hashes AS BIGINT) AS hashes, CAST(matches AS BIGINT) AS matches, unique_reads,
round(classified * 100.0 / reads, 6) AS classified_pct, CASE WHEN classified > 0 THEN round(CAST(matches AS DOUBLE) / classified, 6) ELSE 0.0 END AS matches_avg FROM g""",
    "win4_best": _MATCH + " SELECT read, target, kmer_count FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY kmer_count DESC, target) AS r FROM m) WHERE r = 1",
    "res1_unique": _MATCH + " SELECT read, min(target) AS target, max(kmer_count) AS kmer_count FROM m GROUP BY read HAVING count(*) = 1",
    "res2_lca": _RES + " SELECT * FROM res",
    "res3_skip": _MATCH + " SELECT read, CASE WHEN count(*) = 1 THEN min(target) ELSE '1' END AS target, max(kmer_count) AS kmer_count, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'lca' END AS kind FROM m GROUP BY read",
    "agg5_counters": _RES
    + """, z AS (SELECT prefix, m.target, count(*) AS matches, 0 AS u, 0 AS l FROM m JOIN reads USING (read) GROUP BY 1, 2
UNION ALL SELECT prefix, res.target, 0, count(*) FILTER (WHERE kind = 'unique'), count(*) FILTER (WHERE kind = 'lca') FROM res JOIN reads USING (read) GROUP BY 1, 2)
SELECT prefix, target, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(u) AS BIGINT) AS "unique", CAST(sum(l) AS BIGINT) AS lca FROM z GROUP BY 1, 2""",
    "res4_em_round": _EM + ' SELECT target, "unique", assigned, round(p, 9) AS p FROM p1',
    "res5_one": _EM + " SELECT run_label, readid, target, k AS kmer_count FROM (SELECT m.*, row_number() OVER (PARTITION BY run_label, readid ORDER BY p DESC, k DESC, m.target) AS r FROM m JOIN p1 ON p1.target = m.target) WHERE r = 1",
    "src4_batches": """WITH b AS (SELECT prefix, count(*) AS n_files, count(file2) AS n_paired FROM run_manifest GROUP BY prefix), p AS (SELECT run_label, count(*) AS n FROM read_matches GROUP BY 1)
SELECT b.prefix, n_files, n_paired, coalesce(n, 0) AS n_rows FROM b LEFT JOIN p ON p.run_label = b.prefix""",
    "src8_accessions": r"""SELECT file, CASE WHEN regexp_extract(b, 'GC[AF]_[0-9]+\.[0-9]+') <> '' THEN regexp_extract(b, 'GC[AF]_[0-9]+\.[0-9]+') ELSE b END AS accession, regexp_replace(c, '\.[^.]*$', '') AS stem
FROM (SELECT file, split_part(replace(file, 'GX', 'GC'), '/', -1) AS b, split_part(file, '/', -1) AS c FROM db_info WHERE file IS NOT NULL)""",
}
