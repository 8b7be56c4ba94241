"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import latest_versions
from ..plans.tables import table
from ..session import spread
from . import bpe, cooccurrence, leakage, topk, truncation

BEST = 3
MIN_TOGETHER, MIN_LIFT = 20, 5


def _best(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "read_matches").select("match_id", "run_label", "readid", "target", "kcount", "loaded_at")
    rows = latest_versions(rows, "match_id", "loaded_at").filter(F.col("readid").isNotNull())
    return topk.top_n(rows, ["run_label", "readid"], "kcount", ["target", "match_id"], BEST)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("match_id")


def p2_best_matches(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    got = cooccurrence.pairs(table(spark, d, "read_matches"), ["run_label", "readid"], "target", MIN_TOGETHER, MIN_LIFT)
    return got.select(F.col("item_a").alias("target_a"), F.col("item_b").alias("target_b"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of targets that share a read, with its counts and its ratio to chance."""
    got = cooccurrence.pairs(table(spark, d, "read_matches"), ["run_label", "readid"], "target")
    return got.select(F.col("item_a").alias("target_a"), F.col("item_b").alias("target_b"), "n_ab", "n_a", "n_b", F.round(cooccurrence.lift(), 6).alias("lift"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", bpe.encode(spark, F.col("text")).alias("ids"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ids per document and whether decoding them gives back the text."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("ids", bpe.encode(spark, F.col("text")))
    back = bpe.decoder(spark)(F.col("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_ids"), (back == F.coalesce("text", F.lit(""))).alias("same_text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return leakage.leaked(docs, table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each leaked item."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("doc_id").alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_best_matches, p3_found, p3_pairs, p6_ids, p6_round_trip, p7_found, p7_items, p8_found, p8_rates)}

_BEST = """
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY loaded_at DESC) AS v FROM read_matches
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_label, readid ORDER BY kcount DESC, target, match_id) AS rank
  FROM latest WHERE v = 1 AND readid IS NOT NULL AND target IS NOT NULL AND kcount IS NOT NULL
)"""

_PAIRS = """
WITH b AS (SELECT DISTINCT run_label, readid, target FROM read_matches WHERE readid IS NOT NULL AND target IS NOT NULL),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT run_label, readid FROM b)),
m AS (SELECT target, count(*) AS c FROM b GROUP BY target),
p AS (SELECT x.target AS target_a, y.target AS target_b, count(*) AS n_ab FROM b x JOIN b y
      ON x.run_label IS NOT DISTINCT FROM y.run_label AND x.readid = y.readid AND x.target < y.target GROUP BY 1, 2),
g AS (SELECT p.*, ma.c AS n_a, mb.c AS n_b, n.n FROM p JOIN m ma ON ma.target = target_a JOIN m mb ON mb.target = target_b CROSS JOIN n)"""

ORACLES = {
    "p2_found": _BEST + " SELECT match_id FROM ranked WHERE rank <= 3",
    "p2_best_matches": _BEST + " SELECT run_label, readid, CAST(rank AS INTEGER) AS rank, kcount, target, match_id FROM ranked WHERE rank <= 3",
    "p3_found": _PAIRS + " SELECT target_a, target_b FROM g WHERE n_ab >= 20 AND n_ab * n >= 5 * n_a * n_b",
    "p3_pairs": _PAIRS + " SELECT target_a, target_b, n_ab, n_a, n_b, round(CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift FROM g",
}
