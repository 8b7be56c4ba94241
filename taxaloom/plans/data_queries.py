"""Queries of the general data problems: uneven keys (p1), hierarchies (p4), orphans (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest, references, skew
from .tables import table

HEAVY_SHARE = "0.02"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "read_matches"), ["target", "readid"], HEAVY_SHARE).select("field_name", "key_value")


def p1_target_states(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_states(table(spark, d, "read_matches"), "target", "kcount")


def p1_read_states(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_states(table(spark, d, "read_matches"), "readid", "kcount")


def p1_target_reads(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_distinct(table(spark, d, "read_matches"), "target", ["run_label", "readid"], "n_reads")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.looped(forest.solve(table(spark, d, "tax"), paths=False))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = forest.solve(table(spark, d, "tax")).nodes
    return nodes.select("node", "root", "depth", F.array_join("path", "|").alias("path"), "loop_node")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return forest.descendants(forest.solve(table(spark, d, "tax")))


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (
        references.reference_deltas(table(spark, d, "read_matches"), "target", "loaded_at"),
        references.existence_deltas(table(spark, d, "db_info"), "target", "added_at", "removed_at"),
    )


def _nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (
        references.reference_deltas(table(spark, d, "db_info"), "node", "added_at"),
        references.existence_deltas(table(spark, d, "tax"), "node"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report([("read_matches", *_targets(spark, d)), ("db_info", *_nodes(spark, d))]).select("ref_table", "ref_key", "period")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and keys by table and month."""
    rows = references.orphan_report([("read_matches", *_targets(spark, d)), ("db_info", *_nodes(spark, d))])
    return rows.groupBy("ref_table", "period").agg(F.count("ref_key").alias("n_keys"), F.sum("orphan_refs").alias("n_refs"))


def p5_current(spark: SparkSession, d: str) -> DataFrame:
    """Targets that are referred to and have no valid record after all changes."""
    return references.current_orphans(references.fold(*_targets(spark, d))).select("key", "refs")


QUERIES = {f.__name__: f for f in (p1_found, p1_target_states, p1_read_states, p1_target_reads, p4_found, p4_paths, p4_descendants, p5_found, p5_report, p5_current)}

_STATES = "SELECT {0}, count(*) AS n_rows, count(kcount) AS n_values, CAST(sum(kcount) AS BIGINT) AS total, min(kcount) AS least, max(kcount) AS greatest FROM read_matches GROUP BY {0}"

_ORPHANS = """
WITH refs AS (
  SELECT 'read_matches' AS ref_table, m.target AS ref_key, strftime(m.loaded_at, '%Y-%m') AS period
  FROM read_matches m
  WHERE m.target IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM db_info i WHERE i.target = m.target AND i.added_at <= m.loaded_at
      AND (i.removed_at IS NULL OR m.loaded_at < i.removed_at))
  UNION ALL
  SELECT 'db_info', i.node, strftime(i.added_at, '%Y-%m') FROM db_info i
  WHERE i.node IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tax t WHERE t.node = i.node)
)"""

_CHAINS = """
WITH RECURSIVE one AS (
  SELECT node, min(CASE WHEN parent <> '0' THEN parent END) AS parent FROM tax WHERE node IS NOT NULL GROUP BY node
), edge AS (
  SELECT o.node, p.node AS parent FROM one o LEFT JOIN one p ON o.parent = p.node
), down AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM edge WHERE parent IS NULL
  UNION ALL
  SELECT e.node, d.root, d.depth + 1, d.path || '|' || e.node FROM edge e JOIN down d ON e.parent = d.node
), stuck AS (
  SELECT e.node, e.parent FROM edge e WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.node = e.node)
), walk AS (
  SELECT node AS start, node AS at FROM stuck
  UNION
  SELECT w.start, s.parent FROM walk w JOIN stuck s ON s.node = w.at
), onloop AS (
  SELECT DISTINCT w.start FROM walk w JOIN stuck s ON s.node = w.at WHERE s.parent = w.start
), loops AS (
  SELECT w.start AS node, min(w.at) AS loop_node FROM walk w JOIN onloop l ON l.start = w.at GROUP BY w.start
)"""

ORACLES = {
    "p1_found": """
WITH n AS (SELECT count(*) AS n FROM read_matches)
SELECT 'target' AS field_name, target AS key_value FROM read_matches WHERE target IS NOT NULL
GROUP BY target HAVING count(*) * 50 >= (SELECT n FROM n)
UNION ALL
SELECT 'readid', readid FROM read_matches WHERE readid IS NOT NULL
GROUP BY readid HAVING count(*) * 50 >= (SELECT n FROM n)""",
    "p1_target_states": _STATES.format("target"),
    "p1_read_states": _STATES.format("readid"),
    "p1_target_reads": """
SELECT target, CAST(count(*) FILTER (WHERE run_label IS NOT NULL AND readid IS NOT NULL) AS BIGINT) AS n_reads
FROM (SELECT DISTINCT target, CASE WHEN run_label IS NOT NULL AND readid IS NOT NULL THEN run_label END AS run_label,
      CASE WHEN run_label IS NOT NULL AND readid IS NOT NULL THEN readid END AS readid FROM read_matches) GROUP BY target""",
    "p4_found": _CHAINS + " SELECT node, loop_node FROM loops",
    "p4_paths": _CHAINS
    + """ SELECT node, root, depth, path, CAST(NULL AS VARCHAR) AS loop_node FROM down
UNION ALL SELECT node, NULL, NULL, NULL, loop_node FROM loops""",
    "p4_descendants": """
WITH RECURSIVE one AS (
  SELECT node, min(CASE WHEN parent <> '0' THEN parent END) AS parent FROM tax WHERE node IS NOT NULL GROUP BY node
), edge AS (
  SELECT o.node, p.node AS parent FROM one o LEFT JOIN one p ON o.parent = p.node
), down AS (
  SELECT node, 0 AS depth FROM edge WHERE parent IS NULL
  UNION ALL SELECT e.node, d.depth + 1 FROM edge e JOIN down d ON e.parent = d.node
), up AS (
  SELECT node AS ancestor, node, 0 AS distance FROM down
  UNION ALL
  SELECT e.parent, u.node, u.distance + 1 FROM up u JOIN edge e ON e.node = u.ancestor WHERE e.parent IS NOT NULL
)
SELECT ancestor, node, distance FROM up""",
    "p5_found": _ORPHANS + " SELECT DISTINCT ref_table, ref_key, period FROM refs",
    "p5_report": _ORPHANS + " SELECT ref_table, period, count(DISTINCT ref_key) AS n_keys, count(*) AS n_refs FROM refs GROUP BY ref_table, period",
    "p5_current": """
WITH r AS (SELECT target AS key, count(*) AS refs FROM read_matches WHERE target IS NOT NULL GROUP BY target),
e AS (SELECT target AS key, count(*) FILTER (WHERE removed_at IS NULL) AS n FROM db_info
      WHERE target IS NOT NULL AND added_at IS NOT NULL AND (removed_at IS NULL OR removed_at > added_at) GROUP BY target)
SELECT r.key, r.refs FROM r LEFT JOIN e ON r.key = e.key WHERE coalesce(e.n, 0) = 0""",
}
