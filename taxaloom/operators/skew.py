"""Per-key results over keys of which a handful hold most rows.

Every function here is made of algebraic SQL aggregates (count, sum, min, max). Spark
runs them as a partial and a final hash aggregation: each task folds its rows into a
bounded table of key states, spills states by key when memory is short, and only one
compact state per key and task crosses the network. A key with a third of all rows thus
costs the reducer one row per map task and never one row per record, so no salting and
no per-key task is needed. Distinct counts, which are not algebraic, are first reduced to
one row per (key, value), which spreads a hot key over its values.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(share: float | str | Fraction) -> Fraction:
    """The decimal that was written, not its binary neighbour: 0.02 is 1/50."""
    got = share if isinstance(share, Fraction) else Fraction(str(share))
    if not 0 <= got <= 1:
        raise ValueError(f"a share lies between 0 and 1, not {share}")
    return got


def key_states(df: DataFrame, key: str, value: str | None = None, rows: str = "n_rows") -> DataFrame:
    """One row per value of `key` (null is a key of its own): the row count and, with
    `value`, its non-null count, sum, least and greatest.

    Nulls in `value` are skipped by the aggregates; a key with null values only has count
    0 and null for the rest. An empty table gives no rows. Other columns are not read.
    """
    measures: list[Column] = [F.count(F.lit(1)).alias(rows)]
    if value is not None:
        v = F.col(f"`{value}`")
        measures += [F.count(v).alias("n_values"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("greatest")]
    return df.groupBy(F.col(f"`{key}`").alias(key)).agg(*measures)


def key_distinct(df: DataFrame, key: str, values: list[str], name: str = "n_distinct") -> DataFrame:
    """Exact number of distinct non-null `values` tuples per key.

    Two aggregations: by (key, values), which splits a hot key over many reducers, then
    by key with map-side combining. Keys whose tuples all hold a null count 0.
    """
    cols = [F.col(f"`{v}`") for v in values]
    whole = cols[0].isNotNull()
    for c in cols[1:]:
        whole = whole & c.isNotNull()
    picked = df.select(F.col(f"`{key}`").alias("__k"), whole.alias("__w"), *[F.when(whole, c).alias(f"__v{i}") for i, c in enumerate(cols)])
    return picked.distinct().groupBy("__k").agg(F.sum(F.col("__w").cast("long")).alias(name)).withColumnRenamed("__k", key)


def heavy_keys(df: DataFrame, fields: list[str], share: float | str | Fraction) -> DataFrame:
    """`field_name, key_value, n_rows, n_total`: of each field every non-null value that
    holds at least `share` of all rows, nulls and repeated rows included in the total.

    The comparison is exact (integers). Values are given as strings. Empty input: no rows.
    """
    at_least = ratio(share)
    total = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    parts = [
        key_states(df, f)
        .select(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("key_value"), F.col("n_rows"))
        .filter(F.col("key_value").isNotNull())
        for f in fields
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("n_total", total).filter(F.col("n_rows") * at_least.denominator >= F.col("n_total") * at_least.numerator)
