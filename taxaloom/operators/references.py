"""Orphan references from signed change deltas.

A reference and the existence of the key it names are both deltas on one key: +1/-1 on
the reference count, +1/-1 on the existence count. A key whose references are positive
while its existence count is zero is an orphan. `current_orphans` folds deltas into one
state per key; `orphans_by_period` answers the same question as of the moment of every
reference, which takes prefix sums of the existence deltas along time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def existence_deltas(df: DataFrame, key: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """`key, at, exists_delta`: +1 when a record begins to exist, -1 when it ends.

    Without `since` a record exists from the start of time (`at` null). Records with a
    null key, a null `since`, or an end at or before their beginning never exist.
    """
    k = F.col(f"`{key}`")
    if since is None:
        return df.filter(k.isNotNull()).groupBy(k.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("exists_delta")).select("key", F.lit(None).cast("timestamp").alias("at"), "exists_delta")
    b, e = F.col(f"`{since}`"), F.col(f"`{until}`") if until else F.lit(None)
    rows = df.filter(k.isNotNull() & b.isNotNull() & (e.isNull() | (e > b)))
    moves = F.array(F.struct(b.cast("timestamp").alias("at"), F.lit(1).cast("long").alias("d")), F.struct(e.cast("timestamp").alias("at"), F.lit(-1).cast("long").alias("d")))
    return (
        rows.select(k.cast("string").alias("key"), F.explode(moves).alias("m"))
        .select("key", F.col("m.at").alias("at"), F.col("m.d").alias("d"))
        .filter(F.col("at").isNotNull())
        .groupBy("key", "at")
        .agg(F.sum("d").alias("exists_delta"))
    )


def reference_deltas(df: DataFrame, key: str, at: str | None) -> DataFrame:
    """`key, at, ref_delta`: equal references are added up before any shuffle. A null key
    is no reference; a null moment stays null."""
    k = F.col(f"`{key}`")
    t = F.col(f"`{at}`").cast("timestamp") if at else F.lit(None).cast("timestamp")
    return df.filter(k.isNotNull()).groupBy(k.cast("string").alias("key"), t.alias("at")).agg(F.count(F.lit(1)).alias("ref_delta"))


def fold(refs: DataFrame, exists: DataFrame) -> DataFrame:
    """`key, refs, existing`: the state after all deltas, one row per key."""
    both = refs.select("key", F.col("ref_delta").alias("r"), F.lit(0).cast("long").alias("e")).unionByName(
        exists.select("key", F.lit(0).cast("long").alias("r"), F.col("exists_delta").alias("e"))
    )
    return both.groupBy("key").agg(F.sum("r").alias("refs"), F.sum("e").alias("existing"))


def apply_deltas(state: DataFrame, refs: DataFrame, exists: DataFrame) -> DataFrame:
    """The next state (`key, refs, existing`) from the kept one and new deltas. Keys whose
    counts are both zero are forgotten. Equal to folding all deltas from the beginning."""
    both = state.select("key", "refs", "existing").unionByName(fold(refs, exists).select("key", "refs", "existing"))
    return both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing")).filter((F.col("refs") != 0) | (F.col("existing") != 0))


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys of the state that are referred to and do not exist."""
    return state.filter((F.col("refs") > 0) & (F.col("existing") == 0))


#: The slice of moments that are null, before every other slice.
NO_MOMENT = -(2**63)


def orphans_by_period(refs: DataFrame, exists: DataFrame, unit: str = "month", slices: str = "hour") -> DataFrame:
    """`key, bucket, orphan_refs`: per key and time bucket (its beginning, a timestamp) the
    number of references made while no record of the key existed. A record exists from
    its +1 (included) to its -1 (excluded). References without a moment meet no record
    and stand in the null bucket, unless the key exists from the start of time.

    Hot keys are cut three times: equal (key, moment) references are added up map-side, the
    running sums are taken per (key, slice), and what is left is added up by bucket. The
    existence at a slice's beginning comes from a second, coarser running sum over the
    existence deltas of each (key, slice), one row each, and enters the fine one as its
    first row. A task so holds at most one slice of a key's references. Slices must lie
    within buckets. Empty inputs give no rows.
    """
    zero = F.lit(0).cast("long")
    moves = refs.select("key", "at", F.col("ref_delta").alias("r"), zero.alias("e")).unionByName(exists.select("key", "at", zero.alias("r"), F.col("exists_delta").alias("e")))
    moves = moves.withColumn("slice", F.coalesce(F.unix_micros(F.date_trunc(slices, F.col("at"))), F.lit(NO_MOMENT)))
    upto = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        moves.groupBy("key", "slice")
        .agg(F.sum("e").alias("e"))
        .select("key", F.lit(None).cast("timestamp").alias("at"), zero.alias("r"), F.sum("e").over(upto).alias("e"), "slice")
        .filter(F.col("e") != 0)
    )
    here = Window.partitionBy("key", "slice").orderBy(F.col("at").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    return (
        moves.unionByName(base)
        .withColumn("existing", F.sum("e").over(here))
        .filter((F.col("r") > 0) & (F.col("existing") == 0))
        .groupBy("key", F.date_trunc(unit, F.when(F.col("slice") != NO_MOMENT, F.timestamp_micros("slice"))).alias("bucket"))
        .agg(F.sum("r").alias("orphan_refs"))
    )


def period_label(bucket: Column, unit: str = "month") -> Column:
    form = {"month": "yyyy-MM", "year": "yyyy", "day": "yyyy-MM-dd"}[unit]
    return F.date_format(bucket, form)


def orphan_report(sources: list[tuple[str, DataFrame, DataFrame]], unit: str = "month") -> DataFrame:
    """`ref_table, ref_key, period, orphan_refs` over several (name, refs, exists)."""
    parts = [
        orphans_by_period(r, e, unit).select(F.lit(name).alias("ref_table"), F.col("key").alias("ref_key"), period_label(F.col("bucket"), unit).alias("period"), "orphan_refs")
        for name, r, e in sources
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
