"""Latest version of repeatedly delivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_versions(df: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of `df` of which no other row with the same `key` has a later `version`.

    Null versions are the earliest. Of equal latest versions one row stays: the greatest
    by the remaining columns in order. Rows with a null key are no versions of each
    other and all stay, in an order of their own. All columns must be orderable.

    One mergeable maximum per key: every row is shuffled at most once, versions of a key
    that meet in one task are settled before the shuffle, and a key with a third of all
    rows costs its reducer one row per task. Select the needed columns first.
    """
    names = df.columns
    cols = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    rows = df.toDF(*cols)
    k, v = cols[names.index(key)], cols[names.index(version)]
    order = [v, *[c for c in cols if c not in (k, v)]]
    top = rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.max(F.struct(*order)).alias("top"))
    latest = top.select(*[F.col(c) if c == k else F.col(f"top.{c}") for c in cols])
    if not df.schema[names.index(key)].nullable:
        return latest.toDF(*names)
    return latest.unionByName(rows.filter(F.col(k).isNull())).toDF(*names)
