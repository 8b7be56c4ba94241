"""The N best items of every group by a mergeable, bounded heap.

The aggregate is Spark's `collect_top_k`: its state is a priority queue of at most N
entries, built per task before the shuffle, serialised, and merged by the reducer. A group
of millions of rows therefore costs one state of N entries per task, and no task sorts or
holds a whole group. Entries compare by score, then by the tie columns, ending with a
unique identifier, so the result does not depend on the order or partition of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def bounded_heap(entry: Column, n: int) -> Column:
    """The `n` least entries, in ascending order; null entries are skipped."""
    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", entry, F.lit(n), F.lit(True))


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """`groups..., rank, score, ties...`: per group the first `n` rows by `score`
    descending, then `ties` ascending (strings in byte order). `ties` should end with a
    unique column; rows equal in all of them are interchangeable and keep their number.

    Groups are compared null-safely, so a null group is a group. Rows with a null score
    or a null tie column are left out. `score` is an integer column. Columns that are not
    named are not read. Groups below `n` rows come whole; an empty table gives no rows.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(f"`{score}`")
    keep = s.isNotNull()
    for t in ties:
        keep = keep & F.col(f"`{t}`").isNotNull()
    # ~score reverses the order of all integers without overflow
    entry = F.struct(F.bitwise_not(s.cast("long")).alias("s"), *[F.col(f"`{t}`").alias(f"t{i}") for i, t in enumerate(ties)])
    keys = [F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)]
    heaps = df.filter(keep).groupBy(*keys).agg(bounded_heap(entry, n).alias("__heap"))
    rows = heaps.select(*[F.col(f"__g{i}") for i in range(len(groups))], F.posexplode("__heap").alias("__pos", "__e"))
    return rows.select(
        *[F.col(f"__g{i}").alias(g) for i, g in enumerate(groups)],
        (F.col("__pos") + 1).alias("rank"),
        F.bitwise_not(F.col("__e.s")).alias(score),
        *[F.col(f"__e.t{i}").alias(t) for i, t in enumerate(ties)],
    )
