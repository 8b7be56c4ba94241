"""Classification of reads as they arrive.

A read's matches depend on the read and the index alone, so the batch operators hold for a
stream: the join with the (static) index and the count per read are made within each
micro-batch, and only the counters per target are kept, as a running aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching

READS = "prefix string, read string, seq string"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Reads from parquet files that arrive below `path`."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def classify_batch(reads: DataFrame, index: DataFrame, k: int, w: int, cutoff: float, share: float) -> DataFrame:
    """`prefix, read, target, kmer_count` of one batch of reads."""
    key = ["prefix", "read"]
    counts = matching.count_matches(matching.read_hashes(reads, k, w, key), index, key)
    return matching.rel_filter(matching.rel_cutoff(counts, cutoff), share, key).select(*key, "target", "kmer_count")


def classify_stream(reads: DataFrame, index: DataFrame, out: str, checkpoint: str, k: int, w: int, cutoff: float = 0.75, share: float = 0.1) -> StreamingQuery:
    """Writes the matches of each micro-batch to `out/batch=N`. A batch that is run again
    after a failure overwrites its own folder, so every read is written once."""

    def step(batch: DataFrame, number: int) -> None:
        classify_batch(batch, index, k, w, cutoff, share).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def target_counters(matches: DataFrame) -> DataFrame:
    """Running counts per prefix and target of a stream of matches (complete mode)."""
    return matches.groupBy("prefix", "target").agg(F.count(F.lit(1)).alias("matches"), F.max("kmer_count").alias("best"))
