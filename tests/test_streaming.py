from taxaloom.operators import matching
from taxaloom.streaming import classify


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    refs = spark.createDataFrame([("f", "A", "A" * 20), ("g", "CG", "CG" * 10)], "file string, target string, seq string")
    index, _ = matching.build_index(refs, 5, 5)
    first = spark.createDataFrame([("p", "r1", "A" * 9), ("p", "r2", "CG" * 5)], classify.READS)
    second = spark.createDataFrame([("q", "r3", "CG" * 6), ("q", "r4", "ACACTTGA")], classify.READS)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    first.write.parquet(src)
    stream = classify.read_stream(spark, src, 1)
    for more in (None, second):
        if more is not None:
            more.write.mode("append").parquet(src)
        classify.classify_stream(stream, index, out, str(tmp_path / "cp"), 5, 5).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    want = classify.classify_batch(first.union(second), index, 5, 5, 0.75, 0.1)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()} == {("p", "r1", "A", 5), ("p", "r2", "CG", 6), ("q", "r3", "CG", 8)}
    assert {tuple(x) for x in classify.target_counters(got).collect()} == {("p", "A", 1, 5), ("p", "CG", 1, 6), ("q", "CG", 1, 8)}
