import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from taxaloom.llm import cooccurrence as C


def brute(data):
    baskets = {}
    for run, read, item, *_ in data:
        if read is not None and item is not None:
            baskets.setdefault((run, read), set()).add(item)
    own, both = {}, {}
    for items in baskets.values():
        for a in items:
            own[a] = own.get(a, 0) + 1
        for a, b in combinations(sorted(items, key=str.encode), 2):
            both[a, b] = both.get((a, b), 0) + 1
    return {(a, b, n, own[a], own[b], len(baskets)) for (a, b), n in both.items()}


@pytest.mark.parametrize("blocks", [None, 1, 3])
def test_against_brute_force(spark, blocks):
    r = random.Random(4)
    names = ["a", "b", "é", "Z", "", "日", None] + [f"i{j}" for j in range(20)]
    data = [(r.choice(["r1", None]), r.choice(["hot"] * 5 + [f"q{i}" for i in range(20)] + [None]), r.choice(names), 1) for _ in range(600)]
    df = spark.createDataFrame(data, "run string, read string, item string, n int").repartition(4)
    got = {tuple(x) for x in C.pairs(df, ["run", "read"], "item", item_blocks=blocks).collect()}
    assert got == brute(data)
    few = {tuple(x) for x in C.pairs(df, ["run", "read"], "item", 3, 2, blocks).collect()}
    assert few == {x for x in brute(data) if x[2] >= 3 and x[2] * x[5] >= 2 * x[3] * x[4]}


def test_wide_baskets_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "PRODUCTS", 1000)
    monkeypatch.setattr(C, "SUMS", 500)
    sums = C._Sums(C._Codes())
    import numpy as np
    import pyarrow as pa

    items = [f"i{j:04}" for j in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array([items, items[:3], ["x"]]), pa.array([1, 1, 1])], ["items", "first"])
    total = {}
    for b in C._diagonal_blocks(iter([batch])):
        for x in b.to_pylist():
            total[x["a"], x["b"]] = total.get((x["a"], x["b"]), 0) + x["n"]
    assert total[None, None] == 3 and total["i0000", "i0002"] == 2 and total["i0001", "i0699"] == 1
    assert len(total) == 1 + 700 + 1 + 700 * 699 // 2
    assert sums.baskets == 0 and np.int64(0) == 0


def test_empty_and_lift(spark):
    df = spark.createDataFrame([], "run string, read string, item string")
    assert C.pairs(df, ["run", "read"], "item").count() == 0
    one = spark.createDataFrame([("r", "q", "a"), ("r", "q", "b"), ("r", "p", "a"), ("r", "p", "a")], "run string, read string, item string")
    got = C.pairs(one, ["run", "read"], "item").withColumn("l", C.lift()).select("n_ab", F.round("l", 3)).first()
    assert tuple(got) == (1, 1.0)
