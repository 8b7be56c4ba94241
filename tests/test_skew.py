import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from taxaloom.operators import skew
from taxaloom.operators.versions import latest_versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_heavy_keys_exact_bound_and_nulls(spark):
    data = [("a",)] * 2 + [(None,)] * 3 + [(f"x{i}",) for i in range(95)]
    df = spark.createDataFrame(data, "target string")
    assert rows(skew.heavy_keys(df, ["target"], "0.02").select("key_value", "n_rows", "n_total")) == [("a", 2, 100)]
    assert rows(skew.heavy_keys(df.limit(0), ["target"], "0.02")) == []


def test_heavy_keys_of_two_fields_with_extra_columns(spark):
    df = spark.createDataFrame([("a", "r", 1, 2)] * 9 + [("b", None, 1, 2)], "target string, readid string, n_rows int, key_value int")
    got = rows(skew.heavy_keys(df, ["target", "readid"], 0.5))
    assert got == [("readid", "r", 9, 10), ("target", "a", 9, 10)]


def test_key_states_with_nulls_ties_and_long_keys(spark):
    long = "k" * 100_000
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5), (None, 5), (long, None)], "k string, v long")
    assert rows(skew.key_states(df, "k", "v")) == sorted([("a", 2, 1, 1, 1, 1), (None, 2, 2, 10, 5, 5), (long, 1, 0, None, None, None)], key=repr)


def test_key_distinct_against_brute_force(spark):
    r = random.Random(3)
    data = [(r.choice(["h"] * 8 + ["a", None]), r.choice(["x", "y", None]), r.randrange(4)) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, a string, b int")
    seen = Counter()
    for k, a, b in {(k, a, b) for k, a, b in data}:
        seen[k] += a is not None
    assert dict(rows(skew.key_distinct(df, "k", ["a", "b"]))) == dict(seen)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 3)), max_size=30))
def test_latest_versions(spark, data):
    df = spark.createDataFrame(data, "id long, at int, v int")
    want = [x for x in data if x[0] is None]
    for i in {x[0] for x in data} - {None}:
        want.append(max((x for x in data if x[0] == i), key=lambda x: (x[1] is not None, x[1] or 0, x[2])))
    assert rows(latest_versions(df, "id", "at")) == sorted(want, key=repr)


def test_latest_versions_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "b", 0), (2, 1, None, 5)], "place long, at int, bits string, hit int")
    assert rows(latest_versions(df, "place", "at")) == [(1, 2, "b", 0), (2, 1, None, 5)]
    assert latest_versions(df.limit(0), "place", "at").count() == 0
