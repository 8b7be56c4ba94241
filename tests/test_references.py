import random
from datetime import datetime, timedelta

import pytest

from taxaloom.operators import references as R

T0 = datetime(2023, 1, 30)


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_against_brute_force(spark, seed):
    r = random.Random(seed)
    t = lambda: r.choice([None, *[T0 + timedelta(hours=12 * i) for i in range(12)]])
    key = lambda: r.choice(["hot"] * 5 + ["a", "b", "é", "", None])
    refs = [(key(), t(), 1) for _ in range(120)]
    recs = [(key(), t(), t(), 1) for _ in range(25)]
    rd = R.reference_deltas(spark.createDataFrame(refs, "target string, loaded_at timestamp, at int"), "target", "loaded_at")
    ed = R.existence_deltas(spark.createDataFrame(recs, "target string, added_at timestamp, removed_at timestamp, key int"), "target", "added_at", "removed_at")
    want = {}
    for k, at, _ in refs:
        if k is not None and not any(a is not None and at is not None and x == k and a <= at and (b is None or at < b) for x, a, b, _ in recs):
            w = ("t", k, at.strftime("%Y-%m") if at else None)
            want[w] = want.get(w, 0) + 1
    got = {tuple(x)[:3]: x["orphan_refs"] for x in R.orphan_report([("t", rd, ed)]).collect()}
    assert got == want


def test_static_existence_and_current_state(spark):
    refs = R.reference_deltas(spark.createDataFrame([("a", T0), ("a", T0), ("b", T0), ("c", None)], "k string, t timestamp"), "k", "t")
    have = R.existence_deltas(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "k")
    assert {(x["key"], x["orphan_refs"]) for x in R.orphans_by_period(refs, have).collect()} == {("b", 1), ("c", 1)}
    state = R.fold(refs, have)
    assert {(x["key"], x["refs"]) for x in R.current_orphans(state).collect()} == {("b", 1), ("c", 1)}
    more = R.existence_deltas(spark.createDataFrame([("b",)], "k string"), "k")
    nxt = R.apply_deltas(state, refs.limit(0), more)
    assert {x["key"] for x in R.current_orphans(nxt).collect()} == {"c"}
    assert {tuple(x) for x in nxt.collect()} == {("a", 2, 2), ("b", 1, 1), ("c", 1, 0)}


def test_empty_tables(spark):
    refs = R.reference_deltas(spark.createDataFrame([], "k string, t timestamp"), "k", "t")
    have = R.existence_deltas(spark.createDataFrame([], "k string"), "k")
    assert R.orphans_by_period(refs, have).count() == 0 and R.current_orphans(R.fold(refs, have)).count() == 0
