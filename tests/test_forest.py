import random

import pytest

from taxaloom.operators import forest

SCHEMA = "node string, parent string, rank string, path string, depth int"


def brute(edges):
    parent = {}
    for n, p in edges:
        if n is not None:
            old = parent.get(n)
            p = None if p == "0" else p
            parent[n] = p if old is None else old if p is None else min(old, p)
    out = {}
    for n in parent:
        line, x = [n], n
        while parent[x] is not None and parent[x] in parent and parent[x] not in line:
            x = parent[x]
            line.append(x)
        nxt = parent[x]
        if nxt is not None and nxt in parent:
            out[n] = (None, None, None, min(line[line.index(nxt) :]))
        else:
            out[n] = (x, len(line) - 1, line[::-1], None)
    return out


def solve(spark, edges, spacing):
    df = spark.createDataFrame([(a, b, "r", "p", 7) for a, b in edges], SCHEMA)
    f = forest.solve(df, spacing=spacing)
    return f, {r["node"]: (r["root"], r["depth"], r["path"], r["loop_node"]) for r in f.nodes.collect()}


@pytest.mark.parametrize("seed,spacing", [(1, 1), (2, 3), (3, 1000)])
def test_random_forests(spark, seed, spacing):
    r = random.Random(seed)
    edges = []
    for i in range(150):
        kind = r.random()
        p = None if kind < 0.05 else "0" if kind < 0.1 else "gone" if kind < 0.13 else f"n{r.randrange(150)}" if kind < 0.3 else f"n{max(0, i - r.randrange(1, 4))}"
        edges += [(f"n{i}", p)] * r.choice([1, 1, 2])
    edges += [(None, "n1"), ("self", "self"), ("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("tail", "a2"), ("two", "n3"), ("two", "n1")]
    f, got = solve(spark, edges, spacing)
    assert got == brute(edges)
    want = {(a, n, len(p) - 1 - i) for n, (_, _, p, _) in got.items() if p for i, a in enumerate(p)}
    assert {tuple(x) for x in forest.descendants(f).collect()} == want
    assert {tuple(x) for x in forest.looped(f).collect()} == {(n, v[3]) for n, v in got.items() if v[3]}


def test_deep_chain_and_long_loop(spark):
    edges = [("c0", "0")] + [(f"c{i}", f"c{i - 1}") for i in range(1, 300)] + [(f"l{i:03}", f"l{(i + 1) % 200:03}") for i in range(200)]
    _, got = solve(spark, edges, 64)
    assert got["c299"][:2] == ("c0", 299) and len(got["c299"][2]) == 300
    assert {got[f"l{i:03}"][3] for i in range(200)} == {"l000"}


def test_empty(spark):
    _, got = solve(spark, [], 4)
    assert got == {}
