import random

from taxaloom.llm import topk


def brute(data, n):
    out = []
    for g in {x[0] for x in data}:
        rows = sorted((x for x in data if x[0] == g and None not in x[1:]), key=lambda x: (-x[2], x[1].encode(), x[3]))
        out += [(g, i + 1, k, t, m) for i, (_, t, k, m) in enumerate(rows[:n])]
    return sorted(out, key=repr)


def test_against_brute_force_with_ties_nulls_and_repeats(spark):
    r = random.Random(2)
    data = [(r.choice(["hot"] * 6 + ["a", "b", None, ""]), r.choice(["x", "é", "z", "", None]), r.choice([1, 1, 2, -(2**63), 2**63 - 1, None]), r.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, target string, k long, id long").repartition(5)
    got = sorted((tuple(x) for x in topk.top_n(df, ["g"], "k", ["target", "id"], 3).collect()), key=repr)
    assert got == brute(data, 3)


def test_clashing_names_long_texts_and_empty(spark):
    long = "t" * 200_000
    df = spark.createDataFrame([("g", long, 5, 1, 0), ("g", "a", 5, 2, 0)], "rank string, target string, __heap long, id long, __e int")
    got = [tuple(x) for x in topk.top_n(df, ["rank"], "__heap", ["target", "id"], 1).toDF("g", "n", "k", "t", "i").collect()]
    assert got == [("g", 1, 5, "a", 2)]
    assert topk.top_n(df.limit(0), ["rank"], "__heap", ["id"], 2).count() == 0
