import random

import pytest
from pyspark.sql import functions as F

from taxaloom.llm import truncation as T

SAID = ["Where is the {}?", "I told you, the {} is locked.", "Give me 20 minutes. The {} is cold.", "Nobody asks about the {} anymore.", "Then the {} called, and that was that."]
THINGS = ["piano", "harbour", "signal", "cellar", "ledger", "letter"]


def text(r, cues):
    out = []
    for i in range(cues):
        out.append(f"{i + 1}\n00:00:{i:02},000 --> 00:00:{i:02},900\n" + r.choice(SAID).format(r.choice(THINGS)))
    return "\n\n".join(out) + r.choice(["", "\n", "\n\n"])


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        t = text(r, r.randint(12, 25))
        if i % 10 == 0:
            t = t.rstrip()
            t = t[: r.randrange(300, len(t) - 2)] + r.choice(["", "...", " \n"])
            while T._finished(t.rstrip(".\n ") + "\n\nx", len(t.rstrip(".\n "))) and t.rstrip(".\n ")[-1] in ".?!":
                t = t.rstrip(".\n ")[:-1]
        rows.append((i, "a" if i % 3 else None, t, 5.0))
    rows += [(1000, "limit", text(r, 40)[:900], 1.0) for _ in range(8)] + [(2001, "a", None, 1.0), (2002, None, "", 1.0), (2003, "a", " \n", 1.0), (2004, "a", "x" * 300_000, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, score double").cache()


def test_held_out_accuracy(docs):
    """Most of the cut texts are found and few others; every document gets one score."""
    got = T.scored(docs).collect()
    assert len(got) == docs.count()
    cut = {x["doc_id"] for x in got if x["score"] >= 0.5 and x["doc_id"] < 400}
    true = set(range(0, 400, 10))
    assert len(cut & true) >= 0.8 * len(true) and len(cut - true) <= 0.02 * 400
    assert all(x["score"] == 0 for x in got if x["doc_id"] in (2001, 2002, 2003))


def test_limits_are_found_per_source(docs):
    got = {x["source"]: x["chars"] for x in T.limits(docs.filter("source = 'limit' OR doc_id % 5 = 0")).collect()}
    assert got["limit"] == 900


def test_rates_and_empty(spark, docs):
    rows = {x["source"]: x for x in T.rates(docs).collect()}
    assert sum(x["n_texts"] for x in rows.values()) == docs.count() and None in rows
    assert T.truncated(docs.limit(0)).count() == 0
    assert T.scored(docs.filter("text IS NULL")).select(F.max("score")).first()[0] == 0


@pytest.mark.parametrize("end", ["", "\n\n", "7\n", "7\n00:00:01,0", "7\n00:00:01,000 --> 00:00:02,000\n", "<i>Hello", "[muffled sho", "…", "\r\n", "&lt;i&gt;x", "♪ la"])
def test_features_of_odd_ends(end):
    base = "1\n00:00:00,000 --> 00:00:01,000\nYes.\n\n"
    assert T.features(base + end)[0].startswith("state=")


def test_limits_below_120_characters_and_habits_of_all_cues(spark):
    rows = [(i, "short", ("ab cd " * 40)[: 80 if i % 2 else 20 + i]) for i in range(40)] + [(99 + i, "blank", " \n" * 9) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [tuple(x) for x in T.limits(df).collect()] == [("short", 80, 80)]
    assert T._habits(["Yes."] * 140 + ["no"] * 60 + ["x"])[0] == "3"
