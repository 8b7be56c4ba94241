import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxaloom.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def split(ids, counts):
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def check(vocabulary, library, texts):
    got = split(*vocabulary.encode(texts))
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [vocabulary.decode(i) for i in got] == texts


def test_odd_texts(vocabulary, library):
    r = random.Random(1)
    parts = list(" '\n\t\rsdtmrevlaZ9.,!-") + ["'s", "'re", "'ll", "'S", "  ", "\xa0", "　", "é", "日本", "٣", "\x1c", "\x85", "😀", "<|endoftext|>", "​", "ſ", "ß", "\x00"]
    check(vocabulary, library, ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=40), max_size=5))
def test_any_text(vocabulary, library, texts):
    check(vocabulary, library, texts)


def test_long_texts_are_cut_at_seams(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    check(vocabulary, library, ["it's  a long\n\n text, isn't it? " * 40, "", "x" * 3000, " " * 500, "a b"])


def test_columns(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (3, "Hello world")], "doc_id long, text string")
    got = df.select("doc_id", bpe.encode(spark, F.col("text")).alias("ids"))
    rows = sorted((x["doc_id"], x["ids"]) for x in got.collect())
    assert rows[0] == (1, [15496, 995]) and rows[1] == (2, []) and [x[1] for x in rows[2:]] in ([[], [15496, 995]], [[15496, 995], []])
    back = {x[0] for x in got.filter("doc_id = 1").select(bpe.decoder(spark)(F.col("ids"))).collect()}
    assert back == {"Hello world"}
    assert df.limit(0).select(bpe.encode(spark, F.col("text")).alias("ids")).count() == 0
