import random

import pytest

from taxaloom.llm import leakage as L

ITEM = "In 1765 the botanist Finmirthu Kazo found forty sealed jars of pollen in the port of Dama, although the parish had forbidden any digging in Naya."
OTHER = "Según los archivos de el valle de Baba, un mapa plegado de las marismas perteneció a Lakaka hasta 1812. Después se abrió un segundo acueducto en la montaña."


def cue(lines, number=1):
    return "\n\n".join(f"{number + i}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},900\n{x}" for i, x in enumerate(lines)) + "\n\n"


def found(spark, docs, items=((1, ITEM), (2, OTHER)), **k):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return {tuple(x) for x in L.leaked(d, q, **k).collect()}


def chunks(words, n=6):
    return [" ".join(words[i : i + n]) for i in range(0, len(words), n)]


def test_forms_of_one_passage(spark):
    w = ITEM.split()
    docs = [
        (1, cue(chunks(w))),
        (2, cue(chunks(ITEM.upper().split()))),
        (3, cue([f"<i>{c}</i>" for c in chunks(w[:18])])),
        (4, cue(["NOVA: " + c for c in chunks(w[:20])])),
        (5, cue([c for x in chunks(w[:20]) for c in (x, "[door slams]")])),
        (6, cue(chunks(ITEM.replace("e", "c", 3).replace("l", "I", 2).replace("o", "0", 2).split()))),
        (7, cue(chunks([x for i, x in enumerate(w) if i not in (5, 14)]))),
        (8, cue(chunks(w[:13]))),
        (9, cue(chunks(w[:15]))),
        (10, cue(chunks([x if i % 5 else "thing" for i, x in enumerate(w)]))),
        (11, cue(chunks(OTHER.encode().decode("latin-1").split(), 4))),
        (12, cue(chunks(OTHER.encode("latin-1").decode("utf-8", "replace").split(), 4))),
        (17, cue(chunks(OTHER.replace("ú", "&#250;").replace("ó", "&amp;oacute;").replace("un ", "&lt;i&gt;un&lt;/i&gt; ").split(), 4))),
        (13, None), (14, ""), (15, "words " * 50_000 + ITEM), (15, ITEM), (16, " ".join(reversed(w))),
    ]
    assert found(spark, docs) == {(i, 1) for i in (1, 2, 3, 4, 5, 6, 7, 9, 15)} | {(11, 2), (12, 2), (17, 2)}


def misread(text, code="latin-1"):
    return "".join(bytes([b]).decode(code, "ignore") or chr(b) for b in text.encode())


def test_misread_notes_and_dashes(spark):
    w = ITEM.split()
    notes = [f"♪ {c} ♪" for c in chunks(w, 4)]
    dashed = [x + "—" if i % 5 == 3 else x for i, x in enumerate(w)]
    docs = [
        (1, cue([misread(c) for c in notes])),
        (2, cue([misread(c, "cp1252") for c in notes])),
        (3, cue([misread(c) for c in chunks(dashed)])),
        (4, cue([misread(misread(c, "cp1252"), "cp1252") for c in chunks(dashed)])),
        (5, cue([misread("“" + c + "…”", "cp1252") for c in chunks(w)])),
    ]
    assert found(spark, docs) == {(i, 1) for i in range(1, 6)}


@pytest.mark.parametrize("text", ["привет, я", "東京、です", "Việt București", "👍 naïve", "“yes” — no…", "Σ λόγος"])
@pytest.mark.parametrize("code", ["latin-1", "cp1252"])
def test_misread_letters_of_any_length_come_back(text, code):
    assert L.plain(misread(text, code)) == text
    assert L.plain(misread(misread(text, code), code)) == text


@pytest.mark.parametrize("text", ["naß—", "É… sim", "« café\xa0»", "CAFÉ”", "é…”", "POKÉ’s", "«À\xa0»", "irmã…”"])
def test_right_letters_before_punctuation_stay(text):
    assert L.plain(text) == text


def test_blocks_of_items_and_empty_tables(spark):
    docs = [(1, ITEM), (2, OTHER)]
    assert found(spark, docs, block_chars=10) == {(1, 1), (2, 2)}
    assert found(spark, docs, items=((1, None), (2, "too short"))) == set()
    assert found(spark, []) == set()


def brute(item, doc, words, per):
    """Edit distance of every item stretch to every document stretch, ends held."""
    for i in range(len(item)):
        for p in range(len(doc)):
            if item[i] != doc[p]:
                continue
            rows = {(0, 0): 0}
            n, m = len(item) - i, len(doc) - p
            cost = [[10**6] * (m + 1) for _ in range(n + 1)]
            cost[1][1] = 0
            for a in range(1, n + 1):
                for b in range(1, m + 1):
                    if (a, b) != (1, 1):
                        same = 0 if item[i + a - 1] == doc[p + b - 1] else 1
                        cost[a][b] = min(cost[a - 1][b - 1] + same, cost[a - 1][b] + 1, cost[a][b - 1] + 1)
                    if a >= words and item[i + a - 1] == doc[p + b - 1] and cost[a - 1][b - 1] * per <= a:
                        return True
            del rows
    return False


@pytest.mark.parametrize("seed", range(3))
def test_join_against_brute_force(seed):
    r = random.Random(seed)
    bag = [f"w{c}" for c in "abdgjkmnprsuvxyz"]
    items = [(i, " ".join(r.choice(bag) for _ in range(r.randint(14, 24)))) for i in range(6)]
    ix = L.Index.of(items, 15, 7)
    ix.order({})
    texts = dict(items)
    for _ in range(60):
        words = texts[r.randrange(6)].split()
        words = words[r.randrange(4) :]
        for _ in range(r.randrange(5)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = [r.choice(bag)] * r.randrange(2)
        doc = [r.choice(bag) for _ in range(5)] + words + [r.choice(bag) for _ in range(5)]
        import numpy as np

        seq = np.array(ix.sequence(" ".join(doc)))
        fold = [L.fold(w) for w in doc]
        want = [i for i in ix.ids if brute([L.fold(w) for w in texts[i].split()], fold, 15, 7)]
        assert sorted(ix.leaks(seq)) == want


PATTERN = "Records from {} state that two iron weights stamped with owls belonged to a {} called {} until {}. The correct answer is that {}."
SIBLINGS = [
    (1, PATTERN.format("the valley of Uu", "cartographer", "Bexalu", 1899, "the eels returned to all three canals")),
    (2, PATTERN.format("a village near Bona", "weaver", "Rhoya", 1776, "the toll was abolished for everyone but millers")),
    (3, PATTERN.format("the port of Dama", "botanist", "Kazo", 1923, "a second aqueduct was cut through chalk")),
]


@pytest.mark.parametrize("block_chars", [L.BLOCK_CHARS, 10])
def test_a_stretch_goes_to_the_item_that_explains_it_best(spark, block_chars):
    docs = [(i * 10, cue(chunks(t.split()))) for i, t in SIBLINGS]
    docs.append((40, cue(chunks(SIBLINGS[0][1].split()) + ["and then he said"] + chunks(SIBLINGS[2][1].split()))))
    docs.append((50, cue(chunks(SIBLINGS[1][1].replace("iron ", "").split()))))
    own = {(10, 1), (20, 2), (30, 3), (40, 1), (40, 3), (50, 2)}
    assert found(spark, docs, SIBLINGS, block_chars=block_chars) == own
    every = found(spark, docs, SIBLINGS, block_chars=block_chars, attribute=False)
    assert every == {(d, i) for d in (10, 20, 30, 40) for i in (1, 2, 3)} | {(50, 2)}
    # a phrase that two items share unchanged is held by both
    shared = [(1, ITEM), (2, ITEM + " Name the place where it was kept.")]
    assert found(spark, [(1, cue(chunks(ITEM.split())))], shared, block_chars=block_chars) == {(1, 1), (1, 2)}


def test_other_words_are_no_damaged_ones(spark):
    item = "if he fails to burn the tall bell before noon she will be ill of hearing it for years"
    other = "it be tails to bum the fall hell before noon she will he ill of hearing if for years"
    habit = (99, " ".join([" ".join(sorted(set((item + " " + other).split()), reverse=True))] * 6))
    assert found(spark, [(1, item), (2, other), habit], [(7, item)]) == {(1, 7)}
    # the same spellings are damage where the corpus does not know them
    assert found(spark, [(1, item), (2, other)], [(7, item)]) == {(1, 7), (2, 7)}
    # an item's word is never another's damaged form
    two = [(7, item), (8, "tails be fall hell bum he " * 4)]
    assert (2, 7) not in found(spark, [(1, item), (2, other)], two)


def test_long_tags_and_sounds(spark):
    w = ITEM.split()
    font = "<font color='#ffffff' face='" + "x" * 400 + "'>"
    noise = "[" + "door slams and somebody shouts from the yard " * 8 + "]"
    docs = [(1, cue([font + c + "</font>" for c in chunks(w)])), (2, cue([c for x in chunks(w) for c in (x, noise)])), (3, cue(["[open", *chunks(w), "closed]"]))]
    assert found(spark, docs) == {(1, 1), (2, 1), (3, 1)}


def test_long_items_and_texts():
    r = random.Random(1)
    words = [f"w{r.randrange(5000)}" for _ in range(20_000)]
    ix = L.Index.of([(1, " ".join(words))], 15, 7)
    ix.order({})
    assert ix.leaks(ix.sequence(" ".join(words[5000:5600] + ["x"] * 50_000))) == [1]
    assert L.attributed([]) == []
