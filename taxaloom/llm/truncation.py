"""Texts cut off by field limits or broken transfers.

No label says which texts are cut, so the labels are made. The cues inside a text are
followed by others and therefore finished: a text that is cut after such a cue is intact,
a text that is cut within one is not. A bounded sample of texts is cut at random places of
both kinds, some of the cuts with blanks or an ellipsis behind them and some as if the
place were the source's field width. A logistic regression over hashed features (closing
characters and words, punctuation and markup of the last cue, its place in the cue's
grammar, habits of the whole text, and the distance of the length to the source's limit)
learns to tell them apart and then scores every text, whole.

Field limits come from all texts: per source, a length in characters or in bytes at which
far more texts end than at any other.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, spread
from .leakage import fold

#: Bounds of the fit: texts that are sampled, cuts that are made of each, weights.
SAMPLE_TEXTS, CUTS, BITS = 6_000, 6, 18
#: Tasks that make the examples.
MAKERS = 12
#: A limit is a length that at least this many texts and this share of a source's share.
LIMIT_TEXTS, LIMIT_SHARE = 5, 100
#: Score from which a text counts as cut.
THRESHOLD = 0.5

_BREAK = re.compile(r"\n[ \t]*\n\s*")
_TIME_LINE = re.compile(r"^\s*\d+:\d\d:\d\d[.,]\d{3} ?-{1,2}> ?\d+:\d\d:\d\d[.,]\d{3}(?:[ \t]+\S.*)?\s*$")
_TIME_PART = re.compile(r"^\s*\d{1,3}(?::\d{0,2}){0,2}(?:[.,]\d{0,3})?(?: ?-{0,2}>? ?[\d:.,]*)?\s*$")
_MARK = re.compile(r"\s*(?:\[(?:\.{2,}|…)\]|\((?:\.{2,}|…)\)|\.{2,}|…|‥+|-{2,}|[—–]+|(?:\. ){2,}\.?|~+|>{2,})\s*$")
_OPEN_TAG = re.compile(r"<[^<>]*$|\{[^{}]*$|&[a-z]{0,4}$|&lt;(?:(?!&gt;).)*$", re.S)
_TAGS = re.compile(r"<(/?)([a-zA-Z]+)[^<>]*>|&lt;(/?)([a-zA-Z]+)(?:(?!&gt;).)*?&gt;")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]")
_ENDS = tuple(".?!。？！…♪])")
_STRIP = re.compile(r"<[^<>]*>|\{[^{}]*\}|&lt;.*?&gt;")


def _char(c: str) -> str:
    if c.isdigit():
        return "0"
    if c.isalpha():
        if c < "\x80":
            return "A" if c.isupper() else "a"
        return "J" if c >= "　" else ("U" if c.isupper() else "u")
    return c


def _bucket(x: int, steps: tuple[int, ...]) -> int:
    return sum(x >= s for s in steps)


def _habits(cues: list[str]) -> tuple[str, str, str]:
    """How the finished cues of the text end: punctuated, upper case, blank lines."""
    inner = cues[:-1]
    if not inner:
        return "?", "?", "?"
    ends = [c[-1] for c in inner if c]
    closed = sum(not e.isalnum() for e in ends)
    share = closed * 5 // max(1, len(ends))
    shouted = sum(c.upper() == c for c in inner) * 3 // len(inner)
    return str(share), str(shouted), str(_bucket(len(inner), (2, 5, 20)))


def features(text: str) -> list[str]:
    """What the end of a text looks like, against the rest of it."""
    body = text.replace("\r\n", "\n").replace("\r", "\n")
    trimmed = body.rstrip()
    tail = body[len(trimmed) :]
    blanks = ("n" * min(2, tail.count("\n"))) + ("s" if tail.strip("\n") else "")
    cues = _BREAK.split(trimmed)
    last = cues[-1]
    lines = last.split("\n")
    numbered = sum(bool(re.match(r"\d+$", c.split("\n", 1)[0].strip())) for c in cues[-4:-1]) >= 1
    timed = sum("->" in c for c in cues[-4:-1]) >= 1
    share, shouted, many = _habits(cues)
    while lines and re.match(r"\s*\d+\s*$", lines[0]) and (len(lines) > 1 or numbered):
        lines = lines[1:]
        if not lines:
            break
    state = "text"
    if not lines:
        state = "number"
    elif _TIME_LINE.match(lines[0]):
        lines = lines[1:]
        if not lines:
            state = "time"
    elif len(lines) == 1 and _TIME_PART.match(lines[0]) and timed:
        state = "part" if ":" in lines[0] else "number"
        lines = []
    elif timed:
        state = "untimed"
    out = [f"state={state}", f"state,blanks={state},{blanks}", f"habits={share}", f"bias={many}"]
    if not lines:
        return out
    said = "\n".join(lines)
    mark = _MARK.search(said)
    kept = said[: mark.start()] if mark else said
    kept = kept.rstrip()
    marked = re.sub(r"\s+", "", mark.group())[:4] if mark else ""
    opened = bool(_OPEN_TAG.search(said))
    depth = 0
    for m in _TAGS.finditer(said):
        depth += -1 if m.group(1) or m.group(3) else 1
    pairs = "".join(o for o, c in ("[]", "()", "{}", "«»", "“”", "「」") if said.count(o) > said.count(c))
    pairs += "".join(c for c in "♪#*\"" if said.count(c) % 2)
    bare = _STRIP.sub("", kept).strip()
    words = _WORDS.findall(bare[-160:].lower())
    words = ["0" if w.isdigit() else fold(w) if w[0].isalnum() else w for w in words]  # damaged letters are read as they were
    end = _char(kept[-1]) if kept else "-"
    shape = "".join(_char(c) for c in kept[-3:])
    plain = [w for w in words if w[0].isalnum()]
    first = " ".join(fold(w) for w in _WORDS.findall(bare[:60].lower())[:2])
    since = 0
    for w in reversed(words):
        if w in ".?!。？！…":
            break
        since += 1
    w1, w2, w3 = ([*reversed(words)] + ["", "", ""])[:3]
    p1 = plain[-1] if plain else ""
    token = bare.split()[-1] if bare.split() else ""
    kind = "url" if re.search(r"\w\.\w{2,}", token) else "id" if re.search(r"[a-z]\d|_", token) else "cap" if token[:1].isupper() else "low"
    open_all = f"{int(opened)}{max(-1, min(2, depth))}{pairs}"
    out += [
        f"end={end}",
        f"end,mark={end},{marked}",
        f"shape={shape}",
        f"end,habits={end},{share}",
        f"end,habits,shout={end},{share},{shouted}",
        f"end,blanks={end},{blanks}",
        f"mark,blanks={marked},{blanks}",
        f"open={open_all}",
        f"open,end={open_all},{end}",
        f"raw={kept[-4:].lower()}",
        f"raw6={kept[-6:].lower()}",
        f"w1={w1}",
        f"w1,mark={w1},{marked}",
        f"w2={w2} {w1}",
        f"w3={w3} {w2} {w1}",
        f"w2,mark={w2} {w1},{marked}",
        f"p1,end={p1},{end}",
        f"first={first}",
        f"first,end={first},{end}",
        f"first,kind={first},{kind}",
        f"first,count={first},{min(12, len(plain))}",
        f"first,w1={first},{w1}",
        f"since={min(since, 14)},{end}",
        f"words={_bucket(len(plain), (1, 2, 3, 4, 6, 9, 13))},{end},{share}",
        f"kind,end={kind},{end},{share}",
        f"lines={min(3, len(lines))},{end},{_bucket(len(lines[-1]), (4, 12, 25, 40))}",
    ]
    if end in "aA":
        out.append(f"tail={re.sub(r'[^a-z]', '', p1)[-3:]},{kind}")
    return out


def with_limit(base: list[str], where: str) -> list[str]:
    state = base[0]
    ends = [x for x in base if x.startswith(("end=", "end,habits="))]
    return [f"limit={where}", f"limit,{where},{state}", *[f"limit,{where},{e}" for e in ends]]


def _hash(names: list[str], bits: int) -> list[int]:
    return [zlib.crc32(n.encode()) & ((1 << bits) - 1) for n in names]


def _spoil(text: str, r: random.Random) -> str:
    """What a broken field may have behind its text."""
    return text + r.choice(["", "", "", "", "", "\n", "\n\n", " ", "  \n", "...", "…", " ...", " [...]", "…\n\n", "...\n"])


def _finished(text: str, at: int) -> bool:
    """Whether a cut at `at` leaves the last cue finished: nothing of its line's block is
    lost but blanks, and the block has said something."""
    rest = text[at:]
    gap = re.match(r"[ \t\r]*(\n[ \t\r]*\n|\n?\s*\Z)", rest)
    if gap:
        return True
    return text[:at].endswith(("\n\n", "\r\n\r\n")) and bool(rest)


def cuts(text: str, r: random.Random, n: int = CUTS) -> list[tuple[str, int, bool]]:
    """Examples of one text: (text, 1 if cut within a cue, as if at a field limit)."""
    out = []
    if len(text) < 120:
        return out
    body = text.rstrip()
    breaks = [m.start() for m in re.finditer(r"\r?\n[ \t]*\r?\n", body)]
    breaks = [b for b in breaks if b > 60]
    for _ in range(n):
        at = r.randrange(60, len(body))
        done = _finished(body, at)
        if not done and body[:at].rstrip()[-1:] in _ENDS:
            continue  # a whole sentence within a cue: neither finished nor visibly cut
        atlimit = r.random() < 0.5
        out.append((body[:at] if atlimit else _spoil(body[:at], r), 0 if done else 1, atlimit))
    for _ in range(n + 4):
        if breaks:
            at = r.choice(breaks)
            atlimit = r.random() < 0.005  # by chance only
            whole = body[:at]
            if r.random() < 0.5:  # a finished cue may end in any character
                whole = whole.rstrip(".?!。？！") + r.choice(["...", "…", "—", " —", "-", "--", "", "", ",", "�"])
            out.append((whole + r.choice(["", "", "\n", "\n\n", "\n\n", " "]), 0, atlimit))
    return out


def _examples(bits: int, seed: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = random.Random(seed * 1_000_003 + (doc or 0))
                for cut, label, atlimit in cuts(text, r):
                    base = features(cut)
                    where = "at" if atlimit else r.choice(["far", "far", "far", "close", "none"])
                    marks.append(label)
                    rows.append(_hash(base + with_limit(base, where), bits))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["label", "features"])

    return make


def fit(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS, bits: int = BITS, seed: int = 7, rounds: int = 40) -> np.ndarray:
    """Weights of the hashed features, fitted on a bounded sample.

    The sample is the `sample_texts` texts with the least hash of their id, of those
    below a bound on the hash that leaves about three times as many, so that the one task
    that picks them reads a bounded number. The driver holds at most
    `sample_texts * (2 * CUTS + 4)` rows of about 40 numbers each.
    """
    share = min(1.0, 3 * sample_texts / max(1, documents.count()))
    at = F.xxhash64("doc_id")
    texts = documents.filter((F.length("text") >= 120) & (at <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.length("text") >= 120)).select("doc_id", "text")
    sample = texts.orderBy(at, "doc_id").limit(sample_texts)
    got = sample.repartition(MAKERS, "doc_id").mapInArrow(_examples(bits, seed), "label int, features array<int>").toArrow()
    weights = np.zeros(1 << bits)
    if not got.num_rows:
        return weights
    label = got.column("label").to_numpy().astype(float)
    column = got.column("features").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    flat = column.values.to_numpy()
    offsets = column.offsets.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(label)), np.diff(offsets))
    speed = np.full(1 << bits, 1e-6)
    for _ in range(rounds):  # full-batch adaptive gradient steps with weak decay
        z = np.bincount(row, weights[flat], len(label))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(flat, (p - label)[row], 1 << bits) + 0.3 * weights
        speed += g * g
        weights -= 0.5 * g / np.sqrt(speed)
    return weights


def limits(documents: DataFrame, texts: int = LIMIT_TEXTS, share: int = LIMIT_SHARE) -> DataFrame:
    """`source, chars, bytes`: per source (null is one) the most frequent length of its
    texts that are not blank, of any width, if at least `texts` texts and one in `share` of
    the source have it, in characters and in bytes."""
    lengths = documents.filter(F.col("text").rlike(r"\S")).select("source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"))
    return _limits(lengths, texts, share)


def _limits(lengths: DataFrame, texts: int = LIMIT_TEXTS, share: int = LIMIT_SHARE) -> DataFrame:
    """Both units from one aggregation of the lengths."""
    pairs = lengths.groupBy("source", "n_chars", "n_bytes").agg(F.count(F.lit(1)).alias("c"))
    units = F.array(F.struct(F.lit(True).alias("in_chars"), F.col("n_chars").alias("n")), F.struct(F.lit(False).alias("in_chars"), F.col("n_bytes").alias("n")))
    per = pairs.select("source", F.explode(units).alias("u"), "c").groupBy("source", "u.in_chars", "u.n").agg(F.sum("c").alias("c"))
    best = per.groupBy("source", "in_chars").agg(F.max(F.struct("c", "n")).alias("b"), F.sum("c").alias("all"))
    best = best.filter((F.col("b.c") >= texts) & (F.col("b.c") * share >= F.col("all")))
    return best.groupBy("source").agg(F.max(F.when(F.col("in_chars"), F.col("b.n"))).alias("chars"), F.max(F.when(~F.col("in_chars"), F.col("b.n"))).alias("bytes"))


def scored(documents: DataFrame, **options) -> DataFrame:
    """`doc_id, source, score`: for every document the probability that its text was cut.

    Null, empty and blank texts were not cut and score 0. Texts are read whole. Sources
    and ids may be null. Documents with equal ids are scored apart.
    """
    spark = documents.sparkSession
    bits = options.get("bits", BITS)
    docs = documents.select("doc_id", "source", "text")
    shared = spark.sparkContext.broadcast(fit(docs, **options).astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        where = ["none", "at", "over", "close", "far"]
        for batch in batches:
            plain, by = [], {w: [] for w in where}
            for text in batch.column(2).to_pylist():
                if not text or not text.strip():
                    plain.append(None)
                    for w in where:
                        by[w].append(0.0)
                    continue
                base = features(text)
                plain.append(float(weights[_hash(base, bits)].sum()))
                for w in where:
                    by[w].append(float(weights[_hash(with_limit(base, w), bits)].sum()))
            extra = pa.StructArray.from_arrays([pa.array(by[w], pa.float64()) for w in where], where)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(plain, pa.float64()), extra], ["doc_id", "source", "n_chars", "n_bytes", "plain", "extra"]
            )

    kinds = ", ".join(f"{w}: double" for w in ("none", "at", "over", "close", "far"))
    rows = spread(docs).select("doc_id", "source", "text", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes")).mapInArrow(
        score, f"doc_id bigint, source string, n_chars int, n_bytes int, plain double, extra struct<{kinds}>"
    )
    # scores and lengths are kept, so that the limits need no scan of the texts, and joined
    rows, _ = Scratch(spark, "truncation").cut(rows)
    at = _limits(rows.filter(F.col("plain").isNotNull())).withColumnRenamed("source", "__s")
    rows = rows.join(at, F.col("source").eqNullSafe(F.col("__s")), "left")

    def distance(length: str, limit: str) -> Column:
        d = F.col(limit) - F.col(length)
        return (
            F.when(d.isNull(), F.lit(0))
            .when(d.between(0, 3), 4)
            .when(d.between(-4, -1), 3)
            .when(d.between(4, 40), 2)
            .otherwise(1)
        )

    best = F.greatest(distance("n_chars", "chars"), distance("n_bytes", "bytes"))
    extra = F.col("extra")
    z = F.col("plain") + F.when(best == 4, extra["at"]).when(best == 3, extra["over"]).when(best == 2, extra["close"]).when(best == 1, extra["far"]).otherwise(extra["none"])
    return rows.select("doc_id", "source", F.coalesce(1 / (1 + F.exp(-z)), F.lit(0.0)).alias("score"))


def truncated(documents: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """`doc_id` of the documents whose text was cut."""
    return scored(documents, **options).filter(F.col("score") >= threshold).select("doc_id")


def rates(documents: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """`source, n_texts, n_cut, rate`: how often each source (null is one) truncates."""
    got = scored(documents, **options)
    cut = F.sum((F.col("score") >= threshold).cast("long"))
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), cut.alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n_texts"))
