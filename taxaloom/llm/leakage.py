"""Held-out passages inside a training corpus: a prefix-filtered set join over windows.

Texts become word sequences: markup, cue numbers, time lines, speaker labels and sound
descriptions go, wrong encodings are repaired, case and accents are folded. A passage leaks
if a document holds a stretch of at least `words` consecutive item words, in order,
beginning and ending in a held word, with at most one word in `per_change` changed, dropped
or added.

Two words are equal if they are spelled alike, or if the document's word is a damaged form
of the item's: both fold to one form under the letters that recognition confuses, and the
document's word is neither an item word nor a word of its own. It is one of its own if the
corpus spells it so often that damage can't be the reason (`OWN_COUNT`, `OWN_PER_MILLION`,
`OWN_SHARE`). `be` and `he` are therefore two words, and `thc` is `the`.

The join works on item windows of `words` words, each the set of its shingles (two
neighbouring words, folded, so that the filters lose no damaged one):

- the shingles of all items are ordered by rarity, their document frequency in the whole
  corpus;
- of the `words - 1` shingles of some window of a stretch that may pass, at least `kept`
  are in the document (see `_survivors`), so one of the window's `words - kept` rarest
  shingles, its prefix, must be there. Only prefixes are joined;
- positional and length bound: around a prefix shingle, the stretch of the document that
  a window can cover must hold at least `kept` of the item's shingles;
- what is left is verified exactly, by extending every common run with the fewest changes.

Items that were made after one pattern share phrases, and a document that holds one of them
holds, with a few changes, stretches of the others. A stretch is attributed to the item that
explains it best: it does not count where another item covers it with fewer changes. A pair
remains while one of its stretches does; an unchanged stretch always does.

Items are taken in blocks of bounded size, so the index that is sent to the executors stays
small however many items there are. The corpus is normalised once: its words become 64-bit
codes in a table in the shared folder. With one block only the documents that hold a shingle
of it are kept; with more blocks all are, and every block reads the codes, not the texts.
The table is deleted when the pairs are written.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

WORDS, PER_CHANGE = 15, 7
#: Items of one block: characters of their texts.
BLOCK_CHARS = 4_000_000
#: Distinct words whose codes a worker keeps, and counted spellings before they are sent.
KEPT, COUNTED = 300_000, 500_000
#: A spelling is a word of its own, not a damaged one, if the corpus has it at least so
#: often, so often in a million words, and at least a 20th as often as the commonest
#: spelling that folds to the same form.
OWN_COUNT, OWN_PER_MILLION, OWN_SHARE = 5, 5, 20
#: Document words at either end of a stretch that the item explaining it may leave over.
SLACK = 2

#: Single letters that recognition confuses, each with its stand-in.
CONFUSED = {"e": "c", "i": "l", "1": "l", "0": "o", "b": "h", "8": "h", "f": "t", "q": "g", "5": "s"}
#: Letter groups that recognition confuses, after the single letters.
CONFUSED_GROUPS = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("rl", "n"), ("ll", "h")]

_FOLD = str.maketrans(CONFUSED)
LOST = "�"

_TIME = re.compile(r"^(?:[ \t]*\d+[ \t]*\n)?[^\n]*\d[ \t]*-{1,2}>[^\n]*$", re.M)
_NUMBER = re.compile(r"(?:\A|(?<=\n))\s*\d+[ \t]*(?=\n|\Z)")
_TAG = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_SOUND = re.compile(r"\[(?:(?!\n\s*\n)[^\[\]])*\]|\((?:(?!\n\s*\n)[^()])*\)|\*[^*\n]+\*")  # within a cue
_LABEL = re.compile(r"(?<![^\W_])[^\W\d_a-z][^\Wa-z_]+(?:[ .][^\Wa-z_]+){0,2}:(?=\s)")
_WORD = re.compile(r"[^\W_]+" + f"(?:{LOST}+[^\\W_]*)*|{LOST}+[^\\W_]+(?:{LOST}+[^\\W_]*)*")
_TAIL = "[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_MISREAD = f"(?:[\xc2-\xdf]{_TAIL}|[\xe0-\xef]{_TAIL}{{2}}|[\xf0-\xf4]{_TAIL}{{3}})"
#: UTF-8 characters read as Latin-1 or cp1252: runs of any lead byte, and single ones whose
#: lead is no letter that a word may well end in before a quote or dash (`naß—`, `É…`, `é »`).
_TWICE = re.compile(
    f"{_MISREAD}{{2,}}|[\xc2-\xc5\xce-\xd1\xd7-\xd9]{_TAIL}|\xc6[\xa0\xa1\xaf\xb0]|\xc8[\x98-\x9b˜™š›]"
    f"|[\xe2\xef]{_TAIL}{{2}}|\xe1[\xba\xbb]{_TAIL}|(?<![^\\W\\d_])[\xe1\xe3-\xe7\xea-\xee]{_TAIL}{{2}}|[\xf0-\xf4]{_TAIL}{{3}}"
)
_ONE = re.compile(_MISREAD)
_LEAD = re.compile(f"[\xc2-\xf4]{_TAIL}")


def _once(m: re.Match[str]) -> str:
    raw = b"".join(c.encode("cp1252") if ord(c) > 255 else c.encode("latin-1") for c in m.group())
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return m.group()


def _repaired(m: re.Match[str]) -> str:
    return _ONE.sub(_once, m.group())


def plain(text: str) -> str:
    """The spoken text: without numbering, times, markup, labels and sounds."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for _ in range(3):  # UTF-8 read as a one-byte code, up to three times
        if text.isascii() or not _LEAD.search(text):
            break
        text = _TWICE.sub(_repaired, text)
    for _ in range(2):  # entities, up to twice escaped
        if "&" in text:
            text = html.unescape(text)
    if "->" in text:
        text = _TIME.sub("", text)
    text = _NUMBER.sub("", text)
    if "<" in text or "{" in text:
        text = _TAG.sub("", text)
    text = _SOUND.sub(" ", text)
    if ":" in text:
        text = _LABEL.sub(" ", text)
    return text


def _bare(word: str) -> str:
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def fold(word: str) -> str:
    """One spelling for a lower-case word and its damaged forms."""
    w = _bare(word.replace(LOST, "")).translate(_FOLD)
    for a, b in CONFUSED_GROUPS:
        w = w.replace(a, b)
    return w


def tokens(text: str) -> list[str]:
    """Words in lower case, composed, format characters removed."""
    low = plain(text).lower()
    if not low.isascii():
        low = unicodedata.normalize("NFC", low)
        low = re.sub("[\xad​-‏⁠﻿]", "", low)
    return _WORD.findall(low)


def _hash(text: str, bits: int) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> (64 - bits)


def code(word: str) -> int:
    """A lower-case word in 63 bits: 39 of its folded form, 24 of its spelling. A word that
    has lost letters has no spelling, 0."""
    form = _hash(fold(word), 39) << 24
    return form if LOST in word else form | max(1, _hash("=" + _bare(word), 24))


def codes(text: str, known: dict[str, int]) -> list[int]:
    """The codes of a text's words; `known` is the caller's memory of them."""
    out = []
    for w in tokens(text):
        c = known.get(w)
        if c is None:
            if len(known) >= KEPT:
                known.clear()
            c = known[w] = code(w)
        out.append(c)
    return out


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(values.shape, bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _paired(seq: np.ndarray) -> np.ndarray:
    """Each two neighbouring forms as one number."""
    form = (seq >> 24).astype(np.uint64)
    return (form[:-1] * np.uint64(0x9E3779B97F4A7C15) + form[1:]).view(np.int64)


@lru_cache
def _survivors(words: int, per_change: int) -> int:
    """Shingles of its best window of `words` words that a passing stretch keeps.

    A change destroys two shingles of the stretch, so a stretch of n words loses at most
    2 * (n // per_change). Windows that share no shingle share these losses; the best of
    them has no more than the mean.
    """
    worst = 0
    for n in range(words, words * per_change):
        disjoint = max(1, (n - 1) // (words - 1))
        worst = max(worst, 2 * (n // per_change) // disjoint)
    return max(1, words - 1 - worst)


@lru_cache
def _bounds(words: int, per_change: int, n: int) -> tuple[int, int]:
    """Least length of a common run, and most changes, to look for in an item of n words.

    A passing stretch of which both halves still have `words` words when the changed ones
    at the cut are left out has a passing half. So there is one of at most `longest` words;
    of its changes, one of the runs between them has the least length.
    """
    longest = n if per_change < 2 else min(n, 2 * words * per_change // (per_change - 1) + 2)
    return min(-(-(k - k // per_change) // (k // per_change + 1)) for k in range(words, longest + 1)), longest // per_change


@dataclass
class Index:
    """The words, shingles and windows of one block of items."""

    ids: list[int]
    seqs: list[np.ndarray]
    spelled: np.ndarray  # codes of the items' words, ascending
    forms: np.ndarray  # their folded parts, ascending
    lossy: tuple[np.ndarray, np.ndarray]  # forms without the accented letters, and the codes' forms
    words: int
    per_change: int
    shingles: np.ndarray  # ascending
    own: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # other words of these forms
    postings: dict[int, list[int]] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def of(items: list[tuple[int, str]], words: int, per_change: int) -> Index:
        known: dict[str, int] = {}
        bare: dict[int, int] = {}
        ids, seqs = [], []
        for item, text in items:
            found = tokens(text or "")
            if len(found) < words:
                continue
            for w in found:
                if not w.isascii():  # its accented letters may be lost in a document
                    bare.setdefault(code("".join(c for c in w if c.isascii())) >> 24, code(w) >> 24)
            ids.append(item)
            seqs.append(np.array(codes(text, known), np.int64))
        spelled = np.unique(np.concatenate(seqs)) if seqs else np.empty(0, np.int64)
        forms = np.unique(spelled >> 24)
        lost = sorted((k, v) for k, v in bare.items() if not _within(np.array([k]), forms)[0])
        lossy = np.array([k for k, _ in lost], np.int64), np.array([v for _, v in lost], np.int64)
        pairs = np.unique(np.concatenate([_paired(q) for q in seqs])) if seqs else np.empty(0, np.int64)
        return Index(ids, seqs, spelled, forms, lossy, words, per_change, pairs)

    def sequence(self, text: str) -> np.ndarray:
        """A document's words as codes."""
        return self.mended(np.array(codes(text, self.known), np.int64))

    def mended(self, seq: np.ndarray) -> np.ndarray:
        """Codes in which words without their accented letters stand for the item's."""
        lost, forms = self.lossy
        at = np.flatnonzero((seq & 0xFFFFFF) == 0) if len(lost) else ()
        if len(at):
            place = np.minimum(np.searchsorted(lost, seq[at] >> 24), len(lost) - 1)
            hit = lost[place] == seq[at] >> 24
            seq = seq.copy()
            seq[at[hit]] = forms[place[hit]] << 24
        return seq

    def shingled(self, seq: np.ndarray) -> np.ndarray:
        """The place of each shingle among those of the items, -1 for others."""
        pairs = _paired(seq)
        if not len(self.shingles):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self.shingles, pairs), len(self.shingles) - 1)
        return np.where(self.shingles[at] == pairs, at, -1)

    def matched(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a document's words may equal: a spelling, and for damaged words a form
        (-1 for the others)."""
        form = seq >> 24
        damaged = _within(form, self.forms) & ~_within(seq, self.spelled) & ~_within(seq, self.own)
        return seq, np.where(damaged, form, -1)

    def order(self, frequency: dict[int, int]) -> None:
        """Puts the rarest shingles of every window, by document frequency, into the
        postings (shingle to items)."""
        n = self.words - _survivors(self.words, self.per_change)
        chosen: dict[int, set[int]] = {}
        for k, seq in enumerate(self.seqs):
            own = self.shingled(seq).tolist()
            for at in range(len(own) - self.words + 2):
                window = sorted(range(at, at + self.words - 1), key=lambda q: (frequency.get(own[q], 0), own[q], q))
                for q in window[:n]:
                    chosen.setdefault(own[q], set()).add(k)
        self.postings = {s: sorted(ks) for s, ks in chosen.items()}
        self.prefix = np.zeros(len(self.shingles) + 1, bool)  # the last is for -1
        self.prefix[list(self.postings)] = True
        self.members: dict[int, np.ndarray] = {}

    def _members(self, k: int) -> np.ndarray:
        got = self.members.get(k)
        if got is None:
            got = self.members[k] = np.unique(self.shingled(self.seqs[k]))
        return got

    def leaks(self, seq: np.ndarray, held: np.ndarray | None = None) -> list[int]:
        """Items of which the document holds a stretch, however it is explained."""
        return list(dict.fromkeys(k for k, *_ in self.stretches(seq, held)))

    def stretches(self, seq: np.ndarray, held: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
        """`item, changes, from, to` of the stretches that the document holds; from and to
        are its words. held: its shingles, if known."""
        held = self.shingled(seq) if held is None else held
        at = np.flatnonzero(self.prefix[held])
        near: dict[int, list[int]] = {}
        for p in at.tolist():
            for k in self.postings[int(held[p])]:
                near.setdefault(k, []).append(p)
        least = _survivors(self.words, self.per_change)
        # a window of the item covers at most its own words and the words added between them
        width = self.words + (self.words * 2) // self.per_change
        out: list[tuple[int, int, int, int]] = []
        spelled = form = None
        for k, places in near.items():
            if len(seq) <= least:
                break
            own = _within(held, self._members(k))
            sums = np.concatenate(([0], np.cumsum(own)))
            p = np.array(places)
            p = p[sums[np.minimum(p + width, len(own))] - sums[np.maximum(p - width, 0)] >= least]
            if len(p):
                if spelled is None:
                    spelled, form = self.matched(seq)
                out += [(self.ids[k], *s) for s in sorted(self._verify(self.seqs[k], spelled, form, p))]
        return out

    def _verify(self, item: np.ndarray, spelled: np.ndarray, form: np.ndarray, places: np.ndarray) -> set[tuple[int, int, int]]:
        reach = len(item) + len(item) // self.per_change + 2
        out: set[tuple[int, int, int]] = set()
        at = 0
        while at < len(places):  # regions of the document, merged where they meet
            lo = max(0, int(places[at]) - reach)
            hi = int(places[at]) + reach
            while at + 1 < len(places) and places[at + 1] - reach <= hi:
                at += 1
                hi = int(places[at]) + reach
            at += 1
            out |= {(c, lo + a, lo + b) for c, a, b in self._held(item, spelled[lo:hi], form[lo:hi])}
        return out

    def _held(self, item: np.ndarray, spelled: np.ndarray, form: np.ndarray) -> set[tuple[int, int, int]]:
        """Per number of changes the widest stretches around every common run."""
        n, m = len(item), len(spelled)
        seed, most = _bounds(self.words, self.per_change, n)
        if m < seed:
            return set()
        own, there = _grams(item, seed), _grams(spelled, seed)
        order = np.argsort(own, kind="stable")
        left, right = np.searchsorted(own[order], there, "left"), np.searchsorted(own[order], there, "right")
        x = list(zip(item.tolist(), (item >> 24).tolist(), strict=True))
        y = list(zip(spelled.tolist(), form.tolist(), strict=True))
        back_x, back_y = x[::-1], y[::-1]
        out = set()
        for p in np.flatnonzero(right > left).tolist():
            for i in order[left[p] : right[p]].tolist():
                if i and p and _same(x[i - 1], y[p - 1]):
                    continue  # a run counts once, at its beginning
                j = i
                while j < n and p + j - i < m and _same(x[j], y[p + j - i]):
                    j += 1
                if j - i < seed:
                    continue
                ahead = _reach(x, y, j, p + j - i, most)
                behind = _reach(back_x, back_y, n - i, m - p, most)
                for a, (item_words, doc_words) in enumerate(behind):
                    for b, (more_item, more_doc) in enumerate(ahead[: most + 1 - a]):
                        length = j - i + item_words + more_item
                        if length >= self.words and length >= self.per_change * (a + b):
                            out.add((a + b, p - doc_words, p + j - i + more_doc))
        return out


def _grams(seq: np.ndarray, n: int) -> np.ndarray:
    """Every n neighbouring forms as one number."""
    form = (seq >> 24).astype(np.uint64)
    size = max(0, len(seq) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + form[i : i + size]
    return out


def _same(item: tuple[int, int], doc: tuple[int, int]) -> bool:
    return item[0] == doc[0] or item[1] == doc[1]


def _reach(x: list[tuple[int, int]], y: list[tuple[int, int]], i0: int, p0: int, most: int) -> list[tuple[int, int]]:
    """By number of changes, how many item words can be passed from (i0, p0) on such that
    the last one is held, and how many document words that takes."""
    n, m = len(x) - i0, len(y) - p0
    far = {0: 0}  # by diagonal, the item words passed
    best = [(0, 0)] * (most + 1)
    top = (0, 0)
    for e in range(1, most + 1):
        nxt: dict[int, int] = {}
        for d, w in far.items():
            for dd, ww in ((d, w + 1), (d - 1, w + 1), (d + 1, w)):  # changed, dropped, added
                if ww <= n and 0 <= ww + dd <= m and nxt.get(dd, -1) < ww:
                    nxt[dd] = ww
        for d, w in nxt.items():
            i, p, end = i0 + w, p0 + w + d, min(n - w, m - w - d)
            k = 0
            while k < end and _same(x[i + k], y[p + k]):
                k += 1
            if k:
                nxt[d] = w + k
                if w + k > top[0]:
                    top = (w + k, w + k + d)
        far = nxt
        best[e] = top
    return best


def attributed(stretches: list[tuple[int, int, int, int]]) -> list[int]:
    """Items with a stretch that no other item explains better: covers, but for at most
    `SLACK` words at either end, with fewer changes."""
    if not stretches:
        return []
    item, changes, lo, hi = np.array(stretches, np.int64).T
    sure = set(item[changes == 0].tolist())
    open_ = np.flatnonzero((changes > 0) & ~np.isin(item, list(sure)))
    for i in open_.tolist():
        if int(item[i]) in sure:
            continue
        better = (item != item[i]) & (changes < changes[i]) & (lo <= lo[i] + SLACK) & (hi >= hi[i] - SLACK)
        if not better.any():
            sure.add(int(item[i]))
    return sorted(sure)


#: kind 0: a document, its place in the table and its words; kind 1: a shingle's place and
#: its number of documents; kind 2: a spelling and its number of words.
_SEQ = "kind int, doc bigint, at bigint, seq array<bigint>"
_NAMES = ["kind", "doc", "at", "seq"]
_STRETCHES = "at bigint, doc_id bigint, item_id bigint, changes int, lo int, hi int"


def _documents(docs: list[int], places: list[int], seqs: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(q) for q in seqs])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(seqs), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(docs), np.int32)), pa.array(docs, pa.int64()), pa.array(places, pa.int64()), lists], _NAMES)


def _counted(kind: int, of: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(of) + 1, np.int32)), pa.array([], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(of), kind, np.int32)), pa.array(n, pa.int64()), pa.array(of, pa.int64()), empty], _NAMES)


class _Counts:
    """Document frequency of the shingles, and how often the items' forms are spelled how."""

    def __init__(self, index: Index):
        self.index = index
        self.frequency = np.zeros(len(index.shingles) + 1, np.int64)  # the last is for -1
        self.spellings: dict[int, int] = {}
        self.total = 0

    def add(self, seq: np.ndarray) -> bool:
        """Counts a document; whether it holds a shingle."""
        known = np.unique(self.index.shingled(seq))
        self.frequency[known] += 1
        return bool(len(known)) and known[-1] >= 0

    def spell(self, seqs: list[np.ndarray]) -> None:
        flat = np.concatenate(seqs)
        self.total += len(flat)
        flat = flat[_within(flat >> 24, self.index.forms) & ((flat & 0xFFFFFF) != 0)]
        for c, n in zip(*(x.tolist() for x in np.unique(flat, return_counts=True)), strict=True):
            self.spellings[c] = self.spellings.get(c, 0) + n

    def send(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if last or len(self.spellings) >= COUNTED:
            of = np.array([TOTAL, *self.spellings], np.int64)
            yield _counted(2, of, np.array([self.total, *self.spellings.values()], np.int64))
            self.spellings, self.total = {}, 0
        if last:
            seen = np.flatnonzero(self.frequency[:-1])
            yield _counted(1, seen, self.frequency[seen])


#: Stands for all words among the spellings.
TOTAL = -1


def _reader(shared):
    """Texts as codes. With an index only the documents that hold a shingle of it are kept,
    and the counts of its shingles and spellings follow."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(shared.value) if shared is not None else None
        known: dict[str, int] = {}
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, places, seqs, every = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seq = np.array(codes(text, known), np.int64)
                place += 1
                if not len(seq):
                    continue
                every.append(seq)
                if counts is not None:
                    seq = counts.index.mended(seq)
                    if not counts.add(seq):
                        continue
                docs.append(doc)
                places.append(place)
                seqs.append(seq)
            if docs:
                yield _documents(docs, places, seqs)
            if counts is not None and every:
                counts.spell(every)
                yield from counts.send()
        if counts is not None:
            yield from counts.send(last=True)

    return read


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    values, offsets = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
    for i, (doc, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        yield doc, at, values[offsets[i] : offsets[i + 1]]


def _counter(shared):
    """The counts of one block of items over kept codes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(shared.value)
        for batch in batches:
            seqs = [seq for _, _, seq in _rows(batch)]
            for seq in seqs:
                counts.add(counts.index.mended(seq))
            if seqs:
                counts.spell(seqs)
                yield from counts.send()
        yield from counts.send(last=True)

    return count


def _joiner(shared):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            out = []
            for doc, at, seq in _rows(batch):
                seq = index.mended(seq)
                held = index.shingled(seq)
                if index.prefix[held].any():
                    out += [(at, doc, *s) for s in index.stretches(seq, held)]
            columns = np.array(out, np.int64).reshape(-1, 6).T
            types = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["at", "doc_id", "item_id", "changes", "lo", "hi"])

    return join


def _attribute(rows: pa.Table) -> pa.Table:
    """The pairs of one document, of all its stretches."""
    columns = [rows.column(c).to_pylist() for c in ("item_id", "changes", "lo", "hi")]
    items = attributed(list(zip(*columns, strict=True)))
    return pa.table({"doc_id": pa.array([rows.column("doc_id")[0].as_py()] * len(items), pa.int64()), "item_id": pa.array(items, pa.int64())})


def _own(spellings: DataFrame) -> DataFrame:
    """Spellings that are words of their own."""
    n = spellings.groupBy("at").agg(F.sum("doc").alias("n"))
    total = n.filter(F.col("at") == TOTAL).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select("n").scalar()
    words = n.filter(F.col("at") != TOTAL).withColumn("form", F.shiftright("at", 24))
    top = words.groupBy("form").agg(F.max("n").alias("top"))
    often = (F.col("n") >= OWN_COUNT) & (F.col("n") * 1_000_000 >= total * OWN_PER_MILLION)
    return words.filter(often).join(top, "form").filter(F.col("n") * OWN_SHARE >= F.col("top")).select("at")


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    per_change: int = PER_CHANGE,
    block_chars: int = BLOCK_CHARS,
    attribute: bool = True,
) -> DataFrame:
    """`doc_id, item_id`: distinct pairs where the document holds a stretch of the item.

    Ids are integers. Null and empty texts hold nothing and items below `words` words
    can't leak. Documents are read whole, whatever their length. Rows with the same id
    are documents of their own, whose pairs come once. Without `attribute` stretches count
    that another item explains better.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{doc_text}`").alias("text"))
    held = items.filter(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{item_text}`"))
    scratch = Scratch(spark, "leakage")
    blocks = _blocks(held, block_chars)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    every = None if following is None else scratch.cut(docs.mapInArrow(_reader(None), _SEQ))[0]
    parts: list[DataFrame] = []
    while block is not None:
        index = Index.of(block, words, per_change)
        block, following = following, next(blocks, None)
        if not index.ids:
            continue
        shared = spark.sparkContext.broadcast(index)
        if every is None:
            kept, _ = scratch.cut(docs.mapInArrow(_reader(shared), _SEQ))
            counts = kept
        else:
            kept = every
            counts, _ = scratch.cut(every.select("doc", "at", "seq").mapInArrow(_counter(shared), _SEQ))
        # at most the block's shingles, and the few common spellings of its words
        n = counts.filter("kind = 1").groupBy("at").agg(F.sum("doc").alias("n")).toArrow()
        index.order(dict(zip(n["at"].to_pylist(), n["n"].to_pylist(), strict=True)))
        index.own = np.unique(_own(counts.filter("kind = 2")).toArrow()["at"].to_numpy())
        ready = spark.sparkContext.broadcast(index)
        found = kept.filter("kind = 0").select("doc", "at", "seq").mapInArrow(_joiner(ready), _STRETCHES)
        # cut, so that of all plans only the stretches remain
        parts.append(scratch.cut(found)[0])
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    found = reduce(DataFrame.unionByName, parts)
    if attribute:
        found = found.groupBy("at").applyInArrow(_attribute, "doc_id bigint, item_id bigint")
    pairs = Scratch(spark, "leaked").cut(found.select("doc_id", "item_id").distinct())[0]
    scratch.drop(scratch.root)
    return pairs
