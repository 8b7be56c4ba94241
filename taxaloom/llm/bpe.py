"""Byte-level BPE ids of whole corpora.

Encoding has two parts. Texts are cut into pieces (words with their leading blank,
numbers, punctuation, white space) by array operations over the code points of many texts
at once. Each distinct piece is then merged by its own: its byte symbols form a doubly
linked list, a priority queue holds the mergeable neighbours by rank and place, the best
entry is merged, its new neighbours are queued, and entries whose symbols have changed
since are skipped as stale. Pieces repeat, so their ids are kept per worker and one
merge serves every occurrence; a piece of n bytes takes O(n log n).

Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points cut into pieces at once, and pieces kept per worker.
CHUNK, KEPT, LONGEST_KEPT = 1_000_000, 400_000, 64
#: A vocabulary file may be sent to the executors up to this size.
MOST_BYTES = 64 << 20

#: The code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

BLANK, SPACE, LETTER, NUMBER, OTHER = range(5)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    table[0x20] = BLANK
    return table


def piece_starts(cp: np.ndarray, table: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the concatenated code points `cp` of texts that begin at
    `text_starts` (non-empty texts only).

    A run of one class is a piece, a blank before it belongs to it, the last character of
    a white-space run before other text stands apart from the run, and 's 't 're 've 'm
    'll 'd are pieces where a piece may begin with the apostrophe.
    """
    n = len(cp)
    kind = table[cp]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    begins = first[:-1]
    ends = first[1:]
    white = kind <= SPACE
    before = np.empty(n, np.uint8)
    before[0] = OTHER
    before[1:] = kind[:-1]
    white_before = (before <= SPACE) & ~begins
    next_white = np.empty(n, bool)
    next_white[-1] = True
    next_white[:-1] = white[1:]
    start = begins | np.where(white, ~white_before | (~next_white & ~ends), np.where(white_before, before != BLANK, kind != before))
    # apostrophes that begin a piece, with letters after them in the same text
    at = np.flatnonzero((cp == 39) & start)
    if len(at):
        to = np.append(text_starts[1:], n)[np.searchsorted(text_starts, at, "right") - 1]  # the end of the text
        one = np.where(at + 1 < to, cp[np.minimum(at + 1, n - 1)], 0)
        two = np.where(at + 2 < to, cp[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, length in ((short, 2), (long & ~short, 3)):
            p = at[hit]
            start[p + 1] = False
            after = p + length
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Byte symbols, merges and byte strings of one vocabulary file's content."""

    def __init__(self, content: bytes) -> None:
        model = json.loads(content)["model"]
        #: printable stand-ins of the 256 bytes, as the file writes them
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [b for b in range(256) if b not in kept]
        byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(spare)}
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.byte_id = [0] * 256
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocab[x], vocab[y]), (rank, vocab[x + y]))
        self.kept: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        merges = self.merges
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, x, y, new = heapq.heappop(queue)
            j = right[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = new, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                m = merges.get((new, ids[k]))
                if m:
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            h = left[i]
            if h >= 0:
                m = merges.get((ids[h], new))
                if m:
                    heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def piece(self, piece: bytes) -> list[int]:
        got = self.kept.get(piece)
        if got is None:
            got = self.merge(piece)
            if len(piece) <= LONGEST_KEPT:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[piece] = got
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        counts = np.zeros(len(texts), np.int64)
        parts = []
        for own, group in _chunks(texts):
            ids, n = self._encode(group)
            parts.append(ids)
            np.add.at(counts, own, n)
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), counts

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        data = joined.encode()
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(lengths) - lengths
        starts = piece_starts(cp, classes(), at)
        if len(data) == len(cp):
            offsets = starts
        else:
            width = np.ones(len(cp), np.int64)
            for limit in (0x80, 0x800, 0x10000):
                width += cp >= limit
            offsets = (np.cumsum(width) - width)[starts]
        offsets = np.append(offsets, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        own = [self.piece(p) for p in pieces.dictionary.to_pylist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter((i for ids in own for i in ids), np.int32, int(size.sum()))
        which = pieces.indices.to_numpy()
        n = size[which]
        out = np.cumsum(n) - n
        ids = flat[np.repeat((np.cumsum(size) - size)[which] - out, n) + np.arange(int(n.sum()))]
        first = np.searchsorted(starts, at)
        return ids, np.add.reduceat(n, first) if len(first) else n

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode()


#: Between a character and a blank before a character, pieces always part.
_SEAM = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def _chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of about CHUNK code points: the texts' places and the texts. Longer texts
    are cut at seams, so that their parts give the same ids as the whole."""
    own: list[int] = []
    group: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK:
                seam = _SEAM.search(text, at + CHUNK)
                end = seam.start() if seam else end
            own.append(i)
            group.append(text[at:end] if at or end < len(text) else text)
            size += end - at
            at = end
            if size >= CHUNK:
                yield own, group
                own, group, size = [], [], 0
    if group:
        yield own, group


@lru_cache(4)
def _vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    folder = os.environ.get("TAXALOOM_TOKENIZERS", "/opt/tokenizers")
    return f"{folder}/{name}"


def read_vocabulary(path: str) -> bytes:
    """The file's content, at most MOST_BYTES, compressible and sent once per executor."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encoder(spark: SparkSession, path: str | None = None):
    """A column function from text to `array<int>` of ids, without special tokens, whose
    strings are ordinary text. Null and empty texts give an empty array. Texts of any
    length are encoded whole."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            ids, counts = vocabulary.encode(texts)
            offsets = np.zeros(len(texts) + 1, np.int64)
            np.cumsum(counts, out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, T.ArrayType(T.IntegerType()))


def decoder(spark: SparkSession, path: str | None = None):
    """A column function from ids to text; null gives null. Ids outside the vocabulary
    raise an error."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            yield pa.array([None if ids is None else vocabulary.decode(ids) for ids in batch.to_pylist()], pa.string())

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, T.StringType())


def encode(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    return encoder(spark, path)(text)
