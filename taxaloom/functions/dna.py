"""Nucleotide sequences: encoding, k-mers, canonical hashes and minimizers.

Column expressions (`encode`, `kmers`, `canonical`, `kmer_hashes`) stay in the JVM and are
the plain definition. `minimizer_hashes` is the vectorised form over Arrow batches: all
sequences of a batch are hashed at once with array operations, and only the jumps from one
minimizer to the next, a fraction of the positions, are followed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the 64-bit seed, shifted to the bits that a k-mer uses.
SEED = 0x8F3F73B5CF1C9ADE
MOST_K = 31


def seed(k: int) -> int:
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k lies between 1 and {MOST_K}")
    return SEED >> (64 - 2 * k)


def encode(seq: Column) -> Column:
    """Upper case; every letter but A, C, G, T becomes A. Null stays null."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "A")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, although `use` names it in inner lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k, in order; none for shorter texts."""
    empty = F.array().cast("array<string>")
    return _once(seq, lambda s: F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(empty))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement, as text."""
    return F.least(kmer, reverse_complement(kmer))


def _number(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def kmer_hashes(seq: Column, k: int) -> Column:
    """The canonical hash of every k-mer: min(forward ^ seed, reverse complement ^ seed)."""
    s = F.lit(seed(k))
    return F.transform(kmers(encode(seq), k), lambda m: F.least(_number(m).bitwiseXOR(s), _number(reverse_complement(m)).bitwiseXOR(s)))


_CODE = np.zeros(256, np.uint64)
for _c, _v in zip(b"CGTcgt", (1, 2, 3, 1, 2, 3), strict=True):
    _CODE[_c] = _v


def hashes(sequences: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimizer hashes of all sequences, one after the other, and how many each has.

    A window of w letters holds w - k + 1 k-mers. The first window gives its rightmost
    least hash; after it, a hash is given when a strictly smaller one enters the window,
    or when the last one given leaves it (then the rightmost least of the window). With
    w = k every k-mer's hash is given.
    """
    if w < k:
        raise ValueError("a window is at least as long as a k-mer")
    raw = [s.encode("ascii", "replace") for s in sequences]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    code = _CODE[np.frombuffer(b"".join(raw), np.uint8)]
    n = len(code) - k + 1
    counts = np.zeros(len(raw), np.int64)
    if n < 1:
        return np.empty(0, np.int64), counts
    forward = np.zeros(n, np.uint64)
    backward = np.zeros(n, np.uint64)
    two = np.uint64(2)
    for j in range(k):
        part = code[j : j + n]
        forward = (forward << two) | part
        backward |= (np.uint64(3) - part) << np.uint64(2 * j)
    s = np.uint64(seed(k))
    h = np.minimum(forward ^ s, backward ^ s).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    ok = lengths >= w
    width = w - k + 1
    if width == 1:
        counts[ok] = lengths[ok] - k + 1
        keep = np.repeat(starts[ok] - (np.cumsum(counts[ok]) - counts[ok]), counts[ok]) + np.arange(counts[ok].sum())
        return h[keep], counts
    far = np.iinfo(np.int64).max
    padded = np.concatenate((h, np.full(width, far)))
    least, place = padded[:n].copy(), np.arange(n)
    smaller = np.full(n, -1)
    for d in range(1, width):
        other = padded[d : d + n]
        better = other <= least
        least = np.where(better, other, least)
        place = np.where(better, np.arange(n) + d, place)
        smaller = np.where((smaller < 0) & (other < h), np.arange(n) + d, smaller)
    after = np.append(place[1:], n)  # the rightmost least of the window that begins one further
    out: list[int] = []
    lesser, nxt, first = smaller.tolist(), after.tolist(), place.tolist()
    for i in np.flatnonzero(ok).tolist():
        begin = int(starts[i])
        last = begin + int(lengths[i]) - k
        p = first[begin]
        before = len(out)
        while True:
            out.append(p)
            q = lesser[p]
            if 0 <= q <= last:
                p = q
            elif p + width <= last:
                p = nxt[p]
            else:
                break
        counts[i] = len(out) - before
    return h[np.array(out, np.int64)] if out else np.empty(0, np.int64), counts


def minimizer_hashes(k: int, w: int):
    """A column function from a sequence to `array<bigint>` of its minimizer hashes, in
    order and with repeats. Null and short sequences give an empty array."""
    seed(k)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values, counts = hashes([s or "" for s in batch.to_pylist()], k, w)
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(T.LongType()))
