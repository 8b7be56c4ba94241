"""Items that appear together: a blocked Gram matrix over sparse binary baskets.

With X the binary matrix of baskets by items, the entry (a, b) of X'X is the number of
baskets that hold both items, and its diagonal holds the items' own counts. Baskets become
sparse rows of item codes. Each task sums transpose-products over blocks of its rows and
sends only the entries of the block sum; the sums of all blocks are added by (a, b). Item
rows longer than a block are split over item blocks first, and the products of every two
item blocks of a basket are formed apart, so neither a basket nor a product is ever held
whole where items number in the millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Entries whose products are summed at once, and distinct sums kept before they are sent.
PRODUCTS, SUMS = 4_000_000, 2_000_000
#: Mean items in one block of items.
BLOCK_ITEMS = 1 << 16

GRAM = "a string, b string, n long"


class _Codes:
    """Item texts as integer codes of one task."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.texts: list[str] = []

    def encode(self, flat: pa.Array) -> np.ndarray:
        d = flat.dictionary_encode()
        own = np.empty(len(d.dictionary), np.int64)
        for i, text in enumerate(d.dictionary.to_pylist()):
            c = self.of.get(text)
            if c is None:
                c = self.of[text] = len(self.texts)
                self.texts.append(text)
            own[i] = c
        return own[d.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)


class _Sums:
    """Counts of code pairs: appended, sorted and added up when enough have gathered."""

    def __init__(self, codes: _Codes) -> None:
        self.codes, self.keys, self.counts, self.waiting = codes, [], [], 0
        self.baskets = 0

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(None)
        self.waiting += len(keys)
        if self.waiting >= PRODUCTS:
            self.settle()

    def settle(self) -> None:
        if not self.keys:
            return
        keys = np.concatenate(self.keys)
        ones = [np.ones(len(k), np.int64) if c is None else c for k, c in zip(self.keys, self.counts, strict=True)]
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate(ones)[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts, self.waiting = [keys[first]], [np.add.reduceat(counts, first) if len(first) else counts], 0

    def full(self) -> bool:
        return bool(self.keys) and self.counts[0] is not None and len(self.keys[0]) >= SUMS

    def send(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        names = ["a", "b", "n"]
        if self.baskets:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([self.baskets], pa.int64())], names)
        if self.keys:
            keys, counts = self.keys[0], self.counts[0]
            texts = np.array(self.codes.texts, object)
            rank = np.empty(len(texts), np.int64)
            order = np.argsort(texts, kind="stable")  # code points, which is UTF-8 byte order
            rank[order] = np.arange(len(texts))
            one, two = rank[keys >> 32], rank[keys & 0xFFFFFFFF]
            a, b = np.minimum(one, two), np.maximum(one, two)
            by = np.lexsort((b, a))
            words = pa.array(texts[order], pa.string())
            for at in range(0, len(by), 200_000):
                i = by[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(a[i])), words.take(pa.array(b[i])), pa.array(counts[i])], names)
        self.keys, self.counts, self.waiting, self.baskets = [], [], 0, 0


def _key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.minimum(x, y) << 32) | np.maximum(x, y)


def _inner(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sums: _Sums) -> None:
    """Products of each sparse row with itself, the diagonal included."""
    sums.add(_key(codes, codes))
    for size in np.unique(sizes):
        if size < 2:
            continue
        rows = starts[sizes == size]
        if size <= 512:
            i, j = np.triu_indices(size, 1)
            step = max(1, PRODUCTS // len(i))
            for at in range(0, len(rows), step):
                block = codes[rows[at : at + step, None] + np.arange(size)]
                sums.add(_key(block[:, i].ravel(), block[:, j].ravel()))
        else:
            for s in rows:
                row = codes[s : s + size]
                _outer(row, row, sums, inner=True)


def _outer(x: np.ndarray, y: np.ndarray, sums: _Sums, inner: bool = False) -> None:
    """Products of two sparse rows, in slices; with `inner` only above the diagonal."""
    step = max(1, PRODUCTS // max(1, len(y)))
    for at in range(0, len(x), step):
        i = np.arange(at, min(at + step, len(x)))
        left, right = np.repeat(i, len(y)), np.tile(np.arange(len(y)), len(i))
        if inner:
            keep = right > left
            left, right = left[keep], right[keep]
        sums.add(_key(x[left], y[right]))


def _diagonal_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    sums = _Sums(codes)
    for batch in batches:
        items = batch.column(0)
        flat = codes.encode(items.flatten())
        offsets = items.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = offsets[:-1] - offsets[0]
        sizes = np.diff(offsets)
        sums.baskets += int(np.asarray(batch.column(1)).sum())
        _inner(flat, starts, sizes, sums)
        sums.settle()
        if sums.full():
            yield from sums.send()
            if len(codes.texts) > SUMS:
                codes = _Codes()
                sums = _Sums(codes)
    yield from sums.send()


def _cross_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    sums = _Sums(codes)
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            _outer(codes.encode(x.values), codes.encode(y.values), sums)
        sums.settle()
        if sums.full():
            yield from sums.send()
            if len(codes.texts) > SUMS:
                codes = _Codes()
                sums = _Sums(codes)
    yield from sums.send()


def gram(df: DataFrame, basket: list[str], item: str, item_blocks: int | None = None) -> DataFrame:
    """`a, b, n` with a <= b in byte order: the upper triangle of X'X, diagonal included;
    the row whose a and b are null holds the number of baskets.

    A basket is the set of its distinct items. Rows with a null item, or a null in the
    last basket column (the record's own key), are left out; nulls in the other basket
    columns form baskets like any value. Items are compared as strings. An empty table
    gives no rows. `item_blocks` splits the items by hash; by default it follows from an
    estimate of their number, one block for each 65,536.
    """
    it = F.col(f"`{item}`").cast("string")
    rows = df.filter(it.isNotNull() & F.col(f"`{basket[-1]}`").isNotNull()).select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(basket)], it.alias("__item"))
    keys = [f"__k{i}" for i in range(len(basket))]
    if item_blocks is None:
        item_blocks = max(1, -(-int(rows.agg(F.approx_count_distinct("__item")).first()[0]) // BLOCK_ITEMS))
    if item_blocks == 1:
        sets = rows.groupBy(*keys).agg(F.collect_set("__item").alias("items"))
        parts = sets.select("items", F.lit(1).cast("long").alias("first")).mapInArrow(_diagonal_blocks, GRAM)
    else:
        rows = rows.withColumn("__block", F.pmod(F.xxhash64("__item"), F.lit(item_blocks)).cast("int"))
        sets = rows.groupBy(*keys, "__block").agg(F.collect_set("__item").alias("items"))
        # a basket is counted once, by its lowest block
        lowest = rows.groupBy(*keys).agg(F.min("__block").alias("__low"))
        same = _null_safe(keys)
        low = lowest.select(*[F.col(k).alias(f"{k}_") for k in keys], "__low")
        diagonal = sets.join(low, same).select("items", (F.col("__block") == F.col("__low")).cast("long").alias("first")).mapInArrow(_diagonal_blocks, GRAM)
        other = sets.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("__block").alias("__block_"), F.col("items").alias("items_"))
        cross = sets.join(other, same & (F.col("__block") < F.col("__block_"))).select("items", "items_").mapInArrow(_cross_blocks, GRAM)
        parts = diagonal.unionByName(cross)
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _null_safe(keys: list[str]) -> Column:
    c = F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}_"))
    for k in keys[1:]:
        c = c & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return c


def pairs(df: DataFrame, basket: list[str], item: str, min_count: int = 1, min_lift: int = 0, item_blocks: int | None = None) -> DataFrame:
    """`item_a, item_b, n_ab, n_a, n_b, n_baskets`: every pair a < b that occurs together
    in at least `min_count` baskets and at least `min_lift` times as often as chance would
    give, n_a * n_b / n_baskets. Both bounds are compared exactly."""
    g = gram(df, basket, item, item_blocks)
    # written once, without the pairs that can't count, since it is read four times
    g, _ = Scratch(df.sparkSession, "gram").cut(g.filter(F.col("a").eqNullSafe(F.col("b")) | (F.col("n") >= min_count)))
    off = g.filter(F.col("a") != F.col("b")).select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("n").alias("n_ab"))
    own = g.filter(F.col("a") == F.col("b"))
    n = g.filter(F.col("a").isNull()).agg(F.sum("n").alias("n")).select("n").scalar()
    out = (
        off.join(own.select(F.col("a").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(own.select(F.col("a").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .withColumn("n_baskets", n)
    )
    wide = "decimal(38,0)"  # the products pass 64 bits at scale
    keep = F.col("n_ab").cast(wide) * F.col("n_baskets").cast(wide) >= F.lit(min_lift).cast(wide) * F.col("n_a").cast(wide) * F.col("n_b").cast(wide)
    return out.filter(F.expr("true") if not min_lift else keep).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets")


def lift(n_ab: str = "n_ab", n_a: str = "n_a", n_b: str = "n_b", n: str = "n_baskets") -> Column:
    """How many times as often as chance: n_ab * n / (n_a * n_b)."""
    return F.col(n_ab).cast("double") * F.col(n).cast("double") / (F.col(n_a).cast("double") * F.col(n_b).cast("double"))
