"""Bloom filter arithmetic: sizes, false-positive rates and the search for a layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

LN2 = 0.6931471805599453


def ceil_share(n: Column, share: float | Column) -> Column:
    """The least whole number that is `share` of n or more."""
    return F.ceil(n * share)


def bin_bits(n: Column, fp: float | Column) -> Column:
    """Bits for n hashes at a false-positive rate, with the best number of functions."""
    rate = fp if isinstance(fp, Column) else F.lit(float(fp))
    return F.ceil(n * F.log(rate) / F.log(1 / F.pow(F.lit(2.0), F.lit(LN2))))


def bin_bits_with(n: Column, fp: float | Column, functions: int | Column) -> Column:
    """Bits for n hashes at a rate with a given number of functions."""
    rate = fp if isinstance(fp, Column) else F.lit(float(fp))
    h = functions if isinstance(functions, Column) else F.lit(functions)
    h = h.cast("double")
    return F.ceil(n * (-h / F.log(1 - F.exp(F.log(rate) / h))))


def hash_functions(bits: Column, n: Column, most: int = 5) -> Column:
    """int(ln 2 * bits / n); 0 or more than `most` gives `most`."""
    got = F.floor(F.lit(LN2) * (bits / n)).cast("int")
    return F.when((got == 0) | (got > most), F.lit(most)).otherwise(got)


def false_positive(bits: Column, n: Column, functions: Column | int) -> Column:
    """(1 - e^(-h / (bits / n)))^h; 0 for an empty filter."""
    h = functions if isinstance(functions, Column) else F.lit(functions)
    h = h.cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(1 - F.exp(-h / (bits.cast("double") / n)), h))


def split_false_positive(rate: Column, bins: Column) -> Column:
    """Of a target over several bins, any of which may report it: 1 - (1 - fp)^bins."""
    return 1 - F.pow(1 - rate, bins.cast("double"))


def target_rates(targets: DataFrame, max_hashes: int, bits: int, functions: int) -> DataFrame:
    """`target, n_hashes, n_bins, fpr` from `target, n_hashes`: a target's hashes are
    spread evenly over ceil(n / max_hashes) bins. Targets without hashes have rate 0."""
    bins = F.ceil(F.col("n_hashes") / max_hashes)
    each = F.ceil(F.col("n_hashes") / bins)
    rate = false_positive(F.lit(bits), each, functions)
    return targets.withColumn("n_bins", bins).withColumn("fpr", F.when(F.col("n_hashes") == 0, F.lit(0.0)).otherwise(split_false_positive(rate, F.col("n_bins"))))


def correction_rate(max_split: Column, fp: Column, n: Column, functions: Column) -> Column:
    """How much larger bins must be so that a target over several keeps its rate."""
    share = 1 - F.exp(F.log(1 - fp) / max_split.cast("double"))
    return bin_bits_with(n, share, functions) / bin_bits_with(n, fp, functions)


def round_bins(bins: Column) -> Column:
    """The next multiple of 64."""
    return F.ceil(bins / 64) * 64


#: Values of one bucket of the prefix sums.
BUCKET = 1 << 16


def _bins(cand: DataFrame, sized: DataFrame) -> DataFrame:
    """`cap, n_bins`: the sum of ceil(n / cap) over all targets.

    That sum counts, for every multiple j * cap from 0 on, the targets with more hashes
    than it. There are top / cap multiples of a candidate, so about ln(top / step) per
    candidate, and each asks how many targets are at most so large: a prefix sum, taken in
    two levels (bucket of values, value), so that no task meets all of them."""
    marks = cand.select("cap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top") - 1, F.col("cap"))).alias("v"), F.lit(0).cast("bigint").alias("m"))
    rows = marks.unionByName(sized.select(F.lit(None).cast("bigint").alias("cap"), F.col("n").alias("v"), "m")).withColumn("b", F.floor(F.col("v") / BUCKET))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    base = rows.groupBy("b").agg(F.sum("m").alias("m")).select("b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("b").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.sum("m").over(within)).filter(F.col("cap").isNotNull()).join(base, "b")
    total = sized.agg(F.sum("m").alias("n")).select("n").scalar()
    return upto.groupBy("cap").agg(F.sum(total - F.col("base") - F.col("upto")).alias("n_bins"))


def bin_map(targets: DataFrame, max_hashes: int) -> DataFrame:
    """`target, bin, first, last`: the range of a target's hashes (counted from 0) in each
    of its bins, spread evenly. A bin's number is its place within the target; targets
    without hashes have none."""
    bins = F.ceil(F.col("n_hashes") / max_hashes)
    rows = targets.filter("n_hashes > 0").select("target", "n_hashes", F.least(F.ceil(F.col("n_hashes") / bins), F.lit(max_hashes)).alias("each"), F.explode(F.sequence(F.lit(0).cast("bigint"), bins - 1)).alias("bin"))
    first = F.col("bin") * F.col("each")
    return rows.filter(first < F.col("n_hashes")).select("target", "bin", first.alias("first"), F.least(first + F.col("each") - 1, F.col("n_hashes") - 1).alias("last"))


def layouts(targets: DataFrame, fp: float | None = None, total_bits: int | None = None, functions: int = 0, most: int = 5, step: int = 100) -> DataFrame:
    """One candidate row per number of hashes that a bin may hold: `n_hashes, n_bins,
    n_functions, bin_bits, size_bits, fp`. targets: `target, n_hashes`.

    Candidates run from the largest target down in steps of `step`. With `fp` the size
    follows from the rate, with `total_bits` the rate from the size. `functions` 0 lets
    the sizes choose. Tables without hashes give no candidates. The bins of all candidates
    come from prefix sums over the sizes (see `_bins`).
    """
    sized, _ = Scratch(targets.sparkSession, "sizes").cut(targets.filter(F.col("n_hashes") > 0).groupBy(F.col("n_hashes").cast("bigint").alias("n")).agg(F.count(F.lit(1)).alias("m")))
    top = sized.agg(F.max("n").alias("top")).filter(F.col("top") > 0)
    stride = F.least(F.lit(step).cast("bigint"), F.col("top"))
    cand = top.select("top", F.explode(F.sequence(F.col("top"), stride, -stride)).alias("cap"))
    per = cand.join(_bins(cand, sized), "cap")
    cap = F.col("cap")
    per = per.withColumn("bins64", round_bins(F.col("n_bins"))).withColumn("split", F.ceil(F.col("top") / cap))

    def chosen(bits: Column) -> Column:
        return F.lit(functions) if functions else hash_functions(bits, cap, most)

    if fp is None:
        per = per.withColumn("bin_bits", F.floor(F.lit(float(total_bits or 0)) / F.col("bins64")).cast("bigint")).withColumn("n_functions", chosen(F.col("bin_bits")))
        rate = split_false_positive(false_positive(F.col("bin_bits"), cap, F.col("n_functions")), F.col("split"))
    else:
        raw = bin_bits_with(cap, fp, functions) if functions else bin_bits(cap, fp)
        per = per.withColumn("raw", raw).withColumn("n_functions", chosen(F.col("raw")))
        near = F.least(false_positive(F.col("raw"), F.ceil(F.col("top") / F.col("split")), F.col("n_functions")), F.lit(float(fp)))
        per = per.withColumn("bin_bits", F.floor(F.col("raw") * correction_rate(F.col("split"), near, cap, F.col("n_functions"))).cast("bigint"))
        rate = F.lit(float(fp))
    return per.select(cap.alias("n_hashes"), "n_bins", F.col("n_functions").cast("int").alias("n_functions"), "bin_bits", (F.col("bins64") * F.col("bin_bits")).alias("size_bits"), rate.alias("fp")).filter("size_bits > 0")


#: By mode, the deviation and the weights of size and of bins.
MODES = {"avg": (1.0, 1.0, 1.0), "smaller": (0.5, 0.5, 1.0), "smallest": (0.0, 0.0, 1.0), "faster": (0.5, 1.0, 0.5), "fastest": (0.0, 1.0, 0.0)}


def best_layout(candidates: DataFrame, mode: str = "avg", by: str = "size_bits") -> DataFrame:
    """The candidate with the least mean of its size ratio (or, with by="fp", rate ratio)
    and its bin ratio to the least ones, a harmonic mean that `mode` deviates. Of equal
    ones the candidate with the most hashes."""
    dev, of_size, of_bins = MODES[mode]
    low = candidates.agg(F.min(by).alias("s"), F.min("n_bins").alias("b"))
    size = F.col(by) / low.select("s").scalar()
    bins = F.col("n_bins") / low.select("b").scalar()
    score = (1 + dev**2) * (size * bins) / (of_size * size + of_bins * bins)
    return candidates.withColumn("score", F.round(score, 12)).orderBy("score", F.desc("n_hashes")).limit(1)


def tail_probability(count: Column, n: Column, fpr: Column) -> Column:
    """P(X > count) for X binomial in n trials with rate fpr: the chance that a filter
    reports more than `count` of n hashes by itself. Terms follow by recurrence in log
    space, so large n does not underflow."""
    odds = F.log(fpr) - F.log(1 - fpr)
    start = F.struct((n.cast("double") * F.log(1 - fpr)).alias("lt"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), count.cast("long")),
        start,
        lambda a, i: F.struct((a["lt"] + F.log((n.cast("double") - i) / (i + 1)) + odds).alias("lt"), (a["sum"] + F.exp(a["lt"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when((fpr <= 0) | (count >= n), F.lit(0.0)).otherwise(1 - total)
