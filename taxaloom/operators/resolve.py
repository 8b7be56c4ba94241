"""Resolution of reads with several matches: unique, LCA, skip and EM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def lca(groups: DataFrame, lineage: DataFrame, key: list[str], node: str = "target", root: str = "1") -> DataFrame:
    """`key..., lca` per group of nodes. Nodes outside the lineage hang below the root.

    Groups of equal nodes are one class, so the tree is met by classes and not by groups: a
    group's class is its number of nodes, the least and the greatest of them and 128 bits
    of their hashes, all algebraic, so a group of any size is combined map-side. Of one
    group of each class every ancestor is counted, and the deepest one that all its nodes
    share wins.

    lineage: `node, path` (root first)."""
    nodes = groups.select(*key, F.col(node).alias("__n")).distinct()
    mark = ["__c", "__a", "__b", "__x", "__y"]
    marks = nodes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__c"), F.min("__n").alias("__a"), F.max("__n").alias("__b"), F.bit_xor(F.xxhash64("__n")).alias("__x"), F.bit_xor(F.xxhash64("__n", F.lit(1))).alias("__y")
    )
    one = marks.groupBy(*mark).agg(F.min(F.struct(*key)).alias("__k"))
    firsts = one.select(*[F.col(f"__k.{k}").alias(k) for k in key], F.col("__c").alias("n"))
    own = lineage.select(F.col("node").alias("__l"), "path")
    rows = nodes.join(firsts, key).join(own, F.col("__n") == F.col("__l"), "left")
    path = F.coalesce("path", F.array(F.lit(root), F.col("__n")))
    each = rows.select(*key, "n", F.posexplode(path).alias("depth", "anc"))
    counts = each.groupBy(*key, "n", "anc", "depth").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == F.col("n"))
    found = counts.groupBy(*key).agg(F.max_by("anc", "depth").alias("lca"))
    named = one.select(*mark, *[F.col(f"__k.{k}").alias(k) for k in key]).join(found, key).select(*mark, "lca")
    same = marks["__c"] == named["__c"]
    for m in mark[1:]:
        same = same & marks[m].eqNullSafe(named[m])
    return marks.join(named, same).select(*[marks[k] for k in key], "lca")


def resolve(matches: DataFrame, key: list[str], how: str, lineage: DataFrame | None = None, root: str = "1") -> DataFrame:
    """`key..., target, kmer_count, kind`: one row per read. A single match is `unique`.
    Several go to their LCA with the highest count (`lca`), or to the root (`skip`)."""
    per = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("kmer_count").alias("kmer_count"), F.min("target").alias("t"))
    if how == "skip":
        return per.select(*key, F.when(F.col("n") == 1, F.col("t")).otherwise(F.lit(root)).alias("target"), "kmer_count", F.when(F.col("n") == 1, "unique").otherwise("lca").alias("kind"))
    if lineage is None:
        raise ValueError("lca needs a lineage")
    many = matches.join(per.filter("n > 1").select(*key), key, "left_semi")
    found = lca(many, lineage, key, "target", root)
    out = per.join(found, key, "left")
    return out.select(*key, F.when(F.col("n") == 1, F.col("t")).otherwise(F.coalesce("lca", F.lit(root))).alias("target"), "kmer_count", F.when(F.col("n") == 1, "unique").otherwise("lca").alias("kind"))


def counters(matches: DataFrame, resolved: DataFrame, by: list[str], discarded: DataFrame | None = None) -> DataFrame:
    """`by..., target, matches, unique, lca`: the rows of a .rep, without empty ones. With
    `discarded` (by by and target) its counts stand beside them."""
    m = matches.groupBy(*by, "target").agg(F.count(F.lit(1)).alias("matches"))
    r = resolved.groupBy(*by, "target").agg(F.sum((F.col("kind") == "unique").cast("long")).alias("unique"), F.sum((F.col("kind") != "unique").cast("long")).alias("lca"))
    zero = F.lit(0).cast("bigint")
    both = m.select(*by, "target", "matches", zero.alias("unique"), zero.alias("lca")).unionByName(r.select(*by, "target", zero.alias("matches"), "unique", "lca"))
    out = both.groupBy(*by, "target").agg(*[F.sum(c).alias(c) for c in ("matches", "unique", "lca")])
    if discarded is None:
        return out
    more = [c for c in discarded.columns if c not in (*by, "target")]
    return out.join(discarded, [*by, "target"], "left").select(*out.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in more])


def classes(matches: DataFrame, key: list[str]) -> DataFrame:
    """`targets, weight`: reads with the same targets in the same order (count descending,
    target) are one class with a weight, so a round costs classes and not reads."""
    entry = F.struct((-F.col("kmer_count")).alias("k"), F.col("target").alias("t"))
    lists = matches.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["t"]).alias("targets"))
    return lists.groupBy("targets").agg(F.count(F.lit(1)).alias("weight"))


def _assigned(many: DataFrame, prob: DataFrame) -> DataFrame:
    """`target, g`: the reads of each class (`cls, weight, pos, target`) go to its most
    probable target; ties to the earliest in its list."""
    rows = many.join(prob.select("target", "p"), "target")
    best = F.max(F.struct("p", (-F.col("pos")).alias("o"), "target", "weight"))
    return rows.groupBy("cls").agg(best.alias("b")).groupBy(F.col("b.target").alias("target")).agg(F.sum("b.weight").alias("g"))


def em(matches: DataFrame, key: list[str], max_iter: int = 10, threshold: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
    """Hard-assignment EM. Returns `target, unique, assigned, p` with the counts of the
    last round and the probabilities after it, `key..., target, kmer_count` (one row per
    read by the final probabilities), and the number of rounds.

    A probability begins as the target's share of unique reads; each round gives every
    read with several matches to its most probable target, and the new probability is
    (unique + assigned) / reads. It ends when the summed change is at most `threshold`
    or after `max_iter` rounds (0: no limit). The counts can differ from the one-row
    relation when a round limit ends it, as the latter uses the newer probabilities.
    """
    scratch = Scratch(matches.sparkSession, "em")
    cls, cls_path = scratch.cut(classes(matches, key).withColumn("cls", F.monotonically_increasing_id()))
    reads = cls.agg(F.sum("weight").alias("n")).first()["n"] or 0
    targets = cls.select(F.explode("targets").alias("target")).distinct()
    unique = cls.filter(F.size("targets") == 1).select(F.col("targets")[0].alias("target"), F.col("weight").alias("unique"))
    prob = targets.join(unique, "target", "left").select("target", F.coalesce("unique", F.lit(0)).alias("unique"))
    total = prob.agg(F.sum("unique").alias("n")).first()["n"] or 1
    prob, path = scratch.cut(prob.select("target", "unique", F.lit(0).cast("bigint").alias("assigned"), (F.col("unique") / F.lit(total)).alias("p")))
    many, many_path = scratch.cut(cls.filter(F.size("targets") > 1).select("cls", "weight", F.posexplode("targets").alias("pos", "target")))
    rounds = 0
    while True:
        got = _assigned(many, prob)
        nxt = prob.join(got, "target", "left").select("target", "unique", F.coalesce("g", F.lit(0)).alias("assigned"), "p", ((F.col("unique") + F.coalesce("g", F.lit(0))) / F.lit(max(1, reads))).alias("q"))
        nxt, new, change = scratch.cut_and_see(nxt, F.sum(F.abs(F.col("p") - F.col("q"))))
        change = change or 0.0
        scratch.drop(path)
        prob, path = nxt.select("target", "unique", "assigned", F.col("q").alias("p")), new
        rounds += 1
        if change <= threshold or (max_iter and rounds >= max_iter):
            break
    scratch.drop(cls_path, many_path)
    order = Window.partitionBy(*key).orderBy(F.desc("p"), F.desc("kmer_count"), "target")
    one = matches.join(prob.select("target", "p"), "target").withColumn("__r", F.row_number().over(order)).filter("__r = 1").select(*key, "target", "kmer_count")
    return prob, one, rounds


def reassign_rep(rep: DataFrame, assigned: DataFrame, by_hierarchy: bool = False) -> DataFrame:
    """Rows of the .rep whose target was assigned, with lca := assigned. assigned:
    `[hierarchy,] target, assigned`."""
    on = ["hierarchy", "target"] if by_hierarchy else ["target"]
    return rep.drop("lca").join(assigned.select(*on, F.col("assigned").alias("lca")), on)
