"""Parent-child rows to full hierarchies: path, depth, root, descendants and loops.

Rows of (node, parent) are a graph in which each node has one pointer. The pointers are
followed in three steps, each a few joins over shrinking tables:

1. *Splitters.* A node is a splitter if its hash says so (one in `spacing`), whatever the
   order or partition of the rows. Ends of chains stop a walk as well.
2. *Walk.* Every node walks to its next stop. The walks double: a walker at x that is at y
   takes over what y walked, so r rounds cover 2**r parents. Stops at distance d imply
   stops at distance d - 1, so a round in which no walker arrives proves that the rest
   never will: they lead into loops without a splitter, which are named on their own.
3. *Reduced graph.* Only the splitters remain, each pointing to the next one. The same
   doubling over this table (1/spacing of the nodes) finds every splitter's end, or the
   splitterless loop below which it hangs. What never ends goes through a loop of
   splitters, and such loops are named on the reduced graph too.
4. *Expansion.* Each node takes over root, depth, path or loop of its stop, once.

Loops are named by their smallest node. A hop of the reduced graph knows the least node
that it passes. A walker that doubles until it has made at least as many hops as there are
walkers stands on its loop, and the least node seen on the way from a walker *on* the loop
is the loop's name. Walkers carry a few scalars; trails are carried only for paths, between
splitters by the nodes and along the reduced graph by the splitters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def edges(df: DataFrame, node: str = "node", parent: str = "parent", end: str = "0") -> DataFrame:
    """`node, parent` with one row per distinct non-null node. Of several parents the
    smallest non-null one in byte order is taken. A parent that is null, `end` or no node
    of the table becomes null: the chain ends there and the node is a root."""
    rows = df.select(F.col(f"`{node}`").cast("string").alias("node"), F.col(f"`{parent}`").cast("string").alias("parent")).filter(F.col("node").isNotNull())
    one = rows.groupBy("node").agg(F.min(F.when(F.col("parent") != end, F.col("parent"))).alias("parent"))
    known = one.select(F.col("node").alias("__p"))
    return one.join(known, F.col("parent") == F.col("__p"), "left").select("node", F.col("__p").alias("parent"))


@dataclass
class Forest:
    """`nodes`: node, root, depth, path (root first; null on loops), loop_node (null off
    loops). Depth counts parents, so a root has 0. Root, depth and path are null for nodes
    on or below a loop."""

    nodes: DataFrame
    scratch: Scratch


class _Walkers:
    """Walks of nodes: `node, at` (where the walker stands), `low` (the least node passed),
    `steps`, and with paths `trail` (nodes passed, oldest first)."""

    def __init__(self, scratch: Scratch, arrived: DataFrame, walking: DataFrame):
        self.scratch, self.hops = scratch, 1
        first = arrived.withColumn("done", F.lit(True)).unionByName(walking.withColumn("done", F.lit(False)))
        self.last, path, self.left = scratch.cut_and_count(first, ~F.col("done"))
        self.paths = [path]

    @property
    def arrived(self) -> DataFrame:
        return self.scratch.spark.read.schema(self.last.schema).parquet(*self.paths).filter("done").drop("done")

    @property
    def open(self) -> DataFrame:
        return self.last.filter("NOT done").drop("done")

    def _moved(self) -> DataFrame:
        other = self.arrived.withColumn("done", F.lit(True)).unionByName(self.open.withColumn("done", F.lit(False)))
        seen = other.select(*[F.col(c).alias(f"__{c}") for c in other.columns])
        trail = [F.concat("trail", "__trail").alias("trail")] if "trail" in other.columns else []
        both = self.open.join(seen, F.col("at") == F.col("__node"))
        return both.select("node", F.col("__at").alias("at"), F.least("low", "__low").alias("low"), (F.col("steps") + F.col("__steps")).alias("steps"), *trail, F.col("__done").alias("done"))

    def run(self) -> None:
        """Until no more walker arrives. Each round writes those that still walked."""
        before = -1
        while self.left and self.left != before:
            before = self.left
            self.last, path, self.left = self.scratch.cut_and_count(self._moved(), ~F.col("done"))
            self.paths.append(path)
            self.hops *= 2

    def loops(self) -> DataFrame:
        """`node, loop_node` of the walkers that never arrive."""
        state, path, hops = self.open.select("node", "at", "low"), None, self.hops
        while hops < self.left:
            other = state.select(F.col("node").alias("__n"), F.col("at").alias("__at"), F.col("low").alias("__low"))
            nxt = state.join(other, F.col("at") == F.col("__n")).select("node", F.col("__at").alias("at"), F.least("low", "__low").alias("low"))
            before = path
            state, path = self.scratch.cut(nxt)
            if before:
                self.scratch.drop(before)
            hops *= 2
        # now every walker stands on its loop, and `low` seen from there is the loop's least node
        on_loop = state.select(F.col("node").alias("__n"), F.col("low").alias("loop_node"))
        return state.join(on_loop, F.col("at") == F.col("__n")).select("node", "loop_node")


def solve(df: DataFrame, node: str = "node", parent: str = "parent", end: str = "0", spacing: int = 16, paths: bool = True) -> Forest:
    """Roots, depths, loops and (with `paths`) paths of all distinct nodes (see the
    module's text).

    Repeated rows, null nodes, null or unknown parents and further columns are handled as
    `edges` says. A node that is its own parent is a loop. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "forest")
    stop = F.col("parent").isNull() | (F.pmod(F.xxhash64("node"), F.lit(spacing)) == 0)
    graph, _ = scratch.cut(edges(df, node, parent, end).withColumn("stop", stop))
    none = F.array().cast("array<string>")

    def walk(at: Column, low: Column, steps: Column, trail: Column) -> list[Column]:
        return ["node", at.alias("at"), low.alias("low"), steps.alias("steps"), *([trail.alias("trail")] if paths else [])]

    here, zero, one = F.col("node"), F.lit(0), F.lit(1)
    walkers = _Walkers(scratch, graph.filter("stop").select(*walk(here, here, zero, none)), graph.filter("NOT stop").select(*walk(F.col("parent"), here, one, F.array("node"))))
    walkers.run()
    lost = scratch.cut(walkers.loops())[0] if walkers.left else None

    # the reduced graph: from each splitter over its parent to the parent's stop
    over = walkers.arrived.select(*[F.col(c).alias(f"__{c}") for c in walkers.open.columns])
    hops, _ = scratch.cut(graph.filter("stop").join(over, F.col("parent") == F.col("__node"), "left"))
    going = hops.filter(F.col("__at").isNotNull())
    trail = F.concat(F.array("node"), "__trail") if paths else none
    reduced = _Walkers(
        scratch,
        hops.filter(F.col("__at").isNull()).select(*walk(here, here, zero, none)),
        going.select(*walk(F.col("__at"), F.least("node", "__low"), F.col("__steps") + 1, trail)),
    )
    reduced.run()

    text, up = F.lit(None).cast("string"), ([F.col("trail").alias("__up")] if paths else [])
    ends = reduced.arrived.select(F.col("node").alias("__stop"), F.col("at").alias("end"), F.col("steps").alias("__more"), *up)
    if lost is None:
        ends = ends.withColumn("loop", text)
    else:  # splitters whose parent leads into a loop without splitters
        hang = hops.filter(F.col("__at").isNull() & F.col("parent").isNotNull()).select(F.col("node").alias("__h"), F.col("parent").alias("__hp"))
        named = hang.join(lost.select(F.col("node").alias("__l"), F.col("loop_node").alias("loop")), F.col("__hp") == F.col("__l")).select("__h", "loop")
        ends = ends.join(named, F.col("end") == F.col("__h"), "left").drop("__h")
    if reduced.left:
        more = [none.alias("__up")] if paths else []
        ends = ends.unionByName(reduced.loops().select(F.col("node").alias("__stop"), text.alias("end"), zero.alias("__more"), *more, F.col("loop_node").alias("loop")))
    # 4. every node behind its stop
    off = F.col("loop").isNull()
    path = F.reverse(F.concat("trail", "__up", F.array("end"))) if paths else F.lit(None).cast("array<string>")
    nodes = walkers.arrived.join(ends, F.col("at") == F.col("__stop")).select(
        "node",
        F.when(off, F.col("end")).alias("root"),
        F.when(off, F.col("steps") + F.col("__more")).alias("depth"),
        F.when(off, path).alias("path"),
        F.col("loop").alias("loop_node"),
    )
    if lost is not None:
        nodes = nodes.unionByName(lost.select("node", text.alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"), "loop_node"))
    result = Scratch(df.sparkSession, "hierarchy")
    nodes, _ = result.cut(nodes)
    scratch.drop(scratch.root)
    return Forest(nodes, result)


def descendants(forest: Forest) -> DataFrame:
    """`ancestor, node, distance`: every node below each ancestor, itself (0) included.
    Nodes on or below loops have no rows."""
    return (
        forest.nodes.filter(F.col("path").isNotNull())
        .select("node", "depth", F.posexplode("path").alias("level", "ancestor"))
        .select("ancestor", "node", (F.col("depth") - F.col("level")).alias("distance"))
    )


def looped(forest: Forest) -> DataFrame:
    """`node, loop_node`: the nodes on or below loops."""
    return forest.nodes.filter(F.col("loop_node").isNotNull()).select("node", "loop_node")
