"""Graph operators over edges (src, dst, line, tier): neighbours, bounded reach, rank, cycles, closures, liveness.

Loops run on the driver, to a depth or to the end; every round is a distributed join, written as a table.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

MOST_DEPTH = 6


def neighbours(edges: DataFrame, node, direction: str, unscoped: bool = False) -> tuple[DataFrame, DataFrame]:
    """(symbol, line, tier) one step from a node, and the count of the edges out of scope.

    callers keeps each call site; callees has a node once, at its first line.
    """
    end, other = ("dst", "src") if direction == "callers" else ("src", "dst")
    near = edges.where(F.col(end).cast("string") == str(node))
    hidden = near.where((F.col("tier") == "repo") & F.lit(not unscoped)).agg(F.count(F.lit(1)).alias("n"))
    shown = near.where((F.col("tier") != "repo") | F.lit(unscoped)).select(F.col(other).cast("string").alias("symbol"), "line", "tier")
    if direction == "callees":
        shown = shown.groupBy("symbol").agg(F.min("line").alias("line"), F.min("tier").alias("tier"))
    return shown, hidden


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = MOST_DEPTH) -> DataFrame:
    """(node, depth) least steps along (src, dst) from seeds (node), at most `depth` (None: to the end); seeds count once
    reached again."""
    step = settled(edges.select("src", "dst").distinct())
    frontier, found = seeds.select("node").distinct(), None
    for d in count(1) if depth is None else range(1, min(depth, MOST_DEPTH) + 1):
        nxt = frontier.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        if found is not None:
            nxt = nxt.join(found.select("node"), "node", "left_anti")
        nxt = settled(nxt.withColumn("depth", F.lit(d).cast("long")))
        found = nxt if found is None else found.unionByName(nxt)
        frontier = nxt.select("node")
        if nxt.isEmpty():
            break
    return found


def impact(edges: DataFrame, node, depth: int = MOST_DEPTH, unscoped: bool = False) -> DataFrame:
    """(symbol, depth) of all that reach the node within `depth` calls."""
    back = edges.where((F.col("tier") != "repo") | F.lit(unscoped)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = back.sparkSession.createDataFrame([(str(node),)], "n string").select(F.col("n").cast(back.schema["src"].dataType).alias("node"))
    return reach(back, seeds, depth).select(F.col("node").cast("string").alias("symbol"), "depth")


def impact_hidden(edges: DataFrame, node, depth: int = MOST_DEPTH) -> DataFrame:
    """(n): how many more nodes the edges out of scope would add."""
    scoped, every = impact(edges, node, depth), impact(edges, node, depth, True)
    return every.join(scoped, "symbol", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def closure(parents: DataFrame, root, depth: int = MOST_DEPTH) -> DataFrame:
    """(symbol, depth) of the subtypes of a root over (base, sub); the root itself is left out."""
    e = parents.select(F.col("base").alias("src"), F.col("sub").alias("dst"))
    seeds = e.sparkSession.createDataFrame([(str(root),)], "node string")
    return reach(e, seeds, depth).where(F.col("node") != str(root)).select(F.col("node").alias("symbol"), "depth")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, score) after a fixed number of rounds from 1.0; the mass of nodes without out-edges is dropped."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    e = settled(e.join(out, "src"))
    nodes = settled(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    score = nodes.withColumn("score", F.lit(1.0))
    for i in range(rounds):
        given = e.join(score, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("score") / F.col("deg")).alias("s"))
        score = nodes.join(given, F.col("node") == F.col("dst"), "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("score"))
        if i % 3 == 2:
            score = settled(score)
    return score


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles: both ways reach of least labels, trimmed until nothing changes.

    Rounds go on until no edge is left; each settles the component of the least node, at least.

    Each round: nodes without an edge in or out are trimmed; the least node that reaches a node, and the least that a
    node reaches, agree only within a component; those that agree are settled, and edges between others are cut.
    """
    loops = edges.where("src = dst").select("src").distinct()
    e = edges.where("src <> dst").select("src", "dst").distinct()
    done = None
    while True:
        e = _trim(e)
        if e.isEmpty():
            break
        fwd, back = _least(e, "src", "dst"), _least(e, "dst", "src")
        both = settled(fwd.toDF("node", "f").join(back.toDF("node", "b"), "node"))
        agreed = both.where("f = b").select("node", F.col("f").alias("component"))
        # a node that agrees with itself alone lies between cycles, on none
        agreed = agreed.join(agreed.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("node", "component")
        done = settled(agreed if done is None else done.unionByName(agreed))
        rest = both.where("f <> b")
        s = rest.select(F.col("node").alias("src"), F.col("f").alias("fs"), F.col("b").alias("bs"))
        d = rest.select(F.col("node").alias("dst"), F.col("f").alias("fd"), F.col("b").alias("bd"))
        e = e.join(s, "src").join(d, "dst").where("fs = fd and bs = bd").select("src", "dst")
    own = loops.select(F.col("src").alias("node"), F.col("src").alias("component"))
    if done is None:
        return own
    return done.unionByName(own.join(done, "node", "left_anti"))


def _trim(e: DataFrame) -> DataFrame:
    n = -1
    while True:
        e = settled(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = e.count()
        if now == n:
            return e
        n = now


def _least(e: DataFrame, start: str, end: str) -> DataFrame:
    """(node, label): the least node from which a node is reached along start -> end, itself included."""
    label = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().withColumn("label", F.col("node"))
    mark = None
    while True:
        told = e.join(label, F.col(start) == F.col("node")).select(F.col(end).alias("node"), "label")
        label = settled(label.unionByName(told).groupBy("node").agg(F.min("label").alias("label")))
        now = label.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
        if now == mark:
            return label
        mark = now


def dead(objects: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects (node) that no root reaches over edges, in any number of steps."""
    live = reach(edges, roots, None).select("node").unionByName(roots.select("node")).distinct()
    return objects.join(live, "node", "left_anti")


def around(edges: DataFrame, nodes: DataFrame, most: int = 4) -> DataFrame:
    """(node, relation, other, line): callers and callees of each node (node), the first `most` by relation, place and name."""
    back = edges.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst").select(F.col("dst").alias("node"), F.lit("caller").alias("relation"), F.col("src").alias("other"), "line")
    ahead = edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src").select(F.col("src").alias("node"), F.lit("callee").alias("relation"), F.col("dst").alias("other"), "line")
    both = back.unionByName(ahead).groupBy("node", "relation", "other").agg(F.min("line").alias("line"))
    by = Window.partitionBy("node").orderBy("relation", "line", "other")
    return both.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most).drop("_r")
