"""Connected components by DataFrame joins: large-star and small-star rounds, each written, until nothing changes.

Both steps turn every edge towards the smallest neighbour of its end, so components become stars in a number of rounds
that grows with the logarithm of the graph.  Aggregates are combined before they are shuffled, so a node with very many
edges is no hot key; the joins meet it on one side only, as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task takes (two numbers each).
FEW_EDGES = 50_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a != b.  Links each node's larger (large) or smaller neighbours, and itself, to its smallest."""
    each = lambda *pairs: F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])).alias("e")
    if large:
        both = edges.select(each(("a", "b"), ("b", "a"))).select("e.*")
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a0"), F.least("a", "m").alias("m"))
    out = both.join(least, F.col("a") == F.col("a0"))
    if large:
        return out.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))  # repeats go with the next step
    return out.select(each(("b", "m"), ("a", "m"))).select("e.*").where("a <> b").distinct()


def _dealt(edges: DataFrame) -> DataFrame:
    """Few edges, by their count, go to one task, which spares the shuffles; the steps are the same."""
    return edges.coalesce(1) if edges.count() <= FEW_EDGES else edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of an edge (a, b).  Null ends are left out."""
    every = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    every = written(every.distinct())
    now = _dealt(every.where("a <> b"))
    # done when all are stars: no node has two smaller neighbours, or one that has a smaller one itself
    while not now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() or not now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        now = _dealt(written(_star(_star(now, True), False)))
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    loops = every.where("a = b").select(F.col("a").alias("node"))
    if loops.isEmpty():
        return out
    return out.unionByName(loops.join(out, "node", "left_anti").select("node", F.col("node").alias("root")))
