"""Connected components of an edge table by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). A step needs only the least neighbour of each node, which is
an aggregate with map-side combine; the edges of a node are never gathered, so a hub with a third of all edges is a skewed join
that adaptive execution splits, not a task that holds them. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postmill.runtime import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour v of u is linked to the least node near u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. In: u > v in every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    Null endpoints and self loops are ignored (a node with only a self loop is its own component); repeated edges count once; an
    empty table gives an empty result. Columns beside `src` and `dst` are not read. Raises if `max_rounds` do not suffice (the
    number of rounds grows with the logarithm of the longest path).
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    start = pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(start)
    seen = _checksum(now)
    for _ in range(max_rounds):
        new = cut(_small_star(_large_star(now).distinct()).distinct())
        mark = _checksum(new)
        release(now)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    loops = pairs.filter("a = b").select(F.col("a").alias("node")).distinct().join(now.select(F.col("u").alias("node")).union(roots.select("node")), "node", "left_anti")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return found.union(loops.select("node", F.col("node").alias("component")))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("pmod(xxhash64(v, u), 1000003)"))).first())
