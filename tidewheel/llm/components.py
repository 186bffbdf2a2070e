"""Connected components of an edge table, wholly in Spark.

Alternating large-star and small-star steps (Kiveris et al., "Connected components in
MapReduce and beyond", 2014). Each step is one grouped minimum (combined on the map side),
written to the shared folder, and one join that AQE can split when a node has very many links.
Every step is written, so the lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import discard, stored

#: Rounds after which a graph that still changes is an error; log^2 of any practical size is less.
MOST_ROUNDS = 200


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each larger neighbour of a node goes to the least of the node's neighbourhood; also returns the minima."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
    moved = both.where("b > a").join(least, F.col("a") == F.col("n"))
    return moved.select(F.col("m").alias("a"), "b"), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each smaller neighbour of a node, and the node, go to the least of them; also returns the minima."""
    least = stored(edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m"), "least")
    moved = edges.join(least, F.col("b") == F.col("n")).select(F.col("m"), F.col("a").alias("x"))
    ends = least.select("m", F.col("n").alias("x"))
    return moved.union(ends).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), least


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node that has a link, with the least node reachable from it.

    edges: columns a, b of one type that can be compared; order within a pair, repeats and
    self-links do not matter, and pairs with a null are left out.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        large, least = _large_star(now)
        mid = stored(large, "edges")
        discard(least)
        small, least = _small_star(mid)
        after = stored(small, "edges")
        before, mark = mark, _mark(after)
        for old in (now, mid, least):
            discard(old)
        now = after
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
