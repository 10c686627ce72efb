"""Distributed union-find: connected components by alternating large-star and small-star steps.

Every step works on an edge table of at most the input's size and is written to the shared folder, so a
lost executor costs one step.  Nothing is gathered on the driver but whether a step was the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Cut


def connected(cut: Cut, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges (a, b)`` that isn't a root itself; a root is its component's
    smallest node.  Loops and repeated edges don't matter; no edges give no rows."""
    now = cut.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    for _ in range(most_rounds):
        if _settled(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut.write(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = cut.write(small.select("e.a", "e.b").where("a > b").distinct())
        cut.drop(large, now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge down, to a node that has none."""
    down, up = edges.select(F.col("a").alias("x"), F.lit(1).alias("down")), edges.select(F.col("b").alias("x"), F.lit(0).alias("down"))
    return down.union(up).groupBy("x").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 1 or (down = 1 and n > 1)").isEmpty()
