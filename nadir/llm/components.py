"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Alternates the large-star and small-star steps. A node's neighbours are
    never gathered: each step takes the least neighbour by a partial aggregate
    and joins it back, so a node with very many links is only a skewed join.
    Each round is written to the shared folder. Self-links and repeats are
    allowed; null ends are ignored.
    """
    now = scratch.table(f"{name}-0", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    step = 0
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        linked = scratch.table(f"{name}-{step}", large.distinct())
        # every link now points from the greater to the lesser end
        low = linked.groupBy("a").agg(F.min("b").alias("m"))
        small = linked.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        step += 1
        following = scratch.table(f"{name}-{step}", small.distinct())
        # a star forest: no centre is the member of another star, and each member has one centre
        loose = following.groupBy("a").count().where("count > 1").select("a").union(following.join(following.select(F.col("b").alias("centre")).distinct(), F.col("a") == F.col("centre"), "left_semi").select("a"))
        now = following
        if loose.isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
