"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation (the least neighbour of a node) and a join back,
so a node with very many links is never gathered in one task; adaptive
execution splits the join's hot key. Every step is written to the shared
folder. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (long columns a, b); component is the least node reachable."""
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            least.where("a <> m")).distinct()
        large = written(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            down).distinct()
        small = written(small)
        # Done when every node hangs on a root: no node has two parents and no parent has a parent.
        open_ = small.select(F.col("b").alias("a")).distinct().join(small.select("a").distinct(), "a", "left_semi").limit(1).count()
        links = small
        if not open_ and not small.groupBy("a").count().where("count > 1").limit(1).count():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
