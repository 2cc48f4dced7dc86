"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.llm.common import cut_lineage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with an edge, root being the smallest node reachable.

    Alternates large and small stars: every node hands its larger, then its smaller neighbours to the smallest one, until
    each component is one star. Rounds grow with the logarithm of the component size; each is an aggregate of minima with
    partial sums in the tasks and a join whose hot keys adaptive execution splits. Each round is checkpointed.
    """
    edges = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct()
    edges = cut_lineage(edges)
    while True:
        both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(edges.select("hi", "lo"))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
        large = both.filter("other > node").join(least, "node").select(F.col("root").alias("lo"), F.col("other").alias("hi")).filter("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(least, "hi").select(F.col("root").alias("a"), F.col("lo").alias("b")).union(least.select("root", "hi"))
        after = cut_lineage(small.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
        # Done when every edge leads from a root, that is when no lower end is also a higher end.
        if after.select("hi").intersect(after.select("lo")).isEmpty() and _one_root(after):
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(after.select("lo", "lo").distinct())
        edges = after


def _one_root(edges: DataFrame) -> bool:
    return edges.groupBy("hi").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
