"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges form stars. Neighbourhoods are
    never gathered: a node's smallest neighbour is a partial aggregate, and it is joined back to
    the edges by a plain inner join, whose skewed side adaptive execution can split. Each round
    is cut with a checkpoint. Raises RuntimeError if `most_rounds` don't suffice (their number
    grows as the logarithm of the longest path).
    """
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = cut(edges.select(lo.alias("lo"), hi.alias("hi")).filter("lo < hi").distinct())
    before = None
    for _ in range(most_rounds):
        # large star: what lies above a node is linked to the smallest of its neighbours
        both = now.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(now.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = now.join(least, now["lo"] == least["node"]).select(F.col("m").alias("lo"), "hi").distinct()
        # small star: what lies below a node, and the node, are linked to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "node")
        joined = large.join(least, large["hi"] == least["node"])
        moved = joined.filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        small = moved.union(least.select(F.col("m").alias("lo"), F.col("node").alias("hi"))).distinct()
        now = cut(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
