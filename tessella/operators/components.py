"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is one aggregation and one join, so a node with very many edges is a skewed key at most,
never a group in one task. Lineage is cut each round by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import FEW, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (hi, lo) with hi > lo."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy(F.col("hi").alias("node")).agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
    large = edges.join(least, edges["lo"] == least["node"]).select("hi", F.col("m").alias("lo"))
    # an edge whose lower end is a root keeps it; each node also reaches its own least neighbour
    large = large.distinct()
    down = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(down, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
    return small.select("e.hi", "e.lo").filter("hi > lo").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node.

    Loops and repeated edges are allowed; null ends are dropped."""
    current = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("hi > lo").distinct(),
        "edges",
        FEW,
    )
    for _ in range(max_rounds):
        roots = current.select(F.col("lo").alias("hi")).distinct()
        many = current.groupBy("hi").count().filter("count > 1").limit(1)
        if current.join(roots, "hi", "left_semi").limit(1).count() == 0 and many.count() == 0:
            break
        current = materialize(_stars(current), "edges", FEW)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("lo").alias("node")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )
