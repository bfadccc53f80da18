"""Connected components by alternating large-star and small-star steps.

Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected components in
MapReduce and beyond" (2014). Both steps are a minimum per node (combined before
the shuffle) joined back to the edges, so that no node's neighbours are ever
gathered in one task; a hot node's rows are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.lineage import cut

#: The steps need O(log n) rounds; a graph that takes more points to an error.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects the larger neighbours of every node to its smallest neighbour or itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects every node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``(node, component)`` of every node on an edge; the component is its smallest node.

    edges: columns ``u`` and ``v`` of one orderable type. Edges with a null end and
    loops count for nothing; repeated and reversed edges count once; no edges give
    no rows. Nodes without edges don't come out: they stand alone.
    """
    now = cut(edges.select("u", "v").filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = cut(_small_star(_large_star(now)))
        # A star forest maps onto itself; equal counts and hash sums mean that nothing moved.
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (row.n, row.h):
            centre = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centre)
        mark = (row.n, row.h)
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def star_edges(members: DataFrame, group: str, node: str) -> DataFrame:
    """Edges from each member of a group to the group's smallest member: as many as members, never all pairs."""
    rows = members.select(F.col(group).alias("g"), F.col(node).alias("u")).filter("g is not null and u is not null").distinct()
    least = rows.groupBy("g").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(least, "g").filter("u <> v").select("u", "v").distinct()
