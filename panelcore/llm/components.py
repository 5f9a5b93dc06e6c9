"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.session import cut_lineage

#: Edges that one task reads of a round; few edges then cost few shuffle files.
EDGES = 50_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest member of each node's neighbourhood.

    ``large`` moves the neighbours that are larger than the node, otherwise the node and
    its smaller neighbours. The minimum is an aggregate with map-side combine and comes
    back by a join, so a hub's neighbours are never gathered in one task.
    """
    e = edges.select("u", "v")
    if large:
        e = e.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = e.groupBy("u").agg(F.min("v").alias("_m")).select(
        F.col("u").alias("_u"), F.least("u", "_m").alias("m")
    )
    j = e.join(low, e["u"] == low["_u"])
    if large:
        out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select(F.col("_u").alias("u"), F.col("m").alias("v"))
        )
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from every node that has an edge.

    ``edges`` holds ``u, v``; direction, repeats and loops do not matter. Each round is
    written to the shared checkpoint folder; rounds grow with the logarithm of the
    longest chain. No edge list is ever held by the driver, only two counters.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut_lineage(e.where("u != v").distinct())
    state = None
    while True:
        now = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select("v", "v").distinct()
            )
        state = now
        e = cut_lineage(_star(_star(e.coalesce(now[0] // EDGES + 1), True), False))
