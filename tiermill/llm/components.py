"""Connected components of a graph given as an edge table, by alternating star contraction.

Each round links every vertex's larger neighbours, then its smaller ones, to the smallest vertex known around it, so chains
shrink by a factor and the number of rounds follows the logarithm of the longest path. A round's edges are written to the
shared folder; only two sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import keep


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (u, v) replaced by edges to the smallest vertex of each neighbourhood."""
    if larger:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # The minimum is combined before it moves; the join back to a hub's edges is one that can be split.
    lowest = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = sides.join(lowest, "u")
    if larger:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every vertex of ``edges`` (``u``, ``v``, orderable, not null).

    Loops and repeated edges change nothing; an empty table gives no rows. Vertices without an edge are not listed.
    """
    current = keep(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
        16,
    )
    digest = None
    while True:
        current = keep(_star(_star(current, larger=True), larger=False), "edges", 16)
        state = current.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == digest:
            break
        digest = tuple(state)
    return current.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
