"""Connected components of an edge list, as DataFrame rounds over edges only.

Alternates two steps until nothing changes: every vertex links its larger
neighbours to its smallest neighbour (large star), then links its smaller
neighbours and itself to the smallest (small star). The edges end as stars
around each component's smallest vertex. Both steps are a minimum per vertex
joined back to the edges, so no neighbourhood is ever gathered, and each round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    return linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        least.select("u", F.col("m").alias("v"))
    ).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of `edges` (u, v); root is the smallest vertex of its component."""
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(now, "edges"), None
    while True:
        after = materialize(_small_star(_large_star(now)), "edges")
        seen = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == before:
            break
        now, before = after, seen
    return after.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionAll(
        after.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    )
