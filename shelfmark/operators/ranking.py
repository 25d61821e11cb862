"""Ranking, top-k and order statistics that stay whole under hot keys.

`top_k` relies on the optimizer's window group limit: each map task sorts and
keeps k rows per key before the shuffle, so a hot key ships k rows per task.
Where every row of a group must be numbered, the table is range-partitioned in
the wanted order (edges come from a sample of the rows, so neither a hot group
nor an outlier fills one task) and offsets come from the counts per range.
Order statistics are selected by rounds over the hit range of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import materialize


def top_k(df: DataFrame, keys: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key with their 1-based rank; `order` must end in a unique column."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def with_group_flag(df: DataFrame, keys: list[str], condition: Column, name: str) -> DataFrame:
    """Add whether any row of the group meets `condition`.

    The flag is an aggregate joined back on the key (adaptive execution splits
    a hot key on the row side); a window would gather the group in one task.
    Null keys form no group and get a null flag.
    """
    flags = df.where(condition).select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(flags, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def grouped_rank(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """1-based position of every row in its group.

    `bucket` must not decrease along `order`; it splits hot groups so that each
    task numbers one bucket, and the bucket counts give the offsets.
    """
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    joined = b.withColumn("_w", within).join(
        offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_ob"), "_off"),
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_b").eqNullSafe(F.col("_ob"))],
    )
    return joined.withColumn(name, F.col("_w") + F.col("_off")).drop(
        "_b", "_w", "_off", "_ob", *[f"_k_{k}" for k in keys]
    )


def global_index(df: DataFrame, bucket: Column, order: list, name: str = "index") -> DataFrame:
    """Zero-based position over the whole table, numbered bucket by bucket."""
    one = df.withColumn("_all", F.lit(0))
    return grouped_rank(one, ["_all"], bucket, order, name).withColumn(name, F.col(name) - 1).drop("_all")


def range_rank(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based position of every row in its group, in `order`, which must end in a unique column.

    Ranges are cut over (keys, order), so a group that holds any share of the
    rows is spread over as many tasks as its share needs. The ranges are written
    before rows are counted, so both steps see the same ones. A null key is a
    group of its own; an empty table gives an empty table.
    """
    ranged = materialize(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    # At most one row per key and range: a group has no more rows here than there are ranges.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    same = [F.col("_range") == F.col("_r")] + [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = ranged.withColumn("_w", within).join(offsets, same)
    return joined.withColumn(name, F.col("_w") + F.col("_off")).drop("_range", "_w", "_off", "_r", *[f"_k_{k}" for k in keys])


def range_index(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Zero-based position of every row of the table in `order`, numbered range by range."""
    return range_rank(df.withColumn("_all", F.lit(0)), ["_all"], order, name).withColumn(name, F.col(name) - 1).drop("_all")


def value_at_rank(df: DataFrame, keys: list[str], value: str, rank: Column, buckets: int = 64, at_once: int = 100_000) -> DataFrame:
    """(keys, n, value) where value is the element at zero-based position `rank(n)` of the sorted group.

    Exact selection over distinct values with their counts. Each round cuts the
    values left of a group at their approximate percentiles (so an outlier costs
    nothing) and keeps the range the rank falls into, until no group has more
    than `at_once` values left, which are then ordered. Rounds number about
    log(values) / log(buckets). `rank` is an expression over the group count
    column `n`; null values and null keys take no part.
    """
    present = df.where(F.col(value).isNotNull())
    distinct = materialize(present.groupBy(*keys, value).agg(F.count("*").alias("_c")), "values")
    sizes = distinct.groupBy(*keys).agg(F.sum("_c").alias("n"))
    left = distinct.join(sizes.withColumn("_want", rank), keys)
    points = [i / buckets for i in range(1, buckets)]
    while (left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > max(at_once, 2 * buckets):
        # Approximate percentiles differ between evaluations: written once, so that counts and rows are placed by the same edges.
        edges = materialize(left.groupBy(*keys).agg(F.percentile_approx(value, points, 10_000).alias("_edges")), "value-edges")
        placed = left.join(edges, keys).withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
        counts = placed.groupBy(*keys, "_want", "_b").agg(F.sum("_c").alias("_bc"))
        upto = F.sum("_bc").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("_end", upto).where((F.col("_want") < F.col("_end")) & (F.col("_want") >= F.col("_end") - F.col("_bc")))
        hit = hit.select(*keys, "_b", (F.col("_end") - F.col("_bc")).alias("_start"))
        left = placed.join(hit, [*keys, "_b"]).withColumn("_want", F.col("_want") - F.col("_start")).drop("_b", "_start")
        left = materialize(left, "values-left")
    by_value = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ends = left.withColumn("_cum", F.sum("_c").over(by_value))
    return ends.where((F.col("_want") < F.col("_cum")) & (F.col("_want") >= F.col("_cum") - F.col("_c"))).select(*keys, "n", value)
