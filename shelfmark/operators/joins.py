"""Small join patterns: companions over relation edges, preferred-then-alternate lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import text as T


def companions(items: DataFrame, anime: DataFrame) -> DataFrame:
    """(item_id, companion_id): the first adaptation relation's first anime entry, else the first anime of the same title.

    `items`: item_id, title, relations array<struct<relation, entry array<struct<item_id, type>>>>.
    `anime`: item_id, title, is_anime.
    """
    adaptation = F.get(F.filter("relations", lambda r: F.lower(T.strip_tags(r["relation"])) == "adaptation"), F.lit(0))
    edge = F.get(F.filter(adaptation["entry"], lambda e: F.lower(T.strip_tags(e["type"])) == "anime"), F.lit(0))["item_id"]
    routed = items.select("item_id", "title", edge.alias("_via"))
    direct = anime.select(F.col("item_id").alias("_via"), F.col("item_id").alias("_a"))
    by_title = anime.where("is_anime").groupBy("title").agg(F.min("item_id").alias("_t"))
    return routed.join(direct, "_via", "left").join(by_title, "title", "left").select(
        "item_id", F.coalesce("_a", "_t").alias("companion_id")
    )


def preferred(wanted: DataFrame, tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Left joins in order of preference; the first table that knows the key supplies the value."""
    joined, names = wanted, []
    for i, table in enumerate(tables):
        names.append(f"_v{i}")
        joined = joined.join(table.select(key, F.col(value).alias(names[-1])), key, "left")
    return joined.withColumn(value, F.coalesce(*names)).drop(*names)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
