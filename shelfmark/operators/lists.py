"""Ordered-list aggregations kept as rows: first wins, last wins, merges, votes and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import lexicon as L, text as T

from .ranking import top_k


def first_wins(df: DataFrame, keys: list[str], derived: Column, position: str, values: list[str]) -> DataFrame:
    """(keys, key, values, pos): the first row per derived key; blank keys are dropped."""
    return df.withColumn("key", derived).where(F.col("key") != "").groupBy(*keys, "key").agg(
        F.min_by(F.struct(*values), position).alias("_v"), F.min(position).alias("pos")
    ).select(*keys, "key", "_v.*", "pos")


def last_wins(df: DataFrame, keys: list[str], position: str, values: list[str]) -> DataFrame:
    """(keys, values, first_pos): the last row's values at the place the key first appeared."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*values), position).alias("_v"), F.min(position).alias("first_pos")
    ).select(*keys, "_v.*", "first_pos")


def merged_titles(df: DataFrame, keys: list[str], title: str, position: str, cap: int = 16) -> DataFrame:
    """Up to `cap` titles per key, distinct by normalised text, in first-seen order."""
    distinct = first_wins(df, keys, T.title_norm_cjk(F.col(title)), position, [title])
    kept = top_k(distinct, keys, ["pos", "key"], cap, "_n")
    return kept.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_n", F.col(title).alias("t")))), lambda e: e["t"]
    ).alias("titles"))


def capped_distinct(df: DataFrame, keys: list[str], derived: Column, position: str, values: list[str], cap: int) -> DataFrame:
    """First `cap` rows per key, distinct by a derived key, numbered."""
    return top_k(first_wins(df, keys, derived, position, values), keys, ["pos", "key"], cap)


def reading_mode(images: DataFrame, keys: list[str], default: Column) -> DataFrame:
    """Scroll when at least 60 % of the sized images are tall, paginated up to 30 %, else the default."""
    sized = (F.col("width") > 0) & F.col("height").isNotNull()
    tall = F.avg(F.when(sized, F.when(F.col("height") / F.col("width") >= 1.7, 1.0).otherwise(0.0)))
    mode = F.when(F.col("_t") >= 0.6, "scroll").when(F.col("_t") <= 0.3, "paginated").otherwise(default)
    return images.groupBy(*keys).agg(tall.alias("_t")).withColumn("mode", mode).drop("_t")


def page_counts(links: DataFrame, keys: list[str]) -> DataFrame:
    """Links and chapter links per page; a page without reader signal and two chapter links is a series page."""
    return links.groupBy(*keys).agg(
        F.count("*").alias("links"), F.sum(F.when(F.col("is_chapter"), 1).otherwise(0)).alias("chapter_links"),
        F.max("has_reader").alias("_r"),
    ).withColumn("is_series", ~F.col("_r") & (F.col("chapter_links") >= 2)).drop("_r")


def highest_number(chapters: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    parsed = F.nullif(F.regexp_extract(number, L.NUMBER_RE, 0), F.lit("")).try_cast("double")
    return chapters.groupBy(*keys).agg(F.max(parsed).alias("highest"))


def against_target(df: DataFrame, key: str, target: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("collected")).select(
        key, "collected", F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col("collected")).alias("remaining"),
        (F.col("collected") >= target).alias("reached"),
    )
