"""Alias-expanded search: filter, search, expand weak queries by alias titles, merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import text as T, titles as TT
from shelfmark.operators.results import filter_by_media
from shelfmark.session import materialize

from . import search as P


def _prepared(queries: DataFrame) -> DataFrame:
    return queries.withColumn("query_norm", T.match_norm(F.col("query"))).withColumn(
        "raw_tokens", T.alnum_runs(F.col("query_norm"))
    )


def expand_and_merge(queries: DataFrame, titles: DataFrame, search: Callable[[DataFrame], DataFrame],
                     limit: int = 1) -> dict[str, DataFrame]:
    """Primary and alias searches of prepared queries, merged.

    `search` maps (query_id, query, query_norm, raw_tokens) to ranked results.
    All alias queries of all queries run as one table. Returns the stages
    `primary`, `title_alias` and the final `results`.
    """
    queries = materialize(queries, "prepared-queries")
    primary = materialize(search(queries).join(queries.select("query_id", "query"), "query_id"), "primary")
    weak = materialize(queries.join(P.strong_primary(primary), "query_id", "left_anti"), "weak-queries")
    choices = materialize(P.alias_choices(weak, titles), "alias-choices")
    # From here on only titles of chosen items count.
    titles = materialize(titles.join(choices.select("item_id").distinct(), "item_id", "left_semi"), "chosen-titles")
    extra = materialize(P.alias_queries(weak, choices, titles, limit), "alias-queries")
    alias_rows = _prepared(extra.select(
        F.concat_ws("#", F.col("query_id").cast("string"), F.col("alias_pos").cast("string")).alias("query_id"),
        F.col("alias_query").alias("query"),
    ))
    found = search(alias_rows).withColumn("_p", F.split("query_id", "#")).select(
        F.col("_p")[0].cast("long").alias("query_id"), F.col("_p")[1].cast("int").alias("entry"), "item_id", "title", "score"
    )
    alias_titles = extra.select("query_id", F.col("alias_pos").cast("int").alias("entry"), "item_id", F.col("score").alias("alias_score")).join(
        titles.select("item_id", T.title_norm_cjk(F.col("title")).alias("c")), "item_id"
    ).drop("item_id")
    expanded = extra.select("query_id").distinct()
    first = primary.select("query_id", F.lit(0).alias("entry"), "item_id", "title", "score")
    merged = P.merged_responses(first.join(expanded, "query_id", "left_semi"), found, alias_titles)
    untouched = primary.join(expanded, "query_id", "left_anti").select(
        "query_id", "rank", "item_id", "title", "score", F.lit(0).alias("entry")
    )
    return {"primary": primary, "title_alias": merged, "results": untouched.unionByName(merged)}


def expanded_search(queries: DataFrame, titles: DataFrame, search: Callable[[DataFrame], DataFrame],
                    limit: int = 1) -> dict[str, DataFrame]:
    """As `expand_and_merge`, for raw queries: a trailing media word becomes a result filter first."""
    parsed = queries.withColumn("_f", TT.trailing_media_type(F.col("query"))).select(
        "query_id", F.col("_f.query").alias("query"), F.col("_f.media_type").alias("wanted")
    )
    wanted = materialize(parsed, "parsed-queries")

    def filtered(df: DataFrame) -> DataFrame:
        owner = F.split(F.col("query_id").cast("string"), "#")[0].cast("long")
        rows = search(df).withColumn("_o", owner).join(
            wanted.select(F.col("query_id").alias("_o"), "wanted"), "_o", "left"
        ).drop("_o")
        return filter_by_media(rows, "wanted", ["query_id"]).drop("wanted")

    return expand_and_merge(_prepared(wanted.select("query_id", "query")), titles, filtered, limit)
