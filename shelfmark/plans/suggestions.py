"""Suggestions and direct search over a listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.functions import text as T, titles as TT
from shelfmark.operators import matching as M
from shelfmark.session import materialize


def suggest(inputs: DataFrame, catalogue: DataFrame, supported: DataFrame) -> DataFrame:
    """(query_id, list, rank, pos, title): alternatives and, where inputs carry genres, similar rows, per
    input; the trending rows once under the query id `all`.
    """
    columns = ["query_id", "list", "rank", "pos", "title"]
    parts = [M.alternatives(inputs, catalogue).withColumn("list", F.lit("alternative")).select(columns)]
    if "genres" in inputs.columns:
        parts.append(M.similar_by_genre(inputs, catalogue).withColumn("list", F.lit("similar")).select(columns))
    # At most six rows reach this window.
    top = M.trending(catalogue, supported).withColumn("rank", F.row_number().over(Window.orderBy("pos")))
    parts.append(top.select(F.lit("all").alias("query_id"), F.lit("trending").alias("list"), "rank", "pos", "title"))
    return reduce(DataFrame.unionByName, parts)


def direct_search(queries: DataFrame, candidates: DataFrame, sources: list[str]) -> DataFrame:
    """Relevant results per query from the first source, in order of preference, that has any candidate."""
    variants = materialize(
        T.exploded(queries.select("query_id", "query"), TT.read_now_variants(F.array("query")), "variant", "pos")
        .select("query_id", "pos", "variant"), "variants",
    )
    open_variants, found = variants, []
    for source in sources:
        matches = materialize(M.strict_direct_matches(open_variants, candidates.where(F.col("source") == source)), "direct-matches")
        found.append(matches)
        open_variants = open_variants.join(matches.select("query_id").distinct(), "query_id", "left_anti")
    return M.relevant_results(reduce(DataFrame.unionByName, found), queries)
