"""Reader state from append-only event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import text as T

from .ranking import top_k


def latest(events: DataFrame, keys: list[str], order: list[str], deleted: Column | None = None) -> DataFrame:
    """The last event per key; a key whose last event is a tombstone has no state.

    An aggregate, so each task ships one row per key however hot the key is.
    """
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return last if deleted is None else last.where(~deleted)


def without_removed(state: DataFrame, removals: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """State rows not covered by a later removal of a wider key (such as a whole series)."""
    cut = removals.groupBy(*keys).agg(F.max(at).alias("_cut"))
    return state.join(cut, keys, "left").where(F.col("_cut").isNull() | (F.col(at) > F.col("_cut"))).drop("_cut")


def most_recent(events: DataFrame, user: str, key: Column, order: list[str], n: int) -> DataFrame:
    """The n most recently used keys per user, each with its last event."""
    keyed = events.withColumn("_key", key)
    last = latest(keyed, [user, "_key"], order)
    return top_k(last, [user], [F.desc(c) for c in order], n).withColumnRenamed("_key", "key")


def grow_only_set(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.select(*keys).distinct()


def flagged(rows: DataFrame, members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether each row's key is in a membership set."""
    marked = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def shared_computation(requests: DataFrame, query: str, compute) -> DataFrame:
    """Compute once per distinct normalised query and join the answer back to every request.

    `compute` maps (key) rows to (key, ...) rows.
    """
    keyed = requests.withColumn("key", T.title_norm_cjk(F.col(query)))
    answers = compute(keyed.select("key").where(F.col("key") != "").distinct())
    return keyed.join(answers, "key", "left")


def newest_stage(rows: DataFrame, keys: list[str], stage: str = "stage") -> DataFrame:
    """Consumer view of progressive results: everything a query's highest stage wrote."""
    top = rows.groupBy(*keys).agg(F.max(stage).alias(stage))
    return rows.join(top, [*keys, stage], "left_semi")
