"""Reader state, query sharing and streaming jobs over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import state as ST
from shelfmark.session import new_path
from shelfmark.sources import sinks
from shelfmark.streaming import jobs as Z

from . import query

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def logs(t):
    return t.events.select("event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("most_recent_w5", f"""WITH d AS (SELECT user_id, {_K} AS key, max(event_id) AS event_id, arg_max(ts, event_id) AS ts FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM d) SELECT user_id, key, event_id, rank FROM r WHERE rank <= 50""")
def most_recent(t):
    return ST.most_recent(logs(t), "user_id", F.col("k"), ["event_id"], 50).select("user_id", "key", "event_id", "rank")


@query("membership_flags_j22", f"""SELECT event_id, ({_K}, user_id) IN (SELECT {_K}, user_id FROM events WHERE event_type = 'view') AS has_read, user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 40) AS favoured FROM events""")
def membership_flags(t):
    rows = logs(t)
    read = ST.flagged(rows, rows.where("event_type = 'view'"), ["user_id", "k"], "has_read")
    return ST.flagged(read, rows.where("event_type = 'purchase' AND value > 40"), ["user_id"], "favoured").select("event_id", "has_read", "favoured")


@query("progressive_view_z1", """WITH s AS (SELECT user_id AS query_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS stage, event_id FROM events)
SELECT query_id, stage, event_id FROM s WHERE (query_id, stage) IN (SELECT query_id, max(stage) FROM s GROUP BY 1)""")
def progressive_view(t):
    """Consumer view of staged result rows."""
    stage = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rows = t.events.select(F.col("user_id").alias("query_id"), stage.alias("stage"), "event_id")
    return ST.newest_stage(rows, ["query_id"]).select("query_id", "stage", "event_id")


@query("incremental_sync_z2", "SELECT doc_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS version, md5(text) AS text_md5 FROM documents")
def incremental_sync(t):
    """Two landings of the corpus (the second repeats English documents) streamed into one keyed table."""
    source, checkpoint = new_path(t.spark, "landing"), new_path(t.spark, "sync-checkpoint")
    rows = t.documents.select("doc_id", "text", F.lit(1).alias("version"))
    rows.write.mode("append").json(source)
    t.documents.where("lang = 'en'").select("doc_id", "text", F.lit(2).alias("version")).write.mode("append").json(source)
    store = sinks.scratch_table(t.spark, "synced", ["doc_id"])
    Z.sync_stream(t.spark, source, rows.schema, store, checkpoint, ["version"]).awaitTermination()
    return store.read().select("doc_id", "version", F.md5("text").alias("text_md5"))


@query("shared_queries_z3", "SELECT event_id, lower(event_type) || ' ' || user_id % 7 AS key, length(lower(event_type) || ' ' || user_id % 7) AS answer FROM events")
def shared_queries(t):
    """One computation per distinct normalised query, shared by all requests."""
    requests = t.events.select("event_id", F.concat(F.initcap("event_type"), F.lit(" - "), (F.col("user_id") % 7).cast("string")).alias("query"))
    out = ST.shared_computation(requests, "query", lambda keys: keys.withColumn("answer", F.length("key")))
    return out.select("event_id", "key", "answer")


@query("latest_state_z4", f"""WITH l AS (SELECT user_id, {_K} AS k, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
SELECT 'per_key' AS slot, user_id, k, event_id, value FROM l WHERE event_type <> 'error' UNION ALL
SELECT 'overall', user_id, arg_max({_K}, event_id), max(event_id), arg_max(value, event_id) FROM events GROUP BY 2""")
def latest_state(t):
    """Latest entry per user and key (errors are tombstones), and the single progress slot per user."""
    rows = logs(t)
    per_key = ST.latest(rows, ["user_id", "k"], ["event_id"], F.col("event_type") == "error")
    overall = ST.latest(rows, ["user_id"], ["event_id"])
    columns = ["slot", "user_id", "k", "event_id", "value"]
    return per_key.withColumn("slot", F.lit("per_key")).select(columns).unionByName(overall.withColumn("slot", F.lit("overall")).select(columns))


@query("series_removal_z4_twin", f"""WITH l AS (SELECT user_id, {_K} AS k, max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1, 2), c AS (SELECT user_id, max(event_id) AS cut FROM events WHERE event_type = 'error' AND {_K} % 10 = 0 GROUP BY 1)
SELECT user_id, k, event_id FROM l LEFT JOIN c USING (user_id) WHERE cut IS NULL OR event_id > cut""")
def series_removal(t):
    rows = logs(t)
    state = ST.latest(rows.where("event_type <> 'error'"), ["user_id", "k"], ["event_id"])
    removals = rows.where("event_type = 'error' AND k % 10 = 0")
    return ST.without_removed(state, removals, ["user_id"], "event_id").select("user_id", "k", "event_id")


@query("streamed_state_z4_stream", f"""SELECT user_id, {_K} AS k, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1, 2""")
def streamed_state(t):
    """The same state kept by a stream over the event table."""
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    rows = stream.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    store = sinks.scratch_table(t.spark, "state", ["user_id", "k"])
    Z.state_stream(rows, ["event_id"], store, new_path(t.spark, "state-checkpoint")).awaitTermination()
    return store.read().select("user_id", "k", "event_id", "event_type")
