"""Incremental sync, progressive results, query dedupe and live reader state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions import text as T
from shelfmark.sources.sinks import KeyedTable

# Order of the result stages a consumer sees.
STAGES = {"primary": 0, "title_alias": 1, "final": 2}


def sync_stream(
    spark: SparkSession, source: str, schema, store: KeyedTable, checkpoint: str, order: list[str],
    fmt: str = "json", files_per_trigger: int = 100,
) -> StreamingQuery:
    """Upsert newly landed files into a keyed table and stop when all are read.

    Resumes from its checkpoint; a batch that is replayed after a failure
    upserts the same keys again, so the result does not change.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source)

    def apply(batch: DataFrame, _: int) -> None:
        valid = batch.where(F.coalesce(*[F.col(k).cast("string") for k in store.keys]).isNotNull())
        store.upsert(valid, order)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progressive_stream(
    queries: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str,
    every: str | None = "650 milliseconds",
) -> StreamingQuery:
    """Answer a stream of queries stage by stage, appending each stage's rows with its ordinal.

    The trigger interval bounds how often intermediate results appear; with
    `every=None` the stream handles what is there and stops.
    """
    def apply(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            for name, run in stages.items():
                run(held).withColumn("stage", F.lit(STAGES[name])).write.mode("append").parquet(path)
        finally:
            held.unpersist()

    writer = queries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def deduped_queries(stream: DataFrame, query: str = "query", at: str = "ts", ttl: str = "300 seconds") -> DataFrame:
    """The first of equal normalised queries within the time to live."""
    return stream.withColumn("key", T.title_norm_cjk(F.col(query))).withWatermark(at, ttl).dropDuplicatesWithinWatermark(["key"])


def state_stream(
    events: DataFrame, order: list[str], store: KeyedTable, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Keep the last event per key in a keyed table; tombstones stay in it as last events.

    The aggregate runs in update mode, so a batch carries changed keys only.
    """
    keys = store.keys
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")

    def apply(batch: DataFrame, _: int) -> None:
        store.upsert(batch, order)

    writer = last.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
