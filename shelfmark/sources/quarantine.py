"""Loads that can be resumed: processed keys come from the output itself, rows that fail have a table of their own.

The output and the failed rows are folders of JSON lines. A line of the output
that cannot be read (cut by a crash, say) or lacks its key counts as not
processed; it is reported, never silently dropped. A key that fails is retried
by the next run until it has failed `tries` times; it is settled once the
output holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from shelfmark.session import materialize

from .readers import CORPUS_SCHEMA

FAILED_SCHEMA = "key string, error string, attempt int"
_CORRUPT = "_corrupt_record"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder; none where nothing has been written yet."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")
    return lines.where(F.trim("value") != "")


def read_split(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, required: tuple[str, ...] = ("queue_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): the lines that can be read, and the others as (raw, error)."""
    fields = StructType(_parse_datatype_string(schema).fields).add(_CORRUPT, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = _lines(spark, path).select("value", F.from_json("value", fields, options).alias("r"))
    error = F.when(F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull(), "malformed line")
    for name in required:
        error = error.when(F.col(f"r.{name}").isNull(), f"missing {name}")
    judged = parsed.withColumn("error", error)
    names = [f"r.{f.name}" for f in fields if f.name != _CORRUPT]
    return judged.where("error IS NULL").select(*names), judged.where("error IS NOT NULL").select(F.col("value").alias("raw"), "error")


def failures(spark: SparkSession, path: str) -> DataFrame:
    """(key, error, attempts): the last error of every key that has failed, and how often it did."""
    rows = read_split(spark, path, FAILED_SCHEMA, ("key", "attempt"))[0]
    return rows.groupBy("key").agg(F.max_by("error", F.struct("attempt", "error")).alias("error"), F.max("attempt").alias("attempts"))


def states(queue: DataFrame, key: str, output: str, failed: str, tries: int = 3) -> DataFrame:
    """`queue` with `state` (done, failed, retry or open), `attempts` that failed and the last `error`.

    Rows of the queue whose key is null are open. A failed key is to be retried
    while it has failed fewer than `tries` times.
    """
    spark = queue.sparkSession
    done = read_split(spark, output)[0].select(F.col("queue_id").cast("string").alias("_key")).distinct().withColumn("_done", F.lit(True))
    known = failures(spark, failed).withColumnRenamed("key", "_key")
    joined = queue.withColumn("_key", F.col(key).cast("string")).join(done, "_key", "left").join(known, "_key", "left")
    state = (
        F.when(F.col("_done"), "done").when(F.col("attempts").isNull(), "open").when(F.col("attempts") < tries, "retry").otherwise("failed")
    )
    return joined.select(*[F.col(c) for c in queue.columns], state.alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
                         F.when(~F.coalesce("_done", F.lit(False)), F.col("error")).alias("error"))


def run(queue: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], output: str, failed: str, tries: int = 3) -> DataFrame:
    """Process the open and the retried rows of `queue`; returns its states afterwards.

    `process` maps the rows (with their `attempts`) to rows of the corpus schema
    with an `error`, null where the row is good. It runs once; its result is
    written before the two folders are appended to.
    """
    todo = states(queue, key, output, failed, tries).where(F.col("state").isin("open", "retry")).where(F.col(key).isNotNull())
    todo = materialize(todo.drop("state", "error"), "todo")
    rows = materialize(process(todo), "processed")
    names = [f.name for f in _parse_datatype_string(CORPUS_SCHEMA)]
    rows.where("error IS NULL").select(*names).write.mode("append").json(output)
    before = todo.select(F.col(key).cast("string").alias("key"), "attempts").groupBy("key").agg(F.max("attempts").alias("attempts"))
    bad = rows.where("error IS NOT NULL").select(F.col("queue_id").cast("string").alias("key"), "error").join(before, "key")
    bad.select("key", "error", (F.col("attempts") + 1).alias("attempt")).write.mode("append").json(failed)
    return states(queue, key, output, failed, tries)
