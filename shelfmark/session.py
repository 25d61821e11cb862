"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on. Sizes of shuffles and broadcasts stay with
# the cluster's own configuration and adaptive execution.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


# Folder per local application whose session names none (tests).
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app_name: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the library defaults; `conf` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the session is local (tests) a fresh local folder is used and recorded.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{work_dir(spark).rstrip('/')}/shelfmark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts lineage so that a table used several times is computed once, survives
    the loss of executors, and gives the optimizer true sizes (so Catalyst's own
    threshold, not a hint, decides what is broadcast).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_arrow_batches(spark: SparkSession, limit: str = "67108864") -> None:
    """Limit Arrow batches by bytes where the session has no such limit: packed rows are large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    current = int(spark.conf.get(key, "2147483646"))
    if current > int(limit):
        spark.conf.set(key, limit)


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over the session's cores before CPU-heavy work.

    A table that arrives in fewer partitions than there are cores (one small
    file, say) is repartitioned; a large one already has more and is untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if have * 2 <= cores else df
