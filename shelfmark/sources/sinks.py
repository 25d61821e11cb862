"""Writers: keyed tables (upsert, delete, stale delete), append, statistics tables, reports, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from shelfmark.session import materialize, new_path


def last_per_key(incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key along `order`, with map-side combine."""
    rest = [c for c in incoming.columns if c not in keys]
    if not rest:
        return incoming.distinct()
    latest = F.struct(*[F.col(c) for c in order])
    return incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), latest).alias("_r")).select(*keys, "_r.*").select(*incoming.columns)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows without an incoming key, plus the last incoming row of each key along `order`."""
    last = last_per_key(incoming, keys, order)
    return _without(existing, last, keys).unionByName(last)


def without_stale(existing: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `existing` whose key is still expected."""
    return existing.join(expected.select(*keys), keys, "left_semi")


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a key of `gone`; a null key equals a null key."""
    named = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys])
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys], "left_anti")


# Partition columns of a keyed table and the flag that tells its rows from bucket markers.
_OF, _BUCKET, _LIVE = "_of", "_bucket", "_live"


class KeyedTable:
    """A Parquet table with one row per key, laid out by a hash of the key.

    Rows lie in `buckets` folders by the hash of their key. An upsert or a
    delete rewrites the buckets that hold a changed key and leaves all others,
    file names included, as they are: the buckets touched come from the changed
    keys, the scan reads those folders only, and the write replaces folders by
    dynamic partition overwrite (new files are staged and moved in at the end of
    the job). Repeating a write that failed gives the same table. A touched
    bucket keeps a marker row, so that one that lost all rows is replaced too.

    The number of buckets is fixed by the first write and read off the folder
    names later; choose it so that a bucket is about one file of the table. A
    bucket is written by one task, keys being unique in it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 32):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.buckets = buckets

    def _stored(self) -> DataFrame | None:
        """All rows with bucket columns and markers; None before the first write."""
        try:
            found = self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return found

    def exists(self) -> bool:
        return self._stored() is not None

    def read(self) -> DataFrame:
        stored = self._stored()
        if stored is None:
            raise AnalysisException(f"no table under {self.path}")
        return stored.where(_LIVE).drop(_OF, _BUCKET, _LIVE)

    def _open(self) -> DataFrame | None:
        """The stored rows, with the number of buckets taken from the folders."""
        stored = self._stored()
        if stored is not None:
            # A partition column: the answer comes from folder names, one row is looked at.
            first = stored.select(_OF).first()
            self.buckets = first[0] if first else self.buckets
        return stored

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the bucket of their key."""
        return rows.withColumn(_OF, F.lit(self.buckets)).withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _save(self, rows: DataFrame, mode: str) -> None:
        """`rows` with bucket columns; a marker is added to each of `touched` buckets by the caller."""
        rows.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(_OF, _BUCKET).parquet(self.path)

    def _markers(self, buckets: DataFrame, schema) -> DataFrame:
        columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in (_OF, _BUCKET, _LIVE)]
        return buckets.select(*columns, F.lit(False).alias(_LIVE), F.lit(self.buckets).alias(_OF), _BUCKET)

    def write(self, rows: DataFrame) -> DataFrame:
        """Replace the whole table; keys must be unique."""
        placed = self.placed(rows).withColumn(_LIVE, F.lit(True))
        # One marker, so that an empty table has files too.
        first = self.spark.range(1).select(F.lit(0).alias(_BUCKET))
        self._save(placed.unionByName(self._markers(first, placed.schema)), "static")
        return self.read()

    def _rewrite(self, touched: DataFrame, stored: DataFrame, change) -> DataFrame:
        """Replace the touched buckets by `change` of their rows."""
        # The filter on the touched side lets the scan skip folders at run time.
        wanted = touched.where(f"{_BUCKET} >= 0")
        here = stored.where(_LIVE).join(wanted, _BUCKET, "left_semi")
        new = change(here).withColumn(_LIVE, F.lit(True))
        self._save(new.unionByName(self._markers(touched, new.schema)), "dynamic")
        return self.read()

    def upsert(self, incoming: DataFrame, order: list[str]) -> DataFrame:
        """Put the last incoming row of each key along `order` in place of the stored one."""
        stored = self._open()
        if stored is None:
            return self.write(last_per_key(incoming, self.keys, order))
        last = materialize(self.placed(last_per_key(incoming, self.keys, order)), "upsert")
        touched = materialize(last.select(_BUCKET).distinct(), "upsert-buckets")

        def change(here: DataFrame) -> DataFrame:
            return _without(here.drop(_LIVE), last, self.keys).unionByName(last)

        return self._rewrite(touched, stored, change)

    def delete(self, gone: DataFrame) -> DataFrame:
        """Remove the rows with a key of `gone`."""
        stored = self._open()
        if stored is None:
            raise AnalysisException(f"no table under {self.path}")
        keys = materialize(self.placed(gone.select(*self.keys).distinct()), "delete")
        touched = materialize(keys.select(_BUCKET).distinct(), "delete-buckets")
        return self._rewrite(touched, stored, lambda here: _without(here.drop(_LIVE), keys, self.keys))

    def delete_stale(self, expected: DataFrame) -> DataFrame:
        """Remove the rows whose key is not in `expected`; only the keys are read to find them."""
        return self.delete(_without(self.read().select(*self.keys), expected, self.keys))


def append_corpus(df: DataFrame, path: str) -> None:
    """Append documents as JSON lines."""
    df.write.mode("append").json(path)


def write_report(summary: DataFrame, detail: DataFrame, config: dict, path: str) -> None:
    """Evaluation report: configuration and summary row, with the detail rows beside it."""
    described = reduce(lambda d, kv: d.withColumn(f"config_{kv[0]}", F.lit(kv[1])), sorted(config.items()), summary)
    described.write.mode("overwrite").json(f"{path}/summary")
    detail.write.mode("overwrite").partitionBy("medium").json(f"{path}/detail")


def export_rows(rows: DataFrame, keys: list[str], fragment: str, order: list[str], fields: list[str]) -> DataFrame:
    """JSON arrays per key, cut into fragments so that no key is gathered whole.

    Concatenating a key's fragments in descending fragment order gives the
    full newest-first list.
    """
    entry = F.struct(*[F.col(c) for c in order], F.struct(*fields).alias("entry"))
    listed = F.reverse(F.array_sort(F.collect_list(entry)))
    return rows.groupBy(*keys, fragment).agg(
        F.count("*").alias("n"), F.to_json(F.transform(listed, lambda e: e["entry"])).alias("json")
    )


def scratch_table(spark: SparkSession, name: str, keys: list[str], buckets: int = 32) -> KeyedTable:
    return KeyedTable(spark, new_path(spark, name), keys, buckets)
