"""Keyed tables: only the buckets of changed keys are rewritten."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.session import new_path
from shelfmark.sources.sinks import KeyedTable, scratch_table


def files(table):
    found = glob.glob(f"{table.path}/**/*.parquet", recursive=True)
    return {f: os.stat(f).st_mtime_ns for f in found}


def folders(changed):
    return {os.path.dirname(f) for f in changed}


@pytest.fixture
def table(spark):
    t = scratch_table(spark, "keyed", ["k"], 16)
    t.write(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(0).alias("seq")))
    return t


def test_upsert_rewrites_touched_buckets_only(spark, table):
    before = files(table)
    new = spark.createDataFrame([(3, "a", 1), (3, "b", 2), (5000, "c", 1)], "k long, v string, seq int")
    rows = {r.k: r.v for r in table.upsert(new, ["seq"]).collect()}
    after = files(table)
    assert len(rows) == 1001 and rows[3] == "b" and rows[5000] == "c" and rows[4] == "old"
    touched = {r[0] for r in table.placed(new.select("k")).select("_bucket").collect()}
    gone = {f for f in before if after.get(f) != before[f]}
    assert folders(gone) == {f"{table.path}/_of=16/_bucket={b}" for b in touched} and len(touched) <= 2
    assert {f: t for f, t in before.items() if f not in gone} == {f: t for f, t in after.items() if f in before}
    again = {r.k: r.v for r in table.upsert(new, ["seq"]).collect()}
    assert again == rows


def test_scan_of_an_upsert_skips_folders(spark, table):
    touched = table.placed(spark.createDataFrame([(3,)], "k long")).select("_bucket")
    plan = table._stored().join(touched.where("_bucket >= 0"), "_bucket", "left_semi")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_delete_empties_buckets(spark, table):
    before = files(table)
    one = table.placed(spark.range(1000).select(F.col("id").alias("k"))).where("_bucket = 5").select("k")
    n = one.count()
    assert n > 0 and table.delete(one).count() == 1000 - n
    after = files(table)
    assert {os.path.dirname(f) for f in before if f not in after} == {f"{table.path}/_of=16/_bucket=5"}
    assert table.delete_stale(spark.createDataFrame([(1,), (2,), (9999,)], "k long")).count() == 2
    assert table.delete_stale(spark.createDataFrame([], "k long")).count() == 0 and table.exists()
    assert table.upsert(spark.createDataFrame([(7, "x", 1)], "k long, v string, seq int"), ["seq"]).count() == 1


def test_number_of_buckets_is_the_folder_s(spark, table):
    other = KeyedTable(spark, table.path, ["k"], 999)
    assert other.upsert(spark.createDataFrame([(1, "x", 1)], "k long, v string, seq int"), ["seq"]).count() == 1000
    assert {os.path.basename(os.path.dirname(os.path.dirname(f))) for f in files(other)} == {"_of=16"}


def test_nulls_empty_input_and_missing_tables(spark):
    t = KeyedTable(spark, new_path(spark, "none"), ["a", "b"], 4)
    assert not t.exists()
    with pytest.raises(Exception, match="no table"):
        t.read()
    rows = spark.createDataFrame([(None, "x", 1), (None, "x", 2), (1, None, 1)], "a long, b string, n int")
    assert sorted((r.a, r.b, r.n) for r in t.upsert(rows, ["n"]).where("a IS NULL").collect()) == [(None, "x", 2)]
    before = files(t)
    assert t.upsert(rows.limit(0), ["n"]).count() == 2 and files(t) == before
    assert t.upsert(spark.createDataFrame([(None, "x", 9)], rows.schema), ["n"]).where("a IS NULL").first().n == 9
    assert t.delete(spark.createDataFrame([(None, "x")], "a long, b string")).count() == 1
