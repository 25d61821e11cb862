"""Numbering and order statistics under hot groups and outliers, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import chapters as C, ranking as R


def test_range_rank_numbers_hot_cold_and_null_groups(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randint(0, 9)) for _ in range(3000)] + [("hot", 10**12)] + [("cold", 5), (None, 4), (None, 3)]
    table = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(table, "id long, k string, v long")
    got = R.range_rank(df, ["k"], [F.desc("v"), "id"]).collect()
    want = {}
    for k in ("hot", "cold", None):
        for n, r in enumerate(sorted((r for r in table if r[1] == k), key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = n
    assert {r["id"]: r["rank"] for r in got} == want and set(got[0].asDict()) == {"id", "k", "v", "rank"}
    assert R.range_rank(df.limit(0), ["k"], ["v", "id"]).count() == 0


def test_range_index_spreads_a_hot_group(spark, monkeypatch):
    """One group of nearly all rows with one far value is cut in ranges of like size."""
    seen = {}
    kept = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name, *a: seen.setdefault(name, kept(df, name, *a)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(8000).selectExpr("CASE WHEN id = 7 THEN 1e15 ELSE id % 50 END AS v", "id")
        got = R.range_index(df, ["v", "id"]).orderBy("index").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["index"] for r in got] == list(range(8000)) and [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)
    sizes = [r["count"] for r in seen["ranges"].groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 4000
    plan = R.range_index(df, ["v", "id"])._jdf.queryExecution().optimizedPlan().toString()
    numbered = [line for line in plan.split("\n") if "row_number()" in line and "Window" in line]
    assert numbered and all("_range" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in numbered)


@pytest.mark.parametrize("at_once, buckets", [(100_000, 64), (8, 4), (1, 2)])
def test_value_at_rank_with_an_outlier_and_a_hot_value(spark, at_once, buckets):
    rng = random.Random(4)
    groups = {
        "wide": [rng.random() for _ in range(400)] + [1e300, -1e300],
        "same": [2.0] * 300 + [3.0],
        "one": [9.0],
        "ties": [float(rng.randint(0, 40)) for _ in range(300)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("wide", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for position, at in ((F.floor(F.col("n") / 2), lambda n: n // 2), (F.col("n") - 1, lambda n: n - 1), (F.lit(0), lambda n: 0)):
        got = {r["k"]: (r["n"], r["v"]) for r in R.value_at_rank(df, ["k"], "v", position, buckets, at_once).collect()}
        assert got == {k: (len(v), sorted(v)[at(len(v))]) for k, v in groups.items()}


def test_reader_order(spark):
    rows = [("10", "x", "u10"), ("2", "x", "u2"), (None, "Omake", "ux"), (None, "afterword", "uy"), ("1.5", None, "u1")]
    df = spark.createDataFrame([("s", n, t, u, i) for i, (n, t, u) in enumerate(rows)], "s string, number string, title string, url string, pos long")
    assert [r["url"] for r in C.reader_ordered(df, ["s"]).orderBy("index").collect()] == ["u1", "u2", "u10", "uy", "ux"]


def test_value_at_rank_when_percentiles_differ_between_evaluations(spark, monkeypatch):
    noise = F.udf(lambda edges: [e + random.SystemRandom().uniform(-30, 30) for e in edges], "array<double>").asNondeterministic()
    plain = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: noise(plain(*a)))
    df = spark.range(2000).selectExpr("id % 4 AS k", "CAST(id AS DOUBLE) AS v")
    got = {r["k"]: (r["n"], r["v"]) for r in R.value_at_rank(df, ["k"], "v", F.floor(F.col("n") / 2), 4, 50).collect()}
    assert got == {k: (500, 1000.0 + k) for k in range(4)}
