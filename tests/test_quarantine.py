"""Resumed loads: processed, failed, retried and broken rows."""

from pyspark.sql import functions as F

from shelfmark.sources import quarantine as Q


def corpus(rows, error):
    return rows.select(F.col("id").alias("queue_id"), F.col("id").alias("item_id"), F.lit("t").alias("title"), F.lit("manga").alias("type"),
                       F.lit("x").alias("text"), error.alias("error"))


def test_broken_lines_are_reported(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.json").write_text('{"queue_id":1,"item_id":1,"text":"a"}\n\n{"queue_id":2,"item_\n{"item_id":3}\n{"queue_id":"x"}\n[]\nnull\n{"queue_id":4,"more":5}\n')
    rows, broken = Q.read_split(spark, str(folder))
    assert sorted(r["queue_id"] for r in rows.collect()) == [1, 4]
    got = {r["raw"]: r["error"] for r in broken.collect()}
    assert got['{"item_id":3}'] == "missing queue_id" and got['{"queue_id":2,"item_'] == "malformed line" and got['{"queue_id":"x"}'] == "malformed line"
    assert set(got) == {'{"queue_id":2,"item_', '{"item_id":3}', '{"queue_id":"x"}', "[]", "null"}


def test_failures_are_retried_until_they_settle(spark, tmp_path):
    output, failed = str(tmp_path / "out"), str(tmp_path / "failed")
    queue = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long")
    runs = []

    def process(rows):
        runs.append(sorted(r["id"] for r in rows.collect()))
        bad = (F.col("id") == 3) | ((F.col("id") == 2) & (F.col("attempts") == 0))
        return corpus(rows, F.when(bad, F.concat(F.lit("try "), F.col("attempts").cast("string"))))

    seen = []
    for _ in range(3):
        got = Q.run(queue, "id", process, output, failed, tries=2)
        seen.append({r["id"]: (r["state"], r["attempts"], r["error"]) for r in got.collect()})
    assert runs == [[1, 2, 3], [2, 3], []]
    assert seen[0] == {1: ("done", 0, None), 2: ("retry", 1, "try 0"), 3: ("retry", 1, "try 0"), None: ("open", 0, None)}
    assert seen[1] == seen[2] == {1: ("done", 0, None), 2: ("done", 1, None), 3: ("failed", 2, "try 1"), None: ("open", 0, None)}
    assert spark.read.json(output).count() == 2


def test_lines_cut_by_a_crash_are_processed_again(spark, tmp_path):
    output, failed = str(tmp_path / "out"), str(tmp_path / "failed")
    queue = spark.range(4)
    none = F.lit(None).cast("string")
    Q.run(queue.where("id < 2"), "id", lambda rows: corpus(rows, none), output, failed)
    spark.createDataFrame([('{"queue_id":2,"te',)], "value string").write.mode("append").text(output)
    assert {r["id"]: r["state"] for r in Q.states(queue, "id", output, failed).collect()} == {0: "done", 1: "done", 2: "open", 3: "open"}
    got = Q.run(queue, "id", lambda rows: corpus(rows, none), output, failed)
    assert {r["state"] for r in got.collect()} == {"done"} and Q.read_split(spark, output)[1].count() == 1
