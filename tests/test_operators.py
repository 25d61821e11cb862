"""Operators against brute force and hand-worked rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import similarity as SIM, text as T, titles as TT
from shelfmark.operators import blocking as B, chapters as C, evaluation as EV, matching as M, pages as PG, ranking as R, sparse as SP
from shelfmark.sources import readers, sinks
from shelfmark.streaming import jobs as Z

NAMES = ["red ring", "red rings", "the red ring of fire", "ring", "blue bolt", "bluue bolt", "bolt of blue", "bolts", "aa", "redring saga two",
         "small gear box", "gear box small", "smal gear bx", "fire", "the of", "saga of the red ring of fire two"]


def test_fuzzy_pairs_are_complete(spark):
    q = spark.createDataFrame([(n,) for n in NAMES], "q string")
    c = q.withColumnRenamed("q", "c")
    got = {(r["q"], r["c"]) for r in M.fuzzy_pairs(q, c, 0.88).collect()}
    both = q.join(c, F.lit(True)).withColumns({"qt": SIM.distinct_tokens(F.col("q")), "ct": SIM.distinct_tokens(F.col("c"))})
    full = both.select("q", "c", SIM.title_similarity(F.col("q"), F.col("c"), F.col("qt"), F.col("ct")).alias("s")).where("s >= 0.88")
    assert got == {(r["q"], r["c"]) for r in full.collect()}


def test_listing_pairs_are_complete(spark):
    q = spark.createDataFrame([(n,) for n in NAMES], "q string")
    c = q.withColumnRenamed("q", "c")
    got = {(r["q"], r["c"]) for r in M.listing_pairs(q, c).collect()}
    full = q.join(c, F.lit(True)).withColumn("s", SIM.listing_title_score(TT.listing_norm(F.col("q")), TT.listing_norm(F.col("c")))).where("s >= 0.58")
    assert got == {(r["q"], r["c"]) for r in full.collect()}


def test_alias_lookup_pairs_are_complete(spark):
    q = spark.createDataFrame([(n,) for n in NAMES], "q string")
    c = q.withColumnRenamed("q", "c")
    got = {(r["q"], r["c"]) for r in M.alias_lookup_pairs(q, c).collect()}
    full = q.join(c, F.lit(True)).withColumn("s", SIM.fuzzy_title_score(F.col("q"), F.col("c"))).where("s >= 0.72")
    assert got == {(r["q"], r["c"]) for r in full.collect()}


def test_containment_pairs(spark):
    words = ["a", "ab", "abc", "xabcx", "bc", "zzz", "abcabc"]
    q = spark.createDataFrame([(w,) for w in words], "q string")
    got = {(r["q"], r["c"]) for r in B.containment_pairs(q, q.withColumnRenamed("q", "c")).collect()}
    assert got == {(x, y) for x, y in itertools.product(words, words) if x in y or y in x}


def test_grouped_rank_and_value_at_rank(spark):
    rows = [("hot", i % 97) for i in range(500)] + [("cold", 3), (None, 1)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "id long, k string, v long")
    got = R.grouped_rank(df, ["k"], F.floor(F.col("v") / 10), ["v", "id"]).collect()
    assert sorted(r["rank"] for r in got if r["k"] == "hot") == list(range(1, 501))
    mid = {r["k"]: r["v"] for r in R.value_at_rank(df.where("k is not null"), ["k"], "v", F.floor(F.col("n") / 2), 7).collect()}
    assert mid == {"hot": sorted(v for k, v in rows if k == "hot")[250], "cold": 3}


def test_upsert_twice_is_once_and_last_wins(spark):
    table = sinks.scratch_table(spark, "t", ["id"], 4)
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, v string, seq int")
    once = sorted(map(tuple, table.upsert(new, ["seq"]).collect()))
    twice = sorted(map(tuple, table.upsert(new, ["seq"]).collect()))
    assert once == twice == [(1, "b", 2), (2, "c", 1)]


def test_corpus_reader_modes(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"item_id": 1, "title": "a"}\n\n{broken\n')
    assert readers.read_corpus(spark, str(tmp_path), strict=False).count() == 1
    with pytest.raises(Exception):
        readers.read_corpus(spark, str(tmp_path)).collect()


def test_alias_map_file_shapes(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"anime:5": {"title": "X", "synonyms": ["x", "Y"]}, "7": ["Z", "Unknown"], "k": {"mal_id": 9, "type": "Manga", "title": "W"}}')
    got = {tuple(r) for r in readers.read_alias_map(spark, str(tmp_path / "map.json")).collect()}
    assert got == {("anime", 5, 0, "X"), ("anime", 5, 1, "Y"), ("*", 7, 0, "Z"), ("manga", 9, 0, "W")}
    (tmp_path / "list.json").write_text('[{"mal_id": 3, "type": "ova", "title": "L"}, 4]')
    assert [tuple(r) for r in readers.read_alias_map(spark, str(tmp_path / "list.json")).collect()] == [("*", 3, 0, "L")]
    (tmp_path / "bad.json").write_text("{")
    assert readers.read_alias_map(spark, str(tmp_path / "bad.json")).count() == 0


def test_invalid_case_aborts(spark):
    bad = spark.createDataFrame([("c1", "manga", "plot", "q", "t", 1)], readers.CASE_SCHEMA)
    with pytest.raises(Exception, match="invalid case"):
        readers.validated_cases(bad).collect()


def test_chapter_order(spark):
    rows = [("10", None), ("2", None), ("Prologue", None), ("1.5", None), ("3 bonus", None), ("", "Omake")]
    df = spark.createDataFrame([("s", n, t, f"https://h/{i}", i) for i, (n, t) in enumerate(rows)], "s string, number string, title string, url string, pos long")
    got = [r["number"] or r["title"] for r in C.ordered(df, ["s"]).orderBy("index").collect()]
    assert got == ["1.5", "2", "10", "3 bonus", "Omake", "Prologue"]


def test_page_extraction(spark):
    html = ('<title>Big Sword</title><div class="chapters"><a href="/manga/big/chapter-2">Chapter 2</a><a href="/manga/big/chapter-1">one</a>'
            '<a href="/manga/other/chapter-1">Chapter 1</a><a href="/genre/chapter-9">Chapter 9</a></div><noscript><a href="/manga/big/chapter-5">x</a></noscript>'
            '<div id="reader"><img data-src="/uploads/1.jpg" width="10" height="20"><img srcset="/logo.png 1x, /uploads/2.png 2x"></div>')
    pages = spark.createDataFrame([(1, "https://h.com/manga/big/chapter-2", html)], "page_id long, url string, html string")
    rows = PG.elements(pages)
    assert {r["url"] for r in PG.chapter_links(rows, pages).collect()} == {"https://h.com/manga/big/chapter-2", "https://h.com/manga/big/chapter-1"}
    assert sorted(r["url"] for r in PG.panel_candidates(rows, pages).collect()) == ["https://h.com/uploads/1.jpg", "https://h.com/uploads/2.png"]
    assert PG.page_metadata(rows, pages).first()["title"] == "Big Sword"


def test_suite_expansion(spark):
    seeds = spark.createDataFrame([(i, "manga", f"t{i}", "d", "k") for i in range(3)], "seed_pos int, medium string, title string, descriptor string, keyword string")
    got = {r["case_id"]: r["query"] for r in EV.build_suite(seeds, 3, ["a {title}", "b {title}"], 7, "x").collect()}
    assert got == {"x-manga-001": "a t0", "x-manga-002": "a t1", "x-manga-003": "a t2", "x-manga-004": "b t0", "x-manga-005": "b t1",
                   "x-manga-006": "b t2", "x-manga-007": "a t0"}


def test_streaming_dedupe_and_progressive(spark, tmp_path):
    src = str(tmp_path / "q")
    spark.createDataFrame([(1, "One Piece", "2024-01-01 00:00:00"), (2, "one  piece!", "2024-01-01 00:01:00"), (3, "other", "2024-01-01 00:02:00")],
                          "id long, query string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema("id long, query string, ts timestamp").parquet(src)
    q = Z.deduped_queries(stream).writeStream.format("memory").queryName("dq").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("dq").count() == 2
    stages = {"primary": lambda d: d.select("id"), "final": lambda d: d.select("id")}
    Z.progressive_stream(stream, stages, str(tmp_path / "out"), str(tmp_path / "c2"), None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("stage").count().count() == 2


def test_collapse_handles_unicode_spaces(spark):
    df = spark.createDataFrame([("a b\x85c ",)], "s string")
    assert df.select(T.collapse(F.col("s")).alias("v")).first()["v"] == "a b c"


def test_upsert_reduces_incoming_duplicates(spark):
    from shelfmark.sources.sinks import upserted

    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, upserted(old, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "c"), (3, "e")]


def test_alias_choices_score_every_item_of_a_title(spark):
    from shelfmark.plans.search import alias_choices

    queries = spark.createDataFrame([(1, "thunder garden saga")], "query_id long, query string")
    titles = spark.createDataFrame(
        [(1, 0, "Blue Bolt"), (2, 0, "Blue Bolt"), (2, 1, "Thunder Garden Saga")], "item_id long, pos int, title string"
    )
    assert [(r.item_id, round(r.score, 6)) for r in alias_choices(queries, titles).collect()] == [(2, 1.0)]
