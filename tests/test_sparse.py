"""Block-max postings: exact results, pruning, storage and growth."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import sparse as SP
from shelfmark.session import new_path

WORDS = re.compile("[a-z0-9]+")


def brute(docs, queries, k):
    """Plain BM25 over dictionaries."""
    counts = {d: Counter(WORDS.findall((t or "").lower())) for d, t in docs}
    n, avgdl = len(docs), sum(sum(c.values()) for c in counts.values()) / len(docs)
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for q, text in queries:
        terms = dict.fromkeys(WORDS.findall(text.lower()))
        idf = {w: math.log((n + 1) / (df.get(w, 1) + 0.5)) for w in terms}
        total = sum(idf.values())
        scores = {}
        for d, c in counts.items():
            length, hit = sum(c.values()), [w for w in terms if w in c]
            if hit:
                scores[d] = sum(idf[w] / total * c[w] / (c[w] + 1.2 * (1 - 0.75 + 0.75 * length / avgdl)) for w in hit)
        best = sorted(scores.items(), key=lambda e: (-round(e[1], 9), e[0]))[:k]
        out.update({(q, r): (d, round(s, 7)) for r, (d, s) in enumerate(best, 1)})
    return out


@pytest.fixture(scope="module")
def corpus():
    docs = [(f"d{i:04d}", f"common {'shared ' * (i % 3)} w{i % 40} r{i // 3} " + "pad " * (i % 7)) for i in range(600)] + [("e1", None), ("e2", "")]
    queries = [(1, "common w7 r50"), (2, "shared"), (3, "nothing here"), (4, "r1 r1 w39 common"), (5, "r199")]
    return docs, queries


@pytest.fixture
def frames(spark, corpus):
    return spark.createDataFrame(corpus[0], "doc_id string, text string"), spark.createDataFrame(corpus[1], "query_id long, query string")


def rows(found):
    return {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 7)) for r in found.collect()}


@pytest.mark.parametrize("k,range_docs", [(3, 256), (5, 8), (40, 8), (700, 16)])
def test_topk_against_brute_force(frames, corpus, monkeypatch, k, range_docs):
    monkeypatch.setattr(SP, "RANGE_DOCS", range_docs)
    docs, queries = frames
    assert rows(SP.SparseIndex.build(docs).top(queries, k)) == brute(*corpus, k)


@pytest.mark.parametrize("aside", [0.0, 0.3, 0.9, 1.0])
def test_topk_does_not_depend_on_what_is_set_aside(frames, corpus, monkeypatch, aside):
    monkeypatch.setattr(SP, "RANGE_DOCS", 16)
    monkeypatch.setattr(SP, "ASIDE", aside)
    docs, queries = frames
    assert rows(SP.SparseIndex.build(docs).top(queries, 6)) == brute(*corpus, 6)


def test_blocks_that_cannot_win_stay_closed(frames, monkeypatch):
    monkeypatch.setattr(SP, "RANGE_DOCS", 8)
    docs, queries = frames
    index, one = SP.SparseIndex.build(docs), queries.where("query_id = 1")
    opened = []
    plain = SP.SparseIndex.postings
    monkeypatch.setattr(SP.SparseIndex, "postings", lambda self, wanted, query="query_id": opened.append(wanted) or plain(self, wanted, query))
    index.top(one, 3).collect()
    every = plain(index, index.query_terms(one)).count()
    assert sum(plain(index, wanted).count() for wanted in opened) < every / 5


def test_one_pass_over_the_folders_of_the_terms(frames, monkeypatch):
    docs, queries = frames
    index = SP.SparseIndex.build(docs)
    plans = []
    plain = SP.materialize
    monkeypatch.setattr(SP, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or plain(df, name))
    plans.append(("result", index.top(queries, 3)._jdf.queryExecution().toString()))
    reads = [(name, scan) for name, plan in plans for scan in re.findall(r"FileScan parquet [^\n]*", plan.split("== Physical Plan ==")[1])
             if re.search(r"PartitionFilters: \[[^\]]*bucket", scan)]
    assert len(reads) == 1 and reads[0][0] == "query-blocks" and "dynamicpruning" in reads[0][1].lower()


def test_append_equals_a_rebuild(spark, frames):
    docs, queries = frames
    path = new_path(spark, "index")
    first = SP.SparseIndex.build(docs.where("doc_id < 'd0400'"), path=path)
    second = first.append(docs.where("doc_id >= 'd0400'"))
    whole = SP.SparseIndex.build(docs)
    assert rows(second.top(queries, 9)) == rows(whole.top(queries, 9)) == rows(SP.SparseIndex.open(spark, path).top(queries, 9))
    assert rows(second.append(docs.limit(0)).top(queries, 9)) == rows(whole.top(queries, 9))
    # What a failed append left behind is not named by the totals.
    spark.read.parquet(f"{path}/blocks").drop("part").write.parquet(f"{path}/blocks/part=lost")
    assert rows(SP.SparseIndex.open(spark, path).top(queries, 9)) == rows(whole.top(queries, 9))
    with pytest.raises(Exception):
        SP.SparseIndex.build(docs, path=path)


def test_pair_scores_and_empty_tables(spark, frames, corpus):
    docs, queries = frames
    index = SP.SparseIndex.build(docs)
    pairs = spark.createDataFrame([(1, "d0007"), (1, "d0001"), (2, "d0000"), (3, "d0000"), (4, "nowhere")], "query_id long, doc_id string")
    got = {(r.query_id, r.doc_id): round(r.score, 7) for r in index.pair_scores(pairs, index.query_terms(queries)).collect()}
    every = {(q, d): s for (q, _), (d, s) in brute(*corpus, 1000).items()}
    assert got == {p: every[p] for p in [(1, "d0007"), (1, "d0001"), (2, "d0000")] if p in every}
    assert index.top(queries.limit(0), 3).count() == 0
    assert SP.SparseIndex.build(docs.limit(0)).top(queries, 3).count() == 0


def test_no_table_holds_a_row_per_query_and_document(spark, frames, corpus, monkeypatch):
    from shelfmark.operators import scoring as SC

    monkeypatch.setattr(SC, "SMALL_PART", 64)
    queries = [(i, f"common shared w{i % 40}") for i in range(100)]
    sizes = []
    for module in (SP, SC):
        plain = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, plain=plain: sizes.append((out := plain(df, name)).count()) or out)
    found = SP.SparseIndex.build(frames[0]).top(spark.createDataFrame(queries, "query_id long, query string"), 3)
    assert rows(found) == brute(corpus[0], queries, 3)
    assert max(sizes) < 100 * 600 / 5


@pytest.mark.parametrize("query_block", [7, 50])
def test_floors_of_the_first_parts_lose_nothing(spark, frames, corpus, monkeypatch, query_block):
    from shelfmark.operators import scoring as SC

    for name, value in (("SMALL_PART", 16), ("TILE", 8), ("QUERY_BLOCK", query_block), ("WORK", 64), ("WAITING", 1)):
        monkeypatch.setattr(SC, name, value)
    queries = [(i, f"common shared w{i % 40} r{i} pad") for i in range(60)]
    found = SP.SparseIndex.build(frames[0]).top(spark.createDataFrame(queries, "query_id long, query string"), 9)
    assert rows(found) == brute(corpus[0], queries, 9)


@pytest.mark.parametrize("k,part_postings", [(3, 1 << 20), (5, 50), (700, 400)])
def test_search_without_an_index_against_brute_force(frames, corpus, monkeypatch, k, part_postings):
    monkeypatch.setattr(SP.SC, "PART_POSTINGS", part_postings)
    assert rows(SP.search(*frames, k)) == brute(*corpus, k)


def test_search_takes_rows_of_one_id_for_one_document(spark, frames, corpus):
    halves = [("x1", "common w7 w7"), ("x1", "w7 r50 pad"), (None, "common r50")]
    docs = spark.createDataFrame(corpus[0] + halves, "doc_id string, text string")
    whole = corpus[0] + [("x1", "common w7 w7 w7 r50 pad"), ("", ""), ("none", "common r50")]
    expected = {key: hit for key, hit in brute(whole, corpus[1], 700).items() if hit[0] != "none"}
    found = rows(SP.search(docs, frames[1], 700))
    assert {(q, *hit) for (q, _), hit in found.items()} == {(q, *hit) for (q, _), hit in expected.items()}


def test_search_of_nothing(frames):
    docs, queries = frames
    assert SP.search(docs.limit(0), queries, 3).count() == 0
    assert SP.search(docs, queries.limit(0), 3).count() == 0
    assert SP.search(docs, queries.where("query_id = 3"), 3).count() == 0


def test_search_moves_the_postings_that_are_asked_for(spark, frames, tmp_path, monkeypatch):
    """Only terms of the queries leave the tasks that read the texts."""
    written = {}
    kept = SP.materialize

    def noted(df, name, *more):
        written[name] = kept(df, name, *more)
        return written[name]

    monkeypatch.setattr(SP, "materialize", noted)
    docs, queries = frames
    SP.search(docs, queries.where("query_id = 5"), 3)
    assert written["asked-postings"].where("no IS NOT NULL").count() == 3


def test_parts_are_bounded_by_postings():
    """What a task packs grows neither with the documents nor with their length."""
    assert SP.SC.parts_for(100) == 1
    assert SP.SC.parts_for(100, 5 * SP.SC.PART_POSTINGS) == 5
    assert SP.SC.parts_for(64 * SP.SC.PART_DOCS, 5 * SP.SC.PART_POSTINGS) == 64


def test_parts_of_an_index_are_bounded_by_the_postings_asked_for(frames, monkeypatch):
    monkeypatch.setattr(SP.SC, "PART_POSTINGS", 50)
    made, plain = [], SP.SC.doc_parts
    monkeypatch.setattr(SP.SC, "doc_parts", lambda *a: made.append(plain(*a)) or made[-1])
    SP.SparseIndex.build(frames[0]).top(frames[1], 3).count()
    assert made[0].selectExpr("max(octet_length(weights))").first()[0] < 8 * 50 * 3


def test_a_part_sends_little_more_than_k_documents_to_the_cut(monkeypatch):
    """Postings are added up, and the k-th best so far leaves the others of a part out."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    n, asked, k = 5000, 300, 5
    entries = pd.DataFrame({"part": 0, "doc": np.tile(np.arange(n), 3), "no": np.repeat([1, 2, 3], n), "weight": rng.random(3 * n)})
    entries = entries[rng.random(3 * n) < 0.5]
    weights = rng.random((asked, 3))
    pack = lambda a, t: np.asarray(a, dtype=t).tobytes()
    block = pd.DataFrame([{
        "sizes": pack([4] * asked, "<i8"), "q_nos": pack([-1, 1, 2, 3] * asked, "<i8"), "q_weights": pack(np.c_[np.zeros(asked), weights].ravel(), "<f8"),
        "q_vectors": b"", "floors": pack([-np.inf] * asked, "<f8")}])
    cuts, plain = [], SP.SC._cut
    monkeypatch.setattr(SP.SC, "_cut", lambda found, k: cuts.append(sum(len(f[0]) for f in found)) or plain(found, k))
    row = next(pd.concat([SP.SC._part(entries), block], axis=1).itertuples(index=False))
    q, d, s = SP.SC._pair(row, k, 2e-9)
    d = np.asarray(row.docs)[d]
    full = np.zeros((4, n))
    full[entries["no"], entries["doc"]] = entries["weight"]
    best = weights @ full[1:]
    order = np.lexsort((np.broadcast_to(np.arange(n), best.shape), -best.round(9)))[:, :k]
    assert (d.reshape(asked, k) == order).all() and np.allclose(s.reshape(asked, k), np.take_along_axis(best, order, 1))
    assert max(cuts) <= 2 * k * asked


def test_what_parts_find_stays_packed_by_blocks(spark, frames, corpus, monkeypatch):
    """No task sorts a row per query and document, and the planner sees no copies of queries or parts that it could broadcast."""
    for name, value in (("SMALL_PART", 16), ("QUERY_BLOCK", 7)):
        monkeypatch.setattr(SP.SC, name, value)
    sizes, plain = {}, SP.SC.materialize
    monkeypatch.setattr(SP.SC, "materialize", lambda df, name: sizes.update({name: (out := plain(df, name)).count()}) or out)
    queries = [(i, f"common shared w{i % 40} r{i} pad") for i in range(60)]
    found = SP.search(frames[0], spark.createDataFrame(queries, "query_id long, query string"), 9)
    assert rows(found) == brute(corpus[0], queries, 9)
    assert sizes["first-scored"] == sizes["query-packs"] >= 9
