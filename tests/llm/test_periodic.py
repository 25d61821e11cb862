"""Periodic runs against brute force, the extensions against plain comparison, and awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shelfmark.llm import periodic, queries
from tests.llm.test_llm import FOLDER, LONG, ODD, table


def brute_runs(words):
    """Every maximal stretch of every period, whose smallest period it is."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            stretch = words[a:a + length]
            smaller = any(stretch[p:] == stretch[:-p] for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def got_runs(words):
    start, length, period = periodic.find_runs(np.unique(np.array(words), return_inverse=True)[1].astype(np.int32))
    return list(zip(start.tolist(), length.tolist(), period.tolist()))


def test_cover_has_every_difference():
    for modulus in (7, 13, 31, 64):
        cover = periodic.difference_cover(modulus)
        assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))
    assert len(periodic.COVER) <= 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_extensions_against_plain_comparison(values):
    x = np.array(values, dtype=np.int32)
    pairs = [(i, j) for j in range(len(values)) for i in range(j)]
    if not pairs:
        return
    i, j = np.array(pairs).T
    want = []
    for a, b in pairs:
        k = 0
        while b + k < len(values) and values[a + k] == values[b + k]:
            k += 1
        want.append(k)
    assert periodic.Extensions(x)(i, j).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_against_brute_force(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert got_runs(words) == brute_runs(words)


@pytest.mark.parametrize("unit,times", [(1, 6), (1, 5), (2, 4), (7, 4), (37, 4), (100, 11), (13, 30), (26, 5)])
def test_planted_runs(unit, times):
    rng = np.random.default_rng(unit)
    words = rng.integers(0, 50, 40).tolist() + rng.integers(100, 10_000, unit).tolist() * times + [7]
    assert got_runs(words) == brute_runs(words)


def test_grid_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    words = [w for _ in range(12) for w in rng.integers(0, 3, rng.integers(1, 9)).tolist() * int(rng.integers(1, 8))]
    monkeypatch.setattr(periodic, "GRID_BLOCK", 16)
    assert got_runs(words) == brute_runs(words)


def test_strongest_is_exact_and_breaks_ties():
    a = np.array
    assert periodic.strongest(a([9, 3, 3]), a([12, 8, 16]), a([3, 2, 4])) == (3, 8, 2)
    big = 3 * 10**8
    assert periodic.strongest(a([0, 1]), a([4 * big, 4 * big + 1]), a([big, big])) == (1, 4 * big + 1, big)
    assert periodic.strongest(a([]), a([]), a([])) is None


def planted(doc_id, words):
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(brute_collapsed(words, runs)))


def test_query_against_brute_force(spark):
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, FOLDER).collect()}
    want = {digest(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert got == want
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark, tmp_path):
    more = ["a b " * 50, "la la la la la la", "x\tx\nx\x0bx\x0cx\rx", "y " * 5, "a b " * 50]
    texts = [*ODD, *more]
    ids = [*range(len(ODD)), 100, 101, 102, 103, None]
    rows = table(spark, texts, ids)
    out = {r.doc_id: r for r in periodic.runs(rows).collect()}
    assert out[0].n_words == 0 and out[0].runs == [] and out[0].strongest is None and out[0].collapsed == ""
    assert out[100].collapsed == "a b" and tuple(out[100].runs[0]) == (0, 100, 2) and tuple(out[101].runs[0]) == (0, 6, 1)
    assert out[102].collapsed == "x" and out[103].runs == [] and out[None].collapsed == "a b"
    assert out[12].n_words == len(LONG.split())
    assert periodic.runs(rows.limit(0)).count() == 0
    rows.where("length(text) < 5000 OR text IS NULL").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digest(i, t) for i, t in zip(ids, texts) if t is None or len(t) < 5000), key=str)


def test_long_texts_in_pieces(monkeypatch):
    text = "alpha beta  gamma " * 40 + "omega" * 30
    whole = periodic.answer(text)
    monkeypatch.setattr(periodic, "PIECE_CHARS", 11)
    again = periodic.answer(text)
    assert again[0] == whole[0] and again[-1] == whole[-1] == "alpha beta gamma " + "omega" * 30
