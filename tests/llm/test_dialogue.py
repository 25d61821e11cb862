"""Conversation repair against brute force over all edits, against its SQL, and on awkward rows."""

import hashlib
import heapq
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shelfmark.llm import dialogue, queries
from tests.llm.test_llm import FOLDER

STEP = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute(codes):
    """Cheapest edits, then first in ASCII order: uniform-cost search over whole edit lists."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(codes) and last in ("", "a"):
            return cost, audit
        if (i, last) in seen:
            continue
        seen.add((i, last))
        heapq.heappush(heap, (cost + 3, audit + "I", i, STEP[last]))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if c != "x":
                extra = 3 if c.isupper() else 0
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, STEP[last]))
                if last + c.lower() in ("s", "u", "su", "ua", "au"):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, c.lower()))


@settings(max_examples=600, deadline=None)
@given(st.text("suaoSUAOx", max_size=14))
def test_search_against_brute_force(codes):
    assert dialogue.solve(codes, 0, dialogue._END) == brute(codes)


def test_long_search_is_bounded():
    rng = np.random.default_rng(1)
    for _ in range(5):
        codes = "".join(rng.choice(list("suaoSUAOx"), dialogue.SEGMENT))
        assert dialogue.solve(codes, 0, dialogue._END) == brute(codes)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def expected(rows):
    want = {}
    damaged = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in mine if r[0] is not None}
        letters = [r[1][:1] for r in mine]
        codes = "".join(
            "x" if f in ("blank", "duplicate") else (c if c in ("s", "u", "a") else "o").upper() if f else c if c in ("s", "u", "a") else "o"
            for c, f in zip(letters, faults)
        )
        cost, audit = brute(codes)
        shown, i, last = [], 0, ""
        for e in audit:
            role, text = mine[i][1:] if e != "I" else (None, "")
            if e in "IR":
                role = {"u": "user", "a": "assistant"}[STEP[last]]
            if e != "D":
                shown.append(f"{role}:{text}")
                last = role[0]
            i += e != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        want[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(shown).encode()).hexdigest(),
        )
    return want


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string, at string, segment string, fault string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "k", "a", "s", "f") for r in rows], SCHEMA)


def by_query(spark, folder):
    rows = queries.op12_conversation_repair(spark, folder).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_query(spark, FOLDER) == expected(rows)


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(9)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "User", "", None, "superuser"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", None, "Ends. \n", "…", "Yes.", "x" * 200_000 + "."]
    rows = [(conv, None if rng.random() < 0.1 else int(t) * 2, str(r) if r is not None else None, x)
            for conv in [*range(30), None] for t in range(rng.integers(0, 9))
            for r, x in [(roles[rng.integers(0, len(roles))], texts[rng.integers(0, len(texts))])]]
    rows += [(77, t, ["user", "assistant"][t % 2 if t % 11 else rng.integers(0, 2)], f"line {t if t % 17 else 3}{'.' if t % 7 else ''}") for t in range(500)]
    rows += [(78, 4, "user", "Same."), (78, 4, "user", "Same."), (78, 4, "assistant", "Same."), (79, None, None, None)]
    return rows


def test_awkward_rows_against_brute_force(spark, tmp_path, awkward):
    made(spark, awkward).write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = by_query(spark, str(tmp_path)), expected(awkward)
    assert got == want
    assert len(got[77][6]) > 400


def test_segments_agree_with_one_search(spark, tmp_path, awkward, monkeypatch):
    monkeypatch.setattr(dialogue, "SEGMENT_BITS", 2)
    made(spark, awkward).write.parquet(f"{tmp_path}/conversations.parquet")
    assert by_query(spark, str(tmp_path)) == expected(awkward)


def test_statement(spark, tmp_path, awkward):
    made(spark, awkward).where("length(text) < 1000 AND conv_id IS NOT NULL AND conv_id < 77 OR conv_id > 77").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLES["op12_conversation_repair"])
    names = [c[0] for c in cursor.description]
    got = {r[names.index("conv_id")]: tuple(r[names.index(f)] for f in FIELDS) for r in cursor.fetchall()}
    assert got == by_query(spark, str(tmp_path))


def test_repaired_rows(spark):
    rows = made(spark, [(1, 0, "user", "Hi."), (1, 1, "tool", "Out."), (1, 2, "user", "cut"), (2, 5, "assistant", "Lone.")])
    got = sorted((tuple(r) for r in dialogue.repaired(rows).collect()), key=lambda r: r[:2])
    assert [r[2] for r in got] == ["Keep", "Rerole", "Insert", "Keep"]
    assert got[1][3:] == (1, "assistant", "Out.") and got[2][3:] == (None, "user", "") and got[3][3:] == (5, "assistant", "Lone.")
    assert dialogue.repaired(rows.limit(0)).count() == 0 and dialogue.audits(rows.limit(0)).count() == 0
