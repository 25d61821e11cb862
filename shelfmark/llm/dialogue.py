"""Cheapest repair of conversations, by iterative-deepening A*.

A conversation is well formed if the first letters of its roles read
`(s?(ua)+)?` and no row is blank, a repeat of an earlier one, or cut off before
its closing `.`, `!` or `?`. The edits, in ASCII order of their letters: Delete
a row (4), Insert an empty row of the role that fits (3), Keep a row (0), Rerole
a row to user or assistant (3). Blank rows and duplicates must be deleted; a
truncated row that stays adds 3. The repair is the cheapest list of edits, of
equal ones the one whose letters come first.

`solve` searches depth first in the order D, I, K, R under a cost bound; a node
is (row, state of the pattern). Its estimate is what the faults of the rows
left cost at least; a node that fails keeps the cost it was seen to need, so it
is not entered again below that cost (the transposition table), and the least
such cost at the root is the next bound. The first accepting path is the answer.

Rows are sorted over the whole table, which numbers them; a *segment* is what a
conversation has in a stretch of `SEGMENT` numbers, so a conversation of any
length is searched in parts of bounded size. An Insert belongs to the row it
stands before; so two paths through a segment are never prefixes of each other,
and the cheapest and first repair is found part by part: from the last segment
to the first with the cost from each state to the end, then from the first to
the last with the state reached. Both passes stream segments sorted within
partitions and hold a few integers. The second meets the rows of a conversation
in order, as a digest of its whole text must; it holds one batch.

Defined cases: null role and text count as one space; rows are taken by turn
(null first), then role and text; a null conv_id is a conversation of its own;
a role of another first letter cannot be kept; an empty table gives an empty
table; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfmark.session import bound_arrow_batches, materialize

SEGMENT_BITS = 6
SEGMENT = 1 << SEGMENT_BITS

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
# States of the pattern: nothing yet, after s, after u, after a. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)            # an inserted or reroled row's state
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_END = (0, None, None, 0)
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=65_536)
def solve(codes: str, entry: int, tail: tuple) -> tuple[int, str]:
    """(cost, edits) of the best path from state `entry` through rows `codes`.

    A code is a role's first letter (s, u, a, or o for others), upper case if
    the row is truncated, or x for a row that must go. `tail` holds what each
    state still costs behind these rows; None means it cannot end there, and
    that inserts may follow the last row.
    """
    n, final = len(codes), None in tail
    least = min(t for t in tail if t is not None)
    forced = [least] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = codes[i]
        forced[i] = forced[i + 1] + (DELETE if c in "xO" else TRUNCATED if c.isupper() else REROLE if c == "o" else 0)
    needs: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def descend(i: int, state: int, budget: int) -> int:
        """0 if an accepting path within the budget was found, else a cost that is needed at least, plus one."""
        low = needs.get((i, state), forced[i])
        if low > budget:
            return low + 1
        best = 1 << 60
        if i == n and tail[state] is not None:
            if tail[state] <= budget:
                return 0
            best = tail[state]
        for letter, cost, at, to in _edits(codes, i, state, final):
            path.append(letter)
            found = descend(at, to, budget - cost)
            if not found:
                return 0
            path.pop()
            best = min(best, found - 1 + cost)
        needs[(i, state)] = max(needs.get((i, state), 0), best)
        return best + 1

    bound = forced[0]
    while found := descend(0, entry, bound):
        bound = found - 1
    return bound, "".join(path)


def _edits(codes: str, i: int, state: int, final: bool) -> Iterator[tuple[str, int, int, int]]:
    """The edits at a node in ASCII order: (letter, cost, next row, next state)."""
    there = i < len(codes)
    code = codes[i] if there else ""
    if there:
        yield "D", DELETE, i + 1, state
    if there or final:
        yield "I", INSERT, i, _NEXT[state]
    if there and code != "x":
        extra = TRUNCATED if code.isupper() else 0
        to = _KEEP.get(code.lower(), {}).get(state)
        if to is not None:
            yield "K", extra, i + 1, to
        yield "R", REROLE + extra, i + 1, _NEXT[state]


def _filled(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def numbered(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, at): rows in the order of the table with their number, written; numbers have gaps."""
    kept = rows.select(F.col("conv_id").cast("string").alias("key"), "turn", _filled("role").alias("role"), _filled("text").alias("text"))
    ordered = kept.repartitionByRange("key", F.asc_nulls_first("turn"), "role", "text").sortWithinPartitions(
        F.asc_nulls_first("key"), F.asc_nulls_first("turn"), "role", "text"
    )
    # Written, so that the numbers stay what they are.
    return materialize(ordered.select("*", F.monotonically_increasing_id().alias("at")), "conversation-rows")


def faults(ordered: DataFrame) -> DataFrame:
    """(key, turn, at, initial, fault) of numbered rows: the first letter of the role (o for others) and the first fault or null."""
    first, last = F.substring("role", 1, 1), F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    light = ordered.select(
        "key", "turn", "at", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"), last.alias("last"), content.alias("content"),
    )
    told = light.where("last != ''")
    again = told.groupBy("key", "content").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = told.alias("l").join(
        again.alias("a"), F.col("l.key").eqNullSafe(F.col("a.key")) & (F.col("l.content") == F.col("a.content")) & F.expr("l.at > a.first")
    ).select("at", F.lit(True).alias("repeat"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("repeat"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return light.join(repeats, "at", "left").select("key", "turn", "at", "initial", fault.alias("fault"))


def _segments(found: DataFrame) -> DataFrame:
    """(key, segment, codes, initials) from the faults of rows."""
    gone, initial = F.col("fault").isin("blank", "duplicate"), F.col("initial")
    code = F.when(gone, "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    rows = found.select("key", F.shiftright("at", SEGMENT_BITS).alias("segment"), F.struct("at", code.alias("c"), initial.alias("i")).alias("e"))
    # At most SEGMENT rows each.
    lists = rows.groupBy("key", "segment").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return lists.select(
        "key", "segment", F.array_join("e.c", "").alias("codes"), F.array_join("e.i", "").alias("initials"),
    )


def _tails(segments: DataFrame) -> DataFrame:
    """(key, segment, codes, tail, illegal): what each state costs behind the segment, null behind the last."""
    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, behind, follower = (), None, ""
        for pdf in batches:
            out = []
            for k, segment, codes, initials in zip(pdf["key"], pdf["segment"], pdf["codes"], pdf["initials"]):
                if k != key:
                    key, tail, follower = k, None, ""
                else:
                    before, after = behind
                    costs = [solve(before, state, after or _END)[0] for state in range(4)]
                    # Only differences decide; equal parts then meet in the cache.
                    tail = tuple(c - min(costs) for c in costs)
                pairs = initials + follower
                illegal = sum(pairs[i:i + 2] not in _LEGAL for i in range(len(pairs) - 1))
                out.append((k, segment, codes, None if tail is None else list(tail), illegal))
                behind, follower = (codes, tail), initials[0]
            yield pd.DataFrame(out, columns=["key", "segment", "codes", "tail", "illegal"])

    ordered = segments.repartition("key").sortWithinPartitions("key", F.desc("segment"))
    return ordered.mapInPandas(backward, "key string, segment long, codes string, tail array<long>, illegal long")


_EDIT_SCHEMA = "key string, seq long, edit string, cost long, turn string, role string, text string"
_EDIT_COLUMNS = ["key", "seq", "edit", "cost", "turn", "role", "text"]


def edits(ordered: DataFrame, tails: DataFrame) -> DataFrame:
    """Every edit of every conversation, in order within its partition: (key, seq, edit, cost, turn, role, text).

    Deleted rows keep their role and text; inserted rows have no turn.
    """
    none = F.lit(None)
    decisions = tails.select(
        "key", "segment", F.lit(-1).cast("long").alias("at"), none.cast("string").alias("turn"), none.cast("string").alias("role"),
        none.cast("string").alias("text"), "codes", "tail",
    )
    rows = ordered.select(
        "key", F.shiftright("at", SEGMENT_BITS).alias("segment"), "at", F.col("turn").cast("string").alias("turn"), "role", "text",
        none.cast("string").alias("codes"), none.cast("array<long>").alias("tail"),
    )
    both = decisions.unionByName(rows).repartition("key").sortWithinPartitions("key", "segment", "at")

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, seq, todo = (), START, 0, ""
        for pdf in batches:
            out = []

            def insert():
                nonlocal state, seq, todo
                state, todo = _NEXT[state], todo[1:]
                out.append((key, seq, "Insert", INSERT, None, _ROLE[state], ""))
                seq += 1

            for k, at, turn, role, text, codes, tail in zip(*(pdf[c] for c in ("key", "at", "turn", "role", "text", "codes", "tail"))):
                if at < 0:
                    if k != key:
                        key, state, seq = k, START, 0
                    todo = solve(codes, state, _END if tail is None else tuple(int(t) for t in tail))[1]
                    left = list(codes)
                    continue
                while todo[0] == "I":
                    insert()
                letter, todo, code = todo[0], todo[1:], left.pop(0)
                extra = TRUNCATED if code.isupper() else 0
                if letter == "D":
                    out.append((key, seq, "Delete", DELETE, turn, role, text))
                elif letter == "K":
                    state = _KEEP[code.lower()][state]
                    out.append((key, seq, "Keep", extra, turn, role, text))
                else:
                    state = _NEXT[state]
                    out.append((key, seq, "Rerole", REROLE + extra, turn, _ROLE[state], text))
                seq += 1
                while not left and todo:
                    insert()
            yield pd.DataFrame(out, columns=_EDIT_COLUMNS)

    bound_arrow_batches(ordered.sparkSession)
    return both.mapInPandas(forward, _EDIT_SCHEMA)


def digests(edited: DataFrame) -> DataFrame:
    """(key, cost, audit, repaired_sha256) from `edits`, whose order within partitions it relies on."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cost, letters, digest, empty = (), 0, [], None, True
        for pdf in batches:
            out = []
            for k, edit, price, role, text in zip(pdf["key"], pdf["edit"], pdf["cost"], pdf["role"], pdf["text"]):
                if k != key:
                    if digest is not None:
                        out.append((key, cost, "".join(letters), digest.hexdigest()))
                    key, cost, letters, digest, empty = k, 0, [], hashlib.sha256(), True
                cost += price
                letters.append(edit[0])
                if edit != "Delete":
                    digest.update(f"{role}:{text}".encode() if empty else f"\n{role}:{text}".encode())
                    empty = False
            if out:
                yield pd.DataFrame(out, columns=["key", "cost", "audit", "repaired_sha256"])
        if digest is not None:
            yield pd.DataFrame([(key, cost, "".join(letters), digest.hexdigest())], columns=["key", "cost", "audit", "repaired_sha256"])

    return edited.mapInPandas(rows, "key string, cost long, audit string, repaired_sha256 string")


def _counts(found: DataFrame, tails: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal) of every conversation."""
    per_turn = found.groupBy("key", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    totals = per_turn.groupBy("key").agg(gaps.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    illegal = tails.groupBy(F.col("key").alias("_k")).agg(F.sum("illegal").alias("illegal"))
    return totals.join(illegal, F.col("key").eqNullSafe(F.col("_k"))).drop("_k")


def _analysed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered rows, their faults and the tails of their segments, each written once."""
    ordered = numbered(rows)
    found = materialize(faults(ordered), "conversation-faults")
    return ordered, found, materialize(_tails(_segments(found)), "conversation-tails")


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of `rows`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered, found, tails = _analysed(rows)
    repairs = digests(edits(ordered, tails)).withColumnRenamed("key", "_r")
    both = _counts(found, tails).join(repairs, F.col("key").eqNullSafe(F.col("_r"))).drop("_r")
    return both.select(F.col("key").cast(kind).alias("conv_id"), *[c for c in both.columns if c != "key"])


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, seq, edit, turn, role, text), turn null for inserted rows."""
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("conv_id", "turn")}
    ordered, _, tails = _analysed(rows)
    return edits(ordered, tails).where("edit != 'Delete'").select(
        F.col("key").cast(kinds["conv_id"]).alias("conv_id"), "seq", "edit", F.col("turn").cast(kinds["turn"]).alias("turn"), "role", "text",
    )
