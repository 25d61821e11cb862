"""Periodic runs of words, by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q and at least max(`MIN_WORDS`,
`MIN_POWER` * q) words that no neighbouring word extends. Such a stretch holds
`3 q` or more positions i in a row whose word equals the word q later, so one of
them is a multiple of 3q: the grid for q asks only there, n / 3q questions, in
all n log n for every q. A question is how far two positions agree to the right
and to the left.

The answer compares words until both positions reach the difference cover (a set
of residues modulo `MODULUS` with a pair for every difference; less than
`MODULUS` words). From there the suffixes are sampled ones: only those are
sorted, by blocks of `MODULUS` words and doubling, and the common length of two
of them is a range minimum over neighbours, from a sparse table. The order is
built for a text only once a comparison reaches the cover.

Equal (start, end) of several periods are one stretch; the smallest is its period.

One narrow pass, no shuffle: a text is handled by the task that holds its row,
in arrays of a few integers a word, and the grid is asked in blocks.

Defined cases: null and empty texts have no words, no runs and an empty
collapsed text; repeated rows are answered each; ids of documents may be null
or of any type; an empty table gives an empty table; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.session import bound_arrow_batches

MIN_WORDS = 6
MIN_POWER = 4
MODULUS = 13
PIECE_CHARS = 1_000_000
GRID_BLOCK = 1 << 19       # questions asked at once
OUT_CHARS = 16_000_000

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def difference_cover(modulus: int) -> list[int]:
    """A small set of residues of which some pair has every difference: greedily, each residue that adds most differences."""
    cover, open_ = [0], set(range(1, modulus))
    while open_:
        gain = {c: {(c - d) % modulus for d in cover} | {(d - c) % modulus for d in cover} for c in range(modulus)}
        best = max(range(modulus), key=lambda c: (len(gain[c] & open_), -c))
        cover.append(best)
        open_ -= gain[best]
    return sorted(cover)


COVER = difference_cover(MODULUS)


def _meeting(modulus: int, cover: list[int]) -> np.ndarray:
    """By (i mod modulus, (j - i) mod modulus): the fewest steps after which i and j are both in the cover."""
    inside = np.isin(np.arange(2 * modulus) % modulus, cover)
    table = np.zeros((modulus, modulus), dtype=np.int64)
    for i, d in product(range(modulus), repeat=2):
        table[i, d] = next(k for k in range(modulus) if inside[i + k] and inside[(i + d + k) % modulus])
    return table


_MEETING = _meeting(MODULUS, COVER)


class Extensions:
    """How many words from two positions on are equal, for whole arrays of positions i < j."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        # Zero stands for all that lies behind the end.
        self.words = np.concatenate((words.astype(np.int64) + 1, np.zeros(2 * MODULUS, dtype=np.int64)))
        self.rank: np.ndarray | None = None

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        meet = _MEETING[i % MODULUS, (j - i) % MODULUS]
        length = np.zeros(len(i), dtype=np.int64)
        going = np.flatnonzero(meet > 0)
        for t in range(MODULUS - 1):
            going = going[self.words[i[going] + t] == self.words[j[going] + t]]
            length[going] += 1
            going = going[meet[going] > t + 1]
            if not len(going):
                break
        sampled = np.flatnonzero((length == meet) & (j + meet < self.n))
        if len(sampled):
            k = meet[sampled]
            length[sampled] += self._common(i[sampled] + k, j[sampled] + k)
        return length

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of sampled suffixes: the least of the neighbours' between their ranks."""
        first = self.words[a] == self.words[b]
        out = np.zeros(len(a), dtype=np.int64)
        if not first.any():
            return out
        if self.rank is None:
            self._sort()
        ra, rb = self.rank[self.index[a[first]]], self.rank[self.index[b[first]]]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out[first] = np.minimum(self.table[level, low], self.table[level, high - (1 << level)])
        return out

    def _sort(self) -> None:
        """Ranks of the sampled suffixes and the sparse table over common lengths of neighbours."""
        at = np.flatnonzero(np.isin(np.arange(self.n) % MODULUS, COVER))
        self.index = np.full(self.n + MODULUS, -1, dtype=np.int64)
        self.index[at] = np.arange(len(at))
        blocks = self.words[at[:, None] + np.arange(MODULUS)]
        order = np.lexsort(blocks.T[::-1])
        new = np.concatenate(([True], (blocks[order[1:]] != blocks[order[:-1]]).any(axis=1)))
        rank = np.empty(len(at), dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        levels, step = [(MODULUS, rank)], MODULUS
        while rank[order[-1]] < len(at) - 1:
            after = at + step
            second = np.zeros(len(at), dtype=np.int64)
            inside = np.flatnonzero(after < self.n)
            second[inside] = rank[self.index[after[inside]]] + 1
            pair = rank * (len(at) + 1) + second
            order = np.argsort(pair, kind="stable")
            new = np.concatenate(([True], pair[order[1:]] != pair[order[:-1]]))
            rank = np.empty(len(at), dtype=np.int64)
            rank[order] = np.cumsum(new) - 1
            step *= 2
            levels.append((step, rank))
        # Common lengths of neighbours: whole blocks from the longest down, then single words.
        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(len(a), dtype=np.int64)
        for step, known in reversed(levels):
            inside = np.flatnonzero((a + common < self.n) & (b + common < self.n))
            same = known[self.index[a[inside] + common[inside]]] == known[self.index[b[inside] + common[inside]]]
            common[inside[same]] += step
        going = np.arange(len(a))
        for _ in range(MODULUS):
            x, y = a[going] + common[going], b[going] + common[going]
            going = going[(x < self.n) & (y < self.n) & (self.words[x] == self.words[y])]
            common[going] += 1
        rows, width = [common], 1
        while 2 * width <= len(common):
            last = rows[-1].copy()
            last[:len(common) - width] = np.minimum(rows[-1][:len(common) - width], rows[-1][width:])
            rows.append(last)
            width *= 2
        self.rank, self.table = rank, np.array(rows)


def find_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of an array of word numbers, by start and period."""
    n = len(words)
    none = np.zeros(0, dtype=np.int64)
    if n < MIN_WORDS:
        return none, none, none
    right, left = Extensions(words), Extensions(words[::-1])
    spacing = MIN_POWER - 1
    found, q0, top = [], 1, n // MIN_POWER
    while q0 <= top:
        # As many periods as fit a block of questions, one at least.
        periods = np.arange(q0, min(top, q0 + max(1, GRID_BLOCK * spacing * q0 // n)) + 1)
        counts = -(-(n - periods) // (spacing * periods))
        q = np.repeat(periods, counts)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * spacing * q
        hit = np.flatnonzero(words[i] == words[i + q])
        if len(hit):
            i, q = i[hit], q[hit]
            ahead, back = right(i, i + q), left(n - 1 - i - q, n - 1 - i)
            start, length = i - back + 1, ahead + back - 1 + q
            keep = length >= np.maximum(MIN_WORDS, MIN_POWER * q)
            if keep.any():
                found.append(np.stack((start[keep], length[keep], q[keep]), axis=1))
        q0 = int(periods[-1]) + 1
    if not found:
        return none, none, none
    # The first of equal (start, length) is the smallest period; then the order is start, period.
    rows = np.unique(np.concatenate(found), axis=0)
    first = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: those no run holds behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) == 0


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length over period, exactly; ties go to the smallest start, then period."""
    rows = zip(start.tolist(), length.tolist(), period.tolist())
    return max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = value = len(self)
        return value


def _split(text: str) -> list[str]:
    for space in "\t\n\x0b\x0c\r":
        text = text.replace(space, " ")
    return [word for word in text.split(" ") if word]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of bounded size that end at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end


def answer(text: str) -> tuple:
    """(number of words, starts, lengths, periods, the strongest run, the collapsed text)."""
    numbers, parts = _Numbers(), []
    for piece in _pieces(text):
        words = _split(piece)
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
    words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    runs = find_runs(words)
    stay = words[kept_words(len(words), *runs)] if len(runs[0]) else words
    names = list(numbers)
    collapsed = " ".join(map(names.__getitem__, stay.tolist()))
    return len(words), *runs, strongest(*runs), collapsed


def runs(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, strongest struct or null, collapsed text) of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n_words", "start", "length", "period", "strongest", "collapsed"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, held = [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                n, start, length, period, best, collapsed = answer(text or "")
                ready.append((doc_id, n, start, length, period, best and list(best), collapsed))
                held += len(collapsed) + 24 * len(start) + 64
                if held >= OUT_CHARS:
                    yield pd.DataFrame(ready, columns=columns)
                    ready, held = [], 0
        if ready:
            yield pd.DataFrame(ready, columns=columns)

    bound_arrow_batches(documents.sparkSession)
    # Ids travel as text so that nulls and any id type survive.
    light = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = light.mapInPandas(
        rows,
        "doc_id string, n_words long, start array<long>, length array<long>, period array<long>, strongest array<long>, collapsed string",
    )
    best = F.struct(*[F.element_at("strongest", k + 1).alias(name) for k, name in enumerate(("start", "length", "period"))])
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_words", F.arrays_zip("start", "length", "period").alias("runs"),
        F.when(F.col("strongest").isNotNull(), best).alias("strongest"), "collapsed",
    )


def word_list(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_tail(words: Column, start: Column, period: Column) -> Column:
    """An array whose elements from `start` (from 0) on repeat the `period` elements there until its end."""
    n, rest = F.size(words), F.size(words) - start
    times = F.ceil(rest / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, start + 1, period), times)), F.lit(1), rest)
    return F.when(n > 0, F.concat(F.slice(words, F.lit(1), start), tail)).otherwise(words)
