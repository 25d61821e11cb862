"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of
`SHINGLE` words (fewer words: the whole sequence), repeats included, each
hashed with XXH64 (seed 42); a bit is set if it is set in over half the hashes.
No words: fingerprint zero.

Two fingerprints that differ in at most `MAX_BITS` = 4 bits differ in at most 4
of their 8 bytes, so they share at least 4 positional bytes. The index posts
every distinct fingerprint under `SLOTS`: 20 triples of byte positions of which
every 4 positions contain one (a Turan system), keyed by the three bytes. The
pairs under one key are tallied over all 8 positions, pairs with fewer than 4
shared positional bytes go, and the rest are verified bit by bit.

Equal fingerprints are one index row, whatever their number. A key with more
than `BLOCK` rows is cut into blocks that meet block by block, each pair of
blocks in a row of its own, so no group is gathered whole; a row returns a
spanning forest of its links (fewer links than members), not all pairs, which
keeps every component. Components come from rounds over those links.

Defined cases: null and empty texts have fingerprint zero and link like any
other; documents with equal ids are separate rows; rows with a null id get a
fingerprint and no component of their own id; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from shelfmark.llm.components import components
from shelfmark.session import materialize

SHINGLE = 4
MAX_BITS = 4
BYTES = 8
LEAST_SHARED = BYTES - MAX_BITS
BLOCK = 1024


def _covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that any 4 positions contain one: Turan's construction."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = []
    for a in range(8):
        for b in range(a + 1, 8):
            for c in range(b + 1, 8):
                held = [sum(x in g for x in (a, b, c)) for g in groups]
                inside = 3 in held
                stepped = any(held[i] == 2 and held[(i + 1) % 3] == 1 for i in range(3))
                if inside or stepped:
                    found.append((a, b, c))
    return found


SLOTS = _covering_triples()


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:][:n].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])), dtype=np.uint64,
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprinted(documents: DataFrame, name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """`documents` with the signed 64-bit fingerprint of each whole text."""
    @pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        values = np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return documents.withColumn(name, fingerprint(F.col("text")))


def _forest(left: np.ndarray, right: np.ndarray, same: bool, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one row, or between its two blocks."""
    everything = left if same else np.concatenate((left, right))
    parent = list(range(len(everything)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    offset = 0 if same else len(left)
    for i in range(len(left)):
        others = left[i + 1:] if same else right
        if not len(others):
            continue
        x = others ^ left[i]
        # Count filter: positional bytes in common, then the exact number of bits.
        near = np.flatnonzero(BYTES - (x[:, None].view(np.uint8) != 0).sum(axis=1) >= LEAST_SHARED)
        near = near[np.bitwise_count(x[near]) <= most]
        for j in near.tolist():
            k = j + (i + 1 if same else offset)
            a, b = root(i), root(k)
            if a != b:
                parent[a] = b
                links.append((int(everything[i]), int(everything[k])))
    return links


def links(prints: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(u, v): links between distinct fingerprints that keep every component; `prints` holds distinct `fp`."""
    if not 0 <= most <= MAX_BITS:
        raise ValueError("the index guarantees links of at most 4 bits")
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255) for i in range(BYTES)]
    keys = [
        F.lit(s * 2 ** 24) + byte[a] * 65536 + byte[b] * 256 + byte[c] for s, (a, b, c) in enumerate(SLOTS)
    ]
    posts = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = posts.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select(
        "key", F.ceil(F.col("_n") / BLOCK).alias("_blocks")
    )
    placed = posts.join(large, "key", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("fp"), "_blocks"))
    meeting = placed.select(
        "key", "fp", "_own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    ).select(
        "key", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"),
        F.struct("fp", (F.col("_own") > F.col("_other")).alias("_right")).alias("_e"),
    )
    # A row holds two blocks at most: about 2 x BLOCK fingerprints.
    rows = meeting.groupBy("key", "_a", "_b").agg(F.collect_list("_e").alias("_e")).where(F.size("_e") > 1)
    rows = rows.select((F.col("_a") == F.col("_b")).alias("same"), F.col("_e.fp").alias("fps"), F.col("_e._right").alias("right"))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[tuple[int, int]] = []
            for same, fps, right in zip(pdf["same"], pdf["fps"], pdf["right"]):
                fps = np.asarray(fps, dtype=np.int64).view(np.uint64)
                if same and len(fps) == 2:
                    x = int(fps[0]) ^ int(fps[1])
                    if x.bit_count() <= most:
                        found.append((int(fps[0]), int(fps[1])))
                    continue
                right = np.asarray(right, dtype=bool)
                found += _forest(fps, fps, True, most) if same else _forest(fps[~right], fps[right], False, most)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return rows.mapInPandas(linked, "u long, v long")


def classes(documents: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint long, component_id): component_id is the smallest doc_id reachable over links."""
    marked = materialize(fingerprinted(documents.select("doc_id", "text"), "fp").select("doc_id", "fp"), "fingerprints")
    own = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(own.select("fp"), most))
    placed = own.join(found, own.fp == found.vertex, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(least, "root").select("fp", "component_id")
    return marked.join(by_print, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def one_per_class(documents: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """`documents` with one row of each class: that with the smallest doc_id (any one of rows that share it).

    Rows with a null id stay, as nothing names them.
    """
    kept = classes(documents, most).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = documents.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(documents.where("doc_id IS NULL"))
