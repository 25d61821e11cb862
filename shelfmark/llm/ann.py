"""Approximate nearest neighbours by cosine with a permutation index.

A vector is represented by its nearest pivots in order (`PREFIX` of `PIVOTS`).
Vectors are dealt into blocks of about `BLOCK`; a block posts its vectors in one
inverted file per pivot, with the rank the pivot has for them. A query walks the
files of its own pivots and adds up how little the ranks differ, which orders
the block by the footrule distance of the two prefixes (a pivot outside a prefix
has rank `PREFIX`). The best `RERANK` of the block are reranked by the exact
cosine in double precision, and the best of all blocks remain. The share is the
same for every block, so no bucket is capped and recall does not fall with size.

The pivots come from a bounded sample: of the `SAMPLE` vectors with the smallest
hash of their id, the first `PIVOTS` distinct directions. Every vector is indexed.

Defined cases: vectors that are null, zero or hold null or non-finite components,
and rows without id, take no part; vectors of another length than most take no
part; equal scores go to the smaller id; rows that repeat a query's id are that
query; fewer candidates than k give fewer rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelfmark.operators.ranking import top_k
from shelfmark.session import bound_arrow_batches, materialize, spread

SAMPLE = 1024
PIVOTS = 256
PREFIX = 128
BLOCK = 4096
QUERIES = 512       # queries that meet a block at a time
RERANK = 0.25
LEAST_RERANK = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): one row per id with a vector that can be compared, as doubles."""
    v = F.col("embedding").cast("array<double>")
    limit = F.lit(float("inf"))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(
        ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit)) & F.exists("v", lambda x: x != 0)
    )
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivots_of(vectors: DataFrame) -> np.ndarray:
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    unit = _unit(np.array([r["v"] for r in rows], dtype=float))
    _, first = np.unique(unit.round(9), axis=0, return_index=True)
    return unit[np.sort(first)[:PIVOTS]]


def _prefixes(unit: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :length]


class _Block:
    """The inverted files of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, length: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.length = ids[order], vectors[order], length
        prefixes = _prefixes(_unit(self.vectors), pivots, length)
        n = len(ids)
        pivot = prefixes.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.starts = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))
        self.member = np.repeat(np.arange(n), length)[by_pivot]
        # length - rank: what the pivot is worth if the query ranks it first.
        self.worth = (length - np.tile(np.arange(length), n))[by_pivot].astype(np.int32)
        self.scale = np.abs(self.vectors).max(axis=1)
        scaled = self.vectors / self.scale[:, None]
        self.scaled, self.norms = scaled, np.sqrt((scaled * scaled).sum(axis=1))

    def nearest(self, query_id: int, query: np.ndarray, prefix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        # Footrule = constant - 2 x shared: the sum over common pivots of length - max(rank, rank).
        shared = np.zeros(len(self.ids), dtype=np.int32)
        for rank, p in enumerate(prefix.tolist()):
            a, b = self.starts[p], self.starts[p + 1]
            shared[self.member[a:b]] += np.minimum(self.worth[a:b], self.length - rank)
        take = max(LEAST_RERANK, int(np.ceil(RERANK * len(self.ids))))
        found = np.argsort(-shared, kind="stable")[:take + 1]
        found = found[self.ids[found] != query_id][:take]
        q = query / np.abs(query).max()
        cosine = (self.scaled[found] * q).sum(axis=1) / (self.norms[found] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[found], -cosine))[:k]
        return self.ids[found][best], cosine[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each query, nearest first.

    Both tables have vec_id and embedding; a vector with the query's id is not its neighbour.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    asked = usable(queries)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = usual["d"] if usual else 0
    rows, asked = rows.where(F.size("v") == dimension), materialize(asked.where(F.size("v") == dimension), "query-vectors")
    n, m = rows.count(), asked.count()
    pivots = pivots_of(rows)
    length = min(PREFIX, max(1, (len(pivots) + 1) // 2))
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))

    def packed(df: DataFrame, parts: int, name: str) -> DataFrame:
        placed = df.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)))
        return placed.groupBy(name).agg(F.collect_list(F.struct("vec_id", "v")).alias(f"{name}_rows"))

    # Both sides are written as they are: a copy of the queries for every block would be planned, and broadcast, as if it were one.
    stored = spread(materialize(packed(rows, blocks, "block").select(
        "block", F.col("block_rows.vec_id").alias("ids"), F.flatten("block_rows.v").alias("flat")), "vector-blocks"))
    asked = materialize(packed(asked, chunks, "chunk").select(
        F.col("chunk_rows.vec_id").alias("query_ids"), F.flatten("chunk_rows.v").alias("query_flat")), "query-chunks")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index = None, None
        for pdf in batches:
            for block, ids, flat, query_ids, query_flat in pdf.itertuples(index=False):
                if block != last:
                    last = block
                    index = _Block(np.asarray(ids), np.asarray(flat, dtype=float).reshape(len(ids), -1), pivots, length)
                asked_for = np.asarray(query_flat, dtype=float).reshape(len(query_ids), -1)
                prefixes = _prefixes(_unit(asked_for), pivots, length)
                found = [index.nearest(i, q, p, k) for i, q, p in zip(query_ids, asked_for, prefixes)]
                yield pd.DataFrame({
                    "query_id": np.repeat(np.asarray(query_ids, dtype=np.int64), [len(f[0]) for f in found]),
                    "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found]),
                })

    bound_arrow_batches(spark)
    met = stored.crossJoin(asked).select("block", "ids", "flat", "query_ids", "query_flat")
    best = met.mapInPandas(search, "query_id long, vec_id long, score double")
    ranked = top_k(best, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
