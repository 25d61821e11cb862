"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a weight and all sources share `SHARE` of all words in
proportion to the weights; a source gives at most `MOST` times its own words,
and what that leaves over goes to the others by weight until none is above.
A source that gives r times its words takes every document floor(r) times and
once more with probability r - floor(r).

Those draws are balanced (cube method): probabilities move through the null
space of the constraints "documents drawn" and "words drawn" until each is 0 or
1. Flight phase: the documents of a source are dealt into blocks of at most
about `BLOCK`; three undecided documents at a time move along the one direction
that changes neither total, and a coin in proportion to the two distances picks
the end. A block leaves `LANDING` documents undecided at most; those fly again
together, round by round, until no more remain in the whole source. The landing
problem is solved over all their outcomes: the one nearest to the required
totals. Order and coins come from hashes of ids, so reruns agree; the coins of each
round have a hash of their own, independent of the order, so that every step keeps
the expected probabilities.

Defined cases: a null or empty text has size 0 and is never needed for the
totals; a null source is a source of its own, ordered last; repeated rows are
documents of their own; empty tables mix to empty tables; further columns
pass through.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import materialize

SHARE = 1.5
MOST = 2.0
WEIGHTS = (3, 1, 2)
BLOCK = 4096
LANDING = 10


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): words each source is to give. `sizes` has source and size.

    Weights repeat along the sources in code point order, null last. Capping
    repeats on aggregates of the source table until no source is above its cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, ordered by bytes of UTF-8, which is code point order.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = materialize(
        by_source.withColumn("_at", place).withColumn("weight", F.get(listed, (F.col("_at") % len(weights)).cast("int"))).drop("_at"),
        "source-weights",
    )
    cap = F.col("source_size") * F.lit(float(most))
    wanted = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"] * share
    level, held = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        now = rows.agg(
            F.count(F.when(full, 1)).alias("held"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if now["held"] == held or now["open"] == 0:
            break
        level, held = (wanted - now["given"]) / now["open"], now["held"]
    target = cap if level is None else F.least(F.col("weight") * F.lit(level), cap)
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _fly(p: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """The flight phase: moves probabilities until `LANDING` at most are undecided."""
    p = p.copy()
    held: list[int] = []
    eps = 1e-9
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) <= LANDING:
            continue
        a, b, c = three = held[-3:]
        # The direction in which neither the number nor the size of the draws changes.
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / d if d > 0 else p[k] / -d) for k, d in zip(three, u) if d)
        down = min((p[k] / d if d > 0 else (1 - p[k]) / -d) for k, d in zip(three, u) if d)
        step = up if coin[i] * (up + down) < down else -down
        for k, d in zip(three, u):
            p[k] = min(1.0, max(0.0, p[k] + step * d))
        held = [k for k in held if eps < p[k] < 1 - eps]
        for k in three:
            if k not in held:
                p[k] = round(p[k])
    return p


def _land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing problem: among all outcomes of a few documents the one nearest to both totals."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    outcomes = np.array(list(itertools.product((0, 1), repeat=len(open_))))
    words, docs = (p[open_] * size[open_]).sum(), p[open_].sum()
    scale = max(1.0, float(size[open_].mean()))
    miss = np.abs(outcomes @ size[open_] - words) / scale + 0.02 * np.abs(outcomes.sum(axis=1) - docs)
    chosen = outcomes[int(np.argmin(miss))]
    out = p.copy()
    out[open_] = chosen
    return out


def _hashed(seed: int) -> Column:
    """A hash of the unit in [0, 1)."""
    return F.pmod(F.xxhash64("_unit", F.lit(seed)), F.lit(2 ** 30)) / F.lit(float(2 ** 30))


def _round(rows: DataFrame, group: list[str], landing: bool, number: int) -> DataFrame:
    """One flight over each group of units (_unit, source, size, p, order, coin, _block); groups are bounded by their making."""
    rows = rows.withColumn("coin", _hashed(1000 + number))

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "_unit"], kind="stable")
        sizes = pdf["size"].to_numpy(dtype=float)
        p = _fly(pdf["p"].to_numpy(dtype=float), sizes, pdf["coin"].to_numpy(dtype=float))
        return pdf.assign(p=_land(p, sizes) if landing else p)

    return rows.groupBy(*group).applyInPandas(fly, rows.schema)


def _unit(documents: DataFrame):
    """Key of a row that reruns reproduce: its id with a hash of its text and source. Equal rows share it."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text", "source").cast("string"))


def draws(documents: DataFrame, **options) -> DataFrame:
    """(_unit, doc_id, size, source_size, target, copies): per row how often the mix takes it.

    Equal rows are drawn together, as one unit of their joint size.
    """
    sizes = materialize(
        documents.select(_unit(documents).alias("_unit"), "doc_id", "source", words_in(F.col("text")).alias("size")), "sizes"
    )
    goals = targets(sizes, **options)
    units = sizes.groupBy("_unit").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    counts = units.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_c")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = materialize(
        goals.join(counts, F.col("source").eqNullSafe(F.col("_c")))
        .select(F.col("source").alias("_s"), "source_size", "target", "_n", ratio.alias("_ratio")),
        "source-targets",
    )
    rows = units.join(goals, F.col("source").eqNullSafe(F.col("_s"))).select(
        "_unit", "source", "size", (F.col("_ratio") - F.floor("_ratio")).alias("p"), _hashed(17).alias("order"), F.lit(0.0).alias("coin"),
        F.pmod(F.xxhash64("_unit", F.lit(5)), F.ceil(F.col("_n") / BLOCK)).alias("_block"),
    )
    flown = materialize(_round(rows, ["source", "_block"], False, 0), "flight")
    decided, left = [flown.where("p <= 0 OR p >= 1")], flown.where("p > 0 AND p < 1")
    for number in itertools.count(1):
        most = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= LANDING:
            decided.append(_round(left, ["source"], True, number))
            break
        # LANDING undecided units per block: at most BLOCK of them meet in the next round.
        merged = left.withColumn("_block", F.floor(F.col("_block") / (BLOCK // LANDING)))
        flown = materialize(_round(merged, ["source", "_block"], False, number), "flight")
        decided.append(flown.where("p <= 0 OR p >= 1"))
        left = flown.where("p > 0 AND p < 1")
    drawn = decided[0]
    for more in decided[1:]:
        drawn = drawn.unionAll(more)
    drawn = drawn.select(F.col("_unit").alias("_u"), F.round("p").cast("long").alias("_more"))
    return sizes.join(goals, F.col("source").eqNullSafe(F.col("_s"))).join(drawn, F.col("_unit") == F.col("_u")).select(
        "_unit", "doc_id", "size", "source_size", "target", (F.floor("_ratio") + F.col("_more")).alias("copies")
    )


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix: every row of `documents` as often as it is taken, columns unchanged."""
    taken = draws(documents, **options).where("copies > 0").groupBy(F.col("_unit").alias("__unit")).agg(F.first("copies").alias("__copies"))
    rows = documents.withColumn("__key", _unit(documents))
    return rows.join(taken, F.col("__key") == F.col("__unit")).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    ).select(*documents.columns)
