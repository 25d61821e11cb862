"""Toxicity by compression distance: which of two zstandard dictionaries packs a window better.

An ordinary dictionary is trained on windows of ordinary documents. The toxic
dictionary holds, besides that same ordinary content, a dictionary trained on
the words of toxic documents that carry byte n-grams far more frequent in toxic
than in ordinary documents. A window of a few words that the toxic dictionary
packs some bytes shorter is a toxic window; the share of toxic windows is
calibrated to a score in which `DECISION` is the best threshold found in training.

The dictionaries and the calibration are fitted on a bounded, deterministic
sample of labelled rows (`MAX_TOXIC`, `MAX_ORDINARY`, smallest hash of the id
first; of rows that share an id the one with the smallest hash of its text) and
of each text on its first `MAX_CHARS` characters at most. Where the sample has
more than `TOTAL_CHARS` characters, its longest texts are cut to one length that
fits, so the driver holds a bounded number of characters. Scoring reads every
document whole.

Defined cases: a null or empty text has no toxic window and gets the lowest
score; without a toxic or without an ordinary training row every score is 0;
rows are scored independently, so repeated rows agree; extra columns stay.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from shelfmark.session import materialize

MAX_TOXIC = 1500
MAX_ORDINARY = 4000
MAX_CHARS = 200_000         # of a text that is learnt from
TOTAL_CHARS = 40_000_000    # of all texts that are learnt from
DECISION = 0.7
WINDOW_WORDS = 4
GAIN = 3            # bytes a window must be shorter with the toxic dictionary
LEVEL = 12
ORDINARY_BYTES = 65536
TOXIC_BYTES = 4096
GRAM = 5


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionary contents and the two numbers of the calibration."""

    ordinary: bytes
    toxic: bytes
    cut: float
    slope: float


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").split())


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(0, len(words), size)]


def _grams(word: bytes, sizes: tuple[int, ...] = (5, 6)) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i:i + n] for n in sizes for i in range(len(padded) - n + 1)}


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _shuffled(items: list, seed: int) -> list:
    order = np.random.default_rng(seed).permutation(len(items))
    return [items[i] for i in order]


class _Scorer:
    """Counts the toxic windows of texts with one model; lives in one task."""

    def __init__(self, model: ToxicityModel):
        def packer(content: bytes) -> zstandard.ZstdCompressor:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False
            )

        self.plain, self.toxic = packer(model.ordinary), packer(model.toxic + model.ordinary)
        # A window without any n-gram of the toxic dictionary cannot gain from it and need not be packed.
        self.hints = np.zeros(1 << 20, dtype=bool)
        codes = self._codes(model.toxic)
        if len(codes):
            self.hints[codes] = True

    @staticmethod
    def _codes(data: bytes) -> np.ndarray:
        """A 20-bit hash of every byte n-gram."""
        if len(data) < GRAM:
            return np.zeros(0, dtype=np.uint32)
        b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
        h = np.zeros(len(b) - GRAM + 1, dtype=np.uint64)
        for i in range(GRAM):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (b[i:len(b) - GRAM + 1 + i] + np.uint64(1))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(44)).astype(np.uint32)

    def count(self, text: str | None) -> tuple[int, int]:
        """(toxic windows, windows) of a whole text."""
        words = normalised(text).split()
        if not words:
            return 0, 0
        cut = windows(words)
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        joined = b"".join(cut)
        codes = self._codes(joined)
        if not len(codes):
            return 0, len(cut)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        marks = np.concatenate(([0], np.cumsum(self.hints[codes])))
        first = np.minimum(starts, len(codes))
        last = np.clip(starts + sizes - GRAM + 1, first, len(codes))
        hits = 0
        for i in np.flatnonzero(marks[last] > marks[first]):
            w = cut[i]
            hits += len(self.plain.compress(w)) - len(self.toxic.compress(w)) >= GAIN
        return hits, len(cut)


def _share(hits: int, n: int) -> float:
    return math.log((hits + 0.05) / (n + 12.0))


def fit(toxic_texts: list[str], ordinary_texts: list[str]) -> ToxicityModel | None:
    """Train both dictionaries and the calibration on bounded lists of texts."""
    if not toxic_texts or not ordinary_texts:
        return None
    # Texts are split again where they are needed, so that no list of all words is held.
    toxic, ordinary = [normalised(t) for t in toxic_texts], [normalised(t) for t in ordinary_texts]
    seen: Counter = Counter()
    for text in toxic:
        seen.update({g for w in set(text.split()) for g in _grams(w)})
    least = max(3, len(toxic) // 50)
    frequent = {g: k for g, k in seen.items() if k >= least}
    seen.clear()
    plain: Counter = Counter()
    n_windows = 0
    for text in ordinary:
        words = text.split()
        n_windows += -(-len(words) // 8)
        plain.update({g for w in set(words) for g in _grams(w) if g in frequent})
    marked = {g for g, k in frequent.items() if k / len(toxic) >= 20 * (plain[g] + 1) / (len(ordinary) + 1)}
    if not marked:
        marked = {g for g, k in frequent.items() if k / len(toxic) >= 5 * (plain[g] + 1) / (len(ordinary) + 1)}
    telling: Counter = Counter()
    for text in toxic:
        for w in text.split():
            if _grams(w) & marked:
                telling[b" " + w + b" "] += 1
    words = [w for w, k in sorted(telling.items()) for _ in range(min(k, 50))]
    words = _shuffled(words, 1)
    toxic_dictionary = _trained([b"".join(words[i:i + 6]) for i in range(0, len(words), 6)], TOXIC_BYTES, 32)
    # Every so many windows of ordinary text: about 20,000 to train on.
    every = max(1, n_windows // 20000)
    cut = list(itertools.islice((w for text in ordinary for w in windows(text.split(), 8)), 0, None, every))
    ordinary_dictionary = _trained(_shuffled(cut, 2), ORDINARY_BYTES, 64)
    draft = ToxicityModel(ordinary_dictionary, toxic_dictionary, 0.0, 1.0)
    scorer = _Scorer(draft)
    xs = np.array([_share(*scorer.count(t)) for t in [*toxic_texts, *ordinary_texts]])
    ys = np.array([1] * len(toxic_texts) + [0] * len(ordinary_texts))
    # The threshold with the best F1 on the training rows, half way to the next lower share.
    order = np.argsort(-xs, kind="stable")
    hit, n = np.cumsum(ys[order]), np.arange(1, len(ys) + 1)
    f1 = 2 * hit / (n + ys.sum())
    ends = np.append(xs[order][:-1] != xs[order][1:], True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    at = xs[order][best]
    below = xs[xs < at]
    threshold = float((at + below.max()) / 2) if len(below) else float(at)
    spread = float(np.std(xs)) or 1.0
    return ToxicityModel(ordinary_dictionary, toxic_dictionary, threshold, 2.0 / spread)


def training_rows(documents: DataFrame, labels: DataFrame, admitted=None) -> DataFrame:
    """The bounded sample (_id, _text, _toxic): per class the labelled ids with the smallest hash, one row each.

    The ids are chosen from the labels alone; only the chosen texts are read, and
    rows that repeat an id are reduced to one before the shuffle.
    A document with contradicting labels counts as toxic.
    """
    rows = labels.select(F.col("doc_id").alias("_id"), "toxic").where("_id IS NOT NULL AND toxic IN (0, 1)")
    if admitted is not None:
        rows = rows.where(admitted(F.col("_id")))
    rows = rows.groupBy("_id").agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = rows.where("_toxic = 1").orderBy(order, "_id").limit(MAX_TOXIC).unionAll(
        rows.where("_toxic = 0").orderBy(order, "_id").limit(MAX_ORDINARY)
    )
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    # `chosen` has at most MAX_TOXIC + MAX_ORDINARY ids: a proven bound for the hint.
    met = texts.join(F.broadcast(chosen), "_id").where("_text IS NOT NULL")
    # The hash of the whole text chooses; what is kept of it is bounded.
    return met.groupBy("_id", "_toxic").agg(F.min_by(F.left("_text", F.lit(MAX_CHARS)), F.struct(F.xxhash64("_text"), F.left("_text", F.lit(MAX_CHARS)))).alias("_text"))


def _level(lengths: list[int], total: int) -> int:
    """The largest length to cut texts to so that all together have `total` characters at most."""
    left = total
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) > left:
            return left // (len(lengths) - k)
        left -= n
    return max(lengths, default=0)


def train(documents: DataFrame, labels: DataFrame, admitted=None) -> ToxicityModel | None:
    """Fit on the bounded sample; `admitted` narrows the ids that may be learnt from."""
    rows = materialize(training_rows(documents, labels, admitted), "toxicity-sample")
    most = _level([r[0] for r in rows.select(F.length("_text")).collect()], TOTAL_CHARS)
    rows = rows.select("_id", F.left("_text", F.lit(most)).alias("_text"), "_toxic").orderBy("_id").collect()
    return fit([r["_text"] for r in rows if r["_toxic"] == 1], [r["_text"] for r in rows if r["_toxic"] == 0])


def scored(documents: DataFrame, model: ToxicityModel | None, name: str = "score") -> DataFrame:
    """All rows and columns of `documents` with the score of their whole text."""
    if model is None:
        return documents.withColumn(name, F.lit(0.0))

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(model)
        shift = math.log(DECISION / (1 - DECISION))
        for texts in batches:
            shares = np.array([_share(*scorer.count(t)) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-(model.slope * (shares - model.cut) + shift))))

    return documents.withColumn(name, score(F.col("text")))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `documents` that score below `DECISION`, columns unchanged."""
    name = "_toxicity"
    while name in documents.columns:
        name += "_"
    return scored(documents, train(documents, labels), name).where(F.col(name) < DECISION).drop(name)
