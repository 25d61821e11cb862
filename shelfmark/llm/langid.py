"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and the
1- to 3-grams of the result are hashed to `BUCKETS` features: frequency in the
text times inverse document frequency. Document frequencies are counted over all
rows that may be learnt from. The weights are fitted by follow-the-regularised-
leader with an elastic net on a bounded sample, `SAMPLE` rows of each language
(smallest hash of the id first; of rows that share an id and a language the one
with the smallest hash of its text); a fifth of the sample is kept back to fit the
temperature that calibrates the probabilities. Every text is scored whole.

Defined cases: a null text or one without letters is `und` with score 0, and so
is every text when there is nothing to learn from; repeated rows agree; ties go
to the first language in code point order; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

BUCKETS = 1 << 16
SAMPLE = 400
SHARES = 16
UNKNOWN = "und"
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SCALE = 30.0        # of the TF-IDF features, which are shares of a text
CHUNK = 1 << 20     # characters hashed at a time


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray       # (BUCKETS, languages): idf times weight
    bias: np.ndarray
    temperature: float


def _code_points(text: str, other) -> Iterator[np.ndarray]:
    """Letters and single spaces as code points, a bounded part of the text at a time.

    Parts overlap by the two letters that 3-grams reach back.
    """
    before = ""
    for at in range(0, len(text), CHUNK):
        part = before + other.sub(" ", text[at:at + CHUNK].lower())
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        before = part[-2:]


def _buckets(points: np.ndarray, first: bool) -> np.ndarray:
    """Feature numbers of all 1-, 2- and 3-grams; later parts skip what their first letters began."""
    c = points.astype(np.uint64)
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    one = c * m1
    parts = [one if first else one[2:]]
    if len(c) > 1:
        two = one[:-1] + c[1:] * m2
        parts.append(two if first else two[1:])
    if len(c) > 2:
        parts.append((one[:-2] + c[1:-1] * m2) ^ (c[2:] * m3))
    h = np.concatenate(parts)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64)


def _features(text: str | None, other, letter) -> Iterator[np.ndarray]:
    if text and letter.search(text):
        for i, points in enumerate(_code_points(text, other)):
            yield _buckets(points, i == 0)


def _patterns():
    return regex.compile(r"[^\p{L}]+"), regex.compile(r"\p{L}")


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts of `rows` hold each feature, and how many texts there are."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        other, letter = _patterns()
        seen, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                mark = np.zeros(BUCKETS, dtype=bool)
                for part in _features(text, other, letter):
                    mark[part] = True
                seen += mark
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], n)})

    # One row per feature, however many texts: at most BUCKETS + 1 numbers reach the driver.
    found = rows.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(BUCKETS, dtype=np.int64)
    inside = found["bucket"] >= 0
    frequency[found["bucket"][inside]] = found["n"][inside]
    return frequency, int(found["n"][~inside].sum())


def sample_of(rows: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The bounded training sample: (language, features, counts), in a fixed order."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # First within shares of a language, so that one language is no single task: the second step sees SHARES * SAMPLE ids of it at most.
    shared = rows.select("doc_id", "lang").distinct().withColumn("_share", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES)))
    within = F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))
    kept = shared.withColumn("_k", within).where(F.col("_k") <= SAMPLE).drop("_k", "_share")
    ids = kept.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_k") <= SAMPLE)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_k")
    # At most SAMPLE ids per language to be told apart: a bound for the hint.
    chosen = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    # One row per id and language, reduced before the shuffle; features of a text are bounded by BUCKETS.
    chosen = chosen.groupBy("_k", "lang", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        other, letter = _patterns()
        for pdf in batches:
            out = []
            for k, lang, doc_id, text in pdf.itertuples(index=False):
                counts = np.zeros(BUCKETS, dtype=np.int64)
                for part in _features(text, other, letter):
                    counts += np.bincount(part, minlength=BUCKETS)
                at = np.flatnonzero(counts)
                out.append((k, lang, doc_id, at.astype(np.int32), counts[at].astype(np.int32)))
            yield pd.DataFrame(out, columns=["k", "lang", "doc_id", "at", "n"])

    found = chosen.mapInPandas(featured, "k int, lang string, doc_id long, at array<int>, n array<int>").collect()
    found = sorted(found, key=lambda r: (r["k"], r["lang"], len(r["at"])))
    return [(r["lang"], np.array(r["at"], dtype=np.int64), np.array(r["n"], dtype=float)) for r in found if r["at"]]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], frequency: np.ndarray, documents: int) -> LanguageModel | None:
    """Follow-the-regularised-leader with an elastic net, then the temperature."""
    languages = sorted({lang for lang, _, _ in sample})
    if not languages:
        return None
    idf = np.log((1 + documents) / (1 + frequency)) + 0.05
    number = {lang: i for i, lang in enumerate(languages)}
    k = len(languages)
    rows = [(number[lang], at, SCALE * idf[at] * n / n.sum()) for lang, at, n in sample]
    kept = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    learnt = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    z, s = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    bias = np.zeros(k)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) <= L1, 0.0, shrunk / ((BETA + np.sqrt(s[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(learnt)):
            y, at, x = learnt[i]
            w = weights(at)
            p = _softmax(x @ w + bias)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / ALPHA
            z[at] += g - sigma * w
            s[at] += g * g
            bias -= 0.05 * p
    w = weights(np.arange(BUCKETS))
    logits = np.array([x @ w[at] + bias for _, at, x in kept])
    truth = np.array([y for y, _, _ in kept])
    loss = {}
    for t in np.geomspace(0.05, 20, 121):
        p = _softmax(logits / t)[np.arange(len(truth)), truth]
        loss[float(t)] = -np.log(np.maximum(p, 1e-300)).mean() + 1e-4 * abs(np.log(t))
    temperature = min(loss, key=loss.get)
    return LanguageModel(languages, (SCALE * idf[:, None] * w).astype(np.float64), bias, temperature)


def train(rows: DataFrame) -> LanguageModel | None:
    """Fit on rows (doc_id, text, lang); rows without text or language are not learnt from."""
    rows = rows.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    frequency, n = document_frequencies(rows)
    return fit(sample_of(rows), frequency, n)


def identified(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """`documents` with lang_pred and score of each whole text."""
    if model is None:
        return documents.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    spark = documents.sparkSession
    # BUCKETS x languages numbers, whatever the data; plain values, so that workers need no class of this package.
    shared = spark.sparkContext.broadcast((model.languages, model.table, model.bias, model.temperature))

    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        other, letter = _patterns()
        languages, table, bias, temperature = shared.value
        for texts in batches:
            names, scores = [], []
            for text in texts:
                total, n = np.zeros(len(languages)), 0
                for part in _features(text, other, letter):
                    total += table[part].sum(axis=0)
                    n += len(part)
                if n == 0:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax((total / n + bias) / temperature)
                best = int(np.argmax(p))
                names.append(languages[best])
                scores.append(float(p[best]))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return documents.withColumn("_found", predict(F.col("text"))).withColumns(
        {"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}
    ).drop("_found")
