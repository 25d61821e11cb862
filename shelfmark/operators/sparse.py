"""BM25: statistics, document and query weights, exact top-k over stored postings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfmark.functions import lexicon as L, text as T
from shelfmark.session import materialize, new_path, spread

from . import scoring as SC

# Documents of a range (about) and of a folder of terms; both numbers are fixed when an index is first built.
RANGE_DOCS = 256
BUCKET_DOCS = 50_000
# Kept for callers that set it; no result depends on it.
ASIDE = 0.05

_BLOCK = "range int, term string, postings array<struct<doc:{kind},tf:int,doc_len:int>>, n long, max_tf int, min_len int, tokens long, bucket int"


def term_counts(docs: DataFrame, doc: str, text: str, tokenize=T.tokens) -> DataFrame:
    """(doc, term, tf, doc_len); a document's terms are combined before the shuffle."""
    toks = spread(docs.select(doc, text)).select(doc, tokenize(F.col(text)).alias("_t"))
    terms = T.exploded(toks.select(doc, "_t", F.size("_t").alias("doc_len")), F.col("_t"), "term")
    return terms.groupBy(doc, "term").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def counted(docs: DataFrame, doc: str, text: str, tokenize=T.tokens) -> tuple[DataFrame, DataFrame]:
    """Written term counts and the one-row statistics that follow from them: the text is tokenised once."""
    counts = materialize(term_counts(docs, doc, text, tokenize), "term-counts")
    tokens = counts.agg(F.sum("tf").alias("tokens"))
    n_docs = docs.select(doc).agg(F.count("*").alias("n_docs"))
    return counts, n_docs.select("n_docs", (F.coalesce(tokens.scalar(), F.lit(0)) / F.greatest("n_docs", F.lit(1))).alias("avgdl"))


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def document_weight(tf: Column, doc_len: Column, avgdl: Column, k1: float = L.BM25_K1, b: float = L.BM25_B) -> Column:
    return tf / (tf + k1 * (1.0 - b + b * doc_len / avgdl))


def document_weights(terms: DataFrame, stats: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, term, weight) from raw counts and the one-row statistics."""
    return terms.select(
        doc, "term", document_weight(F.col("tf"), F.col("doc_len"), stats.select("avgdl").scalar()).alias("weight")
    )


def query_weights(queries: DataFrame, df_table: DataFrame, stats: DataFrame, query: str = "query_id",
                  text: str = "query", tokenize=T.tokens) -> DataFrame:
    """(query, term, weight): inverse document frequency of each distinct term, summing to 1 per query.

    Unknown terms take part in the normalisation as if one document held them.
    """
    toks = queries.select(query, F.array_distinct(tokenize(F.col(text))).alias("_t"))
    terms = T.exploded(toks, F.col("_t"), "term").select(query, "term")
    idf = (
        terms.join(df_table, "term", "left")
        .select(query, "term", "df",
                F.log((stats.select("n_docs").scalar() + 1) / (F.coalesce("df", F.lit(1)) + 0.5)).alias("idf"))
    )
    total = F.sum("idf").over(Window.partitionBy(query))
    return idf.select(query, "term", "df", (F.col("idf") / total).alias("weight"))


def _counted_in_rows(docs: DataFrame, doc: str, text: str, tokenize) -> DataFrame:
    """(doc, doc_len, term, tf) of every distinct term, and one row with a null term per document.

    A document's tokens are sorted and counted inside its own row, so that
    nothing is shuffled.
    """
    none = F.array().cast("array<string>")
    rows = spread(docs.select(F.col(doc).alias("doc"), text)).select("doc", F.sort_array(F.coalesce(tokenize(F.col(text)), none)).alias("_s"))
    rows = rows.withColumn("doc_len", F.size("_s")).withColumn("_at", F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))),
        lambda i: (i <= F.size("_s")) & ((i == 1) | (F.get("_s", i - 1) != F.get("_s", i - 2)))))
    runs = F.transform("_at", lambda i, j: F.struct(
        F.get("_s", i - 1).alias("term"), (F.coalesce(F.get("_at", j + 1), F.col("doc_len") + 1) - i).alias("tf")))
    mark = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf")))
    return rows.select("doc", "doc_len", F.inline(F.concat(mark, runs)))


def search(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", text: str = "text", query: str = "query_id",
           query_text: str = "query", tokenize=T.tokens, margin: float = 2e-9) -> DataFrame:
    """Exact top-k of one table of queries over texts that need no stored index: (query, doc, score, rank), written.

    The texts are tokenised where they are read. Only postings of terms that a
    query asks for leave a task: they are written once, give the frequencies and
    totals, and move once to the parts that score them. Rows of one id are one
    document.
    """
    named = T.exploded(queries.select(F.array_distinct(tokenize(F.col(query_text))).alias("_t")), F.col("_t"), "term").select("term").distinct()
    numbers = materialize(named.withColumn("no", F.monotonically_increasing_id()), "asked-terms")
    rows = _counted_in_rows(docs, doc, text, tokenize).join(numbers, "term", "left").where("no IS NOT NULL OR term IS NULL")
    held = materialize(rows.select("doc", "doc_len", "no", "tf"), "asked-postings")
    marks, found = held.where("no IS NULL"), held.where("no IS NOT NULL")
    n_docs = F.count("*")
    stats = materialize(marks.agg(
        n_docs.alias("n_docs"), (F.coalesce(F.sum("doc_len"), F.lit(0)) / F.greatest(n_docs, F.lit(1))).alias("avgdl")), "search-totals")
    if not marks.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        lengths = marks.groupBy("doc").agg(F.sum("doc_len").alias("doc_len"))
        merged = found.groupBy("doc", "no").agg(F.sum("tf").alias("tf")).join(lengths, "doc", "left")
        found = materialize(merged, "merged-postings")
    counts = materialize(found.groupBy("no").agg(F.count("*").alias("df")).join(numbers, "no"), "asked-frequencies")
    weights = query_weights(queries, counts.select("term", "df"), stats, query, query_text, tokenize)
    asked = SparseIndex.numbered(weights.where("df IS NOT NULL"), numbers, query, ["term"])
    n_parts = SC.parts_for(stats.first()["n_docs"], counts.agg(F.sum("df")).first()[0] or 0)
    weight = document_weight(F.col("tf"), F.col("doc_len"), stats.select("avgdl").scalar())
    entries = found.where("doc IS NOT NULL").select(SC.part_of(F.col("doc"), n_parts).alias("part"), "doc", "no", weight.alias("weight"))
    parts = SC.doc_parts(entries, docs.schema[doc].dataType.simpleString())
    best = SC.top_scored(parts, n_parts, asked.withColumn("vector", F.lit(None).cast("array<double>")), k, margin)
    # Written, so that joins know how few rows these are and do not move the texts beside them.
    return materialize(best.select(F.col("id").alias(query), F.col("doc").alias(doc), "score", "rank"), "search-hits")


class SparseIndex:
    """Stored postings in blocks, document frequencies and totals.

    `blocks`: bucket, term, range, n, max_tf, min_len, postings (doc, tf,
    doc_len). Documents fall into ranges of about `RANGE_DOCS` by a hash of
    their id; a block holds the postings of one term in one range, so no row and
    no join key grows with the corpus. Folders go by a hash of the term, files
    are sorted by term: a search reads the folders of its terms.

    Raw counts are stored; weights follow from the statistics at read time.
    Blocks, frequencies and totals add up: documents that are new go into
    further blocks of the same ranges (`append`).
    """

    def __init__(self, blocks: DataFrame, df_table: DataFrame, stats: DataFrame, ranges: int, buckets: int, doc: str = "doc_id",
                 path: str | None = None):
        self.blocks, self.df_table, self.stats, self.doc = blocks, df_table, stats, doc
        self.ranges, self.buckets, self.path = ranges, buckets, path

    @classmethod
    def build(cls, docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenize=T.tokens, path: str | None = None) -> "SparseIndex":
        """Index `docs` under `path` (a fresh folder of the session's own without one), which must hold no index."""
        spark = docs.sparkSession
        path = (path or new_path(spark, "sparse-index")).rstrip("/")
        n = docs.select(doc).count()
        cls._store(docs, n, doc, text, tokenize, path, max(1, -(-n // RANGE_DOCS)), 8 << (n // BUCKET_DOCS).bit_length(), "errorifexists")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "SparseIndex":
        """The index stored under `path`: the parts that its totals name, so a write that failed half-way is not seen."""
        path = path.rstrip("/")
        rows = spark.read.parquet(f"{path}/totals")
        named = rows.select("part", "ranges", "buckets", "doc", "kind").collect()   # one row per build or append
        first = named[0]

        def parts(table: str, schema: str) -> DataFrame:
            folders = [f"{path}/{table}/part={row.part}" for row in named]
            return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*folders).drop("part")

        sums = rows.agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
        stats = sums.select("n_docs", (F.col("tokens") / F.greatest("n_docs", F.lit(1))).alias("avgdl"))
        terms = parts("terms", "term string, df long, tokens long")
        df_table = terms if len(named) == 1 else terms.groupBy("term").agg(F.sum("df").alias("df"))
        return cls(parts("blocks", _BLOCK.format(kind=first.kind)), df_table, stats, first.ranges, first.buckets, first.doc, path)

    def append(self, docs: DataFrame, text: str = "text", tokenize=T.tokens) -> "SparseIndex":
        """Add documents whose ids the index does not hold; the index that is returned sees them."""
        n = docs.select(self.doc).count()
        if n:
            self._store(docs, n, self.doc, text, tokenize, self.path, self.ranges, self.buckets, "append")
        return self.open(docs.sparkSession, self.path)

    @staticmethod
    def _store(docs, n, doc, text, tokenize, path, ranges, buckets, mode) -> None:
        spark, part = docs.sparkSession, uuid.uuid4().hex
        # The texts move once, to the task of their range; counting and grouping stay there.
        placed = docs.select(doc, text, _range_of(F.col(doc), ranges).alias("range")).repartition("range")
        toks = placed.select(doc, "range", tokenize(F.col(text)).alias("_t"))
        terms = T.exploded(toks.select(doc, "range", "_t", F.size("_t").alias("doc_len")), F.col("_t"), "term")
        counts = terms.groupBy("range", doc, "term").agg(F.count("*").cast("int").alias("tf"), F.first("doc_len").alias("doc_len"))
        blocks = counts.groupBy("range", "term").agg(
            F.collect_list(F.struct(F.col(doc).alias("doc"), "tf", "doc_len")).alias("postings"), F.count("*").alias("n"),
            F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.sum("tf").alias("tokens"),
        ).withColumn("bucket", _bucket_of(F.col("term"), buckets))
        # Adaptive execution splits a folder that is too large for one task.
        blocks.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(
            f"{path}/blocks/part={part}")
        kind = docs.schema[doc].dataType.simpleString()
        blocks = spark.read.schema(_BLOCK.format(kind=kind)).parquet(f"{path}/blocks/part={part}")
        summed = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("tokens").alias("tokens"))
        summed.write.parquet(f"{path}/terms/part={part}")
        tokens = spark.read.schema(summed.schema).parquet(f"{path}/terms/part={part}").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        tokens.select(
            F.lit(n).cast("long").alias("n_docs"), "tokens", F.lit(ranges).alias("ranges"), F.lit(buckets).alias("buckets"),
            F.lit(doc).alias("doc"), F.lit(kind).alias("kind"), F.lit(part).alias("part"),
        ).write.mode(mode).parquet(f"{path}/totals")

    def query_terms(self, queries: DataFrame, query: str = "query_id", text: str = "query", tokenize=T.tokens) -> DataFrame:
        """(query, term, df, weight, bucket) of the query terms that documents hold."""
        w = query_weights(queries, self.df_table.select("term", "df"), self.stats, query, text, tokenize)
        return w.where(F.col("df").isNotNull()).withColumn("bucket", _bucket_of(F.col("term"), self.buckets))

    def _weight(self, tf: str, doc_len: str) -> Column:
        return document_weight(F.col(tf), F.col(doc_len), self.stats.select("avgdl").scalar())

    def holding(self, terms: DataFrame) -> "SparseIndex":
        """The part of the index that holds the given terms, written: the one pass over the stored blocks, in the folders of the terms."""
        wanted = terms.where("bucket >= 0").select("bucket", "term").distinct()
        held = materialize(self.blocks.join(wanted, ["bucket", "term"], "left_semi"), "query-blocks")
        return SparseIndex(held, self.df_table, self.stats, self.ranges, self.buckets, self.doc)

    def postings(self, wanted: DataFrame, query: str = "query_id") -> DataFrame:
        """(query, range, doc, score): what the postings of (query, bucket, term, weight) add, of the given ranges if there is a column `range`."""
        keys = ["bucket", "term", *(["range"] if "range" in wanted.columns else [])]
        side = wanted.where("bucket >= 0").select(query, *keys, F.col("weight").alias("_w"))
        hit = self.blocks.select("bucket", "term", "range", "postings").join(side, keys)
        rows = hit.select(query, "range", "_w", F.inline("postings"))
        return rows.select(query, "range", F.col("doc").alias(self.doc), (self._weight("tf", "doc_len") * F.col("_w")).alias("score"))

    def scores(self, terms: DataFrame, query: str = "query_id") -> DataFrame:
        """Scores of all documents that share a term with a query."""
        return self.postings(terms.select(query, "bucket", "term", "weight"), query).groupBy(query, self.doc).agg(F.sum("score").alias("score"))

    def _found(self, wanted: DataFrame, query: str) -> DataFrame:
        """(query, doc, score) of the postings of (query, doc, range, bucket, term, weight), one looked up in each block."""
        side = wanted.where("bucket >= 0").select(query, self.doc, "range", "bucket", "term", F.col("weight").alias("_w"))
        hit = self.blocks.select("bucket", "term", "range", "postings").join(side, ["bucket", "term", "range"])
        own = hit.select(query, self.doc, "_w", F.inline(F.filter("postings", lambda p: p["doc"] == F.col(self.doc))))
        return own.select(query, self.doc, (self._weight("tf", "doc_len") * F.col("_w")).alias("score"))

    def pair_scores(self, pairs: DataFrame, terms: DataFrame, query: str = "query_id") -> DataFrame:
        """Full scores of (query, doc) pairs; pairs without a common term are left out."""
        placed = pairs.select(query, self.doc, _range_of(F.col(self.doc), self.ranges).alias("range"))
        wanted = placed.join(terms.select(query, "bucket", "term", "weight"), query)
        return self._found(wanted, query).groupBy(query, self.doc).agg(F.sum("score").alias("score"))

    def parts(self, terms: DataFrame, docs: int | None = None) -> int:
        """How many parts the documents (`docs` of them, if not those of the index) make when they hold the postings of the query terms."""
        postings = terms.select("term", "df").distinct().agg(F.sum("df")).first()[0]
        return SC.parts_for(self.stats.first()["n_docs"] if docs is None else docs, postings or 0)

    def entries(self, terms: DataFrame, n_parts: int) -> tuple[DataFrame, DataFrame]:
        """(part, doc, no, weight) of the postings of the query terms, which are read once, and (query term, no)."""
        named = terms.select("bucket", "term").distinct().withColumn("no", F.monotonically_increasing_id())
        numbers = materialize(named, "term-numbers")
        held = self.holding(terms).blocks.join(numbers, ["bucket", "term"])
        rows = held.select("no", F.inline("postings"))
        return rows.select(SC.part_of(F.col("doc"), n_parts).alias("part"), "doc", "no", self._weight("tf", "doc_len").alias("weight")), numbers

    @staticmethod
    def numbered(terms: DataFrame, numbers: DataFrame, query: str = "query_id", keys: tuple | list = ("bucket", "term")) -> DataFrame:
        """(id, nos, weights): the terms of every query, in one order."""
        rows = terms.join(numbers, list(keys)).groupBy(F.col(query).alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("no", "weight"))).alias("t"))
        return rows.select("id", F.col("t.no").alias("nos"), F.col("t.weight").alias("weights"))

    def top(self, queries: DataFrame, k: int, query: str = "query_id", text: str = "query", tokenize=T.tokens, margin: float = 2e-9) -> DataFrame:
        """Exact top-k per query: (query, doc, score, rank).

        The blocks of the query terms are read once and dealt to parts of the
        documents. A part scores all queries, and leaves those out of a tile of
        documents whose bound there stays below their k-th best score so far; k
        documents per query leave a part. So the shuffle holds postings once,
        not once for every query that asks for them.
        """
        terms = materialize(self.query_terms(queries, query, text, tokenize), "query-terms")
        n_parts = self.parts(terms)
        entries, numbers = self.entries(terms, n_parts)
        parts = SC.doc_parts(entries, self.blocks.schema["postings"].dataType.elementType["doc"].dataType.simpleString())
        asked = self.numbered(terms, numbers, query).withColumn("vector", F.lit(None).cast("array<double>"))
        return SC.top_scored(parts, n_parts, asked, k, margin).select(F.col("id").alias(query), F.col("doc").alias(self.doc), "score", "rank")


def _range_of(doc: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(ranges)).cast("int")


def _bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
