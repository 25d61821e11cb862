"""Corpus lifecycle: statistics, load, enrichment, backfill, delta sync."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions import sections as S, text as T
from shelfmark.operators import corpus as C, sparse as SP
from shelfmark.operators.dense import embedded
from shelfmark.session import materialize, spread
from shelfmark.sources.sinks import KeyedTable, last_per_key


@dataclass
class SparseParameters:
    df_table: DataFrame
    stats: DataFrame


def load_or_fit(spark: SparkSession, docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> SparseParameters:
    """Stored BM25 parameters if there are any, else fitted on `docs` and stored."""
    df_store, stat_store = KeyedTable(spark, f"{path}/df", ["term"]), KeyedTable(spark, f"{path}/stats", ["name"], 1)
    if not (df_store.exists() and stat_store.exists()):
        counts, stats = SP.counted(docs, doc, text)
        stat_store.write(stats.withColumn("name", F.lit("corpus")))
        df_store.write(SP.document_frequency(counts))
    return SparseParameters(df_store.read(), stat_store.read().drop("name"))


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks with their ids: type, item_id, title, chunk_index, chunk_id, chunk_text."""
    return C.with_chunk_id(C.token_chunks(spread(docs.select("type", "item_id", "title", "text")), "text"))


def records(chunks: DataFrame, parameters: SparseParameters | None = None, encoder=None) -> tuple[DataFrame, DataFrame]:
    """Dense records and sparse postings of chunks, keyed by chunk id.

    Every chunk has one record; postings carry weights under the given
    parameters, or under parameters fitted on these chunks.
    """
    dense = embedded(chunks, "chunk_text", encoder=encoder)
    counts, fitted = SP.counted(chunks, "chunk_id", "chunk_text")
    stats = fitted if parameters is None else parameters.stats
    return dense, SP.document_weights(counts, stats, "chunk_id")


def strict_zip(chunks: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Chunk, dense and sparse sides joined by chunk id; the job fails when a side lacks a chunk.

    `sparse` has one row per chunk (chunk_id, n_terms).
    """
    joined = chunks.join(dense, "chunk_id", "full_outer").join(sparse, "chunk_id", "full_outer")
    complete = F.col("chunk_text").isNotNull() & F.col("embedding").isNotNull() & F.col("n_terms").isNotNull()
    return joined.withColumn("chunk_id", F.when(complete, F.col("chunk_id")).otherwise(
        F.raise_error(F.concat(F.lit("incomplete chunk: "), F.coalesce("chunk_id", F.lit("null"))))
    ))


def initial_load(docs: DataFrame, store: KeyedTable, position: str = "input_pos") -> DataFrame:
    """Validate, keep the longest text per item, chunk, encode and store as a new version."""
    kept = C.keep_longest(C.valid_documents(docs), ["type", "item_id"], position=position)
    chunks = materialize(chunked(kept), "load-chunks")
    dense, postings = records(chunks)
    terms = postings.groupBy("chunk_id").agg(F.count("*").alias("n_terms"))
    every = chunks.select("chunk_id").join(terms, "chunk_id", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    out = strict_zip(chunks, dense.select("chunk_id", "embedding"), every)
    return store.write(out)


def load_counters(before: DataFrame, incoming: DataFrame, after: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row of reconciliation counts: before, upserted, after, stale (gone) and missing (expected, absent)."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    stale = before.select(key).join(incoming.select(key), key, "left_anti")
    missing = incoming.select(key).join(after.select(key), key, "left_anti")
    return n(before, "before").select(
        "before", n(incoming, "x").scalar().alias("upserted"), n(after, "x").scalar().alias("after"),
        n(stale, "x").scalar().alias("stale"), n(missing, "x").scalar().alias("missing"),
    )


def enriched_documents(docs: DataFrame, rosters: DataFrame, cap: int = 40) -> DataFrame:
    """Documents with roster and alias sections.

    `rosters`: type, item_id, pos, name, role; blanks are skipped, then the cap
    applies per item, so an item never gathers more than `cap` entries.
    """
    from shelfmark.operators.ranking import top_k

    named = rosters.withColumn("name", T.collapse(F.col("name"))).where(F.col("name") != "")
    kept = top_k(named, ["type", "item_id"], ["pos"], cap, "_n")
    lists = kept.groupBy("type", "item_id").agg(F.array_sort(F.collect_list(F.struct("_n", "name", "role"))).alias("r"))
    joined = docs.join(lists, ["type", "item_id"], "left").withColumn(
        "names", F.coalesce(F.transform("r", lambda e: e["name"]), F.array().cast("array<string>"))
    )
    lines = F.transform("r", lambda e: F.concat(
        e["name"], F.lit(" ("), S.or_sentinel(T.collapse(e["role"]), "Unknown role"), F.lit(")")))
    aliased = S.with_name_aliases(joined.withColumn("entries", F.coalesce(lines, F.array().cast("array<string>"))), F.col("names"))
    fields = aliased.withColumn("f", S.text_fields(F.col("text")))
    return fields.withColumn("text", S.enriched_text(
        F.col("type"), F.col("title"), F.col("f.genres"), F.col("f.synopsis"), F.col("entries"), F.col("aliases")
    )).drop("r", "names", "entries", "f")


def enrich_and_reload(docs: DataFrame, rosters: DataFrame, store: KeyedTable, done: DataFrame | None = None) -> DataFrame:
    """Enrich unprocessed documents, upsert their records, delete stale ones, and count."""
    todo = docs if done is None else docs.join(done.select("type", "item_id"), ["type", "item_id"], "left_anti")
    chunks = materialize(chunked(enriched_documents(todo, rosters)), "enriched-chunks")
    dense = embedded(chunks, "chunk_text")
    before = store.read() if store.exists() else None
    incoming = materialize(dense.select("chunk_id", "type", "item_id", "title", "chunk_index", "chunk_text", "embedding"), "enriched-records")
    before = before if before is None else materialize(before.select("chunk_id"), "enriched-before")
    after = store.upsert(incoming, ["title", "chunk_text"])
    if done is None:
        after = store.delete_stale(incoming)
    return load_counters(incoming.limit(0) if before is None else before, incoming, after)


def backfill(docs: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuild chunk text, aliases and ids while keeping stored dense vectors.

    `stored`: chunk_id, embedding. Returns the matched records and a one-row
    count of rebuilt chunks without a stored vector.
    """
    aliased = S.with_text_aliases(docs, "text").withColumn("character_aliases", F.array_join("aliases", "; "))
    rebuilt = C.with_chunk_id(C.token_chunks(aliased.select("type", "item_id", "title", "character_aliases", "text"), "text"))
    usable = stored.where(F.size("embedding") > 0).select("chunk_id", "embedding")
    matched = rebuilt.join(usable, "chunk_id")
    unmatched = rebuilt.join(usable.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("unmatched"))
    return matched, unmatched


def delta_sync(listing: DataFrame, payloads: DataFrame, store: KeyedTable, cap: int = 12, position: str | None = None) -> DataFrame:
    """Add listed items the store does not hold: compose, chunk, encode, upsert.

    Known items are told by their (type, item_id) columns. `payloads`: type,
    item_id, title, genres, synopsis, roster; of several payloads of one item
    the last along the column `position` counts, without one the last by title
    and text.
    """
    known = store.read().select("type", "item_id").distinct() if store.exists() else listing.limit(0).select("type", "item_id")
    new = listing.select("type", "item_id").distinct().join(known, ["type", "item_id"], "left_anti")
    rows = payloads.join(new, ["type", "item_id"], "left_semi").where(
        F.col("item_id").isNotNull() & (T.collapse(F.col("title")) != "")
    )
    composed = rows.select("type", "item_id", "title", *([position] if position else []), S.delta_text(
        F.col("type"), T.collapse(F.col("title")), F.col("genres"), T.collapse(F.col("synopsis")),
        S.delta_character_lines(F.col("roster"), cap), cap,
    ).alias("text"))
    docs = last_per_key(composed, ["type", "item_id"], [position] if position else ["title", "text"])
    # The store holds no postings, so none are counted.
    dense = embedded(materialize(chunked(docs), "delta-chunks"), "chunk_text")
    return store.upsert(dense.select("chunk_id", "type", "item_id", "title", "chunk_index", "chunk_text", "embedding"), ["chunk_text"])
