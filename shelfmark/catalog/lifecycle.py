"""Upserts, set differences, payload joins and whole corpus flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import corpus as C, ranking as R, sparse as SP
from shelfmark.operators.dense import embedded
from shelfmark.plans import corpus as P
from shelfmark.session import materialize, new_path
from shelfmark.sources import quarantine, readers, sinks

from . import query, sql as q, views
from .retrieval import CHUNK_SQL


@query("upsert_k1", """SELECT vec_id, CASE WHEN label >= 5 THEN 'new' ELSE 'old' END AS version, label FROM embeddings""")
def upsert(t):
    """Old vectors (labels up to 6) upserted by new ones (labels from 5, each sent twice; the later wins)."""
    old = t.embeddings.where("label <= 6").select("vec_id", F.lit("old").alias("version"), "label")
    new = t.embeddings.where("label >= 5").select("vec_id", F.explode(F.array(F.lit("stale"), F.lit("new"))).alias("version"), "label")
    new = new.withColumn("seq", F.when(F.col("version") == "new", 2).otherwise(1))
    table = sinks.scratch_table(t.spark, "vectors", ["vec_id"])
    table.write(old.withColumn("seq", F.lit(0)))
    return table.upsert(new, ["seq"]).select("vec_id", "version", "label")


@query("stale_delete_k3", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def stale_delete(t):
    table = sinks.scratch_table(t.spark, "stale", ["vec_id"])
    table.write(t.embeddings.select("vec_id", "label"))
    return table.delete_stale(t.labels.select(F.col("doc_id").alias("vec_id")))


@query("evaluation_report_k5")
def evaluation_report(t):
    """Report written as JSON (configuration and summary, partitioned detail) and read back."""
    from shelfmark.operators import evaluation as EV

    from .evaluation import latency_rows

    path = new_path(t.spark, "report")
    rows = latency_rows(t)
    sinks.write_report(EV.summary(rows), rows, {"k": 10, "seed": 42}, path)
    return t.spark.read.json(f"{path}/summary")


@query("resume_k7", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(t):
    """Rows still to process, told by the keys already in the output."""
    path = new_path(t.spark, "resume")
    done = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    sinks.append_corpus(done.select(F.col("doc_id").alias("queue_id"), F.col("doc_id").alias("item_id"), "text"), path)
    seen = readers.read_corpus(t.spark, path, strict=False).select(F.col("queue_id").alias("doc_id")).distinct()
    return t.documents.select("doc_id").join(seen, "doc_id", "left_anti")


@query("resume_states_k7", """WITH d AS (SELECT doc_id, length(coalesce(text, '')) % 4 AS k FROM documents)
SELECT doc_id, CASE WHEN k = 3 THEN 'failed' WHEN k = 2 THEN 'retry' ELSE 'done' END AS state,
CASE WHEN k = 3 THEN 2 WHEN k = 0 THEN 0 ELSE 1 END AS attempts, CASE WHEN k = 3 THEN 'no text 2' WHEN k = 2 THEN 'no text 1' END AS error FROM d""")
def resume_states(t):
    """State of every key after a load, a resumed run and a crash that cuts lines.

    By a text's length: rows pass at once, fail once, fail once and have the line
    of their second run cut, or fail each time.
    """
    output, failed = new_path(t.spark, "resume-output"), new_path(t.spark, "resume-failed")
    queue = t.documents.select("doc_id", (F.length(F.coalesce("text", F.lit(""))) % 4).alias("k"), "text")

    def process(rows):
        bad = (F.col("k") == 3) | ((F.col("k") > 0) & (F.col("attempts") == 0))
        return rows.select(
            F.col("doc_id").alias("queue_id"), F.col("doc_id").alias("item_id"), F.lit("t").alias("title"), F.lit("manga").alias("type"), "text",
            F.when(bad, F.concat(F.lit("no text "), (F.col("attempts") + 1).cast("string"))).alias("error"))

    quarantine.run(queue, "doc_id", process, output, failed, tries=2)
    quarantine.run(queue.where("k != 2"), "doc_id", process, output, failed, tries=2)
    cut = queue.where("k = 2").select(F.format_string('{"queue_id":%d,"item_id":%d,"text":"', "doc_id", "doc_id").alias("value"))
    cut.write.mode("append").text(output)
    return quarantine.states(queue, "doc_id", output, failed, tries=2).select("doc_id", "state", "attempts", "error")


@query("quarantined_lines_s1", """SELECT doc_id AS queue_id, CASE WHEN length(coalesce(text, '')) % 3 = 1 THEN 'malformed line' WHEN length(coalesce(text, '')) % 3 = 2 THEN 'missing queue_id' END AS error FROM documents""")
def quarantined_lines(t):
    """Every line of a corpus folder of which some are cut and some lack their key, with its error."""
    path = new_path(t.spark, "mixed-lines")
    k = F.length(F.coalesce("text", F.lit(""))) % 3
    line = F.to_json(F.struct(F.when(k != 2, F.col("doc_id")).alias("queue_id"), F.col("doc_id").alias("item_id"), "text"))
    t.documents.select(F.when(k == 1, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    rows, broken = quarantine.read_split(t.spark, path)
    item = F.regexp_extract("raw", r'"item_id":(\d+)', 1).cast("long")
    return rows.select("queue_id", F.lit(None).cast("string").alias("error")).unionByName(broken.select(item.alias("queue_id"), "error"))


@query("known_id_anti_join_j1", """SELECT lang AS type, doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def known_id_anti_join(t):
    """New items only: known ids are read off stored record ids and matched as columns."""
    stored = t.labels.select(F.concat(F.lit("ns-mal-"), F.col("doc_id").cast("string"), F.lit("-chunk-000001")).alias("id"))
    known = stored.select(F.regexp_extract("id", r"(?:^|-)mal-(\d+)-chunk-\d+$", 1).try_cast("long").alias("item_id")).where(
        F.col("item_id").isNotNull()).distinct()
    listing = t.documents.select(F.col("lang").alias("type"), F.col("doc_id").alias("item_id"))
    return listing.join(known, "item_id", "left_anti").select("type", "item_id")


@query("stale_and_missing_j2", """WITH old AS (SELECT vec_id FROM embeddings WHERE label <= 6), exp AS (SELECT vec_id FROM embeddings WHERE label >= 5)
SELECT vec_id, 'stale' AS kind FROM old WHERE vec_id NOT IN (SELECT vec_id FROM exp) UNION ALL SELECT vec_id, 'missing' FROM exp WHERE vec_id NOT IN (SELECT vec_id FROM old)""")
def stale_and_missing(t):
    old, exp = t.embeddings.where("label <= 6").select("vec_id"), t.embeddings.where("label >= 5").select("vec_id")
    return old.join(exp, "vec_id", "left_anti").withColumn("kind", F.lit("stale")).unionByName(
        exp.join(old, "vec_id", "left_anti").withColumn("kind", F.lit("missing")))


@query("processed_anti_join_j3", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def processed_anti_join(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("dense_backfill_j4", f"WITH {CHUNK_SQL} SELECT 'manga-' || doc_id || '-chunk-' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS chunk_id, label FROM ch JOIN embeddings ON vec_id = doc_id AND chunk_index = 0")
def dense_backfill(t):
    """Rebuilt chunks that have a stored vector (vectors stand for first chunks)."""
    chunks = C.with_chunk_id(C.token_chunks(t.documents.select(F.col("doc_id").alias("item_id"), F.lit("manga").alias("type"), "text"), "text"))
    stored = t.embeddings.where(F.size("embedding") > 0).select(
        F.format_string("manga-%d-chunk-000", "vec_id").alias("chunk_id"), "label")
    return chunks.join(stored, "chunk_id").select("chunk_id", "label")


@query("payload_join_j10", "SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def payload_join(t):
    roster = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return t.orders.select("o_orderkey", "o_orderstatus").join(roster, "o_orderkey")


@query("strict_zip_j11", f"WITH {CHUNK_SQL} SELECT 'manga-' || doc_id || '-chunk-' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS chunk_id, len(list_distinct({q.toks('chunk_text')})) AS n_terms FROM ch")
def strict_zip(t):
    chunks = materialize(C.with_chunk_id(C.token_chunks(
        t.documents.select(F.col("doc_id").alias("item_id"), F.lit("manga").alias("type"), "text"), "text")), "zip-chunks")
    dense = embedded(chunks, "chunk_text").select("chunk_id", "embedding")
    terms = SP.term_counts(chunks, "chunk_id", "chunk_text").groupBy("chunk_id").agg(F.count("*").alias("n_terms"))
    sparse = chunks.select("chunk_id").join(terms, "chunk_id", "left").select("chunk_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    return P.strict_zip(chunks, dense, sparse).select("chunk_id", "n_terms")


@query("metadata_coalesce_j16", """SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS label, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), 'unknown') AS name
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 1) ON c_custkey = o_custkey""")
def metadata_coalesce(t):
    """Live metadata over stored rows, field by field; blanks do not overwrite."""
    live = t.customer.where("c_custkey % 4 <> 1").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("n"))
    joined = t.orders.join(live, "o_custkey", "left")
    return joined.select("o_orderkey", F.coalesce("c_mktsegment", "o_orderpriority").alias("label"),
                         F.coalesce(F.nullif(F.col("n"), F.lit("")), F.lit("unknown")).alias("name"))


@query("adaptation_join_j17", """WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 END AS via, p_name FROM part),
f AS (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT e.p_partkey, coalesce(a.p_partkey, f.k) AS companion FROM e LEFT JOIN part a ON a.p_partkey = e.via LEFT JOIN f ON f.p_name = e.p_name""")
def adaptation_join(t):
    """First adaptation edge's first anime entry, else the first anime with the same title."""
    from shelfmark.operators.joins import companions

    pk = F.col("p_partkey")
    entry = lambda kind, k: F.struct(k.alias("item_id"), F.lit(kind).alias("type"))
    relations = F.array(
        F.struct(F.lit("Sequel").alias("relation"), F.array(entry("anime", pk + 5)).alias("entry")),
        F.struct(F.when(pk % 3 == 0, "Adaptation").otherwise("Other").alias("relation"),
                 F.array(entry("manga", pk + 2), entry("Anime", pk + 1), entry("anime", pk + 3)).alias("entry")),
    )
    items = t.part.select(pk.alias("item_id"), F.col("p_name").alias("title"), relations.alias("relations"))
    anime = t.part.select(pk.alias("item_id"), F.col("p_name").alias("title"), (pk % 2 == 1).alias("is_anime"))
    return companions(items, anime).select(F.col("item_id").alias("p_partkey"), F.col("companion_id").alias("companion"))


@query("preferred_lookup_j19", """SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL THEN 'supplier' WHEN c_custkey IS NOT NULL THEN 'customer' END AS found
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey""")
def preferred_lookup(t):
    """Lookup in the preferred table, then in the alternate one."""
    from shelfmark.operators.joins import preferred

    wanted = t.part.select(F.col("p_partkey").alias("id"))
    return preferred(wanted, [
        t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("found")),
        t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("found")),
    ], "id", "found").select(F.col("id").alias("p_partkey"), "found")


# --- flows -----------------------------------------------------------------------

def corpus_rows(t):
    """Documents twice: whole, and cut to a third (so that keep-longest has work to do)."""
    base = views.catalogue(t.documents).select(
        F.col("doc_id").alias("item_id"), F.lit("manga").alias("type"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("x")).alias("title"), "text")
    short = base.withColumn("text", F.substr("text", F.lit(1), F.ceil(F.length("text") / 3).cast("int"))).withColumn("input_pos", F.lit(0))
    return short.unionByName(base.withColumn("input_pos", F.lit(1)))


@query("initial_load_r6", f"WITH {CHUNK_SQL} SELECT 'manga-' || doc_id || '-chunk-' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS chunk_id, doc_id AS item_id, md5(chunk_text) AS text_md5, len(list_distinct({q.toks('chunk_text')})) AS n_terms FROM ch")
def initial_load(t):
    out = P.initial_load(corpus_rows(t), sinks.scratch_table(t.spark, "load", ["chunk_id"]))
    return out.select("chunk_id", "item_id", F.md5("chunk_text").alias("text_md5"), "n_terms")


@query("alias_enrichment_r7")
def alias_enrichment(t):
    """Enrich labelled documents with conversation rosters, re-upsert, drop stale records, count."""
    docs = views.labelled(t.documents).select(F.lit("manga").alias("type"), F.col("doc_id").alias("item_id"), F.col("ttl").alias("title"), F.col("payload").alias("text"))
    rosters = t.conversations.select(
        F.lit("manga").alias("type"), F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"),
        F.regexp_extract("text", "[A-Za-z]+", 0).alias("name"), "role")
    store = sinks.scratch_table(t.spark, "enriched", ["chunk_id"])
    dense = embedded(materialize(P.chunked(docs), "plain-chunks"), "chunk_text")
    store.write(dense.select("chunk_id", "type", "item_id", "title", "chunk_index", "chunk_text", "embedding"))
    return P.enrich_and_reload(docs, rosters, store)


@query("sparse_backfill_r8", f"""WITH {CHUNK_SQL}, m AS (SELECT chunk_index, vec_id FROM ch LEFT JOIN embeddings ON vec_id = doc_id AND chunk_index = 0)
SELECT sum(CASE WHEN vec_id IS NOT NULL THEN 1 ELSE 0 END) AS matched, sum(CASE WHEN vec_id IS NULL THEN 1 ELSE 0 END) AS unmatched FROM m""")
def sparse_backfill(t):
    docs = t.documents.select(F.lit("manga").alias("type"), F.col("doc_id").alias("item_id"), F.substring_index("text", "\n", 1).alias("title"), "text")
    stored = t.embeddings.select(F.format_string("manga-%d-chunk-000", "vec_id").alias("chunk_id"), "embedding")
    matched, unmatched = P.backfill(docs, stored)
    return matched.agg(F.count("*").alias("matched")).select("matched", unmatched.scalar().alias("unmatched"))


@query("delta_sync_r9", f"""WITH d AS (SELECT doc_id, {q.ws("split_part(text, chr(10), 1)")} AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS syn FROM documents),
x AS (SELECT doc_id, 'Type: manga' || chr(10) || 'Title: ' || title || chr(10) || 'Genres: Unknown' || chr(10) || 'Synopsis: ' || CASE WHEN {q.ws('syn')} = '' THEN 'No synopsis available.' ELSE {q.ws('syn')} END || chr(10) || 'Characters (max 12): Unknown' AS text FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND title <> ''),
n AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM x), c AS (SELECT doc_id, unnest(range(0, greatest(0, n - 51) + 1, 450)) // 450 AS i FROM n)
SELECT 'manga-' || doc_id || '-chunk-' || lpad(CAST(i AS VARCHAR), 3, '0') AS chunk_id, 'delta' AS origin FROM c
UNION ALL SELECT 'manga-' || doc_id || '-chunk-000', 'stored' FROM labels""")
def delta_sync(t):
    """A store that knows the labelled documents, then a sync of the whole listing: only the others are added."""
    store = sinks.scratch_table(t.spark, "delta", ["chunk_id"])
    doc = F.col("doc_id")
    store.write(t.labels.select(
        F.format_string("manga-%d-chunk-000", doc).alias("chunk_id"), F.lit("manga").alias("type"), doc.alias("item_id"),
        F.lit("stored").alias("title"), F.lit(0).alias("chunk_index"), F.lit("").alias("chunk_text"), F.array(F.lit(0.0)).alias("embedding")))
    rows = views.catalogue(t.documents)
    payloads = rows.select(F.lit("manga").alias("type"), doc.alias("item_id"), "title", "synopsis", F.array().cast("array<string>").alias("genres"),
                           F.array().cast("array<struct<name:string,role:string,about:string>>").alias("roster"))
    out = P.delta_sync(rows.select(F.lit("manga").alias("type"), doc.alias("item_id")), payloads, store)
    return out.select("chunk_id", F.when(F.col("title") == "stored", "stored").otherwise("delta").alias("origin"))


# --- windows over the corpus --------------------------------------------------------

@query("queue_index_w3", "SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS queue_id FROM documents")
def queue_index(t):
    """Run-global index in (type, position) order, numbered range by range."""
    return R.range_index(t.documents.select("doc_id", "lang"), ["lang", "doc_id"], "queue_id").select("doc_id", "queue_id")
