"""Scans and row composition over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import sections as S, text as T
from shelfmark.operators import ranking as R
from shelfmark.operators.results import enriched_results
from shelfmark.session import new_path
from shelfmark.sources import readers, sinks

from . import query, sql as q, views
from .sql import CAT, LAB


def _corpus(t):
    return views.catalogue(t.documents).select(
        F.col("doc_id").alias("queue_id"), F.col("doc_id").alias("item_id"), "title",
        F.col("media_type").alias("type"), "text",
    )


@query("corpus_scan_s1", "SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title, lang AS type, "
       "md5(text) AS text_md5 FROM documents")
def corpus_scan(t):
    """JSON-lines round trip of the whole corpus, read strictly."""
    path = new_path(t.spark, "corpus-lines")
    sinks.append_corpus(_corpus(t), path)
    return readers.read_corpus(t.spark, path).select("item_id", "title", "type", F.md5("text").alias("text_md5"))


@query("seed_scan_s2", "SELECT doc_id, lang FROM documents")
def seed_scan(t):
    """Seed scan falling back from an absent JSON path to Parquet."""
    return readers.read_seed(
        t.spark, f"{t.folder}/no-such-seed.json", [f"{t.folder}/documents.parquet"], t.folder
    ).select("doc_id", "lang")


_ALIAS_SQL = f"""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'manga' ELSE 'anime' END AS kind,
  {q.ws('p_name')} AS a1, {q.ws("p_brand || ' ' || p_name")} AS a2 FROM part),
r AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN kind ELSE '*' END AS media_type, p_partkey AS item_id, a1, a2 FROM v)
SELECT media_type, item_id, 0 AS pos, a1 AS alias FROM r UNION ALL
SELECT media_type, item_id, 1 AS pos, a2 AS alias FROM r WHERE {q.norm('a1')} <> {q.norm('a2')}"""


def alias_entries(part):
    """Alias-map entries made from parts: typed keys, plain numeric keys, and free keys with a nested id."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "manga").otherwise("anime")
    pk = F.col("p_partkey")
    shape = pk % 3
    nested = F.to_json(F.struct(
        F.when(shape == 2, pk).alias("mal_id"), F.col("p_name").alias("title"),
        F.struct(F.array(F.concat_ws(" ", "p_brand", "p_name"), F.lit("Unknown")).alias("synonyms")).alias("titles"),
    ))
    key = F.when(shape == 0, F.concat_ws(":", kind, pk)).when(shape == 1, pk.cast("string")).otherwise(
        F.concat(F.lit("entry-"), pk.cast("string"))
    )
    return part.select(key.alias("key"), nested.alias("value"))


@query("title_alias_scan_s3", _ALIAS_SQL)
def title_alias_scan(t):
    return readers.alias_rows(alias_entries(t.part))


@query("case_scan_s4", "SELECT 'case-' || item_id AS case_id, 'manga' AS medium, 'semantic' AS query_type, text AS query, "
       "split_part(text, ' ', 1) AS target_title, item_id AS target_id FROM benchmark")
def case_scan(t):
    return readers.validated_cases(t.benchmark.select(
        F.concat(F.lit("case-"), F.col("item_id").cast("string")).alias("case_id"), F.lit("manga").alias("medium"),
        F.lit("semantic").alias("query_type"), F.col("text").alias("query"),
        F.substring_index("text", " ", 1).alias("target_title"), F.col("item_id").alias("target_id"),
    ))


def landed_pages(part):
    """Listing pages of 25 parts per type; every tenth id is not an integer."""
    pk = F.col("p_partkey")
    page = F.floor(pk / 25).cast("int") + 1
    row = F.struct(
        F.when(pk % 10 == 9, F.concat(F.lit("x"), pk.cast("string"))).otherwise(pk.cast("string")).alias("mal_id"),
        F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("members"), pk.alias("k"),
    )
    return part.groupBy(F.col("p_type").alias("media_type"), page.alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(pk.alias("k"), row.alias("r")))),
                    lambda e: F.struct(e["r"]["mal_id"].alias("mal_id"), e["r"]["title"].alias("title"),
                                       e["r"]["members"].alias("members"))).alias("data"),
        F.struct((F.max("p_partkey") % 500 < 475).alias("has_next_page")).alias("pagination"),
    )


_LISTING = """WITH b AS (SELECT p_type AS media_type, CAST(floor(p_partkey / 25) AS INT) + 1 AS page, p_partkey, p_name, p_size FROM part),
p AS (SELECT media_type, page, max(p_partkey) % 500 < 475 AS nxt FROM b GROUP BY 1, 2),
s AS (SELECT media_type, min(page) AS stop FROM p WHERE NOT nxt GROUP BY 1),
l AS (SELECT b.media_type, b.page, row_number() OVER (PARTITION BY b.media_type, b.page ORDER BY p_partkey) - 1 AS pos,
  p_partkey AS item_id, p_name AS title, p_size AS members FROM b)
"""


@query("paged_listing_s5", _LISTING + """SELECT l.* FROM l LEFT JOIN s USING (media_type)
WHERE (stop IS NULL OR page <= stop) AND item_id % 10 <> 9""")
def paged_listing(t):
    return readers.listing_rows(landed_pages(t.part))


@query("vector_scan_by_id_s6", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) AND len(embedding) > 0")
def vector_scan(t):
    return readers.vectors_by_id(t.embeddings, t.labels.select(F.col("doc_id").alias("vec_id"))).select("vec_id", "label")


@query("page_scan_s7", "SELECT page_id, url AS requested_url, url AS final_url, 200 AS status, length(html) AS html_chars FROM pages")
def page_scan(t):
    return readers.fetched_pages(t.pages).select(
        "page_id", "requested_url", "final_url", "status", F.length("html").alias("html_chars")
    )


@query("user_state_scan_s8", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def user_state_scan(t):
    """State text with every seventh row cut short, which then takes the default."""
    raw = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    state = readers.json_or_default(raw, "struct<k:long>", F.struct(F.lit(-1).cast("long").alias("k")))
    return t.events.select("event_id", state["k"].alias("k"))


# --- composition --------------------------------------------------------------

@query("base_text_p1", f"WITH {LAB} SELECT doc_id, payload FROM lab")
def base_text(t):
    return views.labelled(t.documents).select("doc_id", "payload")


def _names(c):
    return F.transform(c, lambda v: F.substring_index(v, " (", 1))


@query("enriched_text_p2", f"""WITH {LAB} SELECT doc_id, 'Type: ' || kind || chr(10) || 'Title: ' || ttl || chr(10) || 'Genres: ' ||
source || chr(10) || 'Synopsis: ' || CASE WHEN syn = '' THEN 'No synopsis available.' ELSE syn END || chr(10) || 'Characters:'
|| chr(10) || CASE WHEN len(chars) = 0 THEN 'Unknown' ELSE array_to_string(chars, '; ') END || chr(10) ||
'Character Search Aliases:' || chr(10) || CASE WHEN len(w) = 0 THEN 'Unknown' ELSE array_to_string(w[1:140], '; ') END AS payload FROM lab""")
def enriched_text(t):
    return views.labelled(t.documents).select("doc_id", S.enriched_text(
        F.col("kind"), F.col("ttl"), F.col("source"), F.col("syn"), F.col("chars"), F.col("w")
    ).alias("payload"))


@query("seed_text_p3", f"WITH {CAT} SELECT doc_id, trim(title) AS title, 'Title: ' || trim(title) || chr(10) || 'Synopsis: ' || synopsis AS payload FROM cat")
def seed_text(t):
    return views.catalogue(t.documents).select(
        "doc_id", F.trim("title").alias("title"), S.seed_text(F.trim("title"), F.col("synopsis")).alias("payload")
    )


def _roster(w, about):
    """Up to four roster entries from the first words, some of them blank."""
    return F.array(*[
        F.struct(
            F.coalesce(F.get(w, F.lit(i)) if i != 1 else F.lit(""), F.lit("")).alias("name"),
            F.lit("Main" if i == 0 else "").alias("role"),
            F.coalesce(F.get(w, F.lit(i + 4)) if about and i % 2 == 0 else F.lit(""), F.lit("")).alias("about"),
        ) for i in range(4)
    ])


@query("delta_text_p4", f"""WITH {LAB}, r AS (SELECT *, list_filter([
  CASE WHEN len(w) >= 1 THEN w[1] || ': ' || CASE WHEN len(w) >= 5 THEN w[5] ELSE 'Main' END END,
  CASE WHEN len(w) >= 3 THEN w[3] || ': ' || CASE WHEN len(w) >= 7 THEN w[7] ELSE 'No bio available.' END END,
  CASE WHEN len(w) >= 4 THEN w[4] || ': No bio available.' END], lambda x: x IS NOT NULL) AS lines FROM lab WHERE ttl <> '')
SELECT doc_id, 'Type: ' || kind || chr(10) || 'Title: ' || ttl || chr(10) || 'Genres: ' || source || chr(10) || 'Synopsis: ' ||
CASE WHEN syn = '' THEN 'No synopsis available.' ELSE syn END || chr(10) || 'Characters (max 2): ' ||
CASE WHEN len(lines) = 0 THEN 'Unknown' ELSE array_to_string(lines[1:2], ' | ') END AS payload FROM r""")
def delta_text(t):
    rows = views.labelled(t.documents).where((F.col("ttl") != "") & F.col("doc_id").isNotNull())
    lines = S.delta_character_lines(_roster(F.col("w"), True), 2)
    return rows.select("doc_id", S.delta_text(
        F.col("kind"), F.col("ttl"), F.array("source"), F.col("syn"), lines, 2
    ).alias("payload"))


@query("comma_text_p4_twin", f"""WITH {LAB} SELECT doc_id, 'Title: ' || ttl || chr(10) || 'Genres: ' || source || ', ' || media_type || chr(10) ||
'Synopsis: ' || CASE WHEN syn = '' THEN 'No synopsis available.' ELSE syn END || chr(10) || 'Characters: ' ||
CASE WHEN len(w) = 0 THEN 'Unknown' ELSE array_to_string(w[1:3], ', ') END AS payload FROM lab WHERE ttl <> ''""")
def comma_text(t):
    rows = views.labelled(t.documents).where(F.col("ttl") != "")
    return rows.select("doc_id", S.comma_text(
        F.col("ttl"), F.array("source", "media_type"), F.col("syn"), F.slice("w", 1, 3)
    ).alias("payload"))


_LINE = """WITH s AS (SELECT conv_id, turn, regexp_extract(text, '[A-Za-z]+') AS name, role,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS about FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM s WHERE name <> '')
"""


@query("character_lines_p5", _LINE + "SELECT conv_id, pos, name || ' (' || role || '): ' || about AS line FROM r WHERE pos <= 3")
def character_lines(t):
    """Conversations as rosters: blanks are skipped, then the cap applies, before anything is gathered."""
    rows = t.conversations.select(
        "conv_id", "turn", F.regexp_extract("text", "[A-Za-z]+", 0).alias("name"), "role",
        T.collapse(F.col("text")).alias("about"),
    ).where(F.col("name") != "")
    line = F.get(S.character_lines(F.array(F.struct("name", "role", "about"))), F.lit(0))
    return R.top_k(rows, ["conv_id"], ["turn"], 3, "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), line.alias("line"))


@query("record_ids_p6", """SELECT doc_id, 'manga-' || doc_id || '-chunk-' || lpad(CAST(n_chars % 7 AS VARCHAR), 3, '0') AS chunk_id,
'mal-' || doc_id || '-chunk-' || lpad(CAST(n_chars AS VARCHAR), 6, '0') AS delta_id,
lower(lang) || '-' || doc_id || '-' || (n_chars % 7) || '-' || substr(sha1(text), 1, 16) AS content_id FROM documents""")
def record_ids(t):
    idx = F.col("n_chars") % 7
    return t.documents.select(
        "doc_id", S.chunk_id(F.lit("manga"), F.col("doc_id"), idx).alias("chunk_id"),
        S.delta_chunk_id(F.col("doc_id"), F.col("n_chars")).alias("delta_id"),
        S.content_chunk_id(F.col("lang"), F.col("doc_id"), idx, F.col("text")).alias("content_id"),
    )


@query("first_title_p7", """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_name END AS a,
CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS b, p_type AS c FROM part)
SELECT p_partkey, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), '')) AS default_first,
coalesce(nullif(trim(b), ''), nullif(trim(a), ''), nullif(trim(c), '')) AS english_first FROM v""")
def first_title(t):
    pk = F.col("p_partkey")
    a = F.when(pk % 3 == 0, "  ").otherwise(F.col("p_name"))
    b, c = F.when(pk % 2 == 0, F.col("p_brand")), F.col("p_type")
    return t.part.select(
        "p_partkey", T.first_non_empty(a, b, c).alias("default_first"), T.first_non_empty(b, a, c).alias("english_first")
    )


@query("image_url_p8", """SELECT page_id, coalesce(CASE WHEN page_id % 4 = 0 THEN url || '?l' END, CASE WHEN page_id % 4 = 1 THEN url || '?i' END,
CASE WHEN page_id % 8 = 2 THEN url || '?w' END) AS image_url FROM pages""")
def image_url(t):
    pid, url = F.col("page_id"), F.col("url")

    def sizes(large, default, small):
        return F.struct(large.alias("large_image_url"), default.alias("image_url"), small.alias("small_image_url"))

    images = F.struct(
        sizes(F.when(pid % 4 == 0, F.concat(url, F.lit("?l"))).otherwise(" "),
              F.when(pid % 4 == 1, F.concat(url, F.lit("?i"))), F.lit("")).alias("jpg"),
        sizes(F.when(pid % 8 == 2, F.concat(url, F.lit("?w"))), F.lit(None).cast("string"), F.lit("")).alias("webp"),
    )
    return t.pages.select("page_id", S.image_url(images).alias("image_url"))


@query("citation_p9", """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS id, p_name, p_brand FROM part)
SELECT p_partkey, CASE WHEN id IS NULL THEN '[Source: MAL-ID unknown - Unknown]' ELSE '[Source: MAL-ID ' || id || ' - ' || p_name || ']' END AS cite,
CASE WHEN id IS NULL THEN '[Source: MAL-ID unknown - ' || p_name || ']' ELSE '[Source: MAL-ID ' || id || ' - ' || p_name || ']' END AS cite_kept,
CASE p_partkey % 3 WHEN 0 THEN '[Source: given]' WHEN 1 THEN p_name || ' / ' || 'see ' || p_brand ELSE p_name END AS cites FROM v""")
def citation(t):
    pk = F.col("p_partkey")
    item = F.when(pk % 5 != 0, pk)
    given = F.when(pk % 3 == 0, "[Source: <i></i>given]").when(pk % 3 == 1, F.concat(F.lit("see "), F.col("p_brand")))
    return t.part.select(
        "p_partkey", S.citation(item, F.col("p_name")).alias("cite"),
        S.citation(item, F.col("p_name"), keep_title_when_unknown=True).alias("cite_kept"),
        F.array_join(S.citation_list(given, F.col("p_name")), " / ").alias("cites"),
    )


SITES = {"catalog": "https://catalog.example/search?text={encoded}&sort=best", "stream": "https://stream.example/filter?keyword={plus}",
         "shelf": "https://shelf.example/s/{underscored}", "store": "https://store.example/?q={form}"}


@query("link_map_p10", """WITH v AS (SELECT p_partkey, p_name || ' & ' || p_brand AS s FROM part)
SELECT p_partkey, 'https://catalog.example/search?text=' || url_encode(s) || '&sort=best' AS catalog,
'https://stream.example/filter?keyword=' || replace(s, ' ', '+') AS stream, 'https://shelf.example/s/' || replace(s, ' ', '_') AS shelf,
'https://store.example/?q=' || replace(url_encode(s), '%20', '+') AS store FROM v""")
def link_map(t):
    m = S.link_map(F.concat_ws(" & ", "p_name", "p_brand"), SITES)
    rows = t.part.select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", *[F.col("m")[s].alias(s) for s in SITES])


@query("result_enrichment_p11", f"""WITH {LAB} SELECT doc_id, kind AS media_type, kind AS display_type,
CASE WHEN syn = '' THEN 'No synopsis available.' ELSE syn END AS synopsis,
array_to_string(list_transform(chars, lambda c: c), '; ') AS characters, source || ', ' || media_type AS genres,
'[Source: MAL-ID ' || doc_id || ' - ' || ttl || ']' AS citations FROM lab""")
def result_enrichment(t):
    """Snippet fields of every labelled document."""
    rows = views.labelled(t.documents)
    out = enriched_results(rows.select("doc_id", F.col("doc_id").alias("item_id"), F.col("ttl").alias("title"),
                             T.collapse(F.col("payload")).alias("snippet")))
    return out.select(
        "doc_id", "media_type", "display_type", "synopsis", F.array_join("characters", "; ").alias("characters"),
        F.array_join("genres", ", ").alias("genres"), F.array_join("citations", " / ").alias("citations"),
    )


@query("seed_projection_p14", f"WITH {CAT} SELECT doc_id AS id, trim(title) AS title, trim(synopsis) AS synopsis FROM cat WHERE trim(title) <> '' AND trim(synopsis) <> ''")
def seed_projection(t):
    from shelfmark.operators.corpus import seed_columns

    seed = views.catalogue(t.documents).select(
        F.col("doc_id").cast("string").alias("id"), "title", "synopsis", F.array(F.lit(0.0)).alias("embedding")
    )
    return seed_columns(seed)


@query("valid_documents_f1", f"WITH {CAT} SELECT doc_id, trim(title) AS title FROM cat WHERE trim(title) <> '' AND trim(text) <> '' AND media_type IN ('en', 'de')")
def valid_documents(t):
    from shelfmark.operators.corpus import valid_documents as valid

    rows = views.catalogue(t.documents).select(F.col("doc_id").alias("item_id"), "title", F.col("media_type").alias("type"), "text")
    return valid(rows, ("en", "de")).select(F.col("item_id").alias("doc_id"), "title")


@query("append_lines_k2", "SELECT doc_id AS item_id, lang AS type, length(text) AS chars FROM documents UNION ALL SELECT doc_id, lang, length(text) FROM documents WHERE lang = 'en'")
def append_lines(t):
    """Two appends to one JSON-lines folder, then a read of everything."""
    path = new_path(t.spark, "append-lines")
    sinks.append_corpus(_corpus(t), path)
    sinks.append_corpus(_corpus(t).where(F.col("type") == "en"), path)
    return readers.read_corpus(t.spark, path).select("item_id", "type", F.length("text").alias("chars"))


@query("bookmark_export_k6", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS rn FROM events WHERE event_type = 'click')
SELECT user_id, CAST(floor(rn / 50) AS BIGINT) AS fragment, count(*) AS n, to_json(list({'id': event_id, 'label': props} ORDER BY ts DESC, event_id DESC)) AS json FROM r GROUP BY 1, 2""")
def bookmark_export(t):
    """Newest-first JSON per user in fragments of at most 50 bookmarks."""
    clicks = t.events.where(F.col("event_type") == "click").withColumn("day", F.datediff(F.lit("2100-01-01"), F.to_date("ts")))
    ranked = R.grouped_rank(clicks, ["user_id"], F.col("day"), [F.desc("ts"), F.desc("event_id")], "rn")
    rows = ranked.select("user_id", F.floor((F.col("rn") - 1) / 50).alias("fragment"), "ts", "event_id",
                         F.col("event_id").alias("id"), F.col("props").alias("label"))
    return sinks.export_rows(rows, ["user_id"], "fragment", ["ts", "event_id"], ["id", "label"])
