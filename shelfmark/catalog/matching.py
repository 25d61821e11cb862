"""Record matching, title search and suggestions over the parts catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import lexicon as L, text as T, titles as TT
from shelfmark.operators import lexicon as LEX, lists as LS, matching as M, ranking as R
from shelfmark.plans import search as P
from shelfmark.session import materialize, spread
from shelfmark.sources import readers

from . import query, sql as q, views
from .corpus import _ALIAS_SQL, alias_entries
from .retrieval import chunk_table
from .similarity import LISTING_SCORE, listing_parts, ordinal_sql, suggestion_set

KIND = "CASE WHEN p_partkey % 2 = 0 THEN 'manga' ELSE 'anime' END"


def kind():
    return F.when(F.col("p_partkey") % 2 == 0, "manga").otherwise("anime")


def entries(part):
    return part.select(kind().alias("media_type"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


def index(t):
    part = spread(t.part)
    return M.alias_index(entries(part), readers.alias_rows(alias_entries(part)))


def part_search(t):
    """Title search over the parts, whose index is written once for all searches of a query."""
    aliases = materialize(index(t), "alias-index")
    return lambda queries: P.title_search(queries, aliases)


# Title queries: every distinct name as is, with lengthened vowels, misspelt, and with a word added.
_TQ = f"""nm AS (SELECT p_name AS n, min(p_partkey) AS k FROM part GROUP BY 1),
tq AS (SELECT k * 4 + v AS query_id, CASE v WHEN 0 THEN n WHEN 1 THEN replace(n, 'o', 'ou') WHEN 2 THEN substr(n, 1, length(n) - 1) ELSE n || ' Special' END AS query FROM nm, (VALUES (0), (1), (2), (3)) x(v))"""


def title_queries(part):
    names = part.groupBy(F.col("p_name").alias("n")).agg(F.min("p_partkey").alias("k"))
    forms = F.array(F.col("n"), F.replace("n", F.lit("o"), F.lit("ou")), F.substr("n", F.lit(1), F.length("n") - 1),
                    F.concat(F.col("n"), F.lit(" Special")))
    rows = names.select("k", F.posexplode(forms).alias("v", "query")).select((F.col("k") * 4 + F.col("v")).alias("query_id"), "query")
    return rows.withColumn("query_norm", T.match_norm(F.col("query"))).withColumn("raw_tokens", T.alnum_runs(F.col("query_norm")))


_IDX = f"""al AS ({_ALIAS_SQL}), en AS (SELECT {KIND} AS media_type, p_partkey AS item_id, p_name AS title FROM part),
rw AS (SELECT media_type, item_id, title, title AS alias, 0 AS g, 0 AS p FROM en UNION ALL
SELECT en.media_type, en.item_id, title, alias, CASE WHEN al.media_type = '*' THEN 2 ELSE 1 END, pos FROM en JOIN al ON al.item_id = en.item_id AND al.media_type IN (en.media_type, '*')),
ix AS (SELECT media_type, item_id, title, {q.norm('alias')} AS alias_norm, arg_min({q.ws('alias')}, [g, p]) AS alias, min(g * 100 + p) AS pos FROM rw GROUP BY 1, 2, 3, 4)"""


@query("alias_join_j5", f"WITH {_IDX} SELECT media_type, item_id, alias, pos FROM ix")
def alias_join(t):
    return index(t).select("media_type", "item_id", "alias", (F.col("pos.g") * 100 + F.col("pos.p")).alias("pos"))


_EXACT = f"""WITH {_IDX}, {_TQ}, qk AS (SELECT DISTINCT query_id, unnest([{q.norm('query')}, {q.loose(q.norm('query'))}]) AS key FROM tq),
ik AS (SELECT DISTINCT media_type, item_id, title, unnest([alias_norm, {q.loose('alias_norm')}]) AS key FROM ix),
ex AS (SELECT DISTINCT query_id, media_type, item_id, title FROM qk JOIN ik USING (key))"""


@query("exact_title_join_j6", _EXACT + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS n FROM ex) SELECT query_id, media_type, item_id, 1.0 AS score FROM r WHERE n <= 20")
def exact_title_join(t):
    """The first twenty entries per query that match exactly under either key."""
    found = M.exact_candidates(title_queries(t.part), index(t), 20)
    return R.top_k(found, ["query_id"], ["item_id"], 20).select("query_id", "media_type", "item_id", "score")


@query("fuzzy_title_join_j7")
def fuzzy_title_join(t):
    """Distinct query and alias strings with similarity of at least 0.88."""
    qs = title_queries(t.part).select(F.col("query_norm").alias("q")).distinct()
    return M.fuzzy_pairs(qs, index(t).select(F.col("alias_norm").alias("c")).distinct())


def listed_hits(part, n=6):
    """External hits of every title query: `n` consecutive parts from the query's first one."""
    base = title_queries(part).select("query_id", "query", "query_norm", F.floor(F.col("query_id") / 4).alias("k"))
    hits = base.select("query_id", "query", "query_norm", F.posexplode(F.sequence(F.col("k"), F.col("k") + (n - 1))).alias("pos", "item_id"))
    return hits.join(part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), "p_size"), "item_id")


@query("external_hit_join_j8")
def external_hit_join(t):
    """Catalogue entries named by id in external hits, at the match threshold minus 0.03."""
    hits = listed_hits(t.part)
    return M.external_hits(title_queries(t.part), hits.select("query_id", "item_id", "title"), index(t))


@query("title_acceptance_f22", f"""WITH {views.windows_sql(15)}, v AS (SELECT item_id || '-' || nth AS query_id, {q.toks("c")} AS r, 0.9 + item_id % 6 * 0.01 AS best FROM win)
SELECT query_id, item_id FROM v, (VALUES (1), (2)) i(item_id) WHERE len(r) <= 12 AND (best >= 0.935 OR (len(r) < 4 AND NOT list_has_any(r, {q.lst(L.TITLE_QUERY_HINTS)})))""")
def title_acceptance(t):
    windows = views.word_windows(t.benchmark, 15)
    queries = windows.select(F.concat_ws("-", "item_id", "nth").alias("query_id"), F.col("item_id").alias("_item"), T.tokens(F.col("c")).alias("raw_tokens"))
    cands = queries.select("query_id", "_item", F.explode(F.array(F.lit(1), F.lit(2))).alias("item_id")).withColumn(
        "score", 0.9 + F.col("_item") % 6 * 0.01 - (F.col("item_id") - 1) * 0.005)
    return M.accept_title_results(queries.drop("_item"), cands.drop("_item")).select("query_id", "item_id")


_T1 = f"""WITH b AS (SELECT DISTINCT p_name || ' ' || p_size % 5 AS query, p_name FROM part),
qi AS (SELECT *, hash FROM (SELECT query, p_name, {q.toks('query')} AS rt, query AS hash FROM b)),
c AS (SELECT query, p_partkey AS item_id, t AS title, rt FROM qi JOIN (SELECT *, p_name || ' ' || p_size || CASE WHEN p_size % 7 = 0 THEN ' Recap' ELSE '' END AS t FROM part) p USING (p_name)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY len(list_filter(list_distinct(list_filter(rt, lambda z: regexp_full_match(z, '[0-9]+'))), lambda z: NOT list_contains({q.toks('title')}, z))),
CASE WHEN regexp_matches({q.norm('title')}, '{"|".join(L.SPINOFF_MARKERS)}') AND NOT list_has_any(rt, {q.lst(L.SPINOFF_MARKERS)}) THEN 1 ELSE 0 END, abs(length({q.norm('title')}) - length(query)), lower(title), item_id) AS rank FROM c)
SELECT query, rank, item_id FROM r WHERE rank <= 20"""


@query("title_ranking_t1", _T1)
def title_ranking(t):
    """Five-key order of entries that share a name with the query, which also asks for a number."""
    names = t.part.select(F.concat_ws(" ", "p_name", (F.col("p_size") % 5).cast("string")).alias("query_id"), "p_name").distinct()
    queries = names.withColumn("query_norm", T.match_norm(F.col("query_id"))).withColumn("raw_tokens", T.alnum_runs(F.col("query_norm")))
    title = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 7 == 0, " Recap").otherwise(""))
    idx = t.part.select(kind().alias("media_type"), F.col("p_partkey").alias("item_id"), title.alias("title"),
                        T.match_norm(F.col("p_name")).alias("alias_norm"))
    by_name = queries.withColumn("query_norm", T.match_norm(F.col("p_name")))
    found = M.exact_candidates(by_name.select("query_id", "query_norm"), idx, 20)
    return M.ranked_titles(queries, found, 20).select(F.col("query_id").alias("query"), "rank", "item_id")


@query("title_search_r1")
def title_search(t):
    return P.title_search(title_queries(t.part), index(t)).select(
        "query_id", "rank", "media_type", "item_id", "title", F.round("score", 6).alias("score"))


# --- suggestions ----------------------------------------------------------------

_SUGG = f"""WITH inp AS (SELECT DISTINCT p_name AS title, p_brand AS source FROM part)"""


def suggestion_inputs(part):
    return part.select(F.col("p_name").alias("title"), F.col("p_brand").alias("source")).distinct().withColumn(
        "query_id", F.concat_ws("|", "title", "source"))


def suggestion_catalogue(part):
    return part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.col("p_brand").alias("source"),
                       F.array("p_type", F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)).alias("genres"))


_ALT = _SUGG + f""", st AS (SELECT DISTINCT p_name AS title, {suggestion_set('p_name')} AS s FROM part),
cf AS (SELECT a.title AS x, b.title AS y, floor(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) * 100 + 0.5) AS confidence FROM st a, st b),
r AS (SELECT inp.title || '|' || inp.source AS query_id, p_partkey AS pos, CAST(confidence AS INT) AS confidence, row_number() OVER (PARTITION BY inp.title, inp.source ORDER BY confidence DESC, p_partkey) AS rank
FROM inp JOIN cf ON cf.x = inp.title AND confidence >= 80 JOIN part p ON p.p_name = cf.y AND p.p_brand <> inp.source)"""


@query("title_jaccard_join_j15", _ALT + " SELECT query_id, rank, pos, confidence FROM r WHERE rank <= 5")
def title_jaccard_join(t):
    return M.alternatives(suggestion_inputs(t.part), suggestion_catalogue(t.part)).select("query_id", "rank", "pos", "confidence")


_GEN = f"""WITH inp AS (SELECT p_partkey AS query_id, p_name AS title, [lower(p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS g FROM part),
sets AS (SELECT DISTINCT title, g FROM inp), ov AS (SELECT a.title, a.g, b.query_id AS pos, len(list_intersect(a.g, b.g)) AS overlap FROM sets a JOIN inp b ON a.title <> b.title AND len(list_intersect(a.g, b.g)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY title, g ORDER BY overlap DESC, pos) AS rank FROM ov)"""


def _genre_inputs(part):
    cat = suggestion_catalogue(part)
    return cat.select(F.col("pos").alias("query_id"), "title", "genres")


@query("genre_overlap_join_j14", _GEN + " SELECT query_id, rank, pos, overlap FROM inp JOIN r USING (title, g) WHERE rank <= 6")
def genre_overlap_join(t):
    return M.similar_by_genre(_genre_inputs(t.part), suggestion_catalogue(t.part)).select("query_id", "rank", "pos", "overlap")


@query("trending_t8", "SELECT p_partkey AS pos, p_name AS title FROM part WHERE p_brand IN ('Brand#3', 'Brand#7') ORDER BY p_partkey LIMIT 6")
def trending(t):
    sources = t.part.select(F.col("p_brand").alias("source")).distinct().where(F.col("source").isin("Brand#3", "Brand#7"))
    return M.trending(suggestion_catalogue(t.part), sources).select("pos", "title")


@query("suggestions_r10", _ALT + """, g AS (SELECT DISTINCT p_name || '|' || p_brand AS query_id FROM part) SELECT query_id, 'alternative' AS list, rank, pos FROM r WHERE rank <= 5
UNION ALL SELECT 'all', 'trending', row_number() OVER (ORDER BY p_partkey), p_partkey FROM (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#3', 'Brand#7') ORDER BY p_partkey LIMIT 6)""")
def suggestions(t):
    """Alternatives per distinct title and source, with the shared trending list."""
    from shelfmark.plans.suggestions import suggest

    supported = t.part.select(F.col("p_brand").alias("source")).distinct().where(F.col("source").isin("Brand#3", "Brand#7"))
    out = suggest(suggestion_inputs(t.part), suggestion_catalogue(t.part), supported)
    return out.select("query_id", "list", "rank", "pos")


# --- listing search ---------------------------------------------------------------

_LQ = f"""lq AS (SELECT DISTINCT p_name || ' of the ' || lower(p_type) AS query FROM part), ca AS (SELECT p_partkey AS pos, '/p/' || p_partkey AS url, p_name || ' ' || lower(p_type) AS title, p_brand FROM part),
lv AS (SELECT query AS query_id, query AS variant, 0 AS pos FROM lq),
pv AS (SELECT variant, {q.listing('variant')} AS q FROM (SELECT DISTINCT variant FROM lv)), pt AS (SELECT title, {q.listing('title')} AS c FROM (SELECT DISTINCT title FROM ca)),
px AS (SELECT * FROM pv, pt), sx AS (SELECT variant, title, {LISTING_SCORE} AS score FROM {listing_parts('px', 'variant, title')})"""


def listing_queries(part):
    return part.select(F.concat(F.col("p_name"), F.lit(" of the "), F.lower("p_type")).alias("query")).distinct().withColumn("query_id", F.col("query"))


def listing_candidates(part):
    return part.select(F.col("p_partkey").alias("pos"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"),
                       F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("title"), F.col("p_brand").alias("source"))


def variants_of(queries):
    return T.exploded(queries, TT.read_now_variants(F.array("query")), "variant", "pos").select("query_id", "pos", "variant")


@query("best_source_match_j18", f"""WITH {_LQ}, b AS (SELECT title, arg_min(url, pos) AS url, min(pos) AS pos FROM ca GROUP BY 1),
r AS (SELECT query_id, b.title, b.url, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, lv.pos, b.pos) AS n FROM lv JOIN sx USING (variant) JOIN b USING (title) WHERE score >= 0.58)
SELECT query_id, title, url, round(score, 6) AS score FROM r WHERE n = 1""")
def best_source_match(t):
    out = M.best_listing_match(variants_of(listing_queries(t.part)), listing_candidates(t.part))
    return out.select("query_id", "title", "url", F.round("score", 6).alias("score"))


_T11 = f"""WITH {_LQ}, h AS (SELECT query_id, ca.url, ca.title, max(score) AS score, min(ca.pos) AS pos FROM lv JOIN sx USING (variant) JOIN ca USING (title) WHERE score >= 0.58 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS r FROM h),
k AS (SELECT *, list_filter(string_split(lower(query_id), ' '), lambda z: length(z) > 2) AS w FROM r WHERE r <= 12),
f AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS tk FROM k WHERE contains(lower(title), lower(query_id)) OR len(list_filter(w, lambda z: contains(lower(title), z))) >= ceil(len(w) / 2)),
d AS (SELECT query_id, tk, min(r) AS r, arg_min(url, r) AS url FROM f GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM d)
SELECT query_id, rank, url FROM z WHERE rank <= 6"""


@query("two_stage_cut_t11", _T11)
def two_stage_cut(t):
    queries = listing_queries(t.part)
    first = materialize(M.strict_direct_matches(variants_of(queries), listing_candidates(t.part)), "direct-matches")
    return M.relevant_results(first, queries).select("query_id", "rank", "url")


@query("direct_search_r11", _T11.replace("FROM lv JOIN sx USING (variant) JOIN ca USING (title) WHERE score >= 0.58 GROUP BY 1, 2, 3)",
       """FROM lv JOIN sx USING (variant) JOIN ca USING (title) WHERE score >= 0.58 AND ca.p_brand = 'Brand#1' GROUP BY 1, 2, 3
UNION ALL SELECT query_id, ca.url, ca.title, max(score), min(ca.pos) FROM lv JOIN sx USING (variant) JOIN ca USING (title) WHERE score >= 0.58 AND ca.p_brand = 'Brand#2' AND query_id NOT IN
(SELECT query_id FROM lv JOIN sx USING (variant) JOIN ca USING (title) WHERE score >= 0.58 AND ca.p_brand = 'Brand#1') GROUP BY 1, 2, 3)"""))
def direct_search(t):
    """Two sources in order of preference: the second counts only for queries the first cannot answer."""
    from shelfmark.plans.suggestions import direct_search as run

    return run(listing_queries(t.part), listing_candidates(t.part), ["Brand#1", "Brand#2"]).select("query_id", "rank", "url")


# --- ordinal candidate choice -----------------------------------------------------

_ORD = f"""WITH oq AS (SELECT DISTINCT p_name AS query FROM part), oc AS (SELECT p_partkey AS item_id, p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ii' ELSE ' ' || lower(p_type) END AS title, p_size AS chapters FROM part),
px AS (SELECT query, title, {ordinal_sql('query', 'title', 3, False)} AS score FROM oq, (SELECT DISTINCT title FROM oc)),
r AS (SELECT query AS query_id, item_id, score, chapters, row_number() OVER (PARTITION BY query ORDER BY score, chapters DESC, item_id) AS rank FROM px JOIN oc USING (title) WHERE score <= 2.5)"""


def _ordinal(t):
    queries = t.part.select(F.col("p_name").alias("query")).distinct().withColumn("query_id", F.col("query"))
    k = F.col("p_partkey") % 3
    title = F.concat(F.col("p_name"), F.when(k == 0, "").when(k == 1, " ii").otherwise(F.concat(F.lit(" "), F.lower("p_type"))))
    return M.ordinal_candidates(queries, t.part.select(F.col("p_partkey").alias("item_id"), title.alias("title"), F.col("p_size").alias("chapters")))


@query("candidate_order_t6", _ORD + " SELECT query_id, rank, item_id, score FROM r WHERE rank <= 20")
def candidate_order(t):
    return M.ranked_candidates(_ordinal(t)).select("query_id", "rank", "item_id", "score")


@query("candidate_resolution_j24", _ORD + " SELECT query_id, item_id, score, least(chapters, 1500) AS chapters FROM r WHERE rank = 1")
def candidate_resolution(t):
    best = M.ranked_candidates(_ordinal(t), 1)
    return best.select("query_id", "item_id", "score", F.least("chapters", F.lit(1500)).alias("chapters"))


@query("resolver_ranking_r13", f"""WITH {_TQ}, h AS (SELECT query_id, query, j AS pos, p_partkey AS item_id, p_name AS title FROM tq, (VALUES (0), (1), (2), (3), (4), (5)) x(j), part WHERE p_partkey = query_id // 4 + j),
n AS (SELECT *, {q.alnum('query')} AS a, {q.alnum('title')} AS b FROM h), s AS (SELECT *, CASE WHEN a = b THEN 0 WHEN starts_with(b, a) OR starts_with(a, b) THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 2
WHEN len(list_intersect(string_split(a, ' '), string_split(b, ' '))) = 0 THEN 10 ELSE 3 - least(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) * 0.4, 1.8) END AS score FROM n)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, pos) AS rank, item_id, round(score, 6) AS score FROM s""")
def resolver_ranking(t):
    return M.resolver_ranking(listed_hits(t.part)).select("query_id", "rank", "item_id", F.round("score", 6).alias("score"))


@query("recommendations_t10", f"""WITH d AS (SELECT p_brand, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k, min(p_partkey) AS pos, arg_min(p_name, p_partkey) AS title FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS rank FROM d) SELECT p_brand, rank, title FROM r WHERE rank <= 5""")
def recommendations(t):
    rows = t.part.withColumn("at", F.col("p_partkey"))
    return LS.capped_distinct(rows, ["p_brand"], T.title_norm_apostrophe(F.col("p_name")), "at", ["p_name"], 5).select(
        "p_brand", "rank", F.col("p_name").alias("title"))


@query("popularity_listing_t5", "SELECT p_partkey, p_size FROM part")
def popularity_listing(t):
    return t.part.select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey")


# --- searches ---------------------------------------------------------------------

def catalogue_titles(part):
    """Preferred titles and one alternative each: item_id, pos, title."""
    forms = F.array(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name"))
    return part.select(F.col("p_partkey").alias("item_id"), F.posexplode(forms).alias("pos", "title"))


@query("alias_candidates_f23")
def alias_candidates(t):
    """Up to three alias candidates per title query."""
    return P.alias_choices(title_queries(t.part), catalogue_titles(t.part)).withColumn("score", F.round("score", 6))


def _search_setup(t):
    docs_index = P.SearchIndex.build(chunk_table(t))
    titles = t.documents.select(F.col("lang").alias("media_type"), F.col("doc_id").alias("item_id"),
                                T.collapse(F.substring_index("text", "\n", 1)).alias("title")).where(F.col("title") != "")
    return docs_index, M.alias_index(titles)


@query("full_search_r4")
def full_search(t):
    """Title results first, blended retrieval for the rest; passages and shortened document titles as queries."""
    idx, aliases = _search_setup(t)
    results = P.full_search(search_queries(t), idx, aliases)["results"]
    return results.select("query_id", "rank", "item_id", "mode", F.round("score", 6).alias("score"))


def search_queries(t):
    """Passages, and one query per distinct short document title without its last letter."""
    from shelfmark.operators.dense import embedded

    title = T.collapse(F.substring_index("text", "\n", 1))
    named = t.documents.select(title.alias("title"), "doc_id").where(F.length("title").between(8, 40)).groupBy("title").agg(
        F.min("doc_id").alias("k")).select((F.col("k") + 1_000_000).alias("query_id"), F.substr("title", F.lit(1), F.length("title") - 2).alias("query"))
    passages = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    lex = LEX.alias_lexicon(views.labelled(t.documents).select("payload"), "payload")
    return materialize(embedded(LEX.classified_queries(passages.unionByName(named), *lex), "query"), "search-queries")


@query("strong_primary_f20")
def strong_primary(t):
    """Queries whose first title result settles the search."""
    rows = P.title_search(title_queries(t.part), index(t)).join(title_queries(t.part).select("query_id", "query"), "query_id")
    return P.strong_primary(rows)


@query("federated_merge_u3")
def federated_merge(t):
    """Primary title results merged with the results of one alias query each."""
    from shelfmark.plans.expanded import expand_and_merge

    qs = title_queries(t.part)
    return expand_and_merge(qs, catalogue_titles(t.part), part_search(t))["results"].withColumn("score", F.round("score", 6))


@query("expanded_search_r5")
def expanded_search(t):
    """Type filter off the query, search, alias expansion for the weak ones, merge."""
    from shelfmark.plans.expanded import expanded_search as run

    qs = title_queries(t.part).select("query_id", F.concat(F.col("query"), F.when(F.col("query_id") % 3 == 0, " manga").otherwise("")).alias("query"))
    out = run(qs, catalogue_titles(t.part), part_search(t))
    return out["results"].withColumn("score", F.round("score", 6))
