"""Deduplication and other aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import corpus as C, lexicon as LEX, lists as LS, ranking as R

from . import query, sql as q, views
from .sql import CAT, LAB  # noqa: F401
from .titles import _LEX


@query("keep_longest_a1", """SELECT lang AS type, doc_id % 200 AS item_id, arg_max(doc_id, [n_chars, -doc_id]) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1, 2""")
def keep_longest(t):
    rows = t.documents.select(F.col("lang").alias("type"), (F.col("doc_id") % 200).alias("item_id"), "doc_id", "text", "n_chars")
    return C.keep_longest(rows, ["type", "item_id"], position="doc_id").select("type", "item_id", "doc_id", "n_chars")


LINKS_SQL = r"""raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*>[^<]*</a>')) AS a, unnest(range(1, len(regexp_extract_all(html, '<a [^>]*>[^<]*</a>')) + 1)) AS pos FROM pages),
links AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS label, pos FROM raw)"""


def anchors(pages):
    """Anchor rows read with a plain pattern: page_id, href (made absolute), label, pos."""
    found = T.exploded(pages.select("page_id", "url", "html"), F.regexp_extract_all("html", F.lit("<a [^>]*>[^<]*</a>"), F.lit(0)), "a", "pos")
    return found.select(
        "page_id", F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.regexp_extract("a", 'href="([^"]*)"', 1)).alias("href"),
        F.regexp_extract("a", ">([^<]*)<", 1).alias("label"), (F.col("pos") + 1).alias("pos"),
    )


@query("keep_extreme_a3", f"WITH {LINKS_SQL} SELECT href, arg_max(label, [length(label), -page_id, -pos]) AS longest_label, min(pos) AS lowest_pos FROM links GROUP BY 1")
def keep_extreme(t):
    return anchors(t.pages).groupBy("href").agg(
        F.max_by("label", F.struct(F.length("label"), -F.col("page_id"), -F.col("pos"))).alias("longest_label"),
        F.min("pos").alias("lowest_pos"),
    )


@query("first_wins_distinct_a4", f"SELECT p_brand, {q.norm('p_name')} AS key, arg_min(p_name, p_partkey) AS first_name, min(p_partkey) AS first_key FROM part GROUP BY 1, 2")
def first_wins(t):
    return LS.first_wins(t.part, ["p_brand"], T.match_norm(F.col("p_name")), "p_partkey", ["p_name"]).select(
        "p_brand", "key", F.col("p_name").alias("first_name"), F.col("pos").alias("first_key")
    )


@query("last_wins_distinct_a5", f"WITH {LINKS_SQL} SELECT href, arg_max(label, [page_id, pos]) AS label, min(page_id * 1000 + pos) AS first_pos FROM links GROUP BY 1")
def last_wins(t):
    rows = anchors(t.pages).withColumn("at", F.col("page_id") * 1000 + F.col("pos"))
    return LS.last_wins(rows, ["href"], "at", ["label"]).select("href", "label", F.col("first_pos"))


@query("reading_mode_a13", """WITH v AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 <> 0 AND l_quantity > 0 THEN l_quantity / 20.0 END AS ratio FROM lineitem),
a AS (SELECT l_orderkey, avg(CASE WHEN ratio >= 1.7 THEN 1.0 ELSE 0.0 END) FILTER (ratio IS NOT NULL) AS tall FROM v GROUP BY 1)
SELECT l_orderkey, CASE WHEN tall IS NULL THEN 'paginated' WHEN tall >= 0.6 THEN 'scroll' WHEN tall <= 0.3 THEN 'paginated' ELSE 'paginated' END AS mode FROM a""")
def reading_mode(t):
    """Orders as pages: each line is an image 20 wide and `l_quantity` high, every fourth one unsized."""
    images = t.lineitem.select(
        F.col("l_orderkey"), F.when(F.col("l_linenumber") % 4 != 0, F.lit(20)).alias("width"), F.col("l_quantity").alias("height")
    )
    return LS.reading_mode(images, ["l_orderkey"], F.lit("paginated")).select("l_orderkey", "mode")


@query("page_counts_a14", f"""WITH {LINKS_SQL} SELECT page_id, count(*) AS links, sum(CASE WHEN regexp_matches(href, '(?i)/[a-z]*th') THEN 1 ELSE 0 END) AS chapter_links,
sum(CASE WHEN regexp_matches(href, '(?i)/[a-z]*th') THEN 1 ELSE 0 END) >= 2 AND page_id % 3 <> 0 AS is_series FROM links GROUP BY 1""")
def page_counts(t):
    rows = anchors(t.pages).withColumn("is_chapter", F.regexp_like("href", F.lit("(?i)/[a-z]*th"))).withColumn(
        "has_reader", F.col("page_id") % 3 == 0)
    return LS.page_counts(rows, ["page_id"])


@query("load_counters_a15", """WITH old AS (SELECT vec_id FROM embeddings WHERE label <= 6), inc AS (SELECT vec_id FROM embeddings WHERE label >= 5),
aft AS (SELECT vec_id FROM old UNION SELECT vec_id FROM inc) SELECT (SELECT count(*) FROM old) AS before, (SELECT count(*) FROM inc) AS upserted, (SELECT count(*) FROM aft) AS after,
(SELECT count(*) FROM old WHERE vec_id NOT IN (SELECT vec_id FROM inc)) AS stale, (SELECT count(*) FROM inc WHERE vec_id NOT IN (SELECT vec_id FROM aft)) AS missing""")
def load_counters(t):
    from shelfmark.plans.corpus import load_counters as counters
    from shelfmark.sources.sinks import upserted

    old = t.embeddings.where("label <= 6").select("vec_id", "label")
    inc = t.embeddings.where("label >= 5").select("vec_id", "label")
    return counters(old, inc, upserted(old, inc, ["vec_id"], ["label"]), "vec_id")


@query("highest_chapter_a16", "SELECT l_orderkey, max(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber + 0.5 END) AS highest FROM lineitem GROUP BY 1")
def highest_chapter(t):
    label = F.when(F.col("l_linenumber") % 3 == 0, "extra").otherwise(F.concat(F.lit("Chapter "), F.col("l_linenumber").cast("string"), F.lit(".5")))
    return LS.highest_number(t.lineitem.select("l_orderkey", label.alias("number")), ["l_orderkey"]).select("l_orderkey", "highest")


@query("merged_titles_a17", f"""WITH d AS (SELECT p_type, {q.cjk('p_name')} AS key, arg_min(p_name, p_partkey) AS title, min(p_partkey) AS pos FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY pos) AS rank FROM d) SELECT p_type, string_agg(title, ' / ' ORDER BY rank) AS titles FROM r WHERE rank <= 16 GROUP BY 1""")
def merged_titles(t):
    rows = t.part.select("p_type", "p_name", F.col("p_partkey").alias("pos"))
    merged = LS.merged_titles(rows, ["p_type"], "p_name", "pos")
    return merged.select("p_type", F.array_join("titles", " / ").alias("titles"))


@query("alias_lexicon_a18", _LEX + " SELECT 'phrase' AS kind, p AS value FROM ph UNION ALL SELECT 'token', t FROM ltk")
def alias_lexicon(t):
    phrases, tokens = LEX.alias_lexicon(views.labelled(t.documents).select("payload"), "payload")
    return phrases.select(F.lit("phrase").alias("kind"), F.col("phrase").alias("value")).unionByName(
        tokens.select(F.lit("token").alias("kind"), F.col("token").alias("value")))


@query("alias_membership_j9", _LEX + f""", w AS (SELECT DISTINCT unnest({q.toks('text')}) AS token FROM benchmark) SELECT token, token IN (SELECT t FROM ltk) AS known FROM w""")
def alias_membership(t):
    _, tokens = LEX.alias_lexicon(views.labelled(t.documents).select("payload"), "payload")
    words = T.exploded(t.benchmark, T.tokens(F.col("text")), "token").select("token").distinct()
    return words.join(tokens.withColumn("known", F.lit(True)), "token", "left").select("token", F.coalesce("known", F.lit(False)).alias("known"))


@query("upper_median_a19", """WITH v AS (SELECT p_partkey % 50 AS g, l_extendedprice / l_quantity AS r FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM v) SELECT g, n, r AS median FROM n WHERE i = floor(n / 2)""")
def upper_median(t):
    """Upper median of positive ratios per group of parts."""
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey").where("l_quantity > 0").select(
        (F.col("l_partkey") % 50).alias("g"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("r"))
    return R.value_at_rank(rows, ["g"], "r", F.floor(F.col("n") / 2)).select("g", "n", F.col("r").alias("median"))


@query("type_targets_a20", "SELECT lang AS type, count(*) AS collected, greatest(0, 200 - count(*)) AS remaining, count(*) >= 200 AS reached FROM documents GROUP BY 1")
def type_targets(t):
    return LS.against_target(t.documents.select(F.col("lang").alias("type")), "type", 200)


@query("namespaced_documents_u2", "SELECT 'a:' || doc_id AS id, lang FROM documents UNION ALL SELECT 'b:' || item_id, 'query' FROM benchmark")
def union_sets(t):
    a = t.documents.select(F.concat(F.lit("a:"), F.col("doc_id").cast("string")).alias("id"), "lang")
    b = t.benchmark.select(F.lit("query").alias("lang"), F.concat(F.lit("b:"), F.col("item_id").cast("string")).alias("id"))
    return a.unionByName(b)


@query("id_difference_u6", "SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM labels")
def id_difference(t):
    return t.embeddings.select("vec_id").join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")
