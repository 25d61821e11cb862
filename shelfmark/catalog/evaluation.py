"""Suites, hit rates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import lexicon as L, text as T
from shelfmark.operators import evaluation as EV, sparse as SP
from shelfmark.operators.ranking import range_index
from shelfmark.session import materialize

from . import query, sql as q, views
from .retrieval import _passage_results
from .titles import CLUE_SQL, EVAL_SQL, _CLUE_OK, eval_corpus


def latency_rows(t):
    """Events as evaluation results: medium from the user, type from the event, hits from the value."""
    return t.events.select(
        F.col("event_id").cast("string").alias("case_id"), F.when(F.col("user_id") % 2 == 0, "manga").otherwise("anime").alias("medium"),
        F.col("event_type").alias("query_type"), (F.col("value") > 5).alias("hit"),
        F.floor(F.col("value") * 10).alias("elapsed_ms"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


_LAT = """WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'manga' ELSE 'anime' END AS medium, event_type AS query_type, value > 5 AS hit, CAST(floor(value * 10) AS BIGINT) AS ms,
event_type = 'error' AS err FROM events)"""


@query("evaluation_summary_a10", _LAT + """ SELECT medium, query_type, count(*) AS cases, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN err THEN 1 ELSE 0 END) AS errors,
round(sum(CASE WHEN hit THEN 1 ELSE 0 END) / count(*), 4) AS hit_rate, round(sum(ms) / count(*), 2) AS avg_latency_ms, grouping(medium) * 2 + grouping(query_type) AS grouping FROM r GROUP BY CUBE (medium, query_type)""")
def evaluation_summary(t):
    return EV.summary(latency_rows(t))


@query("suite_summary_a11", """SELECT event_type AS suite, count(*) AS cases, sum(CASE WHEN contains('user ' || user_id, CAST(user_id % 10 AS VARCHAR)) THEN 1 ELSE 0 END) AS resolve_success,
round(avg(user_id % 11), 2) AS avg_relevance, round(avg(event_id % 11), 2) AS avg_hallucination, sum(CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 1 AND event_id % 5 = 0 THEN 1 ELSE 0 END) AS repeat_success FROM events GROUP BY 1""")
def suite_summary(t):
    e = F.col("event_id")
    rows = t.events.select(
        F.col("event_type").alias("suite"), F.concat(F.lit(" "), (F.col("user_id") % 10).cast("string")).alias("target"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("resolved_title"),
        F.when(e % 2 == 0, "cache_hit").otherwise("semantic").alias("method"), (F.col("user_id") % 11).alias("relevance"), (e % 11).alias("hallucination"),
        F.when(e % 3 == 1, "error").when(e % 3 == 0, "live").otherwise("cache_hit").alias("first_mode"),
        F.when(e % 5 == 0, "cache_hit").otherwise("live").alias("second_mode"))
    return EV.suite_summary(rows)


@query("seeded_sampling_t9", f"""WITH r AS (SELECT doc_id, lang AS medium, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:semantic:' || doc_id), doc_id) AS draw FROM documents)
SELECT medium, draw, doc_id FROM r WHERE draw <= 30""")
def seeded_sampling(t):
    pool = t.documents.select("doc_id", F.col("lang").alias("medium"))
    return EV.sampled(pool, 30, 42, "semantic").select("medium", "draw", "doc_id")


@query("sampling_exclusion_j23", """WITH p AS (SELECT doc_id, lang AS medium, doc_id IN (SELECT doc_id FROM labels WHERE lang <> 'de') OR (lang = 'de' AND doc_id >= 10) AS used FROM documents),
l AS (SELECT medium, count(*) FILTER (NOT used) AS n FROM p GROUP BY 1) SELECT doc_id, p.medium FROM p JOIN l USING (medium) WHERE NOT used OR n < 20""")
def sampling_exclusion(t):
    """Used keys are excluded, except in media where fewer than twenty rows would remain."""
    pool = t.documents.select("doc_id", F.col("lang").alias("medium"))
    labelled = pool.join(t.labels.select("doc_id"), "doc_id", "left_semi").where("medium <> 'de'").select("doc_id")
    used = labelled.unionByName(pool.where("medium = 'de' AND doc_id >= 10").select("doc_id")).distinct()
    return EV.preferring_unused(pool, used, 20).select("doc_id", "medium")


_N = 20
_CASES = EVAL_SQL + f""", {CLUE_SQL}, kw AS (SELECT al.doc_id, medium, title, coalesce(b.a, title) AS keyword, coalesce(contains(b.a, ' ') AND b.f <= 3 AND lower(b.a) <> 'unknown', false) AS ok FROM al LEFT JOIN ak USING (doc_id)),
sm AS (SELECT kw.*, clue, row_number() OVER (PARTITION BY medium ORDER BY sha256('42:semantic:' || doc_id), doc_id) AS draw FROM kw JOIN clue USING (doc_id) WHERE clue <> '' AND {_CLUE_OK.format(c='clue')}),
s AS (SELECT * FROM sm WHERE draw <= 15), kl AS (SELECT medium, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM s)) AS n FROM kw WHERE ok GROUP BY 1),
kp AS (SELECT kw.*, row_number() OVER (PARTITION BY kw.medium ORDER BY sha256('42:keyword:' || doc_id), doc_id) AS draw FROM kw JOIN kl USING (medium) WHERE ok AND (n < 5 OR doc_id NOT IN (SELECT doc_id FROM s))),
k AS (SELECT * FROM kp WHERE draw <= 5)
SELECT medium || '-semantic-' || lpad(CAST(draw AS VARCHAR), 4, '0') AS case_id, medium, doc_id AS target_id, title AS target_title,
replace((['manga or anime about {{clue}}', 'series where {{clue}}', 'story with this vibe: {{clue}}', 'what title is about {{clue}}'])[('0x' || substr(sha256('42:st:' || doc_id), 1, 7))::BIGINT % 4 + 1], '{{clue}}', clue) AS query FROM s
UNION ALL SELECT medium || '-keyword-' || lpad(CAST(draw AS VARCHAR), 4, '0'), medium, doc_id, title,
replace((['{{name}}', 'series with character {{name}}', 'find title for {{name}}'])[('0x' || substr(sha256('42:kt:' || doc_id), 1, 7))::BIGINT % 3 + 1], '{{name}}', keyword) FROM k"""


def golden_cases(t):
    corpus = materialize(eval_corpus(t), "eval-corpus")
    return EV.build_cases(corpus, per_medium=_N, title_per_medium=10)


@query("golden_suite_r14", _CASES)
def golden_suite(t):
    """Semantic and keyword cases (title cases depend on further draws and are unit-tested)."""
    return golden_cases(t).where(F.col("query_type") != "title").select("case_id", "medium", "target_id", "target_title", "query")


_HIT = f"""WITH dt AS (SELECT doc_id, {q.ws("split_part(text, chr(10), 1)")} AS title FROM documents)"""


@query("evaluation_run_r15")
def evaluation_run(t):
    """Search with the suite's own queries and summarise hit@10."""
    cases = materialize(golden_cases(t), "cases")
    found = SP.search(t.documents, cases.select(F.col("case_id").alias("query_id"), "query"), 10)
    titles = views.catalogue(t.documents).select("doc_id", T.collapse(F.col("title")).alias("title"))
    results = found.join(titles, "doc_id").select(F.col("query_id").alias("case_id"), "rank", F.col("doc_id").alias("item_id"), "title")
    scored = EV.hit_ranks(cases, results).withColumns({"elapsed_ms": F.lit(0), "error": F.lit(None).cast("string")})
    return EV.summary(scored)


@query("golden_suite_r14_whole")
def golden_suite_whole(t):
    """Semantic, keyword and title cases."""
    return golden_cases(t).select("case_id", "medium", "query_type", "target_id", "target_title", "query")


@query("hit_ranks_r15_detail", f"""WITH d AS (SELECT doc_id, {q.ws("split_part(text, chr(10), 1)")} AS title, row_number() OVER (ORDER BY doc_id) - 1 AS at, count(*) OVER () AS n FROM documents),
r AS (SELECT a.doc_id AS target_id, v.rank, x.doc_id, a.title AS tt, x.title FROM d a, (VALUES (1), (2), (3), (4), (5)) v(rank) JOIN d x ON x.at = (a.at * 3 + v.rank - 3 + a.n) % a.n)
SELECT target_id, min(CASE WHEN doc_id = target_id OR ({q.alnum('tt')} <> '' AND {q.alnum('title')} <> '' AND (contains({q.alnum('tt')}, {q.alnum('title')}) OR contains({q.alnum('title')}, {q.alnum('tt')}))) THEN rank END) AS hit_rank FROM r GROUP BY 1""")
def hit_ranks(t):
    """Every document is the target of a case whose results are five documents from anywhere in the table."""
    titles = views.catalogue(t.documents).select("doc_id", T.collapse(F.col("title")).alias("title"))
    placed = materialize(range_index(titles, ["doc_id"], "at"), "placed-titles")
    n = placed.count()
    cases = placed.select(F.col("doc_id").cast("string").alias("case_id"), F.col("doc_id").alias("target_id"), F.col("title").alias("target_title"))
    asked = placed.select(F.col("doc_id").cast("string").alias("case_id"), F.col("at").alias("_k"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    asked = asked.select("case_id", "rank", ((F.col("_k") * 3 + F.col("rank") - 3 + n) % n).alias("at"))
    results = asked.join(placed, "at").select("case_id", "rank", F.col("doc_id").alias("item_id"), "title")
    return EV.hit_ranks(cases, results).select("target_id", "hit_rank")
