"""Predicates on queries, titles and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import lexicon as L, similarity as SIM, text as T, titles as TT
from shelfmark.operators import evaluation as EV, lexicon as LEX

from . import query, sql as q, views
from .sql import CAT, LAB
from .text_functions import PAGE_TITLE, SERVICE_SQL, page_title


@query("trailing_media_filter_f2", f"""WITH v AS (SELECT item_id, {q.strip_tags('text')} AS c, CASE item_id % 4 WHEN 0 THEN 'manga' WHEN 1 THEN 'anime' END AS m FROM benchmark)
SELECT item_id, c AS query, m AS media_type FROM v""")
def trailing_media_filter(t):
    k = F.col("item_id") % 4
    raw = F.concat(F.col("text"), F.when(k == 0, " Manhwa").when(k == 1, " ANIME ").otherwise(""))
    return t.benchmark.select("item_id", TT.trailing_media_type(raw).alias("f")).select("item_id", "f.*")


_LEX = SERVICE_SQL + f""", ph AS (SELECT DISTINCT unnest(a) AS p FROM a), ltk AS (SELECT DISTINCT unnest(regexp_extract_all(p, '[a-z0-9]+')) AS t FROM ph)"""
_STOP, _HINT = q.lst(L.QUERY_STOPWORDS), q.lst(L.CHARACTER_HINTS)


def character_queries_sql():
    """Query texts: first four words of a document's synopsis, with a hint word on every third."""
    return f""", cq0 AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN 'character ' ELSE '' END ||
  array_to_string(w[1:CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END], ' ') AS qtext FROM lab WHERE len(w) >= 1),
cq1 AS (SELECT query_id, qtext, {q.norm('qtext')} AS qn, {q.toks('qtext')} AS raw FROM cq0),
kn AS (SELECT query_id, list(DISTINCT x.t) AS known FROM (SELECT query_id, unnest(raw) AS t FROM cq1) x SEMI JOIN ltk ON x.t = ltk.t GROUP BY 1),
qk AS (SELECT cq1.*, coalesce(known, []) AS known, qn IN (SELECT p FROM ph) AS phrase,
  list_filter(raw, lambda z: NOT list_contains({_STOP}, z) AND NOT list_contains({_HINT}, z)) AS rest FROM cq1 LEFT JOIN kn USING (query_id)),
qc AS (SELECT *, CASE WHEN len(raw) = 0 THEN false WHEN phrase THEN true WHEN list_has_any(raw, {_HINT}) THEN
  len(rest) > 0 AND len(list_filter(rest, lambda z: NOT regexp_full_match(z, '[a-z]+'))) = 0 AND len(list_filter(rest, lambda z: list_contains(known, z))) >= greatest(1, len(rest) - 1)
  ELSE len(raw) <= 3 AND NOT list_has_any(raw, {_STOP}) AND len(list_filter(raw, lambda z: NOT regexp_full_match(z, '[a-z]+'))) = 0
  AND len(list_filter(raw, lambda z: list_contains(known, z))) = len(raw) END AS is_character, {q.qtoks('raw')} AS qtok FROM qk)"""


def character_query_text():
    """The query text of a labelled document; null without words."""
    n = F.when(F.col("doc_id") % 2 == 0, 2).otherwise(3)
    return F.when(F.size("w") >= 1, F.concat(
        F.when(F.col("doc_id") % 3 == 0, "character ").otherwise(""), F.array_join(F.slice("w", F.lit(1), n), " ")))


def character_queries(t):
    return views.labelled(t.documents).where(F.size("w") >= 1).select(
        F.col("doc_id").alias("query_id"), character_query_text().alias("query"))


@query("character_query_f4", _LEX + character_queries_sql() + " SELECT query_id, is_character FROM qc")
def character_query(t):
    lex = LEX.alias_lexicon(views.labelled(t.documents).select("payload"), "payload")
    return LEX.classified_queries(character_queries(t), *lex).select("query_id", "is_character")


_PLOT = L.PLOT_WORDS_RE.replace("'", "''")


@query("title_search_test_f5", f"""WITH {views.windows_sql(9)}, v AS (SELECT item_id, nth, {q.strip_tags("c")} AS c FROM win)
SELECT item_id, nth, len(list_filter(string_split(c, ' '), lambda w: w <> '')) <= 6 AND NOT regexp_matches(c, '{_PLOT}') AS loose_test,
len(regexp_extract_all(c, '(?i)[a-z0-9]+(?:''[a-z0-9]+)?')) BETWEEN 1 AND 8 AND NOT regexp_matches(lower(c), '{"|".join(L.VAGUE_SIGNALS)}') AS strict_test FROM v""")
def title_search_test(t):
    rows = views.word_windows(t.benchmark, 9)
    return rows.select("item_id", "nth", TT.looks_like_title(F.col("c")).alias("loose_test"),
                       TT.looks_like_exact_title(F.col("c")).alias("strict_test"))


@query("latin_title_f6", f"""WITH {CAT}, v AS (SELECT doc_id, {q.ws("CASE WHEN doc_id % 3 = 0 THEN '漫画 ' || title WHEN doc_id % 3 = 1 THEN '12' ELSE title END")} AS c FROM cat)
SELECT doc_id, length(c) >= 2 AND NOT regexp_matches(c, '[{q.CJK}\\x{{0600}}-\\x{{06ff}}]') AND regexp_matches(c, '[a-zA-Z]') AS latin FROM v""")
def latin_title(t):
    k = F.col("doc_id") % 3
    c = F.when(k == 0, F.concat(F.lit("漫画 "), F.col("title"))).when(k == 1, "12").otherwise(F.col("title"))
    return views.catalogue(t.documents).select("doc_id", TT.latin_readable(c).alias("latin"))


_CLUE_OK = """(NOT starts_with(lower({c}), 'no synopsis available') AND len(regexp_extract_all(lower({c}), '[a-z]{{3,}}')) >= 6
AND len(list_distinct(regexp_extract_all(lower({c}), '[a-z]{{3,}}'))) >= 4)"""


@query("semantic_clue_f7", f"WITH {CAT}, v AS (SELECT doc_id, {q.ws('synopsis')} AS s FROM cat) SELECT doc_id, s <> '' AND {_CLUE_OK.format(c='s')} AS is_clue FROM v")
def semantic_clue(t):
    return views.catalogue(t.documents).select("doc_id", TT.is_semantic_clue(F.col("synopsis")).alias("is_clue"))


CLUE_SQL = f"""c0 AS (SELECT doc_id, {q.ws('synopsis')} AS s, list_slice(list_filter(string_split({q.alnum('title')}, ' '), lambda x: length(x) >= 5), 1, 6) AS lt FROM cat),
c1 AS (SELECT *, {q.ws("array_to_string(list_filter(regexp_extract_all(s, '[\\pL\\pN_]+|[^\\pL\\pN_]+'), lambda x: NOT list_contains(lt, lower(x))), '')")} AS x FROM c0),
c2 AS (SELECT *, CASE WHEN x <> '' THEN array_to_string(list_slice(string_split(x, ' '), 1, 28), ' ') ELSE substr(s, 1, 140) END AS st FROM c1),
clue AS (SELECT doc_id, CASE WHEN s = '' THEN '' WHEN {_CLUE_OK.format(c='st')} THEN st ELSE array_to_string(list_slice(string_split(s, ' '), 1, 28), ' ') END AS clue FROM c2)"""


@query("synopsis_clue_x33", f"WITH {CAT}, {CLUE_SQL} SELECT doc_id, clue FROM clue")
def synopsis_clue(t):
    return views.catalogue(t.documents).select("doc_id", TT.synopsis_clue(F.col("synopsis"), F.col("title")).alias("clue"))


def eval_corpus(t):
    """Distinct evaluation aliases of each labelled document, as rows."""
    from shelfmark.functions import sections as S

    return views.labelled(t.documents).select(
        "doc_id", F.col("kind").alias("medium"), F.col("ttl").alias("title"), F.col("syn").alias("synopsis"),
        S.eval_aliases(F.col("payload")).alias("aliases"),
    )


EVAL_SQL = f"""WITH {LAB}, al AS (SELECT doc_id, kind AS medium, ttl AS title, syn AS synopsis, CASE WHEN len(w) >= 4 THEN
  CASE WHEN lower(w[1] || ', ' || w[2]) = lower(w[3] || ' ' || w[4]) THEN [w[1] || ', ' || w[2]] ELSE [w[1] || ', ' || w[2], w[3] || ' ' || w[4]] END
  WHEN len(w) >= 1 THEN [w[1]] ELSE CAST([] AS VARCHAR[]) END AS aliases FROM lab),
ar AS (SELECT doc_id, unnest(aliases) AS alias, unnest(range(1, len(aliases) + 1)) AS pos FROM al),
fr AS (SELECT {q.alnum('alias')} AS k, count(DISTINCT doc_id) AS frequency FROM ar WHERE {q.alnum('alias')} <> '' GROUP BY 1),
ak AS (SELECT doc_id, arg_min({{'a': alias, 'f': coalesce(frequency, 9999)}}, [CASE WHEN contains(alias, ' ') THEN 0 ELSE 1 END, coalesce(frequency, 9999), -length(alias), pos]) AS b
  FROM ar LEFT JOIN fr ON fr.k = {q.alnum('alias')} GROUP BY 1)"""


@query("alias_frequency_a6", EVAL_SQL + " SELECT k AS alias, frequency FROM fr")
def alias_frequency(t):
    return EV.alias_frequency(eval_corpus(t))


@query("keyword_alias_choice_t7", EVAL_SQL + " SELECT al.doc_id, coalesce(b.a, al.title) AS keyword FROM al LEFT JOIN ak USING (doc_id)")
def keyword_alias_choice(t):
    rows = eval_corpus(t)
    return EV.with_keyword_alias(rows, EV.alias_frequency(rows)).select("doc_id", "keyword")


@query("keyword_alias_gate_f8", EVAL_SQL + " SELECT doc_id, contains(b.a, ' ') AND b.f <= 3 AND lower(b.a) <> 'unknown' AS has_keyword FROM ak UNION ALL SELECT doc_id, false FROM al WHERE len(aliases) = 0")
def keyword_alias_gate(t):
    rows = eval_corpus(t)
    return EV.with_keyword_alias(rows, EV.alias_frequency(rows)).select("doc_id", "has_keyword")


@query("specific_variant_f9", f"""SELECT p_partkey, {q.alnum('v')} <> '' AND (contains({q.alnum('v')}, ' ') OR {q.alnum('v')} = {q.alnum('p_name')}) AS specific
FROM (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) ELSE '--' END AS v FROM part)""")
def specific_variant(t):
    k = F.col("p_partkey") % 3
    v = F.when(k == 0, F.col("p_name")).when(k == 1, F.substring_index("p_name", " ", 1)).otherwise("--")
    return t.part.select("p_partkey", TT.is_specific_variant(v, F.col("p_name")).alias("specific"))


def _neighbours(part):
    """Each part with the next key's name (the last with its own): an equi-join, not a window over the table."""
    nxt = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.select("p_partkey", "p_name", "p_brand", "p_type").join(nxt, "p_partkey", "left").withColumn(
        "other", F.coalesce("other", "p_name"))


_NEXT = "SELECT a.p_partkey, a.p_name, a.p_brand, a.p_type, coalesce(b.p_name, a.p_name) AS other FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query("title_relevance_f12", f"""WITH v AS ({_NEXT}), w AS (SELECT *, list_filter(string_split(lower(other), ' '), lambda x: length(x) > 2) AS ws, lower(p_name || ' ' || p_brand) AS t FROM v)
SELECT p_partkey, contains(t, lower(other)) OR len(ws) = 0 OR len(list_filter(ws, lambda x: contains(t, x))) >= ceil(len(ws) / 2) AS relevant,
regexp_matches(CASE WHEN p_partkey % 2 = 0 THEN 'Top 10 ' ELSE '' END || p_name, '{L.HEADLINE_RE.replace("'", "''")}') AS headline FROM w""")
def title_relevance(t):
    rows = _neighbours(t.part)
    head = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Top 10 ").otherwise(""), F.col("p_name"))
    return rows.select("p_partkey", TT.is_relevant(F.concat_ws(" ", "p_name", "p_brand"), F.col("other")).alias("relevant"),
                       TT.is_headline(head).alias("headline"))


@query("spinoff_tests_f15", f"""SELECT p_partkey, regexp_matches({q.norm("p_name || ' ' || p_type || v")}, '{"|".join(L.SPINOFF_MARKERS)}') AS as_substring,
list_has_any(string_split({q.norm("p_name || ' ' || p_type || v")}, ' '), {q.lst(L.SPINOFF_MARKERS)}) AS as_token
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN ' Part 2' WHEN 1 THEN ' Apartment' ELSE '' END AS v FROM part)""")
def spinoff_tests(t):
    k = F.col("p_partkey") % 4
    title = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.when(k == 0, " Part 2").when(k == 1, " Apartment").otherwise(""))
    return t.part.select("p_partkey", TT.is_spinoff_title(title).alias("as_substring"),
                         TT.mentions_spinoff(F.split(T.match_norm(title), " ")).alias("as_token"))


@query("evaluation_match_f18", f"""SELECT p_partkey, p_partkey % 10 = 0 OR ({q.alnum('p_name')} <> '' AND {q.alnum('other')} <> '' AND
(contains({q.alnum('p_name')}, {q.alnum('other')}) OR contains({q.alnum('other')}, {q.alnum('p_name')}))) AS hit FROM ({_NEXT})""")
def evaluation_match(t):
    result_id = F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey"))
    return _neighbours(t.part).select("p_partkey", EV.is_match(
        F.col("p_name"), F.col("p_partkey"), F.col("other"), result_id
    ).alias("hit"))


@query("title_agreement_f19", f"""WITH v AS ({_NEXT}), n AS (SELECT p_partkey, {q.alnum("other")} AS r, [{q.alnum('p_name')}, {q.alnum("p_name || ' ' || p_brand")}] AS ts FROM v),
k AS (SELECT *, list_filter(string_split(r, ' '), lambda x: length(x) >= 2) AS tk FROM n)
SELECT p_partkey, len(list_filter(ts, lambda n: contains(n, r) OR contains(r, n) OR (len(tk) >= 2 AND len(list_filter(tk, lambda w: list_contains(string_split(n, ' '), w))) / len(tk) >= 0.75))) > 0 AS agrees FROM k""")
def title_agreement(t):
    return _neighbours(t.part).select("p_partkey", TT.agrees_with_titles(
        F.col("other"), F.array("p_name", F.concat_ws(" ", "p_name", "p_brand"))
    ).alias("agrees"))


@query("template_expansion_x34", """WITH s AS (SELECT 'title: ' || p_name AS title, p_partkey, p_type AS descriptor, p_brand AS keyword FROM part),
tp AS (SELECT unnest(['Find a manga or anime about {descriptor}.', 'What is the title where {descriptor}?', 'I want something with this vibe: {descriptor}.',
'Resolve this story to a title: {descriptor}.', 'Name the series about {descriptor}.']) AS tpl, unnest([0, 1, 2, 3, 4]) AS k)
SELECT p_partkey AS seed_id, k AS template, replace(tpl, '{descriptor}', descriptor) AS query, title AS target FROM s, tp""")
def template_expansion(t):
    seeds = t.part.select(F.col("p_partkey").alias("seed_id"), F.concat(F.lit("title: "), F.col("p_name")).alias("title"),
                          F.col("p_type").alias("descriptor"), F.col("p_brand").alias("keyword"))
    return EV.expand_templates(seeds, L.SUITE_TEMPLATES["semantic"], {"title": "title", "descriptor": "descriptor", "keyword": "keyword"}) \
        .select("seed_id", "template", "query", F.col("title").alias("target"))
