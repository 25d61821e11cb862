"""Similarity scores over title pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import similarity as SIM, text as T, titles as TT

from . import query, sql as q
from .sql import CAT  # noqa: F401  (shared statement block)
from .titles import _neighbours
from shelfmark.functions import lexicon as L

# Each part with the next one's name: plain, shortened, with a suffix, or with two letters swapped.
_PAIR = """WITH pr AS (SELECT a.p_partkey, a.p_name || ' of ' || lower(a.p_type) AS x, CASE a.p_partkey % 4 WHEN 0 THEN a.p_name WHEN 1 THEN 'The ' || a.p_name || ': extra'
WHEN 2 THEN replace(a.p_name, 'i', 'ie') ELSE coalesce(b.p_name, a.p_name) || ' ' || lower(a.p_type) END AS y FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def pairs(part):
    k = F.col("p_partkey") % 4
    y = (
        F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("The "), F.col("p_name"), F.lit(": extra")))
        .when(k == 2, F.replace(F.col("p_name"), F.lit("i"), F.lit("ie")))
        .otherwise(F.concat(F.col("other"), F.lit(" "), F.lower("p_type")))
    )
    return _neighbours(part).select(
        "p_partkey", F.concat(F.col("p_name"), F.lit(" of "), F.lower("p_type")).alias("x"), y.alias("y")
    )


@query("title_similarity_x20")
def title_similarity(t):
    """Sequence, token and containment similarity of every pair."""
    rows = pairs(t.part).select("p_partkey", T.match_norm(F.col("x")).alias("q"), T.match_norm(F.col("y")).alias("c")).withColumns({
        "qt": SIM.distinct_tokens(F.col("q")), "ct": SIM.distinct_tokens(F.col("c")),
    })
    return rows.select("p_partkey", F.round(SIM.title_similarity(F.col("q"), F.col("c"), F.col("qt"), F.col("ct")), 6).alias("score"))


_CJK2 = _PAIR + f""", n AS (SELECT p_partkey, {q.cjk('x')} AS q, {q.cjk('y')} AS c FROM pr),
tk AS (SELECT *, list_filter(string_split(q, ' '), lambda z: length(z) >= 2) AS qt, list_filter(string_split(c, ' '), lambda z: length(z) >= 2) AS ct FROM n)"""


@query("fuzzy_similarity_x21", _CJK2 + f""", g AS (WITH RECURSIVE g(p_partkey, i, used, total) AS (SELECT p_partkey, 0, CAST([] AS INT[]), CAST(0 AS DOUBLE) FROM tk
UNION ALL SELECT g.p_partkey, g.i + 1, CASE WHEN b.s >= 0.7 THEN list_append(g.used, b.j) ELSE g.used END, g.total + CASE WHEN b.s >= 0.7 THEN b.s ELSE 0 END
FROM g JOIN tk USING (p_partkey), LATERAL (SELECT arg_max({{'s': s, 'j': j}}, [s, -j]) AS b0 FROM (SELECT j, CASE WHEN list_contains(g.used, j) THEN 0 WHEN qtk = ctk THEN 1
  WHEN length(qtk) < 4 OR length(ctk) < 4 THEN 0 WHEN levenshtein(qtk, ctk) > greatest(1, floor(greatest(length(qtk), length(ctk)) * 0.28)) THEN 0
  ELSE 1 - levenshtein(qtk, ctk) / greatest(length(qtk), length(ctk)) END AS s FROM (SELECT tk.qt[g.i + 1] AS qtk, unnest(tk.ct) AS ctk, CAST(unnest(range(1, len(tk.ct) + 1)) AS INT) AS j))) l,
  LATERAL (SELECT l.b0.s AS s, l.b0.j AS j) b WHERE g.i < len(tk.qt)) SELECT p_partkey, arg_max(total, i) AS total FROM g GROUP BY 1)
SELECT p_partkey, round(CASE WHEN q = c THEN 1 WHEN contains(c, q) OR contains(q, c) THEN 0.88 ELSE greatest(2 * len(list_intersect(list_distinct(qt), list_distinct(ct))) / (len(list_distinct(qt)) + len(list_distinct(ct))),
len(list_intersect(list_distinct(qt), list_distinct(ct))) / len(list_distinct(qt)) * 0.85, total / len(qt) * CASE WHEN len(qt) >= 2 THEN 0.95 ELSE 0.82 END) END, 6) AS score,
round(total / len(qt) * CASE WHEN len(qt) >= 2 THEN 0.95 ELSE 0.82 END, 6) AS greedy FROM tk JOIN g USING (p_partkey)""")
def fuzzy_similarity(t):
    """Dice, coverage and greedy typo-tolerant similarity, and the greedy token score alone (X21, X26)."""
    rows = pairs(t.part).select("p_partkey", T.title_norm_cjk(F.col("x")).alias("q"), T.title_norm_cjk(F.col("y")).alias("c"))
    toks = rows.withColumns({n: F.filter(F.split(s, " "), lambda z: F.length(z) >= 2) for n, s in (("qt", "q"), ("ct", "c"))})
    return toks.select("p_partkey", F.round(SIM.fuzzy_title_score(F.col("q"), F.col("c")), 6).alias("score"),
                       F.round(SIM.greedy_token_score(F.col("qt"), F.col("ct")), 6).alias("greedy"))


_STOP = q.lst(L.TITLE_STOPWORDS)
LISTING_SCORE = """CASE WHEN q = '' OR c = '' THEN 0 WHEN q = c THEN 1 WHEN len(qs) = 0 OR len(cs) = 0 THEN 0 ELSE least(1, greatest(2 * i / (len(qs) + len(cs)), i / len(qs) * 0.7 + i / len(cs) * 0.3,
CASE WHEN contains(c, q) OR contains(q, c) THEN 0.82 ELSE 0 END, CASE WHEN i = len(qs) AND len(qs) >= 2 THEN 0.74 ELSE 0 END,
CASE WHEN length(qp) >= 8 AND contains(cp, qp) THEN 1 WHEN length(cp) >= 8 AND contains(qp, cp) THEN 0.86 ELSE 0 END,
CASE WHEN i >= 3 AND len(qs) >= 3 THEN 0.68 ELSE 0 END, CASE WHEN i >= 2 AND len(qs) >= 3 AND len(cs) >= 2 THEN 0.62 ELSE 0 END)) END"""


def listing_parts(src: str, cols: str) -> str:
    """SQL: tokens, sets, phrases and overlap of listing-normalised `q` and `c`."""
    return f"""(SELECT *, len(list_intersect(qs, cs)) AS i FROM (SELECT *, list_distinct(qt) AS qs, list_distinct(ct) AS cs, array_to_string(qt, ' ') AS qp, array_to_string(ct, ' ') AS cp FROM
(SELECT {cols}, q, c, list_filter(string_split(q, ' '), lambda z: length(z) >= 2 AND NOT list_contains({_STOP}, z)) AS qt,
list_filter(string_split(c, ' '), lambda z: length(z) >= 2 AND NOT list_contains({_STOP}, z)) AS ct FROM {src})))"""


@query("listing_similarity_x22", _PAIR + f", n AS (SELECT p_partkey, {q.listing('x')} AS q, {q.listing('y')} AS c FROM pr) SELECT p_partkey, round({LISTING_SCORE}, 6) AS score FROM {listing_parts('n', 'p_partkey')}")
def listing_similarity(t):
    return pairs(t.part).select("p_partkey", F.round(SIM.listing_title_score(
        TT.listing_norm(F.col("x")), TT.listing_norm(F.col("y"))), 6).alias("score"))


def ordinal_sql(qe: str, te: str, n: int, both: bool) -> str:
    pre = f"starts_with({te}, {qe})" + (f" OR starts_with({qe}, {te})" if both else "")
    qt = f"list_filter(string_split({qe}, ' '), lambda z: length(z) >= {n})"
    tt = f"list_filter(string_split({te}, ' '), lambda z: length(z) >= {n})"
    shared = f"len(list_filter({qt}, lambda z: list_contains({tt}, z)))"
    return f"""CASE WHEN {te} = {qe} THEN 0 WHEN {pre} THEN 1 WHEN {shared} > 0 AND {shared} >= least(len({qt}), len({tt})) THEN 1.5
WHEN contains({te}, {qe}) OR contains({qe}, {te}) THEN 2 END"""


@query("ordinal_scores_x23", _PAIR + f""", n AS (SELECT p_partkey, lower({q.ws('x')}) AS q, lower({q.ws('y')}) AS c, trim(regexp_replace(regexp_replace(lower(x), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS qa,
trim(regexp_replace(regexp_replace(lower(y), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS ca, {q.alnum('x')} AS qn, {q.alnum('y')} AS cn FROM pr)
SELECT p_partkey, {ordinal_sql('q', 'c', 3, False)} AS catalogue_score, {ordinal_sql('qa', 'ca', 2, True)} AS reader_score,
round(CASE WHEN qn = cn THEN 0 WHEN starts_with(cn, qn) OR starts_with(qn, cn) THEN 1 WHEN contains(qn, cn) OR contains(cn, qn) THEN 2
WHEN len(list_intersect(string_split(qn, ' '), string_split(cn, ' '))) = 0 THEN 10 ELSE 3 - least(len(list_intersect(string_split(qn, ' '), string_split(cn, ' '))) * 0.4, 1.8) END, 6) AS resolver_score FROM n""")
def ordinal_scores(t):
    x, y = F.col("x"), F.col("y")
    return pairs(t.part).select(
        "p_partkey",
        SIM.ordinal_title_score(F.lower(T.collapse(x)), F.array(F.lower(T.collapse(y)))).alias("catalogue_score"),
        SIM.ordinal_title_score(T.title_norm_apostrophe(x), F.array(T.title_norm_apostrophe(y)), 2, True).alias("reader_score"),
        F.round(SIM.resolver_title_score(T.title_norm(x), T.title_norm(y)), 6).alias("resolver_score"),
    )


@query("edit_distance_x24", _PAIR + " SELECT p_partkey, levenshtein(x, y) AS distance FROM pr")
def edit_distance(t):
    return pairs(t.part).select("p_partkey", F.levenshtein("x", "y").cast("long").alias("distance"))


@query("typo_similarity_x25", """WITH v AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS a, CASE p_partkey % 3 WHEN 0 THEN replace(split_part(p_name, ' ', 2), 'i', 'ie') WHEN 1 THEN p_type ELSE split_part(p_name, ' ', 2) END AS b FROM part)
SELECT p_partkey, round(CASE WHEN a = b THEN 1 WHEN length(a) < 4 OR length(b) < 4 THEN 0 WHEN levenshtein(a, b) > greatest(1, floor(greatest(length(a), length(b)) * 0.28)) THEN 0
ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS score FROM v""")
def typo_similarity(t):
    a = F.substring_index("p_name", " ", -1)
    k = F.col("p_partkey") % 3
    b = F.when(k == 0, F.replace(a, F.lit("i"), F.lit("ie"))).when(k == 1, F.col("p_type")).otherwise(a)
    return t.part.select("p_partkey", F.round(SIM.typo_similarity(a, b), 6).alias("score"))


_SUG = q.lst(L.SUGGESTION_STOPWORDS)


def suggestion_set(c: str) -> str:
    return f"list_distinct(list_filter(string_split({q.alnum(c)}, ' '), lambda z: z <> '' AND NOT list_contains({_SUG}, z)))"


@query("title_jaccard_x27", _PAIR + f""", n AS (SELECT p_partkey, {suggestion_set('x')} AS a, {suggestion_set('y')} AS b FROM pr)
SELECT p_partkey, CAST(floor(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 100 + 0.5) AS INT) AS confidence FROM n""")
def title_jaccard(t):
    rows = pairs(t.part).select("p_partkey", SIM.suggestion_tokens(F.col("x")).alias("a"), SIM.suggestion_tokens(F.col("y")).alias("b"))
    return rows.select("p_partkey", SIM.jaccard_percent(*SIM.set_parts(F.col("a"), F.col("b"))).alias("confidence"))


@query("token_sets_u4", _PAIR + f""", n AS (SELECT p_partkey, list_distinct({q.toks('x')}) AS a, list_distinct({q.toks('y')}) AS b FROM pr)
SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS either, len(list_filter(a, lambda z: NOT list_contains(b, z))) AS only_a,
len(list_filter(a, lambda z: NOT list_contains(b, z))) = 0 AS is_subset FROM n""")
def token_sets(t):
    rows = pairs(t.part).select("p_partkey", F.array_distinct(T.tokens(F.col("x"))).alias("a"), F.array_distinct(T.tokens(F.col("y"))).alias("b"))
    return rows.select(
        "p_partkey", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("either"),
        F.size(F.array_except("a", "b")).alias("only_a"), (F.size(F.array_except("a", "b")) == 0).alias("is_subset"),
    )
