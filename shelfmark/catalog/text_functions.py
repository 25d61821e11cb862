"""String, array and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import jsonfn as J, lexicon as L, sections as S, text as T, titles as TT
from shelfmark.session import spread

from . import query, sql as q, views
from .sql import LAB

PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def page_title():
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query("collapse_whitespace_x1", f"SELECT doc_id, {q.ws('text')} AS clean FROM documents")
def collapse_whitespace(t):
    return t.documents.select("doc_id", T.collapse(F.col("text")).alias("clean"))


def _six(c):
    for a, b in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")]:
        c = f"replace({c}, '{a}', '{b}')"
    return c


_BOILER = r"(?i)\[(?:Written|Adapted)\s+by\s+MAL\s+Rewrite\]|\bSource:\s*[^.\n]+"


def _clean_sql(decoded):
    return q.ws(f"regexp_replace(regexp_replace({decoded}, '<[^>]+>', ' ', 'g'), '{_BOILER}', ' ', 'g')")


@query("clean_html_x2", f"SELECT page_id, {_clean_sql(_six('html'))} AS clean FROM pages")
def clean_html(t):
    return t.pages.select("page_id", T.clean_html(F.col("html")).alias("clean"))


_FULL = "replace(replace(" + _six("html") + ", '&copy;', '©'), '&middot;', '·')"


@query("clean_html_full_entities_x2", f"SELECT page_id, {_clean_sql(_FULL)} AS clean FROM pages")
def clean_html_full(t):
    return t.pages.select("page_id", T.clean_html(F.col("html"), full_entities=True).alias("clean"))


@query("strip_tags_x2_twin", f"SELECT page_id, {q.strip_tags('html')} AS clean FROM pages")
def strip_tags(t):
    return t.pages.select("page_id", T.strip_tags(F.col("html")).alias("clean"))


@query("match_norm_x3", f"SELECT doc_id, {q.norm('text')} AS norm FROM documents")
def match_norm(t):
    return t.documents.select("doc_id", T.match_norm(F.col("text")).alias("norm"))


@query("loose_romanization_x4", f"SELECT p_partkey, {q.loose(q.norm('p_name'))} AS loose FROM part")
def loose(t):
    return spread(t.part).select("p_partkey", T.loose(T.match_norm(F.col("p_name"))).alias("loose"))


@query("tokens_x5", f"SELECT doc_id, len({q.toks('text')}) AS n, {q.join(q.toks('text'))} AS tokens FROM documents")
def tokens(t):
    rows = t.documents.select("doc_id", T.tokens(F.col("text")).alias("a"))
    return rows.select("doc_id", F.size("a").alias("n"), F.array_join("a", " ").alias("tokens"))


@query("query_tokens_x6", f"WITH r AS (SELECT item_id, {q.toks('text')} AS r FROM benchmark) SELECT item_id, {q.join(q.qtoks('r'))} AS tokens FROM r")
def query_tokens(t):
    return t.benchmark.select("item_id", F.array_join(T.query_tokens(T.tokens(F.col("text"))), " ").alias("tokens"))


_FOLD = "trim(regexp_replace(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"


@query("ascii_fold_x7", "SELECT doc_id, " + _FOLD.format(c="text") + " AS folded FROM documents")
def ascii_fold(t):
    return t.documents.select("doc_id", T.ascii_fold(F.col("text")).alias("folded"))


def _first_wins(lst, key):
    return f"list_filter({lst}, lambda x, i: list_position(list_transform({lst}, lambda y: {key.format('y')}), {key.format('x')}) = i)"


_NAME_SQL = f"""WITH n AS (SELECT doc_id, regexp_extract_all(split_part(text, chr(10), 1), '[^ .,!%&*#$|]{{2,}}') AS w FROM documents),
p AS (SELECT doc_id, w[1] AS a, w[2] AS b FROM n WHERE len(w) >= 2),
o AS (SELECT doc_id, unnest([a || ', ' || b, b || ' ' || a, a || ' ' || b]) AS v, unnest([1, 2, 3]) AS k FROM p),
f AS (SELECT *, {_FOLD.format(c='v')} AS fv FROM o),
e AS (SELECT doc_id, k * 10 + j AS pos, CASE j WHEN 1 THEN v WHEN 2 THEN fv WHEN 3 THEN {q.ws(q.loose('lower(v)'))} ELSE {q.ws(q.loose('lower(fv)'))} END AS x
  FROM f, (VALUES (1), (2), (3), (4)) j(j)),
d AS (SELECT doc_id, lower(x) AS kx, min(pos) AS pos, arg_min(x, pos) AS x FROM e WHERE x <> '' GROUP BY 1, 2)
SELECT doc_id, string_agg(x, '; ' ORDER BY pos) AS aliases FROM d GROUP BY 1"""


@query("name_aliases_x8", _NAME_SQL)
def name_aliases(t):
    words = F.regexp_extract_all(F.substring_index("text", "\n", 1), F.lit("[^ .,!%&*#$|]{2,}"), F.lit(0))
    named = t.documents.select("doc_id", words.alias("w")).where(F.size("w") >= 2).select(
        "doc_id", F.concat(F.col("w")[0], F.lit(", "), F.col("w")[1]).alias("name")
    )
    out = S.with_name_aliases(named, F.array("name"))
    return out.select("doc_id", F.array_join("aliases", "; ").alias("aliases"))


@query("name_aliases_x8_whole")
def name_aliases_whole(t):
    """Aliases of the names in whole first lines: two words a name, a last single word a name of its own."""
    words = F.regexp_extract_all(F.substring_index("text", "\n", 1), F.lit("[^ .,!%&*#$|]{2,}"), F.lit(0))
    starts = F.filter(F.transform("w", lambda _, i: i), lambda i: i % 2 == 0)
    name = lambda i: F.concat_ws(", ", F.get("w", i), F.get("w", i + 1))
    named = t.documents.select("doc_id", words.alias("w")).select("doc_id", F.transform(starts, name).alias("names"))
    out = S.with_name_aliases(named, F.col("names"))
    return out.select("doc_id", F.array_join("aliases", "; ").alias("aliases"))


@query("section_x9", f"""WITH {LAB} SELECT doc_id, CASE WHEN syn = '' THEN 'No synopsis available.' ELSE syn END AS synopsis,
source || ', ' || media_type AS genres, CASE WHEN len(chars) = 0 THEN 'Unknown' ELSE array_to_string(chars, '; ') END AS characters,
'' AS aliases FROM lab""")
def section(t):
    p = F.col("payload")
    return views.labelled(t.documents).select(
        "doc_id", S.section(p, "Synopsis:").alias("synopsis"), S.section(p, "Genres:").alias("genres"),
        S.section(p, "Characters:").alias("characters"), S.section(p, "Character Search Aliases:").alias("aliases"),
    )


@query("line_fields_x10", f"""WITH {LAB} SELECT doc_id, kind AS type, ttl AS title, source || ', ' || media_type AS genres,
CASE WHEN syn = '' THEN 'No synopsis available.' ELSE syn END AS synopsis FROM lab""")
def line_fields(t):
    return views.labelled(t.documents).select("doc_id", S.text_fields(F.col("payload")).alias("f")).select("doc_id", "f.*")


_ALIASES = f"""WITH {LAB}, o AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN [w[1] || ', ' || w[2], w[2] || ' ' || w[1], w[1] || ' ' || w[2], w[3] || ' ' || w[4]]
  WHEN len(w) >= 1 THEN [w[1]] ELSE CAST([] AS VARCHAR[]) END AS o FROM lab),
e AS (SELECT doc_id, list_filter(flatten(list_transform(o, lambda v: [v, {q.loose('lower(v)')}])), lambda v: lower(v) <> 'unknown') AS a FROM o)
SELECT doc_id, array_to_string({_first_wins('a', 'lower({0})')}, '; ') AS aliases FROM e"""


@query("text_aliases_x11", _ALIASES)
def text_aliases(t):
    out = S.with_text_aliases(views.labelled(t.documents).select("doc_id", "payload"), "payload")
    return out.select("doc_id", F.array_join("aliases", "; ").alias("aliases"))


SERVICE_SQL = f"""WITH {LAB}, o AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN [w[1] || ', ' || w[2], w[2] || ' ' || w[1], w[1] || ' ' || w[2], w[3] || ' ' || w[4]]
  WHEN len(w) >= 1 THEN [w[1]] ELSE CAST([] AS VARCHAR[]) END AS o FROM lab),
a AS (SELECT doc_id, list_transform(o, lambda v: {q.norm('v')}) AS a FROM o)"""


@query("service_aliases_x11_twin", SERVICE_SQL + f" SELECT doc_id, array_to_string({_first_wins('a', '{0}')}, '; ') AS aliases FROM a")
def service_aliases(t):
    return views.labelled(t.documents).select("doc_id", F.array_join(S.service_aliases(F.col("payload")), "; ").alias("aliases"))


@query("eval_aliases_x11_eval", f"""WITH {LAB} SELECT doc_id, CASE WHEN len(w) >= 4 THEN CASE WHEN lower(w[1] || ', ' || w[2]) = lower(w[3] || ' ' || w[4])
THEN w[1] || ', ' || w[2] ELSE w[1] || ', ' || w[2] || '; ' || w[3] || ' ' || w[4] END WHEN len(w) >= 1 THEN w[1] ELSE '' END AS aliases FROM lab""")
def eval_aliases(t):
    return views.labelled(t.documents).select("doc_id", F.array_join(S.eval_aliases(F.col("payload")), "; ").alias("aliases"))


@query("snippet_fields_x12", f"""WITH {LAB}, c AS (SELECT *, CASE WHEN len(chars) = 0 THEN [] ELSE chars END AS ch FROM lab)
SELECT doc_id, kind AS display_type, kind AS media_type, source || ' / ' || media_type AS genres, array_to_string(ch, ' / ') AS characters FROM c""")
def snippet_fields(t):
    rows = views.labelled(t.documents).select(
        "doc_id", "payload", *[S.snippet_section(F.col("payload"), f"{n}:").alias(n) for n in ("type", "genres", "characters")]
    )
    return rows.select(
        "doc_id", S.display_type_of(F.col("type")).alias("display_type"), S.snippet_media_type(F.col("payload")).alias("media_type"),
        F.array_join(S.genres_of(F.col("genres")), " / ").alias("genres"),
        F.array_join(S.characters_of(F.col("characters")), " / ").alias("characters"),
    )


_FULL_TITLE = "p_brand || ': ' || p_name || '''s - ' || p_type"


def full_title():
    return F.concat(F.col("p_brand"), F.lit(": "), F.col("p_name"), F.lit("'s - "), F.col("p_type"))


@query("title_norms_x13", f"""WITH v AS (SELECT p_partkey, {_FULL_TITLE} AS s FROM part) SELECT p_partkey, {q.alnum('s')} AS alnum,
{q.cjk('s')} AS cjk, trim(regexp_replace(regexp_replace(lower(s), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS apostrophe, {q.listing('s')} AS listing FROM v""")
def title_norms(t):
    s = full_title()
    return spread(t.part).select(
        "p_partkey", T.title_norm(s).alias("alnum"), T.title_norm_cjk(s).alias("cjk"),
        T.title_norm_apostrophe(s).alias("apostrophe"), TT.listing_norm(s).alias("listing"),
    )


@query("root_title_x14", f"""WITH v AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN {_FULL_TITLE} WHEN 1 THEN p_name || ' - ' || p_type ELSE p_name END AS s FROM part)
SELECT p_partkey, CASE WHEN contains(s, ':') THEN trim(split_part(s, ':', 1)) WHEN contains(s, ' - ') THEN trim(split_part(s, ' - ', 1)) ELSE s END AS root FROM v""")
def root_title(t):
    s = F.when(F.col("p_partkey") % 3 == 0, full_title()).when(
        F.col("p_partkey") % 3 == 1, F.concat_ws(" - ", "p_name", "p_type")
    ).otherwise(F.col("p_name"))
    return spread(t.part).select("p_partkey", T.root_title(s).alias("root"))


def _chain(c, steps):
    out = f"trim({c})"
    for step in steps:
        out = "trim(regexp_replace({}, '{}', '', 'g'))".format(out, step.replace("'", "''"))
    return out


_BASE = f"WITH v AS (SELECT p_partkey, {_FULL_TITLE} AS s FROM part), "


@query("eval_title_variants_x15", _BASE + f"""l AS (SELECT p_partkey, [s, lower(s), {q.ws("regexp_replace(s, '[^A-Za-z0-9 ]+', ' ', 'g')")},
trim(split_part(s, ':', 1)), trim(split_part(s, '-', 1))] AS l FROM v) SELECT p_partkey, array_to_string({_first_wins('l', q.alnum('{0}'))}, ' / ') AS variants FROM l""")
def eval_title_variants(t):
    return spread(t.part).select("p_partkey", F.array_join(TT.query_variants(full_title()), " / ").alias("variants"))


_STEPS = T._PAGE_TITLE_STEPS


@query("read_now_variants_x15", _BASE + f"""b AS (SELECT p_partkey, {_chain('s', _STEPS)} AS b FROM v),
r AS (SELECT p_partkey, [b, regexp_replace(b, '[^a-zA-Z0-9]+', ' ', 'g'), regexp_replace(b, '\\s*\\([^)]*\\)\\s*', ' ', 'g'), regexp_split_to_array(b, '\\s*[-\\x{{2013}}\\x{{2014}}:|]\\s*')[1]] AS r FROM b),
l AS (SELECT p_partkey, list_filter(list_transform(r, lambda x: {_chain('x', _STEPS)}), lambda x: length(x) >= 2 AND regexp_matches(x, '[a-zA-Z]')) AS l FROM r)
SELECT p_partkey, array_to_string(({_first_wins('l', q.listing('{0}'))})[1:12], ' / ') AS variants FROM l""")
def read_now_variants(t):
    return spread(t.part).select("p_partkey", F.array_join(TT.read_now_variants(F.array(full_title())), " / ").alias("variants"))


@query("listing_search_variants_x15", _BASE + f"""l AS (SELECT p_partkey, [s, {q.ws("regexp_replace(regexp_replace(s, '[()\\[\\]{}:|]', ' ', 'g'), '[-_/–—]+', ' ', 'g')")},
trim(regexp_split_to_array(s, '[-:|(\\[]')[1]), CASE WHEN contains(s, ' - ') THEN trim(split_part(s, ' - ', 1)) END,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\\b(chapter|chap|ch|episode|ep)\\b.*$', ''), '(?i)\\bvol(?:ume)?\\b.*$', ''), '\\b\\d+(?:\\.\\d+)?\\b.*$', ''), '[\\s\\-_:|]+$', ''))] AS l FROM v)
SELECT p_partkey, array_to_string({_first_wins("list_filter(l, lambda z: z IS NOT NULL AND z <> '''')", '{0}')}, ' / ') AS variants FROM l""".replace("<> ''''", "<> ''"))
def listing_search_variants(t):
    return spread(t.part).select("p_partkey", F.array_join(TT.listing_search_variants(full_title()), " / ").alias("variants"))


_NOISE = [
    r"(?i)^(?:chapter|chap|ch\.?|episode|ep\.?)\s*[-#: ]?\d+(?:\.\d+)?\s*[-–—:|]\s*",
    r"(?i)\s*[-–—:|]\s*(?:chapter|chap|ch\.?|episode|ep\.?)\s*[-#: ]?\d+(?:\.\d+)?.*$",
    r"(?i)\b(?:chapter|chap|ch\.?|episode|ep\.?)\s*[-#: ]?\d+(?:\.\d+)?.*$",
]


@query("noise_free_variants_x15", f"""WITH v AS (SELECT page_id, {q.ws(PAGE_TITLE)} AS s, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages),
c AS (SELECT page_id, {_chain("s || ' - Chapter ' || page_id", _NOISE)} AS a, {_chain("'Ch. ' || page_id || ': ' || s", _NOISE)} AS b, trim(regexp_replace(split_part(regexp_replace(h, '(?i)^www\\.', ''), '.', 1), '[-_]+', ' ', 'g')) AS h FROM v),
l AS (SELECT page_id, [a, trim(regexp_split_to_array(a, '[-–—:|(\\[\\\\]')[1]), b, trim(regexp_split_to_array(b, '[-–—:|(\\[\\\\]')[1]), h] AS l FROM c)
SELECT page_id, array_to_string({_first_wins("list_filter(l, lambda z: length(z) >= 2)", '{0}')}, ' / ') AS variants FROM l""")
def noise_free_variants(t):
    title = T.collapse(page_title())
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    pid = F.col("page_id").cast("string")
    return t.pages.select("page_id", F.array_join(TT.noise_free_variants(
        F.concat(title, F.lit(" - Chapter "), pid), F.concat(F.lit("Ch. "), pid, F.lit(": "), title), host
    ), " / ").alias("variants"))


_PT = f"""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Read ' || {PAGE_TITLE} || ' | Site' WHEN 1 THEN {PAGE_TITLE} || ' - Foo Scans'
WHEN 2 THEN {PAGE_TITLE} || ' Chapter 12 (Official)' ELSE {PAGE_TITLE} END AS s FROM pages)"""


@query("page_title_cleaner_x16", _PT + f" SELECT page_id, {_chain('s', _STEPS)} AS clean FROM v")
def page_title_cleaner(t):
    k, title = F.col("page_id") % 4, page_title()
    s = F.when(k == 0, F.concat(F.lit("Read "), title, F.lit(" | Site"))).when(
        k == 1, F.concat(title, F.lit(" - Foo Scans"))
    ).when(k == 2, F.concat(title, F.lit(" Chapter 12 (Official)"))).otherwise(title)
    return t.pages.select("page_id", T.clean_page_title(s).alias("clean"))


_SFX = "|".join(L.FUSED_SUFFIXES)


@query("fused_suffixes_x17", f"""WITH w AS (SELECT item_id, {q.strip_tags('text')} AS s FROM benchmark),
j AS (SELECT item_id, s, array_to_string(list_transform(string_split(s, ' '), lambda w: CASE WHEN regexp_matches(w, '(?i)^.{{5,}}(?:{_SFX})$')
THEN regexp_replace(regexp_replace(w, '(?i)^(.{{5,}}?)({_SFX})$', '\\1 \\2'), '(?i)e (ui)$', ' \\1') ELSE w END), ' ') AS j FROM w)
SELECT item_id, CASE WHEN j <> s THEN j ELSE '' END AS variant FROM j""")
def fused_suffixes(t):
    return t.benchmark.select("item_id", T.split_fused_suffixes(F.col("text")).alias("variant"))


@query("series_title_x18", f"""WITH v AS (SELECT page_id, {q.ws(PAGE_TITLE)} || CASE WHEN page_id % 2 = 0 THEN ' - Chapter ' || page_id ELSE '' END AS s FROM pages),
c AS (SELECT page_id, s, trim(regexp_replace(s, '(?i)\\s*[,|:\\-–]\\s*(chapter|ch\\.?|episode|ep\\.?)\\s*[-#: ]?\\d+(?:\\.\\d+)?\\s*$', '')) AS c FROM v)
SELECT page_id, CASE WHEN s = '' THEN 'Unknown Series' WHEN length(c) >= 2 THEN c ELSE s END AS series FROM c""")
def series_title(t):
    s = F.concat(T.collapse(page_title()), F.when(
        F.col("page_id") % 2 == 0, F.concat(F.lit(" - Chapter "), F.col("page_id").cast("string"))
    ).otherwise(""))
    return t.pages.select("page_id", T.series_title(s).alias("series"))


@query("status_norm_x19", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'ongoing' WHEN 'F' THEN 'completed' ELSE 'unknown' END AS status,
CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'ongoing' END AS status_wide FROM orders""")
def status_norm(t):
    raw = F.when(F.col("o_orderstatus") == "O", "On hold? ONGOING").when(
        F.col("o_orderstatus") == "F", "Finished airing"
    ).otherwise("Publishing")
    return t.orders.select("o_orderkey", T.status_norm(raw).alias("status"), T.status_norm(raw, True).alias("status_wide"))


@query("safe_number_x32", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS n,
CASE WHEN event_id % 5 = 0 THEN 9 ELSE least(greatest(floor(value + 0.5), 1), 9) END AS depth,
CASE WHEN event_id % 5 = 0 THEN NULL ELSE least(greatest(floor(value / 5 + 0.5) * 5, 5), 50) END AS step FROM events""")
def safe_number(t):
    raw = F.when(F.col("event_id") % 10 == 0, "NaN").when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    n = T.safe_number(raw)
    return t.events.select(
        "event_id", n.alias("n"), F.coalesce(T.clamp(T.js_round(n), 1, 9), F.lit(9)).cast("double").alias("depth"),
        T.clamp(T.js_round(n / 5) * 5, 5, 50).cast("double").alias("step"),
    )


@query("json_in_text_x45", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS found,
CASE WHEN event_id % 3 = 1 THEN props ELSE NULL END AS widest FROM events""")
def json_in_text(t):
    """Event properties inside prose with a stray brace, inside a fence, or cut off."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("note {x "), F.col("props"), F.lit(" end}"))).when(
        k == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done"))
    ).otherwise(F.concat(F.lit("see {"), F.substring("props", 1, 3)))
    return t.events.select("event_id", J.first_json_object(text).alias("found"), J.widest_json_object(text).alias("widest"))


@query("nested_strings_x46", f"""SELECT p_partkey, {q.ws('p_name')} || ' / ' || {q.ws("p_brand || ' ' || p_name")} AS aliases,
lower(p_name) || ' / ' || lower(p_brand || ' ' || p_name) || ' / unknown' AS strings, 'C' || p_partkey || '=/c/' || p_partkey AS chapters FROM part""")
def nested_strings(t):
    nested = F.to_json(F.struct(
        F.col("p_name").alias("title"),
        F.struct(F.array(F.struct(F.concat_ws(" ", "p_brand", "p_name").alias("title")), F.struct(F.lit("Unknown").alias("title"))).alias("synonyms")).alias("titles"),
    ))
    snapshot = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("/c/"), F.col("p_partkey").cast("string")).alias("web_url"), F.lit(1).alias("z"),
    ).alias("d"))).alias("data")))
    rows = t.part.select("p_partkey", J.alias_strings(nested).alias("a"), J.all_strings(nested).alias("s"),
                         J.chapter_objects(snapshot).alias("c"))
    return rows.select(
        "p_partkey", F.array_join("a", " / ").alias("aliases"), F.array_join("s", " / ").alias("strings"),
        F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("="), x["web_url"])), " / ").alias("chapters"),
    )


@query("flexible_coercion_x47", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN '' ELSE event_type || ' / ' || user_id END AS items,
CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS kind FROM events""")
def flexible_coercion(t):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.to_json(F.array(F.col("event_type"), F.lit(""), F.col("user_id").cast("string")))).when(
        k == 1, F.concat(F.col("event_type"), F.lit(" ;, "), F.col("user_id").cast("string"), F.lit("|")))
    return t.events.select("event_id", F.array_join(J.flexible_list(raw), " / ").alias("items"),
                           J.enum_or(F.upper("event_type"), ["view", "click"], "unknown").alias("kind"))
