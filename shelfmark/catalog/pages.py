"""URL functions and page extraction over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T, urls as U
from shelfmark.operators import chapters as C, pages as PG
from shelfmark.plans import page_record as PR
from shelfmark.session import materialize

from . import query, sql as q
from .dedupe import LINKS_SQL, anchors
from .text_functions import PAGE_TITLE

ORIGIN = "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))"
HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
PATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/')"
SEARCH = "regexp_extract(url, '^[^?#]*([?][^#]*)', 1)"
NHOST = f"regexp_replace({HOST}, '^(www[0-9]*|www|m|mobile|read)\\.', '')"


@query("comparable_url_x35", f"SELECT page_id, {ORIGIN} || {PATH} || {SEARCH} AS url FROM pages UNION ALL SELECT page_id + 1000000, 'not a url #x' FROM pages")
def comparable_url(t):
    good = t.pages.select("page_id", U.comparable(F.col("url")).alias("url"))
    bad = t.pages.select((F.col("page_id") + 1_000_000).alias("page_id"), U.comparable(F.lit("not a url #x")).alias("url"))
    return good.unionByName(bad)


@query("absolute_url_x36", rf"""WITH {LINKS_SQL} SELECT page_id, pos, CASE pos % 5 WHEN 0 THEN NULL WHEN 1 THEN href WHEN 2 THEN {ORIGIN} || '/up' WHEN 3 THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example/x' ELSE {ORIGIN} || '/z/q' END AS url
FROM links JOIN pages USING (page_id)""")
def absolute_url(t):
    k = F.col("pos") % 5
    rows = anchors(t.pages).join(t.pages.select("page_id", F.col("url").alias("base")), "page_id")
    path = F.regexp_replace("href", "^https?://[^/]+", "")
    ref = F.when(k == 0, "JavaScript:void(0)").when(k == 1, path).when(k == 2, "/a/b/../../up").when(k == 3, "//cdn.example/x").otherwise("/z/./q")
    return rows.select("page_id", "pos", U.absolute(F.col("base"), ref).alias("url"))


@query("host_norm_x37", f"SELECT page_id, {NHOST} AS host, regexp_replace({HOST}, '^www\\.', '') AS domain FROM pages")
def host_norm(t):
    return t.pages.select("page_id", U.normal_host(F.col("url")).alias("host"), U.domain(F.col("url")).alias("domain"))


_SEG = f"list_filter(string_split(lower({PATH}), '/'), lambda z: z <> '')"


@query("series_key_x38", f"""WITH v AS (SELECT page_id, {NHOST} AS h, {_SEG} AS s FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN {ORIGIN} || '/manga/S' || page_id || '-chapter-12/' WHEN 2 THEN {ORIGIN} || '/read/x/' || page_id ELSE {ORIGIN} || '/view?a=1&title_no=T' || page_id END AS url FROM pages))
SELECT page_id, CASE page_id % 4 WHEN 0 THEN h || CASE WHEN len(s) >= 2 THEN '/' || s[1] || '/' || s[2] ELSE '' END WHEN 1 THEN h || '/manga/s' || page_id WHEN 2 THEN h ELSE h || '?title_no=t' || page_id END AS series FROM v""")
def series_key(t):
    k, origin, pid = F.col("page_id") % 4, U.parts(F.col("url"))["origin"], F.col("page_id").cast("string")
    url = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(origin, F.lit("/manga/S"), pid, F.lit("-chapter-12/")))
        .when(k == 2, F.concat(origin, F.lit("/read/x/"), pid)).otherwise(F.concat(origin, F.lit("/view?a=1&title_no=T"), pid))
    )
    return t.pages.select("page_id", U.series_key(url).alias("series"))


@query("parent_pages_x39", f"""WITH v AS (SELECT page_id, {ORIGIN} AS o FROM pages) SELECT page_id, o || '/s/x' || page_id || '/' AS candidate FROM v UNION ALL SELECT page_id, o || '/s/' FROM v
UNION ALL SELECT page_id, o || '/s/x' || page_id || '/part/' FROM v""")
def parent_pages(t):
    url = F.concat(U.parts(F.col("url"))["origin"], F.lit("/s/x"), F.col("page_id").cast("string"), F.lit("/part-chapter-3.5?x=1#f"))
    return t.pages.select("page_id", F.explode_outer(U.parent_candidates(url)).alias("candidate"))


@query("slug_title_x40", f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(s, '\\.[0-9]+$', ''), '(?i)[-_][a-z0-9]{{4,10}}$', ''), '[-_]+', ' ', 'g')) AS title, trim(split_part({HOST}, '.', 1)) AS label
FROM (SELECT *, 'the-' || split_part({HOST}, '.', 2) || '_big-' || page_id || 'abcd.' || page_id AS s FROM pages)""")
def slug_title(t):
    slug = F.concat(F.lit("the-"), F.get(F.split(U.host(F.col("url")), r"\."), F.lit(1)), F.lit("_big-"), F.col("page_id").cast("string"), F.lit("abcd."), F.col("page_id").cast("string"))
    return t.pages.select("page_id", U.slug_title(slug).alias("title"), F.get(F.split(U.host(F.col("url")), r"\."), F.lit(0)).alias("label"))


@query("chapter_token_x41", f"""WITH v AS (SELECT page_id, {PATH} AS p FROM pages) SELECT page_id, p || '/ch-0' || page_id || '.5/' AS path, '0' || page_id || '.5' AS raw, regexp_extract(p, '([0-9]+)[^0-9]*$', 1) AS plain FROM v WHERE NOT regexp_matches(p, '(?i)(c|ch|ep)[-_ ]*[0-9]')""")
def chapter_token(t):
    p = U.parts(F.col("url"))["path"]
    rows = t.pages.select("page_id", p.alias("p")).where(~F.regexp_like("p", F.lit("(?i)(c|ch|ep)[-_ ]*[0-9]")))
    keyed = F.concat(F.col("p"), F.lit("/ch-0"), F.col("page_id").cast("string"), F.lit(".5/"))
    return rows.select("page_id", keyed.alias("path"), U.chapter_token(keyed)["raw"].alias("raw"), U.chapter_token(F.col("p"))["raw"].alias("plain"))


@query("chapter_token_x41_whole")
def chapter_token_whole(t):
    """Every page's own token, and the token after a keyed part is added to its path."""
    p = U.parts(F.col("url"))["path"]
    keyed = F.concat(p, F.lit("/ch-0"), F.col("page_id").cast("string"), F.lit(".5/"))
    return t.pages.select("page_id", keyed.alias("path"), U.chapter_token(keyed)["raw"].alias("raw"), U.chapter_token(p)["raw"].alias("plain"))


REGISTRY = [("net", "example.net", "scroll"), ("com", "example.com", "paginated"), ("blog", "blog.example.org", "scroll"), ("org", "example.org", "paginated")]


def registry(spark):
    return spark.createDataFrame([(i, s, d, m) for i, (s, d, m) in enumerate(REGISTRY)], "rank int, site string, domain string, default_mode string")


@query("site_registry_x44", f"""SELECT page_id, CASE WHEN d = 'example.net' OR ends_with(d, '.example.net') THEN 'net' WHEN d = 'example.com' OR ends_with(d, '.example.com') THEN 'com'
WHEN d = 'example.org' OR ends_with(d, '.example.org') THEN 'org' END AS site FROM (SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS d FROM pages)""")
def site_registry(t):
    return PG.site_of(t.pages, registry(t.spark)).select("page_id", "site")


@query("url_admission_f10", f"""SELECT page_id FROM (SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS d, {PATH} AS p FROM pages) WHERE NOT (d = 'cheap-pills.example.com' OR ends_with(d, '.example.net')) AND NOT regexp_matches(p, '(?i)/(blogs?|posts?|articles?|news|guide|review|wiki|about|faq|help)/')""")
def url_admission(t):
    """Pages outside the skipped domains and article paths."""
    skipped = t.spark.createDataFrame([("cheap-pills.example.com",), ("example.net",)], "suffix string")
    rows = t.pages.select("page_id", "url").where(~U.is_article_path(F.col("url")))
    hits = T.exploded(rows, U.domain_suffixes(U.domain(F.col("url"))), "suffix").join(skipped, "suffix", "left_semi").select("page_id")
    return rows.join(hits, "page_id", "left_anti").select("page_id")


_CH = f"(SELECT page_id, CASE page_id % 4 WHEN 0 THEN {ORIGIN} || '/manga/x/' WHEN 1 THEN {ORIGIN} || '/manga/x/chapter-' || page_id WHEN 2 THEN {ORIGIN} || '/x-chapter-1' ELSE url END AS u FROM pages)"


def _chapterish(pages):
    k, o = F.col("page_id") % 4, U.parts(F.col("url"))["origin"]
    return F.when(k == 0, F.concat(o, F.lit("/manga/x/"))).when(k == 1, F.concat(o, F.lit("/manga/x/chapter-"), F.col("page_id").cast("string"))).when(
        k == 2, F.concat(o, F.lit("/x-chapter-1"))).otherwise(F.col("url"))


@query("chapter_url_tests_f11", f"""SELECT page_id, page_id % 4 <> 0 AS searched, regexp_matches(u, '(?i)(?:/|-)chapter[-_/ ]?\\d+|\\bc\\d+(?:\\.\\d+)?\\b|(?:/|-)ep(?:isode)?[-_/ ]?\\d+') AS is_chapter FROM {_CH}""")
def chapter_url_tests(t):
    rows = t.pages.select("page_id", _chapterish(t.pages).alias("u"))
    return rows.select("page_id", U.searched_as_chapter(F.col("u")).alias("searched"), U.is_chapter_url(F.col("u")).alias("is_chapter"))


@query("login_wall_f13", f"""SELECT page_id, page_id % 7 = 0 OR page_id % 5 = 0 OR (page_id % 3 = 0 AND page_id % 4 < 2) OR (page_id % 2 = 0 AND page_id % 4 < 5) AS wall FROM pages""")
def login_wall(t):
    pid = F.col("page_id")
    return t.pages.select("page_id", PG.login_wall(
        F.when(pid % 7 == 0, 403).otherwise(200), F.when(pid % 5 == 0, F.concat(F.col("url"), F.lit("/login?x"))).otherwise(F.col("url")),
        pid % 4, pid % 2 == 0, F.lit("Please sign in or register to continue reading"), pid % 3 == 0).alias("wall"))


@query("image_evidence_f14", rf"""WITH {LINKS_SQL}, v AS (SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN href ELSE 'https://cdn.example/none-' || pos END AS u FROM links)
SELECT page_id, pos, contains(html, u) OR contains(html, split_part(u, '?', 1)) OR contains(html, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1)) AS found FROM v JOIN pages USING (page_id)""")
def image_evidence(t):
    rows = anchors(t.pages).withColumn("u", F.when(F.col("pos") % 2 == 0, F.col("href")).otherwise(
        F.concat(F.lit("https://cdn.example/none-"), F.col("pos").cast("string"))))
    return rows.join(t.pages.select("page_id", "html"), "page_id").select("page_id", "pos", U.has_evidence(F.col("html"), F.col("u")).alias("found"))


@query("same_series_filter_f17", rf"""WITH {LINKS_SQL}, v AS (SELECT page_id, pos, page_id % 3 = 0 AND pos <= 2 AS same FROM links) SELECT page_id, pos FROM (SELECT *, max(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) AS hit FROM v) WHERE same OR hit = 0""")
def same_series_filter(t):
    """On every third page the first two links lead to the page's series; elsewhere none does and all stay."""
    base = t.pages.select("page_id", F.concat(U.parts(F.col("url"))["origin"], F.lit("/manga/own/chapter-1")).alias("base"))
    same = (F.col("page_id") % 3 == 0) & (F.col("pos") <= 2)
    rows = anchors(t.pages).join(base, "page_id").withColumn("url", F.when(
        same, F.concat(U.parts(F.col("base"))["origin"], F.lit("/manga/own/chapter-"), F.col("pos").cast("string"))).otherwise(
        F.concat(U.parts(F.col("base"))["origin"], F.lit("/manga/other/chapter-1"))))
    return C.same_series_or_all(rows, ["page_id"], "base").select("page_id", "pos")


# A host label such as "ads" rejects a URL as much as a path segment does.
_NOT_AD = r"NOT regexp_matches({c}, '(?i)(?:^|[/._-])(logo|avatar|icon|banner|sprite|thumb|cover|ads?)(?:[/._-]|$)')"


@query("content_image_f21", f"SELECT page_id, page_id % 5 IN (0, 1) AND {_NOT_AD.format(c=ORIGIN)} AS content FROM pages")
def content_image(t):
    tails = ["/a/page-1.JPG?x=1", "/uploads/z", "/img/logo.png", "/plain", "/ads/x.webp"]
    k = F.col("page_id") % 5
    url = F.concat(U.parts(F.col("url"))["origin"], F.element_at(T.lit_array(tails), (k + 1).cast("int")))
    return t.pages.select("page_id", U.is_content_image(url).alias("content"))


@query("earliest_chapter_w8", f"""SELECT page_id, o || CASE page_id % 3 WHEN 0 THEN '/s/chapter-' || 2 WHEN 1 THEN '/chapters/uuid/0003' ELSE '/chapters/4' END AS url, CASE page_id % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 ELSE 4.0 END AS number FROM (SELECT page_id, {ORIGIN} AS o FROM pages)""")
def earliest_chapter(t):
    """Earliest same-host chapter link by number, read with three URL shapes."""
    o = U.parts(F.col("url"))["origin"]
    k = F.col("page_id") % 3
    refs = F.when(k == 0, T.lit_array(["/s/chapter-10", "/s/chapter-2", "/about"])).when(k == 1, T.lit_array(["/chapters/uuid/0003", "/chapters/other/00012"])).otherwise(
        T.lit_array(["/chapters/4", "/chapters/99999", "/chapters/5"]))
    rows = T.exploded(t.pages.select("page_id", o.alias("o"), refs.alias("refs")), F.concat(
        F.transform("refs", lambda r: F.concat(F.col("o"), r)), F.array(F.lit("https://elsewhere.example/chapter-1"))), "url")
    kept = rows.where(U.parts(F.col("url"))["origin"] == F.col("o")).withColumn("number", U.listed_number(F.col("url"))).where(F.col("number").isNotNull())
    return kept.groupBy("page_id").agg(F.min_by("url", F.struct("number", "url")).alias("url"), F.min("number").alias("number"))


# --- extraction jobs ------------------------------------------------------------

def reader_pages(pages):
    """Pages with chapter links and images added to their own html, from their keys.

    Page k of host h becomes chapter k % 7 of one series of that host; every
    fourth page has no images, every ninth a login form.
    """
    pid = F.col("page_id")
    k = pid % 7
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(
        F.lit('<a class="c" href="/manga/s'), F.floor(pid / 10).cast("string"), F.lit("/chapter-"), i.cast("string"), F.lit('">Chapter '), i.cast("string"), F.lit("</a>"))), "")
    imgs = F.when(pid % 4 == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(
        F.lit('<img data-src="/uploads/p'), pid.cast("string"), F.lit("-"), i.cast("string"), F.lit('.jpg" width="100" height="'), (i * 100).cast("string"), F.lit('" src="/img/logo.png">'))), ""))
    form = F.when(pid % 9 == 0, '<form><input type="password" name="p"></form><p>Sign in to continue</p>').otherwise("")
    html = F.concat(F.col("html"), F.lit('<div class="chapters">'), links, F.lit('</div><div id="reader">'), imgs, F.lit("</div>"), form)
    url = F.concat(U.parts(F.col("url"))["origin"], F.lit("/manga/s"), F.floor(pid / 10).cast("string"), F.when(k == 0, "").otherwise(F.concat(F.lit("/chapter-"), k.cast("string"))))
    return pages.select("page_id", url.alias("url"), html.alias("html"))


def reader_elements(t):
    return materialize(PG.elements(reader_pages(t.pages)), "elements")


_RP = f"(SELECT page_id, {ORIGIN} AS o, page_id // 10 AS s FROM pages)"


@query("link_extraction_h1", f"SELECT page_id, o || '/manga/s' || s || '/chapter-' || i AS url, CAST(i AS VARCHAR) AS number, 'Chapter ' || i AS title FROM {_RP}, (VALUES (1), (2), (3)) v(i)")
def link_extraction(t):
    return PG.chapter_links(reader_elements(t), reader_pages(t.pages)).select("page_id", "url", "number", "title")


@query("image_extraction_h2", f"SELECT page_id, o || '/uploads/p' || page_id || '-' || i || '.jpg' AS url, 100 AS width, i * 100 AS height FROM {_RP}, (VALUES (1), (2), (3)) v(i) WHERE page_id % 4 <> 0 AND {_NOT_AD.format(c='o')}")
def image_extraction(t):
    return PG.images(reader_elements(t), reader_pages(t.pages)).select("page_id", "url", "width", "height")


_UNESC = f"replace(replace({q.ws(PAGE_TITLE)}, '&amp;', '&'), '&lt;', '<')"


@query("metadata_extraction_h3", f"SELECT page_id, {q.ws(_UNESC)} AS title, 'unknown' AS status FROM pages")
def metadata_extraction(t):
    rows = materialize(PG.elements(t.pages), "plain-elements")
    meta = PG.page_metadata(rows, t.pages, {"title": ["meta[property='og:title']", "title"]})
    return meta.select("page_id", "title", "status")


SITE_SELECTORS = {
    "net": {"title": ["h1", "title"], "links": [".chapters a"], "status": [".status"]},
    "com": {"title": [".entry-title", "title"], "links": ["a[href*='/chapter']"]},
}


@query("site_selectors_h4", f"""SELECT page_id, 'net' AS site, 3 AS n_links FROM pages WHERE ends_with({HOST}, 'example.net') UNION ALL SELECT page_id, 'com', 3 FROM pages WHERE ends_with({HOST}, 'example.com')""")
def site_selectors(t):
    pages = PG.site_of(reader_pages(t.pages), registry(t.spark))
    rows = reader_elements(t).join(pages.select("page_id", "site"), "page_id")
    got = PR.site_extraction(rows, pages, SITE_SELECTORS)
    n_links = got["links"].groupBy("page_id").agg(F.count("*").alias("n_links"))
    return got["meta"].join(n_links, "page_id", "left").join(pages.select("page_id", "site"), "page_id").select("page_id", "site", "n_links")


@query("site_chapter_lists_h5", f"SELECT page_id, o || '/c/' || page_id || '-' || i AS url, CAST(i AS VARCHAR) AS number FROM {_RP}, (VALUES (1), (2)) v(i)")
def site_chapter_lists(t):
    """Embedded JSON snapshot parser: any nested object with a name and a web_url."""
    from shelfmark.functions import jsonfn as J

    pid = F.col("page_id").cast("string")
    snapshot = F.to_json(F.struct(F.array(*[F.struct(
        F.format_string(f"Chapter {i}").alias("name"), F.concat(F.lit("/c/"), pid, F.lit(f"-{i}")).alias("web_url")) for i in (1, 2)]).alias("items")))
    rows = t.pages.select("page_id", "url", J.chapter_objects(snapshot).alias("c"))
    links = T.exploded(rows, F.col("c"), "x")
    return links.select("page_id", U.absolute(F.col("url"), F.col("x.web_url")).alias("url"), U.inferred_number(F.col("x.name"), F.col("x.web_url")).alias("number"))


def listed_pages(pages):
    """Pages with a chapter grid, a list below it and an ordered list added to their own html, from their keys.

    Every fifth page is the full list of its series.
    """
    pid = F.col("page_id").cast("string")
    grid = ('<div class="grid grid-cols-2 gap-3 justify-items-center lg:grid-cols-3"><a href="/chapters/{0}-1">Chapter 1</a>'
            '<button id="selected_chapter">Chapter 7 now</button><a href="/other/{0}">Chapter 9</a></div>'
            '<div class="grid grid-cols-2"><a href="/chapters/{0}-4">Chapter 4</a></div>'
            '<div id="chapter-list"><p><a href="/chapters/{0}-2"> Ch.  2 </a><a href="/chapters/{0}-1">Episode 1 again</a></p></div>')
    ordered = ('<ol role="list" aria-label="List of chapters"><li role="listitem"><a href="/preview/{0}/1"><span class="truncate flex-1">Chapter 1</span>'
               '<span>Chapter 5</span></a><a href="/x">next</a></li><li role="listitem"><a href="/preview/{0}/2">Chapter 2 - dawn</a></li></ol>'
               '<ol role="list" aria-label="Others"><li role="listitem"><a href="/preview/{0}/3">Chapter 3</a></li></ol>')
    html = F.concat(F.col("html"), F.replace(F.lit(grid + ordered), F.lit("{0}"), pid))
    url = F.concat(U.parts(F.col("url"))["origin"], F.lit("/series/"), pid, F.when(F.col("page_id") % 5 == 0, "/full-chapter-list").otherwise(""))
    return pages.select("page_id", url.alias("url"), html.alias("html"))


@query("grid_chapter_list_h5", f"""WITH p AS (SELECT page_id, {ORIGIN} AS o FROM pages), e AS (
SELECT page_id, o || '/chapters/' || page_id || '-1' AS url, '1' AS number, 'Episode 1' AS title FROM p
UNION ALL SELECT page_id, o || '/series/' || page_id || CASE WHEN page_id % 5 = 0 THEN '/full-chapter-list' ELSE '' END, '7', 'Chapter 7' FROM p
UNION ALL SELECT page_id, o || '/chapters/' || page_id || '-2', '2', 'Ch. 2' FROM p
UNION ALL SELECT page_id, o || '/chapters/' || page_id || '-4', '4', 'Chapter 4' FROM p WHERE page_id % 5 = 0) SELECT * FROM e""")
def grid_chapter_list(t):
    """Chapters of a grid, its chosen chapter and the list below, read from html."""
    pages = listed_pages(t.pages)
    return PG.grid_chapters(materialize(PG.elements(pages), "grid-elements"), pages).select("page_id", "url", "number", "title")


@query("ordered_chapter_list_h5", f"SELECT page_id, {ORIGIN} || '/preview/' || page_id || '/' || i AS url, CAST(i AS VARCHAR) AS number, 'Chapter ' || i AS title FROM pages, (VALUES (1), (2)) v(i)")
def ordered_chapter_list(t):
    """Chapters of an ordered list, read from html: the first link of each item."""
    pages = listed_pages(t.pages)
    return PG.ordered_chapters(materialize(PG.elements(pages), "item-elements"), pages).select("page_id", "url", "number", "title")


@query("page_parse_status_h3", "SELECT page_id, true AS parsed, CAST(NULL AS VARCHAR) AS error FROM pages")
def page_parse_status(t):
    """Whether each page could be parsed."""
    return PG.parse_status(materialize(PG.elements(t.pages), "status-elements"), t.pages)


@query("heuristic_merge_h6", f"""SELECT page_id, CASE WHEN ok THEN 'chapter' ELSE 'series' END AS page_type, CASE WHEN ok THEN 3 ELSE 0 END AS n_images, 3 AS n_links
FROM (SELECT page_id, page_id % 4 <> 0 AND {_NOT_AD.format(c=ORIGIN)} AS ok FROM pages)""")
def heuristic_merge(t):
    pages, rows = reader_pages(t.pages), reader_elements(t)
    generic = {k: materialize(v, k) for k, v in PR.site_extraction(rows, pages).items()}
    one = F.lit("one").alias("site")
    adapter = PR.site_extraction(rows.select("*", one), pages.select("*", one), {"one": {"title": ["h1"], "links": [".chapters a"]}})
    adapter = {k: materialize(v, k) for k, v in adapter.items()}
    return PR.heuristic_records(adapter, generic)["meta"].select("page_id", "page_type", "n_images", "n_links")


@query("override_merge_h7", f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'X ' || page_id ELSE t END AS title, CASE WHEN page_id % 3 = 0 THEN 'completed' ELSE 'unknown' END AS status,
CASE WHEN page_id % 2 = 0 THEN 'external' ELSE 'heuristic' END AS image_source FROM (SELECT page_id, {q.ws(PAGE_TITLE)} AS t FROM pages)""")
def override_merge(t):
    pid = F.col("page_id")
    none = F.lit(None).cast("string")
    heuristic = t.pages.select("page_id", T.collapse(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), none.alias("chapter_title"),
                               F.lit("1").alias("number"), none.alias("cover"), T.lit_array(["g"]).alias("genres"), F.lit("unknown").alias("status"))
    external = t.pages.select("page_id", F.when(pid % 2 == 0, F.concat(F.lit("X  "), pid.cast("string"))).otherwise("  ").alias("title"), F.lit("").alias("chapter_title"), none.alias("number"), none.alias("cover"),
                              F.array().cast("array<string>").alias("genres"), F.when(pid % 3 == 0, "completed").otherwise("unknown").alias("status"),
                              F.when(pid % 2 == 0, T.lit_array(["a", "b"])).otherwise(T.lit_array(["a"])).alias("images"))
    return PR.overridden(external, heuristic).select("page_id", "title", "status", "image_source")


@query("script_images_h8", f"""SELECT page_id, u FROM (SELECT page_id, unnest([{ORIGIN} || '/i/' || page_id || '.png?a=1', {ORIGIN} || '/e/' || page_id || '.webp']) AS u FROM pages)""")
def script_images(t):
    o, pid = U.parts(F.col("url"))["origin"], F.col("page_id").cast("string")
    html = F.concat(F.col("html"), F.lit('<script>var a=["'), o, F.lit("/i/"), pid, F.lit('.png?a=1"];b="'),
                    F.replace(F.concat(o, F.lit("/e/"), pid, F.lit(".webp")), F.lit("/"), F.lit("\\/")), F.lit('"</script>'))
    return T.exploded(t.pages.select("page_id", html.alias("h")), PG.script_images(F.col("h")), "u").select("page_id", "u")


@query("series_link_h9", rf"""WITH {LINKS_SQL} SELECT page_id, arg_min(href, pos) AS series_url FROM links WHERE pos >= 2 GROUP BY 1""")
def series_link(t):
    rows = anchors(t.pages).withColumnRenamed("href", "url")
    return PG.first_series_link(rows, t.pages, F.col("pos") >= 2)


@query("sanitise_h10", r"SELECT page_id, length(html) AS chars, substr(html, 1, 800) AS head FROM pages")
def sanitise(t):
    html = F.concat(F.lit("<noscript>n <b>x</b></noscript><EMBED src=x>"), F.col("html"), F.lit('<iframe src="y"></iframe>'))
    return t.pages.select("page_id", F.length(PG.sanitised(html)).alias("chars"), PG.sanitised(html, 800).alias("head"))


@query("cascading_images_u5", f"SELECT page_id, o || '/uploads/p' || page_id || '-' || i || '.jpg' AS url, 1 AS stage FROM {_RP}, (VALUES (1), (2), (3)) v(i) WHERE page_id % 4 <> 0 AND {_NOT_AD.format(c='o')} "
       f"UNION ALL SELECT page_id, o || '/i/' || page_id || '.png', 4 FROM {_RP} WHERE page_id % 4 = 0 AND {_NOT_AD.format(c='o')}")
def cascading_images(t):
    """Reader images where there are any; script URLs on the pages that have none."""
    pages = reader_pages(t.pages)
    o = U.parts(F.col("url"))["origin"]
    pages = pages.withColumn("html", F.concat(F.col("html"), F.lit('<script>x="'), o, F.lit("/i/"), F.col("page_id").cast("string"), F.lit('.png"</script>')))
    rows = materialize(PG.elements(pages), "cascade-elements")
    return PG.panel_candidates(rows, pages).select("page_id", "url", "stage")


@query("page_record_r12")
def page_record(t):
    """Chapter records of all pages, with one hop from series pages to their first chapter."""
    out = PR.chapter_records(reader_pages(t.pages), registry(t.spark), SITE_SELECTORS)
    return out["records"].select("page_id", "source_id", "status", "page_type", "panels", "mode", "number")
