"""Web pages: one parsing job, then links, images, metadata and records in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import lexicon as L, text as T, urls as U

from shelfmark.session import spread

from .ranking import top_k
from .selectors import ancestors, matches

_MARKS = "tag string, id string, classes array<string>, attrs map<string,string>"
_STRUCT = "pos: int, tag: string, id: string, classes: array<string>, attrs: map<string,string>"
ELEMENT_SCHEMA = f"page_id long, pos int, {_MARKS}, text string, above array<struct<{_STRUCT}>>"
FAILED = "#failed"  # tag of the one row of a page that could not be parsed
PAGES_AT_ONCE = 64
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_KEPT = {"a", "img", "amp-img", "source", "meta", "title", "h1", "h2", "script", "input", "button", "li", "form", "body"}
_DROPPED = {"noscript", "iframe", "object", "embed"}


class _Elements(HTMLParser):
    """Collects elements with their text and their ancestors, outermost first; `pos` counts all elements of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.texts, self.skip, self.seen = [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED and tag not in _VOID:
            self.skip += 1
        if self.skip:
            return
        attrs = {k: v or "" for k, v in reversed(attrs)}  # the first of repeated attributes counts
        mark = {"pos": self.seen, "tag": tag, "id": attrs.get("id"), "classes": attrs.get("class", "").split(), "attrs": list(attrs.items())}
        self.seen += 1
        row = None
        if tag in _KEPT or mark["classes"] or "id" in attrs:
            row = {**mark, "text": "", "above": [o[1] for o in self.open]}
            self.rows.append(row)
        if tag not in _VOID:
            self.open.append((tag, mark, row, len(self.texts)))

    def handle_endtag(self, tag):
        if tag in _DROPPED and self.skip:
            self.skip -= 1
            return
        if self.skip or not any(o[0] == tag for o in self.open):
            return
        while self.open:
            name, _, row, start = self.open.pop()
            if row is not None:
                row["text"] = "".join(self.texts[start:])
            if name == tag:
                break

    def handle_data(self, data):
        if not self.skip:
            self.texts.append(data)

    def finished(self):
        while self.open:
            _, _, row, start = self.open.pop()
            if row is not None:
                row["text"] = "".join(self.texts[start:])
        return self.rows


def _page_rows(page_id, html: str | None) -> list[dict]:
    parser = _Elements()
    try:
        parser.feed(html or "")
        parser.close()
    except (ValueError, AssertionError) as error:
        failed = {"pos": -1, "tag": FAILED, "id": None, "classes": [], "attrs": [], "text": f"{type(error).__name__}: {error}", "above": []}
        return [{"page_id": page_id, **failed}]
    return [{"page_id": page_id, **r} for r in parser.finished()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string()))]
    above = pa.list_(pa.struct([("pos", pa.int32()), *marks]))
    schema = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), *marks, ("text", pa.string()), ("above", above)])
    for batch in batches:
        for start in range(0, batch.num_rows, PAGES_AT_ONCE):
            part = batch.slice(start, PAGES_AT_ONCE)
            rows = [r for page in part.to_pylist() for r in _page_rows(page["page_id"], page["html"])]
            yield pa.RecordBatch.from_pylist(rows, schema)


def elements(pages: DataFrame) -> DataFrame:
    """One row per relevant element; the only step in which Python sees the html.

    A page whose html the parser rejects gives one row, tag `FAILED`, with the
    error as its text, and none of its elements.
    """
    return spread(pages.select("page_id", "html")).mapInArrow(_parse, ELEMENT_SCHEMA)


def parse_status(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, parsed, error) of every page; a page without elements is parsed."""
    failed = rows.where(F.col("tag") == FAILED).select("page_id", F.col("text").alias("error"))
    return pages.select("page_id").join(failed, "page_id", "left").select("page_id", F.col("error").isNull().alias("parsed"), "error")


def rules(selectors: list[str] | dict[str, list[str]]) -> list[tuple[Column, int]]:
    """(condition, rank) pairs of an ordered selector list, or of one list per value of a `site` column."""
    if isinstance(selectors, dict):
        return [((F.col("site") == site) & matches(s), i) for site, listed in selectors.items() for i, s in enumerate(listed)]
    return [(matches(s), i) for i, s in enumerate(selectors)]


def first_rank(selectors) -> Column:
    """Rank of the first selector that matches the element; null when none does."""
    return F.least(*[F.when(c, F.lit(i)) for c, i in rules(selectors)], F.lit(None).cast("int"))


def text_of() -> Column:
    return T.collapse(F.when(F.col("tag") == "meta", F.col("attrs")["content"]).otherwise(F.col("text")))


def first_values(rows: DataFrame, fields: dict[str, tuple[list[str] | dict[str, list[str]], Column]]) -> DataFrame:
    """One column per field: its first non-blank value, trying selectors in order; the first element of each counts.

    All fields come from one pass over the elements.
    """
    hits = [
        F.when(c, F.struct(F.lit(name).alias("field"), F.lit(i).alias("rank"), value.alias("v")))
        for name, (selectors, value) in fields.items() for c, i in rules(selectors)
    ]
    found = T.exploded(rows.select("page_id", "pos", F.array(*hits).alias("h")), F.filter("h", lambda x: x.isNotNull()), "x")
    per_selector = found.select("page_id", "pos", "x.*").groupBy("page_id", "field", "rank").agg(F.min_by("v", "pos").alias("v"))
    filled = per_selector.where(F.coalesce("v", F.lit("")) != "")
    return filled.groupBy("page_id").agg(*[
        F.min_by(F.when(F.col("field") == name, F.col("v")), F.when(F.col("field") == name, F.col("rank"))).alias(name) for name in fields
    ])


def texts(rows: DataFrame, selectors, cap: int, name: str) -> DataFrame:
    """(page_id, name array): distinct texts in selector then page order, at most `cap`."""
    found = rows.select("page_id", "pos", text_of().alias("v"), first_rank(selectors).alias("_s")).where(
        F.col("_s").isNotNull() & (F.col("v") != ""))
    distinct = found.groupBy("page_id", "v").agg(F.min(F.struct("_s", "pos")).alias("o"))
    kept = top_k(distinct, ["page_id"], ["o"], cap, "_n")
    return kept.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "v"))), lambda e: e["v"]).alias(name))


# Generic selectors (fixed values).
LINK_SELECTORS = [
    ".chapters a", ".chapter-list a", ".wp-manga-chapter a", ".row-content-chapter a", "#_listUl a", ".episode_lst a",
    "a[href*='/chapter']", "a[href*='/c']", "a[href*='/episode']",
]
IMAGE_SELECTORS = [
    "#imgs img", ".chapter-content img", ".reading-content img", ".container-chapter-reader img", "#reader img", ".reader img",
    ".viewer img", "article img", "main img",
]
TITLE_SELECTORS = ["meta[property='og:title']", "h1", "h2", "title"]
CHAPTER_TITLE_SELECTORS = [".chapter-heading", ".entry-title", "h1", "title"]
COVER_SELECTORS = ["meta[property='og:image']", ".cover img", ".info-image img", ".summary_image img", "img[alt*='cover' i]"]
GENRE_SELECTORS = ["a[href*='/genre/']", "a[href*='/tag/']", ".genres a", ".genres-content a"]
STATUS_SELECTORS = [".status", ".series-status", ".summary-content"]
READER_CONTAINERS = ["#imgs", "#reader", ".reading-content", ".chapter-content", ".container-chapter-reader", "main"]


def any_of(selectors: list[str]) -> Column:
    out = F.lit(False)
    for s in selectors:
        out = out | matches(s)
    return out


def _last_per_url(found: DataFrame) -> DataFrame:
    """(page_id, url, number, title, pos) of (page_id, at, url, title): the last entry per URL at its first place."""
    merged = found.groupBy("page_id", "url").agg(F.max_by("title", "at").alias("title"), F.min("at").alias("pos"))
    return merged.select("page_id", "url", U.inferred_number(F.col("title"), F.col("url")).alias("number"),
                         F.nullif(F.col("title"), F.lit("")).alias("title"), "pos")


def grid_chapters(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapter lists laid out as a grid: links in the grid, the chosen chapter, the list below, then full lists.

    An element may stand in several of these; each is an entry of its own.
    """
    base = pages.select("page_id", F.col("url").alias("base"))
    full = F.regexp_like("base", F.lit(L.FULL_LIST_URL_RE))
    stages = F.array(
        F.when(matches(f"{L.GRID_SELECTOR} a[href]"), 0), F.when(matches(f"{L.GRID_SELECTOR} button#selected_chapter"), 1),
        F.when(matches("#chapter-list a[href*='/chapters/']"), 2), F.when(matches("a[href*='/chapters/']"), 3),
    )
    staged = T.exploded(
        rows.where(F.col("tag").isin("a", "button")).select(
            "page_id", "pos", U.clean_chapter_label(F.col("text")).alias("title"), F.col("attrs")["href"].alias("href"), stages.alias("_s")
        ), F.array_compact("_s"), "stage").join(base, "page_id").where((F.col("stage") < 3) | full)

    def accepted(u: Column) -> Column:
        return F.when(u.isNotNull() & F.regexp_like(u, F.lit(L.CHAPTERS_PATH_RE)), F.array(u))

    chosen = staged.where("stage = 1 AND title != ''").withColumn("url", F.col("base"))
    linked = T.exploded(staged.where("stage != 1"), T.let(U.absolute(F.col("base"), F.col("href")), accepted), "url")
    return _last_per_url(linked.unionByName(chosen).select("page_id", "url", "title", F.struct("stage", "pos").alias("at")))


def ordered_chapters(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapter lists marked up as ordered lists: the first link of each item, labelled by its title span if it has one."""
    base = pages.select("page_id", F.col("url").alias("base"))
    in_item = T.exploded(rows.where(matches("a[href]")), ancestors(L.ITEM_SELECTOR), "item")
    links = in_item.groupBy("page_id", "item").agg(F.min_by(F.struct("pos", F.col("attrs")["href"].alias("href"), "text"), "pos").alias("a"))
    spans = T.exploded(rows.where(matches(L.ITEM_TITLE_SELECTOR)), ancestors("a[href]"), "link")
    named = spans.groupBy("page_id", "link").agg(F.min_by("text", "pos").alias("span"))
    joined = links.select("page_id", "item", "a.*").withColumn("link", F.col("pos")).join(named, ["page_id", "link"], "left").join(base, "page_id")
    own, short = U.clean_chapter_label(F.col("text")), U.clean_chapter_label(F.coalesce("span", F.lit("")))
    found = joined.select("page_id", F.col("item").alias("at"), U.absolute(F.col("base"), F.col("href")).alias("url"),
                          F.coalesce(F.nullif(short, F.lit("")), own).alias("title"))
    return _last_per_url(found.where(F.col("url").isNotNull()))


def chapter_links(rows: DataFrame, pages: DataFrame, selectors=None) -> DataFrame:
    """(page_id, url, number, title, pos): chapter links of each page, the last entry per URL at its first place.

    Same host and series, no taxonomy paths, and a chapter word, a number or a
    previous / next hint. Preview links of some hosts need not name the series.
    Host and series of the page are computed once per page, a link is resolved
    once and judged in the same expression.
    """
    listed = rules(selectors or LINK_SELECTORS)
    base = pages.select("page_id", F.col("url").alias("base"), U.normal_host(F.col("url")).alias("b_host"), U.series_key(F.col("url")).alias("b_key"))
    first = F.least(*[F.when(c, F.lit(i)) for c, i in listed], F.lit(None).cast("int"))
    last = F.greatest(*[F.when(c, F.lit(i)) for c, i in listed], F.lit(None).cast("int"))
    a = rows.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).select(
        "page_id", "pos", first.alias("_f"), last.alias("_l"), F.col("attrs")["href"].alias("href"),
        T.collapse(F.col("text")).alias("label"), F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))).alias("rel"),
    ).where(F.col("_f").isNotNull())
    hinted = (
        F.regexp_like("label", F.lit(r"(?i)chapter|ch\.?|episode|ep\.?|\d|\b(prev(?:ious)?|next)\b"))
        | F.regexp_like("rel", F.lit(r"\b(prev|next)\b"))
    )

    def accepted(u: Column) -> Column:
        preview = F.regexp_like("b_host", F.lit(L.PREVIEW_HOST_RE)) & F.regexp_like(u, F.lit(L.PREVIEW_PATH_RE))
        ok = (
            u.isNotNull() & (U.normal_host(u) == F.col("b_host")) & (preview | F.coalesce(U.series_key(u) == F.col("b_key"), F.lit(False)))
            & ~F.regexp_like(u, F.lit(L.TAXONOMY_PATH_RE))
            & (hinted | F.regexp_like(u, F.lit(r"(?i)chapter[-_/ ]?\d|episode[-_/ ]?\d|/c(?:h(?:apter)?)?[-_/ ]?\d+")))
        )
        return F.when(ok, F.array(u))

    kept = T.exploded(a.join(base, "page_id"), T.let(U.absolute(F.col("base"), F.col("href")), accepted), "url")
    merged = kept.groupBy("page_id", "url").agg(
        F.max_by("label", F.struct("_l", "pos")).alias("title"), F.min(F.struct("_f", "pos")).alias("pos")
    )
    return merged.select("page_id", "url", U.inferred_number(F.col("title"), F.col("url")).alias("number"),
                         F.nullif(F.col("title"), F.lit("")).alias("title"), "pos")


def _image_sources() -> Column:
    """Candidate references of an image element: seven attributes in order, srcset lists split."""
    def of(name: str) -> Column:
        raw = F.col("attrs")[name]
        if "srcset" not in name:
            return F.when(F.coalesce(raw, F.lit("")) != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
        parts = F.transform(F.split(raw, ","), lambda s: F.element_at(F.split(T.trim_ws(s), r"\s+"), 1))
        return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in L.IMAGE_ATTRIBUTES])


def images(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, width, height): the first content-image reference of every image element."""
    base = pages.select("page_id", F.col("url").alias("base"))
    imgs = rows.where(F.col("tag").isin("img", "amp-img", "source")).select("*", _image_sources().alias("_srcs"))
    refs = T.exploded(imgs, F.col("_srcs"), "ref", "i").join(base, "page_id")

    def accepted(u: Column) -> Column:
        return F.when(u.isNotNull() & ~F.startswith(u, F.lit("data:")) & U.is_content_image(u), F.array(u))

    found = T.exploded(refs, T.let(U.absolute(F.col("base"), F.col("ref")), accepted), "url")

    def size(name: str) -> Column:
        n = F.nullif(F.regexp_extract(F.coalesce(F.col("attrs")[name], F.lit("")), r"^\s*(\d+)", 1), F.lit("")).try_cast("int")
        return F.when(n > 0, n)

    return found.groupBy("page_id", "pos").agg(F.min_by(F.struct(
        "url", size("width").alias("width"), size("height").alias("height"), any_of(IMAGE_SELECTORS).alias("in_reader")
    ), "i").alias("r")).select("page_id", "pos", "r.*")


def script_images(html: Column) -> Column:
    """Image URLs inside scripts, plain first, then slash-escaped ones unescaped."""
    plain = F.regexp_extract_all(html, F.lit(L.SCRIPT_IMAGE_RE), F.lit(0))
    escaped = F.transform(F.regexp_extract_all(html, F.lit(L.SCRIPT_ESCAPED_IMAGE_RE), F.lit(0)),
                          lambda v: F.replace(v, F.lit("\\/"), F.lit("/")))
    return F.concat(plain, escaped)


def panel_candidates(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, url, width, height, stage, pos): images by stages, each used only while fewer than two URLs are known.

    Stages: reader selectors, all images, metadata images, script URLs.
    """
    base = pages.select("page_id", F.col("url").alias("base"))
    found = images(rows, pages)
    meta = rows.where(matches("meta[property='og:image']") | matches("meta[name='twitter:image']") | matches("meta[itemprop='image']"))
    meta = meta.join(base, "page_id").select("page_id", "pos", U.absolute(F.col("base"), F.coalesce(F.col("attrs")["content"], F.col("attrs")["src"])).alias("url"))
    script = T.exploded(rows.where("tag = 'script'").select("page_id", "pos", "text"), script_images(F.col("text")), "url", "k").select(
        "page_id", (F.col("pos") * 10_000 + F.col("k")).alias("pos"), "url")
    empty = F.lit(None).cast("int")
    staged = (
        found.where("in_reader").select("page_id", "pos", "url", "width", "height", F.lit(1).alias("stage"))
        .unionByName(found.select("page_id", "pos", "url", "width", "height", F.lit(2).alias("stage")))
        .unionByName(meta.where(F.col("url").isNotNull() & U.is_content_image(F.col("url"))).select(
            "page_id", "pos", "url", empty.alias("width"), empty.alias("height"), F.lit(3).alias("stage")))
        .unionByName(script.where(U.is_content_image(F.col("url"))).select(
            "page_id", "pos", "url", empty.alias("width"), empty.alias("height"), F.lit(4).alias("stage")))
    )
    return cascade(staged)


def cascade(staged: DataFrame) -> DataFrame:
    """Keep a stage only where earlier stages found fewer than two distinct URLs; first place, last entry per URL.

    The counts per page and stage are an aggregate joined back, so a page with
    very many images is not gathered.
    """
    first = staged.groupBy("page_id", "url").agg(
        F.min("stage").alias("stage"), F.min(F.struct("stage", "pos")).alias("at"),
        F.max_by(F.struct("width", "height"), F.struct("stage", "pos")).alias("size"),
    )
    counts = first.groupBy("page_id").agg(*[
        F.sum(F.when(F.col("stage") < s, 1).otherwise(0)).alias(f"_n{s}") for s in (2, 3, 4)
    ])
    known = F.when(F.col("stage") == 1, 0).when(F.col("stage") == 2, F.col("_n2")).when(F.col("stage") == 3, F.col("_n3")).otherwise(F.col("_n4"))
    return first.join(counts, "page_id").where(known < 2).select(
        "page_id", "url", "size.width", "size.height", "stage", F.col("at.pos").alias("pos"))


def login_wall(status: Column, url: Column, panels: Column, has_form: Column, body: Column, strict: Column) -> Column:
    return (
        status.isin(401, 403) | F.regexp_like(url, F.lit(L.LOGIN_URL_RE)) | (strict & (panels < 2))
        | (has_form & F.regexp_like(body, F.lit(L.GATE_TEXT_RE)) & (panels < 5))
    )


def has_login_form() -> Column:
    """Over elements: an input below a form that asks for a password, e-mail or login."""
    name = F.lower(F.coalesce(F.col("attrs")["name"], F.lit("")))
    return (F.col("tag") == "input") & F.exists("above", lambda a: a["tag"] == "form") & (
        (F.col("attrs")["type"] == "password") | F.contains(name, F.lit("email")) | F.contains(name, F.lit("login"))
    )


def sanitised(html: Column, cap: int | None = None) -> Column:
    """Without noscript, iframe, object and embed elements."""
    out = F.regexp_replace(T.text_or_empty(html), r"(?is)<(noscript|iframe|object)\b[^>]*>.*?</(?:noscript|iframe|object)\s*>", "")
    out = F.regexp_replace(out, r"(?is)</?(?:noscript|iframe|object|embed)\b[^>]*>", "")
    return out if cap is None else F.substring(out, 1, cap)


def site_of(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Pages with the first registry entry (by `rank`) whose domain equals the host or is a parent of it."""
    suffixes = T.exploded(pages.select("page_id", U.domain(F.col("url")).alias("_d")), U.domain_suffixes(F.col("_d")), "domain")
    best = suffixes.join(registry, "domain").groupBy("page_id").agg(
        F.min_by(F.struct("site", "default_mode"), "rank").alias("r")
    )
    return pages.join(best, "page_id", "left").select(*pages.columns, F.col("r.site").alias("site"), F.col("r.default_mode").alias("default_mode"))


def page_metadata(rows: DataFrame, pages: DataFrame, selectors: dict | None = None) -> DataFrame:
    """Title, chapter title, cover, genres and status of each page by ordered selectors."""
    s = {"title": TITLE_SELECTORS, "chapter_title": CHAPTER_TITLE_SELECTORS, "cover": COVER_SELECTORS,
         "genres": GENRE_SELECTORS, "status": STATUS_SELECTORS, **(selectors or {})}
    image = F.coalesce(F.col("attrs")["src"], F.col("attrs")["content"])
    values = first_values(rows, {
        "title": (s["title"], text_of()), "chapter_title": (s["chapter_title"], text_of()), "status": (s["status"], text_of()),
        "_cover": (s["cover"], image),
    })
    out = pages.select("page_id", "url").join(values, "page_id", "left").join(texts(rows, s["genres"], 20, "genres"), "page_id", "left")
    return out.select(
        "page_id", "url", "title", "chapter_title", U.absolute(F.col("url"), F.col("_cover")).alias("cover"),
        F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), T.status_norm(F.col("status")).alias("status"),
    )


def first_series_link(links: DataFrame, pages: DataFrame, is_series: Column) -> DataFrame:
    """(page_id, series_url): the first link of a page that leads to a series page, not back to itself."""
    joined = links.join(pages.select("page_id", F.col("url").alias("_own")), "page_id")
    kept = joined.where((U.comparable(F.col("url")) != U.comparable(F.col("_own"))) & is_series)
    return kept.groupBy("page_id").agg(F.min_by("url", "pos").alias("series_url"))


