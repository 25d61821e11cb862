"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicon as L
from .text import let, lit_array, text_or_empty, trim_ws

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*://)(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(\?[^#]*)?(#.*)?$"


_SEP = "\u0001"


def matched(c: Column, pattern: str, n: int) -> Column:
    """The first `n` groups of a pattern that is anchored at both ends, from one match; null where it does not match."""
    def groups(x: Column) -> Column:
        marked = F.regexp_replace(x, pattern, "".join(f"${i + 1}{_SEP}" for i in range(n)))
        # Text that holds the separator itself is matched group by group.
        apart = F.when(F.regexp_like(x, F.lit(pattern)), F.array(*[F.regexp_extract(x, pattern, i + 1) for i in range(n)]))
        return F.when(F.contains(x, F.lit(_SEP)), apart).otherwise(let(F.split(marked, _SEP), lambda g: F.when(F.size(g) > n, g)))

    return let(c, groups)


def parts(url: Column) -> Column:
    """struct(origin, host, path, search) of an absolute URL; null when it is not one."""
    return let(matched(text_or_empty(url), _PARTS, 5), lambda g: F.when(g.isNotNull(), F.struct(
        F.lower(F.concat(g[0], g[1], g[2])).alias("origin"), F.lower(g[1]).alias("host"),
        F.coalesce(F.nullif(g[3], F.lit("")), F.lit("/")).alias("path"), g[4].alias("search"),
    )))


def comparable(url: Column) -> Column:
    """Without fragment; text that is not an absolute URL is unchanged."""
    plain = F.regexp_like(text_or_empty(url), F.lit(r"^[a-z][a-z0-9+.\-]*://[a-z0-9.\-]+(:\d+)?/[^#]*$"))
    rebuilt = let(parts(url), lambda p: F.when(p.isNull(), url).otherwise(F.concat(p["origin"], p["path"], p["search"])))
    return F.when(plain, url).otherwise(rebuilt)


def host(url: Column) -> Column:
    return F.coalesce(parts(url)["host"], F.lit(""))


def normal_host(url: Column) -> Column:
    """Host without a leading www, m, mobile or read label."""
    return F.regexp_replace(host(url), L.HOST_PREFIX_RE, "")


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _without_dots(path: Column) -> Column:
    """Path with its dot segments resolved; a trailing dot segment leaves a trailing slash."""
    def step(kept: Column, s: Column) -> Column:
        return (
            F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
        )

    # The leading empty segment stands for the root and is put back at the end.
    body = F.regexp_replace(F.regexp_replace(path, r"/\.\.?$", "$0/"), "^/", "")
    resolved = F.aggregate(F.split(body, "/"), lit_array([]), step)
    return F.when(F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)")), F.concat(F.lit("/"), F.array_join(resolved, "/"))).otherwise(path)


def absolute(base: Column, ref: Column, reject_data: bool = False) -> Column:
    """Resolved link; null for empty, fragment-only, javascript/about (and data) references."""
    schemes = "javascript|about|data" if reject_data else "javascript|about"

    def resolve(r: Column) -> Column:
        bad = (r == "") | F.startswith(r, F.lit("#")) | F.regexp_like(r, F.lit(rf"(?i)^({schemes}):"))
        ref_path = F.regexp_extract(r, r"^([^?#]*)", 1)
        rest = F.substr(r, F.length(ref_path) + 1)

        def against(p: Column) -> Column:
            folder = F.regexp_extract(p["path"], r"^(.*/)", 1)
            return (
                F.when(F.startswith(r, F.lit("//")), F.concat(F.regexp_extract(p["origin"], "^([a-z][a-z0-9+.\\-]*:)", 1), r))
                .when(F.startswith(r, F.lit("/")), F.concat(p["origin"], _without_dots(ref_path), rest))
                .when(ref_path == "", F.concat(p["origin"], p["path"], r))
                .otherwise(F.concat(p["origin"], _without_dots(F.concat(folder, ref_path)), rest))
            )

        return (
            F.when(bad, F.lit(None).cast("string")).when(F.regexp_like(r, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), r)
            .otherwise(let(parts(base), against))
        )

    return let(trim_ws(text_or_empty(ref)), resolve)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _series_segment(s: Column) -> Column:
    stripped = F.trim(F.regexp_replace(F.regexp_replace(s, L.CHAPTER_SEGMENT_TAIL_RE, ""), "[-_]+$", ""))
    return F.when(stripped != "", stripped).otherwise(s)


def series_key(url: Column) -> Column:
    """Host plus an id-like query parameter, or plus the series part of the path, or the host alone."""
    def build(p: Column) -> Column:
        h = F.regexp_replace(p["host"], L.HOST_PREFIX_RE, "")
        by_param = [
            F.when(
                F.trim(F.regexp_extract(p["search"], rf"[?&]{k}=([^&]*)", 1)) != "",
                F.concat(h, F.lit(f"?{k}="), F.lower(F.trim(F.regexp_extract(p["search"], rf"[?&]{k}=([^&]*)", 1)))),
            ) for k in L.SERIES_QUERY_KEYS
        ]

        def by_path(s: Column) -> Column:
            first, second, third = (F.get(s, F.lit(i)) for i in range(3))
            two = F.concat_ws("/", h, first, _series_segment(second))
            return (
                F.when(second.isNull(), h)
                .when(F.array_contains(lit_array(L.SERIES_ROOTS), first), two)
                .when(third.isNotNull() & (F.length(first) == 2), F.concat_ws("/", two, _series_segment(third)))
                .when(~F.array_contains(lit_array(L.CHAPTER_ROOTS), first), two).otherwise(h)
            )

        return F.coalesce(*by_param, let(F.transform(segments(F.lower(p["path"])), F.lower), by_path))

    return let(parts(url), lambda p: F.when(p.isNotNull() & (p["host"] != ""), build(p)))


def same_series(base: Column, candidate: Column) -> Column:
    return F.coalesce(series_key(base) == series_key(candidate), F.lit(False))


def parent_candidates(url: Column) -> Column:
    """Likely series pages of a chapter URL: one or two segments dropped, or the chapter token cut from the last."""
    def build(p: Column) -> Column:
        def with_segments(s: Column) -> Column:
            n = F.size(s)
            last = F.coalesce(F.get(s, n - 1), F.lit(""))
            cut = F.trim(F.regexp_replace(F.regexp_replace(
                last, r"(?i)^(.*?)(?:chapter|chap|ch|episode|ep)[-_ ]*\d+(?:\.\d+)?", "$1"), "[-_]+$", ""))

            def page(arr: Column) -> Column:
                return F.when(F.size(arr) > 0, F.concat(p["origin"], F.lit("/"), F.array_join(arr, "/"), F.lit("/"))).otherwise(
                    F.concat(p["origin"], F.lit("/")))

            head = F.slice(s, F.lit(1), F.greatest(n - 1, F.lit(0)))
            found = F.array(
                F.when(n > 1, page(head)),
                F.when(n > 2, page(F.slice(s, F.lit(1), F.greatest(n - 2, F.lit(0))))),
                F.when((n > 0) & (cut != "") & (cut != last), page(F.concat(head, F.array(cut)))),
            )
            own = F.concat(p["origin"], p["path"], p["search"])
            return F.array_distinct(F.filter(found, lambda c: c.isNotNull() & (c != own)))

        return let(segments(p["path"]), with_segments)

    return let(parts(url), lambda p: F.when(p.isNull(), lit_array([])).otherwise(build(p)))


def slug_title(slug: Column) -> Column:
    """Readable title of a slug: numeric and short hash tails dropped, separators to spaces."""
    out = F.regexp_replace(text_or_empty(slug), r"\.\d+$", "")
    out = F.regexp_replace(out, r"(?i)[-_][a-z0-9]{4,10}$", "")
    return F.trim(F.regexp_replace(out, "[-_]+", " "))


def series_name(url: Column) -> Column:
    """Title from the second path segment, else the first."""
    s = segments(parts(url)["path"])
    return slug_title(F.coalesce(F.get(s, F.lit(1)), F.get(s, F.lit(0)), F.lit("")))


def is_chapter_url(url: Column) -> Column:
    return F.regexp_like(text_or_empty(url), F.lit(L.CHAPTER_URL_RE))


def is_chapter_text(c: Column) -> Column:
    return F.regexp_like(text_or_empty(c), F.lit(L.CHAPTER_TEXT_RE))


def searched_as_chapter(url: Column) -> Column:
    """Chapter rather than series page, judged by path; anything undecided counts as a chapter."""
    path = parts(url)["path"]
    return (
        F.when(path.isNull(), False).when(F.regexp_like(path, F.lit(L.CHAPTER_PATH_RE)), True)
        .when(F.regexp_like(path, F.lit(L.CHAPTER_SLUG_RE)), True)
        .when(F.regexp_like(path, F.lit(L.SERIES_PATH_RE)), False).otherwise(True)
    )


def domain_suffixes(d: Column) -> Column:
    """The domain and each of its parent domains."""
    labels = F.split(d, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def is_article_path(url: Column) -> Column:
    return F.regexp_like(F.coalesce(parts(url)["path"], F.lit("")), F.lit(L.ARTICLE_PATH_RE))


def is_content_image(url: Column) -> Column:
    u = text_or_empty(url)
    return ~F.regexp_like(u, F.lit(L.IMAGE_BLACKLIST_RE)) & (
        F.regexp_like(u, F.lit(L.IMAGE_EXT_RE)) | F.regexp_like(u, F.lit(L.IMAGE_PATH_RE))
    )


def has_evidence(html: Column, url: Column) -> Column:
    """The URL occurs in the page: raw, without its query string, or by path."""
    h = F.replace(F.replace(text_or_empty(html), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&"))
    u = F.replace(text_or_empty(url), F.lit("&amp;"), F.lit("&"))
    path = F.coalesce(parts(u)["path"], F.lit("/"))
    return let(h, lambda x: F.contains(x, u) | F.contains(x, F.substring_index(u, "?", 1)) | ((path != "/") & F.contains(x, path)))


# --- chapter tokens -----------------------------------------------------------

_KEYED = r"(?i)^(.*(?:chapter|chap|ch|episode|ep|c)[-_ ]*)(\d+(?:\.\d+)?)(.*)$"


def chapter_token(path: Column) -> Column:
    """struct(head, raw, tail) around the last keyword+number of a path, else around its last number; null if none."""
    def token(g: Column) -> Column:
        return F.struct(*[g[i].alias(n) for i, n in enumerate(("head", "raw", "tail"))])

    def plain(numbers: Column) -> Column:
        raw, tail = F.get(numbers, F.size(numbers) - 1), F.regexp_extract(path, r"([^0-9]*)$", 1)
        return F.when(F.size(numbers) > 0, let(tail, lambda t: F.struct(
            F.substr(path, F.lit(1), F.length(path) - F.length(t) - F.length(raw)).alias("head"), raw.alias("raw"), t.alias("tail"))))

    return let(matched(path, _KEYED, 3), lambda g: F.when(g.isNotNull(), token(g)).otherwise(
        let(F.regexp_extract_all(path, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), plain)))


def segment_token(path: Column) -> Column:
    """Reader variant without a keyword: around the first all-numeric segment."""
    pattern = r"^((?:/[^/]*?)*?/)(\d+(?:\.\d+)?)(/.*|)$"
    plain = F.struct(*[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(("head", "raw", "tail"))])
    keyed = r"(?i)^(.*(?:chapter|chap|ch|episode|ep|c)[-_ /]*)(\d+(?:\.\d+)?)(.*)$"
    by_key = F.struct(*[F.regexp_extract(path, keyed, i + 1).alias(n) for i, n in enumerate(("head", "raw", "tail"))])
    return F.when(F.regexp_like(path, F.lit(keyed)), by_key).when(F.regexp_like(path, F.lit(pattern)), plain)


def format_like(template: Column, value: Column) -> Column:
    """A number in the shape of a template: same decimals, same zero padding."""
    def shown(s: Column) -> Column:
        def body(scaled: Column) -> Column:
            whole = F.floor(scaled / s["scale"]).cast("long")
            fraction = F.lpad((scaled - whole * s["scale"].cast("long")).cast("string"), s["decimals"], F.lit("0"))
            text = whole.cast("string")
            padded = F.lpad(text, F.greatest(F.length(text), F.when(s["zeros"] > 0, s["zeros"] + 1).otherwise(0)), F.lit("0"))
            return F.concat(F.when(s["value"] < 0, "-").otherwise(""),
                            F.when(s["decimals"] > 0, F.concat(padded, F.lit("."), fraction)).otherwise(padded))

        return let(F.floor(F.abs(s["value"]) * s["scale"] + 0.5).cast("long"), body)

    # Bound once: nothing shares an expression inside a lambda.
    shape = let(F.length(F.regexp_extract(template, r"\.(\d*)", 1)), lambda d: F.struct(
        d.alias("decimals"), F.pow(F.lit(10.0), d).alias("scale"), F.length(F.regexp_extract(template, "^-?(0+)", 1)).alias("zeros"),
        value.cast("double").alias("value")))
    return let(shape, shown)


def number_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_or_empty(c), L.NUMBER_RE, 0), F.lit("")).try_cast("double")


_PARAM = r"(?i)^([?].*?|[?])([^=&?]*(?:chapter|chap|ch|episode|ep|c)[^=&]*=)([^&]*)(.*)$"


def chapter_frame(url: Column) -> Column:
    """struct(prefix, raw, suffix) around the number of a chapter URL; raw is empty where a chapter-like
    parameter holds no number, the struct null where the URL has neither token nor such a parameter.
    """
    def frame(prefix: Column, raw: Column, suffix: Column) -> Column:
        return F.struct(prefix.alias("prefix"), raw.alias("raw"), suffix.alias("suffix"))

    def build(p: Column) -> Column:
        def in_param(g: Column) -> Column:
            raw = F.regexp_extract(g[2], L.NUMBER_RE, 0)
            head, tail = (F.regexp_extract(g[2], rf"^(.*?){L.NUMBER_RE}(.*)$", i) for i in (1, 2))
            return F.when(g.isNotNull(), frame(F.concat(p["origin"], p["path"], g[0], g[1], head), raw, F.concat(tail, g[3])))

        in_path = let(chapter_token(p["path"]), lambda t: F.when(t.isNotNull(), frame(
            F.concat(p["origin"], t["head"]), t["raw"], F.concat(t["tail"], p["search"]))))
        return F.coalesce(in_path, let(matched(p["search"], _PARAM, 4), in_param))

    return let(parts(url), lambda p: F.when(p.isNotNull(), build(p)))


def filled_frame(frame: Column, number: Column) -> Column:
    """A chapter frame with a number (or, when it holds no number, its text) in place."""
    def shown(n: Column) -> Column:
        return F.when(n.isNotNull() & (frame["raw"] != ""), format_like(frame["raw"], n)).otherwise(F.trim(number))

    return F.when(frame.isNotNull() & (F.trim(number) != ""), F.concat(frame["prefix"], let(number_in(number), shown), frame["suffix"]))


def rendered_chapter(url: Column, number: Column) -> Column:
    """The URL with its chapter token (or chapter-like parameter) replaced by a number; null if it has none."""
    return let(chapter_frame(url), lambda f: filled_frame(f, number))


def rendered_pattern(url: Column, pattern: Column, number: Column) -> Column:
    """A `{chapter}` pattern filled with a number, against the page's origin."""
    filled = F.replace(pattern, F.lit("{chapter}"), F.replace(F.url_encode(F.trim(number)), F.lit("+"), F.lit("%20")))
    origin = parts(url)["origin"]
    return F.when(F.contains(pattern, F.lit("{chapter}")) & (F.trim(number) != ""), F.when(
        F.startswith(filled, F.lit("/")), F.concat(origin, filled)
    ).otherwise(filled))


def chapter_pattern(url: Column) -> Column:
    return let(chapter_token(parts(url)["path"]), lambda t: F.concat(t["head"], F.lit("{chapter}"), t["tail"]))


def adjacent(url: Column, offset: int) -> Column:
    """The neighbouring chapter's URL; null without a token or below zero."""
    def build(p: Column) -> Column:
        def in_path(t: Column) -> Column:
            n = t["raw"].cast("double") + offset
            return F.when(n >= 0, F.concat(p["origin"], t["head"], format_like(t["raw"], n), t["tail"], p["search"]))

        raw = F.regexp_extract(F.regexp_extract(p["search"], _PARAM, 3), r"\d+(?:\.\d+)?", 0)
        n = F.nullif(raw, F.lit("")).cast("double") + offset
        value = F.replace(F.regexp_extract(p["search"], _PARAM, 3), raw, format_like(raw, n))
        in_search = F.when(n >= 0, F.concat(p["origin"], p["path"], F.regexp_extract(p["search"], _PARAM, 1),
                                            F.regexp_extract(p["search"], _PARAM, 2), value, F.regexp_extract(p["search"], _PARAM, 4)))
        return F.coalesce(let(chapter_token(p["path"]), in_path), in_search)

    return let(parts(url), lambda p: F.when(p.isNotNull(), build(p)))


# --- chapter labels -----------------------------------------------------------

def inferred_number(label: Column, url: Column) -> Column:
    """First number of the label (prefix removed) or, for a blank label, of the URL; else the last slug, 64 long."""
    cleaned = F.trim(F.regexp_replace(text_or_empty(label), L.CHAPTER_PREFIX_RE, ""))
    source = F.when(cleaned != "", cleaned).otherwise(url)
    slug = F.coalesce(F.get(F.reverse(segments(url)), F.lit(0)), F.lit("Unknown"))
    return F.coalesce(F.nullif(F.regexp_extract(source, L.NUMBER_RE, 0), F.lit("")), F.substring(slug, 1, 64))


def label_number(label: Column) -> Column:
    return number_in(F.trim(F.regexp_replace(text_or_empty(label), L.CHAPTER_PREFIX_RE, "")))


def is_special(label: Column) -> Column:
    return label_number(label).isNull() | F.regexp_like(text_or_empty(label), F.lit(L.SPECIAL_RE))


def clean_chapter_label(c: Column) -> Column:
    from .text import collapse

    cleaned = collapse(c)
    hit = F.regexp_extract(cleaned, r"(?i)\b(?:chapter|ch\.?|episode|ep\.?)\s*-?\d+(?:\.\d+)?\b", 0)
    return F.when(hit != "", hit).otherwise(cleaned)


def listed_number(href: Column) -> Column:
    """Chapter number of a link by three URL shapes: keyword, id then number, numeric last segment below 10000."""
    explicit = F.regexp_extract(href, r"(?i)(?:chapter|/c|episode)[-_/]?(\d+(?:\.\d+)?)", 1)
    after_id = F.regexp_extract(href, r"(?i)/chapters?/[^/]+/(\d{1,6})(?:[?#]|$)", 1)
    last = F.regexp_extract(F.coalesce(F.get(F.reverse(segments(href)), F.lit(0)), F.lit("")), r"^\s*(-?\d+(?:\.\d+)?)", 1)
    numeric_last = F.nullif(last, F.lit("")).try_cast("double")
    return (
        F.when(explicit != "", explicit.try_cast("double")).when(after_id != "", after_id.try_cast("double"))
        .when(F.regexp_like(href, F.lit(r"(?i)/chapters?/")) & (numeric_last < 10000), numeric_last)
    )
