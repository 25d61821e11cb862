"""String normalisation and tokens, as column expressions.

Whitespace classes name the Unicode separators explicitly because the JVM's
``\\s`` is ASCII only.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from . import lexicon as L

WS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


def let(value: Column, body) -> Column:
    """Bind an expression that `body` uses several times, so that it is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def exploded(df: DataFrame, values: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per element of `values`, keeping the other columns.

    The outer form with a filter afterwards: for the inner form the optimizer
    adds a size test below the generator, which would compute `values` twice.
    """
    if pos is None:
        rows = df.select("*", F.explode_outer(values).alias(name))
    else:
        rows = df.select("*", F.posexplode_outer(values).alias(pos, name))
    return rows.where(F.col(name).isNotNull())


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Whitespace runs become one space; null becomes empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), WS, " "))


def strip_tags(c: Column) -> Column:
    """Tags become spaces, then whitespace is collapsed."""
    return collapse(F.regexp_replace(text_or_empty(c), L.TAG_RE, " "))


def decode_six_entities(c: Column) -> Column:
    """The six named entities the light cleaner knows, in its order."""
    for entity, char in [
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ]:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@F.pandas_udf(StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """The full HTML entity table, which Spark has no built-in for."""
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) and "&" in v else v)


def clean_html(c: Column, full_entities: bool = False) -> Column:
    """Decode entities, drop tags and boilerplate phrases, collapse."""
    c = text_or_empty(c)
    has_entity = F.contains(c, F.lit("&"))
    decoded = F.when(has_entity, unescape_entities(F.when(has_entity, c))).otherwise(c) if full_entities else (
        decode_six_entities(c)
    )
    no_tags = F.regexp_replace(decoded, L.TAG_RE, " ")
    return collapse(F.regexp_replace(no_tags, L.BOILERPLATE_RE, " "))


def match_norm(c: Column) -> Column:
    """Lower case, straight apostrophes, light punctuation to spaces."""
    lowered = F.replace(F.lower(collapse(c)), F.lit("’"), F.lit("'"))
    return collapse(F.translate(lowered, "-/:,.()", "       "))


def loose(c: Column) -> Column:
    """Shorten romanised long vowels; each replacement sees the previous one's output."""
    for long_form, short_form in L.ROMAN_PAIRS:
        c = F.replace(c, F.lit(long_form), F.lit(short_form))
    return c


def loose_name(c: Column) -> Column:
    """Loose romanisation of a display name: collapsed and lower-cased first."""
    return collapse(loose(F.lower(collapse(c))))


def alnum_runs(normalised: Column) -> Column:
    return F.regexp_extract_all(normalised, F.lit("[a-z0-9]+"), F.lit(0))


def tokens(c: Column) -> Column:
    """The runs of `match_norm`, which otherwise only puts spaces and quotes in place of what no run holds."""
    return alnum_runs(F.lower(text_or_empty(c)))


def words_of(c: Column) -> Column:
    """Split an already collapsed string; the empty string has no words."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def query_tokens(raw: Column) -> Column:
    """Content tokens of a query, relaxing step by step when nothing is left."""
    stop = lit_array(L.QUERY_STOPWORDS)
    noise = lit_array(sorted({*L.QUERY_STOPWORDS, *L.CHARACTER_HINTS, *L.SCAFFOLD_WORDS}))

    def choose(r: Column) -> Column:
        strict = F.filter(r, lambda t: ~F.array_contains(noise, t))
        relaxed = F.filter(r, lambda t: ~F.array_contains(stop, t))
        return F.when(F.size(strict) > 0, strict).when(F.size(relaxed) > 0, relaxed).otherwise(r)

    return let(raw, choose)


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    def fold(v):
        return unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")

    return s.map(lambda v: fold(v) if isinstance(v, str) else v)


def ascii_fold(c: Column) -> Column:
    """NFKD with everything outside ASCII dropped; pure ASCII never leaves the JVM."""
    c = text_or_empty(c)
    outside = F.regexp_like(c, F.lit(r"[^\x00-\x7F]"))
    return collapse(F.when(outside, _fold(F.when(outside, c))).otherwise(c))


@F.pandas_udf(ArrayType(StringType()))
def fold_array(s: pd.Series) -> pd.Series:
    """NFKD fold of every element of a bounded array."""
    return s.map(lambda vs: None if vs is None else [
        unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii") for v in vs
    ])


def title_norm(c: Column) -> Column:
    """Alphanumeric runs joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "))


def title_norm_cjk(c: Column) -> Column:
    """As `title_norm`, keeping kana, Han and Hangul; tags are stripped first."""
    kept = F.regexp_replace(F.lower(strip_tags(c)), rf"[^a-z0-9{L.CJK_CLASS}\s]", " ")
    return collapse(kept)


def title_norm_apostrophe(c: Column) -> Column:
    """As `title_norm`, joining the letters around an apostrophe."""
    joined = F.regexp_replace(F.lower(collapse(c)), "['’]", "")
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def root_title(c: Column) -> Column:
    """The part of a title before a colon, else before a spaced dash."""
    return let(collapse(c), lambda t: (
        F.when(F.contains(t, F.lit(":")), F.trim(F.substring_index(t, ":", 1)))
        .when(F.contains(t, F.lit(" - ")), F.trim(F.substring_index(t, " - ", 1))).otherwise(t)
    ))


# Ordered removals that reduce a page title to a series name (fixed values).
_PAGE_TITLE_STEPS = [
    r"(?i)\s+cover\s*$",
    r"\s*\|.*$",
    r"(?i)^(?:read|where\s+to\s+read|free\s+reading|free\s+read|every\s+chapter\s+of|all\s+chapters?\s+of|how\s+to\s+read)\s+",
    r"(?i)\s*[-\x{2013}\x{2014}]\s*[\w\s]+scans?\s*$",
    r"(?i)\s*[-\x{2013}\x{2014}]\s*(?:read|free|online|officially\s+licensed|ad\s+free|chapter\s*[\d.]+|vol\.?\s*\d+|manga|manhwa|manhua|comic|scan|scans|raw|official|licensed|era|velvet|asura).*$",
    r"(?i)\s+(?:on|from|at|via)\s+\S+\s*$",
    r"(?i)\s*[\[(](?:volume|vol\.?|color(?:ed)?|colou?red|official|licensed|english|raw|chapter\s*[\d.]+)[^\])]*[\])]",
    r"(?i)\s*(?:chapter|ch\.?|episode|ep\.?|vol\.?)\s*[\d.]+.*$",
    r"(?i)\s+(?:manga|manhwa|manhua|comic)\s*(?:online\s*(?:for\s*free)?)?$",
    r"(?i)\s+online\s*(?:for\s*free)?$",
    r"[,.:;!?\-\x{2013}\x{2014}]+$",
]


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}|{WS}$", "")


def clean_page_title(c: Column) -> Column:
    out = trim_ws(text_or_empty(c))
    for step in _PAGE_TITLE_STEPS:
        out = trim_ws(F.regexp_replace(out, step, ""))
    return out


def split_fused_suffixes(c: Column) -> Column:
    """Detach a known suffix glued to a stem of five or more letters; empty when nothing changed."""
    suffixes = "|".join(L.FUSED_SUFFIXES)

    def split_word(w: Column) -> Column:
        parted = F.regexp_replace(w, rf"(?i)^(.{{5,}}?)({suffixes})$", "$1 $2")
        return F.when(parted != w, F.regexp_replace(parted, r"(?i)e (ui)$", " $1")).otherwise(w)

    def split_all(original: Column) -> Column:
        return let(F.array_join(F.transform(words_of(original), split_word), " "),
                   lambda joined: F.when(joined != original, joined).otherwise(""))

    return let(strip_tags(c), split_all)


def series_title(title: Column, chapter_title: Column | None = None) -> Column:
    """Series name from a page title that may carry chapter text."""
    tail = r"(?i)\s*[,|:\-\x{2013}]\s*(chapter|ch\.?|episode|ep\.?)\s*[-#: ]?\d+(?:\.\d+)?\s*$"

    def choose(v: Column) -> Column:
        cleaned, cut = v["cleaned"], v["cut"]
        out = F.when(cleaned == "", F.lit("Unknown Series")).when(F.length(cut) >= 2, cut)
        lead = F.regexp_extract(cleaned, r"^(.*?)\s+-\s+", 1)
        rest = F.trim(F.regexp_replace(cleaned, r"^.*?\s+-\s+", ""))
        out = out.when(F.regexp_like(lead, F.lit(r"(?i)chapter|ch\.?|episode|ep\.?")) & (rest != ""), rest)
        if chapter_title is not None:
            chapter = v["chapter"]
            remainder = F.trim(F.substr(cleaned, F.length(chapter) + 1))
            out = out.when(
                (chapter != "") & (cleaned != chapter) & F.startswith(cleaned, chapter) & (remainder != ""), remainder
            )
        return out.otherwise(cleaned)

    return let(collapse(title), lambda c: let(F.struct(
        c.alias("cleaned"), F.trim(F.regexp_replace(c, tail, "")).alias("cut"),
        (F.lit("") if chapter_title is None else collapse(chapter_title)).alias("chapter"),
    ), choose))


def history_series_title(series: Column, chapter: Column) -> Column:
    """History variant: only when the series equals the chapter label is its prefix removed."""
    s, ch = trim_ws(text_or_empty(series)), trim_ws(text_or_empty(chapter))
    label = r"(?i)^(?:chapter|chap|ch\.?|episode|ep\.?)\s*[-#: ]?\d+(?:\.\d+)?"
    stripped = trim_ws(F.regexp_replace(s, label + r"\s*[-\x{2013}\x{2014}:|]\s*", ""))
    fixed = F.when(F.regexp_like(s, F.lit(label + r"\b")) & (s == ch) & (stripped != ""), stripped).otherwise(s)
    return F.when(fixed != "", fixed).otherwise(ch)


def status_norm(c: Column, publishing_counts: bool = False) -> Column:
    low = F.lower(text_or_empty(c))
    ongoing = F.contains(low, F.lit("ongoing"))
    if publishing_counts:
        ongoing = ongoing | F.contains(low, F.lit("publishing"))
    done = F.contains(low, F.lit("complete")) | F.contains(low, F.lit("finished"))
    return F.when(ongoing, "ongoing").when(done, "completed").otherwise("unknown")


def first_non_empty(*cols: Column, clean=collapse) -> Column:
    """The first column that is not blank after cleaning, cleaned; null when all are blank."""
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in cols])


def dedupe_array(values: Column, key) -> Column:
    """First-wins distinct of a bounded array by a derived key; blank keys are dropped.

    One fold over (key, value) pairs, so the key of an element is computed once.
    """
    pairs = F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("ks"), none.alias("vs"))

    def step(state: Column, p: Column) -> Column:
        known = (p["k"] == "") | F.array_contains(state["ks"], p["k"])
        return F.when(known, state).otherwise(F.struct(
            F.concat(state["ks"], F.array(p["k"])).alias("ks"), F.concat(state["vs"], F.array(p["v"])).alias("vs")
        ))

    return F.aggregate(pairs, start, step, lambda state: state["vs"])


def safe_number(c: Column) -> Column:
    """Finite double, else null."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(d)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def js_round(c: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(c + F.lit(0.5))

