"""Title variants, spin-off tests and search-intent predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicon as L
from .text import (
    clean_page_title, collapse, dedupe_array, let, lit_array, match_norm, root_title, split_fused_suffixes, strip_tags, text_or_empty,
    title_norm, title_norm_apostrophe, title_norm_cjk, trim_ws, words_of,
)


def query_variants(title: Column, aliases: Column | None = None) -> Column:
    """Evaluation variants: each base, then per base lower / compact / before colon / before dash."""
    bases = F.array(collapse(title)) if aliases is None else F.concat(
        F.array(collapse(title)), F.transform(aliases, collapse)
    )
    bases = dedupe_array(bases, title_norm)
    derived = F.flatten(F.transform(bases, lambda b: F.filter(F.array(
        F.lower(b),
        collapse(F.regexp_replace(b, "[^A-Za-z0-9 ]+", " ")),
        F.when(F.contains(b, F.lit(":")), collapse(F.substring_index(b, ":", 1))),
        F.when(F.contains(b, F.lit("-")), collapse(F.substring_index(b, "-", 1))),
    ), lambda v: v.isNotNull())))
    return dedupe_array(F.concat(bases, derived), title_norm)


def latin_readable(c: Column, clean=collapse) -> Column:
    return let(clean(c), lambda cleaned: (
        (F.length(cleaned) >= 2)
        & ~F.regexp_like(cleaned, F.lit(f"[{L.CJK_CLASS}{L.ARABIC_CLASS}]"))
        & F.regexp_like(cleaned, F.lit("[a-zA-Z]"))
    ))


def read_now_variants(titles: Column, cap: int = 12) -> Column:
    """Listing-lookup variants of each title, Latin only, distinct by normalised text."""
    def variants(raw: Column) -> Column:
        return F.transform(let(clean_page_title(raw), lambda base: F.array(
            base,
            F.regexp_replace(base, "[^a-zA-Z0-9]+", " "),
            F.regexp_replace(base, r"\s*\([^)]*\)\s*", " "),
            F.element_at(F.split(base, r"\s*[-\x{2013}\x{2014}:|]\s*", 2), 1),
        )), clean_page_title)

    flat = F.filter(F.flatten(F.transform(titles, variants)), lambda v: latin_readable(v, clean_page_title))
    return F.slice(dedupe_array(flat, listing_norm), 1, cap)


def listing_norm(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9\s]", " "))


def listing_search_variants(title: Column) -> Column:
    """Catalogue-search variants: whole, unpunctuated, leading part, before dash, without chapter noise."""
    cleaned = collapse(title)
    stripped = collapse(F.regexp_replace(
        F.regexp_replace(cleaned, r"[\(\)\[\]\{\}:|]", " "), r"[\x{2013}\x{2014}\-_/]+", " "
    ))
    leading = F.trim(F.element_at(F.split(cleaned, r"[\-:|\(\[]", 2), 1))
    before_dash = F.when(F.contains(cleaned, F.lit(" - ")), F.trim(F.substring_index(cleaned, " - ", 1)))
    quiet = cleaned
    for step in (
        r"(?i)\b(chapter|chap|ch|episode|ep)\b.*$", r"(?i)\bvol(?:ume)?\b.*$", r"\b\d+(?:\.\d+)?\b.*$", r"[\s\-_:|]+$",
    ):
        quiet = F.regexp_replace(quiet, step, "")
    values = F.array(cleaned, stripped, leading, before_dash, F.trim(quiet))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def strip_chapter_noise(c: Column) -> Column:
    out = collapse(c)
    for step in (
        r"(?i)^(?:chapter|chap|ch\.?|episode|ep\.?)\s*[-#: ]?\d+(?:\.\d+)?\s*[-\x{2013}\x{2014}:|]\s*",
        r"(?i)\s*[-\x{2013}\x{2014}:|]\s*(?:chapter|chap|ch\.?|episode|ep\.?)\s*[-#: ]?\d+(?:\.\d+)?.*$",
        r"(?i)\b(?:chapter|chap|ch\.?|episode|ep\.?)\s*[-#: ]?\d+(?:\.\d+)?.*$",
    ):
        out = F.regexp_replace(out, step, "")
    return trim_ws(out)


def noise_free_variants(series: Column, chapter: Column, host: Column) -> Column:
    """Chapter-noise-free variants of series and chapter titles, plus the first host label."""
    def leading(v: Column) -> Column:
        return F.trim(F.element_at(F.split(v, r"[-\x{2013}\x{2014}:|(\[\\]", 2), 1))

    a, b = strip_chapter_noise(series), strip_chapter_noise(chapter)
    label = F.trim(F.regexp_replace(
        F.element_at(F.split(F.regexp_replace(text_or_empty(host), r"(?i)^www\.", ""), r"\.", 2), 1), "[-_]+", " "
    ))
    generic = F.regexp_like(label, F.lit(r"(?i)^(read|manga|manhwa|chapter|chapters)$"))
    values = F.array(a, leading(a), b, leading(b), F.when(~generic, label))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.length(v) >= 2)))


def is_spinoff_title(title: Column, whole_tokens: bool = False) -> Column:
    """Marker inside the normalised title: as a substring, or as a whole token on request."""
    norm = match_norm(title)
    if whole_tokens:
        return F.arrays_overlap(F.split(norm, " "), lit_array(L.SPINOFF_MARKERS))
    return F.regexp_like(norm, F.lit("|".join(L.SPINOFF_MARKERS)))


def mentions_spinoff(query_tokens: Column) -> Column:
    return F.arrays_overlap(query_tokens, lit_array(L.SPINOFF_MARKERS))


def looks_like_title(query: Column) -> Column:
    c = strip_tags(query)
    return (
        F.when(c == "", False)
        .when(F.regexp_like(c, F.lit(f"[{L.CJK_CLASS}]")), True)
        .when(F.size(words_of(c)) > 6, False)
        .otherwise(~F.regexp_like(c, F.lit(L.PLOT_WORDS_RE)))
    )


def looks_like_exact_title(query: Column) -> Column:
    c = collapse(query)
    n = F.size(F.regexp_extract_all(c, F.lit(r"(?i)[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0)))
    vague = F.regexp_like(F.lower(c), F.lit("|".join(L.VAGUE_SIGNALS)))
    return n.between(1, 8) & ~vague


def trailing_media_type(query: Column) -> Column:
    """struct(query, media_type): a final media word becomes a filter unless it is the whole query."""
    pattern = r"(?i)(?:^|\s)(anime|manga|manhwa|manhua)\s*$"

    def parts(c: Column) -> Column:
        word = F.lower(F.regexp_extract(c, pattern, 1))
        rest = F.trim(F.regexp_replace(c, pattern, ""))
        hit = (word != "") & (rest != "")
        return F.struct(
            F.when(hit, rest).otherwise(c).alias("query"),
            F.when(hit, F.when(word == "anime", "anime").otherwise("manga")).alias("media_type"),
        )

    return let(strip_tags(query), parts)


def is_semantic_clue(c: Column) -> Column:
    low = F.lower(collapse(c))
    return ~F.startswith(low, F.lit("no synopsis available")) & let(
        F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0)),
        lambda toks: (F.size(toks) >= 6) & (F.size(F.array_distinct(toks)) >= 4),
    )


def synopsis_clue(synopsis: Column, title: Column) -> Column:
    """First 28 words of the synopsis without the longer title words; unmodified when too little is left."""
    long_tokens = F.slice(F.filter(F.split(title_norm(title), " "), lambda t: F.length(t) >= 5), 1, 6)

    def clue(source: Column) -> Column:
        def without(toks: Column) -> Column:
            pattern = F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(toks, "|"), F.lit(r")\b"))
            return F.when(F.size(toks) > 0, F.regexp_replace(source, pattern, F.lit(""))).otherwise(source)

        def first_words(words: Column) -> Column:
            return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 28), " ")).otherwise(
                F.substring(source, 1, 140)
            )

        stripped = let(words_of(collapse(let(long_tokens, without))), first_words)
        plain = F.array_join(F.slice(words_of(source), 1, 28), " ")
        return F.when(source == "", "").otherwise(
            let(stripped, lambda s: F.when(is_semantic_clue(s), s).otherwise(plain))
        )

    return let(collapse(synopsis), clue)


def is_specific_variant(variant: Column, canonical: Column) -> Column:
    q, c = title_norm(variant), title_norm(canonical)
    one_word = ~F.contains(q, F.lit(" "))
    return (q != "") & (c != "") & (~one_word | (q == c))


def titles_match(target: Column, result: Column) -> Column:
    """Normalised titles equal, or either contains the other."""
    a, b = title_norm(target), title_norm(result)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def agrees_with_titles(result_title: Column, titles: Column) -> Column:
    """Metadata agreement: equality, containment, or three quarters of the result's tokens."""
    def against(v: Column) -> Column:
        r, toks = v["r"], v["toks"]

        def one(n: Column) -> Column:
            other = F.split(n, " ")
            covered = F.size(F.filter(toks, lambda w: F.array_contains(other, w)))
            return (n != "") & (
                F.contains(n, r) | F.contains(r, n) | ((F.size(toks) >= 2) & (covered / F.size(toks) >= 0.75))
            )

        return F.when(r == "", True).otherwise(F.exists(F.transform(titles, title_norm_apostrophe), one))

    return let(title_norm_apostrophe(result_title), lambda r: let(F.struct(
        r.alias("r"), F.filter(F.split(r, " "), lambda t: F.length(t) >= 2).alias("toks")
    ), against))


def is_relevant(title: Column, query: Column) -> Column:
    """Title contains the query, or at least half of its longer words."""
    t, q = F.lower(text_or_empty(title)), F.lower(text_or_empty(query))
    words = F.filter(F.split(q, r"\s+"), lambda w: F.length(w) > 2)
    found = F.size(F.filter(words, lambda w: F.contains(t, w)))
    return F.contains(t, q) | (F.size(words) == 0) | (found >= F.ceil(F.size(words) / 2))


def is_headline(title: Column) -> Column:
    return F.regexp_like(text_or_empty(title), F.lit(L.HEADLINE_RE))


def root_key(title: Column) -> Column:
    return match_norm(root_title(title))


def lookup_queries(query: Column) -> Column:
    """The query with fused suffixes split, then the query itself; distinct, at most two."""
    values = F.array(split_fused_suffixes(query), strip_tags(query))
    return F.slice(dedupe_array(values, title_norm_cjk), 1, 2)
