"""Labelled document text: rendering (P) and parsing (X9-X12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import lexicon as L
from .text import (
    collapse, dedupe_array, fold_array, let, loose_name, match_norm, strip_tags, text_or_empty, trim_ws,
)


def or_sentinel(c: Column, sentinel: str) -> Column:
    return F.coalesce(F.nullif(text_or_empty(c), F.lit("")), F.lit(sentinel))


def _joined(values: Column, sep: str) -> Column:
    return or_sentinel(F.array_join(F.coalesce(values, F.array().cast("array<string>")), sep), L.UNKNOWN)


def base_text(media_type: Column, title: Column, genres: Column, synopsis: Column, characters: Column) -> Column:
    """Base layout: comma-joined genres, semicolon-joined characters, sentinels for empties."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Type: "), media_type), F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Genres: "), _joined(genres, ", ")),
        F.concat(F.lit("Synopsis: "), or_sentinel(synopsis, L.NO_SYNOPSIS)),
        F.lit("Characters:"), _joined(characters, "; "),
    )


def enriched_text(
    media_type: Column, title: Column, genres: Column, synopsis: Column, characters: Column, aliases: Column,
    alias_cap: int = 140,
) -> Column:
    """Base layout plus up to `alias_cap` search aliases; `genres` is already one line."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Type: "), media_type), F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Genres: "), or_sentinel(genres, L.UNKNOWN)),
        F.concat(F.lit("Synopsis: "), or_sentinel(synopsis, L.NO_SYNOPSIS)),
        F.lit("Characters:"), _joined(characters, "; "),
        F.lit("Character Search Aliases:"), _joined(F.slice(aliases, 1, alias_cap), "; "),
    )


def seed_text(title: Column, synopsis: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nSynopsis: "), synopsis)


def delta_text(
    media_type: Column, title: Column, genres: Column, synopsis: Column, characters: Column, cap: int
) -> Column:
    """Delta layout: characters joined by a bar under a label that names the cap."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Type: "), media_type), F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Genres: "), _joined(genres, ", ")),
        F.concat(F.lit("Synopsis: "), or_sentinel(synopsis, L.NO_SYNOPSIS)),
        F.concat(F.lit(f"Characters (max {cap}): "), _joined(characters, " | ")),
    )


def comma_text(title: Column, genres: Column, synopsis: Column, names: Column) -> Column:
    """Comma layout without a type line."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), title), F.concat(F.lit("Genres: "), _joined(genres, ", ")),
        F.concat(F.lit("Synopsis: "), or_sentinel(synopsis, L.NO_SYNOPSIS)),
        F.concat(F.lit("Characters: "), _joined(names, ", ")),
    )


def character_lines(roster: Column, cap: int = 12, with_about: bool = True) -> Column:
    """`Name (Role): about` lines of a roster array; blanks are skipped before the cap applies."""
    named = F.filter(roster, lambda r: collapse(r["name"]) != "")

    def line(r: Column) -> Column:
        head = F.concat(collapse(r["name"]), F.lit(" ("), or_sentinel(collapse(r["role"]), L.UNKNOWN_ROLE), F.lit(")"))
        if not with_about:
            return head
        about = collapse(r["about"])
        return F.when(about != "", F.concat(head, F.lit(": "), about)).otherwise(head)

    return F.transform(F.slice(named, 1, cap), line)


def delta_character_lines(roster: Column, cap: int) -> Column:
    """`Name: bio` lines, the bio falling back from about to role to a sentinel."""
    named = F.filter(roster, lambda r: collapse(r["name"]) != "")
    return F.transform(F.slice(named, 1, cap), lambda r: F.concat(
        collapse(r["name"]), F.lit(": "),
        F.coalesce(F.nullif(collapse(r["about"]), F.lit("")), F.nullif(collapse(r["role"]), F.lit("")), F.lit(L.NO_BIO)),
    ))


def section(
    text: Column, marker: str, stops: list[str] | None = None, allow_stop_at_start: bool = False, trim_first: bool = False
) -> Column:
    """Text after `marker` up to the nearest other label.

    Labels match without regard to case. A stop label directly at the start is
    skipped unless `allow_stop_at_start`; `trim_first` trims the tail before
    looking for stops, which is how the evaluation variant sees one there.
    """
    stops = [s for s in (L.SECTION_LABELS if stops is None else stops)
             if not (allow_stop_at_start and s == marker.lower())]
    first_allowed = 1 if allow_stop_at_start else 2

    def cut(tail: Column) -> Column:
        return let(F.lower(tail), lambda low: let(
            F.array_min(F.filter(
                F.array(*[F.locate(s, low, 1) for s in stops]), lambda at: at >= first_allowed
            )),
            lambda end: trim_ws(F.when(end.isNull(), tail).otherwise(F.substr(tail, F.lit(1), end - 1))),
        ))

    def after_marker(t: Column) -> Column:
        def tail_from(start: Column) -> Column:
            tail = F.substr(t, start + len(marker))
            return F.when(start == 0, "").otherwise(let(trim_ws(tail) if trim_first else tail, cut))

        return let(F.locate(marker.lower(), F.lower(t)), tail_from)

    return let(text_or_empty(text), after_marker)


def text_fields(text: Column) -> Column:
    """struct(type, title, genres, synopsis) from line prefixes, the last such line winning."""
    def field(label: str, default: str) -> Column:
        hits = F.regexp_extract_all(text_or_empty(text), F.lit(rf"(?m)^[ \t]*{label}:(.*)$"), F.lit(1))
        return or_sentinel(collapse(F.get(F.reverse(hits), F.lit(0))), default)

    return F.struct(
        field("Type", "").alias("type"), field("Title", "").alias("title"),
        field("Genres", L.UNKNOWN).alias("genres"), field("Synopsis", L.NO_SYNOPSIS).alias("synopsis"),
    )


def comma_orders(name: Column) -> Column:
    """The name and, for `Last, First`, both plain orders."""
    last, first = collapse(F.substring_index(name, ",", 1)), collapse(F.regexp_extract(name, "^[^,]*,(.*)$", 1))
    both = F.contains(name, F.lit(",")) & (first != "") & (last != "")
    return F.filter(
        F.array(name, F.when(both, F.concat_ws(" ", first, last)), F.when(both, F.concat_ws(" ", last, first))),
        lambda v: v.isNotNull() & (v != ""),
    )


def with_name_aliases(df: DataFrame, names: Column, name: str = "aliases", cap: int | None = None) -> DataFrame:
    """Add spelling variants of each name in a bounded array, distinct ignoring case.

    Per name, in order: each name order plain, folded to ASCII, romanised, and
    both. Folding is a Python function, so it runs on the whole array once,
    between two JVM projections.
    """
    staged = df.withColumn("_o", F.flatten(F.transform(names, lambda n: comma_orders(collapse(n)))))
    staged = staged.withColumn("_f", fold_array(F.col("_o")))
    pairs = F.arrays_zip(F.col("_o").alias("plain"), F.col("_f").alias("folded"))
    expanded = F.flatten(F.transform(pairs, lambda p: F.array(
        p["plain"], collapse(p["folded"]), loose_name(p["plain"]), loose_name(p["folded"])
    )))
    out = dedupe_array(expanded, F.lower)
    return staged.withColumn(name, out if cap is None else F.slice(out, 1, cap)).drop("_o", "_f")


def with_text_aliases(df: DataFrame, text: str, name: str = "aliases", cap: int = 180) -> DataFrame:
    """Add a document's alias list: its alias section, else the expanded names before each parenthesis."""
    staged = (
        df.withColumn("_listed", explicit_aliases(F.col(text)))
        .withColumn("_named", names_before_paren(section(F.col(text), "Characters:")))
    )
    staged = with_name_aliases(staged, F.when(F.size("_listed") > 0, F.array().cast("array<string>"))
                               .otherwise(F.col("_named")), "_expanded", cap)
    return staged.withColumn(
        name, F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(F.col("_expanded"))
    ).drop("_listed", "_named", "_expanded")


def names_before_paren(section_text: Column) -> Column:
    names = F.transform(F.split(section_text, ";"), lambda e: collapse(F.substring_index(e, "(", 1)))
    return F.filter(names, lambda n: (n != "") & (F.lower(n) != "unknown"))


def explicit_aliases(text: Column) -> Column:
    entries = F.transform(F.split(section(text, "Character Search Aliases:"), ";"), collapse)
    return dedupe_array(entries, F.lower)


def service_aliases(text: Column) -> Column:
    """Normalised alias phrases the retrieval side sees in a snippet (both labels, comma flips)."""
    def from_marker(marker: str) -> Column:
        body = section(text, marker, stops=["character search aliases:", "synopsis:", "genres:", "type:", "title:"],
                       trim_first=True)
        return F.flatten(F.transform(names_before_paren(body), comma_orders))

    both = F.concat(from_marker("character search aliases:"), from_marker("characters:"))
    return F.array_distinct(F.filter(F.transform(both, match_norm), lambda a: a != ""))


def metadata_aliases(value: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(collapse(value), ";"), match_norm), lambda a: a != ""))


def eval_aliases(text: Column) -> Column:
    """Unexpanded aliases: the alias section if it has any, else names before the parenthesis."""
    listed = F.filter(
        F.transform(F.split(collapse(section(text, "Character Search Aliases:", trim_first=True)), ";"),
                    lambda e: collapse(F.regexp_replace(e, r"^[A-Za-z ]+:\s*", ""))),
        lambda a: (a != "") & (F.lower(a) != "unknown"),
    )
    named = names_before_paren(collapse(section(text, "Characters:", trim_first=True)))
    return dedupe_array(F.when(F.size(listed) > 0, listed).otherwise(named), F.lower)


# --- snippet fields -----------------------------------------------------------

_SNIPPET_STOPS = ["characters:", "character search aliases:", "genres:", "synopsis:", "type:", "title:"]


def snippet_section(snippet: Column, marker: str) -> Column:
    body = section(strip_tags(snippet), marker, stops=_SNIPPET_STOPS, allow_stop_at_start=True)
    return F.trim(F.regexp_replace(body, r"^[-:|]+", ""))


def synopsis_of(section_text: Column) -> Column:
    return F.when(F.lower(section_text) == "unknown", "").otherwise(section_text)


def genres_of(section_text: Column, cap: int = 8) -> Column:
    kept = F.slice(dedupe_array(F.transform(F.split(section_text, "[;,|]+"), strip_tags), F.lower), 1, cap)
    return F.when(F.lower(section_text).isin("", "unknown"), F.array().cast("array<string>")).otherwise(kept)


def characters_of(section_text: Column, cap: int = 24) -> Column:
    rough = F.split(section_text, "[;|]+")
    parts = F.when(F.size(rough) > 1, rough).otherwise(F.split(section_text, r",\s+"))
    names = F.transform(parts, lambda p: F.trim(F.regexp_replace(strip_tags(p), r"\s*-\s*.*$", "")))
    kept = F.slice(dedupe_array(F.filter(names, lambda n: F.length(n) >= 2), F.lower), 1, cap)
    return F.when(F.lower(section_text).isin("", "unknown", "none"), F.array().cast("array<string>")).otherwise(kept)


def display_type_of(section_text: Column) -> Column:
    return F.nullif(F.trim(F.element_at(F.split(section_text, r"[|;]"), 1)), F.lit(""))


def snippet_media_type(snippet: Column) -> Column:
    low = F.lower(text_or_empty(snippet))
    return F.when(F.contains(low, F.lit("type: manga")), "manga").when(F.contains(low, F.lit("type: anime")), "anime")


# --- citations, ids, links ----------------------------------------------------

def citation(item_id: Column, title: Column, keep_title_when_unknown: bool = False) -> Column:
    unknown = F.concat(F.lit(f"[Source: {L.SOURCE_LABEL} unknown - "), title, F.lit("]")) if keep_title_when_unknown \
        else F.lit(f"[Source: {L.SOURCE_LABEL} unknown - {L.UNKNOWN}]")
    known = F.concat(F.lit(f"[Source: {L.SOURCE_LABEL} "), item_id.cast("string"), F.lit(" - "), title, F.lit("]"))
    return F.when(item_id.isNull(), unknown).otherwise(known)


def citation_list(given: Column, fallback: Column) -> Column:
    c = strip_tags(given)
    return (
        F.when(c == "", F.array(fallback)).when(F.startswith(c, F.lit("[Source:")), F.array(c))
        .otherwise(F.array(fallback, c))
    )


def strip_citations(c: Column) -> Column:
    return F.trim(F.regexp_replace(collapse(c), r"\[Source:[^\]]+\]", ""))


def justification(query: Column, title: Column, cite: Column, reasoning: Column | None = None,
                  status: Column | None = None) -> Column:
    head = F.concat(F.lit("Top match for '"), query, F.lit("' is "), title, F.lit("."))
    note = F.lit("") if status is None else F.when(
        collapse(status) != "", F.concat(F.lit(" Status: "), collapse(status), F.lit("."))
    ).otherwise("")
    why = F.lit("") if reasoning is None else F.when(
        strip_citations(reasoning) != "", F.concat(F.lit(" "), strip_citations(reasoning))
    ).otherwise("")
    return F.concat(head, why, note, F.lit(" "), cite)


def chunk_id(media_type: Column, item_id: Column, index: Column) -> Column:
    return F.format_string("%s-%d-chunk-%03d", media_type, item_id.cast("long"), index.cast("long"))


def delta_chunk_id(item_id: Column, index: Column) -> Column:
    return F.format_string("mal-%d-chunk-%06d", item_id.cast("long"), index.cast("long"))


def content_chunk_id(media_type: Column, item_id: Column, index: Column, text: Column) -> Column:
    """Content-addressed id: 16 hex digits of the SHA-1 of the chunk text."""
    return F.concat_ws("-", F.lower(media_type), item_id.cast("string"), index.cast("string"),
                       F.substring(F.sha1(text), 1, 16))


def percent_encode(c: Column) -> Column:
    """Component encoding: %20 for spaces and the five marks a URI component leaves alone."""
    out = F.url_encode(F.trim(c))
    for coded, plain in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def link_map(title: Column, templates: dict[str, str]) -> Column:
    """map(site, url) from templates with {encoded}, {plus}, {form} or {underscored} slots."""
    slots = {
        "{encoded}": percent_encode(title), "{plus}": F.regexp_replace(F.trim(title), r"\s+", "+"),
        "{form}": F.url_encode(collapse(title)), "{underscored}": F.replace(collapse(title), F.lit(" "), F.lit("_")),
    }
    entries = []
    for site, template in templates.items():
        url = F.lit(template)
        for slot, value in slots.items():
            if slot in template:
                url = F.replace(url, F.lit(slot), value)
        entries += [F.lit(site), url]
    return F.create_map(*entries)


def image_url(images: Column) -> Column:
    """First non-blank of large, default and small for jpg, then for webp."""
    return F.coalesce(*[
        F.nullif(strip_tags(images[fmt][size]), F.lit(""))
        for fmt in ("jpg", "webp") for size in ("large_image_url", "image_url", "small_image_url")
    ])


def candidate_line(position: Column, title: Column, media_type: Column, item_id: Column, score: Column,
                   exact: Column, hits: Column, snippet: Column, is_character: Column) -> Column:
    """One candidate rendered for an external ranker."""
    flag = F.when(exact, "True").otherwise("False")
    body = F.when(is_character, F.substring(collapse(snippet), 1, 240)).otherwise(F.substring(collapse(snippet), 1, 360))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("id="), position.cast("string")), F.concat(F.lit("title="), title),
        F.concat(F.lit("media_type="), F.coalesce(media_type, F.lit("unknown"))),
        F.concat(F.lit("mal_id="), F.coalesce(item_id.cast("string"), F.lit("None"))),
        F.concat(F.lit("score="), F.format_string("%.5f", score)),
        F.concat(F.lit("alias_exact="), flag), F.concat(F.lit("alias_hits="), hits.cast("string")),
        F.concat(F.lit("snippet="), body),
    )
