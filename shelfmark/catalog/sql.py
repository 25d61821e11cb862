"""Building blocks of the SQL statements used for the independent check."""

from __future__ import annotations

from shelfmark.functions import lexicon as L


def quote(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def lst(values) -> str:
    return f"[{quote(values)}]"


def ws(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def strip_tags(c: str) -> str:
    return ws(f"regexp_replace({c}, '<[^>]+>', ' ', 'g')")


def norm(c: str) -> str:
    return ws(f"translate(replace(lower({ws(c)}), '’', ''''), '-/:,.()', '       ')")


def loose(c: str) -> str:
    for a, b in L.ROMAN_PAIRS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def toks(c: str) -> str:
    return f"regexp_extract_all({norm(c)}, '[a-z0-9]+')"


def alnum(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def listing(c: str) -> str:
    return ws(rf"regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g')")


CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}"


def cjk(c: str) -> str:
    return ws(rf"regexp_replace(lower({strip_tags(c)}), '[^a-z0-9{CJK}\s]', ' ', 'g')")


def qtoks(raw: str) -> str:
    stop = lst(L.QUERY_STOPWORDS)
    noise = lst(sorted({*L.QUERY_STOPWORDS, *L.CHARACTER_HINTS, *L.SCAFFOLD_WORDS}))
    strict = f"list_filter({raw}, lambda w: NOT list_contains({noise}, w))"
    relaxed = f"list_filter({raw}, lambda w: NOT list_contains({stop}, w))"
    return f"CASE WHEN len({strict}) > 0 THEN {strict} WHEN len({relaxed}) > 0 THEN {relaxed} ELSE {raw} END"


def join(c: str, sep: str = " ") -> str:
    return f"array_to_string({c}, '{sep}')"


# Documents as a catalogue: first line = title, the rest = synopsis, `lang` = media type.
CAT = """cat AS (SELECT doc_id, lang AS media_type, source, text, n_chars, split_part(text, chr(10), 1) AS title,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS synopsis
  FROM documents)"""

# The same catalogue with a two-value media type and labelled text (see catalog.views).
LAB = CAT + f""", lab0 AS (SELECT *, CASE WHEN media_type = 'en' THEN 'manga' ELSE 'anime' END AS kind,
  {ws('synopsis')} AS syn, {ws('title')} AS ttl, regexp_extract_all(synopsis, '[A-Za-z]{{4,}}') AS w FROM cat),
lab1 AS (SELECT *, CASE WHEN len(w) >= 4 THEN [w[1] || ', ' || w[2] || ' (Main)', w[3] || ' ' || w[4] || ' (Supporting)']
  WHEN len(w) >= 1 THEN [w[1] || ' (Main)'] ELSE CAST([] AS VARCHAR[]) END AS chars FROM lab0),
lab AS (SELECT *, 'Type: ' || kind || chr(10) || 'Title: ' || ttl || chr(10) || 'Genres: ' || source || ', ' || media_type
  || chr(10) || 'Synopsis: ' || CASE WHEN syn = '' THEN 'No synopsis available.' ELSE syn END || chr(10) || 'Characters:'
  || chr(10) || CASE WHEN len(chars) = 0 THEN 'Unknown' ELSE array_to_string(chars, '; ') END AS payload FROM lab1)"""
