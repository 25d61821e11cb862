"""JSON helpers: recursive string collection, objects inside free text, flexible coercion."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .text import collapse, dedupe_array, lit_array

# Keys under which alternative titles may nest (fixed values).
ALIAS_KEYS = [
    "title", "title_english", "title_japanese", "title_synonyms", "synonyms", "aliases", "titles", "alternative_titles",
]


def _walk(value, keys):
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for item in value:
            yield from _walk(item, keys)
    elif isinstance(value, dict):
        for key in (value if keys is None else keys):
            if key in value:
                yield from _walk(value[key], keys)


def _strings(s: pd.Series, keys, keep) -> pd.Series:
    def one(v):
        try:
            found = _walk(json.loads(v), keys) if v is not None else ()
        except ValueError:
            return []
        return keep(" ".join(x.split()) for x in found)

    return s.map(one)


@F.pandas_udf(ArrayType(StringType()))
def alias_strings(s: pd.Series) -> pd.Series:
    """Strings below the alias keys at any depth, cleaned, without blanks and the unknown sentinel."""
    return _strings(s, ALIAS_KEYS, lambda vs: [v for v in vs if v and v.lower() != "unknown"])


@F.pandas_udf(ArrayType(StringType()))
def all_strings(s: pd.Series) -> pd.Series:
    """Every string at any depth, cleaned and lower-cased, distinct in first-seen order."""
    return _strings(s, None, lambda vs: list(dict.fromkeys(v.lower() for v in vs if v)))


@F.pandas_udf(ArrayType(StructType().add("name", StringType()).add("web_url", StringType())))
def chapter_objects(s: pd.Series) -> pd.Series:
    """Any nested object that carries both a name and a web_url."""
    def visit(value, out):
        if isinstance(value, list):
            for item in value:
                visit(item, out)
        elif isinstance(value, dict):
            if isinstance(value.get("name"), str) and isinstance(value.get("web_url"), str):
                out.append({"name": value["name"], "web_url": value["web_url"]})
            for item in value.values():
                visit(item, out)
        return out

    def one(v):
        try:
            return visit(json.loads(v), []) if v is not None else []
        except ValueError:
            return []

    return s.map(one)


@F.pandas_udf(StringType())
def _first_object(s: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def one(text):
        at = text.find("{") if isinstance(text, str) else -1
        while at >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
                if isinstance(value, dict):
                    return text[at:end]
            except ValueError:
                pass
            at = text.find("{", at + 1)
        return None

    return s.map(one)


def first_json_object(c: Column) -> Column:
    """Source text of the first brace that starts a decodable JSON object; null if there is none."""
    has_brace = F.contains(c, F.lit("{"))
    return F.when(has_brace, _first_object(F.when(has_brace, c)))


def widest_json_object(c: Column) -> Column:
    """Fenced block content if present, else first to last brace; null unless it parses to an object."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    wide = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    pick = F.when(fenced != "", fenced).otherwise(wide)
    return F.when(F.try_parse_json(pick).isNotNull() & (pick != ""), pick)


def flexible_list(c: Column) -> Column:
    """A JSON list, or text split at newline, comma, semicolon or bar, as a list; null gives an empty list."""
    listed = F.filter(F.from_json(c, "array<string>"), lambda v: v.isNotNull() & (v != ""))
    split = F.filter(F.transform(F.split(c, r"[\n,;|]+"), lambda v: F.trim(v)), lambda v: v != "")
    is_list = F.startswith(F.ltrim(c), F.lit("[")) & F.try_parse_json(c).isNotNull()
    return F.coalesce(F.when(is_list, listed).otherwise(split), lit_array([]))


def enum_or(c: Column, allowed: list[str], default: str) -> Column:
    low = F.lower(F.coalesce(c, F.lit("unknown")))
    return F.when(low.isin(*allowed), low).otherwise(default)


def distinct_strings(c: Column) -> Column:
    return dedupe_array(F.transform(c, collapse), lambda v: v)
