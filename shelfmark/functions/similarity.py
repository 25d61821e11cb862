"""Title and token similarity scores, as column expressions over two strings.

The scores take normalised strings or token arrays that the caller has already
materialised as columns, so nothing is normalised once per candidate pair.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from . import lexicon as L
from .text import js_round, let, lit_array, loose, title_norm, words_of


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings (argument order matters)."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None
                      for x, y in zip(a, b)], dtype="float64")


def distinct_tokens(norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)))


def set_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of the intersection and the union of two distinct token arrays."""
    overlap = F.size(F.array_intersect(a, b))
    return overlap, F.size(a) + F.size(b) - overlap


def token_part(q_tokens: Column, a_tokens: Column) -> Column:
    """The share of the similarity that comes from shared tokens (0 to 0.45)."""
    overlap, union = set_parts(q_tokens, a_tokens)
    precision = overlap / F.greatest(F.lit(1), F.size(q_tokens))
    recall = overlap / F.greatest(F.lit(1), F.size(a_tokens))
    jaccard = F.when(union > 0, overlap / union).otherwise(0.0)
    subset = (F.size(q_tokens) > 0) & (overlap == F.size(q_tokens))
    return precision * 0.20 + recall * 0.10 + jaccard * 0.10 + F.when(subset, 0.05).otherwise(0.0)


def containment_floor(q: Column, a: Column) -> Column:
    shorter, longer = F.least(F.length(q), F.length(a)), F.greatest(F.length(q), F.length(a))
    return F.when(F.contains(a, q) | F.contains(q, a), 0.86 + 0.12 * (shorter / longer)).otherwise(0.0)


def ratio_bound(q: Column, a: Column) -> Column:
    """Upper bound of the sequence ratio from the lengths alone."""
    return 2.0 * F.least(F.length(q), F.length(a)) / (F.length(q) + F.length(a))


def title_similarity(q: Column, a: Column, q_tokens: Column, a_tokens: Column, at_least: float = 0.0) -> Column:
    """Similarity of two normalised titles, at most 1.

    The sequence ratio is the only part that leaves the JVM. It is evaluated
    only for pairs whose length bound says it can lift the score above both the
    containment floor and `at_least`; every other pair is already decided
    (scores below `at_least` may then be understated, never those above it).
    """
    tokens, floor = token_part(q_tokens, a_tokens), containment_floor(q, a)
    q2, a2 = loose(q), loose(a)
    bound = F.greatest(ratio_bound(q, a), ratio_bound(q2, a2)) * 0.60 + tokens
    needed = (bound > floor) & (bound >= at_least)
    ratio = F.when(needed, F.greatest(
        sequence_ratio(F.when(needed, q), F.when(needed, a)), sequence_ratio(F.when(needed, q2), F.when(needed, a2))
    )).otherwise(0.0)
    score = F.greatest(ratio * 0.60 + tokens, floor)
    return (
        F.when((q == "") | (a == ""), 0.0).when(q == a, 1.0).when(q2 == a2, 0.995)
        .otherwise(F.least(F.lit(1.0), score))
    )


def typo_similarity(a: Column, b: Column) -> Column:
    """1 for equal tokens; for tokens of four or more letters within the typo budget, 1 - distance / longer."""
    longer = F.greatest(F.length(a), F.length(b))
    budget = F.greatest(F.lit(1), F.floor(longer * 0.28)).cast("int")
    distance = F.levenshtein(a, b)
    return (
        F.when(a == b, 1.0)
        .when((F.length(a) < 4) | (F.length(b) < 4) | (F.abs(F.length(a) - F.length(b)) > budget), 0.0)
        .when(distance > budget, 0.0).otherwise(1.0 - distance / longer)
    )


def greedy_token_score(q_tokens: Column, c_tokens: Column) -> Column:
    """Greedy one-to-one matching: each query token takes the best unused candidate scoring at least 0.7."""
    def step(state: Column, token: Column) -> Column:
        scored = F.transform(c_tokens, lambda c, i: F.struct(
            F.when(F.array_contains(state["used"], i), 0.0).otherwise(typo_similarity(token, c)).alias("s"),
            (-i).alias("i"),
        ))
        best = F.array_max(scored)
        hit = best["s"] >= 0.7
        return F.struct(
            (state["total"] + F.when(hit, best["s"]).otherwise(0.0)).alias("total"),
            F.when(hit, F.concat(state["used"], F.array(-best["i"]))).otherwise(state["used"]).alias("used"),
        )

    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("used"))
    total = F.aggregate(q_tokens, start, step)["total"]
    coverage = total / F.size(q_tokens) * F.when(F.size(q_tokens) >= 2, 0.95).otherwise(0.82)
    return F.when((F.size(q_tokens) == 0) | (F.size(c_tokens) == 0), 0.0).otherwise(coverage)


def fuzzy_title_score(q: Column, c: Column) -> Column:
    """Alias-lookup similarity of two `title_norm_cjk` strings."""
    def tokenised(text: Column) -> Column:
        return F.filter(F.split(text, " "), lambda t: F.length(t) >= 2)

    def by_tokens(v: Column) -> Column:
        qt, ct = v["qt"], v["ct"]
        qs, cs = F.array_distinct(qt), F.array_distinct(ct)
        inter = F.size(F.array_intersect(qt, ct))
        dice = 2.0 * inter / (F.size(qs) + F.size(cs))
        return F.when((F.size(qt) == 0) | (F.size(ct) == 0), 0.0).otherwise(
            F.greatest(dice, inter / F.size(qs) * 0.85, greedy_token_score(qt, ct))
        )

    return (
        F.when((q == "") | (c == ""), 0.0).when(q == c, 1.0)
        .when(F.contains(c, q) | F.contains(q, c), 0.88)
        .otherwise(let(F.struct(tokenised(q).alias("qt"), tokenised(c).alias("ct")), by_tokens))
    )


def listing_tokens(norm: Column) -> Column:
    return F.filter(
        F.split(norm, " "), lambda t: (F.length(t) >= 2) & ~F.array_contains(lit_array(L.TITLE_STOPWORDS), t)
    )


def listing_title_score(q: Column, c: Column) -> Column:
    """Listing-search similarity of two `listing_norm` strings (stop words ignored)."""
    zero = F.lit(0.0)

    def counts(v: Column) -> Column:
        return F.struct(
            F.size(F.array_distinct(v["qt"])).alias("nq"), F.size(F.array_distinct(v["ct"])).alias("nc"),
            F.size(F.array_intersect(v["qt"], v["ct"])).alias("inter"),
            F.array_join(v["qt"], " ").alias("qp"), F.array_join(v["ct"], " ").alias("cp"),
        )

    def score(v: Column) -> Column:
        nq, nc, inter, qp, cp = (v[k] for k in ("nq", "nc", "inter", "qp", "cp"))
        best = F.greatest(
            2.0 * inter / (nq + nc),
            inter / nq * 0.7 + inter / nc * 0.3,
            F.when(F.contains(c, q) | F.contains(q, c), 0.82).otherwise(zero),
            F.when((inter == nq) & (nq >= 2), 0.74).otherwise(zero),
            F.when((F.length(qp) >= 8) & F.contains(cp, qp), 1.0)
            .when((F.length(cp) >= 8) & F.contains(qp, cp), 0.86).otherwise(zero),
            F.when((inter >= 3) & (nq >= 3), 0.68).otherwise(zero),
            F.when((inter >= 2) & (nq >= 3) & (nc >= 2), 0.62).otherwise(zero),
        )
        return F.when((nq == 0) | (nc == 0), 0.0).otherwise(F.least(F.lit(1.0), best))

    tokens = F.struct(listing_tokens(q).alias("qt"), listing_tokens(c).alias("ct"))
    return (
        F.when((q == "") | (c == ""), 0.0).when(q == c, 1.0)
        .otherwise(let(tokens, lambda v: let(counts(v), score)))
    )


def ordinal_title_score(q: Column, titles: Column, min_token: int = 3, prefix_both_ways: bool = False) -> Column:
    """0 equal, 1 prefix, 1.5 token cover, 2 containment; null when no title qualifies.

    `min_token=3` with one-way prefixes is the catalogue-count variant;
    `min_token=2` with two-way prefixes is the reader variant.
    """
    qt = F.filter(F.split(q, r"\s+"), lambda t: F.length(t) >= min_token)

    def one(t: Column) -> Column:
        tt = F.filter(F.split(t, r"\s+"), lambda x: F.length(x) >= min_token)
        shared = F.size(F.filter(qt, lambda w: F.array_contains(tt, w)))
        prefix = F.startswith(t, q)
        if prefix_both_ways:
            prefix = prefix | F.startswith(q, t)
        return (
            F.when(t == q, 0.0).when(prefix, 1.0)
            .when((shared > 0) & (shared >= F.least(F.size(qt), F.size(tt))), 1.5)
            .when(F.contains(t, q) | F.contains(q, t), 2.0)
        )

    return F.array_min(F.transform(F.filter(titles, lambda t: t != ""), one))


def resolver_title_score(q: Column, c: Column) -> Column:
    """Resolver variant over `title_norm` strings: 0, 1, 2, then 3 - min(0.4 overlap, 1.8), 10 without overlap."""
    overlap = F.size(F.array_intersect(F.split(q, " "), F.split(c, " ")))
    return (
        F.when((q == "") | (c == ""), F.lit(None).cast("double")).when(q == c, 0.0)
        .when(F.startswith(c, q) | F.startswith(q, c), 1.0)
        .when(F.contains(q, c) | F.contains(c, q), 2.0)
        .when(overlap == 0, 10.0).otherwise(3.0 - F.least(overlap * 0.4, F.lit(1.8)))
    )


def suggestion_tokens(title: Column) -> Column:
    return F.array_distinct(
        F.filter(words_of(title_norm(title)), lambda t: ~F.array_contains(lit_array(L.SUGGESTION_STOPWORDS), t))
    )


def jaccard_percent(overlap: Column, union: Column) -> Column:
    return F.when(union == 0, F.lit(0)).otherwise(js_round(overlap / union * 100)).cast("int")


# --- character queries --------------------------------------------------------

def query_side(query_tokens: Column) -> Column:
    """struct(phrase, own, loose): what matching needs of a query."""
    return F.struct(
        F.array_join(query_tokens, " ").alias("phrase"), F.array_distinct(query_tokens).alias("own"),
        F.array_distinct(F.transform(query_tokens, loose)).alias("loose"),
    )


def alias_side(aliases: Column) -> Column:
    """struct(phrases, own, loose): what matching needs of a row's character aliases."""
    runs = F.array_distinct(F.flatten(F.transform(aliases, lambda a: F.regexp_extract_all(a, F.lit("[a-z0-9]+"), F.lit(0)))))
    return F.struct(aliases.alias("phrases"), runs.alias("own"), F.array_distinct(F.transform(runs, loose)).alias("loose"))


def match_sides(query: Column, alias: Column, snippet_tokens: Column) -> Column:
    """struct(alias_exact, alias_hits) of a `query_side` against an `alias_side` and the row's tokens."""
    def shared(few: Column, many: Column) -> Column:
        return F.size(F.filter(few, lambda z: F.array_contains(many, z)))

    own = query["own"]
    exact = (query["phrase"] != "") & F.array_contains(alias["phrases"], query["phrase"])
    hits = F.greatest(shared(own, alias["own"]), shared(query["loose"], alias["loose"]), shared(own, snippet_tokens))
    return F.struct(exact.alias("alias_exact"), F.when(exact, F.size(own)).otherwise(hits).alias("alias_hits"))


def character_match(query_tokens: Column, aliases: Column, snippet_tokens: Column) -> Column:
    """struct(alias_exact, alias_hits) of a query against one row's character aliases."""
    return match_sides(query_side(query_tokens), alias_side(aliases), snippet_tokens)


def character_boost(exact: Column, hits: Column, required: Column) -> Column:
    return (
        F.when(exact, 0.8).when((required > 0) & (hits >= required), 0.75)
        .when(hits >= 2, 0.28).when(hits == 1, -0.16).otherwise(-0.32)
    )


def is_character_query(query: Column, raw: Column, phrase_known: Column, known_tokens: Column) -> Column:
    """Whole phrase known; or a hint word with almost all other words known; or up to three known words.

    `phrase_known` says whether the normalised query is an alias phrase and
    `known_tokens` holds the query tokens found among alias tokens.
    """
    stop, hints = lit_array(L.QUERY_STOPWORDS), lit_array(L.CHARACTER_HINTS)
    rest = F.filter(raw, lambda t: ~F.array_contains(stop, t) & ~F.array_contains(hints, t))

    def alphabetic(arr: Column) -> Column:
        return F.forall(arr, lambda t: F.regexp_like(t, F.lit("^[a-z]+$")))

    def known(arr: Column) -> Column:
        return F.size(F.filter(arr, lambda t: F.array_contains(known_tokens, t)))

    hinted = (F.size(rest) > 0) & alphabetic(rest) & (known(rest) >= F.greatest(F.lit(1), F.size(rest) - 1))
    short = (F.size(raw) <= 3) & ~F.arrays_overlap(raw, stop) & alphabetic(raw) & (known(raw) == F.size(raw))
    return (
        F.when(F.size(raw) == 0, False).when(phrase_known, True)
        .when(F.arrays_overlap(raw, hints), hinted).otherwise(short)
    )


def blend_weight(query_tokens: Column, is_character: Column) -> Column:
    return (
        F.when(is_character, L.ALPHA_CHARACTER).when(F.size(query_tokens) <= 2, L.ALPHA_SHORT)
        .otherwise(L.ALPHA_DEFAULT)
    )


def blended_score(dense: Column, sparse: Column, alpha: Column) -> Column:
    """Convex blend with the weight clamped to 0..1; a missing side counts as zero."""
    a = F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0))
    return F.coalesce(dense, F.lit(0.0)) * a + F.coalesce(sparse, F.lit(0.0)) * (1.0 - a)
