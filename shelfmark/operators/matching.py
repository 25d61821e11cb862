"""Record matching on titles: alias index, exact and fuzzy joins, candidate choice, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import lexicon as L, similarity as SIM, text as T, titles as TT
from shelfmark.session import materialize

from . import blocking as B
from .ranking import first_per_key, top_k


def alias_index(entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(media_type, item_id, title, alias, alias_norm, pos): the title first, then typed, then wildcard aliases.

    Aliases stay rows; of those with the same normalised text per entry the
    first stays.
    """
    own = entries.select("media_type", "item_id", "title", F.col("title").alias("alias"),
                         F.struct(F.lit(0).alias("g"), F.lit(0).alias("p")).alias("pos"))
    rows = own
    if aliases is not None:
        a = aliases.select(F.col("media_type").alias("_m"), "item_id", "alias", F.col("pos").cast("int").alias("p"))
        both = entries.select("media_type", "item_id", "title").join(a, "item_id").where(
            (F.col("_m") == F.col("media_type")) | (F.col("_m") == "*")
        )
        rows = own.unionByName(both.select(
            "media_type", "item_id", "title", "alias",
            F.struct(F.when(F.col("_m") == "*", 2).otherwise(1).alias("g"), "p").alias("pos"),
        ))
    normed = rows.withColumn("alias", T.collapse(F.col("alias"))).withColumn("alias_norm", T.match_norm(F.col("alias")))
    return normed.where(F.col("alias_norm") != "").groupBy("media_type", "item_id", "title", "alias_norm").agg(
        F.min_by(F.struct("alias", "pos"), "pos").alias("r")
    ).select("media_type", "item_id", "title", "alias_norm", "r.alias", "r.pos")


def exact_pairs(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (q, c) of normalised strings equal under either key: as is, or loosely romanised."""
    def keyed(df: DataFrame, col: str) -> DataFrame:
        keys = F.array_distinct(F.array(F.col(col), T.loose(F.col(col))))
        return T.exploded(df.select(col), keys, "key")

    return keyed(queries, "q").join(keyed(aliases, "c"), "key").select("q", "c").distinct()


def fuzzy_pairs(queries: DataFrame, aliases: DataFrame, threshold: float = L.TITLE_MATCH) -> DataFrame:
    """(q, c, score) of distinct normalised strings with title similarity of at least `threshold`.

    Without containment, the score needs (threshold - 0.7) / 0.3 of the query
    tokens; with it, a length ratio of (threshold - 0.86) / 0.12. Blocking uses
    both, then the similarity decides.
    """
    threshold = max(0.80, min(0.99, threshold))
    share, ratio = (threshold - 0.70) / 0.30, max(0.0, (threshold - 0.86) / 0.12)
    q = queries.withColumn("tokens", SIM.distinct_tokens(F.col("q")))
    c = aliases.withColumn("tokens", SIM.distinct_tokens(F.col("c")))
    by_token = B.overlap_pairs(q, c, lambda n: F.greatest(F.lit(1), F.ceil(n * share - 1e-9)).cast("int"))
    inside = B.containment_pairs(q, c, min_ratio=ratio)
    pairs = by_token.unionByName(inside).unionByName(exact_pairs(queries, aliases)).distinct()
    toks = pairs.withColumn("qt", SIM.distinct_tokens(F.col("q"))).withColumn("ct", SIM.distinct_tokens(F.col("c")))
    reachable = F.greatest(
        F.greatest(SIM.ratio_bound(F.col("q"), F.col("c")),
                   SIM.ratio_bound(T.loose(F.col("q")), T.loose(F.col("c")))) * 0.60 + SIM.token_part(F.col("qt"), F.col("ct")),
        SIM.containment_floor(F.col("q"), F.col("c")),
        F.when(T.loose(F.col("q")) == T.loose(F.col("c")), 1.0).otherwise(0.0),
    )
    scored = toks.where(reachable >= threshold - 1e-9).withColumn(
        "score", SIM.title_similarity(F.col("q"), F.col("c"), F.col("qt"), F.col("ct"), threshold - 1e-9)
    )
    return scored.where(F.col("score") >= threshold).select("q", "c", "score")


def title_candidates(queries: DataFrame, index: DataFrame, threshold: float = L.TITLE_MATCH, keep: int = 20) -> DataFrame:
    """(query_id, media_type, item_id, title, score): best alias score per query and entry.

    Strings are matched once per distinct pair. Entries that share alias and
    title differ only in their id for every ranking, so of each such group the
    first `keep` ids are enough for a list of `keep` results.
    """
    texts = materialize(queries.select(F.col("query_norm").alias("q")).distinct(), "title-texts")
    # The index is read once; every string of it has a group.
    groups = materialize(
        top_k(index.select("alias_norm", "title", "media_type", "item_id"), ["alias_norm", "title"], ["item_id", "media_type"], keep, "_n")
        .drop("_n").withColumnRenamed("alias_norm", "c"), "title-groups")
    names = materialize(groups.select("c").distinct(), "title-names")
    exact = exact_pairs(texts, names).withColumn("score", F.lit(1.0))
    pairs = materialize(
        exact.unionByName(fuzzy_pairs(texts, names, threshold)).groupBy("q", "c").agg(F.max("score").alias("score")),
        "title-pairs",
    )
    hits = queries.select("query_id", F.col("query_norm").alias("q")).join(pairs, "q").join(groups, "c")
    return hits.groupBy("query_id", "media_type", "item_id").agg(
        F.max("score").alias("score"), F.min("title").alias("title")
    )


def exact_candidates(queries: DataFrame, index: DataFrame, keep: int = 20) -> DataFrame:
    """As `title_candidates`, for exact matches only (score 1)."""
    texts = queries.select(F.col("query_norm").alias("q")).distinct()
    pairs = exact_pairs(texts, index.select(F.col("alias_norm").alias("c")).distinct())
    groups = top_k(index.select("alias_norm", "title", "media_type", "item_id"), ["alias_norm", "title"],
                   ["item_id", "media_type"], keep, "_n").drop("_n").withColumnRenamed("alias_norm", "c")
    hits = queries.select("query_id", F.col("query_norm").alias("q")).join(pairs, "q").join(groups, "c")
    return hits.groupBy("query_id", "media_type", "item_id").agg(F.min("title").alias("title")).withColumn("score", F.lit(1.0))


def accept_title_results(queries: DataFrame, candidates: DataFrame, near: float = L.TITLE_NEAR) -> DataFrame:
    """Drop all candidates of queries whose best score is not near and that read like descriptions.

    Up to 12 tokens are eligible at all; below `near` a description hint or
    four or more tokens reject.
    """
    best = candidates.groupBy("query_id").agg(F.max("score").alias("_best"))
    hint = F.arrays_overlap(F.col("raw_tokens"), T.lit_array(L.TITLE_QUERY_HINTS))
    ok = (F.size("raw_tokens") <= 12) & (
        (F.col("_best") >= near) | (~F.coalesce(hint, F.lit(False)) & (F.size("raw_tokens") < 4))
    )
    kept = queries.join(best, "query_id").where(ok).select("query_id")
    return candidates.join(kept, "query_id", "left_semi")


def ranked_titles(queries: DataFrame, candidates: DataFrame, top_n: int = 20) -> DataFrame:
    """Five-key title order: score; missing query numbers; unasked spin-offs; length difference; title. Id breaks ties."""
    rows = candidates.join(queries.select("query_id", "query_norm", "raw_tokens"), "query_id")
    digits = F.array_distinct(F.filter("raw_tokens", lambda w: F.regexp_like(w, F.lit("^[0-9]+$"))))
    missing = F.size(F.array_except(digits, T.tokens(F.col("title"))))
    unasked = TT.is_spinoff_title(F.col("title")) & ~F.coalesce(TT.mentions_spinoff(F.col("raw_tokens")), F.lit(False))
    keyed = rows.withColumns({
        "_m": missing, "_s": unasked, "_l": F.abs(F.length(T.match_norm(F.col("title"))) - F.length("query_norm")),
        "_t": F.lower("title"),
    })
    order = [F.desc(F.round("score", 9)), F.asc("_m"), F.asc("_s"), F.asc("_l"), F.asc("_t"), F.asc("item_id"), F.asc("media_type")]
    return top_k(keyed, ["query_id"], order, top_n).drop("_m", "_s", "_l", "_t", "query_norm", "raw_tokens")


def external_hits(queries: DataFrame, hits: DataFrame, index: DataFrame, threshold: float = L.TITLE_MATCH - 0.03) -> DataFrame:
    """Index entries named by id in external hits, scored by their best hit title.

    `hits` has query_id, item_id, title (one row per hit title).
    """
    norm = hits.select("query_id", "item_id", T.match_norm(F.col("title")).alias("c")).where(F.col("c") != "")
    pairs = norm.join(queries.select("query_id", F.col("query_norm").alias("q")), "query_id")
    # Hits of ids the index lacks are dropped before any similarity is computed.
    known = index.select("media_type", "item_id").distinct()
    toks = pairs.join(known.select("item_id").distinct(), "item_id", "left_semi")
    distinct = toks.select("q", "c").distinct().withColumn("qt", SIM.distinct_tokens(F.col("q"))).withColumn(
        "ct", SIM.distinct_tokens(F.col("c"))
    )
    scored = distinct.select("q", "c", SIM.title_similarity(
        F.col("q"), F.col("c"), F.col("qt"), F.col("ct"), threshold
    ).alias("score")).where(F.col("score") >= threshold)
    best = toks.join(scored, ["q", "c"]).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return best.join(known, "item_id").select("query_id", "media_type", "item_id", "score")


# --- listing similarity -------------------------------------------------------

def listing_pairs(queries: DataFrame, candidates: DataFrame, at_least: float = L.LISTING_MATCH) -> DataFrame:
    """(q, c, score) of distinct raw strings whose listing similarity reaches `at_least` (0.58 or more)."""
    def prepared(df: DataFrame, col: str) -> DataFrame:
        normed = df.select(col).distinct().withColumn("norm", TT.listing_norm(F.col(col)))
        return normed.withColumn("tokens", F.array_distinct(SIM.listing_tokens(F.col("norm")))).withColumn(
            "phrase", F.array_join(SIM.listing_tokens(F.col("norm")), " ")
        )

    q, c = prepared(queries, "q"), prepared(candidates, "c")
    qn = q.select(F.col("norm").alias("q"), "tokens").distinct()
    cn = c.select(F.col("norm").alias("c"), "tokens").distinct()
    by_token = B.overlap_pairs(qn, cn, lambda n: F.when(n >= 3, 2).otherwise(1))
    whole = B.containment_pairs(qn.select("q"), cn.select("c"))
    phrases = B.containment_pairs(
        q.select(F.col("phrase").alias("qp")).distinct(), c.select(F.col("phrase").alias("cp")).distinct(), "qp", "cp"
    )
    by_phrase = phrases.join(q.select(F.col("norm").alias("q"), F.col("phrase").alias("qp")).distinct(), "qp").join(
        c.select(F.col("norm").alias("c"), F.col("phrase").alias("cp")).distinct(), "cp"
    ).select("q", "c")
    norms = by_token.unionByName(whole).unionByName(by_phrase).distinct()
    scored = norms.withColumn("score", SIM.listing_title_score(F.col("q"), F.col("c"))).where(F.col("score") >= at_least)
    out = scored.select(F.col("q").alias("qn"), F.col("c").alias("cn"), "score")
    return out.join(q.select("q", F.col("norm").alias("qn")), "qn").join(c.select("c", F.col("norm").alias("cn")), "cn").select("q", "c", "score")


def best_listing_match(variants: DataFrame, candidates: DataFrame, at_least: float = L.LISTING_MATCH) -> DataFrame:
    """Best candidate over all title variants of a query.

    `variants`: query_id, pos, variant. `candidates`: url, title, pos. Ties go
    to the earlier variant, then the earlier candidate.
    """
    pairs = listing_pairs(variants.select(F.col("variant").alias("q")), candidates.select(F.col("title").alias("c")), at_least)
    lead = first_per_key(candidates.select("title", "url", F.col("pos").alias("c_pos")), ["title"], ["c_pos", "url"])
    hits = variants.join(pairs, F.col("variant") == F.col("q")).join(lead, F.col("title") == F.col("c"))
    return first_per_key(hits, ["query_id"], [F.desc(F.round("score", 9)), "pos", "c_pos", "url"]).select(
        "query_id", "variant", "title", "url", "score"
    )


def strict_direct_matches(variants: DataFrame, candidates: DataFrame, cap: int = 12,
                          at_least: float = L.LISTING_MATCH) -> DataFrame:
    """First cut of a direct search: best score per candidate URL, `cap` URLs per query.

    Candidates with one title tie on score, so the first `cap` of each title suffice.
    """
    pairs = listing_pairs(variants.select(F.col("variant").alias("q")), candidates.select(F.col("title").alias("c")), at_least)
    lead = top_k(candidates.select("title", "url", F.col("pos").alias("c_pos")), ["title"], ["c_pos", "url"], cap, "_n").drop("_n")
    hits = variants.join(pairs, F.col("variant") == F.col("q")).join(lead, F.col("title") == F.col("c"))
    best = hits.groupBy("query_id", "url").agg(
        F.max("score").alias("score"), F.min("c_pos").alias("c_pos"), F.min("title").alias("title")
    )
    return top_k(best, ["query_id"], [F.desc(F.round("score", 9)), "c_pos", "url"], cap)


def relevant_results(matches: DataFrame, queries: DataFrame, cap: int = 6) -> DataFrame:
    """Second cut: relevant, not a headline, distinct by punctuation-free title, `cap` per query."""
    rows = matches.withColumnRenamed("rank", "_r").join(queries.select("query_id", "query"), "query_id").where(
        TT.is_relevant(F.col("title"), F.col("query")) & ~TT.is_headline(F.col("title"))
    ).withColumn("_k", F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""))
    return top_k(first_per_key(rows, ["query_id", "_k"], ["_r"]), ["query_id"], ["_r"], cap).drop("_k", "_r", "query")


def ordinal_candidates(queries: DataFrame, catalogue: DataFrame, at_most: float = 2.5, keep: int = 20) -> DataFrame:
    """(query_id, item_id, score, chapters) of entries whose ordinal title score is at most `at_most`.

    `catalogue`: item_id, title, chapters. Of entries with one title the first
    `keep` stay, enough to rank `keep` results per query. Scores are computed once per distinct
    pair of strings; equality, prefixes and containment come from grams, token
    cover from the rarest token of the smaller side.
    """
    def prepared(df: DataFrame, col: str, name: str) -> DataFrame:
        rows = df.select(F.lower(T.collapse(F.col(col))).alias(name)).distinct().where(F.col(name) != "")
        listed = rows.withColumn("_l", F.filter(F.split(name, r"\s+"), lambda w: F.length(w) >= 3))
        return listed.withColumn("tokens", F.array_distinct("_l"))

    q, c = prepared(queries, "query", "q"), prepared(catalogue, "title", "c")
    repeated = q.where(F.size("_l") > F.size("tokens"))
    pairs = (
        B.containment_pairs(q, c).unionByName(B.subset_pairs(q, c))
        .unionByName(B.overlap_pairs(repeated, c, lambda n: F.lit(1))).distinct()
    )
    scored = pairs.withColumn("score", SIM.ordinal_title_score(F.col("q"), F.array("c"))).where(F.col("score") <= at_most)
    entries = catalogue.withColumn("c", F.lower(T.collapse(F.col("title"))))
    # For a query, entries with one title differ only by chapter count and id.
    lead = top_k(entries.select("c", "item_id", "chapters"), ["c"],
                 [F.desc(F.coalesce("chapters", F.lit(0))), "item_id"], keep, "_n").drop("_n")
    wanted = queries.select("query_id", F.lower(T.collapse(F.col("query"))).alias("q"))
    return wanted.join(scored, "q").join(lead, "c").select("query_id", "item_id", "score", "chapters")


def ranked_candidates(candidates: DataFrame, k: int = 20) -> DataFrame:
    """Score ascending, then larger chapter count."""
    return top_k(candidates, ["query_id"], ["score", F.desc(F.coalesce("chapters", F.lit(0))), "item_id"], k)


def resolver_ranking(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Order fetched candidates by resolver score, stable: (query_id, rank, item_id, title, score)."""
    scored = candidates.withColumn("score", SIM.resolver_title_score(T.title_norm(F.col("query")), T.title_norm(F.col("title"))))
    return top_k(scored, ["query_id"], [F.asc_nulls_last("score"), "pos"], k).select("query_id", "rank", "item_id", "title", "score")


# --- alias lookup similarity --------------------------------------------------

def alias_lookup_pairs(queries: DataFrame, titles: DataFrame, at_least: float = L.ALIAS_CANDIDATE_MIN) -> DataFrame:
    """(q, c, score) of distinct `title_norm_cjk` strings whose typo-tolerant similarity reaches `at_least` (0.72)."""
    def prepared(df: DataFrame, col: str) -> DataFrame:
        rows = df.select(col).distinct().where(F.col(col) != "").withColumn(
            "_l", F.filter(F.split(col, " "), lambda w: F.length(w) >= 2)
        ).withColumn("tokens", F.array_distinct("_l"))
        # Repeated tokens count more than once in the fuzzy score, so one shared token may then be enough.
        return rows.withColumn("need", F.when(F.size("_l") > F.size("tokens"), 1)).drop("_l")

    q, c = materialize(prepared(queries, "q"), "lookup-queries"), materialize(prepared(titles, "c"), "lookup-titles")
    vocabulary = T.exploded(c.select("tokens"), F.col("tokens"), "token").select("token").distinct()
    wanted = T.exploded(q.select("tokens"), F.col("tokens"), "q_token").select("q_token").distinct()
    relation = materialize(B.typo_relation(wanted, vocabulary), "typo-relation")
    by_token = B.overlap_pairs(q, c, lambda n: F.greatest(F.lit(1), F.ceil(n * 0.5)).cast("int"), relation=relation)
    pairs = by_token.unionByName(B.containment_pairs(q, c)).distinct()
    scored = pairs.withColumn("score", SIM.fuzzy_title_score(F.col("q"), F.col("c")))
    return scored.where(F.col("score") >= at_least)


# --- suggestions --------------------------------------------------------------

def alternatives(inputs: DataFrame, catalogue: DataFrame, minimum: int = 80, top: int = 5) -> DataFrame:
    """Catalogue rows of another source whose titles overlap by at least `minimum` percent.

    `inputs`: query_id, title, source. `catalogue`: pos, title, source. Titles
    are compared once per distinct token set, through their rarest tokens.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("tokens", F.array_sort(SIM.suggestion_tokens(F.col("title")))).withColumn(
            "key", F.array_join("tokens", " ")
        )

    base, cat = keyed(inputs), keyed(catalogue)
    need = (minimum - 0.5) / 100.0
    q = base.select(F.col("key").alias("q"), "tokens").distinct()
    c = cat.select(F.col("key").alias("c"), "tokens").distinct()
    pairs = B.overlap_pairs(q, c, lambda n: F.greatest(F.lit(1), F.ceil(n * need - 1e-9)).cast("int"))
    both = pairs.withColumn("qt", F.split("q", " ")).withColumn("ct", F.split("c", " "))
    overlap, union = SIM.set_parts(F.col("qt"), F.col("ct"))
    scored = both.withColumn("confidence", SIM.jaccard_percent(overlap, union)).where(F.col("confidence") >= minimum)
    # The first rows of each token set that any excluded source can leave over.
    per_source = top_k(cat.select(F.col("key").alias("c"), "title", "source", "pos"), ["c", "source"], ["pos"], top, "_s").drop("_s")
    short = top_k(per_source, ["c"], ["pos"], 2 * top, "_n").drop("_n")
    sets = base.select(F.col("key").alias("q"), F.col("source").alias("own")).distinct()
    found = sets.join(scored.select("q", "c", "confidence"), "q").join(short, "c").where(F.col("source") != F.col("own"))
    best = top_k(found, ["q", "own"], [F.desc("confidence"), "pos"], top).select(
        F.col("q").alias("key"), F.col("own").alias("source"), "rank", "title", F.col("source").alias("other_source"), "pos", "confidence"
    )
    return base.select("query_id", "key", "source").join(best, ["key", "source"]).drop("key")


def similar_by_genre(inputs: DataFrame, catalogue: DataFrame, top: int = 6) -> DataFrame:
    """Catalogue rows sharing most genres, the input's own title excluded.

    Works on distinct genre sets: a genre held by a third of the catalogue
    contributes one row per set, and each set offers only its first rows.
    """
    def keyed(df: DataFrame) -> DataFrame:
        genres = F.array_sort(F.array_distinct(F.transform("genres", lambda g: F.lower(g))))
        return df.withColumn("genres", genres).withColumn("key", F.array_join("genres", "\n"))

    base, cat = keyed(inputs), keyed(catalogue)
    per_title = top_k(cat.select(F.col("key").alias("c"), "title", "pos"), ["c", "title"], ["pos"], top, "_t").drop("_t")
    short = top_k(per_title, ["c"], ["pos"], 2 * top, "_n").drop("_n")

    def sets(df: DataFrame, name: str) -> DataFrame:
        return T.exploded(df.select(F.col("key").alias(name), "genres").distinct(), F.col("genres"), "genre").drop("genres")

    overlap = sets(base, "q").join(sets(cat, "c"), "genre").groupBy("q", "c").agg(F.count("*").alias("overlap"))
    wanted = base.select(F.col("key").alias("q"), F.col("title").alias("own")).distinct()
    found = wanted.join(overlap, "q").join(short, "c").where(F.col("title") != F.col("own"))
    best = top_k(found, ["q", "own"], [F.desc("overlap"), "pos"], top)
    return base.select("query_id", F.col("key").alias("q"), F.col("title").alias("own")).join(best, ["q", "own"]).select(
        "query_id", "rank", "title", "pos", "overlap"
    )


def trending(catalogue: DataFrame, sources: DataFrame, top: int = 6) -> DataFrame:
    """First rows of the catalogue whose source is supported."""
    return catalogue.join(sources.select("source"), "source", "left_semi").orderBy("pos").limit(top)
