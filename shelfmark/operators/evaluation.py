"""Query suites from a corpus and hit-rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import lexicon as L, text as T, titles as TT

from .ranking import top_k


def alias_frequency(corpus: DataFrame) -> DataFrame:
    """(alias, frequency): number of documents that list the normalised alias."""
    return (
        T.exploded(corpus.select("doc_id", "aliases"), F.col("aliases"), "a")
        .select("doc_id", T.title_norm(F.col("a")).alias("alias")).where(F.col("alias") != "").distinct()
        .groupBy("alias").agg(F.count("*").alias("frequency"))
    )


def with_keyword_alias(corpus: DataFrame, frequency: DataFrame, max_frequency: int = 3) -> DataFrame:
    """Add the keyword alias (multi-word first, then rarest, then longest) and whether it is specific enough.

    A document without aliases uses its title and never qualifies.
    """
    listed = T.exploded(corpus.select("doc_id", "aliases"), F.col("aliases"), "a", "pos").withColumn(
        "alias", T.title_norm(F.col("a"))
    )
    scored = listed.join(frequency, "alias", "left").withColumn("f", F.coalesce("frequency", F.lit(9999)))
    words = F.size(T.words_of(T.collapse(F.col("a"))))
    best = scored.groupBy("doc_id").agg(F.min_by(
        F.struct("a", "f"), F.struct(F.when(words >= 2, 0).otherwise(1), F.col("f"), -F.length("a"), F.col("pos"))
    ).alias("_b"))
    clean = T.collapse(F.col("_b.a"))
    specific = (F.size(T.words_of(clean)) >= 2) & (F.lower(clean) != "unknown") & (F.col("_b.f") <= max_frequency)
    return corpus.join(best, "doc_id", "left").withColumns({
        "keyword": F.coalesce(F.col("_b.a"), F.col("title")), "has_keyword": F.coalesce(specific, F.lit(False)),
    }).drop("_b")


def is_match(target_title: Column, target_id: Column, result_title: Column, result_id: Column) -> Column:
    return F.coalesce(result_id == target_id, F.lit(False)) | TT.titles_match(target_title, result_title)


def render(template: Column, slots: dict[str, Column]) -> Column:
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def expand_templates(seeds: DataFrame, templates: list[str], slots: dict[str, str]) -> DataFrame:
    """Every seed with every template (`template` is its position)."""
    return seeds.select("*", F.posexplode(T.lit_array(templates)).alias("template", "_t")).withColumn(
        "query", render(F.col("_t"), {k: F.col(v) for k, v in slots.items()})
    ).drop("_t")


def build_suite(seeds: DataFrame, n_seeds: int, templates: list[str], target: int, method: str) -> DataFrame:
    """`target` cases: case i takes seed i mod n and template (i div n) mod m; seeds carry `seed_pos` from 0."""
    rounds = F.floor((F.lit(target - 1) - F.col("seed_pos")) / F.lit(n_seeds)).cast("int")
    rows = seeds.where(F.col("seed_pos") < target).select("*", F.explode(F.sequence(F.lit(0), rounds)).alias("round"))
    template = F.element_at(T.lit_array(templates), (F.col("round") % len(templates) + 1).cast("int"))
    i = F.col("seed_pos") + F.col("round") * n_seeds + 1
    return rows.select(
        F.format_string(f"{method}-%s-%03d", F.col("medium"), i.cast("long")).alias("case_id"), "medium",
        F.lit(method).alias("method"),
        render(template, {k: F.col(k) for k in ("title", "descriptor", "keyword")}).alias("query"),
        F.col("title").alias("target"),
    )


def draw(seed: int, *key: Column) -> Column:
    """Order of a reproducible draw: the same rows for the same seed on any cluster."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)


def pick(seed: int, salt: str, options: int, *key: Column) -> Column:
    """A reproducible choice in 0..options-1 from the first seven hex digits of the draw."""
    return F.conv(F.substring(draw(seed, F.lit(salt), *key), 1, 7), 16, 10).cast("long") % options


def sampled(pool: DataFrame, n: int, seed: int, salt: str) -> DataFrame:
    """`n` rows per medium by hash order."""
    return top_k(pool, ["medium"], [draw(seed, F.lit(salt), F.col("doc_id")), F.col("doc_id")], n, "draw")


def preferring_unused(pool: DataFrame, used: DataFrame, n: int) -> DataFrame:
    """Rows of `pool` not in `used`, per medium; where fewer than `n` remain the whole pool counts again."""
    flagged = pool.join(used.select("doc_id").withColumn("_u", F.lit(True)), "doc_id", "left")
    left = flagged.groupBy("medium").agg(F.count(F.when(F.col("_u").isNull(), 1)).alias("_left"))
    return flagged.join(left, "medium").where(F.col("_u").isNull() | (F.col("_left") < n)).drop("_u", "_left")


def build_cases(
    corpus: DataFrame, aliases: DataFrame | None = None, per_medium: int = 100, semantic_ratio: float = 0.75,
    title_per_medium: int = 40, seed: int = 42, max_frequency: int = 3,
) -> DataFrame:
    """Semantic, keyword and title cases per medium.

    `corpus` has doc_id, medium, title, synopsis, aliases; `aliases` optionally
    maps doc_id to alternative titles. Draws are by hash, so a seed gives the
    same suite on every run and cluster.
    """
    n_semantic = int(round(per_medium * semantic_ratio))
    n_keyword = per_medium - n_semantic
    rows = with_keyword_alias(corpus, alias_frequency(corpus), max_frequency).withColumn(
        "clue", TT.synopsis_clue(F.col("synopsis"), F.col("title"))
    )
    semantic = sampled(rows.where(TT.is_semantic_clue(F.col("clue"))), n_semantic, seed, "semantic")
    keyword_pool = rows.where(F.col("has_keyword"))
    keyword = sampled(preferring_unused(keyword_pool, semantic, n_keyword), n_keyword, seed, "keyword")
    used = semantic.select("doc_id").union(keyword.select("doc_id")).distinct()
    title = sampled(preferring_unused(rows, used, title_per_medium), title_per_medium, seed, "title")
    if aliases is not None:
        title = title.join(aliases.select("doc_id", F.col("aliases").alias("alt")), "doc_id", "left")
    else:
        title = title.withColumn("alt", F.array().cast("array<string>"))

    def cases(df: DataFrame, kind: str, query: Column) -> DataFrame:
        return df.select(
            F.format_string(f"%s-{kind}-%04d", F.col("medium"), F.col("draw").cast("long")).alias("case_id"), "medium",
            F.lit(kind).alias("query_type"), query.alias("query"), F.col("title").alias("target_title"),
            F.col("doc_id").alias("target_id"),
        )

    def templated(templates: list[str], slot: str, value: str, salt: str) -> Column:
        choice = F.element_at(T.lit_array(templates), (pick(seed, salt, len(templates), F.col("doc_id")) + 1).cast("int"))
        return render(choice, {slot: F.col(value)})

    variants = title.withColumn("variants", F.filter(
        TT.query_variants(F.col("title"), F.coalesce("alt", F.array().cast("array<string>"))),
        lambda v: TT.is_specific_variant(v, F.col("title")),
    )).withColumn("others", F.filter("variants", lambda v: T.title_norm(v) != T.title_norm(F.col("title"))))

    def choice_of(options: str, salt: str) -> Column:
        at = F.pmod(pick(seed, salt, 1_000_003, F.col("doc_id")), F.size(options)).cast("int")
        return F.get(F.col(options), at)

    title_query = (
        F.when((F.size("others") > 0) & (pick(seed, "alt", 100, F.col("doc_id")) < 45), choice_of("others", "alt-choice"))
        .when((pick(seed, "own", 100, F.col("doc_id")) < 55) | (F.size("variants") == 0), F.col("title"))
        .otherwise(choice_of("variants", "any-choice"))
    )
    return (
        cases(semantic, "semantic", templated(L.SEMANTIC_TEMPLATES, "clue", "clue", "st"))
        .unionByName(cases(keyword, "keyword", templated(L.KEYWORD_TEMPLATES, "name", "keyword", "kt")))
        .unionByName(cases(variants, "title", title_query))
    )


def require_cases(cases: DataFrame, media: list[str], expected: dict[str, int]) -> DataFrame:
    """Fail the job when a medium has too few cases of a type (one small aggregate)."""
    found = {(r["medium"], r["query_type"]): r["n"] for r in cases.groupBy("medium", "query_type").agg(
        F.count("*").alias("n")).collect()}
    short = [f"{m}/{k}: {found.get((m, k), 0)} of {n}" for m in media for k, n in expected.items() if found.get((m, k), 0) < n]
    if short:
        raise RuntimeError("not enough rows for the suite: " + "; ".join(short))
    return cases


def hit_ranks(cases: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """Cases with the first matching rank within the top k, and the top titles."""
    joined = cases.select("case_id", "target_title", "target_id").join(results.where(F.col("rank") <= max(k, 10)), "case_id")
    match = is_match(F.col("target_title"), F.col("target_id"), F.col("title"), F.col("item_id")) & (F.col("rank") <= k)
    per_case = joined.groupBy("case_id").agg(
        F.min(F.when(match, F.col("rank"))).alias("hit_rank"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "title")))), lambda e: e["title"]).alias("top_titles"),
    )
    return cases.join(per_case, "case_id", "left").withColumn("hit", F.col("hit_rank").isNotNull())


def summary(results: DataFrame) -> DataFrame:
    """Cases, hits, errors, average latency and hit rate overall, by medium, by type and by both."""
    n = F.count("*")
    hits = F.sum(F.when(F.col("hit"), 1).otherwise(0))
    return results.cube("medium", "query_type").agg(
        n.alias("cases"), hits.alias("hits"),
        F.sum(F.when(F.col("error").isNotNull() & (F.col("error") != ""), 1).otherwise(0)).alias("errors"),
        F.round(hits / n, 4).alias("hit_rate"), F.round(F.sum("elapsed_ms") / n, 2).alias("avg_latency_ms"),
        F.grouping_id().alias("grouping"),
    )


def gate(summary_rows: DataFrame, minimum: float = 0.90) -> bool:
    row = summary_rows.where(F.col("grouping") == 3).select("hit_rate").first()
    return row is not None and row["hit_rate"] >= minimum


def suite_summary(rows: DataFrame) -> DataFrame:
    """Per suite: cases, resolve successes (target inside the resolved title), mean scores, repeat-call successes."""
    target, resolved = F.lower(F.trim("target")), F.lower(F.trim(F.coalesce("resolved_title", F.lit(""))))
    ok = (target != "") & (resolved != "") & F.contains(resolved, target)
    repeat = (F.col("method") == "cache_hit") & F.col("first_mode").isin("live", "cache_hit") & (F.col("second_mode") == "cache_hit")
    return rows.groupBy("suite").agg(
        F.count("*").alias("cases"), F.sum(F.when(ok, 1).otherwise(0)).alias("resolve_success"),
        F.round(F.avg("relevance"), 2).alias("avg_relevance"), F.round(F.avg("hallucination"), 2).alias("avg_hallucination"),
        F.sum(F.when(repeat, 1).otherwise(0)).alias("repeat_success"),
    )
