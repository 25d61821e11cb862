"""Chapter lists: merge, order, gap filling, neighbours, first chapter, same-series filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import lexicon as L, text as T, urls as U

from .ranking import first_per_key, range_rank, with_group_flag


def merged_unique(rows: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """One row per comparable URL: the first non-empty number and title win, the first place is kept."""
    r = rows.withColumn("url", U.comparable(F.col("url")))

    def first_filled(name: str) -> Column:
        filled = F.coalesce(F.col(name), F.lit("")) != ""
        return F.min_by(F.when(filled, F.col(name)), F.when(filled, F.col(position))).alias(name)

    return r.groupBy(*keys, "url").agg(first_filled("number"), first_filled("title"), F.min(position).alias(position))


def merged_longer_first(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two lists per key where the longer list (the first on a tie) supplies rows for shared URLs.

    Within one list the last entry of a URL wins. The lengths are two small
    aggregates joined back.
    """
    n_a = a.groupBy(*keys).agg(F.count("*").alias("_na"))
    n_b = b.groupBy(*keys).agg(F.count("*").alias("_nb"))
    rows = a.withColumn("_l", F.lit(0)).unionByName(b.withColumn("_l", F.lit(1)))
    sized = rows.join(n_a, keys, "left").join(n_b, keys, "left").fillna(0, ["_na", "_nb"])
    primary = F.when(F.col("_na") >= F.col("_nb"), 0).otherwise(1)
    ranked = sized.withColumn("_p", F.when(F.col("_l") == primary, 0).otherwise(1)).where(F.coalesce("url", F.lit("")) != "")
    best = ranked.groupBy(*keys, "url").agg(
        F.min_by(F.struct(T.collapse(F.col("number")).alias("number"), T.collapse(F.col("title")).alias("title")),
                 F.struct("_p", -F.col("pos"))).alias("_r"),
        F.min(F.struct("_p", "pos")).alias("order"),
    )
    return best.select(*keys, "url", "_r.*", "order")


def label_of(number: Column, title: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(number, F.lit("")), title, F.lit("")))


def ordered(chapters: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Last entry per URL, then numbered chapters by number and label, then specials by label; adds special and index."""
    latest = chapters.where(F.coalesce("url", F.lit("")) != "").groupBy(*keys, "url").agg(
        F.max_by(F.struct("number", "title"), position).alias("_r"), F.min(position).alias(position)
    ).select(*keys, "url", "_r.*", position)
    label = label_of(F.col("number"), F.col("title"))
    rows = latest.withColumns({"_label": F.lower(label), "special": U.is_special(label), "_n": U.label_number(label)})
    rows = rows.withColumn("_n", F.when(~F.col("special"), F.col("_n")))
    order = ["special", F.asc("_n"), F.asc("_label"), F.asc(position), F.asc("url")]
    return range_rank(rows, keys, order, "index").drop("_label", "_n")


def reader_ordered(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Reader variant: numbered rows by number (from number, title or URL), then the others by title."""
    source = F.coalesce(F.nullif(F.col("number"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.col("url"))
    rows = chapters.withColumns({"_n": U.number_in(source), "_t": F.lower(F.coalesce("title", "number"))})
    rows = rows.withColumn("_t", F.when(F.col("_n").isNull(), F.col("_t")))
    return range_rank(rows, keys, [F.asc_nulls_last("_n"), "_t", "pos", "url"], "index").drop("_n", "_t")


def gap_rows(chapters: DataFrame, keys: list[str], base_url: str, known: str) -> DataFrame:
    """(keys, number, url): rendered rows for the whole numbers up to max(existing, known count) that are missing."""
    existing = chapters.select(*keys, base_url, known, U.number_in(F.col("number")).alias("_n"))
    heads = existing.groupBy(*keys).agg(F.first(base_url).alias("_u"), F.max(known).alias("_k"), F.max("_n").alias("_m"))
    top = F.floor(F.greatest(F.coalesce("_m", F.lit(0.0)), F.coalesce(F.col("_k").cast("double"), F.lit(0.0)))).cast("int")
    framed = heads.select(*keys, U.chapter_frame(F.col("_u")).alias("_f"), top.alias("_top"))
    every = T.exploded(framed, F.when(F.col("_top") > 0, F.sequence(F.lit(1), F.col("_top"))), "n")
    have = existing.where(F.col("_n") == F.floor("_n")).select(*keys, F.col("_n").cast("int").alias("n")).distinct()
    missing = every.join(have, [*keys, "n"], "left_anti")
    return missing.select(*keys, F.col("n").cast("string").alias("number"), U.filled_frame(F.col("_f"), F.col("n").cast("string")).alias("url")).where(
        F.col("url").isNotNull())


def overlaid(generated: DataFrame, real: DataFrame, keys: list[str]) -> DataFrame:
    """Reader variant of gap filling: generated rows, with real rows replacing those of the same comparable URL."""
    g = generated.withColumn("_c", U.comparable(F.col("url")))
    r = real.withColumn("_c", U.comparable(F.col("url")))
    return g.join(r.select(*keys, "_c"), [*keys, "_c"], "left_anti").unionByName(r.select(g.columns)).drop("_c")


def with_neighbours(chapters: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Chapter lists with the current chapter and its inferred previous and next ones; last entry per URL wins.

    `current`: keys, number, title, url.
    """
    def shifted(delta: int) -> Column:
        n = U.number_in(F.col("number")) + delta
        raw = F.regexp_extract(F.coalesce("number", F.lit("")), L.NUMBER_RE, 0)
        return F.when(n >= 0, U.format_like(raw, n)).otherwise("")

    far = F.lit(1 << 40)
    empty = F.lit(None).cast("string")
    listed = chapters.select(*keys, "number", "title", "url", F.col("pos").cast("long").alias("pos"))
    own = current.select(*keys, "number", "title", "url", far.alias("pos"))
    prev = current.select(*keys, shifted(-1).alias("number"), empty.alias("title"), U.adjacent(F.col("url"), -1).alias("url"), (far + 1).alias("pos"))
    nxt = current.select(*keys, shifted(1).alias("number"), empty.alias("title"), U.adjacent(F.col("url"), 1).alias("url"), (far + 2).alias("pos"))
    rows = listed.unionByName(own).unionByName(prev).unionByName(nxt).where(F.col("url").isNotNull())
    number = F.coalesce(F.nullif(T.collapse(F.col("number")), F.lit("")), U.inferred_number(T.collapse(F.col("title")), F.col("url")))
    filled = rows.withColumns({"number": number, "title": F.nullif(T.collapse(F.col("title")), F.lit(""))})
    return filled.groupBy(*keys, "url").agg(
        F.max_by(F.struct("number", "title"), "pos").alias("_r"), F.min("pos").alias("pos")
    ).select(*keys, "url", "_r.*", "pos")


def first_chapter(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """First chapter by priority: label says one; number is one and not special; first non-special; first row."""
    says_one = F.regexp_like(F.coalesce("title", F.lit("")), F.lit(L.CHAPTER_ONE_RE)) | F.regexp_like(
        F.coalesce("number", F.lit("")), F.lit(L.CHAPTER_ONE_RE))
    special = F.coalesce(F.col("special"), F.lit(False))
    n = U.number_in(F.coalesce(F.nullif(F.col("number"), F.lit("")), F.col("title")))
    priority = F.when(says_one, 0).when((n == 1) & ~special, 1).when(~special, 2).otherwise(3)
    return first_per_key(chapters.withColumn("_p", priority), keys, ["_p", "pos", "url"]).drop("_p")


def first_of_series(chapters: DataFrame, keys: list[str], own_url: str, suggested: str | None = None) -> DataFrame:
    """First chapter of a series page: a suggested URL, else the first listed number from zero on, else the first non-special.

    Rows must look like chapters and not lead back to the page. `chapters` carries special and index.
    """
    ok = (U.comparable(F.col("url")) != U.comparable(F.col(own_url))) & (
        U.is_chapter_text(F.col("title")) | U.is_chapter_text(F.col("number")) | U.is_chapter_url(F.col("url")))
    n = U.number_in(F.coalesce(F.nullif(F.col("number"), F.lit("")), F.col("title")))
    priority = F.when((n >= 0) & ~F.col("special"), 0).when(~F.col("special"), 1).otherwise(2)
    best = first_per_key(chapters.where(ok).withColumn("_p", priority), keys, ["_p", "index", "url"]).select(*keys, F.col("url").alias("first_url"))
    if suggested is None:
        return best
    hints = chapters.select(*keys, own_url, suggested).distinct().where(
        F.col(suggested).isNotNull() & (U.comparable(F.col(suggested)) != U.comparable(F.col(own_url)))).select(*keys, F.col(suggested).alias("_s"))
    return best.join(hints, keys, "full_outer").select(*keys, F.coalesce("_s", "first_url").alias("first_url"))


def same_series_or_all(rows: DataFrame, keys: list[str], base: str) -> DataFrame:
    """Rows of the same series as `base`; where a group has none, the whole group stays."""
    flagged = rows.withColumn("_same", U.same_series(F.col(base), F.col("url")))
    return with_group_flag(flagged, keys, F.col("_same"), "_any").where(F.col("_same") | ~F.col("_any")).drop("_same", "_any")


def same_series_with_current(rows: DataFrame, base: str) -> DataFrame:
    """Reader variant: same-series rows plus the current item."""
    return rows.where(U.same_series(F.col(base), F.col("url")) | (U.comparable(F.col("url")) == U.comparable(F.col(base))))


def list_filter(number: Column, title: Column, query: Column) -> Column:
    """List search: equal number if the query has one, or the query inside number and title."""
    q = F.trim(query)
    wanted = U.number_in(q)
    text = F.lower(F.concat(F.coalesce(number, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))
    return (q == "") | F.coalesce(wanted == U.number_in(number), F.lit(False)) | F.contains(text, F.lower(q))
