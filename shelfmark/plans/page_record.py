"""Page to chapter record: adapter and generic extraction, merge, one hop from series to first chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions import jsonfn as J, text as T, urls as U
from shelfmark.operators import chapters as C, lists as LS, pages as PG
from shelfmark.session import materialize


def site_extraction(rows: DataFrame, pages: DataFrame, sites: dict[str, dict[str, list[str]]] | None = None) -> dict[str, DataFrame]:
    """Metadata, links and image candidates of pages: generic, or under each page's site selectors in one pass.

    With `sites`, `rows` and `pages` carry a `site` column and only pages of a
    known site take part.
    """
    if not sites:
        return {"meta": PG.page_metadata(rows, pages), "links": PG.chapter_links(rows, pages), "images": PG.panel_candidates(rows, pages)}
    rows, pages = rows.where(F.col("site").isin(*sites)), pages.where(F.col("site").isin(*sites))
    by_field = {
        field: {site: listed[field] for site, listed in sites.items() if field in listed}
        for field in ("title", "chapter_title", "cover", "genres", "status", "links")
    }
    listed = {k: v for k, v in by_field.items() if v}
    return {
        "meta": PG.page_metadata(rows, pages, {k: v for k, v in listed.items() if k != "links"}),
        "links": PG.chapter_links(rows, pages, listed.get("links")), "images": PG.panel_candidates(rows, pages),
    }


def heuristic_records(adapter: dict[str, DataFrame] | None, generic: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adapter extraction over generic extraction: field by field, larger image set first, merged chapter lists."""
    if adapter is None:
        meta, images = generic["meta"], generic["images"].withColumn("order", F.struct(F.lit(0).alias("l"), F.col("stage"), F.col("pos")))
        links = C.merged_longer_first(generic["links"].limit(0).withColumn("pos", F.lit(0)), _linked(generic["links"]), ["page_id"])
    else:
        a, g = adapter["meta"], generic["meta"]
        keep = [c for c in g.columns if c not in ("page_id", "url", "genres", "status")]
        joined = g.join(a.select("page_id", *[F.col(c).alias(f"_a_{c}") for c in a.columns if c not in ("page_id", "url")]), "page_id", "left")
        meta = joined.select("page_id", "url", *[F.coalesce(F.nullif(T.collapse(F.col(f"_a_{c}")), F.lit("")), F.col(c)).alias(c) for c in keep],
                             F.slice(J.distinct_strings(F.concat(F.coalesce("_a_genres", F.array().cast("array<string>")), "genres")), 1, 20).alias("genres"),
                             F.coalesce("_a_status", "status").alias("status"))
        n_a = adapter["images"].groupBy("page_id").agg(F.count("*").alias("_na"))
        n_g = generic["images"].groupBy("page_id").agg(F.count("*").alias("_ng"))
        both = adapter["images"].withColumn("_l", F.lit(0)).unionByName(generic["images"].withColumn("_l", F.lit(1)))
        sized = both.join(n_a, "page_id", "left").join(n_g, "page_id", "left").fillna(0, ["_na", "_ng"])
        lead = F.when(F.col("_na") >= F.col("_ng"), 0).otherwise(1)
        order = F.struct(F.when(F.col("_l") == lead, 0).otherwise(1).alias("l"), F.col("stage"), F.col("pos"))
        images = sized.withColumn("order", order).groupBy("page_id", "url").agg(
            F.min("order").alias("order"), F.max_by(F.struct("width", "height"), "order").alias("s")
        ).select("page_id", "url", "s.*", "order")
        links = C.merged_longer_first(_linked(adapter["links"]), _linked(generic["links"]), ["page_id"])
    counts = meta.select("page_id").join(images.groupBy("page_id").agg(F.count("*").alias("n_images")), "page_id", "left").join(
        links.groupBy("page_id").agg(F.count("*").alias("n_links")), "page_id", "left").fillna(0)
    kind = F.when(F.col("n_images") >= 2, "chapter").when(F.col("n_links") >= 2, "series").otherwise("unknown")
    title = F.coalesce("chapter_title", F.col("title"))
    meta = meta.join(counts, "page_id").withColumns({
        "page_type": kind, "number": U.inferred_number(title, F.col("url")),
        "series_title": T.series_title(F.col("title"), F.col("chapter_title")), "chapter_pattern": U.chapter_pattern(F.col("url")),
    })
    return {"meta": meta, "links": links, "images": images}


def _linked(links: DataFrame) -> DataFrame:
    """Links with a numeric place, as the list merge expects."""
    return links.withColumn("pos", F.col("pos._f") * 1_000_000 + F.col("pos.pos"))


def overridden(external: DataFrame, heuristic: DataFrame) -> DataFrame:
    """An external extraction over the heuristic one, field by field; blanks and unknowns do not override."""
    def filled(name: str) -> Column:
        return F.coalesce(F.nullif(T.collapse(F.col(f"_x_{name}")), F.lit("")), F.col(name)).alias(name)

    x = external.select("page_id", *[F.col(c).alias(f"_x_{c}") for c in external.columns if c != "page_id"])
    joined = heuristic.join(x, "page_id", "left")
    return joined.select(
        "page_id", filled("title"), filled("chapter_title"), filled("number"), filled("cover"),
        F.when(F.size(F.coalesce("_x_genres", F.array().cast("array<string>"))) > 0, J.distinct_strings(F.col("_x_genres"))).otherwise(F.col("genres")).alias("genres"),
        F.when(F.coalesce("_x_status", F.lit("unknown")) == "unknown", F.col("status")).otherwise(F.col("_x_status")).alias("status"),
        F.when(F.size(F.coalesce("_x_images", F.array().cast("array<string>"))) >= 2, "external").otherwise("heuristic").alias("image_source"),
    )


def chapter_records(pages: DataFrame, registry: DataFrame, sites: dict[str, dict[str, list[str]]]) -> dict[str, DataFrame]:
    """Chapter records of a page table, rejections as a status.

    `pages`: page_id, url, html[, status]. `registry`: rank, site, domain,
    default_mode. `sites`: selectors by site. A series page without images takes
    the record of its first chapter, when that page is in the table (one hop).
    """
    fetched = pages if "status" in pages.columns else pages.withColumn("status", F.lit(200))
    sited = PG.site_of(fetched, registry)
    known = materialize(sited.select("page_id", "url", "status", "site", "default_mode"), "pages-known")
    parsed = PG.elements(pages.select("page_id", PG.sanitised(F.col("html")).alias("html")))
    rows = materialize(parsed.join(known.select("page_id", "site"), "page_id"), "page-elements")
    generic = {k: materialize(v, f"generic-{k}") for k, v in site_extraction(rows, known).items()}
    adapter = {k: materialize(v, f"adapter-{k}") for k, v in site_extraction(rows, known, sites).items()} if sites else None
    record = {k: materialize(v, f"page-{k}") for k, v in heuristic_records(adapter, generic).items()}
    html = pages.select("page_id", "html")
    images = materialize(record["images"].join(html, "page_id").where(U.has_evidence(F.col("html"), F.col("url"))).drop("html"), "page-evidence")
    links = record["links"]
    # The mode vote sees all candidates, the page count only those with evidence in the html.
    modes = LS.reading_mode(record["images"].join(known.select("page_id", "default_mode"), "page_id"), ["page_id", "default_mode"],
                            F.coalesce("default_mode", F.lit("paginated"))).select("page_id", "mode")
    body = rows.where("tag = 'body'").groupBy("page_id").agg(F.first(T.collapse(F.col("text"))).alias("body"))
    forms = rows.where(PG.has_login_form()).select("page_id").distinct().withColumn("has_form", F.lit(True))
    n_panels = images.groupBy("page_id").agg(F.count("*").alias("panels"))
    base = record["meta"].join(known.select("page_id", "status", "site", "default_mode").withColumnRenamed("status", "http_status"), "page_id")
    full = base.join(n_panels, "page_id", "left").join(body, "page_id", "left").join(forms, "page_id", "left").join(modes, "page_id", "left").fillna(0, ["panels"]).withColumns({
        "has_form": F.coalesce("has_form", F.lit(False)), "body": F.coalesce("body", F.lit("")),
        "mode": F.coalesce("mode", "default_mode", F.lit("paginated")),
        "signal": U.is_chapter_url(F.col("url")) | U.is_chapter_text(F.col("chapter_title")) | (F.col("page_type") == "chapter"),
    })
    status = (
        F.when(~F.col("signal") & (F.col("panels") < 4), "not_chapter")
        .when(PG.login_wall(F.col("http_status"), F.col("url"), F.col("panels"), F.col("has_form"), F.col("body"), U.is_chapter_url(F.col("url"))), "not_public")
        .when(F.col("panels") < 2, "not_chapter").otherwise("ok")
    )
    judged = materialize(full.withColumn("status", status).drop("body"), "page-judged")
    # One hop: series pages look up their first chapter among the pages at hand.
    order = C.ordered(links.withColumn("pos", F.col("order")), ["page_id"])
    hop = (F.col("panels") < 4) & ((F.col("page_type") == "series") | (~F.col("signal") & (F.col("n_links") > 0)))
    sources = judged.where(hop).select("page_id", F.col("url").alias("own"))
    firsts = C.first_of_series(order.join(sources, "page_id"), ["page_id"], "own")
    targets = judged.select(U.comparable(F.col("url")).alias("_c"), F.col("page_id").alias("target_id"))
    hops = firsts.withColumn("_c", U.comparable(F.col("first_url"))).join(targets, "_c").groupBy("page_id").agg(F.min("target_id").alias("target_id"))
    routed = judged.select("page_id").join(hops, "page_id", "left").withColumn("source_id", F.coalesce("target_id", "page_id"))
    record_columns = [c for c in judged.columns if c not in ("page_id", "url")]
    records = routed.select("page_id", "source_id").join(judged.select(F.col("page_id").alias("source_id"), "url", *record_columns), "source_id")
    # Chapter lists gain the current chapter, keep to the series, and are ordered.
    current = judged.where("status = 'ok'").select("page_id", "number", F.col("chapter_title").alias("title"), "url",
                                                   F.struct(F.lit(9).alias("_p"), F.lit(0).cast("long").alias("pos")).alias("order"))
    listed = links.select("page_id", "number", "title", "url", F.struct(F.col("order._p").alias("_p"), F.col("order.pos").cast("long").alias("pos")).alias("order"))
    merged = C.merged_unique(listed.join(current.select("page_id"), "page_id", "left_semi").unionByName(current.select(listed.columns)), ["page_id"], "order")
    own = merged.join(judged.select("page_id", F.col("url").alias("base")), "page_id")
    chapters = C.ordered(C.same_series_or_all(own, ["page_id"], "base"), ["page_id"], "order")
    return {"records": records, "images": images, "chapters": chapters}
