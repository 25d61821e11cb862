"""Scans: corpus lines, seeds, alias side files, cases, landed listing pages, vectors, pages, user state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions import jsonfn as J, text as T

CORPUS_SCHEMA = "queue_id long, item_id long, title string, type string, text string"
CASE_SCHEMA = "case_id string, medium string, query_type string, query string, target_title string, target_id long"


def read_corpus(spark: SparkSession, path: str, strict: bool = True, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """JSON-lines corpus; blank lines are skipped.

    Loaders are strict and fail on a malformed line; services skip such lines.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_seed(spark: SparkSession, json_path: str, parquet_paths: list[str], glob_root: str | None = None) -> DataFrame:
    """First readable of a JSON seed, the listed Parquet paths, then any Parquet file below `glob_root`."""
    tries = [("json", json_path, {})] + [("parquet", p, {}) for p in parquet_paths]
    if glob_root:
        tries.append(("parquet", glob_root, {"recursiveFileLookup": "true", "pathGlobFilter": "*.parquet"}))
    errors = []
    for fmt, path, options in tries:
        try:
            df = spark.read.format(fmt).options(**options).load(path)
            if set(df.columns) - {"_corrupt_record"}:
                return df
            errors.append(f"{path}: no columns")
        except AnalysisException as exc:
            errors.append(f"{path}: {exc.getMessage() or exc}")
    raise RuntimeError("no readable seed:\n" + "\n".join(errors))


def alias_rows(entries: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(media_type, item_id, pos, alias) of alias entries.

    `key` is null for entries of a list (which carry their own id and type) or
    the map key: `media:ID`, `ID`, or anything, in which case a nested id
    counts. An unknown type becomes the wildcard `*`.
    """
    k, v = F.lower(T.collapse(F.col(key))), F.col(value)
    nested_id = F.when(
        F.get_json_object(v, "$.mal_id").rlike("^-?[0-9]+$"), F.get_json_object(v, "$.mal_id")
    ).try_cast("long")
    nested_type = F.lower(T.collapse(F.get_json_object(v, "$.type")))
    typed = F.regexp_extract(k, r"^(anime|manga):([0-9]+)$", 1)
    item_id = (
        F.when(F.col(key).isNull(), nested_id)
        .when(typed != "", F.regexp_extract(k, r"^(anime|manga):([0-9]+)$", 2).try_cast("long"))
        .when(k.rlike("^[0-9]+$"), k.try_cast("long")).otherwise(nested_id)
    )
    known = nested_type.isin("anime", "manga")
    media = (
        F.when((typed != "") & F.col(key).isNotNull(), typed)
        .when(F.col(key).isNotNull() & k.rlike("^[0-9]+$"), "*")
        .otherwise(F.when(known, nested_type).otherwise("*"))
    )
    return (
        entries.select(media.alias("media_type"), item_id.alias("item_id"), J.alias_strings(v).alias("found"))
        .where(F.col("item_id").isNotNull())
        .withColumn("aliases", T.dedupe_array(F.col("found"), T.match_norm))
        .select("media_type", "item_id", F.posexplode("aliases").alias("pos", "alias"))
    )


def read_alias_map(spark: SparkSession, path: str) -> DataFrame:
    """Alias side file holding one JSON list or map; an unparsable file has no rows."""
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    entries = docs.where(F.col("doc").isNotNull()).lateralJoin(
        spark.tvf.variant_explode(F.col("doc").outer())
    ).select("key", F.to_json("value").alias("value"))
    return alias_rows(entries)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; any invalid row aborts the job with its id."""
    return validated_cases(spark.read.schema(CASE_SCHEMA).option("mode", "FAILFAST").json(path))


def validated_cases(cases: DataFrame, media: tuple = ("anime", "manga")) -> DataFrame:
    """All text fields non-empty, enums respected, integer target; otherwise the job fails naming the row."""
    ok = F.lit(True)
    for name in ("case_id", "query", "target_title"):
        ok = ok & (T.collapse(F.col(name)) != "")
    ok = ok & F.col("medium").isin(*media) & F.col("query_type").isin("semantic", "keyword", "title")
    ok = F.coalesce(ok & F.col("target_id").isNotNull(), F.lit(False))
    message = F.concat(F.lit("invalid case: "), F.to_json(F.struct("*")))
    return cases.withColumn("case_id", F.when(ok, F.col("case_id")).otherwise(F.raise_error(message)))


LISTING_SCHEMA = (
    "media_type string, page int, data array<struct<mal_id:string,title:string,members:long>>, "
    "pagination struct<has_next_page:boolean>"
)


def listing_rows(pages: DataFrame) -> DataFrame:
    """(media_type, page, pos, item_id, title, members) of landed listing pages.

    Reading stops at the first empty page or the first page without a next one;
    entries whose id is not an integer are dropped and the first occurrence of
    an id is kept.
    """
    empty = F.coalesce(F.size("data"), F.lit(0)) <= 0
    last = ~F.coalesce(F.col("pagination.has_next_page"), F.lit(False))
    stops = pages.where(empty | last).groupBy("media_type").agg(F.min("page").alias("stop"))
    rows = (
        pages.join(stops, "media_type", "left").where(F.col("stop").isNull() | (F.col("page") <= F.col("stop")))
        .select("media_type", "page", F.posexplode("data").alias("pos", "row"))
        .select("media_type", "page", "pos", F.col("row.mal_id").try_cast("long").alias("item_id"),
                "row.title", "row.members")
        .where(F.col("item_id").isNotNull())
    )
    return rows.groupBy("media_type", "item_id").agg(
        F.min_by(F.struct("page", "pos", "title", "members"), F.struct("page", "pos")).alias("r")
    ).select("media_type", "r.page", "r.pos", "item_id", "r.title", "r.members")


def vectors_by_id(vectors: DataFrame, ids: DataFrame, id_col: str = "vec_id", dense: str = "embedding") -> DataFrame:
    """Stored vectors for the requested ids; rows without a dense value are ignored."""
    return vectors.where(F.size(dense) > 0).join(ids.select(id_col), id_col, "left_semi")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """Pages in fetch shape: requested url, final url, status, html."""
    have = pages.columns
    return pages.select(
        "page_id", F.col("url").alias("requested_url"),
        (F.col("final_url") if "final_url" in have else F.col("url")).alias("final_url"),
        (F.col("status") if "status" in have else F.lit(200)).cast("int").alias("status"),
        T.text_or_empty(F.col("html")).alias("html"),
    )


def json_or_default(c: Column, schema: str, default: Column) -> Column:
    """Parsed state, or the default when the text is missing or not valid JSON."""
    return F.when(F.try_parse_json(c).isNull(), default).otherwise(F.coalesce(F.from_json(c, schema), default))


