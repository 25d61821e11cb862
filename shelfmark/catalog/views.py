"""Shapes of the input tables that many queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions import sections as S, text as T


def catalogue(documents: DataFrame) -> DataFrame:
    """Documents as a catalogue: first line = title, the rest = synopsis, `lang` = media type."""
    return documents.select(
        "doc_id", F.col("lang").alias("media_type"), "source", "text", "n_chars",
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.locate("\n", F.col("text")) > 0, F.substr("text", F.locate("\n", F.col("text")) + 1)).otherwise("")
        .alias("synopsis"),
    )


def labelled(documents: DataFrame) -> DataFrame:
    """Catalogue rows with a two-value media type, a small roster and the base labelled text."""
    words = F.regexp_extract_all("synopsis", F.lit("[A-Za-z]{4,}"), F.lit(0))
    rows = (
        catalogue(documents)
        .withColumn("kind", F.when(F.col("media_type") == "en", "manga").otherwise("anime"))
        .withColumn("ttl", T.collapse(F.col("title")))
        .withColumn("syn", T.collapse(F.col("synopsis")))
        .withColumn("w", words)
    )
    w = F.col("w")
    chars = (
        F.when(F.size(w) >= 4, F.array(
            F.concat(w[0], F.lit(", "), w[1], F.lit(" (Main)")), F.concat(w[2], F.lit(" "), w[3], F.lit(" (Supporting)"))
        )).when(F.size(w) >= 1, F.array(F.concat(w[0], F.lit(" (Main)"))))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        rows.withColumn("chars", chars)
        .withColumn("payload", S.base_text(
            F.col("kind"), F.col("ttl"), F.array("source", "media_type"), F.col("syn"), F.col("chars")
        ))
    )


def windows_sql(most: int) -> str:
    """Statement of `word_windows` over `benchmark`, as the table `win`."""
    return f"""wd AS (SELECT item_id, string_split(text, ' ') AS w, 1 + item_id % {most} AS n FROM benchmark),
wa AS (SELECT *, unnest(range(0, (len(w) - 1) // n + 1)) AS nth FROM wd),
win AS (SELECT item_id, nth, array_to_string(list_slice(w, nth * n + 1, nth * n + n), ' ') AS c FROM wa)"""


def word_windows(benchmark, most: int):
    """(item_id, nth, c): every passage whole, cut into consecutive windows of one to `most` words by its id."""
    n = F.col("item_id") % most + 1
    rows = benchmark.select("item_id", F.split("text", " ").alias("_w"), n.alias("_n"))
    cut = rows.select("item_id", "_w", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(size(_w) - 1) div _n"))).alias("nth"))
    window = F.slice("_w", (F.col("nth") * F.col("_n") + 1).cast("int"), F.col("_n").cast("int"))
    return cut.select("item_id", "nth", F.array_join(window, " ").alias("c"))
