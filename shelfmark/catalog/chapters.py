"""Chapter-list operators with orders as series and lines as chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import urls as U
from shelfmark.operators import chapters as C
from shelfmark.session import spread

from . import query

_URL = "'https://h.example/manga/o' || l_orderkey || '/chapter-' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0')"


def lines(t):
    """Lines as chapters: series, number, title, url, pos; a line number may repeat within an order."""
    url = F.format_string("https://h.example/manga/o%d/chapter-%03d", "l_orderkey", F.col("l_linenumber").cast("long"))
    return spread(t.lineitem).select(
        F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("string").alias("number"), F.col("l_returnflag").alias("title"),
        url.alias("url"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 1000 + F.floor("l_quantity")).alias("pos"),
        F.col("l_linenumber").alias("n"), "l_quantity", "l_linestatus",
    )


_POS = "l_partkey * 1000000 + l_suppkey * 1000 + CAST(floor(l_quantity) AS BIGINT)"


@query("chapter_merge_j20", f"""WITH v AS (SELECT l_orderkey AS series, {_URL} AS url, CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS VARCHAR) END AS number, CASE WHEN l_quantity > 20 THEN 'T' || l_linenumber END AS title, {_POS} AS pos FROM lineitem)
SELECT series, url, max(number) AS number, max(title) AS title, min(pos) AS pos FROM v GROUP BY 1, 2""")
def chapter_merge(t):
    """First non-empty number and title per URL, fragments ignored."""
    rows = lines(t).withColumns({
        "number": F.when(F.col("l_linestatus") == "O", F.col("number")).otherwise(""),
        "title": F.when(F.col("l_quantity") > 20, F.concat(F.lit("T"), F.col("number"))),
        "url": F.concat(F.col("url"), F.when(F.col("l_quantity") > 10, "#p").otherwise("")),
    })
    rows = rows.withColumn("title", F.when(F.col("l_quantity") > 20, F.concat(F.lit("T"), F.col("n").cast("string"))))
    return C.merged_unique(rows, ["series"]).select("series", "url", "number", "title", "pos")


@query("longer_list_merge_j20_twin", f"""WITH v AS (SELECT l_orderkey AS series, {_URL} AS url, l_linestatus AS st, l_linenumber AS n FROM lineitem), a AS (SELECT DISTINCT series, url, n FROM v WHERE st = 'O'), b AS (SELECT DISTINCT series, url, n FROM v WHERE st <> 'O'),
c AS (SELECT series, count(*) FILTER (st = 'O') AS na, count(*) FILTER (st <> 'O') AS nb FROM v GROUP BY 1)
SELECT series, url, CASE WHEN (na >= nb AND a.url IS NOT NULL) OR b.url IS NULL THEN 'A' || coalesce(a.n, b.n) ELSE 'B' || coalesce(b.n, a.n) END AS number FROM a FULL JOIN b USING (series, url) JOIN c USING (series)""")
def longer_list_merge(t):
    rows = lines(t).withColumn("title", F.lit(""))
    a = rows.where("l_linestatus = 'O'").select("series", "url", F.concat(F.lit("A"), F.col("number")).alias("number"), "title", "pos")
    b = rows.where("l_linestatus <> 'O'").select("series", "url", F.concat(F.lit("B"), F.col("number")).alias("number"), "title", "pos")
    return C.merged_longer_first(a, b, ["series"]).select("series", "url", "number")


@query("gap_fill_j21", """WITH h AS (SELECT l_orderkey AS series, greatest(max(l_linenumber), 4) AS top FROM lineitem GROUP BY 1), e AS (SELECT series, unnest(range(1, top + 1)) AS n FROM h)
SELECT series, CAST(n AS VARCHAR) AS number, 'https://h.example/manga/o' || series || '/chapter-' || lpad(CAST(n AS VARCHAR), 3, '0') AS url FROM e ANTI JOIN lineitem ON l_orderkey = series AND l_linenumber = n""")
def gap_fill(t):
    rows = lines(t).withColumn("known", F.lit(4)).withColumn("base", F.format_string("https://h.example/manga/o%d/chapter-001", "series"))
    return C.gap_rows(rows, ["series"], "base", "known").select("series", "number", "url")


@query("neighbours_w6", """WITH c AS (SELECT l_orderkey AS series, max(l_linenumber) AS n FROM lineitem GROUP BY 1), x AS (SELECT DISTINCT l_orderkey AS series, l_linenumber AS n FROM lineitem UNION SELECT series, n - 1 FROM c UNION SELECT series, n + 1 FROM c)
SELECT series, 'https://h.example/manga/o' || series || '/chapter-' || lpad(CAST(n AS VARCHAR), 3, '0') AS url, CAST(n AS VARCHAR) AS number FROM x""")
def neighbours(t):
    rows = lines(t)
    current = rows.groupBy("series").agg(F.max("n").alias("n")).select(
        "series", F.col("n").cast("string").alias("number"), F.lit("now").alias("title"),
        F.format_string("https://h.example/manga/o%d/chapter-%03d", "series", F.col("n").cast("long")).alias("url"))
    return C.with_neighbours(rows, current, ["series"]).select("series", "url", "number")


@query("first_chapter_w7", f"""WITH v AS (SELECT l_orderkey AS series, l_linenumber AS n, {_POS} AS pos, l_returnflag = 'R' AS special, {_URL} AS url FROM lineitem),
p AS (SELECT *, CASE WHEN n = 1 AND NOT special THEN 1 WHEN NOT special THEN 2 ELSE 3 END AS p FROM v) SELECT series, arg_min(n, [p, pos, n]) AS n FROM p GROUP BY 1""")
def first_chapter(t):
    rows = lines(t).withColumn("special", F.col("title") == "R")
    return C.first_chapter(rows, ["series"]).select("series", "n")


@query("chapter_order_t3", f"""WITH v AS (SELECT l_orderkey AS series, {_URL} AS url, CASE WHEN l_linenumber = 3 THEN 'Bonus ' || chr(CAST(65 + l_orderkey % 26 AS INT)) ELSE 'Chapter ' || l_linenumber END AS label, l_linenumber AS n FROM lineitem),
d AS (SELECT DISTINCT series, url, label, n FROM v) SELECT series, url, row_number() OVER (PARTITION BY series ORDER BY n = 3, n) AS index FROM d""")
def chapter_order(t):
    rows = lines(t).withColumn("number", F.when(F.col("n") == 3, F.concat(F.lit("Bonus "), F.char(F.col("series") % 26 + 65))).otherwise(
        F.concat(F.lit("Chapter "), F.col("number"))))
    return C.ordered(rows, ["series"]).select("series", "url", "index")


@query("reader_order_t3_twin", f"""WITH v AS (SELECT l_orderkey AS series, {_URL} AS url, l_linenumber AS n, {_POS} AS pos FROM lineitem)
SELECT series, url, row_number() OVER (PARTITION BY series ORDER BY n = 3, CASE WHEN n = 3 THEN 0 ELSE n END, pos, url) AS index FROM v""")
def reader_order(t):
    """Order of the reader's list: numbered chapters, then the others by title."""
    special = F.col("n") == 3
    rows = lines(t).withColumns({"number": F.when(~special, F.col("number")), "title": F.when(special, "Bonus").otherwise(F.col("title"))})
    return C.reader_ordered(rows, ["series"]).select("series", "url", "index")


@query("list_search_f16", "SELECT l_orderkey AS series, l_linenumber AS n, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber = 2 OR contains(lower(CAST(l_linenumber AS VARCHAR) || ' ' || l_returnflag), '2')")
def list_search(t):
    rows = t.lineitem.where(C.list_filter(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.lit(" 2 ")))
    return rows.select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_quantity")


@query("chapter_url_rendering_x42", """SELECT l_orderkey, l_linenumber, l_partkey, 'https://h.example/m/' || l_orderkey || '/ch-' || lpad(CAST(l_linenumber + 10 AS VARCHAR), 3, '0') || '.0/x' AS from_path,
'https://h.example/v?chapter=' || lpad(CAST(l_linenumber + 10 AS VARCHAR), 2, '0') || '&p=1' AS from_query, 'https://h.example/c/' || (l_linenumber + 10) || '/' AS from_pattern FROM lineitem""")
def chapter_url_rendering(t):
    n = F.concat(F.lit("Chapter "), (F.col("l_linenumber") + 10).cast("string"))
    base = F.concat(F.lit("https://h.example/m/"), F.col("l_orderkey").cast("string"), F.lit("/ch-001.5/x"))
    return spread(t.lineitem).select(
        "l_orderkey", "l_linenumber", "l_partkey", U.rendered_chapter(base, n).alias("from_path"),
        U.rendered_chapter(F.lit("https://h.example/v?chapter=01&p=1"), n).alias("from_query"),
        U.rendered_pattern(base, F.lit("/c/{chapter}/"), (F.col("l_linenumber") + 10).cast("string")).alias("from_pattern"))


@query("chapter_number_x43", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN '-' || l_linenumber || '.5' WHEN 1 THEN CAST(l_linenumber AS VARCHAR) ELSE 'prologue' END AS number, l_linenumber % 3 = 2 AS special FROM lineitem""")
def chapter_number(t):
    k = F.col("l_linenumber") % 3
    n = F.col("l_linenumber").cast("string")
    label = F.when(k == 0, F.concat(F.lit("Ch. -"), n, F.lit(".5 end"))).when(k == 1, F.concat(F.lit("Episode "), n)).otherwise("")
    url = F.when(k == 2, "https://h.example/m/prologue").otherwise("https://h.example/m/x")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", U.inferred_number(label, url).alias("number"), U.is_special(label).alias("special"))
