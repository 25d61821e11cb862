"""Registered queries of the training-data operators: (spark, folder) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import ann, bpe, byte_bpe, dialogue, langid, licenses, line_dedup, mixing, periodic, sharding, simhash, spotsigs, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable, sql: str | None = None) -> Callable:
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _crc(column) -> F.Column:
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the numbers of its lines that repeat an earlier line, whole or but for one word."""
    rows = line_dedup.decisions(_table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"))


OP1_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), lines AS (
  SELECT doc_id, line_no, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw
), filled AS (SELECT * FROM lines WHERE line <> ''),
firsts AS (
  SELECT doc_id, line_no, string_split(line, ' ') AS w FROM filled
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) = 1
), gaps AS (
  SELECT doc_id, line_no, w, unnest(range(0, len(w) + 1)) AS c FROM firsts WHERE len(w) >= 4
), variants AS (
  SELECT doc_id, line_no, md5(array_to_string(w[1:c], ' ') || chr(10) || array_to_string(w[c+1:], ' ')) AS v FROM gaps
  UNION ALL
  SELECT doc_id, line_no, md5(array_to_string(w[1:c], ' ') || chr(10) || array_to_string(w[c+2:], ' ')) AS v FROM gaps WHERE c < len(w)
), ranked AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY v ORDER BY doc_id, line_no) AS k FROM variants
), near AS (SELECT DISTINCT doc_id, line_no FROM ranked WHERE k > 1),
kept AS (SELECT doc_id, line_no FROM firsts ANTI JOIN near USING (doc_id, line_no)),
gone AS (SELECT doc_id, line_no FROM filled ANTI JOIN kept USING (doc_id, line_no))
SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_dropped, coalesce(g.l, '') AS dropped
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM filled GROUP BY 1) f USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS l FROM gone GROUP BY 1) g USING (doc_id)
"""
query(op1_line_dedup, OP1_SQL)


@query
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the number of BPE ids, a digest of the ids and one of the text they decode to."""
    return bpe.encoded(_table(spark, folder, "documents"))


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its SimHash fingerprint and the smallest document id of its class."""
    rows = simhash.classes(_table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the words that a mix of the sources at target weights takes of it."""
    rows = mixing.draws(_table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its toxicity score; learnt from two thirds of the labels."""
    documents = _table(spark, folder, "documents")
    model = toxicity.train(documents, _table(spark, folder, "labels"), lambda i: _crc(i) % 3 != 1)
    rows = toxicity.scored(documents.select("doc_id", "text"), model)
    held_out = F.coalesce(_crc(F.col("doc_id")) % 3 == 1, F.lit(False))
    return rows.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= toxicity.DECISION, 1).otherwise(0).alias("predicted")
    )


@query
def op2_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors by cosine of every vector whose id is divisible by 50."""
    vectors = _table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices found in documents."""
    return licenses.scan(_table(spark, folder, "documents"))


OP4_SQL = r"""
WITH templates(license, text) AS (VALUES {values}),
t AS (SELECT license, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM templates),
tb AS (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS tb FROM t),
texts AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(l) AS u FROM texts
  UNION ALL SELECT doc_id, text AS u FROM texts WHERE len(l) > 1
), words AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units
), ub AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS ub
  FROM words WHERE w <> ['']
), d AS (
  SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) AS dice FROM ub, tb
  WHERE len(ub) <= 1.5 * len(tb) + 1 AND len(tb) <= 1.5 * len(ub) + 1
)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units FROM d WHERE dice >= 0.8 GROUP BY doc_id, license
"""
query(op4_license_scan, OP4_SQL.replace("{values}", ", ".join(f"('{n}', '{t}')" for n, t in licenses.TEMPLATES)))


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard of 40 in the hash tree, its slot there, and its shard if there were 41."""
    rows = sharding.sizes(_table(spark, folder, "documents"))
    key = F.col("doc_id")
    rows = sharding.placed(sharding.placed(rows, key, 40, "now"), key, 41, "grown")
    rows = rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("now.shard").alias("shard"), F.col("grown.shard").alias("grown_shard"),
        F.col("now.region").alias("region"), F.col("now.rack").alias("rack"),
    )
    return sharding.numbered(rows, ["doc_id", "text_crc32", "size"]).withColumn("slot", F.col("slot").cast("long"))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its predicted language; learnt from three quarters of the table."""
    documents = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = langid.train(documents.where(F.col("doc_id").isNotNull() & ~held_out))
    rows = langid.identified(documents.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op9_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and likeness to that and to the next document."""
    return spotsigs.compared(_table(spark, folder, "documents"))


@query
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the number of byte-level BPE ids, a digest of the ids and one of the bytes they decode to."""
    rows = byte_bpe.encoded(_table(spark, folder, "documents"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its periodic runs of words, the strongest of them, and a digest of the text without repeats.

    Each tenth document is given a repeated tail first; a null id is given none.
    """
    h = _crc(F.col("doc_id"))
    chosen = _table(spark, folder, "documents").select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("planted"))
    words = chosen.withColumn("w", F.when(F.col("planted"), periodic.word_list(F.col("text"))))
    n = F.size("w")
    start = (F.col("g") % n).cast("int")
    period = (F.lit(1) + F.floor((n - start) / (3 + F.col("g") % 8))).cast("int")
    tailed = F.array_join(periodic.repeated_tail(F.col("w"), start, period), " ")
    texts = words.select("doc_id", F.when(F.col("planted") & (n > 0), tailed).otherwise(F.col("text")).alias("text"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return periodic.runs(texts).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("(1000 * strongest.length) DIV strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with every twentieth row lost, emptied, cut, repeated or given to the user, by a hash of its place."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))  # noqa: E731
    place = rows.withColumn("_h", F.crc32(F.encode(F.concat(filled("conv_id"), F.lit(":"), filled("turn")), "UTF-8")) % 20)
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(F.col("_h") == 4, "user").otherwise(filled("role"))
    times = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return place.where("_h != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_t")).drop("_t")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Per conversation, after damage, its faults and the cheapest edits that make it well formed."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    audits = dialogue.audits(_damaged(rows)).withColumnRenamed("conv_id", "_c")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select("conv_id").distinct().join(audits, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# The same result by dynamic programming over rows: states 0 nothing, 1 after s, 2 after u, 3 after a.
OP12_SQL = r"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(place, ''), lambda c: ascii(c)::BIGINT)), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS h
  FROM filled
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE h <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    regexp_extract(text, '([^ 	-])[ 	-]*\z', 1) AS last, left(role, 1) AS c
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair
  FROM numbered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), inserts(s, t, letters, price, shown) AS (VALUES
  (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 3, chr(10) || 'user:'), (1, 2, 'I', 3, chr(10) || 'user:'),
  (3, 2, 'I', 3, chr(10) || 'user:'), (2, 3, 'I', 3, chr(10) || 'assistant:'), (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')
), moves(s, c, t, letter, price) AS (
  SELECT s, NULL::VARCHAR, s, 'D', 4 FROM (VALUES (0), (1), (2), (3)) x(s)
  UNION ALL SELECT * FROM (VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (3, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0),
    (0, NULL::VARCHAR, 2, 'R', 3), (1, NULL, 2, 'R', 3), (2, NULL, 3, 'R', 3), (3, NULL, 2, 'R', 3)) y
), best(conv_id, i, s, cost, audit, shown) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '', '' FROM counts
  UNION ALL
  SELECT conv_id, i, t, cost, audit, shown FROM (
    SELECT b.conv_id, j.i, m.t, b.cost + n.price + m.price + CASE WHEN m.letter <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
      b.audit || n.letters || m.letter AS audit,
      b.shown || n.shown || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text
        ELSE chr(10) || CASE m.t WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || j.text END AS shown
    FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1 JOIN inserts n ON n.s = b.s
    JOIN moves m ON m.s = n.t AND (m.c IS NULL OR m.c = j.c) AND (m.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, i, t ORDER BY cost, audit) = 1
), repairs AS (
  SELECT b.conv_id, b.cost + n.price AS cost, b.audit || n.letters AS audit, b.shown || n.shown AS shown
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN inserts n ON n.s = b.s
  WHERE (n.t = 0 OR n.t = 3)
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + n.price, b.audit || n.letters) = 1
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(r.cost, 0)::BIGINT AS cost, coalesce(r.audit, '') AS audit,
  sha256(coalesce(substr(r.shown, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repairs r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
query(op12_conversation_repair, OP12_SQL)
