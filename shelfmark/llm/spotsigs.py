"""Document fingerprints from spot signatures.

Anchors are common words (`COMMON`, of four languages) and the start of the
text. A signature is an anchor with the chain of two content words (words that
are not common) that follow it; a text is the set of its signatures, hashed to
64 bits, and its fingerprint is the hash of the ordered set. Likeness is the
Jaccard coefficient of two sets, pruned: sets whose lengths alone keep it below
what is asked for, or whose value ranges do not meet, are not intersected.

`near_duplicates` partitions the sets by length so that a pair of likeness t has
lengths in the same or neighbouring partitions, posts each set under its rarest
signatures only (as many as t requires for a common one), prunes by length and
verifies by the exact coefficient. Equal sets are one row of the index.

Only DataFrame functions run here. Defined cases: null and empty texts have one
and the same signature (start and end), so they are alike; texts without common
words have the signature of their start; rows that repeat an id follow each
other in the order of id and text hash; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import materialize

THRESHOLD = 0.8
GROUP_ROWS = 1024
MAX_GROUPS = 4096

# Common words that serve as anchors.
COMMON = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which"
    " der die das und in zu den von mit ist des auf für nicht ein eine dem im auch es an werden aus er hat dass sie nach"
    " le la les de des et en un une du que est pour qui dans par sur au plus ne pas il ce avec"
    " el los las y que un una por con para se del al lo como su es no más"
).split()


def with_signatures(rows: DataFrame, text: str, name: str = "_set") -> DataFrame:
    """`rows` with the ordered set of hashed signatures of column `text`.

    Staged columns: an array used several times is computed once.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    rows = rows.withColumn("_words", F.concat(F.array(F.lit("^")), F.split(plain, " "), F.array(F.lit("$"))))
    words = F.col("_words")
    anchored = F.zip_with(
        F.slice(words, 2, F.size(words)), words,
        lambda w, before: F.when(
            ~w.isin(*COMMON), F.struct(w.alias("w"), F.when((before == "^") | before.isin(*COMMON), before).alias("anchor"))
        ),
    )
    rows = rows.withColumn("_content", F.array_compact(anchored))
    content = F.col("_content")
    chains = F.zip_with(
        content, F.slice(content, 2, F.size(content)),
        lambda a, b: F.when(a["anchor"].isNotNull(), F.xxhash64(a["anchor"], a["w"], b["w"])),
    )
    return rows.withColumn(name, F.sort_array(F.array_distinct(F.array_compact(chains)))).drop("_words", "_content")


def fingerprint(sets: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(sets)), 16, "0"))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two ordered sets; null where pruning shows that it is below `least`."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    exact = (
        F.when((n == 0) & (m == 0), 1.0)
        .when((n == 0) | (m == 0), 0.0)
        .when((F.element_at(a, -1) < F.element_at(b, 1)) | (F.element_at(b, -1) < F.element_at(a, 1)), 0.0)
        .otherwise(both / (n + m - both))
    )
    if least <= 0:
        return exact
    found = F.when(F.least(n, m) >= F.lit(least) * F.greatest(n, m), exact)
    return F.when(found >= least, found)


def _bounds(documents: DataFrame) -> list[int]:
    """At most `MAX_GROUPS` upper bounds of id that cut the table into groups of about `GROUP_ROWS`."""
    n = documents.where("doc_id IS NOT NULL").count()
    groups = min(MAX_GROUPS, n // GROUP_ROWS)
    if groups < 2:
        return []
    at = F.percentile_approx("doc_id", [i / groups for i in range(1, groups)], 100_000)
    return sorted(set(documents.agg(at.alias("b")).first()["b"]))


def _with_group(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Adds `_g`, the number of bounds below the id: groups ascend with ids, null ids are in the first.

    A binary search over a constant array, one column per step.
    """
    if not bounds:
        return rows.withColumn("_g", F.lit(0))
    listed = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows, width = rows.withColumn("_g", F.lit(0)), 1 << (len(bounds).bit_length() - 1)
    while width:
        probe = F.col("_g") + width
        rows = rows.withColumn("_g", F.when((probe <= len(bounds)) & (F.get(listed, probe - 1) < F.col("doc_id")), probe).otherwise(F.col("_g")))
        width >>= 1
    return rows


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, _set, next_text, next__set): every document beside the next one.

    The next document is that with the next smaller id; the smallest is followed
    by the largest. The table is dealt once, by ranges of id; the first document
    of every range also goes to the range before, where it ends the order.
    """
    rows = documents.select("doc_id", "text")
    bounds = _bounds(rows)
    order = F.struct(F.col("doc_id").isNotNull().alias("f"), "doc_id", F.xxhash64("text").alias("h"))
    keyed = _with_group(rows, bounds).select("doc_id", "text", "_g", order.alias("_o"))
    # One row per range: at most MAX_GROUPS.
    heads = keyed.groupBy("_g").agg(F.max("_o").alias("o")).orderBy("_g").collect()
    if not heads:
        return _led(keyed.withColumn("_end", F.lit(False)))
    before = {heads[i]["_g"]: heads[(i + 1) % len(heads)]["_g"] for i in range(len(heads))}
    listed = [(h["o"]["doc_id"], h["o"]["h"], before[h["_g"]]) for h in heads]
    kind = documents.schema["doc_id"].dataType.simpleString()
    ends = documents.sparkSession.createDataFrame(listed, f"_id {kind}, _h long, _to int")
    ghosts = keyed.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_o.h") == F.col("_h"))).select(
        "doc_id", "text", F.col("_to").alias("_g"), "_o"
    ).dropDuplicates(["_g"])
    everything = keyed.withColumn("_end", F.lit(False)).unionByName(ghosts.withColumn("_end", F.lit(True)))
    return _led(everything)


def _led(rows: DataFrame) -> DataFrame:
    rows = with_signatures(rows.repartition("_g"), "text")
    w = Window.partitionBy("_g").orderBy("_end", F.desc("_o"))
    rows = rows.withColumns({"next_text": F.lead("text").over(w), "next__set": F.lead("_set").over(w)})
    return rows.where("NOT _end").drop("_g", "_o", "_end")


def compared(documents: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text, with their likeness and that to the next document.

    The edited text has the last floor(n/2) code points replaced by the first as
    many of the next document, or by all of it.
    """
    rows = with_next(documents)
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), n - half), F.substr(after, F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "_set", F.col("next__set").alias("_next"))
    rows = with_signatures(rows, "_edited", "_edited_set")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("_set")).alias("fingerprint"),
        fingerprint(F.col("_edited_set")).alias("edited_fingerprint"), likeness(F.col("_set"), F.col("_edited_set")).alias("near_edited"),
        likeness(F.col("_set"), F.col("_next")).alias("near_next"), F.size("_set").cast("long").alias("n_signatures"),
    )


def near_duplicates(documents: DataFrame, least: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): members maps doc_id to its fingerprint, links are pairs of fingerprints with their likeness."""
    sets = with_signatures(documents.select("doc_id", "text"), "text", "s").select("doc_id", "s", fingerprint(F.col("s")).alias("f"))
    sets = materialize(sets, "signature-sets")
    # Equal fingerprints are equal sets: one row of the index.
    own = materialize(sets.groupBy("f").agg(F.min("s").alias("s")).withColumn("n", F.size("s")), "distinct-sets")
    rarity = own.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    ranked = own.select("f", "n", F.explode("s").alias("g")).join(rarity, "g")
    ordered = ranked.groupBy("f", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    # Sets of likeness t share a signature among the first n - ceil(t n) + 1 of each in any common order.
    prefix = F.slice("o", 1, F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / least)) + 1e-9)
    posts = ordered.where("n > 0").select("f", "n", part.alias("p"), F.explode(F.transform(prefix, lambda e: e["g"])).alias("g"))
    left = posts.select("g", F.col("f").alias("a"), F.col("n").alias("na"), F.explode(F.array("p", F.col("p") + 1)).alias("p"))
    right = posts.select("g", F.col("f").alias("b"), F.col("n").alias("nb"), "p")
    met = left.join(right, ["g", "p"]).where(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= F.lit(least) * F.col("nb") - 1e-9)
    ).select("a", "b").distinct()
    full = met.join(own.select(F.col("f").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("f").alias("b"), F.col("s").alias("sb")), "b")
    links = full.withColumn("likeness", likeness(F.col("sa"), F.col("sb"), least)).where("likeness IS NOT NULL").select("a", "b", "likeness")
    return sets.select("doc_id", F.col("f").alias("fingerprint")), links
