"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every shard draws an exponential variable per key, -ln(u) / weight with u from a
hash of key and shard. The draw of a rack is the least of its shards' draws and
the draw of a region the least of its racks', so each level is a weighted hash
draw with the weight of the whole subtree. A key descends to the region with
the least draw, there to the least rack, there to the least shard. Draws outside
a subtree do not depend on it: when weights change inside a subtree, keys only
move out of or into that subtree, and a new shard takes keys only into itself.

Only the key and the tree decide, so every row is placed on its own, without a
shuffle. Slots number the rows of a shard without gaps: shards are cut into
hash buckets of bounded size whose counts give the offsets.

Defined cases: a null text has no bytes; a null key is placed like the empty
text; rows that repeat a key share its shard and have slots of their own; an
empty table gives an empty table; further columns are kept by `placed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.operators.ranking import grouped_rank

REGIONS = 4
RACKS = 5
BUCKET_ROWS = 4096
FIXED_BYTES = 16


def tree(shards: int, weights: dict[int, float] | None = None) -> dict[int, dict[int, dict[int, float]]]:
    """{region: {rack: {shard: weight}}}; the place of a shard depends on its number alone."""
    found: dict[int, dict[int, dict[int, float]]] = {}
    for s in range(shards):
        weight = (weights or {}).get(s, 1.0)
        if weight > 0:
            found.setdefault(s % REGIONS, {}).setdefault(s // REGIONS % RACKS, {})[s] = float(weight)
    return found


def shard_of(key: Column, nodes: dict[int, dict[int, dict[int, float]]]) -> Column:
    """(draw, region, rack, shard) of a key; the least draw of each level carries the path below it."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2 ** 53))
        return -F.log(u) / F.lit(weight)

    regions = []
    for r, racks in sorted(nodes.items()):
        rack_draws = []
        for k, shards in sorted(racks.items()):
            leaves = F.array_min(F.array(*[F.struct(draw(s, w).alias("draw"), F.lit(s).alias("id")) for s, w in sorted(shards.items())]))
            rack_draws.append(F.struct(leaves["draw"].alias("draw"), F.lit(k).alias("id"), leaves["id"].alias("shard")))
        rack = F.array_min(F.array(*rack_draws))
        regions.append(F.struct(rack["draw"].alias("draw"), F.lit(r).alias("region"), rack["id"].alias("rack"), rack["shard"].alias("shard")))
    return F.array_min(F.array(*regions))


def placed(rows: DataFrame, key: Column, shards: int, name: str = "place", weights: dict[int, float] | None = None) -> DataFrame:
    """`rows` with a struct (draw, region, rack, shard)."""
    return rows.withColumn(name, shard_of(key, tree(shards, weights)))


def numbered(rows: DataFrame, order: list[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """Adds the zero-based, gapless position of each row in its shard; `order` starts with the key."""
    shards = max(1, rows.select(shard).distinct().count())
    buckets = max(1, -(-rows.count() // (shards * BUCKET_ROWS)))
    bucket = F.pmod(F.xxhash64(F.col(order[0]), F.lit(29)), F.lit(buckets))
    return grouped_rank(rows, [shard], bucket, [F.col(c) for c in order], name).withColumn(name, F.col(name) - 1)


def write_shards(rows: DataFrame, key: Column, shards: int, path: str, weights: dict[int, float] | None = None) -> None:
    """Write `rows` as Parquet folders region / rack / shard."""
    place = shard_of(key, tree(shards, weights))
    out = rows.withColumn("_place", place).select(*rows.columns, "_place.region", "_place.rack", "_place.shard")
    out.repartition("region", "rack", "shard", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("region", "rack", "shard").parquet(path)


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) of every document."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id", (F.octet_length(text) + FIXED_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
