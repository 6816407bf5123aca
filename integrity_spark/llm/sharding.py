"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 64-bit hashes; a key goes clockwise to the first point whose shard has
room. Loads are bounded by capacities that sum to the number of rows (at most one apart), so the counts are balanced
exactly and only keys that overflow a full shard move on. The walk runs on the arcs between points: arcs
take their own keys in ring order until their shard is full, and the overflow of an arc continues clockwise to the
shards that still have room. The plan depends on arc counts alone and is bounded by the number of points (each hand-over
fills a shard or empties an arc); keys get their rank within their arc and meet the plan in a broadcast join.

Defined results: repeated ids are neighbours on the ring and are placed one by one; a null id is a key like any other;
null text has size 1, and a very long one is a row like any other (counts are balanced, not bytes); an empty table gives no rows; extra columns of the input don't pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHARDS, VNODES = 16, 128


def points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place on the ring, shard), clockwise; places are signed 64-bit."""
    return sorted((int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(vnodes))


def place_of(key: Column) -> Column:
    """A key's place on the ring: 64 bits of a digest, so places don't depend on the engine's version."""
    hexes = F.sha2(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"), 256)
    half = [F.conv(F.substring(hexes, 1 + 8 * k, 8), 16, 10).cast("long") for k in (0, 1)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


def arc_of(place: Column, ring: list[tuple[int, int]]) -> Column:
    """Index of the first point at or after the place, clockwise."""
    places = F.array(*(F.lit(p) for p, _ in ring))
    n = len(ring)
    low, high = F.lit(0), F.lit(n)
    zero = F.struct(low.alias("lo"), high.alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc.lo + acc.hi) / 2).cast("int")
        below = (acc.lo < acc.hi) & (F.get(places, mid) < place)
        return F.struct(F.when(below, mid + 1).otherwise(acc.lo).alias("lo"), F.when(below | (acc.lo >= acc.hi), acc.hi).otherwise(mid).alias("hi"))

    steps = F.array(*(F.lit(k) for k in range(n.bit_length() + 1)))
    return F.aggregate(steps, zero, halve, lambda acc: acc.lo % n)


def assign(counts: dict[int, int], ring: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (arc, first rank, last rank + 1, shard, slot of the first)."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    size, used, rows = list(room), [0] * shards, []

    def take(arc: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            rows.append((arc, lo, lo + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return lo + n

    over = []
    for arc, (_, shard) in enumerate(ring):
        n = counts.get(arc, 0)
        if n and (lo := take(arc, 0, n, shard)) < n:
            over.append((arc, lo, n))
    free = [k for k, (_, s) in enumerate(ring) if room[s]]
    for arc, lo, hi in over:
        while lo < hi:
            free = [k for k in free if room[ring[k][1]]]
            at = free[bisect_left(free, arc) % len(free)]
            lo = take(arc, lo, hi, ring[at][1])
    assert used == size
    return rows


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``size``, ``text_crc32``, ``shard`` and a gapless ``slot`` in it."""
    ring = points(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    place = place_of(F.col(id_col))
    keyed = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), place.alias("place"))
    keyed = written(keyed.withColumn("arc", arc_of(F.col("place"), ring)), "keys")
    counts = {r["arc"]: r["n"] for r in keyed.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    rows = assign(counts, ring, shards) or [(0, 0, 0, 0, 0)]
    plan = docs.sparkSession.createDataFrame(rows, "arc int, lo long, hi long, shard int, first long")
    clockwise = W.partitionBy("arc").orderBy("place", F.col("id").asc_nulls_first(), "size", "text_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(clockwise) - 1)
    met = ranked.join(plan.hint("broadcast"), (ranked.arc == plan.arc) & (ranked["rank"] >= plan.lo) & (ranked["rank"] < plan.hi))
    return met.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).cast("long").alias("slot"))
