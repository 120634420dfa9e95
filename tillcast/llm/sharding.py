"""Shards of nearly equal bytes by sampled splitters; equal texts stay together.

Records are ordered by a hash of their text, so that equal texts lie together. Groups of equal texts are of two kinds.

* Small ones, up to ``TOLERANCE`` of a shard. A sample of keys, drawn in proportion to size, gives quantile boundaries; the
  ranges between them are summed up, and those that turn out too full are subdivided by a second hash of the text, so
  that a group is never divided. Prefix sums within the ranges, begun at the total of the ranges before, put every
  record at its place in the whole order. A group goes where its first byte falls, which moves no boundary by
  more than the tolerance.
* Heavy ones, at most ``1 / TOLERANCE`` a shard. They are placed first, the largest first, each whole into the shard in which it leaves
  the least room. One that fits into no shard, such as one larger than a shard, is divided, as no law of equal bytes can keep it
  whole; its rows are dealt to parts by a hash of the id and cut by prefix sums. The small groups then fill what is left.

Texts are read once or twice and never moved; ids, hashes and sizes are. Only the boundaries, the totals of the
ranges and the heavy groups, all of them bounded by the number of shards, reach the driver. All of it is DataFrame functions.

Null texts count no bytes and form one group. Null ids come first in their group. Repeated rows take
places of their own.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import workspace, written

ROW_BYTES = 16
RANGES_PER_SHARD = 8
SAMPLES_PER_RANGE = 64
#: By how much of its share a shard's bytes may differ for a group to stay whole.
TOLERANCE = 0.01
HEAVY = "key long, first_part int, parts int, starts array<long>, shards array<int>"


def keyed(docs: DataFrame) -> DataFrame:
    """Id, size, checksum and sort key of every record."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("key"),
        F.xxhash64(F.lit(11), "doc_id", "text").alias("draw"),
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Boundaries between ranges of about equal size, from keys drawn in proportion to size."""
    wanted = ranges * SAMPLES_PER_RANGE
    unit = F.pmod("draw", F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(unit < F.col("size") * F.lit(wanted / max(total, 1))).select("key")
    shares = [k / ranges for k in range(1, ranges)]
    found = sample.agg(F.percentile_approx("key", shares, 20 * ranges)).first()[0]
    return sorted(set(found or []))


def _lookup(values: list, at: Column) -> Column:
    return F.get(F.lit(values), at)


def room_for(groups: list[tuple[int, int]], shards: int, share: float) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Where heavy ``groups`` (key, size), in order of size, go: (shard, bytes) for each; and the room that is left."""
    free = [share] * shards
    out = []
    for _, size in groups:
        fits = [k for k in range(shards) if free[k] >= size]
        if fits:
            k = min(fits, key=lambda k: (free[k], k))
            free[k] -= size
            out.append([(k, size)])
            continue
        pieces, left = [], size
        for k in sorted(range(shards), key=lambda k: (-free[k], k)):
            taken = min(left, int(max(free[k], 0)))
            if taken:
                free[k] -= taken
                left -= taken
                pieces.append((k, taken))
            if not left:
                break
        if left:  # bytes lost in rounding
            k = pieces[-1][0] if pieces else max(range(shards), key=lambda k: free[k])
            free[k] -= left
            pieces.append((k, left))
        out.append(pieces)
    return out, free


def place(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` of :func:`keyed`, which must be fixed, with ``part``, ``before`` (bytes) and ``shard``."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    limit = max(1, -(-2 * total // ranges))
    share = total / shards

    # At most shards / TOLERANCE groups are heavier than that.
    weights = rows.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > TOLERANCE * share)
    heavy = sorted(((r["key"], r["size"]) for r in weights.collect()), key=lambda g: (-g[1], g[0]))
    pieces, free = room_for(heavy, shards, share)

    light = rows
    if heavy:
        numbers = [-(-size // limit) for _, size in heavy]
        table = [
            {
                "key": key,
                "first_part": first,
                "parts": parts,
                "starts": list(accumulate([0, *(n for _, n in dealt[:-1])])),
                "shards": [k for k, _ in dealt],
            }
            for (key, _), first, parts, dealt in zip(heavy, accumulate([0, *numbers]), numbers, pieces)
        ]
        known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), f"array<struct<{HEAVY}>>")))
        met = rows.join(F.broadcast(known), "key", "left")
        light = met.where(F.col("parts").isNull()).select(*rows.columns)
        owned = met.where(F.col("parts").isNotNull()).withColumn(
            "part", F.col("first_part") + F.pmod("draw", F.col("parts").cast("long")).cast("int")
        )
        # Bytes before a part, counted from the first part of its group.
        sums = {r["part"]: r["size"] for r in owned.groupBy("part").agg(F.sum("size").alias("size")).collect()}
        begins = []
        for first, parts in zip(accumulate([0, *numbers]), numbers):
            begins += accumulate([0, *(sums.get(k, 0) for k in range(first, first + parts - 1))])
        in_order = Window.partitionBy("part").orderBy("doc_id", "draw", "size", "text_crc32")
        owned = owned.withColumn(
            "before",
            _lookup(begins, F.col("part"))
            + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("size"),
        )
        nth = F.size(F.filter("starts", lambda start: start <= F.col("before"))) - 1
        owned = owned.withColumn("shard", F.get("shards", nth))
    heavy_parts = sum(numbers) if heavy else 0

    # The small groups: one order of all of them, cut at the room left in each shard.
    rest = max(total - sum(size for _, size in heavy), 0)
    room = [max(r, 0.0) for r in free]
    scale = rest / max(sum(room), 1e-9)
    ends = list(accumulate(r * scale for r in room))
    cuts = splitters(light, rest, ranges) if rest else []
    at = F.size(F.filter(F.lit(cuts), lambda cut: cut <= F.col("key"))) if cuts else F.lit(0)
    ranged = light.withColumn("range", at)
    totals = {r["range"]: r["size"] for r in ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()}
    parts = [max(1, -(-totals.get(k, 0) // limit)) for k in range(len(cuts) + 1)]
    first_part = [0, *accumulate(parts)]
    sub = F.pmod(F.xxhash64(F.lit(17), "key"), _lookup(parts, F.col("range")).cast("long")).cast("int")
    dealt = ranged.withColumn("part", _lookup(first_part, F.col("range")) + sub)
    sums = {r["part"]: r["size"] for r in dealt.groupBy("part").agg(F.sum("size").alias("size")).collect()}
    begins = [0, *accumulate(sums.get(k, 0) for k in range(first_part[-1]))]
    in_order = Window.partitionBy("part").orderBy("key", "doc_id", "size", "text_crc32")
    of_key = Window.partitionBy("part", "key")
    placed = dealt.withColumn(
        "before",
        _lookup(begins, F.col("part"))
        + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("size"),
    ).withColumn("group_before", F.min("before").over(of_key))
    full = F.size(F.filter(F.lit(ends), lambda end: end <= F.col("group_before")))
    last = max((k for k in range(shards) if room[k] > 0), default=0)
    placed = placed.withColumn("shard", F.least(F.lit(last), full)).withColumn("part", F.col("part") + heavy_parts)
    columns = ("doc_id", "size", "text_crc32", "part", "before", "shard")
    placed = placed.select(*columns)
    return owned.select(*columns).unionByName(placed) if heavy else placed


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row of ``docs`` (doc_id, text)."""
    folder = workspace(docs.sparkSession, "sharding")
    placed = written(place(written(keyed(docs), f"{folder}/keys"), shards), f"{folder}/placed")
    # Slots count on from part to part; how many rows of a shard each part has is a small table.
    counts = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        "part", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("begin")
    )
    in_part = Window.partitionBy("part", "shard").orderBy("before", "doc_id", "text_crc32")
    return placed.withColumn("nth", F.row_number().over(in_part) - 1).join(begins, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("nth")).cast("long").alias("slot")
    )
