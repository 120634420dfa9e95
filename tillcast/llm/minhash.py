"""Near copies by b-bit MinHash.

A document is the set of its five-word shingles. 128 minima of hashes of that set are cut into bands
of four; documents with equal bands are candidates. Of each minimum the low four bits are
kept, packed into eight longs: the share of equal positions, corrected for those equal by chance,
estimates the similarity of candidates with a few bit counts. Candidates are then confirmed
on their full sets.

How the work stays in proportion to the input:

* Documents with equal sets are one class, found by a grouped minimum.
* In a bucket (documents with an equal band) every document is compared with two leaders, not
  with all others. What is confirmed is joined into components.
* Only where a bucket still holds several components are its documents compared across them, in blocks of
  bounded size, and each pair in the first bucket that both share. Bit counts, sharpened by 1,536 further
  minima, name the documents of a block that may link across. These meet again with the hashes of
  all their shingles, and the block counts the exact intersections. It hands on a forest of what links: pairs that
  connect all that the block's links connect. So no link between components is left out, pairs
  below the threshold never leave their block, and a block hands on fewer pairs than it has documents.
* The forest is confirmed on the texts. Should a pair fail there, which takes two shingles with equal 64-bit
  hashes, all linking pairs of all blocks are confirmed instead of the forest.

A band misses a pair of similarity 0.75 so often that all 32 do in 5 of a million cases; the estimates
(five standard deviations below 0.75 for 128 minima, 4.2 for 1,664) drop one of 70,000. Both are for pairs
exactly at the threshold that nothing else connects; more similar ones are missed far less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.caps import _forest
from tillcast.llm.common import (
    LOWER,
    byte_view,
    chunks,
    mixed,
    span_hashes,
    utf8,
    words,
    workspace,
    written,
)
from tillcast.llm.graph import components

SHINGLE = 5
PERCENT = 75
MINIMA, ROWS, BITS = 128, 4, 4
BANDS = MINIMA // ROWS
PACKED = MINIMA * BITS // 64
#: Equal low bits from which a pair may be similar enough: five deviations below what 0.75 gives.
_CHANCE = 1 / (1 << BITS)
_EQUAL = PERCENT / 100 * (1 - _CHANCE) + _CHANCE


def least_equal(positions: int, deviations: float) -> int:
    return int(positions * _EQUAL - deviations * (positions * _EQUAL * (1 - _EQUAL)) ** 0.5)


MIN_EQUAL = least_equal(MINIMA, 5)
#: Further minima of documents that meet others in a bucket, for a sharper estimate there.
WIDE = 1536
MIN_EQUAL_WIDE = least_equal(MINIMA + WIDE, 4.2)
#: Documents of a bucket that are compared with each other at once.
BLOCK = 512
#: Shingles of the documents of a block, on average.
BLOCK_SHINGLES = 1_000_000
#: Shingles that a block's sets are compared by at once.
COLUMNS = 4096
#: Shingles verified against one leader in one task.
LEADER_SHINGLES = 1_000_000

_rng = np.random.default_rng(5)
_TIMES = (_rng.integers(0, 1 << 32, MINIMA + WIDE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLUS = _rng.integers(0, 1 << 32, MINIMA + WIDE, dtype=np.uint64).astype(np.uint32)
NARROW_PART, WIDE_PART = slice(0, MINIMA), slice(MINIMA, MINIMA + WIDE)


# --- signatures ------------------------------------------------------------------


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct 64-bit hashes of the shingles of each text."""
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(LOWER[data], starts, ends)
    count = max(len(hashes) - SHINGLE + 1, 0)
    keys = np.zeros(count, dtype=np.uint64)
    for k in range(SHINGLE):
        keys = mixed(keys * np.uint64(31) ^ hashes[k : k + count])
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= SHINGLE:
            out.append(np.unique(keys[i : j - SHINGLE + 1]))
        elif j > i:
            key = np.array([j - i], dtype=np.uint64)
            for k in range(i, j):
                key = mixed(key * np.uint64(37) ^ hashes[k : k + 1])
            out.append(key)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minima(keys: np.ndarray, part: slice = NARROW_PART) -> np.ndarray:
    """The smallest value of each of some hash functions over a set that is not empty."""
    times, plus = _TIMES[part, None], _PLUS[part, None]
    least = np.full(len(times), 0xFFFFFFFF, dtype=np.uint32)
    short = (keys >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        values = times * short[None, i : i + 1024] + plus
        np.minimum(least, values.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of (rows of) minima, 16 to a long."""
    low = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)
    low = low.reshape(*least.shape[:-1], -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(
        axis=-1, dtype=np.uint64
    )


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(*least.shape[:-1], BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:-1])
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ rows[..., k])
    return keys


SIGNED = "doc_id {0}, n_shingles bigint, set_1 bigint, set_2 bigint, sig array<bigint>, bands array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        for first, last, part in chunks(data, offsets):
            sets = shingle_hashes(part, offsets[first : last + 1] - offsets[first])
            least = np.zeros((len(sets), MINIMA), dtype=np.uint32)
            marks = np.zeros((len(sets), 2), dtype=np.uint64)
            for i, keys in enumerate(sets):
                if len(keys):
                    least[i] = minima(keys)
                    marks[i] = keys.sum(dtype=np.uint64), mixed(keys * np.uint64(3)).sum(dtype=np.uint64)
            sizes = np.array([len(keys) for keys in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array(sizes),
                    pa.array(marks[:, 0].view(np.int64)),
                    pa.array(marks[:, 1].view(np.int64)),
                    _lists(packed(least)),
                    _lists(band_keys(least)),
                ],
                names=["doc_id", "n_shingles", "set_1", "set_2", "sig", "bands"],
            )


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_shingles, sig, bands, utf8) with the further minima packed as ``wide``."""
    for batch in batches:
        data, offsets = byte_view(batch.column(4))
        for first, last, part in chunks(data, offsets):
            sets = shingle_hashes(part, offsets[first : last + 1] - offsets[first])
            wide = packed(np.stack([minima(keys, WIDE_PART) for keys in sets]))
            some = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [*some.columns, _lists(wide)], names=[*some.schema.names, "wide"]
            )


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    ends = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def equal_bits(one: Column, other: Column) -> Column:
    """How many of the minima of two signatures have equal low bits."""
    ones = F.lit(0x1111111111111111).cast("long")
    unequal = F.lit(0)
    for i in range(PACKED):
        x = one[i].bitwiseXOR(other[i])
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unequal = unequal + F.bit_count(x.bitwiseAND(ones))
    return F.lit(MINIMA) - unequal


# --- confirming on full sets ------------------------------------------------------


def _full_set(text: bytes) -> set:
    heard = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if len(heard) < SHINGLE:
        return {tuple(heard)}
    return set(zip(*(heard[k:] for k in range(SHINGLE))))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lead, part, place, doc, text) in order: each leader's text comes before its documents'."""
    at, lead_set = None, set()
    for batch in batches:
        leads, places, docs = (batch.column(i).to_pylist() for i in (0, 2, 3))
        pairs: list[tuple] = []
        for i in range(batch.num_rows):
            if places[i] == 0:
                if at != leads[i]:
                    at, lead_set = leads[i], _full_set(batch.column(4)[i].as_py())
                continue
            own = _full_set(batch.column(4)[i].as_py())
            shared = len(own & lead_set)
            if 100 * shared >= PERCENT * (len(own) + len(lead_set) - shared):
                pairs.append((docs[i], leads[i]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (doc, lead) whose full sets are similar enough, as links (a, b).

    ``texts`` has doc_id, n_shingles and utf8. Only a leader's set is held in memory; the documents
    of a leader are dealt over as many tasks as their size asks for.
    """
    sizes = texts.select(F.col("doc_id").alias("doc"), "n_shingles")
    spread = (
        pairs.join(sizes, "doc")
        .groupBy("lead")
        .agg(F.ceil(F.sum("n_shingles") / LEADER_SHINGLES).cast("int").alias("parts"))
    )
    members = pairs.join(spread, "lead").select(
        "doc", "lead", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("place")
    )
    leaders = spread.select(
        F.col("lead").alias("doc"),
        "lead",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("place"),
    )
    rows = texts.withColumnRenamed("doc_id", "doc").join(members.unionByName(leaders), "doc")
    return (
        rows.select("lead", "part", "place", "doc", "utf8")
        .repartition("lead", "part")
        .sortWithinPartitions("lead", "part", "place")
        .mapInArrow(_confirm, "a bigint, b bigint")
    )


# --- buckets with several components -----------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, list[list[tuple]]]]:
    """Bucket, whether a block meets itself, and the rows of both sides.

    Rows (bucket, one, other, side, ...) come in order, those of a meeting of two blocks after each other.
    """
    meeting, sides = None, [[], []]
    for batch in batches:
        for bucket, one, other, side, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, one, other) != meeting:
                if meeting is not None:
                    yield meeting[0], meeting[1] == meeting[2], sides
                meeting, sides = (bucket, one, other), [[], []]
            sides[side].append(row)
    if meeting is not None:
        yield meeting[0], meeting[1] == meeting[2], sides


def _unequal(x: np.ndarray) -> np.ndarray:
    """How many packed positions are not zero in each row of longs."""
    x = x.view(np.uint64)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def _columns(sides: list[list[tuple]], k: int) -> list[np.ndarray]:
    return [np.array([row[k] for row in side], dtype=np.int64) for side in sides]


def _first_met(p: np.ndarray, q: np.ndarray, bands: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which of the pairs of rows share no bucket before this one."""
    out = np.empty(len(p), dtype=bool)
    for k in range(0, len(p), 1 << 16):
        one, other = bands[0][p[k : k + (1 << 16)]], bands[1][q[k : k + (1 << 16)]]
        out[k : k + (1 << 16)] = ~((one == other) & (one < bucket)).any(axis=1)
    return out


def _may_link_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (..., doc_id, component, sig, wide, bands) those that may link with another component here."""
    for bucket, own, sides in _blocks(batches):
        if not sides[0] or not (own or sides[1]):
            continue
        both = [sides[0], sides[0]] if own else sides
        parts, sigs, wides, bands = (_columns(both, k) for k in (1, 2, 3, 4))
        hit = [np.zeros(len(side), dtype=bool) for side in both]
        for i in range(0, len(both[0]), 64):
            unequal = _unequal(sigs[0][i : i + 64, None, :] ^ sigs[1][None, :, :])
            p, q = np.nonzero(
                (MINIMA - unequal >= MIN_EQUAL) & (parts[0][i : i + 64, None] != parts[1][None, :])
            )
            total = unequal[p, q] + _unequal(wides[0][i + p] ^ wides[1][q])
            close = MINIMA + WIDE - total >= MIN_EQUAL_WIDE
            p, q = i + p[close], q[close]
            new = _first_met(p, q, bands, bucket)
            hit[0][p[new]] = hit[1][q[new]] = True
        if own:
            hit = [hit[0] | hit[1]]
        rows = [(side, both[side][r]) for side in range(len(hit)) for r in np.flatnonzero(hit[side])]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket] * len(rows), pa.int64()),
                    pa.array([side for side, _ in rows], pa.int32()),
                    pa.array([r[0] for _, r in rows], pa.int64()),
                    pa.array([r[1] for _, r in rows], pa.int64()),
                    pa.array([r[5] for _, r in rows], pa.int32()),
                    pa.array([r[6] for _, r in rows], pa.int32()),
                ],
                names=["bucket", "side", "doc_id", "component", "one", "other"],
            )


def shared_counts(sides: list[list[np.ndarray]]) -> np.ndarray:
    """Sizes of the intersections of each set of one side with each of the other, some columns at a time."""
    flat = [np.concatenate(sets) for sets in sides]
    rows = [np.repeat(np.arange(len(sets)), [len(x) for x in sets]) for sets in sides]
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    counts = np.zeros((len(sides[0]), len(sides[1])), dtype=np.int64)
    # Places of all hashes among the common ones, in order of these.
    found = []
    for keys, row in zip(flat, rows):
        place = np.minimum(np.searchsorted(common, keys), max(len(common) - 1, 0))
        hit = common[place] == keys if len(common) else np.zeros(len(keys), bool)
        place, row = place[hit], row[hit]
        order = np.argsort(place, kind="stable")
        found.append((place[order], row[order]))
    for k in range(0, len(common), COLUMNS):
        marks = []
        for (place, row), sets in zip(found, sides):
            i, j = np.searchsorted(place, (k, k + COLUMNS))
            mark = np.zeros((len(sets), min(COLUMNS, len(common) - k)), dtype=np.float32)
            mark[row[i:j], place[i:j] - k] = 1
            marks.append(mark)
        counts += (marks[0] @ marks[1].T).astype(np.int64)
    return counts


def _links_across(forest: bool):
    """Pairs of different components in a block that link by the hashes of all their shingles.

    All of them, or a forest that connects the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, one, other, side, doc_id, component, bands, keys)."""
        for bucket, own, sides in _blocks(batches):
            if not sides[0] or not (own or sides[1]):
                continue
            both = [sides[0], sides[0]] if own else sides
            ids, parts, bands = (_columns(both, k) for k in (0, 1, 2))
            sets = [[np.frombuffer(row[3], dtype=np.uint64) for row in side] for side in both]
            sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in sets]
            shared = shared_counts(sets)
            union = sizes[0][:, None] + sizes[1][None, :] - shared
            linked = (100 * shared >= PERCENT * union) & (parts[0][:, None] != parts[1][None, :])
            if own:
                linked &= ids[0][:, None] < ids[1][None, :]
            p, q = np.nonzero(linked)
            met = _first_met(p, q, bands, bucket)
            linked[p[~met], q[~met]] = False
            pairs = np.array(_forest(linked) if forest else np.argwhere(linked), dtype=np.int64)
            if len(pairs):
                a, b = ids[0][pairs[:, 0]], ids[1][pairs[:, 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["doc", "lead"]
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, bands, utf8) with the hashes of all shingles instead of the text."""
    for batch in batches:
        data, offsets = byte_view(batch.column(2))
        for first, last, part in chunks(data, offsets):
            sets = shingle_hashes(part, offsets[first : last + 1] - offsets[first])
            some = batch.slice(first, last - first)
            keys = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), keys], names=["doc_id", "bands", "keys"])


MEETING = ["bucket", "one", "other"]


def _met(seats: DataFrame, *columns: str) -> DataFrame:
    rows = seats.select(*MEETING, "side", *columns)
    return rows.repartition(*MEETING).sortWithinPartitions(*MEETING)


def seats_across(members: DataFrame, texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Documents that may link with another component of their bucket, a row for each meeting of blocks."""
    labelled = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    mixed_up = (
        labelled.groupBy("bucket")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.greatest(
                F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
            ).cast("int").alias("blocks"),
        )
        .where("low <> high")
        .select("bucket", "blocks")
    )
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    seats = (
        labelled.select("doc_id", "bucket", "component")
        .join(mixed_up, "bucket")
        .join(texts.select("doc_id", "sig", "wide", "bands"), "doc_id")
        .withColumn("own", own)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
        .withColumns(
            {
                "one": F.least("own", "met"),
                "other": F.greatest("own", "met"),
                "side": F.when(F.col("own") <= F.col("met"), 0).otherwise(1),
            }
        )
    )
    # The blocks' numbers once more behind, for the rows that go on.
    seats = seats.withColumns({"first_block": F.col("one"), "second_block": F.col("other")})
    return _met(
        seats, "doc_id", "component", "sig", "wide", "bands", "first_block", "second_block"
    ).mapInArrow(
        _may_link_across, "bucket bigint, side int, doc_id bigint, component bigint, one int, other int"
    )


def pairs_across(seats: DataFrame, texts: DataFrame, forest: bool = True) -> DataFrame:
    """Pairs (doc, lead) of different components that link: all, or a forest of each block's."""
    sets = (
        texts.join(seats.select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", "bands", "utf8")
        .mapInArrow(_keys, "doc_id bigint, bands array<bigint>, keys binary")
    )
    return (
        _met(seats.join(sets, "doc_id"), "doc_id", "component", "bands", "keys")
        .mapInArrow(_links_across(forest), "doc bigint, lead bigint")
        .distinct()
    )


# --- all of it ------------------------------------------------------------------------


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs`` (doc_id, text).

    ``doc_id`` must be a whole number. Null and empty texts, and texts of white space, have no
    shingles and link with nothing. A row without id links with nothing either, has no
    component and is kept. Rows of one id are one document with several texts: they share a component.
    """
    folder = workspace(docs.sparkSession, "minhash")
    own = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("utf8"))
    signed = own.mapInArrow(_sign, SIGNED.format("bigint"))
    signed = written(signed, f"{folder}/signed")

    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = usable.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # Read from files, both sides are exchanged for the join, and a set that most documents have is split.
    several = written(classes.where("n > 1").drop("n"), f"{folder}/classes")
    placed = written(
        usable.select("doc_id", "n_shingles", "set_1", "set_2")
        .join(several, ["set_1", "set_2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")),
        f"{folder}/placed",
    )
    reps = written(
        usable.join(
            placed.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi"
        ).select("doc_id", "n_shingles", "sig", "bands"),
        f"{folder}/reps",
    )

    buckets = reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    leaders = (
        buckets.groupBy("bucket")
        .agg(
            F.min("doc_id").alias("lead"),
            F.min_by("doc_id", F.xxhash64("doc_id")).alias("lead_2"),
            F.max("doc_id").alias("last"),
        )
        .where("lead <> last")
        .drop("last")
    )
    members = written(buckets.join(leaders, "bucket"), f"{folder}/members")
    # Written first: if Spark finds their file small enough it broadcasts them, and no other texts are shuffled.
    met = written(members.select("doc_id").distinct(), f"{folder}/met")
    texts = written(
        own.join(met, "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .join(reps.dropDuplicates(["doc_id"]), "doc_id")
        .select("doc_id", "n_shingles", "sig", "bands", "utf8")
        .mapInArrow(
            _widen,
            "doc_id bigint, n_shingles bigint, sig array<bigint>, bands array<bigint>, utf8 binary,"
            " wide array<bigint>",
        ),
        f"{folder}/texts",
    )
    star = (
        members.select(F.col("doc_id").alias("doc"), F.explode(F.array("lead", "lead_2")).alias("lead"))
        .where("doc <> lead")
        .distinct()
    )
    tried = written(may_link(star, reps), f"{folder}/tried-0")
    links = written(confirmed(tried, texts), f"{folder}/links-0")
    parts = components(links, f"{folder}/parts-0")
    seats = written(
        seats_across(members.select("doc_id", "n_shingles", "bucket"), texts, parts), f"{folder}/seats"
    )
    if not seats.isEmpty():
        across = written(pairs_across(seats, texts), f"{folder}/across")
        more = written(confirmed(across, texts), f"{folder}/links-1")
        if more.count() < across.count():  # two shingles had one hash
            every = written(pairs_across(seats, texts, forest=False), f"{folder}/every")
            more = written(confirmed(every, texts), f"{folder}/links-2")
        parts = components(links.unionByName(more), f"{folder}/parts-1")

    labels = placed.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    alone = signed.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return labels.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def may_link(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of ``pairs`` (doc, lead) whose signatures do not rule out the similarity asked for."""
    sigs = reps.select("doc_id", "sig")
    return (
        pairs.join(sigs.toDF("doc", "sig"), "doc")
        .join(sigs.toDF("lead", "lead_sig"), "lead")
        .where(equal_bits(F.col("sig"), F.col("lead_sig")) >= MIN_EQUAL)
        .select("doc", "lead")
    )
