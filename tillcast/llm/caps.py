"""Near copies among vectors by spherical-cap filters.

A filter is a random direction; a vector belongs to all filters whose inner product with it exceeds a
threshold. Directions form product codes: each half of a direction is one of a few random
vectors, so a vector is scored against the halves and its list of filters is decoded from those
scores, without looking at most of the directions. Directions of one code are correlated, so that many pairs would
share no filter of it at any number of filters; ``CODES`` codes with rotations of their own share the filters instead. Vectors that share a filter are compared
exactly, in double precision and in blocks of bounded size; a full filter is spread over pairs of blocks.

Pairs are counted where they are found, not emitted: a pair counts in the first filter its
vectors share, and a block hands on each vector's number of links and a forest of them, so its
output is as large as the block. Equal vectors are one class, found by a grouped minimum.

The number of filters follows the number of vectors of a length, so that filters hold about one to two times
``LOAD`` vectors at any size. The threshold is measured, with the very directions used, on random pairs at the least
similarity: ``MISSED`` of them share no filter, fewer of closer ones. Vectors in few filters get a lower threshold.
Up to ``LOAD`` vectors of a length are all compared. Tests measure recall at filter counts of up to 10 million vectors.

Vectors that are null, empty or zero or hold null or non-finite components, and rows without id, link with
nothing. Vectors of different lengths do not link. Rows of one id are one vector with several places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import workspace, written
from tillcast.llm.graph import components

MIN_COSINE = 0.9
LOAD = 1_000
#: Independent product codes; each has its share of the filters.
CODES = 16
#: Share of pairs at the least similarity without a common filter, as measured on ``TRIALS`` random pairs.
MISSED = 0.0005
TRIALS = 8_000
TRIED = 24
#: Filters every vector belongs to at least, and the steps, in standard deviations, by which its threshold is lowered for it.
FEWEST = 4
LOWERED = 0.25
BLOCK = 1_024
#: Shorter vectors all meet in one filter: caps of few dimensions are too coarse.
MIN_LENGTH = 16


def words_for(n: int) -> int:
    """Random halves of each kind in each code, for ``n`` distinct vectors of a length."""
    return max(8, math.isqrt(round(n * 20 / LOAD / CODES)))


@lru_cache(16)
def code(length: int, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The random halves of the directions for vectors of one length: ``CODES`` pairs, each rotated by itself."""
    rng = np.random.default_rng([length, words])
    pairs = []
    for _ in range(CODES):
        rotation = np.linalg.qr(rng.standard_normal((length, length)))[0]
        halves = []
        for basis in (rotation[: length // 2], rotation[length // 2 :]):
            rows = rng.standard_normal((words, len(basis)))
            rows *= math.sqrt(len(basis) / length) / np.linalg.norm(rows, axis=1, keepdims=True)
            halves.append(rows @ basis)
        pairs.append((halves[0], halves[1]))
    return pairs


def pairs_at(length: int, n: int, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors with this similarity."""
    rng = np.random.default_rng([length, n, seed])
    x, z = rng.standard_normal((2, n, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


def threshold(length: int, words: int, cosine: float = MIN_COSINE) -> float:
    """Score, in standard deviations, above which all but ``MISSED`` of random pairs share a filter.

    A pair shares one up to the largest of all directions' smaller scores. Only the ``TRIED`` most promising
    first halves of a code are looked at, so the value is that threshold or a lower one.
    """
    x, y = pairs_at(length, TRIALS, cosine, 1)
    best = np.full(TRIALS, -np.inf)
    for first, second in code(length, words):
        tried = min(words, TRIED)
        for k in range(0, TRIALS, 256):
            a, b = x[k : k + 256] @ first.T, x[k : k + 256] @ second.T
            c, d = y[k : k + 256] @ first.T, y[k : k + 256] @ second.T
            bound = np.minimum(a + b.max(axis=1, keepdims=True), c + d.max(axis=1, keepdims=True))
            for i in np.argpartition(-bound, tried - 1, axis=1)[:, :tried].T:
                i = i[:, None]
                both = np.minimum(np.take_along_axis(a, i, 1) + b, np.take_along_axis(c, i, 1) + d)
                best[k : k + 256] = np.maximum(best[k : k + 256], both.max(axis=1))
    return float(np.sort(best)[int(MISSED * TRIALS)]) * math.sqrt(length)


def decoded(vectors: np.ndarray, words: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit ``vectors`` and the filters they belong to, in order of rows and filters.

    With no ``words`` all belong to one filter. Who exceeds the threshold in less than ``FEWEST`` filters gets a lower one.
    """
    n, length = vectors.shape
    if not words:
        return np.arange(n), np.zeros(n, dtype=np.int64)
    need = np.full(n, t / math.sqrt(length))
    rows, found, left = [], [], np.arange(n)
    while len(left):
        row, cap = _exceeded(vectors[left], words, need[left])
        few = np.bincount(row, minlength=len(left)) < FEWEST
        rows.append(left[row[~few[row]]])
        found.append(cap[~few[row]])
        left = left[few]
        need[left] -= LOWERED / math.sqrt(length)
    row, cap = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((cap, row))
    return row[order], cap[order]


def _exceeded(vectors: np.ndarray, words: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, found = [], []
    for k, (first, second) in enumerate(code(vectors.shape[1], words)):
        one, other = vectors @ first.T, vectors @ second.T
        # Only first halves that some second half can complete are looked at.
        row, i = np.nonzero(one + other.max(axis=1, keepdims=True) >= need[:, None])
        pair, j = np.nonzero(other[row] >= (need[row] - one[row, i])[:, None])
        rows.append(row[pair])
        found.append((k * words + i[pair]) * words + j)
    return np.concatenate(rows), np.concatenate(found)


def _vectors(array: pa.Array) -> list[np.ndarray]:
    flat = array.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = array.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _decode(plans: dict[int, tuple[int, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (rep, copies, embedding) to (rep, copies, unit, filters)."""
        for batch in batches:
            vectors = _vectors(batch.column(2))
            lengths = np.array([len(v) for v in vectors], dtype=np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for k in range(0, len(at), 256):
                    own = at[k : k + 256]
                    unit = np.stack([vectors[i] for i in own])
                    unit /= np.abs(unit).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    row, found = decoded(unit, *plans.get(int(length), (0, 0.0)))
                    ends = np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(own)),
                            batch.column(1).take(pa.array(own)),
                            pa.array([v.tobytes() for v in unit], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(found + (length << 40))),
                        ],
                        names=["rep", "copies", "unit", "filters"],
                    )

    return run


# --- inside a block --------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (filter, one, other, side, rep, copies, unit, filters), those of a block after each other."""
    block, rows = None, []
    for batch in batches:
        for cap, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (cap, i, j) != block:
                if block is not None:
                    yield from _block_links(rows, block)
                block, rows = (cap, i, j), []
            rows.append(row)
    if block is not None:
        yield from _block_links(rows, block)


def _block_links(rows: list, block: tuple) -> Iterator[pa.RecordBatch]:
    """Numbers of links (a, null, n) and a forest of links (a, b, null) first found in this block."""
    sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
    if block[1] == block[2]:
        sides[1] = sides[0]
    if not sides[0] or not sides[1]:
        return
    units = [np.stack([np.frombuffer(r[3]) for r in side]) for side in sides]
    linked = units[0] @ units[1].T >= MIN_COSINE
    if block[1] == block[2]:
        linked &= ~np.tri(len(linked), dtype=bool)
    if not linked.any():
        return
    _drop_met(linked, [[r[4] for r in side] for side in sides], block[0])
    reps = [np.array([r[1] for r in side], dtype=np.int64) for side in sides]
    copies = [np.array([r[2] for r in side], dtype=np.int64) for side in sides]
    ids = np.concatenate(reps)
    counts = np.concatenate((linked @ copies[1], linked.T @ copies[0]))
    some = np.flatnonzero(counts)
    pairs = _forest(linked)
    a = np.concatenate((ids[some], reps[0][[p[0] for p in pairs]]))
    b = np.concatenate((np.zeros(len(some), np.int64), reps[1][[p[1] for p in pairs]]))
    n = np.concatenate((counts[some], np.zeros(len(pairs), np.int64)))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])


def _drop_met(linked: np.ndarray, filters: list[list], cap: int) -> None:
    """Take out of ``linked`` the pairs that share a filter before ``cap``."""
    marks = []
    for own, busy in zip(filters, (linked.any(axis=1), linked.any(axis=0))):
        at = np.flatnonzero(busy)
        held = [np.array(own[k], dtype=np.int64) for k in at]
        held = [x[x < cap] for x in held]
        marks.append((np.repeat(at, [len(x) for x in held]), np.concatenate(held)))
    shared = np.intersect1d(marks[0][1], marks[1][1])
    for k in range(0, len(shared), BLOCK):
        some, sides = shared[k : k + BLOCK], []
        for (row, found), own in zip(marks, filters):
            place = np.minimum(np.searchsorted(some, found), len(some) - 1)
            hit = some[place] == found
            mark = np.zeros((len(own), len(some)), dtype=np.float32)
            mark[row[hit], place[hit]] = 1
            sides.append(mark)
        linked &= (sides[0] @ sides[1].T) == 0


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect the same rows and columns as all pairs of ``linked``."""
    height, width = linked.shape
    rows_left, cols_left = linked.any(axis=1), np.ones(width, dtype=bool)
    pairs: list[tuple[int, int]] = []
    for start in range(height):
        stack = [start] if rows_left[start] else []
        rows_left[start] = False
        while stack:
            row = stack.pop()
            new = np.flatnonzero(linked[row] & cols_left)
            cols_left[new] = False
            for col in new.tolist():
                pairs.append((row, col))
                more = np.flatnonzero(linked[:, col] & rows_left)
                rows_left[more] = False
                for r in more.tolist():
                    pairs.append((r, col))
                    stack.append(r)
    return pairs


# --- all of it -----------------------------------------------------------------------------


def linked_vectors(table: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``table`` (vec_id, embedding)."""
    spark, folder = table.sparkSession, workspace(table.sparkSession, "caps")
    own = table.select(F.col("vec_id").cast("long"), "embedding")
    if not isinstance(own.schema["embedding"].dataType.elementType, (T.FloatType, T.DoubleType)):
        own = own.withColumn("embedding", F.col("embedding").cast("array<double>"))
    sound = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    digests = [F.xxhash64("embedding").alias("set_1"), F.xxhash64(F.lit(7), "embedding").alias("set_2")]
    usable = own.where(sound & F.col("vec_id").isNotNull())
    named = usable.select("vec_id", F.size("embedding").alias("length"), *digests)
    classes = named.groupBy("set_1", "set_2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    placed = written(
        named.join(classes, ["set_1", "set_2"]).select("vec_id", "rep", "copies", "length", "set_1", "set_2"),
        f"{folder}/placed",
    )
    reps = placed.where("vec_id = rep").select("rep", "copies", "length", "set_1", "set_2").distinct()
    # Each length named here has more than ``LOAD`` vectors; the others all meet in one filter.
    sizes = reps.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.where((F.col("length") >= MIN_LENGTH) & (F.col("n") > LOAD)).collect()
    plans = {r["length"]: (words_for(r["n"]), threshold(r["length"], words_for(r["n"]))) for r in sizes}
    vectors = written(
        usable.select("vec_id", "embedding", *digests)
        .dropDuplicates(["vec_id", "set_1", "set_2"])
        .join(reps.drop("length"), ["set_1", "set_2"])
        .where("vec_id = rep")
        .select("rep", "copies", "embedding")
        .mapInArrow(_decode(plans), "rep bigint, copies bigint, unit binary, filters array<bigint>"),
        f"{folder}/vectors",
    )
    seats = vectors.select("rep", F.explode("filters").alias("cap"))
    blocks = seats.groupBy("cap").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select(
        "cap", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")
    )
    own_block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = (
        seats.join(blocks, "cap")
        .withColumn("own", own_block)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
        .select(
            "rep",
            "cap",
            F.least("own", "met").alias("one"),
            F.greatest("own", "met").alias("other"),
            F.when(F.col("own") <= F.col("met"), 0).otherwise(1).alias("side"),
        )
    )
    found = written(
        met.join(vectors, "rep")
        .select("cap", "one", "other", "side", "rep", "copies", "unit", "filters")
        .repartition("cap", "one", "other")
        .sortWithinPartitions("cap", "one", "other")
        .mapInArrow(_counted, "a bigint, b bigint, n bigint"),
        f"{folder}/found",
    )
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.where("n = 0").select("a", "b"), f"{folder}/parts")
    known = (
        placed.select("vec_id", "rep", "copies")
        .join(counts, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "vec_id",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    alone = own.where(~sound | F.col("vec_id").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return known.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
