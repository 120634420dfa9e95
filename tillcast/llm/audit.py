"""How filters work together, in whatever order they are applied.

Five filters give 32 subsets, and a document survives a subset if it fails none of its filters. So every
document is one word of 32 bits, bit s for survival under the subset with the bits of s. Tasks add up these words
by position: carry-save adders turn three words into a sum and a carry of double weight, until
a few words of each weight are left to be counted bit by bit. What leaves a task is one row of
counts for each part and label it saw; their sums say, for every prefix of every order, who survives, and so
all that is reported.

The filters: A under 100 words; B distinct words below 80 % of the words; C ASCII capitals above 10 % of the
code points; D one of ``#$%&*|``; E the text of a smaller doc_id, anywhere in the table. Copies are found by
the SHA-256 of the text. Of each digest only the smallest id is kept, combined before the shuffle, and
those of several rows are written. Read from files, both sides of the join are exchanged for it, so Spark can split
a text which a third of all rows share. Texts are read once and never moved.

A null text is an empty one, without words: it fails A alone, or also E. A null language is the part of the empty string.
Rows with a null id have no label and fail E only if a row with an id has their text. Repeated rows are documents of their own; of equal ids none
is the smaller one. Several labels of an id count as one which has what any of them has. Other columns are not
read. An empty table has no parts and no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import workspace, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
#: Counters of (part, label) that a task holds before it hands them on.
HELD = 4096


def failures(text: Column) -> list[tuple[int, Column]]:
    """Bit and failure condition of the filters that judge a text by itself; its ``words`` are a column."""
    words = F.col("words")
    n_words = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        (1, n_words < LEAST_WORDS),
        (2, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n_words),
        (4, 100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.char_length(text)),
        (8, text.rlike(SYMBOLS)),
    ]


def judged(docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``part`` and ``failed`` (a bit for each filter) of every row, at ``folder``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    alone = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(bad, F.lit(bit)).otherwise(F.lit(0)) for bit, bad in failures(F.col("text"))]
    rows = written(
        alone.withColumn("words", F.array_remove(F.split("text", SPACES), "")).select(
            "doc_id",
            "part",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            (bits[0] + bits[1] + bits[2] + bits[3]).alias("failed"),
        ),
        f"{folder}/rows",
    )
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    copied = written(first.where("n > 1").select("digest", "first_id"), f"{folder}/copied")
    # A text that occurs once finds no partner and keeps its word.
    late = F.coalesce(
        F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id"))),
        F.lit(False),
    )
    return rows.join(copied, "digest", "left").select(
        "doc_id", "part", F.col("failed").bitwiseOR(F.when(late, 16).otherwise(0)).alias("failed")
    )


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` by doc_id; rows without a label have neither."""
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    return rows.join(marks, "doc_id", "left").fillna(0, subset=["good", "toxic"])


# --- words and their counts -----------------------------------------------------------

#: The word of each combination of failed filters.
WORDS = np.array(
    [sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32
)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, by carry-save adders."""
    counts, weight = np.zeros(32, dtype=np.int64), 1
    level = words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * n :]])
        for word in level.tolist():
            counts += weight * ((word >> np.arange(32)) & 1)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        parts, goods, toxics = zip(*held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(parts, pa.string()),
                pa.array(goods, pa.int32()),
                pa.array(toxics, pa.int32()),
                pa.array(list(held.values()), pa.list_(pa.int64())),
            ],
            names=["part", "good", "toxic", "survivors"],
        )

    for batch in batches:
        part = batch.column(0).dictionary_encode()
        label = batch.column(2).to_numpy() * 2 + batch.column(3).to_numpy()
        words = WORDS[batch.column(1).to_numpy()]
        group = part.indices.to_numpy().astype(np.int64) * 4 + label
        order = np.argsort(group, kind="stable")
        keys, begins = np.unique(group[order], return_index=True)
        for key, some in zip(keys.tolist(), np.split(words[order], begins[1:])):
            name = part.dictionary[key // 4].as_py(), key % 4 // 2, key % 2
            held[name] = held.get(name, 0) + positional_counts(some)
        if len(held) >= HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def survivors(rows: DataFrame) -> DataFrame:
    """``part``, ``good``, ``toxic`` and ``survivors``: documents left under each subset of filters.

    ``rows`` have part, failed, good and toxic.
    """
    tallied = rows.select("part", F.col("failed").cast("int"), "good", "toxic").mapInArrow(
        _tally, "part string, good int, toxic int, survivors array<bigint>"
    )
    sums = [F.sum(F.col("survivors")[s]).alias(f"s{s}") for s in range(SUBSETS)]
    return (
        tallied.groupBy("part", "good", "toxic")
        .agg(*sums)
        .select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(SUBSETS))).alias("survivors"))
    )


# --- what orders do -------------------------------------------------------------------


def _steps() -> list[dict]:
    """Order, step, the bit of the step's filter and the bits of those before it; 600, whatever the data."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def audit(counted: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the counts of :func:`survivors`."""
    only = [
        ("all_", F.lit(1)),
        ("good_", F.col("good")),
        ("toxic_", F.col("toxic")),
    ]
    by_part = counted.groupBy("part").agg(
        *(
            F.array(*(F.sum(F.col("survivors")[s] * keep) for s in range(SUBSETS))).alias(name)
            for name, keep in only
        )
    )
    steps = F.from_json(
        F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    )
    rows = by_part.select("part", "all_", "good_", "toxic_", F.inline(steps))

    def left(counts: str, subset: Column) -> Column:
        return F.get(F.col(counts), subset)

    before, bit = F.col("before"), F.col("bit")
    after = before + bit
    rest = F.lit(SUBSETS - 1) - bit
    removed = left("all_", before) - left("all_", after)
    # A filter removes the same documents whenever the same filters stand before it: their number of
    # orders is (filters before)! * (filters behind)!.
    factorial = F.array(*(F.lit(n) for n in (1, 1, 2, 6, 24)))
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: s.bitwiseAND(bit) == 0),
        F.lit(0).cast("long"),
        lambda total, s: total
        + (left("all_", s) - left("all_", s + bit))
        * F.get(factorial, F.bit_count(s).cast("int"))
        * F.get(factorial, F.lit(len(FILTERS) - 1) - F.bit_count(s).cast("int")),
    )
    return rows.select(
        "part",
        "filter_order",
        "step",
        left("all_", after).alias("kept"),
        removed.alias("removed"),
        (left("all_", F.lit(0)) - left("all_", bit) - removed).alias("redundant"),
        (left("all_", rest) - left("all_", F.lit(SUBSETS - 1))).alias("unique_fails"),
        (left("good_", before) - left("good_", after)).alias("good_lost"),
        (left("toxic_", before) - left("toxic_", after)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, lang, text) and ``labels`` (doc_id, quality, toxic)."""
    folder = workspace(docs.sparkSession, "audit")
    return audit(written(survivors(labelled(judged(docs, folder), labels)), f"{folder}/survivors"))
