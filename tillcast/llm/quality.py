"""Quality rules: counts of a text, and a classifier of hashed word and character n-grams.

The classifier is a logistic regression fitted on a bounded sample of labelled rows; its margin
is made a probability by a logistic curve fitted on labelled rows that the weights have not seen.
Texts are measured and scored whole, in Arrow batches, against fixed thresholds. There is no
shuffle of texts: the labelled sample is found by id first, and scoring is a map.

Null text counts as empty: no words, rejected by the base rules. Repeated rows are each scored.
Rows with null ids or labels other than 0 and 1 are not learnt from. Without labels of
both kinds there is no classifier and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import (
    byte_view,
    chunks,
    free_name,
    mixed,
    segment_sums,
    span_hashes,
    utf8,
    words,
)

WORD_BITS, CHAR_BITS = 16, 15
GRAM = 4  # bytes of a character n-gram
#: Labelled rows learnt from, of each kind. All are used if there are fewer.
SAMPLE_ROWS = 1_000
MIN_PROBABILITY = 0.1
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityModel:
    """Weights by slot (words, then characters), bias, and the curve from margin to probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -60, 60)))


# --- one run of whole texts ---------------------------------------------------


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """The counts of each text, and its words for the classifier."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    text_of = np.repeat(np.arange(n), np.diff(first))
    hashes = span_hashes(data, starts, ends)
    code_points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[data])))
    out = {
        "n_words": np.diff(first),
        "word_chars": np.bincount(
            text_of, weights=code_points[ends] - code_points[starts], minlength=n
        ).astype(np.int64),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _repeated_lines(data, offsets, starts),
        "n_repeat_words": _repeated_windows(hashes, text_of, n),
    }
    return out, (hashes, first)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(data))
    ends = np.where(np.isin(ends - 1, breaks, assume_unique=False), ends - 1, ends)
    ends = np.maximum(np.minimum(ends, offsets[text_of + 1]), starts)
    spoken = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, text_of = starts[spoken], ends[spoken], text_of[spoken]
    keys = mixed(span_hashes(data, starts, ends) ^ mixed(text_of.astype(np.uint64)))
    _, kept = np.unique(keys, return_index=True)
    return np.bincount(text_of, minlength=n) - np.bincount(text_of[kept], minlength=n)


def _repeated_windows(hashes: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Words inside a window of ``WINDOW`` words that occurs at least twice in the text."""
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return np.zeros(n, dtype=np.int64)
    keys = mixed(text_of[:count].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        keys = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k : k + count]
        keys ^= keys >> np.uint64(31)
    whole = text_of[:count] == text_of[WINDOW - 1 :]
    ordered = np.sort(keys[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(whole & np.isin(keys, twice))
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(text_of[np.cumsum(edge[:-1]) > 0], minlength=n)


def slots(data: np.ndarray, word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every word, and of the character n-gram at every byte."""
    of_words = (word_hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    wide = np.concatenate((data, np.zeros(GRAM, np.uint8))).astype(np.uint32)
    gram = wide[: len(data)].copy()
    for k in range(1, GRAM):
        gram |= wide[k : k + len(data)] << np.uint32(8 * k)
    gram = (gram * np.uint32(0x9E3779B1)) ^ (gram >> np.uint32(15))
    gram = (gram * np.uint32(0x85EBCA77)) >> np.uint32(32 - CHAR_BITS)
    return of_words, gram.astype(np.int32) + (1 << WORD_BITS)


def margins(
    data: np.ndarray, offsets: np.ndarray, found: tuple, model: QualityModel
) -> np.ndarray:
    """Bias, mean weight of the words and mean weight of the character n-grams."""
    hashes, first = found
    of_words, of_chars = slots(data, hashes)
    n_grams = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    by_word = segment_sums(model.weights[of_words], first[:-1], first[1:])
    by_char = segment_sums(model.weights[of_chars], offsets[:-1], offsets[:-1] + n_grams)
    return (
        model.bias
        + by_word / np.maximum(np.diff(first), 1)
        + by_char / np.maximum(n_grams, 1)
    )


# --- learning -------------------------------------------------------------------


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, folds = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i in range(batch.num_rows):
            data, offsets = byte_view(batch.column(0).slice(i, 1))
            starts, ends, _ = words(data, offsets)
            of_words, of_chars = slots(data, span_hashes(data, starts, ends))
            of_chars = of_chars[: max(len(data) - GRAM + 1, 0)]
            parts = [np.unique(x, return_counts=True) for x in (of_words, of_chars)]
            index = np.concatenate([p[0] for p in parts])
            share = np.concatenate([p[1] / max(p[1].sum(), 1) for p in parts])
            yield pa.RecordBatch.from_pydict(
                {
                    "label": pa.array([labels[i]], pa.int32()),
                    "fold": pa.array([folds[i]], pa.int32()),
                    "slots": pa.array([index.astype(np.int32).tobytes()], pa.binary()),
                    "shares": pa.array([share.astype(np.float32).tobytes()], pa.binary()),
                }
            )


def fit_quality_model(
    labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = 150
) -> QualityModel | None:
    """Learn from ``labelled`` (doc_id, text, quality); None without rows of both kinds.

    At most ``sample_rows`` rows of each kind, those with the smallest hash of their id, are
    learnt from. Their features are hashed in the executors; the rows that come to the driver
    are bounded by ``sample_rows`` and by the number of slots.
    """
    rows = labelled.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    rank = F.xxhash64(F.col("doc_id"), F.lit(17))
    chosen = None
    for kind in (0, 1):
        part = (
            rows.where(F.col("quality") == kind)
            .distinct()
            .orderBy(rank, "doc_id")
            .limit(sample_rows)
        )
        chosen = part if chosen is None else chosen.unionByName(part)
    # Every fourth row is for the probability curve.
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)))
    chosen = chosen.select("doc_id", "quality", "fold")
    table = (
        labelled.select("doc_id", "text")
        .join(chosen, "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .join(chosen, "doc_id")
        .select(utf8("text").alias("text"), F.col("quality").cast("int"), F.col("fold").cast("int"))
        .mapInArrow(_sparse, "label int, fold int, slots binary, shares binary")
        .toArrow()
    )
    label = table["label"].to_numpy()
    if len(np.unique(label)) < 2:
        return None
    index = [np.frombuffer(x, np.int32) for x in table["slots"].to_pylist()]
    share = [np.frombuffer(x, np.float32) for x in table["shares"].to_pylist()]
    order = np.lexsort(([x.tobytes() for x in index], label))  # not the order of arrival
    label, fold = label[order], table["fold"].to_numpy()[order]
    return _fit(label, fold, [index[i] for i in order], [share[i] for i in order], steps)


def _fit(
    label: np.ndarray, fold: np.ndarray, index: list, share: list, steps: int
) -> QualityModel:
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    slot = np.concatenate(index).astype(np.int64)
    value = np.concatenate(share).astype(np.float64)
    row = np.repeat(np.arange(len(label)), [len(x) for x in index])
    learn = (fold != 0).astype(np.float64)
    if len(np.unique(label[fold != 0])) < 2 or len(np.unique(label[fold == 0])) < 2:
        learn[:] = 1.0
    # Either kind counts as much as the other, however many rows it has.
    for kind in (0, 1):
        learn[label == kind] /= max(learn[label == kind].sum(), 1)
    weights, bias = np.zeros(size), 0.0
    squares, bias_square = np.full(size, 1e-12), 1e-12

    def scores() -> np.ndarray:
        return bias + np.bincount(row, weights=value * weights[slot], minlength=len(label))

    for _ in range(steps):
        slip = (label - 1 / (1 + np.exp(-np.clip(scores(), -60, 60)))) * learn
        slope = np.bincount(slot, weights=value * slip[row], minlength=size) - 1e-7 * weights
        squares += slope**2
        bias_square += slip.sum() ** 2
        weights += 2.0 * slope / np.sqrt(squares)
        bias += 0.2 * slip.sum() / np.sqrt(bias_square)
    margin = scores()
    seen = fold == 0 if len(np.unique(label[fold == 0])) == 2 else np.full(len(label), True)
    slope, shift = _curve(margin[seen], label[seen])
    return QualityModel(weights, bias, slope, shift)


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the labels, by Newton's method.

    Targets are drawn in from 0 and 1 a little, so that separable labels have a finite curve.
    """
    good = label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x = np.stack((margin / scale, np.ones(len(margin))))
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        grade = x @ (target - p) - 1e-6 * at
        bend = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        at = at + np.clip(np.linalg.solve(bend, grade), -2, 2)
    return float(at[0] / scale), float(at[1])


# --- scoring ----------------------------------------------------------------------


def _scorer(handle, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in batches:
            data, offsets = byte_view(batch.column(text_at))
            found: dict[str, list] = {name: [] for name in (*MEASURES, "probability")}
            for first, last, part in chunks(data, offsets):
                starts = offsets[first : last + 1] - offsets[first]
                counts, heard = measure(part, starts)
                for name in MEASURES:
                    found[name].append(counts[name].astype(np.int64))
                found["probability"].append(
                    np.ones(last - first)
                    if model is None
                    else model.probability(margins(part, starts, heard, model))
                )
            extra = {
                k: pa.array(np.concatenate(v) if v else [], pa.float64() if k == "probability" else pa.int64())
                for k, v in found.items()
            }
            kept = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), *extra.values()],
                names=[*(batch.schema.field(i).name for i in kept), *extra],
            )

    return run


def score_quality(
    docs: DataFrame, model: QualityModel | None, carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``carry`` columns of ``docs`` with the counts, ``probability``, ``base_failed``, ``kept``.

    ``model`` is sent to the tasks; its size is fixed by the number of slots.
    """
    text = free_name(docs, "utf8_text")
    handle = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in carry])
    for name in MEASURES:
        schema = schema.add(name, "long")
    scored = docs.select(*carry, utf8("text").alias(text)).mapInArrow(
        _scorer(handle, len(carry)), schema.add("probability", "double")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= MIN_PROBABILITY)
    )


def keep_good(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    own = docs.select([F.col(c) for c in docs.columns])
    payload = free_name(docs, "row")
    scored = score_quality(
        own.select(F.struct(*docs.columns).alias(payload), F.col("text")), model, (payload,)
    )
    return scored.where("kept").select(f"{payload}.*")
