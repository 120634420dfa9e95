"""A hashed maximum-entropy language model with classes.

The chance of a token is that of its class, given the tokens before it, times that of the token
in its class. Frequent words are classes of their own, the others share classes by a hash of their last two bytes.

* The class softmax has features of n-grams (one, two and three tokens back) and skips (the second,
  the third, the first with the third) of kinds of tokens, hashed into ``SLOTS`` slots; its weights are trained by
  gradient steps whose sums run in Spark over the counts of all training contexts.
* Pairs of whole words are features of their own, as many as the training texts have: the previous word with the class,
  and the previous word and the class with the word. Both are hashed into 64 bits. Pairs seen ``KEPT`` times or more are outcomes beside the
  one that stands for the coarser model (the class softmax, or the word's relative frequency in its class). No two contexts
  share such a weight, so the softmax over the outcomes of a context has its solution in the counts:
  ``(n - DISCOUNT) / (N + 1)`` for a pair, the rest for the coarser model.

A token that was never seen gets what the training tokens that occur once leave for it, so the chances of all known
tokens and of the unknown one add up to one.

Texts are laid out in blocks of some megabytes. A block hands on its distinct words, later its distinct pairs, as sorted and packed
64-bit keys with their training counts, cut at the limits of equal ranges of keys; a range sums them over all blocks and answers
each block in the order of its keys, so answers need no keys. A word or pair is there once a block, however frequent it is, and
ranges are as many as blocks, so neither a task nor the driver holds the vocabulary or the pairs. With more
ranges than a block has keys, this becomes a row a key. What reaches the driver is bounded by the numbers of classes, contexts and slots.
A context of pairs stays in one range: its entries, one a block and pair, meet in one task and are not split.

Null text is the end token alone. Rows with null ids are training rows. Repeated rows all count. A text longer than a block
is a block of its own. Without training rows the score is the base score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import (
    LOWER,
    byte_view,
    chunks,
    mixed,
    segment_sums,
    span_hashes,
    utf8,
    words,
    workspace,
    written,
)

BLOCK_BYTES = 16 << 20
END = np.uint64(1)  # the hash of the end token

SINGLE, SUFFIX = 64, 64  # classes of one word (the end token is class 0), classes of many
CLASSES = SINGLE + SUFFIX
NEAR, FAR = 32, 8  # kinds of the first two and of the third token back
CONTEXTS = FAR * NEAR * NEAR
SLOTS = 1 << 12
FEATURES = 7
STEPS = 15
RATE = 0.35
SHARDS = 8

ITEM_BITS = 28  # low bits of a pair's key: the class or word; the others are its context
KEPT = 2  # pairs seen so often are features
DISCOUNT = 0.5  # what a pair leaves of its count to the coarser model


# --- tokens of a run of texts -----------------------------------------------------------


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix hash of every word, and at which word each text begins."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    hashes[hashes == END] += np.uint64(1)
    last = data[ends - 1].astype(np.uint32)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint32)
    suffix = ((last * np.uint32(257) + before) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return hashes, suffix.astype(np.int64), first


@dataclass(frozen=True)
class Classes:
    """The words that are classes of their own, by frequency."""

    tops: np.ndarray  # their hashes; the end token is not among them

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the frequent words from 1, else 0."""
        order = np.argsort(self.tops)
        at = np.minimum(np.searchsorted(self.tops[order], hashes), max(len(order) - 1, 0))
        if not len(order):
            return np.zeros(len(hashes), dtype=np.int64)
        return np.where(self.tops[order][at] == hashes, order[at] + 1, 0)

    def kinds(self, hashes: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each word, and its kind as the near and the far context."""
        rank = self.ranks(hashes)
        own = np.where(rank > 0, rank, SINGLE + suffix % SUFFIX)
        near = np.where((rank > 0) & (rank < NEAR // 2), rank, NEAR // 2 + suffix % (NEAR // 2))
        return own, near, 1 + suffix % (FAR - 1)


def laid_out(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Values of words in one row, with a zero for the end token after each text."""
    out = np.zeros(len(values) + len(first) - 1, dtype=np.int64)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(values)) + text_of] = values
    return out


def contexts(near: np.ndarray, far: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context of every token; before a text there are end tokens."""
    lengths = np.diff(first) + 1
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(near)) - np.repeat(begins, lengths)

    def back(values: np.ndarray, k: int) -> np.ndarray:
        moved = np.concatenate((np.zeros(min(k, len(values)), np.int64), values[:-k]))
        return np.where(place >= k, moved, 0)

    return (back(far, 3) * NEAR + back(near, 2)) * NEAR + back(near, 1)


# --- passes over the texts ------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, utf8) with the number of their block."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        numbers = []
        for text in batch.column(2):
            width = text.as_buffer().size
            if size and size + width > BLOCK_BYTES:
                block, size = block + 1, 0
            size += width
            numbers.append(block)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "block"]
        )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one block after each other."""
    block = batch.column(batch.schema.get_field_index("block")).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(block[a]), batch.slice(a, b - a)


def _cells_of(context: np.ndarray) -> np.ndarray:
    return mixed(context) >> np.uint64(ITEM_BITS) << np.uint64(ITEM_BITS)


def pair_keys(hashed: np.ndarray, own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all tokens, the key of the previous word with the class, and of it and the class with the word."""
    begins = first[:-1] + np.arange(len(first) - 1)
    before = np.concatenate(([END], hashed[:-1]))
    before[begins] = END
    item = hashed >> np.uint64(64 - ITEM_BITS)
    kind = own.astype(np.uint64)
    of_class = _cells_of(before) | kind
    return of_class, _cells_of(before ^ mixed(kind + np.uint64(2))) | item


def tokens(classes: Classes, part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, class, near and far kind of every token, and at which word each text begins."""
    hashes, suffix, first = hashed_words(part, offsets)
    own, near, far = (laid_out(x, first) for x in classes.kinds(hashes, suffix))
    hashed = laid_out(hashes.view(np.int64), first).view(np.uint64)
    hashed[first[1:] + np.arange(len(first) - 1)] = END
    return hashed, own, near, far, first


# --- sums over all blocks, by ranges of keys -----------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all before the second ones, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges begins among sorted keys, and the end."""
    cells = np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - ITEM_BITS)
    limits = (cells + np.uint64(ranges - 1)) // np.uint64(ranges) << np.uint64(ITEM_BITS)
    return np.concatenate(([0], np.searchsorted(keys, limits), [len(keys)]))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of every value among them."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(values) else np.zeros(0, bool)
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], *(np.add.reduceat(v[order], firsts) if len(firsts) else v for v in values)


ASKED = "block bigint, range bigint, size bigint, keys binary, counts binary, marks binary"
REPLIES = "block bigint, kind int, range bigint, size bigint, reply binary"
#: Distinct keys that are held at most before they are handed on, and another part of the block begun.
HELD = 6_000_000


def _asking(ranges: int, keyed):
    """Rows (utf8, held_out, block) to packed distinct keys; ``keyed`` gives keys, marks and texts of a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block = None

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = summed(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            marks = np.zeros(len(keys), np.uint8)
            for known, _, mark in held:
                marks[np.searchsorted(keys, known)] = mark
            held.clear()
            cuts = range_cuts(keys, ranges)
            rows = [
                (block, r, b - a, packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(n[a:b]), packed(marks[a:b]))
                for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                if b > a
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            for i in range(0, len(rows), 64):
                columns = [pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64]), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "range", "size", "keys", "counts", "marks"])

        for batch in batches:
            for number, texts in _runs(batch):
                if held and number != block:
                    yield from flush()
                block = number
                data, offsets = byte_view(texts.column(0))
                out = texts.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for a, b, part in chunks(data, offsets):
                    keys, marks, text = keyed(part, offsets[a : b + 1] - offsets[a])
                    known, place = distinct(keys)
                    n = np.bincount(place, weights=(~out[a:b])[text], minlength=len(known)).astype(np.int64)
                    mark = np.zeros(len(known), np.uint8)
                    mark[place] = marks
                    held.append((known, n, mark))
                if sum(len(h[0]) for h in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _text_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)


def _as_words(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, suffix, first = hashed_words(part, offsets)
    ends = first[1:] + np.arange(len(first) - 1)
    hashed = laid_out(hashes.view(np.int64), first).view(np.uint64)
    hashed[ends] = END
    return hashed, laid_out(suffix % SUFFIX, first).astype(np.uint8), _text_of(first)


def _as_pairs(classes: Classes):
    def keyed(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashed, own, _, _, first = tokens(classes, part, offsets)
        of_class, of_word = pair_keys(hashed, own, first)
        many, text = own >= SINGLE, _text_of(first)
        keys = np.concatenate((of_class, of_word[many]))
        return keys, np.zeros(len(keys), np.uint8), np.concatenate((text, text[many]))

    return keyed


def _opened(asked: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Block, keys, counts and marks of the parts of a range, one after each other by block."""
    parts = []
    for row in asked.sort_by("block").to_pylist():
        keys = np.cumsum(unpacked(row["keys"], row["size"], np.uint64), dtype=np.uint64)
        counts, marks = unpacked(row["counts"], row["size"], np.int64), unpacked(row["marks"], row["size"], np.uint8)
        if parts and parts[-1][0] == row["block"]:  # a block that came in parts is answered as one
            _, more, n, mark = parts.pop()
            both, n = summed(np.concatenate((more, keys)), np.concatenate((n, counts)))
            out = np.zeros(len(both), np.uint8)
            out[np.searchsorted(both, more)], out[np.searchsorted(both, keys)] = mark, marks
            keys, counts, marks = both, n, out
        parts.append((row["block"], keys, counts, marks))
    return parts


def _replies(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "kind", "range", "size", "reply"]
    )


WORDS, PAIRS, TOP, TALLY = 0, 1, 2, 3


def _word_sums(asked: pa.Table) -> pa.Table:
    """A range of words to the counts for each block, its most frequent words, and its tokens by suffix."""
    number, parts = asked["range"][0].as_py(), _opened(asked)
    keys, n = summed(*(np.concatenate([p[k] for p in parts]) for k in (1, 2)))
    marks = np.zeros(len(keys), np.uint8)
    rows = []
    for block, asks, _, mark in parts:
        at = np.searchsorted(keys, asks)
        marks[at] = mark
        rows.append((block, WORDS, number, len(asks), packed(n[at])))
    words = np.flatnonzero((n > 0) & (keys != END))
    best = words[np.lexsort((keys[words].view(np.int64), -n[words]))[: SINGLE - 1]]
    if len(best):
        top = np.stack([keys[best].view(np.int64), n[best], marks[best].astype(np.int64)], axis=1)
        rows.append((None, TOP, number, len(best), top.tobytes()))
    tally = np.zeros(SUFFIX + 4, np.int64)
    tally[:SUFFIX] = np.bincount(marks[words], weights=n[words], minlength=SUFFIX)
    tally[SUFFIX:] = n.sum(), (n > 0).sum(), (n == 1).sum(), n[keys == END].sum()
    rows.append((None, TALLY, number, 1, tally.tobytes()))
    return _replies(rows)


def _merged(rows: Iterable) -> tuple[list[list[int]], np.ndarray]:
    """The most frequent words (hash, count, suffix) and the tally of several ranges."""
    best, tally = np.zeros((0, 3), np.int64), np.zeros(SUFFIX + 4, np.int64)
    for row in rows:
        numbers = np.frombuffer(row["reply"], np.int64)
        if row["kind"] == TALLY:
            tally += numbers
        else:
            best = np.concatenate((best, numbers.reshape(-1, 3)))
            best = best[np.lexsort((best[:, 0], -best[:, 1]))[: SINGLE - 1]]
    return best.tolist(), tally


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best, tally = _merged(row for batch in batches for row in batch.to_pylist())
    replies = [np.array(best, np.int64).tobytes(), tally.tobytes()]
    yield pa.RecordBatch.from_pydict(
        {"kind": pa.array([TOP, TALLY], pa.int32()), "reply": pa.array(replies, pa.binary())}
    )


def _pair_sums(asked: pa.Table) -> pa.Table:
    """A range of pairs to the answers for each block: which are features, their chances, and what each context leaves."""
    number, parts = asked["range"][0].as_py(), _opened(asked)
    keys, n = summed(*(np.concatenate([p[k] for p in parts]) for k in (1, 2)))
    pair, rest = outcomes(keys, n)
    rows = []
    for block, asks, _, _ in parts:
        at = np.searchsorted(keys, asks)
        chance, left = pair[at], rest[at][context_starts(asks)]
        known = chance > 0
        reply = np.packbits(known).tobytes() + left.tobytes() + chance[known].tobytes()
        rows.append((block, PAIRS, number, len(asks), pa.compress(reply, codec="zstd", asbytes=True)))
    return _replies(rows)


def context_starts(keys: np.ndarray) -> np.ndarray:
    """Whether each of the sorted keys is the first of its context."""
    cell = keys >> np.uint64(ITEM_BITS)
    return np.append(True, cell[1:] != cell[:-1]) if len(keys) else np.zeros(0, bool)


def outcomes(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys with all their counts: the chance of each pair in its context, and that of the coarser model."""
    starts = np.flatnonzero(context_starts(keys))
    kept = np.where(n >= KEPT, n - DISCOUNT, 0.0)
    sizes = np.diff(np.append(starts, len(keys)))
    total = np.repeat(np.add.reduceat(n, starts), sizes) + 1.0
    taken = np.repeat(np.add.reduceat(kept, starts), sizes)
    return (kept / total).astype(np.float32), ((total - taken) / total).astype(np.float32)


def _answered(keys: np.ndarray, replies: list[dict], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sorted distinct pairs of a block, what ``outcomes`` says of them."""
    pair, rest = np.zeros(len(keys)), np.ones(len(keys))
    cuts = range_cuts(keys, ranges)
    for row in replies:
        a, b = cuts[row["range"]], cuts[row["range"] + 1]
        n, starts = int(b - a), context_starts(keys[a:b])
        if n != row["size"]:
            raise ValueError("a block does not hold the pairs that were summed for it")
        contexts_, bits = int(starts.sum()), (n + 7) // 8
        # The number of features is only known from the bits, so the answer is opened as a stream.
        with pa.CompressedInputStream(pa.BufferReader(row["reply"]), "zstd") as stream:
            data = stream.read()
        known = np.unpackbits(np.frombuffer(data, np.uint8, bits), count=n).astype(bool)
        left = np.frombuffer(data, np.float32, contexts_, bits)
        pair[a:b][known] = np.frombuffer(data, np.float32, int(known.sum()), bits + 4 * contexts_)
        rest[a:b] = left[np.cumsum(starts) - 1]
    return pair, rest


def _cells(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Training rows (utf8) to how often each class follows each context."""
        total = np.zeros(CONTEXTS * CLASSES, dtype=np.int64)
        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            for a, b, part in chunks(data, offsets):
                hashes, suffix, first = hashed_words(part, offsets[a : b + 1] - offsets[a])
                own, near, far = (laid_out(x, first) for x in classes.kinds(hashes, suffix))
                cell, n = np.unique(contexts(near, far, first) * CLASSES + own, return_counts=True)
                total[cell] += n
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full // CLASSES), pa.array(full % CLASSES), pa.array(total[full])],
            names=["context", "class", "n"],
        )

    return run


# --- training ---------------------------------------------------------------------------------


def slots_of(context: np.ndarray) -> np.ndarray:
    """The slots of the features of each context: bias, n-grams, skips."""
    one, two, three = context % NEAR, context // NEAR % NEAR, context // NEAR // NEAR
    keys = np.stack(
        [
            np.zeros_like(context),
            one,
            two * NEAR + one,
            context,
            two,
            three,
            three * NEAR + one,
        ],
        axis=1,
    ).astype(np.uint64)
    keys = (keys * np.uint64(FEATURES) + np.arange(FEATURES, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    slots = (keys >> np.uint64(40)) % np.uint64(SLOTS - 1) + np.uint64(1)
    slots[:, 0] = 0  # the bias shares its slot with nothing
    return slots.astype(np.int64)


def class_logs(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural logarithm of the chance of every class in each context."""
    scores = weights[slots_of(context)].sum(axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _sums(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row: what the counts of this shard have and what the weights expect of every weight."""
        seen, expected = np.zeros((SLOTS, CLASSES)), np.zeros((SLOTS, CLASSES))
        for batch in batches:
            context, kind, count = (c.to_numpy() for c in batch.columns)
            context, at = np.unique(context, return_inverse=True)
            n = np.zeros((len(context), CLASSES))
            np.add.at(n, (at, kind), count)
            chance = np.exp(class_logs(handle.value, context)) * n.sum(axis=1, keepdims=True)
            slots = slots_of(context)
            for k in range(FEATURES):
                np.add.at(seen, slots[:, k], n)
                np.add.at(expected, slots[:, k], chance)
        yield pa.RecordBatch.from_pydict(
            {
                "seen": pa.array([seen.astype(np.float32).tobytes()], pa.binary()),
                "expected": pa.array([expected.astype(np.float32).tobytes()], pa.binary()),
            }
        )

    return run


def trained(cells: DataFrame, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights by slot and class from the fixed table ``cells`` (context, class, n).

    A step moves every weight along its gradient, seen less expected counts, in units of the
    counts. The shards' sums have the size of the model, whatever the size of the corpus.
    """
    spark = cells.sparkSession
    weights = np.zeros((SLOTS, CLASSES))
    for _ in range(steps):
        handle = spark.sparkContext.broadcast(weights)
        seen, expected = np.zeros(weights.shape), np.zeros(weights.shape)
        sums = cells.mapInArrow(_sums(handle), "seen binary, expected binary")
        for row in sums.collect():
            seen += np.frombuffer(row["seen"], np.float32).reshape(weights.shape)
            expected += np.frombuffer(row["expected"], np.float32).reshape(weights.shape)
        weights = weights + rate * (seen - expected) / (np.maximum(seen, expected) + 1)
        handle.destroy()
    return weights


# --- scoring -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    classes: Classes
    chances: np.ndarray  # of every class in every context
    class_totals: np.ndarray  # training tokens of each class
    tokens: int
    distinct: int
    once: int

    @property
    def unknown(self) -> float:
        """Chance of a token that was never seen."""
        return min(0.5, (self.once + 1) / (self.tokens + 2))


def _scorer(handle, ranges: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        model: Model = handle.value
        texts = [byte_view(chunk) for chunk in docs.combine_chunks()["utf8"].chunks]
        rows = sorted(replies.to_pylist(), key=lambda row: row["range"])
        runs = [
            (part, offsets[a : b + 1] - offsets[a]) for data, offsets in texts for a, b, part in chunks(data, offsets)
        ]
        # Texts are taken apart once; of each run stay its distinct keys and the places of its tokens among them.
        held = []
        for part, offsets in runs:
            hashed, own, near, far, first = tokens(model.classes, part, offsets)
            of_class, of_word = pair_keys(hashed, own, first)
            many = own >= SINGLE
            keys = np.concatenate((of_class, of_word[many])) if model.tokens else np.zeros(0, np.uint64)
            kind = contexts(near, far, first).astype(np.int16)
            held.append((*distinct(hashed), *distinct(keys), own.astype(np.uint8), kind, first))
        none = np.zeros(0, np.uint64)
        names = distinct(np.concatenate([none, *(h[0] for h in held)]))[0]
        pairs = distinct(np.concatenate([none, *(h[2] for h in held)]))[0]
        counts = [unpacked(r["reply"], r["size"], np.int64) for r in rows if r["kind"] == WORDS]
        counts = np.concatenate([np.zeros(0, np.int64), *counts])
        if len(counts) != len(names):
            raise ValueError("a block does not hold the words that were counted for it")
        pair, rest = _answered(pairs, [r for r in rows if r["kind"] == PAIRS], ranges)
        logs10 = np.log10((counts + 1) / (model.tokens + model.distinct + 1))
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for known_words, word, known_pairs, place, own, kind, first in held:
            at = np.searchsorted(names, known_words)
            c, base = counts[at][word], logs10[at][word]
            score = base
            if model.tokens:
                at = np.searchsorted(pairs, known_pairs)
                seen, left = pair[at][place], rest[at][place]
                n = len(own)
                chance = seen[:n] + left[:n] * model.chances[kind, own]
                share = np.maximum(c, 1) / np.maximum(model.class_totals[own], 1)
                many = own >= SINGLE
                share[many] = seen[n:] + left[n:] * share[many]
                known = c > 0
                score = np.full(n, np.log10(model.unknown))
                score[known] = np.log10(chance[known] * share[known] * (1 - model.unknown))
            begins = first[:-1] + np.arange(len(first) - 1)
            ends = first[1:] + np.arange(1, len(first))
            out["n_tokens"].append(ends - begins)
            out["n_known"].append(segment_sums((c > 0).astype(np.int64), begins, ends))
            out["base_score"].append(segment_sums(base, begins, ends))
            out["score"].append(segment_sums(score, begins, ends))
        columns = [docs["doc_id"], docs["held_out"]]
        for k in out:
            kind = np.float64 if k.endswith("score") else np.int64
            columns.append(pa.array(np.concatenate(out[k]).astype(kind) if out[k] else np.zeros(0, kind)))
        return pa.table(columns, names=["doc_id", "held_out", *out])

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, held_out, text) by a model of the rows not held out."""
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "maxent")
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("utf8", "binary").add("block", "long")
    laid = written(
        docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), utf8("text").alias("utf8")).mapInArrow(
            _blocks, schema
        ),
        f"{folder}/texts",
    )
    ranges = max(8, laid.select(F.count_distinct("block")).first()[0])
    texts = laid.select("utf8", "held_out", "block")

    def sums(keyed, add, name: str) -> DataFrame:
        asked = texts.mapInArrow(_asking(ranges, keyed), ASKED)
        return written(asked.groupBy("range").applyInArrow(add, REPLIES), f"{folder}/{name}")

    vocabulary = sums(_as_words, _word_sums, "vocabulary")
    statistics = vocabulary.where(F.col("kind").isin(TOP, TALLY)).select("kind", "reply").repartition(SHARDS)
    best, tally = _merged(statistics.mapInArrow(_merging, "kind int, reply binary").collect())
    classes = Classes(np.array([t[0] for t in best], dtype=np.int64).view(np.uint64))
    totals = np.zeros(CLASSES, dtype=np.int64)
    totals[SINGLE:] = tally[:SUFFIX]
    for place, (_, n, suffix) in enumerate(best, 1):
        totals[place] = n
        totals[SINGLE + suffix] -= n
    n_tokens, distinct_, once, totals[0] = tally[SUFFIX:].tolist()
    replies = vocabulary.where(F.col("kind") == WORDS)
    weights = np.zeros((SLOTS, CLASSES))
    if n_tokens:
        replies = replies.unionByName(sums(_as_pairs(classes), _pair_sums, "pairs"))
        cells = written(
            laid.where(~F.col("held_out"))
            .select("utf8")
            .mapInArrow(_cells(classes), "context bigint, class bigint, n bigint")
            .groupBy("context", "class")
            .agg(F.sum("n").alias("n"))
            .repartition(SHARDS)
            .sortWithinPartitions("context"),
            f"{folder}/cells",
        )
        weights = trained(cells)
    chances = np.exp(class_logs(weights, np.arange(CONTEXTS)))
    if n_tokens:  # classes without a training token have no chance
        chances[:, totals == 0] = 0
        chances /= chances.sum(axis=1, keepdims=True)
    handle = spark.sparkContext.broadcast(Model(classes, chances, totals, n_tokens, distinct_, once))
    schema = docs.select("doc_id").schema.add("held_out", "boolean")
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    scored = laid.groupBy("block").cogroup(replies.groupBy("block"))
    return scored.applyInArrow(_scorer(handle, ranges), schema).withColumn(
        "train_tokens", F.lit(n_tokens).cast("long")
    )
