"""Packing token sequences by a grouping genetic algorithm.

Texts are tokenised where they lie and leave the task as lengths and checksums. A text longer than a
sequence is cut so that all its pieces but the first are whole sequences; what is left, at most
one piece a text, is packed. The pieces are dealt into cells of about ``CELL`` by a hash of their
running number. Each cell is packed on several islands: populations of packings whose
crossover takes over whole well-filled bins from one parent, removes the bins of the other
parent that hold the same pieces, and best-fits the displaced pieces, by ones and twos, into bins that
they fill. After an epoch each island's best packing migrates to the next island of its cell, which goes on with its
own population besides; the best of all after the last epoch counts. A cell is a row of bounded size, so islands run
anywhere.

Null text is an empty one: its end token alone. Repeated rows are packed each for itself. Other columns
of the input are not carried.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import workspace, written

SEQUENCE_TOKENS = 2048
END_ID = 0
CELL = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 12
#: Tasks that the islands of an epoch are dealt over, at most.
MOST_TASKS = 10_000
#: Pieces of text whose ids a task remembers.
REMEMBERED = 300_000


# --- tokens -----------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary.

    Bytes with a visible Latin-1 character stand for themselves, the others for 256, 257, ...
    """
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes.

    A word with the blank before it is always encoded alike, so it is encoded once and
    remembered. Texts with other white space than single blanks and line ends, or with the name of a special
    token, are encoded whole. New words are encoded by tiktoken from the same vocabulary, which is several times
    faster, if that is a plain byte-level one with ids in order of rank, and gives the tokenizer's own ids for
    the first of them; else by the tokenizer.
    """

    PART = re.compile(r"[ \n]?[^ \n]+")
    ODD = re.compile(
        "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    )

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.path = path
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        # In a byte-level vocabulary each character of a token stands for one byte.
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(self.vocabulary.values()) + 1, dtype=np.int64)
        for token, number in self.vocabulary.items():
            self.width[number] = len(token)
        self.known: dict[str, bytes] = {}
        self.fast = None
        self.tried = False

    def _ids(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(found, dtype="<u4")

    def _words(self, text: str) -> np.ndarray:
        if not self.tried:
            self.tried = True
            from tillcast.llm.backtracking import vocabulary  # which imports from here

            try:
                tables = vocabulary(self.path)
                merged = tables.id_of[256:]
                if merged == sorted(merged):
                    fast = tiktoken.Encoding(
                        "words",
                        pat_str=public_tokenizers.PATTERN,
                        mergeable_ranks=dict(zip(tables.spelling, tables.id_of)),
                        special_tokens={},
                    )
                    if fast.encode_ordinary(text) == self._ids(text).tolist():
                        self.fast = fast
            except (KeyError, ValueError):  # another kind of vocabulary
                pass
        if self.fast is None:
            return self._ids(text)
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")

    def _learn(self, parts: list[str]) -> None:
        """Encode the parts as one text and cut its ids where the parts end."""
        joined = [p for p in parts if p[0] in " \n"]
        for part in (p for p in parts if p[0] not in " \n"):
            self.known[part] = self._ids(part).tobytes()
        for i in range(0, len(joined), 4096):
            some = joined[i : i + 4096]
            ids = self._words("".join(some))
            ends = np.cumsum([len(p.encode()) for p in some])
            cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            data, at = ids.tobytes(), 0
            for part, cut in zip(some, (cuts * 4).tolist()):
                self.known[part] = data[at:cut]
                at = cut

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = []
        for text in texts:
            parts = self.PART.findall(text)
            blanks = text.count(" ") + text.count("\n")
            plain = blanks == len(parts) - (text[:1] not in ("", " ", "\n")) and not self.ODD.search(text)
            named = self.special is not None and self.special.search(text)
            split.append(parts if plain and not named else None)
        met: set[str] = set()
        for parts in split:
            met.update(parts or ())
        new = met.difference(self.known)
        if len(self.known) > REMEMBERED:  # what these texts have as well is frequent
            self.known = {p: self.known[p] for p in met - new}
        if new:
            self._learn(list(new))
        for text, parts in zip(texts, split):
            if parts is None:
                yield self._ids(text).tobytes()
            else:
                yield b"".join(map(self.known.__getitem__, parts))


@lru_cache(maxsize=1)
def remembered(path: str) -> Encoder:
    """The tokenizer and the words that one Python worker keeps from task to task."""
    return Encoder(path)


def _pieces(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(path)
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in _runs(batch.column(1)):
                texts = [x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts)):
                    ids += END_ID.to_bytes(4, "little")
                    total = len(ids) // 4
                    at, end, k = 0, (total - 1) % SEQUENCE_TOKENS + 1, 0
                    while at < total:
                        own = ids[4 * at : 4 * end]
                        doc.append(lo + i)
                        piece.append(k)
                        start.append(at)
                        length.append(end - at)
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            kept.append(own)
                        at, end, k = end, end + SEQUENCE_TOKENS, k + 1
                columns = {
                    "doc_id": batch.column(0).take(pa.array(doc, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "item": pa.array(np.arange(item, item + len(doc), dtype=np.int64)),
                }
                item += len(doc)
                if keep_ids:
                    columns["ids"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with a few megabytes of text; a longer text is a run of its own."""
    lo, size = 0, 0
    lengths = pc.binary_length(texts).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > 4 << 20:
            yield lo, i
            lo, size = i, 0
        size += n
    if len(lengths) > lo:
        yield lo, len(lengths)


def token_pieces(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """The pieces of every text, numbered by ``item``; with their ids if asked for.

    ``tokenizer`` is the path of the tokenizer's file, at the same place on every machine.
    ``item`` depends on how the rows are dealt: write the result before using it twice.
    """
    schema = docs.select("doc_id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("item", "long")):
        schema = schema.add(name, kind)
    if keep_ids:
        schema = schema.add("ids", "binary")
    own = docs.select("doc_id", F.col("text").cast("string"))
    return own.mapInArrow(_pieces(tokenizer, keep_ids), schema)


# --- one packing ---------------------------------------------------------------------


class Room:
    """Bins by free room; the tightest that still takes a piece is found by bits of one number."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for number, held in enumerate(bins):
            self._put(number, capacity - sum(map(sizes.__getitem__, held)))

    def _put(self, number: int, free: int) -> None:
        self.by_free[free].append(number)
        self.mask |= 1 << free

    def best_fit(self, pieces: list[int]) -> None:
        for piece in pieces:
            size = self.sizes[piece]
            fitting = self.mask >> size
            if fitting:
                free = size + (fitting & -fitting).bit_length() - 1
                number = self.by_free[free].pop()
                if not self.by_free[free]:
                    self.mask &= ~(1 << free)
            else:
                free, number = self.capacity, len(self.bins)
                self.bins.append([])
            self.bins[number].append(piece)
            self._put(number, free - size)


def fitness(bins: list[list[int]], sizes: list[int]) -> tuple[int, int]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum(sum(map(sizes.__getitem__, held)) ** 2 for held in bins)


def refit(bins: list[list[int]], displaced: list[int], sizes: list[int], capacity: int, dice: random.Random) -> None:
    """Add bins for the displaced pieces: the largest one, and what fits best beside it.

    Beside it go, again and again, the piece or the two pieces that leave the least room; now and then the
    second best, so that no two children are alike.
    """
    displaced = sorted(displaced, key=lambda piece: (sizes[piece], piece))
    width = np.array([sizes[piece] for piece in displaced], dtype=np.int64)
    names = np.array(displaced, dtype=np.int64)
    while len(names):
        held, room = [int(names[-1])], capacity - int(width[-1])
        width, names = width[:-1], names[:-1]
        while len(width) and width[0] <= room:
            few = int(np.searchsorted(width, room, side="right"))
            room_ = room - (dice.random() < 0.1)
            taken, best = [few - 1], int(width[few - 1])
            other = np.searchsorted(width[:few], room_ - width[:few], side="right") - 1
            pairs = np.flatnonzero(other > np.arange(few))
            if len(pairs):
                total = width[pairs] + width[other[pairs]]
                k = int(np.argmax(total))
                if total[k] > best:
                    best, taken = int(total[k]), [int(pairs[k]), int(other[pairs[k]])]
            held += names[taken].tolist()
            room -= best
            width, names = np.delete(width, taken), np.delete(names, taken)
        bins.append(held)


def crossed(one: list, other: list, sizes: list[int], capacity: int, dice: random.Random) -> list[list[int]]:
    """``one`` with some well-filled bins of ``other`` injected whole.

    Bins of ``one`` that hold an injected piece are dissolved, and so are, as a mutation, the emptiest ones and half of those
    that are not well filled. The displaced pieces are fitted into new bins.
    """

    def well(inside: list[int]) -> bool:
        return sum(map(sizes.__getitem__, inside)) >= capacity - capacity // 1024

    full = [held for held in other if well(held)]
    dice.shuffle(full)
    injected = full[: max(1, len(full) // 2)]
    held = {piece for inside in injected for piece in inside}
    bins, displaced, loose = [list(inside) for inside in injected], [], []
    for inside in one:
        if not held.isdisjoint(inside):
            displaced += [piece for piece in inside if piece not in held]
        elif well(inside):
            bins.append(list(inside))
        else:
            loose.append(inside)
    loose.sort(key=lambda inside: sum(map(sizes.__getitem__, inside)))
    for k, inside in enumerate(loose):
        if k < 4 or dice.random() < 0.5:
            displaced += inside
        else:
            bins.append(list(inside))
    refit(bins, displaced, sizes, capacity, dice)
    return bins


def evolved(
    sizes: list[int], seeds: list[list[list[int]]], capacity: int, dice: random.Random
) -> list[list[list[int]]]:
    """A population of packings that begins with ``seeds``, the best first."""
    least = -(-sum(sizes) // capacity)
    people = [(fitness(bins, sizes), bins) for bins in seeds]
    while len(people) < POPULATION and not any(-f[0] <= least for f, _ in people):
        swing = 0.3 * dice.random() if people else 0.0
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + swing * dice.random()))
        bins: list[list[int]] = []
        Room(bins, sizes, capacity).best_fit(order)
        people.append((fitness(bins, sizes), bins))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: p[0], reverse=True)
        if -people[0][0][0] <= least or len(people) < 2:
            break
        one, other = dice.sample(range(len(people)), 2)
        child = crossed(people[one][1], people[other][1], sizes, capacity, dice)
        people[-1] = max(people[-1], (fitness(child, sizes), child), key=lambda p: p[0])
    people.sort(key=lambda p: p[0], reverse=True)
    return [bins for _, bins in people[:POPULATION]]


# --- islands ----------------------------------------------------------------------------


def _epoch(capacity: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sizes = row["sizes"]
                seeds = []
                for plan in row["plans"]:
                    bins: list[list[int]] = [[] for _ in range(max(plan) + 1)]
                    for piece, at in enumerate(plan):
                        bins[at].append(piece)
                    seeds.append(bins)
                dice = random.Random(f"{row['cell']} {row['island']} {number}")
                people = evolved(sizes, seeds, capacity, dice)
                plans = []
                for bins in people:
                    plan = [0] * len(sizes)
                    for at, held in enumerate(bins):
                        for piece in held:
                            plan[piece] = at
                    plans.append(plan)
                out.append(
                    {"cell": row["cell"], "island": row["island"], "n_bins": len(people[0]), "plans": plans}
                )
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pylist(
                out,
                pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("n_bins", pa.int32()), ("plans", kind)]),
            )

    return run


def pack_items(items: DataFrame, folder: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """``item``, ``sequence_id``, ``offset`` for rows of (item, length), lengths up to ``capacity``.

    ``items`` must be fixed rows, such as a written table.
    """
    cells = max(1, -(-items.count() // CELL))
    cell = F.pmod(F.xxhash64("item"), F.lit(cells))
    table = written(
        items.groupBy(cell.alias("cell")).agg(
            F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("order"), "item"))).alias("pieces")
        ).select(
            "cell",
            F.col("pieces.item").alias("items"),
            F.transform("pieces.order", lambda x: (-x).cast("int")).alias("sizes"),
        ),
        f"{folder}/cells",
    )
    islands = table.select("cell", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    elite = None
    for number in range(EPOCHS):
        if elite is None:
            state = islands.withColumn("plans", F.array().cast("array<array<int>>"))
        else:
            # Every island goes on with its own population and the best packing of the island before it.
            own = elite.select("cell", "island", F.col("plans").alias("own"))
            came = elite.select(
                "cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("plans", 1, 1).alias("migrant")
            )
            state = (
                islands.join(own, ["cell", "island"])
                .join(came, ["cell", "island"])
                .withColumn("plans", F.concat("own", "migrant"))
            )
        # So many tasks whatever the size of the rows: an island is little data and much work.
        state = state.select("cell", "island", "sizes", "plans").repartition(min(cells * ISLANDS, MOST_TASKS), "cell", "island")
        elite = written(
            state.mapInArrow(
                _epoch(capacity, number), "cell bigint, island int, n_bins int, plans array<array<int>>"
            ),
            f"{folder}/epoch-{number}",
        )
    best = elite.groupBy("cell").agg(F.min_by(F.col("plans")[0], F.struct("n_bins", "island")).alias("plan"))
    placed = (
        table.join(best, "cell")
        .select("cell", F.explode(F.arrays_zip("items", "sizes", "plan")).alias("p"))
        .select(
            F.col("p.items").alias("item"),
            (F.shiftleft("cell", 20) + F.col("p.plan")).alias("sequence_id"),
            F.col("p.sizes").cast("long").alias("size"),
        )
    )
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("item", "sequence_id", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and its place there.

    Sequences of one whole piece have negative numbers.
    """
    folder = workspace(docs.sparkSession, "packing")
    pieces = written(token_pieces(docs, tokenizer, keep_ids), f"{folder}/pieces")
    whole = pieces.where(F.col("length") == SEQUENCE_TOKENS).select(
        "*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < SEQUENCE_TOKENS)
    packed = rest.join(pack_items(rest.select("item", "length"), folder), "item")
    return whole.unionByName(packed).drop("item")
