"""Byte-level BPE by recursive queries.

Every task runs DuckDB over its own words. A word is rows of (word, position, token), at first one for each byte.
A recursive query joins neighbouring rows with the merge table, takes each word's pair of lowest rank, the
leftmost of them, contracts it, and goes on until no pair of any word is in the table. Ids are decoded by
joining them with the vocabulary and an ordered aggregation.

A text is cut into words by the tokenizer's pattern. A word is encoded once and remembered, and so is
what stands between two blanks, which the pattern always cuts alike. Nothing is shuffled; tasks work on a few
megabytes of text at a time and remember a bounded number of words; beyond it the rarer ones are forgotten.

The recursion keeps the rows of all rounds, about the square of a word's length. A word of more than ``LONG`` bytes is therefore
encoded as windows of ``WINDOW`` bytes, each of which begins in the middle of the one before, and its ids are the windows' ids up to and from a
token that both neighbours have at the same place. All neighbouring tokens then stand together in the ids of some window, and tokens of which
this holds are the ids of the whole. Neighbours without a common token become one window; if they are many, all are
taken wider, at last the word as a whole. Wide windows contract all places of the lowest pair in one round. A long word costs rows in
proportion to its length, and words go to DuckDB in runs of bounded rows.

Null and empty texts have no ids. Repeated rows are encoded each for itself. Other columns are not carried.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_BYTES = 4 << 20
REMEMBERED = 400_000
LONG = 64  # bytes of words that are encoded as a whole
WINDOW, WIDER = 32, 8  # bytes of the first windows of longer ones, and how many times wider the next ones are
APART = 0.2  # share of neighbours without a common token above which all windows are widened
STEP_ROWS = 12_000_000  # squares of lengths that go to one recursive query

# The rows of a word without a pair in the table come once more, as done.
ENCODE = """
WITH RECURSIVE step AS (
  SELECT word, place, token, 1 AS width, false AS done FROM bytes_of_words
  UNION ALL
  SELECT word, place, CASE WHEN place = first_place THEN merged ELSE token END,
         CASE WHEN place = first_place THEN width + second_width ELSE width END, first_place IS NULL
  FROM step LEFT JOIN (
    SELECT word, CAST(best >> 32 AS INTEGER) AS merged,
           CAST(best & 4294967295 AS INTEGER) AS first_place, second_place, second_width
    FROM (
      SELECT one.word, min(high | one.place) AS best, arg_min(two.place, high | one.place) AS second_place,
             arg_min(two.width, high | one.place) AS second_width
      FROM step one
      JOIN step two ON two.word = one.word AND two.place = one.place + one.width
      JOIN merges ON first_token = one.token AND second_token = two.token
      GROUP BY one.word
    )
  ) USING (word)
  WHERE NOT done AND (second_place IS NULL OR place <> second_place)
)
SELECT word, place, token FROM step WHERE done
"""

# The same with all places of a word's lowest pair in one round: of a run of pairs that overlap, every second one
# from the left.
ENCODE_WIDE = """
WITH RECURSIVE step AS (
  SELECT 0 AS round, word, place, token FROM bytes_of_words
  UNION ALL
  SELECT round + 1, word, place, CASE WHEN chosen THEN merged ELSE token END
  FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY place), false) AS swallowed
    FROM (
      SELECT *, hit AND (nth - min(nth) OVER (PARTITION BY word, hit, nth - nth_hit)) % 2 = 0 AS chosen
      FROM (
        SELECT *, row_number() OVER (PARTITION BY word, hit ORDER BY place) AS nth_hit
        FROM (
          SELECT *, coalesce(high = best, false) AS hit
          FROM (
            SELECT *, min(high) OVER (PARTITION BY word) AS best
            FROM (
              SELECT round, word, place, nth, token, high, CAST(high >> 32 AS INTEGER) AS merged
              FROM (
                SELECT *, lead(token) OVER (PARTITION BY word ORDER BY place) AS following,
                       row_number() OVER (PARTITION BY word ORDER BY place) AS nth
                FROM step
              ) LEFT JOIN merges ON first_token = token AND second_token = following
            )
          )
          WHERE best IS NOT NULL
        )
      )
    )
  )
  WHERE NOT swallowed
)
SELECT word, place, token FROM step
JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
"""

READ = """
SELECT word, string_agg(id_and_bytes, ' ' ORDER BY place)
FROM tokens JOIN (SELECT token, CAST(token AS VARCHAR) || ' ' || hex AS id_and_bytes FROM vocabulary) USING (token)
GROUP BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """DuckDB with the tables of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.con = duckdb.connect(
            config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""}  # nothing is spilled
        )
        halves = [
            (ranks[t[:i]], ranks[t[i:]], n)
            for t, n in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        columns = np.array(halves, dtype=np.int32).reshape(-1, 3).T
        # Ranks sit above the place in one number, so that its minimum is the leftmost lowest pair.
        self._table(
            "merges",
            {
                "first_token": pa.array(columns[0]),
                "second_token": pa.array(columns[1]),
                "high": pa.array(columns[2].astype(np.int64) << 32),
            },
        )
        self._table(
            "vocabulary",
            {
                "token": pa.array(list(ranks.values()), pa.int32()),
                "hex": pa.array([t.hex() for t in ranks]),
            },
        )
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def _table(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)
        self.con.register("rows_in", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.con.unregister("rows_in")

    def encode(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids, as decimal numbers with blanks between, and decoded bytes of each word."""
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(words)

        def read(numbers: list[int]) -> None:
            for word, row in self.con.execute(READ).fetchall():
                row = row.split(" ")
                out[numbers[word]] = " ".join(row[::2]).encode(), bytes.fromhex("".join(row[1::2]))

        short = [n for n, w in enumerate(words) if len(w) <= LONG]
        for run in _runs_of_rows(short, [len(words[n]) for n in short]):
            self._contract([words[n] for n in run], ENCODE)
            read(run)
        long = [n for n, w in enumerate(words) if len(w) > LONG]
        if long:
            found = self._long([words[n] for n in long])
            sizes = [len(ids) for _, ids in found]
            columns = {
                "word": pa.array(np.repeat(np.arange(len(long), dtype=np.int32), sizes)),
                "place": pa.array(np.concatenate([at for at, _ in found])),
                "token": pa.array(np.concatenate([ids for _, ids in found])),
            }
            self._table("tokens", columns)
            read(long)
        return out

    def _contract(self, words: list[bytes], query: str) -> None:
        """The table ``tokens``: word, place of the first byte and id of every token of ``words``."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        widths = np.array([len(w) for w in words], dtype=np.int64)
        begins = np.repeat(np.cumsum(widths) - widths, widths)
        self._table(
            "bytes_of_words",
            {
                "word": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), widths)),
                "place": pa.array((np.arange(len(data)) - begins).astype(np.int32)),
                "token": pa.array(self.of_byte[data]),
            },
        )
        self.con.execute(f"CREATE OR REPLACE TABLE tokens AS {query}")

    def _long(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and ids of the tokens of long words."""
        out: list = [None] * len(words)
        spans = [_spans(len(w), WINDOW) for w in words]
        widths = [WINDOW] * len(words)
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        waiting = list(range(len(words)))
        while waiting:
            # Equal windows, as in a word that repeats itself, are encoded once.
            new = sorted({words[n][a:b] for n in waiting for a, b in spans[n]} - known.keys(), key=len)
            for run in _runs_of_rows(list(range(len(new))), [len(w) for w in new]):
                some = [new[k] for k in run]
                self._contract(some, ENCODE if len(some[-1]) <= LONG else ENCODE_WIDE)
                rows = self.con.execute("SELECT word, place, token FROM tokens ORDER BY word, place").fetchnumpy()
                cuts = np.searchsorted(rows["word"], np.arange(len(run) + 1))
                known.update((w, (rows["place"][a:b], rows["token"][a:b])) for w, a, b in zip(some, cuts[:-1], cuts[1:]))
            left = []
            for n in waiting:
                found = [known[words[n][a:b]] for a, b in spans[n]]
                meet = _meetings(spans[n], found)
                apart = [k for k, at in enumerate(meet) if at is None]
                if not apart:
                    out[n] = _joined(spans[n], found, meet)
                elif len(apart) > APART * len(meet):
                    widths[n] *= WIDER
                    spans[n] = _spans(len(words[n]), widths[n])
                else:
                    spans[n] = _united(spans[n], apart)
                if apart:
                    left.append(n)
            waiting = left
        return out


def _spans(length: int, width: int) -> list[tuple[int, int]]:
    """Windows of a word, each from the middle of the one before."""
    half = width // 2
    return [(a, min(a + width, length)) for a in range(0, max(1, length - half), half)]


def _united(spans: list[tuple[int, int]], apart: list[int]) -> list[tuple[int, int]]:
    """``spans`` with one for each two neighbours that have no token in common."""
    out, k, apart_set = [], 0, set(apart)
    while k < len(spans):
        two = k in apart_set
        out.append((spans[k][0], spans[k + two][1]))
        k += 1 + two
    return out


def _meetings(spans: list[tuple[int, int]], found: list) -> list[tuple[int, int] | None]:
    """For each window but the last a token that the next one has too: its number in both, or nothing.

    A token is the same in both if it begins and ends at the same places. The last one of a window ends only
    because the window does.
    """
    out = []
    for (a, _), (b, _), (at, _), (follows, _) in zip(spans, spans[1:], found, found[1:]):
        first = int(np.searchsorted(at, b - a))
        own = at[first:] + (a - b)
        places = np.intersect1d(own, follows)
        pairs = []
        if len(places) > 1:
            x, y = np.searchsorted(own, places), np.searchsorted(follows, places)
            same = np.flatnonzero((np.diff(x) == 1) & (np.diff(y) == 1))
            pairs = [(first + int(x[k]), int(y[k])) for k in same]
        out.append(pairs[len(pairs) // 2] if pairs else None)
    return out


def _joined(spans: list, found: list, meet: list) -> tuple[np.ndarray, np.ndarray]:
    """Places and ids of a word, from window to window at the tokens where they meet."""
    places, ids, first = [], [], 0
    for (a, _), (at, tokens), (here, there) in zip(spans, found, [*meet, (None, None)]):
        last = None if here is None else here + 1
        places.append(at[first:last] + a)
        ids.append(tokens[first:last])
        first = there
        if first is not None:
            first += 1
    return np.concatenate(places).astype(np.int32), np.concatenate(ids).astype(np.int32)


def _runs_of_rows(items: list[int], widths: list[int]) -> Iterator[list[int]]:
    """``items`` in runs whose recursions keep a bounded number of rows; one item may have more."""
    run: list[int] = []
    size = 0
    for item, width in zip(items, widths):
        if run and size + width * width > STEP_ROWS:
            yield run
            run, size = [], 0
        run.append(item)
        size += width * width
    if run:
        yield run


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles: a run makes a million small lists and strings, none of them in a cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Numbers(dict):
    """Parts of texts by number; a part not met before gets the next one and is put down."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.new.append(part)
        return number


class Texts:
    """Ids and decoded bytes of texts, by words that are remembered."""

    PART = re.compile(r"[ \n]?[^ \n]+")
    ODD = re.compile(
        "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    )

    def __init__(self, codec: Codec):
        self.codec = codec
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.parts = Numbers()
        self.ids: list[bytes] = []  # of each part, by its number
        self.decoded: list[bytes] = []
        self.alone: list[bool] = []  # whether the part is one word
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the parts that are met most often, a quarter of those that may be remembered."""
        kept = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 4]
        kept = np.sort(kept[self.uses[kept] > 1])
        names = list(self.parts)
        self.parts = Numbers()
        self.parts.update((names[k], n) for n, k in enumerate(kept))
        self.ids, self.decoded, self.alone = ([held[k] for k in kept] for held in (self.ids, self.decoded, self.alone))
        self.uses = self.uses[kept] // 2
        self.words = {
            part: pair for part, *pair, one in zip(self.parts, self.ids, self.decoded, self.alone) if one
        }

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        if len(self.parts) > REMEMBERED or len(self.words) > REMEMBERED:
            self._forget()
        number = self.parts.__getitem__
        numbered = []
        for text in texts:
            parts = self.PART.findall(text)
            blanks = text.count(" ") + text.count("\n")
            # Runs of white space and rarer kinds of it are cut by the pattern itself.
            if blanks != len(parts) - (text[:1] not in ("", " ", "\n")) or self.ODD.search(text):
                parts = self.codec.pattern.findall(text)
            numbered.append(list(map(number, parts)))
        self._learn()
        met = np.bincount(np.fromiter(chain.from_iterable(numbered), np.int64), minlength=len(self.ids))
        met[: len(self.uses)] += self.uses
        self.uses = met
        for numbers in numbered:
            yield (
                b" ".join(map(self.ids.__getitem__, numbers)),
                b"".join(map(self.decoded.__getitem__, numbers)),
            )

    def _learn(self) -> None:
        """Ids and decoded bytes of the new parts, in order of their numbers."""
        cut = [self.codec.pattern.findall(p) for p in self.parts.new]
        self.parts.new = []
        unknown = sorted({w for ws in cut for w in ws} - self.words.keys())
        if unknown:
            self.words.update(zip(unknown, self.codec.encode([w.encode() for w in unknown])))
        for ws in cut:
            if len(ws) == 1:
                ids, decoded = self.words[ws[0]]
            else:
                found = [self.words[w] for w in ws]
                ids, decoded = b" ".join([f[0] for f in found]), b"".join([f[1] for f in found])
            self.ids.append(ids)
            self.decoded.append(decoded)
            self.alone.append(len(ws) == 1)


@lru_cache(maxsize=1)
def remembered(path: str, pattern: str) -> Texts:
    """The codec and the words that one Python worker keeps from task to task."""
    return Texts(Codec(read_ranks(path), pattern))


#: What can be had of a text, and its type.
COLUMNS = {
    "n_tokens": "bigint",
    "ids": "array<int>",
    "ids_sha256": "string",
    "decoded": "binary",
    "decoded_sha256": "string",
}


def _column(name: str, ids: bytes, decoded: bytes):
    if name == "n_tokens":
        return ids.count(b" ") + 1 if ids else 0
    if name == "ids":
        return [int(x) for x in ids.split()]
    if name == "decoded":
        return decoded
    return hashlib.sha256(ids if name == "ids_sha256" else decoded).hexdigest()


def _run(path: str, pattern: str, columns: tuple[str, ...]):
    kinds = {
        "n_tokens": pa.int64(),
        "ids": pa.list_(pa.int32()),
        "ids_sha256": pa.string(),
        "decoded": pa.binary(),
        "decoded_sha256": pa.string(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = None
        for batch in batches:
            texts = texts or remembered(path, pattern)
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
            first = 0
            while first < batch.num_rows:
                done = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, done + RUN_BYTES, side="right")))
                some = batch.slice(first, last - first)
                with uncollected():
                    found = list(texts.encode([x or "" for x in some.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0)]
                    + [pa.array([_column(c, *f) for f in found], kinds[c]) for c in columns],
                    names=["doc_id", *columns],
                )
                first = last

    return run


def encode_and_decode(
    docs: DataFrame, ranks_path: str, pattern: str, columns: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """``doc_id`` and the asked for ``COLUMNS`` of every row of ``docs`` (doc_id, text).

    ``decoded`` comes from the ids, not from the text. The rank file lies at the same place on every machine.
    """
    schema = docs.select("doc_id").schema.simpleString()[len("struct<") : -1]
    schema = ", ".join([schema.replace(":", " ", 1), *(f"{c} {COLUMNS[c]}" for c in columns)])
    own = docs.select("doc_id", F.col("text").cast("string"))
    return own.mapInArrow(_run(ranks_path, pattern, tuple(columns)), schema)
