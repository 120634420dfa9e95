"""Byte-level BPE by longest matches and a table of pairs that may stand side by side.

A word is not merged pair by pair. Aho-Corasick finds the longest token that begins at every
place. The encoder takes the longest one, goes on behind it, and keeps it only if merging would
leave a boundary between it and the token before; else it tries the next shorter prefix that is a
token, and if none is left takes back the token before. Places without a way on are marked, so
each is left once and the work grows with the length of the word. Whether a boundary stays is read
from the merge table: on both sides only tokens along the boundary matter, and the merge that
would cross it either comes before they grow on or never.

Ids are decoded by an offset table: all tokens' bytes in one row, and where each begins.

Only doc_id and text go through the tasks, a batch at a time in runs of some megabytes; a word takes
memory in proportion to its length. Null and empty texts have no ids. Repeated rows and null ids are
rows like others, other columns are not carried. Ids that the vocabulary lacks decode to nothing, null
ids to an empty text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tillcast.llm.packing import byte_alphabet

#: Words whose ids a task remembers, and the longest of them.
REMEMBERED = 300_000
REMEMBERED_CHARS = 64
#: Bytes of text or ids handled at once.
RUN_BYTES = 8 << 20
#: Libraries differ in what later versions of Unicode call a letter; up to here they can't.
LATER = re.compile("[\u0530-\U0010ffff]")


class Vocabulary:
    """Tables of a byte-level BPE vocabulary in the tokenizers library's JSON.

    Tokens are numbered by age: the single bytes, then one for each merge in order of rank.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if (
            model["type"] != "BPE"
            or spec["normalizer"]
            or any(cut.get(k) != v for k, v in plain.items())
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        byte = byte_alphabet()

        def spelled(token: str) -> bytes:
            return bytes(map(byte.__getitem__, token))

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = {spelled(token): number for token, number in model["vocab"].items()}
        self.spelling = [bytes([b]) for b in range(256)]
        self.age = {s: k for k, s in enumerate(self.spelling)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = self.age[spelled(left)], self.age[spelled(right)]
            whole = spelled(left) + spelled(right)
            if whole in self.age:
                raise ValueError(f"two merges make {whole!r}")
            self.joined[pair] = self.age[whole] = len(self.spelling)
            self.halves.append(pair)
            self.spelling.append(whole)
        self.id_of = [ids[s] for s in self.spelling]
        self.width = [len(s) for s in self.spelling]
        self.shorter = [self._prefix(s) for s in self.spelling]
        self.matches = ahocorasick.Automaton()
        for k, s in enumerate(self.spelling):
            self.matches.add_word(s.decode("latin-1"), k)
        self.matches.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._offsets(ids)

    def _prefix(self, spelling: bytes) -> int:
        """The longest token that begins this one, without itself; -1 for a single byte."""
        for n in range(len(spelling) - 1, 0, -1):
            if spelling[:n] in self.age:
                return self.age[spelling[:n]]
        return -1

    def _offsets(self, ids: dict[bytes, int]) -> None:
        bytes_of = {number: s for s, number in ids.items()}
        bytes_of |= {number: content.encode() for content, number in self.special.items()}
        tokens = [bytes_of.get(k, b"") for k in range(max(bytes_of) + 1)]
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.begins = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    @functools.cache  # noqa: B019  as long as the vocabulary
    def right_edge(self, token: int) -> tuple[int, ...]:
        """The tokens that end where this one ends, from its last byte up to itself."""
        halves = self.halves[token]
        return (token,) if halves is None else (*self.right_edge(halves[1]), token)

    @functools.cache  # noqa: B019
    def left_edge(self, token: int) -> tuple[int, ...]:
        """The tokens that begin where this one begins, from its first byte up to itself."""
        halves = self.halves[token]
        return (token,) if halves is None else (*self.left_edge(halves[0]), token)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging makes both of these tokens side by side.

        Both grow from the bytes at the boundary. A pair across it merges if its rank comes
        before its left half grows on, and not after its right half does: merges of the same rank go
        from left to right.
        """
        before, behind = self.right_edge(left), self.left_edge(right)
        i = j = 0
        never = len(self.spelling)
        while True:
            grows_left = before[i + 1] if i + 1 < len(before) else never
            grows_right = behind[j + 1] if j + 1 < len(behind) else never
            across = self.joined.get((before[i], behind[j]))
            if across is not None and across < grows_left and across <= grows_right:
                return False
            if grows_left == grows_right == never:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def encode(self, word: bytes) -> list[int]:
        """Ids of a word, as merging pair by pair would give them."""
        if word in self.age:
            return [self.id_of[self.age[word]]]
        n, width, shorter = len(word), self.width, self.shorter
        longest = [0] * n
        for end, token in self.matches.iter(word.decode("latin-1")):
            longest[end + 1 - width[token]] = token  # ends ascend: the last one is the longest
        closed = bytearray(n + 1)
        found: list[int] = []
        place, token = 0, longest[0] if n else -1
        while place < n:
            end = place + width[token]
            if not closed[end] and (not found or self.compatible(found[-1], token)):
                found.append(token)
                place = end
                token = longest[place] if place < n else -1
                continue
            token = shorter[token]
            while token < 0:  # no way on from here
                closed[place] = 1
                place -= width[found[-1]]
                token = shorter[found.pop()]
        return [self.id_of[t] for t in found]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes in a row."""
        ids = ids[(ids >= 0) & (ids < len(self.begins) - 1)]
        widths = self.begins[ids + 1] - self.begins[ids]
        total = int(widths.sum())
        shift = self.begins[ids] - (np.cumsum(widths) - widths)
        return self.data[np.repeat(shift, widths) + np.arange(total)].tobytes()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Texts:
    """Ids of texts, as little-endian 32-bit bytes; short words are encoded once and remembered."""

    def __init__(self, tables: Vocabulary):
        self.tables = tables
        self.known: dict[str, bytes] = {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        names = sorted(tables.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _words(self, text: str) -> list[str]:
        if LATER.search(text):
            return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _packed(self, word: str) -> bytes:
        return np.array(self.tables.encode(word.encode()), dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        words = self._words(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self._packed(word)
                if len(word) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(
            np.array([self.tables.special[part]], dtype="<u4").tobytes() if k % 2 else self._plain(part)
            for k, part in enumerate(self.special.split(text))
        )


def _runs(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices with about ``RUN_BYTES`` each, or one row."""
    done, first = np.cumsum(sizes), 0
    while first < batch.num_rows:
        begun = done[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(done, begun + RUN_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _encoding(path: str, packed: bool):
    kind = pa.binary() if packed else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(vocabulary(path))
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            for some in _runs(batch, sizes):
                ids = [texts.encode(t or "") for t in some.column(1).to_pylist()]
                ids = ids if packed else [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, kind)], names=["doc_id", "ids"])

    return run


def _decoding(path: str, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary(path)
        for batch in batches:
            count = pc.binary_length(batch.column(1)) if packed else pc.list_value_length(batch.column(1))
            for some in _runs(batch, 4 * count.fill_null(0).to_numpy(zero_copy_only=False)):
                if packed:
                    rows = [np.frombuffer(x or b"", dtype="<u4") for x in some.column(1).to_pylist()]
                else:
                    rows = [np.array([i for i in x or [] if i is not None]) for x in some.column(1).to_pylist()]
                texts = [tables.decode(r.astype(np.int64)).decode("utf-8", "replace") for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"]
                )

    return run


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode_texts(docs: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``docs`` (doc_id, text).

    Ids are an array, or ``packed`` as little-endian unsigned 32-bit integers. Names of the vocabulary's special
    tokens in a text become these tokens, none is added. The file lies at the same place on every machine.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = "binary" if packed else "array<int>"
    return own.mapInArrow(_encoding(path, packed), f"doc_id {_id_type(docs)}, ids {kind}")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``text`` of every row of ``encoded`` (doc_id, ids), special tokens by name.

    Bytes that are no UTF-8 become replacement characters.
    """
    kind = encoded.schema["ids"].dataType.simpleString()
    own = encoded.select("doc_id", "ids")
    schema = f"doc_id {_id_type(encoded)}, ids {kind}, text string"
    return own.mapInArrow(_decoding(path, kind == "binary"), schema)
