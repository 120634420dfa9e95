"""What several of these operators need: a shared folder, and texts as byte arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the characters between words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Each byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text handled at once by the numpy code.
CHUNK_BYTES = 1 << 20


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine (``local`` or ``local[n]``) without that setting gets a
    temporary folder. Intermediate tables stay there for as long as a result may be read again;
    the owner of the checkpoint folder clears it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tillcast-llm-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once as Parquet and read back: fixed rows, short lineage."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: str | Column) -> Column:
    """Text as bytes, null as no bytes."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def byte_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array in one row, and where each value begins (one more at the end)."""
    if array.type == pa.binary():
        kind = np.int32
    elif array.type == pa.large_binary():
        kind = np.int64
    else:
        raise TypeError(f"not binary: {array.type}")
    _, starts, data = array.buffers()
    if len(array) == 0 or starts is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(starts, dtype=kind)[array.offset : array.offset + len(array) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of whole values with about ``CHUNK_BYTES`` bytes: first, last + 1, their bytes.

    A longer value is a run of its own.
    """
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]]
        first = last


def column_batches(
    batches: Iterable[pa.RecordBatch], names: list[str]
) -> Iterator[list[pa.Array]]:
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(name)) for name in names]


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values[start:end]`` for each pair; empty ones are zero."""
    out = np.zeros(len(starts), dtype=values.dtype)
    full = np.flatnonzero(ends > starts)
    if len(full):
        cuts = np.empty(2 * len(full), dtype=np.int64)
        cuts[0::2], cuts[1::2] = starts[full], ends[full]
        out[full] = np.add.reduceat(np.append(values, values.dtype.type(0)), cuts)[0::2]
    return out


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


_BASE = 0x100000001B3
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes have equal hashes wherever they are.

    A sum of bytes times powers, by differences of its prefix sums.
    """
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a run of texts, and at which word each text begins."""
    inside = ~SPACE[data]
    left = np.zeros(len(data) + 1, dtype=bool)
    left[1:] = inside
    left[offsets] = False
    right = np.zeros(len(data) + 1, dtype=bool)
    right[:-1] = inside
    right[offsets] = False
    starts = np.flatnonzero(inside & ~left[:-1])
    ends = np.flatnonzero(inside & ~right[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)
