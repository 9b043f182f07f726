"""Whole texts of an Arrow batch as flat numpy arrays: bytes, words, hashes.

Every function works on all texts of a batch at once, without a Python object per word.
Word and window hashes are pure functions of the bytes, equal in every task and session.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracklore.session import configure

# Arrow batches are cut by bytes, as one text may be as large as a thousand others.
BATCH_BYTES = 8 << 20
_SEGMENT = 1 << 20
# Longer words are hashed by a keyed digest each.
_LONG_WORD = 24
U64 = np.uint64


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """Session settings that the operators here rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    # Shuffle files go when their query ends, not when the driver happens to collect garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def spaces() -> np.ndarray:
    """Bytes that separate words in most operators: [\\x20\\x09-\\x0D]."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def non_alphanumeric() -> np.ndarray:
    """Bytes outside digits, ASCII letters and non-ASCII characters."""
    table = np.ones(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """(starts, ends, per-text word offsets): no word crosses from one text to the next."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.cache
def hasher(seed: int) -> Hasher:
    return Hasher(seed)


def release() -> None:
    """Give back what earlier operators left in a worker that Spark uses again: the power
    tables of their hashes, and memory that Arrow keeps for later."""
    hasher.cache_clear()
    pa.default_memory_pool().release_unused()


class Hasher:
    """Two or more independent hashes of byte ranges and of sequences of hashes."""

    def __init__(self, seed: int):
        draw = np.frombuffer(hashlib.shake_256(f"tracklore {seed}".encode()).digest(8 * 260), U64)
        self.byte_values = draw[:256]
        self.key = draw[258:260].tobytes()
        self.base = draw[256] | U64(1)
        self.word_base = draw[257] | U64(1)
        self._powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _tables(self, base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of an odd base and of its inverse modulo 2**64."""
        power, inverse = self._powers.get(int(base), (np.ones(0, U64),) * 2)
        if len(power) < n:
            n = max(n, _SEGMENT + (_SEGMENT >> 2))
            power, inverse = np.full(n, base, U64), np.full(n, U64(pow(int(base), -1, 1 << 64)), U64)
            power[0] = inverse[0] = U64(1)
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            if n <= 4 * _SEGMENT:
                self._powers[int(base)] = power, inverse
        return power, inverse

    def _ranges(self, values, base, starts, ends):
        power, inverse = self._tables(base, len(values) + 1)
        total = np.empty(len(values) + 1, U64)
        total[0] = 0
        np.cumsum(values * power[: len(values)], out=total[1:])
        return (total[ends] - total[starts]) * inverse[starts]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each byte range; ranges are in order and don't overlap."""
        out = np.empty(len(starts), U64)
        at = 0
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + _SEGMENT, "right")))
            piece = self.byte_values[data[low : ends[to - 1]]]
            out[at:to] = self._ranges(piece, self.base, starts[at:to] - low, ends[at:to] - low)
            at = to
        # Powers of two make sums over long ranges meet for some texts, whatever the base.
        for i in np.flatnonzero(ends - starts > _LONG_WORD).tolist():
            raw = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=self.key).digest()
            out[i] = U64(int.from_bytes(raw, "little"))
        return mix(out + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """A hash for each run of ``width`` hashes; len(hashes) - width + 1 of them."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = np.empty(n, U64)
        for at in range(0, n, _SEGMENT):
            to = min(n, at + _SEGMENT)
            starts = np.arange(to - at)
            out[at:to] = self._ranges(hashes[at : to + width - 1], self.word_base, starts, starts + width)
        return mix(out + U64(width * 0xD1B54A32D192ED03 % (1 << 64)))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i]."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in source if b.num_rows)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over ``data`` (any fixed-width type) cut at ``offsets`` (in items)."""
    raw = np.ascontiguousarray(data)
    at = np.asarray(offsets, np.int64) * raw.itemsize
    if at[-1] < 1 << 31:
        return pa.Array.from_buffers(
            pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)]
        )
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
