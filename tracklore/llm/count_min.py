"""A count-min sketch built where the rows are and merged cell by cell.

Batches send only the cells they touch; a merging task holds one block of the sketch at a
time. What comes back is one bit a cell and threshold, so its size is bounded by the
number of cells, whatever the corpus. A bit is never clear for a key whose true count
reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklore.llm.text_arrays import U64, batches, binaries, mix

ROWS = 2
_BLOCKS = 256
_TOP = 255


def cells_for(entries: float, load: float, most: int) -> int:
    """Cells a row for ``entries`` keys at that load, a power of two, at most ``most``."""
    cells = 1 << 16
    while cells < most and cells * load < entries:
        cells *= 2
    return cells


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each 64-bit key in each row of the sketch."""
    mask = U64(cells - 1)
    other = mix(keys ^ U64(0xA0761D6478BD642F))
    return np.stack([(keys & mask), (other & mask) + U64(cells)])


PARTIAL = "block int, cells binary, counts binary"


def partial(keys: np.ndarray, cells: int) -> pa.RecordBatch:
    """The sketch of ``keys`` as touched cells by block."""
    touched, counts = np.unique(cells_of(keys, cells).ravel(), return_counts=True)
    size = ROWS * cells // _BLOCKS
    cuts = np.searchsorted(touched, np.arange(_BLOCKS + 1, dtype=U64) * U64(size))
    inner = (touched % U64(size)).astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(_BLOCKS, dtype=np.int32)),
            binaries(inner, cuts),
            binaries(np.minimum(counts, _TOP).astype(np.uint8), cuts),
        ],
        ["block", "cells", "counts"],
    )


def _merge(cells: int, thresholds: Sequence[int]):
    size = ROWS * cells // _BLOCKS

    def bits(block: int, counts: np.ndarray) -> pa.RecordBatch:
        packed = [np.packbits(counts >= t, bitorder="little").tobytes() for t in thresholds]
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([block], pa.int32()), "bits": pa.array([b"".join(packed)], pa.binary())}
        )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, None
        for batch in batches(source):
            for block, touched, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != current:
                    if current is not None:
                        yield bits(current, counts)
                    current, counts = block, np.zeros(size, np.uint16)
                at = np.frombuffer(touched, np.uint32)  # distinct within one partial sketch
                counts[at] = np.minimum(counts[at] + np.frombuffer(more, np.uint8), _TOP)
        if current is not None:
            yield bits(current, counts)

    return run


def merged(partials: DataFrame, cells: int, thresholds: Sequence[int] = (2,)) -> list[np.ndarray]:
    """For each threshold (255 at most), one bit a cell."""
    found = (
        partials.repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_merge(cells, thresholds), "block int, bits binary")
    )
    size = ROWS * cells // _BLOCKS // 8
    out = np.zeros((len(thresholds), _BLOCKS, size), np.uint8)
    for row in found.collect():  # bounded: one bit a cell and threshold
        out[:, row.block] = np.frombuffer(row.bits, np.uint8).reshape(len(thresholds), size)
    return list(out.reshape(len(thresholds), -1))


def reached(bits: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    """Whether the estimate of each key reaches the threshold of ``bits``."""
    at = cells_of(keys, cells)
    return ((bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1).all(axis=0)
