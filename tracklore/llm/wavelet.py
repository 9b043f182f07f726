"""A wavelet matrix: a sequence of ids as bit-planes, compressed in one file.

Level by level, from the highest bit, a plane holds that bit of every id; ids with a clear
bit then come first, in order, and the rest after them. Ranks on the planes give the id at
any place, the number of occurrences of an id in any prefix and the place of its k-th
occurrence, without unpacking the sequence. In memory a directory of one count per 64 bits
serves the ranks; the file holds planes only, each compressed by itself.

File: ``MAGIC``, a length-prefixed JSON header (items, bits, sizes of parts), the parts.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"tracklore wavelet 1\n"


class Plane:
    """Bits with rank and select."""

    def __init__(self, packed: bytes, n: int):
        self.n = n
        padded = packed + bytes(8 - len(packed) % 8 + 8)
        self.words = np.frombuffer(padded, "<u8")
        counts = np.bitwise_count(self.words[:-1]).astype(np.int64)
        self.before = np.r_[0, np.cumsum(counts)]
        self.ones = int(self.before[-1])
        self.zeros = n - self.ones

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask).astype(np.int64)

    def select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """The place of the k-th set (or clear) bit, from 0."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.n, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            upto = self.rank1(np.minimum(middle + 1, self.n))
            upto = upto if bit else np.minimum(middle + 1, self.n) - upto
            right = (upto <= k) & (low < high)
            low = np.where(right, middle + 1, low)
            high = np.where(right, high, np.minimum(middle, high))
        return low


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: list[bytes]):
        self.n, self.bits, self.packed = n, bits, planes
        self._planes: list[Plane] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        rest, planes = np.asarray(ids, np.uint32), []
        if len(rest) and int(rest.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        for level in range(bits - 1, -1, -1):
            bit = (rest >> np.uint32(level)) & np.uint32(1) == 1
            planes.append(np.packbits(bit, bitorder="little").tobytes())
            rest = np.concatenate([rest[~bit], rest[bit]])
        return cls(len(rest), bits, planes)

    @property
    def planes(self) -> list[Plane]:
        if self._planes is None:
            self._planes = [Plane(p, self.n) for p in self.packed]
        return self._planes

    def all(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        out = np.zeros(self.n, np.uint32)
        for level, packed in enumerate(reversed(self.packed)):
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros = self.n - int(bit.sum())
            earlier = np.empty(self.n, np.uint32)
            earlier[~bit] = out[:zeros]
            earlier[bit] = out[zeros:] | np.uint32(1 << level)
            out = earlier
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such place")
        for plane in self.planes:
            bit = plane.get(at)
            ones = plane.rank1(at)
            out = out << np.uint32(1) | bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return out

    def _range(self, id_: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id in start..end lie below the last plane."""
        if id_ < 0 or id_ >> self.bits:
            return 0, 0
        ends = np.array([start, end], np.int64)
        for level, plane in enumerate(self.planes):
            ones = plane.rank1(ends)
            ends = plane.zeros + ones if id_ >> (self.bits - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, id_: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in start..end."""
        end = self.n if end is None else end
        low, high = self._range(id_, min(start, self.n), min(end, self.n))
        return max(0, high - low)

    def places(self, id_: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the occurrences number ``first`` up to before ``last`` of an id."""
        low, high = self._range(id_, 0, self.n)
        at = np.arange(low + first, high if last is None else min(high, low + last))
        for level in range(self.bits):
            plane = self.planes[self.bits - 1 - level]
            bit = bool(id_ >> level & 1)
            at = plane.select(at - plane.zeros if bit else at, bit)
        return at

    def to_bytes(self, **parts: bytes) -> bytes:
        """The file, with named parts of the caller's own."""
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pack(p) for p in self.packed] + [pack(p) for p in parts.values()]
        header = {"n": self.n, "bits": self.bits, "sizes": [len(b) for b in blobs], "parts": list(parts)}
        head = json.dumps(header).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *blobs])

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[WaveletMatrix, dict[str, bytes]]:
        if not raw.startswith(MAGIC):
            raise ValueError("not a wavelet file")
        at = len(MAGIC) + 4
        size = struct.unpack("<I", raw[at - 4 : at])[0]
        header = json.loads(raw[at : at + size])
        at += size
        blobs, unpack = [], zstandard.ZstdDecompressor().decompress
        for size in header["sizes"]:
            blobs.append(unpack(raw[at : at + size]))
            at += size
        planes = blobs[: header["bits"]]
        return cls(header["n"], header["bits"], planes), dict(zip(header["parts"], blobs[header["bits"] :]))
