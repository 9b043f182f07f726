"""Exact duplicates through content-defined chunk recipes.

Texts are equal when identical after replacing each run of white space by one space. A
normalised text is cut where a rolling hash of its last sixteen bytes has its low bits
clear, so equal passages are cut alike wherever they stand. A chunk's identifier is a
keyed 128-bit digest, verified: each distinct chunk moves once (a batch sends a chunk
once, however often it holds it) and chunks under one identifier are compared byte by
byte; should two differ, the key is changed and the pass repeated. A document is then its
recipe, the ordered list of verified identifiers, about one byte in a hundred; recipes are
compared, and long texts don't move again.

Of equal texts the row with the smallest id stays. Defined cases: null counts as empty;
empty texts equal one another; null ids come after all others; of rows that share the
smallest id exactly one stays; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.joins import free_name, join_groups
from tracklore.llm.text_arrays import batches, flat, hasher, prepare, spaces
from tracklore.session import stage

CHUNK_BITS = 11
CHUNK_MAX = 1 << 16
DIGEST_BYTES = 16
_TRIES = 20
_WINDOW = 16


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each run of white space replaced by one space."""
    space = spaces()[data]
    before = np.zeros_like(space)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep = ~(space & before)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    out = np.where(space, np.uint8(0x20), data)[keep]
    return out, total[offsets]


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(ends of chunks, number of chunks up to each text): none crosses two texts."""
    rolled = (hasher(70).byte_values >> np.uint64(32)).astype(np.uint32)[data]
    width = 1
    while width < _WINDOW:
        earlier = np.zeros_like(rolled)
        earlier[width:] = rolled[:-width] << np.uint32(width)
        rolled = rolled + earlier
        width *= 2
    ends = np.flatnonzero((rolled >> np.uint32(12)) & np.uint32((1 << bits) - 1) == 0) + 1
    # The window must lie inside the text, so that a cut depends on the text alone.
    text = np.searchsorted(offsets, ends, "left") - 1
    ends = ends[ends - offsets[text] >= _WINDOW]
    ends = np.unique(np.concatenate([ends, offsets[1:][np.diff(offsets) > 0]]))
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    if len(ends) and (ends - starts).max() > CHUNK_MAX:
        pieces = [np.arange(a + CHUNK_MAX, b, CHUNK_MAX) for a, b in zip(starts, ends) if b - a > CHUNK_MAX]
        ends = np.unique(np.concatenate([ends, *pieces]))
    return ends, np.searchsorted(ends, offsets[1:], "right")


def _chunks(batch: pa.RecordBatch, key: int, size: int):
    data, offsets = normalise(*flat(batch.column("text")))
    ends, upto = chunk_ends(data, offsets)
    raw, salt = data.tobytes(), key.to_bytes(8, "little")
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    digests = [hashlib.blake2b(p, digest_size=size, key=salt).digest() for p in pieces]
    return raw, offsets.tolist(), pieces, digests, [0, *upto.tolist()]


def recipe_batches(key: int, size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            raw, offsets, _, digests, cuts = _chunks(batch, key, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("_t"),
                    pa.array([b"".join(digests[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array(
                        [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])], pa.string()
                    ),
                ],
                ["id", "_t", "recipe", "text_sha256"],
            )

    return run


def chunk_batches(key: int, size: int):
    """Each distinct (digest, bytes) of a batch once."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            _, _, pieces, digests, _ = _chunks(batch, key, size)
            distinct = list(dict.fromkeys(zip(digests, pieces)))
            for at in range(0, len(distinct), 1000):
                part = distinct[at : at + 1000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in part], pa.binary()), pa.array([p for _, p in part], pa.binary())],
                    ["digest", "chunk"],
                )

    return run


def verified_key(texts: DataFrame, size: int = DIGEST_BYTES, first_key: int = 1) -> int:
    """A digest key under which no two different chunks of the corpus share an identifier."""
    for key in range(first_key, first_key + _TRIES):
        clash = (
            texts.select("text")
            .mapInArrow(chunk_batches(key, size), "digest binary, chunk binary")
            .repartition("digest")
            .dropDuplicates(["digest", "chunk"])
            .groupBy("digest")
            .count()
            .filter("count > 1")
        )
        if clash.isEmpty():
            return key
    raise ValueError(f"{size} bytes are too few to tell chunks apart")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    prepare(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("text")
    )
    key = verified_key(texts, digest_bytes)
    id_type = texts.schema["id"].dataType.simpleString()
    recipes = stage(
        texts.mapInArrow(
            recipe_batches(key, digest_bytes), f"id {id_type}, _t long, recipe binary, text_sha256 string"
        ).withColumn("row", F.monotonically_increasing_id()),
        "recipes",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    groups = stage(
        recipes.groupBy("recipe").agg(first.alias("keep"), F.count("*").alias("group_size")), "recipe_groups"
    )
    return join_groups(recipes, groups, "recipe", "group_size", recipes.count()).withColumn(
        "kept", F.col("row") == F.col("keep.row")
    )


def duplicates(docs: DataFrame, id_col="doc_id", text_col="text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    return _verdicts(docs, id_col, text_col, digest_bytes).select(
        F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", "kept", "text_sha256"
    )


def keep_first(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` without rows whose text an earlier row holds; all columns as they are."""
    key = free_name(docs, "_k")
    chosen = _verdicts(docs, id_col, text_col).filter("kept")
    chosen = chosen.select(F.struct(F.col("id"), F.col("_t").alias("t")).alias(key))
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t")))
    # Rows equal in id and text are one document. One key for both steps: texts move once.
    return keyed.join(chosen, key, "left_semi").dropDuplicates([key]).drop(key)
