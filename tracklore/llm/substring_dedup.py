"""Removal of long passages that an earlier document already holds.

A window is ``window`` consecutive words of one document. Every word covered by a window
whose word sequence also starts in a document with a smaller id is removed; windows are
judged on the input.

Method: a count-min sketch as prefilter. Every Arrow batch of documents sketches its
windows; sketches are merged cell by cell. A window is represented in the sketch by its
rarest-looking part (the smallest hash among its sub-windows of half its length), so
neighbouring windows share one entry and the sketch needs about one cell in thirteen
words. Equal windows have equal representatives at different places, so the merged
sketch never says less than the true count. The second pass groups only windows whose
estimate is two or more, by two independent 64-bit hashes of all their words; none that
repeats is lost.

Scale. The sketch grows with the corpus up to ``MAX_CELLS`` cells a row (64 MB for both
rows); beyond that the hash space is cut into slices, one pass each, so a task never holds
more. Before the shuffle a batch reduces equal windows to those of its smallest document,
so a window found everywhere arrives once per batch. Buckets grow in number with the
corpus, which bounds each group.

Defined cases: a null or empty text has no words; one with fewer words than a window
keeps them all; rows with a null id count as later than all others and do not remove each
other; rows with the same id do not remove each other's words; equal rows give equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import count_min
from tracklore.llm.text_arrays import (
    U64,
    batches,
    binaries,
    flat,
    hasher,
    mix,
    prepare,
    ragged,
    spaces,
    words,
)

WINDOW = 50
MAX_CELLS = 1 << 28
_LOAD = 0.25
_BUCKET_BYTES = 1 << 20
_LAST = np.iinfo(np.int64).max


class Plan:
    """Sizes of one run, from the bytes of text."""

    def __init__(self, total_bytes: int, window: int, max_cells: int = MAX_CELLS):
        self.window = window
        self.part = max(1, window // 2)
        # A batch has two representatives per (window - part + 2) words of some 6 bytes.
        entries = total_bytes / 6 * 2 / (window - self.part + 2)
        self.cells = count_min.cells_for(entries, _LOAD, max_cells)
        self.slices = max(1, int(np.ceil(entries / self.cells / 2 / _LOAD)))
        self.buckets = max(1, int(np.ceil(total_bytes / _BUCKET_BYTES)))


def representatives(hashes: np.ndarray, word_offsets: np.ndarray, plan: Plan):
    """(window starts, their representative hashes, places of representatives)."""
    n = np.diff(word_offsets) - plan.window + 1
    starts = ragged(word_offsets[:-1][n > 0], n[n > 0])
    if not len(starts):
        return starts, np.zeros(0, U64), starts
    parts = hasher(40).windows(hashes, plan.part)
    view = sliding_window_view(parts, plan.window - plan.part + 1)
    least = np.empty(len(view), np.int32)
    for at in range(0, len(view), 1 << 17):
        least[at : at + (1 << 17)] = view[at : at + (1 << 17)].argmin(axis=1)
    places = starts + least[starts]
    return starts, parts[places], places


def in_slice(keys: np.ndarray, plan: Plan, number: int) -> np.ndarray:
    return (keys >> U64(36)) % U64(plan.slices) == U64(number)


def sketch_batches(plan: Plan, number: int):
    """Each batch's own sketch of its representatives, each place counted once."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets = flat(batch.column("text"))
            starts, ends, word_offsets = words(data, offsets, spaces())
            hashes = hasher(41).words(data, starts, ends)
            _, keys, places = representatives(hashes, word_offsets, plan)
            keys = keys[np.flatnonzero(np.diff(places, prepend=-1))]
            keys = keys[in_slice(keys, plan, number)]
            if len(keys):
                yield count_min.partial(keys, plan.cells)

    return run


def emit_windows(plan: Plan, number: int, sketch):
    """Windows estimated repeated, in one blob per bucket and batch.

    Of equal windows in a batch those of the smallest id stand for the batch; the others
    are removed whatever other batches hold and go out as such (bucket -1).
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets = flat(batch.column("text"))
            starts, ends, word_offsets = words(data, offsets, spaces())
            hashes = hasher(41).words(data, starts, ends)
            at, keys, _ = representatives(hashes, word_offsets, plan)
            keep = in_slice(keys, plan, number)
            keep[keep] = count_min.reached(sketch.value, keys[keep], plan.cells)
            at, keys = at[keep], keys[keep]
            if not len(at):
                continue
            h1 = hasher(42).windows(hashes, plan.window)[at]
            # Of other word hashes, so that two words that clash in the first don't here.
            other = hasher(44).words(data, starts, ends)
            h2 = hasher(43).windows(other, plan.window)[at]
            ref = (np.searchsorted(word_offsets, at, "right") - 1).astype(np.int32)
            ids = batch.column("k").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids[ref], h2, h1))
            h1, h2, ref, at, keys = h1[order], h2[order], ref[order], at[order], keys[order]
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            group = np.cumsum(new) - 1
            least = ids[ref[np.flatnonzero(new)]][group]
            # Neighbouring windows share a representative, hence a bucket.
            bucket = np.where(ids[ref] > least, -1, (mix(keys) % U64(plan.buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            bucket, h1, h2, ref = bucket[order], h1[order], h2[order], ref[order]
            place = (at[order] - word_offsets[ref]).astype(np.int32)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            texts = batch.column("t").to_numpy(zero_copy_only=False)
            for low, high in zip(cuts[:-1], cuts[1:]):
                own, short = np.unique(ref[low:high], return_inverse=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([bucket[low]], pa.int64()),
                        "h1": pa.array([h1[low:high].tobytes()], pa.binary()),
                        "h2": pa.array([h2[low:high].tobytes()], pa.binary()),
                        "ref": pa.array([short.astype(np.uint16).tobytes()], pa.binary()),
                        "place": pa.array([place[low:high].tobytes()], pa.binary()),
                        "ids": pa.array([ids[own].tobytes()], pa.binary()),
                        "texts": pa.array([texts[own].tobytes()], pa.binary()),
                    }
                )

    return run


_BLOB = "bucket long, h1 binary, h2 binary, ref binary, place binary, ids binary, texts binary"


def resolve(table: pa.Table) -> pa.Table:
    """Exact grouping within one bucket: places of windows that a smaller id also holds."""
    column = {name: table.column(name).to_pylist() for name in ("h1", "h2", "ref", "place", "ids", "texts")}
    sure = table.column("bucket")[0].as_py() < 0
    own = [len(x) // 8 for x in column["ids"]]
    shift = np.repeat(np.cumsum([0, *own[:-1]]), [len(x) // 2 for x in column["ref"]])
    join = lambda name, kind: np.frombuffer(b"".join(column[name]), kind)
    ids, texts = join("ids", np.int64), join("texts", np.int64)
    ref, place = join("ref", np.uint16) + shift, join("place", np.int32)
    if not sure:
        h1, h2 = join("h1", U64), join("h2", U64)
        order = np.lexsort((ids[ref], h2, h1))
        h1, h2, ref, place = h1[order], h2[order], ref[order], place[order]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        least = ids[ref[np.flatnonzero(new)]][np.cumsum(new) - 1]
        lost = ids[ref] > least
        ref, place = ref[lost], place[lost]
    order = np.argsort(ref, kind="stable")
    ref, place = ref[order], place[order]
    cuts = np.flatnonzero(np.r_[True, ref[1:] != ref[:-1], True]) if len(ref) else np.zeros(1, np.int64)
    first = ref[cuts[:-1]]
    return pa.table(
        {"k": pa.array(ids[first]), "t": pa.array(texts[first]), "places": binaries(place, cuts)},
        schema=pa.schema([("k", pa.int64()), ("t", pa.int64()), ("places", pa.binary())]),
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k"),
        F.xxhash64(F.col(text_col)).alias("t"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(id_col).alias("_id"),
    )


def repeated_places(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, max_cells=MAX_CELLS):
    """(k, t, places): for each text its starts of repeated windows, in words."""
    spark = prepare(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col).drop("_id")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(size, window, max_cells)
    found = []
    for number in range(plan.slices):
        partials = keyed.select("text").mapInArrow(sketch_batches(plan, number), count_min.PARTIAL)
        sketch = spark.sparkContext.broadcast(count_min.merged(partials, plan.cells)[0])
        found.append(keyed.mapInArrow(emit_windows(plan, number, sketch), _BLOB))
    blobs = found[0]
    for other in found[1:]:
        blobs = blobs.unionByName(other)
    # Sure removals need no partner, so they are dealt out in small groups of their own.
    dealt = F.when(F.col("bucket") < 0, F.xxhash64("ids", "place")).otherwise(0)
    return (
        blobs.withColumn("_deal", dealt)
        .groupBy("bucket", "_deal")
        .applyInArrow(resolve, "k long, t long, places binary")
        .groupBy("k", "t")
        .agg(F.collect_list("places").alias("places"))
    )


def cut_words(window: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            data, offsets = flat(batch.column("text"))
            starts, ends, word_offsets = words(data, offsets, spaces())
            places = batch.column("places").to_pylist()
            n_words = np.diff(word_offsets)
            removed, kept_hash, kept_text = [], [], []
            for i in range(batch.num_rows):
                a, b = starts[word_offsets[i] : word_offsets[i + 1]], ends[word_offsets[i] : word_offsets[i + 1]]
                gone = np.zeros(len(a) + 1, np.int64)
                for blob in places[i] or ():
                    p = np.frombuffer(blob, np.int32)
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                low = offsets[i]
                pieces = raw.split() if keep.all() else [raw[x:y] for x, y in zip(a[keep] - low, b[keep] - low)]
                text = b" ".join(pieces)
                removed.append(int(len(a) - keep.sum()))
                kept_hash.append(hashlib.sha256(text).hexdigest())
                kept_text.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept_hash, pa.string()),
                    pa.array(kept_text, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeated(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, max_cells=MAX_CELLS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text), one row per row of ``docs``."""
    places = repeated_places(docs, id_col, text_col, window, max_cells)
    id_type = docs.schema[id_col].dataType.simpleString()
    return (
        _keyed(docs, id_col, text_col)
        .join(places, ["k", "t"], "left")
        .select("_id", "text", "places")
        .mapInArrow(
            cut_words(window),
            f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string",
        )
    )
