"""Benchmark decontamination by suffix arrays of the training texts.

Each Arrow batch of documents is a shard with a suffix array over its words; every suffix
of every benchmark item is searched in it by bisection. A search gives the range of shard
suffixes that begin with the item's window of ``width`` words (or the whole item, if it
is shorter), hence all its places, and the longest verbatim match with its place.

A shard's array is sparse: it holds the suffixes that begin with at least as many
benchmark words as the shortest window has, since no other can begin a match. Words
outside the benchmark all count as one unknown word.

The benchmark comes in blocks of bounded size, each broadcast to one pass; between passes
the documents with what was found so far are written to the shared folder. No pass
shuffles anything, so documents that share a passage never meet in one task.

Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased.
Defined cases: a null or empty text has no words and no hits; an item without words
occurs nowhere; equal items are all reported; a null item id is reported as an empty text; equal rows give equal results; an empty
benchmark leaves everything clean; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.text_arrays import LOWER, batches, flat, non_alphanumeric, prepare, words
from tracklore.session import stage

WIDTH = 13
BLOCK_BYTES = 16 << 20
_STEP = 16


def split_words(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(all words, offsets by text)."""
    data, offsets = flat(column)
    data = LOWER[data]
    _, _, cuts = words(data, offsets, non_alphanumeric())
    text = np.where(non_alphanumeric()[data], np.uint8(0x20), data)
    # A space between texts, so that one split serves them all.
    return np.insert(text, offsets[1:-1], 0x20).tobytes().split(), cuts


class Block:
    """Benchmark items as word numbers, with each distinct window once."""

    def __init__(self, item_ids: list, texts: list, width: int = WIDTH):
        spelled, cuts = split_words(pa.array(texts, pa.large_string()))
        self.numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys(spelled))}
        self.words = np.array([self.numbers[w] for w in spelled] + [0] * _STEP, np.int32)
        self.item_ids = item_ids
        n = np.diff(cuts)
        # Every suffix: where it starts, how many words it has, which item it is of.
        self.starts = np.arange(len(spelled))
        self.item = np.repeat(np.arange(len(n)), n)
        self.lengths = cuts[1:][self.item] - self.starts
        self.window = np.minimum(n, width)[self.item]
        self.is_window = self.lengths >= self.window
        self.shortest = int(self.window.min()) if len(spelled) else 0
        self.longest = int(n.max()) if len(spelled) else 0


class SuffixArray:
    """Suffixes of a shard that begin with ``shortest`` known words, in order."""

    def __init__(self, shard: np.ndarray, cuts: np.ndarray, shortest: int, longest: int):
        """``shard``: word numbers, 0 for unknown, texts cut at ``cuts``."""
        # A zero after each text ends every match there.
        text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        self.shift = text  # place in padded text = place + number of texts before
        padded = np.zeros(len(shard) + len(cuts) + _STEP, np.int32)
        padded[np.arange(len(shard)) + text] = shard
        self.words = padded
        known = padded > 0
        # Distance from each place to the end of its run of known words.
        stops = np.flatnonzero(~known)
        run = stops[np.searchsorted(stops, np.arange(len(padded) - _STEP))] - np.arange(len(padded) - _STEP)
        enough = run >= max(shortest, 1)
        starts = np.flatnonzero(enough)
        # Ranks for suffixes at every place that a longer suffix reaches into.
        reach = np.zeros(len(padded) + 1, np.int64)
        np.add.at(reach, starts, 1)
        np.add.at(reach, starts + run[starts], -1)
        places = np.flatnonzero(np.cumsum(reach)[:-1] > 0)
        rank = np.zeros(len(padded) + 1, np.int64)
        rank[places] = padded[places]
        step = 1
        while len(places) and step < longest:
            ahead = np.minimum(places + step, len(padded))
            key = rank[places] * (len(padded) + int(padded.max()) + 2) + rank[ahead]
            values, inverse = np.unique(key, return_inverse=True)
            rank[places] = inverse + 1
            step *= 2
            if len(values) == len(places):
                break
        self.suffixes = starts[np.argsort(rank[starts], kind="stable")]

    def _compare(self, block: Block, queries: np.ndarray, limit: np.ndarray, suffixes: np.ndarray):
        """(sign of suffix - query over the first ``limit`` words, common words)."""
        sign = np.zeros(len(queries), np.int8)
        common = np.zeros(len(queries), np.int64)
        open_ = np.arange(len(queries))
        along = np.arange(_STEP)
        while len(open_):
            done = common[open_]
            q = np.minimum((block.starts[queries[open_]] + done)[:, None] + along, len(block.words) - 1)
            s = np.minimum((suffixes[open_] + done)[:, None] + along, len(self.words) - 1)
            within = along < (limit[open_] - done)[:, None]
            differ = (block.words[q] != self.words[s]) & within
            any_ = differ.any(axis=1)
            at = np.where(any_, differ.argmax(axis=1), within.sum(axis=1))
            common[open_] += at
            hit = np.flatnonzero(any_)
            sign[open_[hit]] = np.sign(self.words[s[hit, at[hit]]].astype(np.int64) - block.words[q[hit, at[hit]]])
            open_ = open_[~any_ & (common[open_] < limit[open_])]
        return sign, common

    def bounds(self, block: Block, queries: np.ndarray, limit: np.ndarray, upper: bool) -> np.ndarray:
        """Bisection for all queries at once."""
        low = np.zeros(len(queries), np.int64)
        high = np.full(len(queries), len(self.suffixes))
        while (active := np.flatnonzero(low < high)).size:
            middle = (low[active] + high[active]) // 2
            sign, _ = self._compare(block, queries[active], limit[active], self.suffixes[middle])
            right = sign <= 0 if upper else sign < 0
            low[active[right]] = middle[right] + 1
            high[active[~right]] = middle[~right]
        return low

    def longest_matches(self, block: Block, queries: np.ndarray):
        """(common words, place) of the best suffix for each query."""
        limit = block.lengths[queries]
        at = self.bounds(block, queries, limit, upper=False)
        best = np.zeros(len(queries), np.int64)
        place = np.zeros(len(queries), np.int64)
        for near in (at - 1, at):
            there = np.flatnonzero((near >= 0) & (near < len(self.suffixes)))
            found = self.suffixes[near[there]]
            _, common = self._compare(block, queries[there], limit[there], found)
            better = common > best[there]
            best[there[better]], place[there[better]] = common[better], found[better]
        return best, place


def _shard(batch: pa.RecordBatch, block: Block):
    spelled, cuts = split_words(batch.column("text"))
    get = block.numbers.get
    numbers = np.fromiter((get(w, 0) for w in spelled), np.int32, len(spelled))
    array = SuffixArray(numbers, cuts, block.shortest, block.longest)
    text_starts = cuts[:-1] + np.arange(len(cuts) - 1)
    return array, cuts, text_starts


def search_batches(shared, last: bool = False):
    """Add one block's hits to documents: merged word spans, and items with a hit window."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches(source):
            array, cuts, text_starts = _shard(batch, block)
            queries = np.flatnonzero(block.is_window) if len(block.starts) else np.zeros(0, np.int64)
            width = block.window[queries] if len(queries) else np.zeros(0, np.int64)
            low = array.bounds(block, queries, width, upper=False)
            high = array.bounds(block, queries, width, upper=True)
            some = np.flatnonzero(high > low)
            text_of, word_of, long_of, item_of = [], [], [], []
            for i in some.tolist():
                places = array.suffixes[low[i] : high[i]]
                text = np.searchsorted(text_starts, places, "right") - 1
                text_of.append(text)
                word_of.append(places - text_starts[text])
                long_of.append(np.full(len(places), width[i]))
                item_of.append(np.full(len(places), block.item[queries[i]]))
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            text_of, word_of, long_of, item_of = map(join, (text_of, word_of, long_of, item_of))
            order = np.argsort(text_of, kind="stable")
            text_of, word_of, long_of, item_of = (x[order] for x in (text_of, word_of, long_of, item_of))
            parts = np.searchsorted(text_of, np.arange(batch.num_rows + 1))
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for t in np.flatnonzero(np.diff(parts)).tolist():
                part = slice(parts[t], parts[t + 1])
                old = np.array(spans[t], np.int64).reshape(-1, 2)
                spans[t] = merge_spans(
                    np.r_[old[:, 0], word_of[part]], np.r_[old[:, 1], word_of[part] + long_of[part]]
                )
                items[t] = sorted({*items[t], *(block.item_ids[k] for k in np.unique(item_of[part]).tolist())})
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text" or not last}
            columns["n_words"] = pa.array(np.diff(cuts), pa.int64())
            columns["spans"] = pa.array(spans, pa.list_(pa.int64()))
            columns["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Half-open spans as one flat list, overlapping ones joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    return np.stack([starts[first], ends[last]], axis=1).ravel().tolist()


def blocks(benchmark: DataFrame, item_col="item_id", text_col="text", width=WIDTH, block_bytes=BLOCK_BYTES):
    """Blocks of whole items, each of about ``block_bytes`` of text."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for number in range(count):
        own = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == number).collect()
        yield Block([r.i for r in own], [r.t for r in own], width)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col="text",
    item_col="item_id",
    item_text_col="text",
    width: int = WIDTH,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (as struct ``doc``, or of it the columns in ``carry``) with n_words, n_hit,
    spans (of words), items, contaminated."""
    spark = prepare(docs.sparkSession)
    found = docs.select(
        F.struct(*(carry or docs.columns)).alias("doc"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<bigint>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    before = None
    for block in blocks(benchmark, item_col, item_text_col, width, block_bytes):
        if before is not None:
            found = stage(found.mapInArrow(search_batches(before), found.schema), "searched")
        before = spark.sparkContext.broadcast(block)
    found = found.mapInArrow(search_batches(before, last=True), found.drop("text").schema)
    hit = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    found = found.withColumn("n_hit", hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col="text", **options) -> DataFrame:
    """``docs`` without contaminated rows; all columns as they are."""
    return contamination(docs, benchmark, text_col, **options).filter("NOT contaminated").select("doc.*")


def match_batches(shared):
    """Longest match of every benchmark suffix in each shard."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches(source):
            array, _, text_starts = _shard(batch, block)
            queries = np.arange(len(block.starts))
            common, place = array.longest_matches(block, queries)
            some = np.flatnonzero(common)
            text = np.searchsorted(text_starts, place[some], "right") - 1
            item = block.item[some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.item_ids[k] for k in item.tolist()], pa.string()),
                    pa.array(block.starts[some] - np.searchsorted(block.item, item), pa.int64()),
                    pa.array(common[some], pa.int64()),
                    batch.column("id").take(pa.array(text)),
                    pa.array(place[some] - text_starts[text], pa.int64()),
                ],
                ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
            )

    return run


def longest_matches(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", width=1):
    """(item_id, item_word, n_words, doc_id, doc_word): for each benchmark suffix the longest
    verbatim match of at least ``width`` words over all shards, and one of its places."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    parts = None
    for block in blocks(benchmark, item_col, item_text_col, width):
        part = texts.mapInArrow(
            match_batches(spark.sparkContext.broadcast(block)),
            f"item_id string, item_word long, n_words long, doc_id {id_type}, doc_word long",
        )
        parts = part if parts is None else parts.unionByName(part)
    best = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct("n_words", -F.col("doc_word")))
    return parts.groupBy("item_id", "item_word").agg(best.alias("best")).select("item_id", "item_word", "best.*")
