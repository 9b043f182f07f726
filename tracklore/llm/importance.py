"""Importance resampling towards a target distribution, with Arrow kernels.

Documents and target texts are seen as bags of hashed n-grams. A bucket's gain is the
logarithm of how much likelier the target holds it than the corpus does; a document's
weight is the mean gain of its features. Weights get Gumbel noise that depends on seed and
id alone, and the highest scores are drawn: a sample without replacement with
probabilities in proportion to exp(weight).

Method, per Arrow batch: ascii_lower and split_pattern_regex give words, list_flatten and
list_parent_indices lay them out with their texts, dictionary_encode names each distinct
word. Runs of two and more words are pairs of a shifted name and the name of the run
before it, named again by dictionary_encode, so only distinct runs are hashed (CRC-32,
carried on from the shorter run). Gains reach the features by ``take`` through the names,
and sums by segment (numpy's reduceat) give each text's weight.

Scale. Two passes over the texts, and no text is shuffled. The first sends one vector of
``buckets`` counts per task; sums over all tasks are ``buckets`` numbers, the only thing
that is broadcast. Scores are whole thousandths within a bounded range (weights between
the least and the largest gain, noise between -3,131 and 22,874), so a histogram of scores
is bounded too and gives the score where the draw ends. Only rows from there up are
sorted, and numbered where the sort left them (ranking.ranked).

Defined cases: a null or empty text has no features and the weight 0; documents with fewer
than ``least_words`` words are scored but never drawn; equal scores go to smaller ids, null
ids last; a null id is noise of the seed alone; rows equal in id and score get neighbouring
ranks; an empty target gives every bucket the gain its corpus count alone implies; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracklore.llm.ranking import ranked
from tracklore.llm.text_arrays import batches, prepare
from tracklore.session import stage

NGRAMS = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BATCH_BYTES = 4 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, the text each is of)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_SEPARATORS)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    filled = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(filled), parents.filter(filled).to_numpy()


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(name of each value, the distinct values)."""
    found = values.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def grams(texts: pa.Array, ngrams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1, 2 ... words: (name of each run, the text it is of, bucket of each name)."""
    words, parents = split_words(texts)
    word, distinct = encoded(words)
    raw = distinct.cast(pa.binary()).to_pylist()
    sums = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    run, own = word, parents
    yield run, own, sums % buckets
    for n in range(2, ngrams + 1):
        # A run of n - 1 words and the word after it, where that is of the same text.
        inside = np.flatnonzero(parents[: len(run) - 1] == parents[n - 1 :]) if len(run) > 1 else np.zeros(0, np.int64)
        pairs, own = run[inside] * len(raw) + word[inside + n - 1], parents[inside]
        short, pair = encoded(pa.array(pairs))
        head, tail = np.divmod(pair.to_numpy(), max(1, len(raw)))
        carried = [zlib.crc32(raw[t], zlib.crc32(b" ", c)) for c, t in zip(sums[head].tolist(), tail.tolist())]
        sums = np.array(carried, np.uint32)
        yield short, own, sums % buckets
        # Places in the next round are places of words: rows without a run keep no name.
        run = np.full(max(0, len(word) - n + 1), -1, np.int64)
        run[inside] = short


def count_buckets(texts: DataFrame, text_col: str, ngrams: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches(source):
            for names, _, bucket in grams(batch.column("text"), ngrams, buckets):
                times = np.bincount(names, minlength=len(bucket))
                held += np.bincount(bucket, times, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bucket", "n"])

    found = (
        texts.select(F.col(text_col).alias("text"))
        .mapInArrow(run, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
    )
    counts = np.zeros(buckets, np.int64)
    for row in found.collect():  # bounded: one row a bucket
        counts[row.bucket] = row.n
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    total, aim, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (total + n)) / ((s + 1) * (aim + n))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(seed: int, doc_id: str) -> int:
    """Thousandths of a Gumbel variate, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(gains, ngrams: int, seed: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            n = batch.num_rows
            features, sums, words = np.zeros(n, np.int64), np.zeros(n, np.int64), None
            for names, own, bucket in grams(batch.column("text"), ngrams, len(gains.value)):
                counts = np.bincount(own, minlength=n)
                words = counts if words is None else words
                features += counts
                if len(names):
                    gained = pa.array(gains.value).take(pa.array(bucket)).take(pa.array(names)).to_numpy()
                    filled = np.flatnonzero(counts)
                    starts = np.cumsum(counts) - counts
                    sums[filled] += np.add.reduceat(gained, starts[filled])
            weight = sums // np.maximum(features, 1)  # rounds down
            ids = batch.column("id").to_pylist()
            score = weight + np.array([noise(seed, i or "") for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (words, features, weight, score))],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row for each of ``docs``; the
    ``percent`` of documents with at least ``least_words`` words that are drawn have ranks
    1, 2, 3 ..., the others null."""
    spark = prepare(docs.sparkSession, _BATCH_BYTES)
    corpus = count_buckets(docs, text_col, ngrams, buckets)
    gains = spark.sparkContext.broadcast(gains_of(corpus, count_buckets(target, text_col, ngrams, buckets)))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(id_col).cast("string").alias("id"),
        F.col(text_col).alias("text"),
    ).mapInArrow(weigh(gains, ngrams, seed), f"doc_id {kind}, n_words long, n_features long, weight long, score long")
    rows = stage(rows, "scores")
    able = F.col("n_words") >= least_words
    histogram = rows.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    total = histogram.agg(F.sum("n")).first()[0] or 0
    drawn = total * percent // 100
    # Bounded by the range of scores, not by the rows.
    down_to = F.sum("n").over(Window.orderBy(F.desc("score")))
    edge = histogram.withColumn("down_to", down_to).filter(F.col("down_to") >= drawn).agg(F.max("score")).first()[0]
    near = able & (F.col("score") >= F.lit(edge).cast("long")) if drawn else F.lit(False)
    near = F.coalesce(near, F.lit(False))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    first = ranked(rows.filter(near), order, "rank")
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest)
