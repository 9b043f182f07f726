"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the element-wise product of
its letters' vectors, each rotated by its place; a text is the sum of its trigrams; a
language's prototype is the sum over its training texts. A text gets the language of the
prototype with the largest cosine.

Training counts trigrams per language in Spark over all training texts and bundles each
language's counts in one task: there are at most 128**3 trigrams however large the
corpus. Prediction is one pass without a shuffle; a text's vector is one matrix product
over the distinct trigrams of a batch, whatever its length.

Only texts are inputs of a prediction. Letters are Unicode letters in lower case; ASCII
letters have a vector each, the others share 101 by code point. Trigrams lie inside
words, whose edges count as a letter. Defined cases: a null text, or one without letters,
is ``und`` with score 0; rows with a null id are never trained on; no training rows: all
``und``; equal cosines: the first language in alphabetical order; empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore.llm.text_arrays import batches, flat, prepare

WIDTH = 1024
UNKNOWN = "und"
# A text with a smaller cosine is rejected. Clean texts of a word or two come out low, so
# by default only texts without letters are.
REJECT_BELOW = 0.0
_SYMBOLS = 128
_OTHERS = 101
_TABLE = 0x33480
_TEXTS_AT_ONCE = 256
# Distinct trigrams of a batch are held as float vectors of the whole width.
BATCH_BYTES = 3 << 20


@functools.cache
def _symbols() -> np.ndarray:
    """Code point to symbol: 0 for non-letters, 1-26 for a-z, then the other letters."""
    out = np.zeros(_TABLE, np.uint8)
    for point in range(_TABLE):
        c = chr(point)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[point] = low - 96 if 97 <= low <= 122 else 27 + low % _OTHERS
    return out


@functools.cache
def _letters(width: int) -> np.ndarray:
    raw = np.frombuffer(hashlib.shake_256(b"letters").digest(_SYMBOLS * width // 8), np.uint8)
    return (np.unpackbits(raw).astype(np.int8) * 2 - 1).reshape(_SYMBOLS, width)


def trigram_vectors(codes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Bound vectors of trigram codes."""
    letters = _letters(width)
    out = np.roll(letters, 2, axis=1)[codes >> 14]
    out = out * np.roll(letters, 1, axis=1)[(codes >> 7) & 127]
    return out * letters[codes & 127]


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all trigrams, offsets by text)."""
    data, offsets = flat(column)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    point = padded[lead].astype(np.uint32)
    for low, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero((point >= low) & (point < 256) & (padded[lead] >= low))
        at = at[padded[lead[at]] < {2: 0xE0, 3: 0xF0, 4: 0xF8}[size]]
        value = padded[lead[at]].astype(np.uint32) & (0xFF >> (size + 1))
        for k in range(1, size):
            value = (value << 6) | (padded[lead[at] + k] & 0x3F)
        point[at] = value | 1 << 31  # marked, so that no later round takes it again
    point &= 0x7FFFFFFF
    point[point >= _TABLE] = 0
    symbol = _symbols()[point].astype(np.int32)
    cuts = np.searchsorted(lead, offsets)
    before, after = np.zeros_like(symbol), np.zeros_like(symbol)
    before[1:], after[:-1] = symbol[:-1], symbol[1:]
    full = np.flatnonzero(np.diff(cuts))
    before[cuts[:-1][full]] = 0
    after[cuts[1:][full] - 1] = 0
    middle = np.flatnonzero(symbol)
    codes = before[middle] << 14 | symbol[middle] << 7 | after[middle]
    return codes, np.searchsorted(middle, cuts)


def count_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of each batch."""
    for batch in batches(source):
        codes, cuts = trigrams(batch.column("text"))
        names = batch.column("lang").dictionary_encode()
        of_text = names.indices.to_numpy()
        of_code = np.repeat(of_text, np.diff(cuts))
        for i, name in enumerate(names.dictionary.to_pylist()):
            counts = np.bincount(codes[of_code == i])
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(counts[there])],
                ["lang", "code", "n"],
            )


def bundle(width: int):
    def run(table: pa.Table) -> pa.Table:
        codes, counts = table.column("code").to_numpy(), table.column("n").to_numpy().astype(float)
        total = np.zeros(width)
        for at in range(0, len(codes), 4096):
            total += counts[at : at + 4096] @ trigram_vectors(codes[at : at + 4096], width).astype(float)
        return pa.table({"lang": table.column("lang").slice(0, 1), "profile": [total.tolist()]})

    return run


def profiles(training: DataFrame, width: int = WIDTH) -> tuple[list[str], np.ndarray]:
    """(languages in order, their prototypes at length 1) from rows (text, lang)."""
    found = (
        training.select("text", "lang")
        .mapInArrow(count_batches, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .applyInArrow(bundle(width), "lang string, profile array<double>")
        .orderBy("lang")
        .collect()
    )
    table = np.array([r.profile for r in found], np.float32).reshape(len(found), width)
    return [r.lang for r in found], table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-30)


def predict_batches(shared, width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches(source):
            codes, cuts = trigrams(batch.column("text"))
            present = np.zeros(_SYMBOLS**3, bool)
            present[codes] = True
            distinct = np.flatnonzero(present)
            number = np.cumsum(present, dtype=np.int32) - 1
            codes = number[codes]
            vectors = trigram_vectors(distinct, width).astype(np.float32)
            best = np.zeros(batch.num_rows, np.int64)
            score = np.zeros(batch.num_rows)
            for low in range(0, batch.num_rows if len(names) and len(distinct) else 0, _TEXTS_AT_ONCE):
                high = min(low + _TEXTS_AT_ONCE, batch.num_rows)
                own = codes[cuts[low] : cuts[high]]
                text = np.repeat(np.arange(high - low), np.diff(cuts[low : high + 1]))
                counts = np.bincount(text * len(distinct) + own, minlength=(high - low) * len(distinct))
                sums = counts.reshape(high - low, -1).astype(np.float32) @ vectors
                cosine = (sums @ table.T) / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
                best[low:high] = cosine.argmax(axis=1)
                score[low:high] = cosine.max(axis=1)
            known = (np.diff(cuts) > 0) & bool(len(names))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            columns["lang_pred"] = pa.array(
                [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], pa.string()
            )
            columns["score"] = pa.array(np.where(known, np.clip(score, 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def held_out(id_col: str) -> Column:
    """Rows kept from training: the CRC-32 of the id's text leaves 2 modulo 4, or no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    width: int = WIDTH,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (as struct ``doc``, or of it the columns in ``carry``) with held_out,
    lang_pred, score; prototypes come from its own rows that are not held out."""
    spark = prepare(docs.sparkSession, BATCH_BYTES)
    training = docs.filter(~held_out(id_col)).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    learned = profiles(training.filter("lang IS NOT NULL AND text IS NOT NULL"), width)
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("doc"),
        held_out(id_col).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    schema = rows.select("doc", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(predict_batches(spark.sparkContext.broadcast(learned), width), schema)


def keep_known(docs: DataFrame, reject_below: float = REJECT_BELOW, **options) -> DataFrame:
    """``docs`` without rows that have no letters or are like no language."""
    found = identify(docs, **options)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= reject_below)).select("doc.*")
