"""Toxicity scores by gradient-boosted trees over dense features, calibrated.

Features of a text: densities of a lexicon's words and stems, the share of lexicon words
with a second person within five words, capitals, punctuation, and obfuscation rates
(digits and signs for letters, letters drawn out, spelled words, mixed words).

The lexicon is learned: words, and stems of four bytes, that occur in labelled toxic texts
far more often than in others. Lexicon, trees (Spark ML) and calibration (isotonic
regression, Spark ML) are each fitted on a part of their own of at most ``SAMPLE``
labelled rows, those with the smallest hash of their id; that bound is a parameter, as is
the lexicon's size. Scoring covers every row in one pass without a shuffle.

Labels, language, source and id are never inputs of a score. Defined cases: a null or
empty text is scored like any other, from features that are all 0; rows with a null id or
label are not trained on; if the labels hold one class only, its value is every score;
without labels every score is 0; equal rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.language_id import held_out
from tracklore.llm.text_arrays import LOWER, U64, batches, flat, hasher, non_alphanumeric, prepare, words
from tracklore.session import stage

SAMPLE = 16_000
LEXICON = 512
THRESHOLD = 0.3
_STEM = 4
_NEAR = 5
_LEAST_TEXTS = 4
_LEAST_RATIO = 6.0

# Second-person words of the four languages.
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "deinen ihr euch euer tú ti usted ustedes vosotros tus"
).split()

# Digits and signs written for letters.
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = (
    "log_words lexicon lexicon_count stems near_second_person second_person capitals "
    "capital_words exclamations questions punctuation disguised drawn_out mixed spelled"
).split()

# A batch's features take some dozens of times its bytes.
_BATCH_BYTES = 2 << 20


def _plain() -> np.ndarray:
    """Bytes as read through the usual disguises."""
    table = LOWER.copy()
    for sign, letter in WRITTEN_FOR.items():
        table[ord(sign)] = ord(letter)
    return table


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hasher(60).words(data, starts, ends)


def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the first bytes of longer words; 0 for shorter ones."""
    out = np.zeros(len(starts), U64)
    long = np.flatnonzero(ends - starts > _STEM)
    out[long] = hasher(61).words(data, starts[long], starts[long] + _STEM)
    return out


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def term_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic, clean): texts of each label with a term, by batch."""
    for batch in batches(source):
        data, offsets = flat(batch.column("text"))
        data = LOWER[data]
        starts, ends, cuts = words(data, offsets, non_alphanumeric())
        text = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        for stem, values in ((False, _hashes(data, starts, ends)), (True, _stems(data, starts, ends))):
            there = values > 0
            pairs = np.unique(np.stack([values[there], text[there].astype(U64)]), axis=1)
            terms, at = np.unique(pairs[0], return_inverse=True)
            of = toxic[pairs[1].astype(np.int64)]
            yes = np.bincount(at, of, minlength=len(terms)).astype(np.int64)
            no = np.bincount(at, ~of, minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)), pa.array([stem] * len(terms)), pa.array(yes), pa.array(no)],
                ["term", "stem", "toxic", "clean"],
            )


def learn_lexicon(labelled: DataFrame, size: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, stem hashes), the most telling terms of (text, toxic) rows."""
    totals = labelled.agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = totals[0] or 0, totals[1] - (totals[0] or 0)
    ratio = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * ((clean + 1) / (toxic + 1))
    found = (
        labelled.select("text", "toxic")
        .mapInArrow(term_batches, "term long, stem boolean, toxic long, clean long")
        .groupBy("term", "stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= _LEAST_TEXTS)
        .withColumn("ratio", ratio)
        .filter(F.col("ratio") >= _LEAST_RATIO)
        .orderBy(F.desc("ratio"), "stem", "term")
        .limit(size)
        .collect()
    )
    pick = lambda stem: np.sort(np.array([r.term for r in found if r.stem == stem], np.int64).view(U64))
    return pick(False), pick(True)


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set in each range; no wider copy of the flags is made."""
    out = np.zeros(len(starts), np.int64)
    some = ends > starts
    if some.any():
        edges = np.stack([starts[some], ends[some]], axis=1).ravel()
        out[some] = np.add.reduceat(np.append(flags, False).view(np.int8), edges, dtype=np.int64)[::2]
    return out


def features(column: pa.Array, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = flat(column)
    low, plain = LOWER[data], _plain()[data]
    n = len(offsets) - 1
    starts, ends, cuts = words(low, offsets, non_alphanumeric())
    text = np.repeat(np.arange(n), np.diff(cuts))
    count = np.maximum(np.diff(cuts), 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text, flags, minlength=n).astype(float)

    running = lambda flags: np.r_[0, np.cumsum(flags)]

    def bytes_per_text(flags: np.ndarray) -> np.ndarray:
        return _counts(flags, offsets[:-1], offsets[1:]).astype(float)

    length = ends - starts
    values = _hashes(low, starts, ends)
    hit = _among(values, lexicon[0])
    stem = _among(_stems(low, starts, ends), lexicon[1]) & ~hit
    persons = SECOND_PERSON
    known = np.frombuffer("".join(persons).encode(), np.uint8)
    upto = np.cumsum([len(p.encode()) for p in persons])
    second = _among(values, np.sort(_hashes(known, np.r_[0, upto[:-1]], upto)))
    around = running(second)
    place = np.arange(len(starts))
    near = around[np.minimum(place + _NEAR + 1, cuts[1:][text])] - around[np.maximum(place - _NEAR, cuts[:-1][text])]
    any_hit = hit | stem

    # The same text read through disguises, signs for letters being part of words.
    separator = non_alphanumeric()
    separator[[ord(s) for s in WRITTEN_FOR]] = False
    s2, e2, c2 = words(data, offsets, separator)
    found = _among(_hashes(plain, s2, e2), lexicon[0]) & ~_among(_hashes(low, s2, e2), lexicon[0])
    disguised = np.bincount(np.repeat(np.arange(n), np.diff(c2)), found, minlength=n)

    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = ((low >= 97) & (low <= 122)) | (data >= 0x80)
    capital = (_counts(upper, starts, ends) == length) & (length >= 3)
    d, a = _counts(digit, starts, ends), _counts(letter, starts, ends)
    same = np.zeros(len(data), bool)
    same[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & (low[2:] < 0x80)
    single = (length == 1) & (a == 1)
    chain = running(single)
    spelled = single & (chain[np.minimum(place + 2, len(starts))] - chain[np.maximum(place - 1, 0)] == 3)
    sign = (data > 32) & (data < 0x80) & ~letter & ~digit
    size = np.maximum(np.diff(offsets), 1)
    hits = per_text(any_hit)
    columns = [
        np.log1p(np.diff(cuts)),
        per_text(hit) / count,
        np.minimum(hits, 20),
        per_text(stem) / count,
        per_text(any_hit & (near > 0)) / np.maximum(hits, 1),
        per_text(second) / count,
        bytes_per_text(upper) / np.maximum(bytes_per_text(letter), 1),
        per_text(capital) / count,
        bytes_per_text(data == 33) / count,
        bytes_per_text(data == 63) / count,
        bytes_per_text(sign) / size,
        disguised / count,
        per_text(_counts(same, starts, ends) > 0) / count,
        per_text((d > 0) & (a > 0)) / count,
        per_text(spelled) / count,
    ]
    return np.stack(columns, axis=1)


def feature_batches(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            table = features(batch.column("text"), shared.value)
            columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            columns |= {name: pa.array(table[:, i]) for i, name in enumerate(FEATURES)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def with_features(rows: DataFrame, shared) -> DataFrame:
    """``rows`` with the feature columns instead of ``text``."""
    schema = rows.drop("text").schema
    for name in FEATURES:
        schema = schema.add(name, "double")
    return rows.mapInArrow(feature_batches(shared), schema)


def labelled_sample(docs, labels, id_col, text_col, label_col, size) -> DataFrame:
    """(text, toxic, part): at most ``size`` labelled rows that are not held out."""
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .withColumn("_order", F.xxhash64("_id", F.lit("sample")))
        .orderBy("_order", "_id")
        .limit(size)
    )
    part = F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(10))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    return joined.select("text", "toxic", part.alias("part"))


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (as struct ``doc``, or of it the columns in ``carry``) with held_out, score,
    predicted."""
    spark = prepare(docs.sparkSession, _BATCH_BYTES)
    rows = docs.select(
        F.struct(*(carry or docs.columns)).alias("doc"),
        held_out(id_col).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    labelled = stage(labelled_sample(docs, labels, id_col, text_col, label_col, sample), "labelled")
    classes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    done = lambda s: s.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    if min(classes.get(0, 0), classes.get(1, 0)) < 10:
        # Too few of one class to fit anything: the share of toxic rows is the score.
        share = classes.get(1, 0) / max(1, sum(classes.values()))
        return done(rows.select("doc", "held_out", F.lit(float(share)).alias("score")))

    # Parts 0-5 for the lexicon, 6-8 for the trees, 9 for calibration.
    shared = spark.sparkContext.broadcast(learn_lexicon(labelled.filter("part < 6")))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fit = stage(vector.transform(with_features(labelled.filter("part >= 6"), shared)).select("features", "toxic", "part"), "features")
    trees = GBTClassifier(labelCol="toxic", maxIter=15, maxDepth=3, stepSize=0.3, seed=6, cacheNodeIds=False)
    trees = trees.fit(fit.filter("part < 9"))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    held = trees.transform(fit.filter("part = 9")).select(margin, "toxic")
    # Two anchors far out, so that the curve is defined and not flat without data there.
    held = held.union(spark.createDataFrame([(-50.0, 0), (50.0, 1)], held.schema))
    curve = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="score").fit(held)
    scored = trees.transform(vector.transform(with_features(rows, shared))).select("doc", "held_out", margin)
    scored = curve.transform(scored).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    return done(scored.select("doc", "held_out", "score"))
