"""Importance resampling against a plain version, on hard small tables."""

import hashlib
import math
import random
import re
import zlib

from tracklore.llm import importance
from tracklore.llm.queries import QUERIES


def features(text, ngrams):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    runs = [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]
    return len(w), runs


def plain_resample(rows, target, ngrams=1, buckets=10000, seed=2024, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    split = [(i, *features(text, ngrams)) for i, text in rows]
    for _, _, runs in split:
        for f in runs:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, ngrams)[1]:
            t[bucket(f)] += 1
    total, aim = sum(s), sum(t)
    gain = [math.floor(1000 * math.log(((b + 1) * (total + buckets)) / ((a + 1) * (aim + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, words, runs in split:
        weight = sum(gain[bucket(f)] for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([words, i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[0] >= least), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[3], x[2]))
    rank = {id(x): k + 1 for k, x in enumerate(able[: len(able) * percent // 100])}
    return [(*x[1:], rank.get(id(x))) for x in out]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def hard_rows():
    draw = random.Random(12)
    pool = ["Alpha", "beta", "GAMMA", "ümt", "É", "漢字", "x1", "the", "of", "cat"]
    rows = [(i, " ".join(draw.choice(pool) for _ in range(draw.randrange(60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " .,;\n"), (903, "one"), (904, "-a--B- ~c"), (905, "the cat " * 30_000)]
    rows += [(906, "nul\x00byte 😀 " * 12), (7, "same id " * 15), (7, "same id " * 15), (None, "no id " * 20), (None, "no id " * 20)]
    return rows


TARGET = ["the cat of GAMMA 漢字", None, "", "alpha alpha beta"]


def test_resample(spark):
    rows = hard_rows()
    # Columns whose names the operator uses itself.
    docs = spark.createDataFrame([(*r, 1, "s", 0.5) for r in rows], "doc_id long, text string, rank int, id string, score double")
    docs = docs.repartition(4)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert order(importance.resample(docs, target).drop("n_words").collect()) == order(plain_resample(rows, TARGET))
    for ngrams, buckets, percent, least in ((2, 50, 100, 0), (4, 7, 33, 5)):
        got = importance.resample(docs, target, ngrams, buckets, 5, percent, least).drop("n_words")
        assert order(got.collect()) == order(plain_resample(rows, TARGET, ngrams, buckets, 5, percent, least))
    none = importance.resample(docs.filter("doc_id < 0"), target)
    assert none.count() == 0
    nothing = importance.resample(docs, target.limit(0)).drop("n_words")
    assert order(nothing.collect()) == order(plain_resample(rows, []))
    few = [(1, "a " * 30), (2, None)]
    got = importance.resample(spark.createDataFrame(few, "doc_id long, text string"), target).drop("n_words")
    assert order(got.collect()) == order(plain_resample(few, TARGET))


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_resampling"](spark, sf).collect()
    assert order(got) == order(plain_resample(docs, target))
