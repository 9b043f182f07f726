"""Periodic runs against a plain version, on hard small tables."""

import hashlib
import random
import zlib

import numpy as np

from tracklore.llm import periodic_runs
from tracklore.llm.queries import QUERIES


def plain_runs(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q):
                found.setdefault((i, length), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def collapsed(w, runs):
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def plain_row(doc_id, text):
    w = planted(doc_id, text)
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *four, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(w, runs)).hexdigest())


def words_of(draw):
    """Runs of many periods, nested, touching and spoilt here and there."""
    w = []
    for _ in range(draw.randrange(1, 6)):
        root = [draw.choice("abc") for _ in range(draw.choice([1, 1, 2, 3, 4, 6, 8, 13, 16, 31]))]
        if draw.random() < 0.3:
            root = root * draw.randrange(2, 4)
        w += (root * draw.randrange(1, 12))[: draw.randrange(1, 200)]
        w += [draw.choice("abcd") for _ in range(draw.randrange(4))]
    if draw.random() < 0.3:
        w[draw.randrange(len(w))] = "z"
    return w


def test_tiles():
    draw = random.Random(13)
    lists = [words_of(draw) for _ in range(400)] + [["a"] * n for n in (0, 1, 5, 6, 7, 64)] + [list("ab") * 40, list("aab") * 33]
    codes = {x: i for i, x in enumerate(sorted({x for w in lists for x in w}))}
    names = np.array([codes[x] for w in lists for x in w])
    tiles = periodic_runs.Tiles(names, np.array([len(w) for w in lists]))
    got = [[] for _ in lists]
    for k, q, s, e in zip(*tiles.fragments()):
        got[k].append((s, e - s + q, q))
    for w, runs in zip(lists, got):
        assert sorted(runs) == plain_runs(w)


def hard_rows():
    draw = random.Random(14)
    rows = [(i, " ".join(words_of(draw))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "é " * 6), (905, "漢 字 " * 400), (906, "a  b\na\tb a b a b")]
    rows += [(7, "x y " * 9), (7, "x y " * 9), (None, "n n n n n n n"), (None, "n n n n n n n"), (None, None)]
    rows += [(1000 + k, " ".join(words_of(draw) * 7)) for k in range(20)]
    return rows


def test_find_runs(spark):
    rows = hard_rows()
    schema = "doc_id long, text string, row int, period string, runs double"  # names the operator uses
    docs = spark.createDataFrame([(*r, 1, "p", 0.5) for r in rows], schema).repartition(3)
    key = lambda r: repr(r)
    want = sorted(
        ((i, len((t or "").split()), plain_runs((t or "").encode().split())) for i, t in rows), key=key
    )
    for tile in (periodic_runs.TILE, 8, 32):  # whole documents, and documents in many tiles
        found = periodic_runs.find_runs(docs, tile=tile).collect()
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in found), key=key) == want
        for r in found:
            if r.collapsed is not None:
                assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    sums = sorted((str(i), hashlib.sha256(collapsed(w := (t or "").encode().split(), plain_runs(w))).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.collapsed_sha256) for r in found) == sums
    higher = periodic_runs.find_runs(docs, exponent=6, least=20, tile=16).collect()
    want = sorted(((i, plain_runs((t or "").encode().split(), 6, 20)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in higher), key=key) == want
    assert periodic_runs.find_runs(docs.filter("doc_id < 0")).count() == 0


def test_very_long_text(spark):
    """Many tiles of one text, with runs longer than every tile."""
    draw = random.Random(15)
    w = [f"w{draw.randrange(50)}" for _ in range(600)]
    w += w[:150] * 6 + ["x"] * 1200 + [f"w{draw.randrange(50)}" for _ in range(500)] + w[5:9] * 700
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    found = periodic_runs.find_runs(docs, tile=64).first()
    assert [tuple(r) for r in found.runs] == plain_runs(w)
    assert found.collapsed.split() == collapsed([x.encode() for x in w], plain_runs(w)).decode().split()


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()), key=repr)
    short = {i for i, t in rows if len((t or "").split()) <= 800}
    want = sorted((plain_row(i, t) for i, t in rows if i in short), key=repr)
    assert len(got) == len(rows) and [r for r in got if r[0] in short] == want
