"""Each corpus operator against its plain version, on hard small tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from tracklore.llm import (
    bpe,
    components,
    decontaminate,
    exact_dedup,
    language_id,
    near_dedup,
    private_data,
    substring_dedup,
    token_shards,
    toxicity,
)
from tracklore.llm.queries import vocabulary_path
from tracklore.llm.wavelet import WaveletMatrix

BASE = " ".join(f"Wort{i % 37} é{i}" for i in range(60))


def table():
    """Null, empty, blank, short, one long, copies, near copies, shared passages."""
    draw = random.Random(3)
    texts = [None, "", " \n\t ", "one", "One  two\nthree", "漢字 😀", BASE, BASE.replace(" ", "\n "), BASE.upper()]
    words = BASE.split()
    for share in (2, 5, 9, 30):
        w = list(words)
        for k in draw.sample(range(len(w)), share):
            w[k] = f"x{draw.randrange(99)}"
        texts += [" ".join(w), " ".join(["lead", *w, "tail"])]
    texts += ["pre " + " ".join(words[10:70]) + " post", " ".join(words[:49]), "long " * 30000 + BASE]
    texts += ["mail a.b@c.de, ip 10.0.0.1. card 4111 1111 1111 1111 tel +1 (202) 555-0143 é a@b", "<|endoftext|> x  y"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, i * 2) for i, t in table()]
    # Columns whose names operators might use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact(docs, empty):
    assert rows_of(exact_dedup.duplicates(docs)) == sorted(plain.exact(table()), key=repr)
    assert exact_dedup.duplicates(empty).count() == 0
    twice = exact_dedup.keep_first(docs.union(docs))
    assert twice.columns == docs.columns
    assert sorted(r.doc_id for r in twice.collect()) == [x[0] for x in plain.exact(table()) if x[3]]
    # Identifiers of two bytes clash now and then; the key then changes.
    assert rows_of(exact_dedup.duplicates(docs, digest_bytes=2)) == sorted(plain.exact(table()), key=repr)


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    kept = exact_dedup.duplicates(df).filter("kept").collect()
    assert sorted((r.doc_id, r.group_size) for r in kept if r.doc_id is not None) == [(3, 3)] and len(kept) == 2


def test_near(docs, empty):
    got = near_dedup.near_duplicates(docs).drop("text_key")
    assert rows_of(got) == sorted(plain.near(table()), key=repr)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_open_lists(spark, monkeypatch):
    """Chains of edits, where the first member of a list is linked with few of it."""
    monkeypatch.setattr(near_dedup, "_ROUNDS", 1)
    draw = random.Random(5)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        for _ in range(2):
            words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
        rows.append((i * 7 % 60, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_key")
    assert rows_of(got) == sorted(plain.near(rows), key=repr)


def test_compare_list_in_blocks():
    sets = [np.arange(k, k + 20, dtype=np.uint32) for k in (0, 1, 2, 50)]
    listed = [[5], [5], [5], [5]]
    made = lambda block: pa.table(
        {
            "value": [5] * 4, "class": [1, 2, 3, 4], "n": [20] * 4, "component": [1, 2, 3, 4], "block": block,
            "listed": listed, "members": [s.tobytes() for s in sets],
        }
    )
    pairs = lambda t: sorted(zip(*near_dedup.compare_list(t).to_pydict().values()))
    assert pairs(made([0, 0, 0, 0])) == [(1, 2), (1, 3), (2, 3)]
    assert pairs(made([0, 1, 1, 1])) == [(1, 2), (1, 3)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (203, 201)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200, 203: 200}


def test_substrings(docs, empty):
    got = substring_dedup.remove_repeated(docs).drop("kept_text")
    assert rows_of(got) == sorted(plain.substrings(table()), key=repr)
    assert substring_dedup.remove_repeated(empty).count() == 0
    # A sketch far too small, in slices, changes nothing.
    got = substring_dedup.remove_repeated(docs, max_cells=1 << 16, window=10).drop("kept_text")
    assert rows_of(got) == sorted(plain.substrings(table(), 10), key=repr)


def test_contamination(spark, docs, empty):
    items = [(1, " ".join(BASE.split()[5:25])), (2, "one TWO three"), (3, None), (4, "..."), (5, "one two three")]
    items += [(10, "long " * 14)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(plain.contamination(table(), items), key=repr)
    for size in (1 << 20, 64):  # one block, and several
        found = decontaminate.contamination(docs, benchmark, block_bytes=size)
        got = [
            (r.doc.doc_id, r.n_words, r.n_hit, len(r["items"]), plain.sha(",".join(r["items"])), r.contaminated)
            for r in found.collect()
        ]
        assert sorted(got, key=repr) == want
    clean = decontaminate.remove_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert not decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count()


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x b c d q")], "doc_id long, text string")
    found = decontaminate.longest_matches(docs, spark.createDataFrame([(7, "b c d q z")], "item_id long, text string"))
    got = {r.item_word: (r.n_words, r.doc_id, r.doc_word) for r in found.collect()}
    assert got == {0: (4, 2, 1), 1: (3, 2, 2), 2: (2, 2, 3), 3: (1, 2, 4)}


def test_private(docs):
    got = {r.doc.doc_id: r for r in private_data.find_private(docs).collect()}
    for i, text in table():
        want = plain.private(text or "")
        assert got[i].base_sha256 == plain.sha(want)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    draw = random.Random(4)
    pieces = list("ab1289..@+-() é漢") + ["4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (202) 555-0143"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(30)))
        raw = text.encode()
        assert private_data._listed(private_data.base_spans(raw), raw) == plain.private(text)


def test_random_field_adds_other_forms():
    field = private_data.train(private_data.LINES)
    texts = ["write bob (at) site (dot) org now", "call (312) 555-7788 please", "the year 2020 and 15 people"]
    got = private_data.added_spans(field, pa.array(texts))
    assert [[private_data.KINDS[k] for _, k, _ in got.get(i, [])] for i in range(3)] == [["email"], ["phone"], []]


def test_toxicity(spark, empty):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = draw.random() < 0.2
        words = [f"w{draw.randrange(300)}" for _ in range(40)]
        if bad:
            words[draw.randrange(40)] = "grobian"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (600, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    truth = dict(labels.dropna().collect())
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == truth[r.doc.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.score for r in toxicity.score(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.score(empty, labels).count() == 0


def test_language(spark, docs, empty):
    draw = random.Random(8)
    stems = {"aa": "ba da ga ma na".split(), "bb": "ört ümt äst öln".split(), "cc": "при вет мир дом".split()}
    rows = []
    for i in range(300):
        lang = draw.choice(sorted(stems))
        rows.append((i, " ".join(draw.choice(stems[lang]) * draw.randrange(1, 3) for _ in range(8)), lang))
    more = [(300, None, "aa"), (301, "12 !?", None), (302, "", "bb")]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    got = {r.doc.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (300, 301, 302))
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns and kept.count() == 300
    assert language_id.identify(empty).count() == 0
    none = language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 0)).filter("lang = 'q' OR doc_id = 3"))
    assert none.count() == 1


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode(docs, path).collect():
        text = r.doc.text or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0
    encoder, draw = bpe.Encoder(bpe.Vocabulary.load(path)), random.Random(1)
    pieces = list("abc  \n\t'sre1 2.,é漢 　\x1c\x85") + ["<|endoftext|>", "'ll", " the", "aaaa"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(30))) for _ in range(3000)]
    ids, cuts = encoder.encode(texts)
    for text, a, b in zip(texts, cuts, cuts[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_wavelet():
    draw = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 3000):
        ids = draw.integers(0, 1000, n).astype(np.uint32)
        matrix, parts = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 10).to_bytes(more=b"x"))
        assert parts == {"more": b"x"} and (matrix.all() == ids).all()
        assert (matrix.access(np.arange(n)) == ids).all()
        for value in (0, 7, 999, 5000):
            assert matrix.places(value).tolist() == np.flatnonzero(ids == value).tolist()
            assert matrix.count(value, 3, 50) == (ids[3:50] == value).sum()


def test_shards(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    library, start, places = Tokenizer.from_file(path), 0, []
    out = str(tmp_path / "shards")
    token_shards.write_shards(docs, path, out, partition_bytes=20_000)
    got = {r.doc_id: r for r in token_shards.read_documents(spark, out).collect()}
    for i, text in table():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        places += [(i, p) for p, x in enumerate(ids) if x == ids[0] and i == 6]
        crc = zlib.crc32(np.array(ids, "<u4"))
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    first = library.encode(BASE, add_special_tokens=False).ids[0]
    found = token_shards.find_token(spark, out, first)
    assert sorted(tuple(r) for r in found.filter("doc_id = 6").collect()) == places
    assert token_shards.count_token(spark, out, first) == found.count()
    token_shards.write_shards(empty, path, out + "0")
    assert token_shards.read_documents(spark, out + "0").count() == 0
