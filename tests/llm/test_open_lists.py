"""Near duplicates: lists whose members are all in one component are not joined again."""

import random

import pytest

from tests.llm import plain
from tracklore.llm import near_dedup
from tracklore.llm.joins import join_marked


def test_only_open_lists_go_on(spark):
    # List 1 is hot and closed, 2 hot and open, 3 closed, 4 open.
    rows = [(v, c, 9, v < 3) for v, members in ((1, range(40)), (2, range(42)), (3, (1, 2)), (4, (5, 50))) for c in members]
    entries = spark.createDataFrame(rows, "value long, class long, n long, hot boolean").repartition(5)
    found = spark.createDataFrame([(c, 0) for c in range(41)], "node long, component long")
    for number in range(3):
        entries = near_dedup._open_lists(entries.select("value", "class", "n", "hot"), found, number)
        got = sorted((r.value, r["class"], r.component, r.held) for r in entries.collect())
        assert got == sorted([(2, c, 0 if c < 41 else c, 42) for c in range(42)] + [(4, 5, 0, 2), (4, 50, 50, 2)])
        assert entries.select("value", "first").distinct().count() == 2


def test_marked_join(spark):
    rows = spark.createDataFrame([(1, True, i) for i in range(9)] + [(2, False, 9), (3, False, 8), (4, True, 7)], "k long, hot boolean, x long")
    groups = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (5, False, "c")], "k long, hot boolean, g string")
    got = sorted(tuple(r) for r in join_marked(rows, groups, "k", "hot").select("k", "x", "g").collect())
    assert got == [(1, i, "a") for i in range(9)] + [(2, 9, "b")]


@pytest.mark.parametrize("size", [40, 80])
def test_hot_lists_are_found_once(spark, monkeypatch, size):
    """A large group of near copies, copies of copies that drift apart, and rows alone."""
    draw = random.Random(size)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(size):
        w = list(base)
        w[draw.randrange(90)] = f"x{i}"
        texts.append(" ".join(w))
    drift = [f"d{i}" for i in range(60)]
    for i in range(size // 2):
        drift[(7 * i) % 60] = f"y{i}"
        texts.append(" ".join(drift))
    texts += [" ".join([*base[:30], *(f"z{i}_{k}" for k in range(60))]) for i in range(5)] + [None, "", texts[0]]
    joined = []
    plain_join = near_dedup.join_groups
    monkeypatch.setattr(
        near_dedup, "join_groups", lambda rows, groups, key, *a: joined.append(key) or plain_join(rows, groups, key, *a)
    )
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs).drop("text_key").collect())
    assert got == sorted(plain.near(list(enumerate(texts))))
    assert joined.count("value") == 1
