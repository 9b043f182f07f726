"""Words made to clash under sums of powers, and byte counts of ranges."""

import random

import numpy as np

from tests.llm import plain
from tracklore.llm import exact_dedup, near_dedup, substring_dedup, toxicity
from tracklore.llm.text_arrays import hasher


def thue_morse(length, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(length))


PAIRS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (64, 512, 1024, 4096)]


def test_long_words_do_not_clash():
    for a, b in PAIRS:
        data = np.frombuffer((a + b).encode(), np.uint8)
        for seed in range(40, 45):
            one, two = hasher(seed).words(data, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
            assert one != two


def test_documents_of_one_such_word_are_not_linked(spark):
    rows = [(2 * k + j, word) for k, pair in enumerate(PAIRS) for j, word in enumerate(pair)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_key")
    assert sorted(map(tuple, got.collect())) == sorted(plain.near(rows)) and got.filter("kept").count() == len(rows)


def test_windows_that_differ_in_such_a_word_are_kept(spark):
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(2 * k + j, f"{word} {rest} end{k}") for k, pair in enumerate(PAIRS) for j, word in enumerate(pair)]
    rows += [(100, rows[0][1])]
    got = substring_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept_text")
    assert sorted(map(tuple, got.collect())) == sorted(plain.substrings(rows))


def test_counts_of_ranges():
    draw = random.Random(16)
    flags = np.array([draw.random() < 0.5 for _ in range(500)])
    cuts = np.sort(np.array([0, 0, 7, 7, 7, 500, 500] + [draw.randrange(500) for _ in range(40)]))
    want = [int(flags[a:b].sum()) for a, b in zip(cuts, cuts[1:])]
    assert toxicity._counts(flags, cuts[:-1], cuts[1:]).tolist() == want
    assert toxicity._counts(flags[:0], np.zeros(2, int), np.zeros(2, int)).tolist() == [0, 0]


def test_columns_of_the_same_name_stay(spark):
    rows = [(1, "a b c", 5, 6), (2, "a  b c", 7, 8), (3, "other text", 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k int, _K_ int")
    for keep in (exact_dedup.keep_first, near_dedup.keep_representatives):
        kept = keep(docs)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
