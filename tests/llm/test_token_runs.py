"""The token shards' encoder: ids of whole batches from their distinct runs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tracklore.llm import token_shards
from tracklore.llm.queries import vocabulary_path
from tracklore.llm.text_arrays import flat

PIECES = [*"abCZ  \n\t\x0b\x0c'sre12.,;:!?<|éÉßØ÷×漢　\x1c\x85́", "<|endoftext|>", "<|EndOfText|>", "'ll", " the", "aaaa", "naïve."]


@pytest.fixture(scope="module")
def path():
    return vocabulary_path("word_bpe_49k.json")


def encoder(path):
    with open(path, encoding="utf-8") as file:
        return token_shards.RunEncoder(file.read())


def encoded(found, texts):
    ids, cuts = found.encode(*flat(pa.array(texts, pa.string())))
    assert len(cuts) == len(texts) + 1 and cuts[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_ids_are_the_librarys(path):
    from tokenizers import Tokenizer

    library, draw, found = Tokenizer.from_file(path), random.Random(5), encoder(path)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(12))) for _ in range(6000)]
    # Nothing may join, part or be found across the edge of two texts.
    texts += ["a", ".b", "é", ".", "<", "|endoftext|> A.b", None, "", " ", "!", "x<", "|", "0", "a0 b"]
    for part in (texts, texts[::-1], ["."], [None], ["", ""], ["<|"], ["A"], []):
        want = [library.encode(t or "", add_special_tokens=False).ids for t in part]
        assert encoded(found, part) == want


def test_each_distinct_run_is_looked_up_once_a_batch(path):
    class Counted(dict):
        lookups = 0

        def __contains__(self, key):
            Counted.lookups += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.lookups += 1
            return super().__getitem__(key)

    found = encoder(path)
    once = encoded(found, ["one two, Three"])[0]
    found.known = Counted(found.known)
    assert encoded(found, ["one two, Three " * 1000] * 3) == [once * 1000] * 3
    assert Counted.lookups <= 2 * len(found.known)


def test_bytes_that_are_no_text(path):
    """A letter's second byte belongs to the text it stands in."""
    found = encoder(path)
    texts = pa.array([b"\xc3", b"\xa9.", b"\xc3\xa9."], pa.binary())
    ids, cuts = found.encode(*flat(texts))
    alone = [encoder(path).encode(*flat(texts.slice(i, 1)))[0] for i in range(3)]
    for a, b, want in zip(cuts, cuts[1:], alone):
        assert np.array_equal(ids[a:b], want)
