"""What the encoder returns, and what it leaves in a worker."""

from tracklore.llm import bpe, text_arrays
from tracklore.llm.queries import vocabulary_path


def test_decoded_text_can_be_left_out(spark):
    docs = spark.createDataFrame([(1, "a few  words"), (2, None), (2, "")], "doc_id long, text string")
    path = vocabulary_path("byte_bpe_50k.json")
    whole = bpe.encode(docs, path, carry=["doc_id"])
    ids = bpe.encode(docs, path, carry=["doc_id"], with_decoded=False)
    assert ids.columns == [c for c in whole.columns if c != "decoded"]
    assert sorted(map(repr, ids.collect())) == sorted(map(repr, whole.drop("decoded").collect()))


def test_tables_of_hashes_are_given_back():
    before = text_arrays.hasher(30)
    text_arrays.release()
    after = text_arrays.hasher(30)
    assert after is not before and after.key == before.key
