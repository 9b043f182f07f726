"""Steps of the import that are done once, not once a row, copy or file."""

import pyarrow as pa
from pyspark.sql import functions as F

from tracklore.functions import text
from tracklore.plans import adapters
from tracklore.sources.history_json import _skip_reason, skipped_documents

DOCUMENTS = [
    ("a", "[1] x", "not_json"),
    ("b", " \t\n\r[1],[2]", "not_json"),
    ("c", "[1", "not_json"),
    ("d", '{"a": [1]}', "not_array"),
    ("e", "17", "not_array"),
    ("f", "\u00a0[1]", "not_json"),
    ("g", "", "not_json"),
    ("h", "[[1], NaN", "not_json"),
]


def events(spark):
    rows = [
        (n, kind, float(n), n % 7, '{"k": %d}' % n)
        for n, kind in enumerate(["click", "view", "purchase", "signup", "error", None] * 25)
    ]
    found = spark.createDataFrame(rows, "event_id long, event_type string, value double, user_id long, props string")
    return found.withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1700000000).cast("timestamp_ntz"))


def test_cut_documents_are_parsed_once(spark):
    docs = spark.createDataFrame([r[:2] for r in DOCUMENTS], "file_name string, value string")
    assert sorted(map(tuple, skipped_documents(docs).collect())) == [(n, why) for n, _, why in DOCUMENTS]
    # What begins as an array needs no second look: it is known before the parser's branch.
    branches = _skip_reason(F.lit(None).cast("array<variant>"))
    assert str(branches).index("startswith") < str(branches).index("not_array")


def test_stored_documents_are_stored_without_copies(spark, tmp_path):
    events(spark).write.parquet(f"{tmp_path}/events.parquet")
    stored = adapters.stored_documents(spark, str(tmp_path))
    plain = adapters.documents(spark, str(tmp_path))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
    files = spark.read.parquet(*stored.inputFiles())
    assert files.count() * 3 == plain.count()


def test_batches_without_other_letters_stay_out_of_python():
    nothing = pa.nulls(3, pa.string())
    assert text._unicode_identity.func(nothing, nothing).equals(nothing)
    some = text._unicode_identity.func(pa.array([" \u00c9a", None]), pa.array(["\u2460", "x"]))
    assert some.to_pylist() == ["\u00e9a|1".replace("|", text.fx.IDENTITY_SEPARATOR), None]
