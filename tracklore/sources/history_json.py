"""Export documents to records.

A document is one file holding one JSON array. A file that is not valid JSON, or
whose root is not an array, contributes nothing and does not affect other files;
array elements that are not objects are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.functions import records as rec

DOCUMENT_SCHEMA = "file_name string, value string"

# The document is parsed inside an outer array that ends with this marker, so text
# left over after the document's own array, or a second array, is noticed.
_END = '["end-of-document"]'
# A document is one Spark string of at most 2 GB, and is wrapped in some more text.
MAX_DOCUMENT_BYTES = (1 << 31) - 1024
_JSON_SPACE = " \t\n\r"
_JSON_OPTIONS = {"allowSingleQuotes": "false"}

_FIELDS = {
    "ts": fx.KEY_TIMESTAMP,
    "track_uri": fx.KEY_TRACK_URI,
    "title": fx.KEY_TITLE,
    "artist_name": fx.KEY_ARTIST,
    "album_name": fx.KEY_ALBUM,
    "ms_played": fx.KEY_DURATION,
}
_RECORD_TYPE = "struct<" + ", ".join(f"{key}: variant" for key in _FIELDS.values()) + ">"


def _is_single_file(spark: SparkSession, path: str) -> bool | None:
    """True for a file, False for a folder, None when nothing is there."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    return fs.getFileStatus(target).isFile()


def read_documents(
    spark: SparkSession, path: str, pattern: str = fx.EXPORT_FILE_PATTERN
) -> DataFrame:
    """One row (file_name, value) per export file.

    A file is taken whatever its suffix; a folder yields its own files matching
    ``pattern``, not those of sub-folders; anything else yields no rows. Many files
    spread over tasks; one file is one task, as its array has to be read whole to
    know whether it is valid. A file too large for that comes with a NULL value.
    """
    kind = _is_single_file(spark, path)
    if kind is None:
        return spark.createDataFrame([], DOCUMENT_SCHEMA)
    # The files themselves are the paths read, so a sub-folder named like a partition
    # (year=2024) takes no part.
    files = _literal(path) if kind else own_files(path, pattern)
    found = _matches(spark, files)
    large = [name for name, _, size in found if size > MAX_DOCUMENT_BYTES]
    if large:
        files = [_literal(where) for _, where, size in found if size <= MAX_DOCUMENT_BYTES]
    # Spark's reader gives no row for an empty file.
    unread = [(name, None) for name in large] + [(name, "") for name, _, size in found if not size]
    documents = spark.createDataFrame(unread, DOCUMENT_SCHEMA)
    if len(found) == len(unread):
        return documents
    read = spark.read.text(files, wholetext=True)
    if not kind:
        # The pattern may also stand for a sub-folder.
        read = read.filter(parent_path() == F.lit(qualified(spark, path)))
    read = read.select(file_name(), "value")
    return read.unionByName(documents) if unread else read


def own_files(path: str, pattern: str) -> str:
    """The glob for the files of a folder itself."""
    return f"{_literal(path)}/{pattern}"


def qualified(spark: SparkSession, path: str) -> str:
    """A folder's full address, as files in it name it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(target).toUri().getPath().rstrip("/")


def parent_path() -> Column:
    """Decoded path of the folder of the file a row came from, without scheme and host."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_extract(encoded, r"^(?:[^:/]+:(?://[^/]*)?)?(/.*)/[^/]*$", 1))


def _literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path.rstrip("/"))


def _matches(spark: SparkSession, files: str) -> list[tuple[str, str, int]]:
    """(name, path, bytes) of the files a pattern stands for."""
    target = spark._jvm.org.apache.hadoop.fs.Path(files)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for s in fs.globStatus(target) or [] if s.isFile()]
    return [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in found]


def file_name() -> Column:
    """Decoded name of the file a row came from; names order the documents."""
    encoded = F.col("_metadata.file_name")
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))).alias("file_name")


def _document_array() -> Column:
    """The document's root array as ``array<variant>``; NULL when it is not one."""
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit(f",{_END}]"))
    parts = F.from_json(wrapped, "array<array<variant>>", _JSON_OPTIONS)
    # The lambda names the parsed value, so that it is parsed once.
    root = F.transform(
        F.array(parts), lambda p: F.when((F.size(p) == 2) & p[1].isNotNull(), p[0])
    )
    return root[0]


def explode_records(documents: DataFrame) -> DataFrame:
    """One row per JSON object: (file_name, pos, record VARIANT)."""
    return (
        documents.filter(F.is_valid_utf8("value"))
        .select("file_name", F.posexplode(_document_array()).alias("pos", "record"))
        .filter(rec.is_object(F.col("record")))
    )


def _skip_reason(array: Column) -> Column:
    """Why a document adds nothing; NULL for one that was read. One that doesn't begin as an
    array is parsed once more to tell whether it is one JSON value at all."""
    values = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))), "$", "array<variant>"
    )
    return (
        F.when(F.col("value").isNull(), "too_large")
        .when(~F.is_valid_utf8("value"), "not_utf8")
        .when(array.isNotNull(), None)
        .when(F.ltrim("value", F.lit(_JSON_SPACE)).startswith("["), "not_json")
        .when(F.size(values) == 1, "not_array")
        .otherwise("not_json")
    )


def _elements(documents: DataFrame) -> DataFrame:
    """(file_name, skipped, pos, r): the elements of documents that were read, and one row
    without an element for each that was not, from one pass."""
    fields = F.transform(
        F.when(F.is_valid_utf8("value"), _document_array()),
        lambda item: F.try_variant_get(item, "$", _RECORD_TYPE),
    )
    # The lambda names the array, so that it is made once for both uses.
    parsed = F.transform(
        F.array(fields), lambda a: F.struct(_skip_reason(a).alias("skipped"), a.alias("items"))
    )[0]
    return (
        documents.select("file_name", F.explode(F.array(parsed)).alias("d"))
        .select("file_name", F.col("d.skipped").alias("skipped"), F.posexplode_outer("d.items").alias("pos", "r"))
        .filter(F.col("r").isNotNull() | F.col("skipped").isNotNull())
    )


def skipped_documents(documents: DataFrame) -> DataFrame:
    """(file_name, skipped): documents that add no record, and why: too_large, not_utf8,
    not_json (cut off, or text after the array), not_array."""
    return _elements(documents).filter(F.col("skipped").isNotNull()).select("file_name", "skipped")


def scan_history(documents: DataFrame, with_skipped: bool = False) -> DataFrame:
    """The six known keys of each record as plain columns; other keys are ignored.

    An element that is not an object does not convert to the record type and is dropped.
    ``with_skipped`` adds the column ``skipped`` and a row for each document that was not
    read, with its reason there and nothing else.
    """
    split = _elements(documents).select(
        "file_name", "skipped", "pos", *[F.col(f"r.{key}").alias(name) for name, key in _FIELDS.items()]
    )
    if not with_skipped:
        split = split.filter(F.col("skipped").isNull())
    kinds = split.select(
        "*", *[F.schema_of_variant(name).alias(f"{name}_kind") for name in _FIELDS]
    )

    def of(name: str) -> tuple[Column, Column]:
        return F.col(name), F.col(f"{name}_kind")

    wrong = F.lit(False)
    for name in ("track_uri", "title", "artist_name"):
        wrong = wrong | rec.is_wrong_type(*of(name))
    return kinds.select(
        "file_name",
        "pos",
        *[
            rec.text_value(*of(name)).alias(name)
            for name in ("ts", "track_uri", "title", "artist_name")
        ],
        rec.scalar_text(*of("album_name")).alias("album_name"),
        rec.duration_ms(*of("ms_played")).alias("ms_played"),
        F.coalesce(F.col("ms_played_kind") != "VOID", F.lit(False)).alias("has_duration"),
        wrong.alias("wrong_type"),
        *(["skipped"] if with_skipped else []),
    )
