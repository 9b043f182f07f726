"""Inserts that skip or overwrite existing keys, ids and default stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklore.operators.dimensions import first_wins
from tracklore.operators.skew import broadcast_rows


def new_rows(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    nullable_keys: bool = False,
) -> DataFrame:
    """Incoming rows whose key is not stored yet, the first of each key by ``order``.

    Reducing incoming rows to one per key comes first, so the anti join sees no
    repeated key, and both steps share one partitioning on ``keys``. With
    ``nullable_keys`` a row with a NULL in its key never conflicts and is kept.
    """
    candidates = incoming
    if nullable_keys:
        whole = F.lit(True)
        for key in keys:
            whole = whole & F.col(key).isNotNull()
        candidates = incoming.filter(whole)
    if order:
        unique = first_wins(candidates, keys, order)
    else:
        unique = candidates.dropDuplicates(list(keys))
    fresh = unique.join(existing.select(*keys), list(keys), "left_anti")
    if nullable_keys:
        fresh = fresh.unionByName(incoming.filter(~whole).select(*fresh.columns))
    return fresh


def insert_if_absent(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    nullable_keys: bool = False,
) -> DataFrame:
    """``existing`` plus the new rows; a column only one side has is NULL in the other."""
    fresh = new_rows(existing, incoming, keys, order, nullable_keys)
    return existing.unionByName(fresh, allowMissingColumns=True)


def insert_or_update(
    existing: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """``existing`` with ``columns`` taken from ``incoming`` where its key occurs.

    An incoming NULL overwrites too, which is why presence is flagged instead of
    coalescing values. Columns outside ``columns`` keep their stored value, and are
    filled from ``incoming`` only for a new row. ``incoming`` holds each key once.
    """
    old = existing.select(*existing.columns, F.lit(True).alias("_stored")).alias("old")
    new = incoming.select(*incoming.columns, F.lit(True).alias("_sent")).alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    sent = F.col("new._sent").isNotNull()
    stored = F.col("old._stored").isNotNull()

    def value(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}"))
        if name in columns:
            return F.when(sent, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        if name in incoming.columns:
            return F.when(stored, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}"))
        return F.col(f"old.{name}")

    return joined.select(*[value(c).alias(c) for c in existing.columns])


def stamp(rows: DataFrame, column: str) -> DataFrame:
    """Default time stamp of inserted rows."""
    return rows.withColumn(column, F.current_timestamp().cast("timestamp_ntz"))


def stable_play_ids(plays: DataFrame) -> DataFrame:
    """64-bit id from the unique key: no shuffle, the same on every run.

    Hash values may collide once a table holds billions of plays; ``dense_play_ids``
    is exact.
    """
    return plays.withColumn("id", F.xxhash64("track_uri", "played_at"))


def dense_play_ids(plays: DataFrame, after: int = 0, digits: int = 4) -> DataFrame:
    """Ids ``after``+1, ``after``+2, ... for plays unique on (track_uri, played_at).

    Plays are spread evenly over 16**digits ranges of an MD5 key, numbered inside
    their range, and shifted by the sizes of the ranges before. Only the range sizes
    (at most 16**digits rows) meet in one task. The numbering depends on the plays
    alone, so a re-run task gives the same ids.
    """
    identity = F.concat_ws(
        "|",
        F.coalesce("track_uri", F.lit("")),
        F.unix_micros(F.col("played_at").cast("timestamp")).cast("string"),
    )
    keyed = plays.withColumn("_key", F.md5(identity)).withColumn(
        "_range", F.substring("_key", 1, digits)
    )
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")
    starts = sizes.select("_range", before.alias("_before"))
    in_range = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "played_at", "track_uri"))
    numbered = keyed.withColumn("_n", in_range).join(broadcast_rows(starts, 16**digits), "_range")
    return numbered.withColumn("id", F.lit(after) + F.col("_before") + F.col("_n")).drop(
        "_key", "_range", "_n", "_before"
    )
