"""First-seen dimensions of a set of plays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.operators.normalise import with_artist_uri

# Documents in name order, then array position.
SOURCE_ORDER = ("file_name", "pos")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key by ``order``.

    An aggregate, not a window: rows are reduced to one per key before the shuffle,
    so a key holding most of the input sends one row per map task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    picked = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    grouped = rows.groupBy(*keys).agg(picked.alias("first"))
    return grouped.select(*keys, *[F.col("first")[c].alias(c) for c in rest])


def track_rows(plays: DataFrame) -> DataFrame:
    """One row per track. A play's length is never taken for the track's."""
    rows = plays.select(F.col("track_uri").alias("uri"), "title", "album_name", *SOURCE_ORDER)
    return first_wins(rows, ["uri"], SOURCE_ORDER).withColumn("duration_ms", F.lit(None).cast("int"))


def artist_rows(plays: DataFrame, collision_safe: bool = False) -> DataFrame:
    named = with_artist_uri(plays, collision_safe)
    rows = named.select(
        F.col("artist_uri").alias("uri"), F.col("artist_name").alias("name"), *SOURCE_ORDER
    )
    return first_wins(rows, ["uri"], SOURCE_ORDER)


def track_artist_rows(plays: DataFrame, collision_safe: bool = False) -> DataFrame:
    return with_artist_uri(plays, collision_safe).select("track_uri", "artist_uri").distinct()
