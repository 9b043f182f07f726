"""Records to plays, and the rows that cannot become one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.functions.records import clamp_duration
from tracklore.functions.text import artist_uri, blank_to_null, local_uri
from tracklore.functions.timestamps import parse_timestamp


def normalise(records: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Add the normalised columns and ``reason`` (NULL for a valid play).

    One projection, no shuffle. A value of a wrong type is set aside with a reason
    so that one bad record does not stop the import. Columns in ``carry`` are kept.
    """
    rows = records.withColumns(
        {c: blank_to_null(F.col(c)) for c in ("track_uri", "title", "artist_name")}
    )
    artist, title = F.col("artist_name"), F.col("title")
    derived = local_uri("track", artist, title, when=F.col("track_uri").isNull())
    out = rows.select(
        "file_name",
        "pos",
        F.coalesce("track_uri", derived).alias("track_uri"),
        F.coalesce("title", F.lit(fx.DEFAULT_TITLE)).alias("title"),
        "artist_name",
        "album_name",
        parse_timestamp(F.col("ts")).alias("played_at"),
        clamp_duration(F.col("ms_played")).alias("playback_ms"),
        "has_duration",
        "wrong_type",
        *carry,
    )
    reason = (
        F.when(F.col("wrong_type"), "wrong_type")
        .when(F.col("track_uri").isNull(), "missing_identity")
        .when(F.col("played_at").isNull(), "invalid_timestamp")
        .when(~F.col("has_duration"), "missing_duration")
        .when(F.col("playback_ms").isNull(), "invalid_duration")
    )
    out = out.withColumn("reason", reason).drop("has_duration", "wrong_type")
    # A generator between here and a filter on ``reason`` keeps Spark from computing
    # URIs and timestamps a second time inside that filter.
    return out.select(F.inline(F.array(F.struct(*out.columns))))


def valid_plays(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reason").isNull()).drop("reason")


def rejected(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("reason").isNotNull()).select("file_name", "pos", "reason")


def play_facts(plays: DataFrame) -> DataFrame:
    """Columns of the play table, plus the order key of each row."""
    return plays.select(
        "track_uri", "played_at", F.col("playback_ms").alias("played_time"), "file_name", "pos"
    )


def with_artist_uri(plays: DataFrame, collision_safe: bool = False) -> DataFrame:
    """Plays that name an artist, with that artist's URI."""
    named = plays.filter(F.col("artist_name") != "")
    return named.withColumn("artist_uri", artist_uri(F.col("artist_name"), collision_safe))
