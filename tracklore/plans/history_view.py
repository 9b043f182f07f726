"""The denormalised listening-history view (D1: J1-J5, A1-A3, P7, P8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.operators.skew import salted_join
from tracklore.schema import Star


def joined_text(values: Column) -> Column:
    """Distinct values as one sorted, comma-separated text; NULL when there are none."""
    known = F.array_sort(F.array_distinct(F.array_compact(values)))
    return F.when(F.size(known) > 0, F.array_join(known, fx.LIST_SEPARATOR))


def seconds(milliseconds: Column, digits: int) -> Column:
    """Milliseconds as exact decimal seconds, rounded half up."""
    return F.round(milliseconds.cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)"), digits)


def track_credits(track_artists: DataFrame, artists: DataFrame) -> DataFrame:
    """Per track: distinct artist names and genre lists, as arrays.

    Names and genres come from one join and one aggregate; duplicates are dropped
    before the shuffle. A track without a known artist has no row.
    """
    credited = track_artists.join(
        artists.select(F.col("uri").alias("artist_uri"), "name", "genres"), "artist_uri"
    )
    return credited.groupBy("track_uri").agg(
        F.collect_set("name").alias("names"),
        F.flatten(F.collect_set("genres")).alias("genres"),
    )


def artist_names(track_artists: DataFrame, artists: DataFrame) -> DataFrame:
    credits = track_credits(track_artists, artists)
    return credits.select("track_uri", joined_text(F.col("names")).alias("artist_names"))


def track_genres(track_artists: DataFrame, artists: DataFrame) -> DataFrame:
    """Genre text of each track that has at least one genre."""
    credits = track_credits(track_artists, artists.filter(F.col("genres").isNotNull()))
    genres = credits.select("track_uri", joined_text(F.col("genres")).alias("artist_genres"))
    return genres.filter(F.col("artist_genres").isNotNull())


def track_profile(star: Star) -> DataFrame:
    """One row per track with everything the view shows about it.

    Built per track before plays are touched, so plays are joined once and never
    fan out over the artists of a track.
    """
    credits = track_credits(star.track_artists, star.artists).select(
        "track_uri",
        joined_text(F.col("names")).alias("artist_names"),
        joined_text(F.col("genres")).alias("artist_genres"),
    )
    tracks = star.tracks.select(
        F.col("uri").alias("track_uri"),
        F.col("title").alias("track_title"),
        "album_name",
        "release_date",
        "popularity",
        seconds(F.col("duration_ms"), 1).alias("duration_seconds"),
    )
    features = star.audio_features.select("track_uri", "tempo", "energy", "danceability", "valence")
    return (
        tracks.join(credits, "track_uri", "left")
        .join(features, "track_uri", "left")
        .withColumn("artist_names", F.coalesce("artist_names", F.lit(fx.DEFAULT_ARTIST)))
    )


VIEW_COLUMNS = [
    "history_id",
    "played_at",
    "played_time",
    "track_uri",
    "track_title",
    "album_name",
    "release_date",
    "popularity",
    "duration_seconds",
    "played_time_seconds",
    "artist_names",
    "artist_genres",
    "tempo",
    "energy",
    "danceability",
    "valence",
]


def view_plays(played_history: DataFrame) -> DataFrame:
    return played_history.select(
        F.col("id").alias("history_id"),
        "track_uri",
        "played_at",
        "played_time",
        seconds(F.col("played_time"), 3).alias("played_time_seconds"),
    )


def history_view(star: Star, profile: DataFrame | None = None) -> DataFrame:
    """One row per play of a known track.

    With a stored ``profile`` both join inputs are plain scans: Spark broadcasts the
    profile when its files are small and otherwise splits hot tracks at run time. A
    profile computed in the same plan is already partitioned by track, which rules
    that split out, so hot tracks are salted instead.
    """
    plays = view_plays(star.played_history)
    if profile is not None:
        joined = plays.join(profile, "track_uri")
    else:
        joined = salted_join(plays, track_profile(star), "track_uri", ["history_id"])
    return joined.select(*VIEW_COLUMNS)


def publish_view(star: Star, profile: DataFrame | None = None) -> DataFrame:
    """Create or replace the view under its public name in the star's session."""
    view = history_view(star, profile)
    view.createOrReplaceTempView(fx.HISTORY_VIEW)
    return view
