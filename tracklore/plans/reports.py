"""Question shapes over the history.

Each takes plays and the per-track profile rather than the finished view: plays are
reduced to one row per track (and period) first, so what is shuffled and joined grows
with tracks, not with plays, and a much-played track costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklore.operators.skew import broadcast_rows


def plays_per_track(plays: DataFrame, period: str | None = None) -> DataFrame:
    keys = ["track_uri"]
    if period:
        plays = plays.withColumn("period", F.date_trunc(period, "played_at"))
        keys.append("period")
    return plays.groupBy(*keys).agg(
        F.count("*").alias("plays"), F.sum("played_time").alias("played_ms")
    )


def genre_filter(view: DataFrame, genre: str) -> DataFrame:
    """Plays whose genre text contains ``genre``, in any case."""
    return view.filter(F.col("artist_genres").ilike(f"%{genre}%"))


def date_range(rows: DataFrame, column: str, start, end) -> DataFrame:
    """Half-open range: ``start`` included, ``end`` not. Bounds are typed literals, so
    the scan can skip row groups."""
    return rows.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def listening_time(plays: DataFrame, profile: DataFrame) -> DataFrame:
    """Played milliseconds by artist text, from playback time only."""
    per_track = plays_per_track(plays).join(profile.select("track_uri", "artist_names"), "track_uri")
    return per_track.groupBy("artist_names").agg(
        F.sum("plays").alias("plays"), F.sum("played_ms").alias("played_ms")
    )


def track_summary(plays: DataFrame, profile: DataFrame) -> DataFrame:
    """Counts and audio metrics by album, weighted by plays."""
    tracks = profile.select("track_uri", "album_name", "tempo", "energy", "valence")
    joined = plays_per_track(plays).join(tracks, "track_uri")
    weight = F.when(F.col("tempo").isNotNull(), F.col("plays"))
    return joined.groupBy("album_name").agg(
        F.sum("plays").alias("plays"),
        F.count("*").alias("tracks"),
        F.try_divide(F.sum(F.col("tempo") * F.col("plays")), F.sum(weight)).alias("avg_tempo"),
        F.min("energy").alias("min_energy"),
        F.max("valence").alias("max_valence"),
    )


def plays_by_period(plays: DataFrame, tracks: DataFrame, period: str) -> DataFrame:
    """Plays of known tracks per period."""
    known = tracks.select(F.col("uri").alias("track_uri"))
    per_track = plays_per_track(plays, period).join(known, "track_uri", "left_semi")
    return per_track.groupBy("period").agg(
        F.sum("plays").alias("plays"), F.sum("played_ms").alias("played_ms")
    )


def top_tracks(plays: DataFrame, tracks: DataFrame, n: int) -> DataFrame:
    """The ``n`` most played tracks, ties by URI."""
    known = tracks.select(F.col("uri").alias("track_uri"), F.col("title").alias("track_title"))
    return (
        plays_per_track(plays)
        .join(known, "track_uri")
        .orderBy(F.desc("plays"), "track_uri")
        .limit(n)
    )


def topn_by_period(plays: DataFrame, tracks: DataFrame, n: int, period: str) -> DataFrame:
    """The overall top ``n`` tracks, broken down by period.

    The second pass over plays keeps only top tracks through a broadcast of ``n`` rows.
    """
    top = top_tracks(plays, tracks, n).select("track_uri", "track_title")
    kept = plays.join(broadcast_rows(top, n), "track_uri")
    return (
        kept.withColumn("period", F.date_trunc(period, "played_at"))
        .groupBy("track_uri", "track_title", "period")
        .agg(F.count("*").alias("plays"), F.sum("played_time").alias("played_ms"))
    )


def rank_in_period(plays: DataFrame, tracks: DataFrame, period: str) -> DataFrame:
    """Rank of every known track by plays within its period, ties sharing a rank.

    A window over a period would sort all its tracks in one task. A rank only depends
    on how many tracks have more plays, so tracks are counted per distinct play count
    first; the window then runs over those few rows per period.
    """
    known = tracks.select(F.col("uri").alias("track_uri"))
    per_track = plays_per_track(plays.filter(F.col("track_uri").isNotNull()), period)
    per_track = per_track.join(known, "track_uri", "left_semi")
    levels = per_track.groupBy("period", "plays").agg(F.count("*").alias("tied"))
    up_to_here = F.sum("tied").over(Window.partitionBy("period").orderBy(F.desc("plays")))
    ranks = levels.select("period", "plays", (up_to_here - F.col("tied") + 1).alias("rank"))
    return per_track.join(ranks, ["period", "plays"]).select(
        "period", "track_uri", "plays", "rank"
    )
