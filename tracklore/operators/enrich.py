"""Incremental enrichment of tracks with features and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.functions.text import blank_to_null, embedding_text, track_id
from tracklore.plans.history_view import joined_text, track_credits
from tracklore.schema import FEATURE_COLUMNS, Star

Encoder = Callable[[DataFrame, str, str], DataFrame]


def missing_features(tracks: DataFrame, audio_features: DataFrame) -> DataFrame:
    """Tracks without a feature row. Local tracks have no external id and stay here."""
    have = audio_features.select(F.col("track_uri").alias("uri"))
    return tracks.select("uri").join(have, "uri", "left_anti")


def found_features(candidates: DataFrame, source: DataFrame) -> DataFrame:
    """Feature rows from ``source`` (keyed by external ``id``) for the candidates.

    Rows without an id are ignored; of several rows for one id one is kept, chosen by
    value so that every run keeps the same.
    """
    ids = candidates.select(F.col("uri").alias("track_uri"), track_id(F.col("uri")).alias("id"))
    rows = source.filter(blank_to_null(F.col("id")).isNotNull())
    one = rows.groupBy("id").agg(F.max(F.struct(*FEATURE_COLUMNS)).alias("f"))
    return (
        ids.filter(F.col("id").isNotNull())
        .join(one, "id")
        .select("track_uri", *[F.col("f")[c].alias(c) for c in FEATURE_COLUMNS])
    )


def embedding_candidates(star: Star) -> DataFrame:
    """Tracks without an embedding, with the columns their text is made of.

    The anti join comes first and artists are looked up for candidates only, so a run
    after a small import does little more than that anti join.
    """
    tracks = star.tracks.select(F.col("uri").alias("track_uri"), "title", "album_name")
    todo = tracks.join(star.embeddings.select("track_uri"), "track_uri", "left_anti")
    bridge = star.track_artists.join(todo.select("track_uri"), "track_uri", "left_semi")
    names = track_credits(bridge, star.artists).select(
        "track_uri", joined_text(F.col("names")).alias("artist_names")
    )
    features = star.audio_features.select("track_uri", "tempo", "energy", "danceability", "valence")
    return (
        todo.join(names, "track_uri", "left")
        .join(features, "track_uri", "left")
        .withColumn("artist_names", F.coalesce("artist_names", F.lit(fx.DEFAULT_ARTIST)))
    )


def embedding_texts(candidates: DataFrame) -> DataFrame:
    columns = ["title", "artist_names", "album_name", "tempo", "energy", "danceability", "valence"]
    text = embedding_text(*[F.col(c) for c in columns])
    return candidates.select("track_uri", text.alias("text"))


def new_embeddings(star: Star, encoder: Encoder) -> DataFrame:
    """Embeddings for every track that has none."""
    return encoder(embedding_texts(embedding_candidates(star)), "text", "embedding").select(
        "track_uri", "embedding"
    )
