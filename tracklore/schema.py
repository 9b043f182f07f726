"""The star schema: six tables with their keys."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

TABLE_SCHEMAS = {
    "tracks": (
        "uri string, title string, album_name string, album_uri string, release_date date, "
        "popularity int, duration_ms int, updated_at timestamp_ntz"
    ),
    "artists": (
        "uri string, name string, genres array<string>, popularity int, updated_at timestamp_ntz"
    ),
    "track_artists": "track_uri string, artist_uri string",
    "played_history": (
        "id bigint, track_uri string, played_at timestamp, context_type string, "
        "context_uri string, inserted_at timestamp_ntz, played_time int"
    ),
    "audio_features": (
        "track_uri string, valence double, energy double, danceability double, tempo double, "
        "acousticness double, instrumentalness double, liveness double, loudness double, "
        "speechiness double, updated_at timestamp_ntz"
    ),
    "embeddings": "track_uri string, embedding array<float>, updated_at timestamp_ntz",
}

FEATURE_COLUMNS = [
    "valence",
    "energy",
    "danceability",
    "tempo",
    "acousticness",
    "instrumentalness",
    "liveness",
    "loudness",
    "speechiness",
]

# Unique keys, used by inserts and by the uniqueness check.
UNIQUE_KEYS = {
    "tracks": ["uri"],
    "artists": ["uri"],
    "track_artists": ["track_uri", "artist_uri"],
    "played_history": ["track_uri", "played_at"],
    "audio_features": ["track_uri"],
    "embeddings": ["track_uri"],
}

# (child table, child column, parent table); parents are keyed by ``uri``.
FOREIGN_KEYS = [
    ("track_artists", "track_uri", "tracks"),
    ("track_artists", "artist_uri", "artists"),
    ("played_history", "track_uri", "tracks"),
    ("audio_features", "track_uri", "tracks"),
    ("embeddings", "track_uri", "tracks"),
]

# Dimensions before facts.
WRITE_ORDER = ["tracks", "artists", "track_artists", "played_history", "audio_features", "embeddings"]


@dataclass(frozen=True)
class Star:
    """The six tables as DataFrames."""

    tracks: DataFrame
    artists: DataFrame
    track_artists: DataFrame
    played_history: DataFrame
    audio_features: DataFrame
    embeddings: DataFrame

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLE_SCHEMAS[name])
