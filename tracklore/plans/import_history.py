"""Import of export files into the warehouse, enrichment and report."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.operators import dimensions, enrich, normalise
from tracklore.operators.dimensions import SOURCE_ORDER
from tracklore.operators.upsert import dense_play_ids, new_rows, stamp
from tracklore.plans.history_view import publish_view
from tracklore.schema import FEATURE_COLUMNS, UNIQUE_KEYS, Star
from tracklore.session import configure, stage
from tracklore.sources.history_json import read_documents, scan_history
from tracklore.sources.warehouse import MONTH, Warehouse, month_of

# Session setting that names the warehouse whose view is published.
_PUBLISHED = "tracklore.published.warehouse"


def load_documents(warehouse: Warehouse, documents: DataFrame, collision_safe: bool = False) -> dict:
    """Parse documents and insert what is new, dimensions before plays; returns how many
    records were read and rejected, and how many documents skipped.

    The parsed, typed records are written once to the shared folder: JSON is read a
    single time, and the four loads below read only the columns they need.
    """
    scanned = stage(
        normalise.normalise(scan_history(documents, with_skipped=True), carry=["skipped"]), "records"
    )
    records = scanned.filter(F.col("skipped").isNull()).drop("skipped")
    plays = normalise.valid_plays(records)
    loads = {
        "tracks": (dimensions.track_rows(plays), ()),
        "artists": (dimensions.artist_rows(plays, collision_safe), ()),
        "track_artists": (dimensions.track_artist_rows(plays, collision_safe), ()),
    }
    for name, (rows, order) in loads.items():
        warehouse.insert(name, partial(_fresh, rows, UNIQUE_KEYS[name], order))
    load_plays(warehouse, normalise.play_facts(plays))
    follow(warehouse)
    read = F.col("skipped").isNull()
    counts = scanned.agg(
        F.count_if(read).alias("records_read"),
        F.count_if(read & F.col("reason").isNotNull()).alias("records_rejected"),
        F.count("skipped").alias("documents_skipped"),
    ).first()
    return counts.asDict()


def _fresh(rows: DataFrame, keys, order, stored: DataFrame) -> DataFrame:
    return stamp(new_rows(stored, rows, keys, order), "updated_at")


def load_plays(warehouse: Warehouse, facts: DataFrame) -> int:
    """Insert plays not stored yet; returns how many.

    Stored plays are compared only in the months that occur in the new rows; the list of
    months is bounded by the calendar.
    """
    months = [r[0] for r in facts.select(month_of("played_at")).distinct().collect()]
    count = 0

    def numbered(stored: DataFrame) -> DataFrame | None:
        nonlocal count
        known = stored.filter(F.col(MONTH).isin(months))
        fresh = stage(new_rows(known, facts, UNIQUE_KEYS["played_history"], SOURCE_ORDER), "new_plays")
        count = fresh.count()
        if not count:
            return None
        return stamp(dense_play_ids(fresh, after=warehouse.reserve_play_ids(count)), "inserted_at")

    warehouse.insert("played_history", numbered)
    return count


def enrich_features(warehouse: Warehouse, source: DataFrame | None) -> dict:
    """Add features of tracks that have none; without a source only count them."""
    star = warehouse.star()
    candidates = enrich.missing_features(star.tracks, star.audio_features)
    stats = {"feature_candidates": candidates.count(), "features_upserted": 0}
    if source is not None and stats["feature_candidates"]:
        found = stage(enrich.found_features(candidates, source), "features")
        stats["features_upserted"] = found.count()
        warehouse.insert("audio_features", partial(_fresh, found, UNIQUE_KEYS["audio_features"], ()))
    return stats


def enrich_embeddings(warehouse: Warehouse, encoder) -> dict:
    """Add embeddings of tracks that have none; without an encoder only count them."""
    star = warehouse.star()
    texts = stage(enrich.embedding_texts(enrich.embedding_candidates(star)), "texts")
    stats = {"embedding_candidates": texts.count(), "embeddings_upserted": 0}
    if encoder is not None and stats["embedding_candidates"]:
        vectors = stage(encoder(texts, "text", "embedding").select("track_uri", "embedding"), "vectors")
        stats["embeddings_upserted"] = vectors.count()
        warehouse.insert("embeddings", partial(_fresh, vectors, UNIQUE_KEYS["embeddings"], ()))
    return stats


def update_features(warehouse: Warehouse, source: DataFrame) -> int:
    """Put features of ``source`` (keyed by external id) over the stored ones of known
    tracks, NULLs too, and add those that were not there; returns for how many tracks."""
    found = stage(enrich.found_features(warehouse.read("tracks"), source), "features")
    warehouse.update("audio_features", found, FEATURE_COLUMNS)
    follow(warehouse)
    return found.count()


def update_embeddings(warehouse: Warehouse, encoder) -> int:
    """Encode the present text of all tracks again and put it over the stored vectors;
    returns for how many tracks."""
    star = warehouse.star()
    anew = Star(**{**dict(star.items()), "embeddings": star.embeddings.limit(0)})
    vectors = stage(enrich.new_embeddings(anew, encoder), "vectors")
    warehouse.update("embeddings", vectors, ["embedding"])
    return vectors.count()


def enrich_after_import(warehouse: Warehouse, features: DataFrame | None, encoder) -> dict:
    """Features first: the embedded text is made from them."""
    return {**enrich_features(warehouse, features), **enrich_embeddings(warehouse, encoder)}


def import_history(
    spark: SparkSession,
    path: str,
    root: str,
    reset: bool = False,
    features: DataFrame | None = None,
    encoder=None,
    collision_safe: bool = False,
    pattern: str = fx.EXPORT_FILE_PATTERN,
) -> dict:
    """Import a file or folder of exports and return the report numbers."""
    configure(spark)
    warehouse = Warehouse(spark, root)
    if reset:
        warehouse.reset()
    counts = load_documents(warehouse, read_documents(spark, path, pattern), collision_safe)
    stats = enrich_after_import(warehouse, features, encoder)
    warehouse.refresh_profile()
    warehouse.vacuum()
    follow(warehouse)
    return {
        "records_read": counts["records_read"],
        "tracks": warehouse.read("tracks").count(),
        "artists": warehouse.read("artists").count(),
        "plays": warehouse.read("played_history").count(),
        **stats,
    }


def open_history(spark: SparkSession, root: str) -> DataFrame:
    """Publish the view of a warehouse in this session, as of its latest commit.

    What is returned stays as it is, whatever is loaded later; the published view follows
    the imports of the same session.
    """
    warehouse = Warehouse(spark, root)
    at = warehouse.snapshot()
    spark.conf.set(_PUBLISHED, warehouse.root)
    return publish_view(at.star(), at.profile())


def follow(warehouse: Warehouse) -> None:
    """Bring the session's published view up to date if it is this warehouse's."""
    if warehouse.spark.conf.get(_PUBLISHED, None) == warehouse.root:
        open_history(warehouse.spark, warehouse.root)
