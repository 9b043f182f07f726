"""The registered queries: each runs one operator over the whole supplied tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore import fixed_values as fx
from tracklore.functions import encoders, sql_text, text, vectors
from tracklore.functions.encoders import encode_question
from tracklore.functions.nested import drop_nested_keys as without_keys
from tracklore.functions.records import clamp_duration as clamp
from tracklore.functions.timestamps import parse_timestamp
from tracklore.operators import adhoc, cell_index, dimensions, enrich, normalise, quality, search, upsert
from tracklore.plans import adapters, history_view, import_history, reports
from tracklore.schema import FEATURE_COLUMNS, Star
from tracklore.session import new_stage_path, stage
from tracklore.sources import history_json
from tracklore.sources.history_json import read_documents, scan_history
from tracklore.sources.sinks import rows_as_json as json_rows
from tracklore.sources.warehouse import Warehouse
from tracklore.streaming.ingest import stream_history

QUERIES = {}


def query(run):
    """Register ``run`` under its name; results in types any SQL engine shares."""

    def comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tracklore.session import configure

        df = run(configure(spark), sf_dir)

        def plain(field: T.StructField) -> Column:
            c = F.col(field.name)
            if isinstance(field.dataType, T.TimestampType):
                return c.cast("timestamp_ntz").alias(field.name)
            if isinstance(field.dataType, T.DecimalType):
                return c.cast("double").alias(field.name)
            return c

        return df.select(*[plain(f) for f in df.schema.fields])

    QUERIES[run.__name__] = comparable
    return run


def _micro(vector: str) -> Column:
    """A vector as text, in millionths."""
    units = F.transform(vector, lambda v: F.round(v.cast("double") * 1e6).cast("bigint").cast("string"))
    return F.array_join(units, ",")


# --- the view and its parts ---------------------------------------------------


@query
def view_history(spark, sf_dir):
    return history_view.history_view(adapters.star(spark, sf_dir))


@query
def artist_names(spark, sf_dir):
    return history_view.artist_names(
        adapters.track_artists(spark, sf_dir), adapters.artists(spark, sf_dir)
    )


@query
def track_genres(spark, sf_dir):
    return history_view.track_genres(
        adapters.track_artists(spark, sf_dir), adapters.artists(spark, sf_dir)
    )


@query
def join_plays_tracks(spark, sf_dir):
    plays = adapters.played_history(spark, sf_dir).select(F.col("id").alias("history_id"), "track_uri")
    tracks = adapters.tracks(spark, sf_dir).select(F.col("uri").alias("track_uri"), "title")
    return plays.join(tracks, "track_uri").select("history_id", "track_uri", "title")


@query
def left_join_artists(spark, sf_dir):
    tracks = adapters.tracks(spark, sf_dir).select(F.col("uri").alias("track_uri"))
    names = adapters.artists(spark, sf_dir).select(F.col("uri").alias("artist_uri"), "name")
    credits = adapters.track_artists(spark, sf_dir).join(names, "artist_uri", "left")
    return tracks.join(credits, "track_uri", "left").select("track_uri", "artist_uri", "name")


@query
def left_join_features(spark, sf_dir):
    tracks = adapters.tracks(spark, sf_dir).select(F.col("uri").alias("track_uri"))
    features = adapters.audio_features(spark, sf_dir).select("track_uri", "tempo", "energy")
    return tracks.join(features, "track_uri", "left")


@query
def unit_columns(spark, sf_dir):
    plays = history_view.view_plays(adapters.played_history(spark, sf_dir))
    tracks = adapters.tracks(spark, sf_dir).select(
        F.col("uri").alias("track_uri"),
        history_view.seconds(F.col("duration_ms"), 1).alias("duration_seconds"),
    )
    return plays.join(tracks, "track_uri").select(
        "history_id", "played_time_seconds", "duration_seconds"
    )


@query
def default_artist(spark, sf_dir):
    return history_view.track_profile(adapters.star(spark, sf_dir)).select("track_uri", "artist_names")


# --- questions over the view ----------------------------------------------------


def _plays_and_profile(spark, sf_dir):
    star = adapters.star(spark, sf_dir)
    return star.played_history, history_view.track_profile(star)


@query
def genre_filter(spark, sf_dir):
    view = history_view.history_view(adapters.star(spark, sf_dir))
    return reports.genre_filter(view, "nation_1").select("history_id", "track_uri", "artist_genres")


@query
def date_range_events(spark, sf_dir):
    plays = adapters.played_history(spark, sf_dir)
    found = reports.date_range(plays, "played_at", datetime(2024, 1, 10), datetime(2024, 1, 20))
    return found.select("id", "track_uri", "played_at")


@query
def listening_time(spark, sf_dir):
    return reports.listening_time(*_plays_and_profile(spark, sf_dir))


@query
def track_summary(spark, sf_dir):
    summary = reports.track_summary(*_plays_and_profile(spark, sf_dir))
    return summary.withColumn("avg_tempo", F.round("avg_tempo", 6))


@query
def plays_by_period(spark, sf_dir):
    return reports.plays_by_period(
        adapters.played_history(spark, sf_dir), adapters.tracks(spark, sf_dir), "day"
    )


@query
def top_tracks(spark, sf_dir):
    return reports.top_tracks(
        adapters.played_history(spark, sf_dir), adapters.tracks(spark, sf_dir), 25
    )


@query
def rank_in_period(spark, sf_dir):
    return reports.rank_in_period(
        adapters.played_history(spark, sf_dir), adapters.tracks(spark, sf_dir), "day"
    )


@query
def topn_by_period(spark, sf_dir):
    return reports.topn_by_period(
        adapters.played_history(spark, sf_dir), adapters.tracks(spark, sf_dir), 10, "day"
    )


@query
def adhoc_sql(spark, sf_dir):
    session = adhoc.query_session(
        spark, lambda s: history_view.publish_view(adapters.star(s, sf_dir))
    )
    return adhoc.structured_query(session, ADHOC_STATEMENT)


ADHOC_STATEMENT = """
```sql
SELECT track_uri, track_title, COUNT(*) AS plays, SUM(played_time) AS played_ms,
       MAX(tempo) AS tempo
FROM v_listening_history
WHERE artist_genres ILIKE '%asia%' AND played_at >= TIMESTAMP '2024-01-05'
GROUP BY track_uri, track_title
ORDER BY plays DESC, track_uri;
```
"""


# --- functions --------------------------------------------------------------------


@query
def track_id(spark, sf_dir):
    uris = adapters.tracks(spark, sf_dir).select("uri").unionByName(
        adapters.artists(spark, sf_dir).select("uri")
    )
    return uris.select("uri", text.track_id(F.col("uri")).alias("track_id"))


@query
def slug(spark, sf_dir):
    return adapters.table(spark, sf_dir, "documents").select(
        "doc_id", text.clean_slug(F.col("text")).alias("slug")
    )


@query
def local_uri(spark, sf_dir):
    parts = adapters.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("item"),
        text.local_uri("track", F.col("p_brand"), F.col("p_name")).alias("uri"),
    )
    suppliers = adapters.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("item"),
        text.local_uri("artist", F.col("s_name")).alias("uri"),
    )
    documents = adapters.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("item"),
        text.local_uri("track", F.col("source"), F.col("text")).alias("uri"),
    )
    return parts.unionByName(suppliers).unionByName(documents)


@query
def parse_ts(spark, sf_dir):
    stamps = adapters.table(spark, sf_dir, "events").select("event_id", adapters.stamp_text().alias("s"))
    return stamps.select("event_id", parse_timestamp(F.col("s")).alias("parsed"))


@query
def embedding_text(spark, sf_dir):
    return enrich.embedding_texts(enrich.embedding_candidates(adapters.star(spark, sf_dir)))


@query
def cosine_distance(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "embeddings")
    centres = _centroids(rows, "label")
    distance = vectors.cosine_distance(F.col("embedding"), F.col("vector"))
    return rows.join(centres, "label").select("vec_id", F.round(distance, 6).alias("distance"))


def _centroids(rows: DataFrame, by: str) -> DataFrame:
    """Mean vector per value of ``by``; a group is as long as a vector is wide."""
    cells = rows.select(by, F.posexplode("embedding").alias("i", "v"))
    means = cells.groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(by).agg(F.transform(ordered, lambda c: c["m"]).alias("vector"))


# --- import --------------------------------------------------------------------------


def _normalised(spark, sf_dir):
    return normalise.normalise(scan_history(adapters.documents(spark, sf_dir)))


@query
def src_json_history(spark, sf_dir):
    folder = _export_files(spark, sf_dir)
    rows = scan_history(read_documents(spark, folder, "*.txt"))
    return rows.select("ts", "track_uri", "title", "artist_name", "album_name", "ms_played")


def _export_files(spark, sf_dir) -> str:
    """The documents as files, one each."""
    folder = new_stage_path(spark, "exports")
    documents = adapters.documents(spark, sf_dir).select("value")
    documents.write.option("maxRecordsPerFile", 1).text(folder)
    return folder


@query
def skipped_documents(spark, sf_dir):
    return history_json.skipped_documents(adapters.documents(spark, sf_dir))


@query
def normalise_plays(spark, sf_dir):
    return normalise.valid_plays(_normalised(spark, sf_dir))


@query
def rejected_plays(spark, sf_dir):
    return normalise.rejected(_normalised(spark, sf_dir))


@query
def clamp_duration(spark, sf_dir):
    rows = scan_history(adapters.documents(spark, sf_dir))
    return rows.select("file_name", "pos", clamp(F.col("ms_played")).alias("playback_ms"))


@query
def dim_tracks(spark, sf_dir):
    plays = normalise.valid_plays(_normalised(spark, sf_dir))
    return dimensions.track_rows(plays).select("uri", "title", "album_name")


@query
def dim_artists(spark, sf_dir):
    return dimensions.artist_rows(normalise.valid_plays(_normalised(spark, sf_dir)))


@query
def dim_track_artists(spark, sf_dir):
    return dimensions.track_artist_rows(normalise.valid_plays(_normalised(spark, sf_dir)))


def _row_counts(warehouse: Warehouse, names) -> DataFrame:
    counts = [
        warehouse.read(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        for name in names
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


IMPORTED = ["tracks", "artists", "track_artists", "played_history"]


@query
def import_star(spark, sf_dir):
    warehouse = Warehouse(spark, new_stage_path(spark, "warehouse"))
    import_history.load_documents(warehouse, adapters.documents(spark, sf_dir))
    return _row_counts(warehouse, IMPORTED)


@query
def default_stamps(spark, sf_dir):
    """Every inserted row carries the time of its own load, also after a second one."""

    def now() -> Column:
        time = F.current_timestamp().cast("timestamp_ntz").cast("string")
        return F.lit(spark.range(1).select(time).first()[0]).cast("timestamp_ntz")

    start = now()
    warehouse = Warehouse(spark, new_stage_path(spark, "warehouse"))
    documents = adapters.stored_documents(spark, sf_dir)
    import_history.load_documents(warehouse, documents)
    half = now()
    import_history.load_documents(warehouse, documents)
    stamps = {"tracks": "updated_at", "artists": "updated_at", "played_history": "inserted_at"}
    parts = [
        warehouse.read(name).agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("n"),
            F.count_if(F.col(column).between(start, half)).alias("stamped_by_first_load"),
        )
        for name, column in stamps.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def import_twice(spark, sf_dir):
    """Loading the same documents again adds nothing."""
    warehouse = Warehouse(spark, new_stage_path(spark, "warehouse"))
    documents = adapters.stored_documents(spark, sf_dir)
    import_history.load_documents(warehouse, documents)
    import_history.load_documents(warehouse, documents)
    return _row_counts(warehouse, IMPORTED)


@query
def stream_import(spark, sf_dir):
    warehouse = Warehouse(spark, new_stage_path(spark, "warehouse"))
    files = _export_files(spark, sf_dir)
    stream_history(spark, files, warehouse.root, new_stage_path(spark, "stream"), "*.txt").awaitTermination()
    return _row_counts(warehouse, IMPORTED)


def _per_track(view: DataFrame, moment: str) -> DataFrame:
    return view.groupBy("track_uri", "artist_names").agg(
        F.lit(moment).alias("moment"), F.count("*").alias("plays")
    )


@query
def view_after_stream(spark, sf_dir):
    """The view as opened before a stream loads the other half, and as published after it."""
    warehouse = Warehouse(spark, new_stage_path(spark, "warehouse"))
    files = _export_files(spark, sf_dir)
    import_history.load_documents(warehouse, adapters.documents(spark, sf_dir).filter(_FIRST_HALF))
    warehouse.refresh_profile()
    opened = import_history.open_history(spark, warehouse.root)
    stream_history(spark, files, warehouse.root, new_stage_path(spark, "stream"), "*.txt").awaitTermination()
    return _per_track(opened, "opened").unionByName(_per_track(spark.table(fx.HISTORY_VIEW), "now"))


# Documents of even numbers, which their names hold.
_FIRST_HALF = "cast(substring(file_name, 9, 12) AS bigint) % 2 = 0"


@query
def view_after_reset(spark, sf_dir):
    """The view as opened before a reset, and as published after the next load."""
    warehouse = Warehouse(spark, new_stage_path(spark, "warehouse"))
    documents = adapters.stored_documents(spark, sf_dir)
    import_history.load_documents(warehouse, documents)
    opened = import_history.open_history(spark, warehouse.root)
    warehouse.reset()
    import_history.load_documents(warehouse, documents.filter(_FIRST_HALF))
    return _per_track(opened, "opened").unionByName(_per_track(spark.table(fx.HISTORY_VIEW), "now"))


@query
def import_summary(spark, sf_dir):
    report = import_history.import_history(
        spark,
        _export_files(spark, sf_dir),
        new_stage_path(spark, "warehouse"),
        reset=True,
        features=adapters.feature_source(spark, sf_dir),
        encoder=encoders.hashing_encoder(),
        pattern="*.txt",
    )
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in report.items()])


@query
def reset_reload(spark, sf_dir):
    warehouse = Warehouse(spark, new_stage_path(spark, "warehouse"))
    star = adapters.star(spark, sf_dir)
    names = ["tracks", "artists", "track_artists"]
    for _ in range(2):
        warehouse.reset()
        for name in names:
            warehouse.append(name, star[name])
    return _row_counts(warehouse, [*names, "played_history"])


# --- upserts ------------------------------------------------------------------------------


@query
def upsert_nothing(spark, sf_dir):
    """Returned items are stored already; all items come in."""
    rows = adapters.lineitem_plays(spark, sf_dir)
    keys, order = ["track_uri", "played_at"], ["file_no", "pos", "played_time_order"]
    rows = rows.withColumn("played_time_order", F.col("played_time"))
    stored = dimensions.first_wins(rows.filter(F.col("returnflag") == "R").drop("returnflag"), keys, order)
    return upsert.insert_if_absent(stored, rows.drop("returnflag"), keys, order)


def _sent_features(spark, sf_dir):
    source = adapters.feature_source(spark, sf_dir)
    ids = source.select(F.concat(F.lit(fx.TRACK_URI_PREFIX), "id").alias("uri")).distinct()
    return enrich.found_features(ids, source)


@query
def upsert_features(spark, sf_dir):
    stored = adapters.audio_features(spark, sf_dir)
    sent = _sent_features(spark, sf_dir)
    return upsert.insert_or_update(stored, sent, "track_uri", FEATURE_COLUMNS)


@query
def update_stored(spark, sf_dir):
    """Features put over stored ones in four parts, which readers merge."""
    warehouse = Warehouse(spark, new_stage_path(spark, "warehouse"))
    warehouse.append("audio_features", adapters.audio_features(spark, sf_dir))
    sent = stage(_sent_features(spark, sf_dir), "sent")
    for part in range(4):
        rows = sent.filter(F.pmod(F.xxhash64("track_uri"), F.lit(4)) == part)
        warehouse.update("audio_features", rows, FEATURE_COLUMNS)
    return warehouse.read("audio_features").select("track_uri", *FEATURE_COLUMNS)


@query
def upsert_embeddings(spark, sf_dir):
    """Half of the labels are sent again with new vectors, the rest as new tracks."""
    rows = adapters.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("track_uri"), "embedding", "label"
    )
    key = F.when(F.col("label") < 5, F.col("track_uri")).otherwise(F.concat(F.lit("new-"), "track_uri"))
    sent = rows.select(key.alias("track_uri"), F.reverse("embedding").alias("embedding"))
    merged = upsert.insert_or_update(rows.drop("label"), sent, "track_uri", ["embedding"])
    return merged.select("track_uri", _micro("embedding").alias("embedding"))


@query
def play_ids(spark, sf_dir):
    plays = adapters.played_history(spark, sf_dir).select("track_uri", "played_at")
    unique = plays.dropDuplicates(["track_uri", "played_at"])
    return upsert.dense_play_ids(unique, after=1000).select("id", "track_uri", "played_at")


# --- enrichment ------------------------------------------------------------------------------


@query
def missing_features(spark, sf_dir):
    return enrich.missing_features(
        adapters.tracks(spark, sf_dir), adapters.audio_features(spark, sf_dir)
    )


@query
def enrich_features(spark, sf_dir):
    candidates = missing_features(spark, sf_dir)
    return enrich.found_features(candidates, adapters.feature_source(spark, sf_dir))


@query
def embedding_candidates(spark, sf_dir):
    return enrich.embedding_candidates(adapters.star(spark, sf_dir))


@query
def enrichment_stats(spark, sf_dir):
    star = adapters.star(spark, sf_dir)
    candidates = enrich.missing_features(star.tracks, star.audio_features)
    found = enrich.found_features(candidates, adapters.feature_source(spark, sf_dir))
    todo = star.tracks.select("uri").join(
        star.embeddings.select(F.col("track_uri").alias("uri")), "uri", "left_anti"
    )
    parts = {
        "feature_candidates": candidates,
        "features_upserted": found,
        "embedding_candidates": todo,
        "embeddings_upserted": enrich.new_embeddings(star, encoders.hashing_encoder()),
    }
    counts = [
        df.agg(F.lit(name).alias("statistic"), F.count("*").alias("n")) for name, df in parts.items()
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query
def embed_batch(spark, sf_dir):
    star = adapters.star(spark, sf_dir)
    embedded = enrich.new_embeddings(star, encoders.hashing_encoder())
    return embedded.select(
        "track_uri",
        F.size("embedding").alias("width"),
        F.round(vectors.norm(F.col("embedding")), 4).alias("length"),
    )


# --- search ---------------------------------------------------------------------------------


def _mean_vector(spark, sf_dir) -> list[float]:
    """The mean of all embeddings: one row, as wide as a vector."""
    rows = adapters.embeddings(spark, sf_dir).withColumn("all", F.lit(1))
    return list(_centroids(rows, "all").first()["vector"])


@query
def semantic_topk(spark, sf_dir):
    star = adapters.star(spark, sf_dir)
    hits = search.semantic_search(star, _mean_vector(spark, sf_dir))
    return hits.withColumns(
        {
            "artists": F.array_join("artists", "|"),
            "artist_genres": F.array_join("artist_genres", "|"),
            "cosine_distance": F.round("cosine_distance", 6),
        }
    )


@query
def question_topk(spark, sf_dir):
    """A question put to freshly encoded tracks: the text of one of them finds it first."""
    encoder = encoders.hashing_encoder()
    texts = stage(enrich.embedding_texts(enrich.embedding_candidates(adapters.star(spark, sf_dir))), "texts")
    question = texts.agg(F.min_by("text", "track_uri").alias("text")).first()["text"]
    known = encoder(texts, "text", "embedding").select("track_uri", "embedding")
    if question is None:
        return known.select("track_uri", F.lit(0.0).alias("cosine_distance"))
    hits = search.nearest(known, encode_question(spark, question, encoder), 1)
    return hits.select("track_uri", F.abs(F.round("cosine_distance", 6)).alias("cosine_distance"))


@query
def batch_topk(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "embeddings")
    queries = _centroids(rows, "label").select(F.col("label").cast("bigint").alias("query_id"), "vector")
    hits = search.nearest_batch(adapters.embeddings(spark, sf_dir), queries)
    return hits.withColumn("cosine_distance", F.round("cosine_distance", 6))


@query
def ann_topk(spark, sf_dir):
    """Certain search of the stored index: cells are left out by their bounds only."""
    index = cell_index.build(adapters.embeddings(spark, sf_dir), new_stage_path(spark, "cells"))
    hits = index.search(_mean_vector(spark, sf_dir), certain=True)
    return hits.withColumn("cosine_distance", F.round("cosine_distance", 6))


@query
def ann_recall(spark, sf_dir):
    """Every vector with an id divisible by 50, searched in the index and in all rows."""
    rows = adapters.table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(
        F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").alias("vector")
    )
    known = adapters.embeddings(spark, sf_dir)
    index = cell_index.build(known, new_stage_path(spark, "cells"))
    found = index.search_batch(asked)
    exact = search.nearest_batch(known, asked).select("query_id", "track_uri", F.lit(1).alias("hit"))
    both = found.join(exact, ["query_id", "track_uri"], "full")
    return both.agg(
        F.countDistinct("query_id").alias("queries"),
        F.count("rank").alias("found"),
        (F.sum(F.when(F.col("rank").isNotNull(), F.col("hit"))) >= 0.9 * F.count("hit")).alias("recall_reached"),
    )


# --- quality ------------------------------------------------------------------------------------


@query
def dq_unique(spark, sf_dir):
    items = adapters.table(spark, sf_dir, "lineitem")
    return quality.duplicate_keys(items, ["l_orderkey", "l_linenumber"])


@query
def dq_unique_star(spark, sf_dir):
    """Every table's key, over the plays as the export has them, repeats included."""
    star = adapters.star(spark, sf_dir)
    return quality.key_counts(replace(star, played_history=adapters.lineitem_plays(spark, sf_dir)))


@query
def dq_columns(spark, sf_dir):
    out = None
    for name, df in adapters.star(spark, sf_dir).items():
        rules = [r for r in quality.COLUMN_RULES[name] if r[0] in df.columns]
        found = quality.column_violations(df, rules).withColumn("table_name", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


@query
def dq_orphans(spark, sf_dir):
    return quality.all_orphans(adapters.star(spark, sf_dir))


@query
def cascade_delete(spark, sf_dir):
    """All tracks of one album go, with what refers to them."""
    star = adapters.star(spark, sf_dir)
    gone = star.tracks.filter(F.col("album_name") == "Brand#1")
    left = quality.cascade_delete(star, "tracks", gone)
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


# --- statements, results, nested data ----------------------------------------------------------------


@query
def sql_audit(spark, sf_dir):
    rows = adapters.statements(spark, sf_dir)
    cleaned = rows.select("event_id", sql_text.clean_sql(F.col("raw")).alias("sql"))
    return cleaned.select("event_id", "sql", sql_text.audit_sql(F.col("sql")).alias("reason"))


@query
def rows_as_json(spark, sf_dir):
    view = history_view.history_view(adapters.star(spark, sf_dir))
    return json_rows(
        view.select("history_id", "track_uri", "release_date", "played_time_seconds", "artist_genres")
    )


@query
def drop_nested_keys(spark, sf_dir):
    """Keys go from columns, structs, arrays of structs, maps and VARIANT values alike."""
    e = adapters.table(spark, sf_dir, "events")
    inner = F.struct(F.col("value").alias("value"), F.col("user_id").alias("secret"))
    nested = e.select(
        "event_id",
        F.col("props").alias("secret"),
        F.struct(
            F.col("event_type").alias("kind"),
            F.lit("x").alias("secret"),
            F.array(inner, inner).alias("items"),
        ).alias("body"),
        F.create_map(F.lit("secret"), inner, F.lit("kept"), inner).alias("named"),
        F.to_variant_object(F.struct(F.array(inner, inner).alias("list"), inner.alias("secret"))).alias("open"),
    )
    clean = without_keys(nested, ["secret"])
    return clean.select(
        "event_id",
        F.to_json(F.struct(*[c for c in clean.columns if c != "event_id"])).alias("rest"),
    )
