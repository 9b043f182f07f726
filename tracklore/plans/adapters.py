"""Listening-history tables and export documents derived from the supplied test tables.

Every view covers its whole source tables; plays without a track, tracks without
artists or features and artists without genres come out of the values themselves.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.schema import Star
from tracklore.session import stage

RECORDS_PER_DOCUMENT = 1000
# Stored documents are parsed by as many tasks as Spark makes of the files, each file
# counting as 4 MB more than it has; few documents a file keep tasks short.
DOCUMENTS_PER_FILE = 50


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; kept per session, as opening one reads its footers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _track(key: Column) -> Column:
    return F.concat(F.lit(fx.TRACK_URI_PREFIX), key.cast("string"))


def _local_track(key: Column) -> Column:
    return F.concat(F.lit(f"{fx.TRACK_URI_PREFIX}{fx.LOCAL_URI_VERSION}:page-"), key.cast("string"))


def _artist(key: Column) -> Column:
    return F.concat(F.lit("spotify:artist:"), key.cast("string"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are catalogue tracks; pages are local tracks known by title only."""
    parts = table(spark, sf_dir, "part").select(
        _track(F.col("p_partkey")).alias("uri"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("album_name"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size") * 30).alias("release_date"),
        F.col("p_size").alias("popularity"),
        (F.col("p_size") * 1234).alias("duration_ms"),
    )
    pages = table(spark, sf_dir, "pages").select(
        _local_track(F.col("page_id")).alias("uri"), F.col("url").alias("title")
    )
    return parts.unionByName(pages, allowMissingColumns=True)


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The 25 nations of the fixed-size table are looked up as one map value. Joining them
    # would make Spark multiply table sizes and take the artists for a large side.
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    entries = F.collect_list(F.struct("n_nationkey", F.array("n_name", "r_name")))
    lookup = places.agg(F.map_from_entries(entries).alias("m")).scalar()
    located = table(spark, sf_dir, "supplier").withColumn(
        "place", F.try_element_at(lookup, F.col("s_nationkey"))
    )
    return located.filter(F.col("place").isNotNull()).select(
        _artist(F.col("s_suppkey")).alias("uri"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") >= 2000, F.col("place")).alias("genres"),
        F.col("s_nationkey").alias("popularity"),
    )


def track_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distinct on the numeric keys, before they become text.
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.select(
        _track(F.col("l_partkey")).alias("track_uri"),
        _artist(F.col("l_suppkey")).alias("artist_uri"),
    )


def _played_track() -> Column:
    """Exponentially distributed track keys: few tracks hold most plays, and the tail
    lies beyond the known tracks."""
    value = F.col("value")
    return (
        F.when(F.col("event_type") == "error", _local_track(F.floor(value)))
        .when(F.col("event_type") == "signup", _track(F.floor(value * 100)))
        .otherwise(_track(F.floor(value * 10)))
    )


def played_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        _played_track().alias("track_uri"),
        F.col("ts").alias("played_at"),
        F.col("event_type").alias("context_type"),
        F.floor(F.col("value") * 1000).cast("int").alias("played_time"),
    )


def lineitem_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger play table in which (track_uri, played_at) repeats."""
    return table(spark, sf_dir, "lineitem").select(
        _track(F.col("l_partkey")).alias("track_uri"),
        F.col("l_shipdate").alias("played_at"),
        F.floor("l_extendedprice").cast("int").alias("played_time"),
        F.col("l_orderkey").alias("file_no"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_returnflag").alias("returnflag"),
    )


def audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        _track(F.col("c_custkey")).alias("track_uri"),
        (F.abs(balance) / 10000.0).alias("valence"),
        (F.col("c_nationkey") / 25.0).alias("energy"),
        ((25 - F.col("c_nationkey")) / 32.0).alias("danceability"),
        F.when(balance >= 0, balance / 50.0).alias("tempo"),
        (F.col("c_nationkey") / 50.0).alias("acousticness"),
        F.lit(None).cast("double").alias("instrumentalness"),
        F.lit(0.125).alias("liveness"),
        (-balance / 1000.0).alias("loudness"),
        F.lit(0.0625).alias("speechiness"),
    )


def feature_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Externally supplied features by id. Three orders share an id, and many ids belong
    to no track."""
    return table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 3).cast("string").alias("id"),
        (F.col("o_totalprice") / 1000000.0).alias("valence"),
        F.lit(0.5).alias("energy"),
        F.lit(0.25).alias("danceability"),
        (F.col("o_totalprice") / 5000.0).alias("tempo"),
        *[
            F.lit(None).cast("double").alias(c)
            for c in ["acousticness", "instrumentalness", "liveness", "loudness", "speechiness"]
        ],
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        _track(F.col("vec_id")).alias("track_uri"), "embedding"
    )


def star(spark: SparkSession, sf_dir: str) -> Star:
    return Star(
        tracks=tracks(spark, sf_dir),
        artists=artists(spark, sf_dir),
        track_artists=track_artists(spark, sf_dir),
        played_history=played_history(spark, sf_dir),
        audio_features=audio_features(spark, sf_dir),
        embeddings=embeddings(spark, sf_dir),
    )


def stamp_text() -> Column:
    """The time of an event in the spellings exports use; early errors have none."""
    kind, ts = F.col("event_type"), F.col("ts")

    def at(pattern: str, hours: int = 0) -> Column:
        return F.date_format(ts + F.make_dt_interval(hours=F.lit(hours)), pattern)

    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return (
        F.when(kind == "click", F.concat(at(iso), F.lit("Z")))
        .when(kind == "view", F.concat(at(iso, 2), F.lit("+02:00")))
        .when(kind == "purchase", at("yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == "signup", F.concat(at(iso, -5), F.lit("-05:00")))
        .when(F.col("value") < 5, F.lit("not-a-datetime"))
        .otherwise(F.concat(at("yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("Z")))
    )


def _record_json() -> Column:
    """One event as an export record, with the defects exports have."""
    kind, value = F.col("event_type"), F.col("value")
    key = F.floor(value * 10).cast("string")
    uri = F.when(kind == "click", None).when((kind == "view") & (value < 20), "").otherwise(
        _track(F.floor(value * 10))
    )
    title = F.when((kind == "purchase") & (value < 10), None).when(
        (kind == "click") & (value < 3), None
    ).otherwise(F.concat(F.lit("Title "), key))
    artist = F.when((kind == "signup") & (value < 30), None).otherwise(
        F.concat(F.lit("Artist "), F.col("user_id").cast("string"))
    )
    album = F.concat(F.lit("Album "), F.get_json_object("props", "$.k"))
    ms = F.floor(value * 1000) - 5000

    def written(*fields: Column) -> Column:
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    def ending(duration: Column) -> Column:
        return written(duration.alias(fx.KEY_DURATION), F.lit("ignored").alias("platform"))

    # Only the end of a record differs by kind. With five whole records to choose from, the
    # generated code is too long for the JVM to compile.
    beginning = written(
        stamp_text().alias(fx.KEY_TIMESTAMP),
        uri.alias(fx.KEY_TRACK_URI),
        title.alias(fx.KEY_TITLE),
        artist.alias(fx.KEY_ARTIST),
        album.alias(fx.KEY_ALBUM),
    )
    end = (
        F.when(kind == "signup", ending(ms.cast("string")))
        .when((kind == "view") & (value >= 100), ending(F.lit(None).cast("bigint")))
        .when((kind == "error") & (value >= 100), ending(F.lit("abc")))
        .when(kind == "error", ending(ms + F.lit(0.75)))
        .otherwise(ending(ms))
    )
    # A text or null stands before the one brace and a key after the other.
    return F.concat(F.rtrim(beginning, F.lit("}")), F.lit(","), F.ltrim(end, F.lit("{")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export documents of at most ``RECORDS_PER_DOCUMENT`` events each.

    Every document starts with two elements that are not objects. Each comes with a
    truncated copy and one whose root is an object; neither may add a record.
    """
    return _with_broken_copies(_whole_documents(spark, sf_dir))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for several readers: the whole ones are written once, the copies are made
    from them when read."""
    whole = _whole_documents(spark, sf_dir)
    return _with_broken_copies(stage(whole, "documents", maxRecordsPerFile=DOCUMENTS_PER_FILE))


def _whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, text) of every document."""
    events = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / RECORDS_PER_DOCUMENT).alias("doc"),
        F.struct("event_id", _record_json().alias("json")).alias("item"),
    )
    arrays = events.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    body = F.array_join(F.transform("items", lambda i: i["json"]), ",")
    text = F.concat(F.lit('["a text",17,'), body, F.lit("]"))
    name = F.concat(F.lit("history-"), F.lpad(F.col("doc").cast("string"), 12, "0"))
    return arrays.select(name.alias("name"), text.alias("text"))


def _with_broken_copies(whole: DataFrame) -> DataFrame:
    name, text = F.col("name"), F.col("text")
    variants = F.array(
        F.struct(F.concat(name, F.lit(".json")).alias("file_name"), text.alias("value")),
        F.struct(
            F.concat(name, F.lit("-cut.json")).alias("file_name"),
            F.left(text, F.length(text) - 1).alias("value"),
        ),
        F.struct(
            F.concat(name, F.lit("-root.json")).alias("file_name"),
            F.concat(F.lit('{"items":'), text, F.lit("}")).alias("value"),
        ),
    )
    return whole.select(F.inline(variants))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SQL statement per event, good and bad: (event_id, raw)."""
    kind, value = F.col("event_type"), F.col("value")
    n = F.floor(value).cast("string")
    view = fx.HISTORY_VIEW

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    raw = (
        F.when((kind == "click") & (value < 20), text("```sql\nSELECT * FROM ", view, " LIMIT ", n, ";\n```"))
        .when((kind == "click") & (value < 60), text("  select track_title from ", view, " where track_title = 'Drop; ", n, "'  ;"))
        .when(kind == "click", text("WITH t AS (SELECT * FROM ", view, ") SELECT * FROM t -- delete ", n))
        .when((kind == "view") & (value < 20), text("SELECT ", n, "; SELECT 2"))
        .when((kind == "view") & (value < 60), text("EXPLAIN SELECT * FROM ", view))
        .when(kind == "view", text("```\n\n```"))
        .when((kind == "purchase") & (value < 20), text("WITH x AS (DELETE FROM tracks RETURNING 1) SELECT ", n, " FROM x"))
        .when((kind == "purchase") & (value < 60), text("SELECT ", n, " FROM somewhere"))
        .when(kind == "purchase", text("SELECT * FROM ", view, " v JOIN tracks t ON 1=1 join\n artists a on ", n, "=1"))
        .when((kind == "signup") & (value < 20), text("/* from tracks; */ SELECT ", n, " FROM ", view))
        .when((kind == "signup") & (value < 60), text("SELECT created_at, updates FROM ", view, " WHERE n='it''s ", n, "'"))
        .when(kind == "signup", text(" ; "))
        .when((kind == "error") & (value < 20), text("SELECT x FROM ", view, "_old"))
        .when((kind == "error") & (value < 60), text("select * from ", view, ", embeddings where 1=", n))
        .otherwise(text("SELECT * FROM ", view, " WHERE a IN (SELECT uri FROM Played_History)"))
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
