"""Upserts, checks, search, statement gate and nested keys on small inputs."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.functions.encoders import model_encoder
from tracklore.functions.nested import drop_nested_keys
from tracklore.functions.vectors import cosine_distance
from tracklore.operators import adhoc, enrich, quality, search, upsert
from tracklore.schema import Star, empty_table
from tracklore.sources.sinks import rows_as_json


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- upserts --------------------------------------------------------------------


def test_insert_if_absent_keeps_stored_and_first_rows(spark):
    stored = frame(spark, [("a", 1)], "k string, v int")
    sent = frame(spark, [("a", 9, 0), ("b", 2, 1), ("b", 3, 0), (None, 4, 2), (None, 4, 3)], "k string, v int, o int")
    out = upsert.insert_if_absent(stored, sent, ["k"], ["o"], nullable_keys=True)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [("a", 1), ("b", 3), (None, 4), (None, 4)], key=repr
    )


def test_update_overwrites_with_null_and_keeps_other_columns(spark):
    stored = frame(spark, [("a", 1, "old"), ("b", 2, "old")], "k string, v int, at string")
    sent = frame(spark, [("a", None, "new"), ("c", 3, "new")], "k string, v int, at string")
    out = {tuple(r) for r in upsert.insert_or_update(stored, sent, "k", ["v"]).collect()}
    assert out == {("a", None, "old"), ("b", 2, "old"), ("c", 3, "new")}


def test_play_ids_do_not_depend_on_partitioning(spark):
    plays = spark.range(500).select(
        F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("track_uri"),
        F.timestamp_seconds(F.col("id")).alias("played_at"),
    )
    a = {(r.track_uri, r.played_at): r.id for r in upsert.dense_play_ids(plays, after=10, digits=1).collect()}
    b = {(r.track_uri, r.played_at): r.id for r in upsert.dense_play_ids(plays.repartition(5), after=10).collect()}
    assert a == b and sorted(a.values()) == list(range(11, 511))
    assert upsert.stable_play_ids(plays).select("id").distinct().count() == 500


# --- quality -------------------------------------------------------------------


def test_column_rules(spark):
    rows = frame(spark, [(None, "x" * 256, ["ok"], [1.0]), ("t", "x", ["y" * 300], None)],
                 "title string, uri string, genres array<string>, embedding array<float>")
    rules = [("title", "not_null", None), ("uri", "max_length", 255), ("genres", "max_item_length", 255), ("embedding", "width", 2)]
    found = {(r.column_name, r.rule): r.violations for r in quality.column_violations(rows, rules).collect()}
    assert set(found.values()) == {1} and len(found) == 4


def test_duplicates_ignore_null_keys(spark):
    rows = frame(spark, [("a", 1), ("a", 1), ("a", None), ("a", None), ("b", 1)], "k string, m int")
    assert [tuple(r) for r in quality.duplicate_keys(rows, ["k", "m"]).collect()] == [("a", 1, 2)]


def star_of(spark, **tables):
    return Star(**{n: tables.get(n, empty_table(spark, n)) for n in
                   ("tracks", "artists", "track_artists", "played_history", "audio_features", "embeddings")})


def test_cascade(spark):
    star = star_of(
        spark,
        tracks=frame(spark, [("a",), ("b",)], "uri string"),
        artists=frame(spark, [("x",)], "uri string"),
        track_artists=frame(spark, [("a", "x"), ("b", "x")], "track_uri string, artist_uri string"),
        played_history=frame(spark, [(1, "a"), (2, "b"), (3, None)], "id int, track_uri string"),
    )
    left = quality.cascade_delete(star, "tracks", frame(spark, [("a",)], "uri string"))
    assert [r.uri for r in left.tracks.collect()] == ["b"]
    assert {r.id for r in left.played_history.collect()} == {2, 3}
    assert left.artists.count() == 1
    gone = quality.cascade_delete(star, "artists", frame(spark, [("x",)], "uri string"))
    assert gone.track_artists.count() == 0 and gone.tracks.count() == 2


# --- enrichment ----------------------------------------------------------------


def test_model_encoder_gets_batches(spark):
    def load():
        def predict(texts):
            return np.array([[len(t), len(texts) <= 4] for t in texts], dtype="float32")

        return predict

    rows = spark.range(40).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    out = model_encoder(load, batch_size=4)(rows, "text", "embedding").collect()
    assert [list(r.embedding) for r in out] == [[float(len(r.text)), 1.0] for r in out]


def test_features_only_for_known_external_ids(spark):
    tracks = frame(spark, [("spotify:track:a",), ("spotify:track:local:v1:x:1",), ("spotify:track:b",)], "uri string")
    have = frame(spark, [("spotify:track:b",)], "track_uri string")
    todo = enrich.missing_features(tracks, have)
    assert {r.uri for r in todo.collect()} == {"spotify:track:a", "spotify:track:local:v1:x:1"}
    source = frame(
        spark, [(i, 0.1, None, None, t, None, None, None, None, None) for i, t in [("a", 1.0), ("a", 2.0), ("b", 3.0), (None, 4.0), ("local:v1:x:1", 5.0)]],
        "id string, valence double, energy double, danceability double, tempo double, acousticness double, "
        "instrumentalness double, liveness double, loudness double, speechiness double")
    found = enrich.found_features(todo, source).collect()
    assert [(r.track_uri, r.tempo) for r in found] == [("spotify:track:a", 2.0)]


# --- search ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(600, 16)).astype("float32")
    data[100:300] = data[100]
    rows = [(f"t{i:04}", [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [("zero", [0.0] * 16), ("none", None)]
    return data, spark.createDataFrame(rows, "track_uri string, embedding array<float>").cache()


def brute(data, query, k):
    d = 1 - (data.astype("float64") @ query) / np.linalg.norm(data.astype("float64"), axis=1) / np.linalg.norm(query)
    order = sorted(range(len(data)), key=lambda i: (round(d[i], 12), f"t{i:04}"))[:k]
    return [(f"t{i:04}", d[i]) for i in order]


def test_nearest_is_exact(vectors):
    data, df = vectors
    query = [float(x) for x in np.random.default_rng(5).normal(size=16)]
    got = search.nearest(df, query, 10).collect()
    want = brute(data, np.array(query), 10)
    assert [r.track_uri for r in got] == [u for u, _ in want]
    assert all(math.isclose(r.cosine_distance, d, abs_tol=1e-9) for r, (_, d) in zip(got, want))
    everything = search.nearest(df, query, 1000).collect()
    assert len(everything) == 602 and {r.track_uri for r in everything[-2:]} == {"zero", "none"}


def test_batch_equals_single_searches_with_many_equal_vectors(spark, vectors):
    data, df = vectors
    queries = [(q, [float(x) for x in v]) for q, v in enumerate(np.vstack([data[100], data[5], -data[7]]))]
    frame_ = spark.createDataFrame(queries, "query_id bigint, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = search.nearest_batch(df.repartition(5), frame_, 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, v in queries:
        hits = sorted((r.rank, r.track_uri) for r in got if r.query_id == q)
        assert [u for _, u in hits] == [u for u, _ in brute(data, np.array(v), 10)]


def test_ann_recall_and_fallback(vectors):
    data, df = vectors
    known = df.filter(F.col("track_uri").startswith("t"))
    index = search.AnnIndex.build(known)
    rng = np.random.default_rng(8)
    hit = 0
    for i in rng.integers(300, 600, size=4):
        query = [float(x) for x in data[i] + 0.05 * rng.normal(size=16)]
        got = index.search(known, query, 5).collect()
        assert len(got) == 5 and got[0].track_uri == f"t{i:04}"
        hit += len({r.track_uri for r in got} & {u for u, _ in brute(data, np.array(query), 5)})
    assert hit >= 0.8 * 20
    assert index.search(known, query, 600).count() == 600


def test_cosine_of_unequal_widths_is_null(spark):
    rows = frame(spark, [([1.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [None, 1.0]


# --- statements --------------------------------------------------------------------


@pytest.mark.parametrize(
    ("sql", "reason"),
    [
        ("", fx.REASON_EMPTY),
        (" ; ", fx.REASON_EMPTY),
        ("select 1; select 2", fx.REASON_SEVERAL),
        ("EXPLAIN SELECT * FROM v_listening_history", fx.REASON_NOT_SELECT),
        ("with x as (delete from tracks) select 1", fx.REASON_WRITES),
        ("select 1", fx.REASON_NO_VIEW),
        ("select 1 from v_listening_history_old", fx.REASON_NO_VIEW),
        ("select * from v_listening_history join tracks on true join Artists on true",
         fx.REASON_RAW_TABLES.format("artists, tracks")),
        ("select * from v_listening_history -- ; drop\n where title = 'delete; from tracks'", None),
        ("/* update */ select created_at from v_listening_history", None),
    ],
)
def test_gate(spark, sql, reason):
    if reason is None:
        assert adhoc.checked_statement(spark, sql) == sql
    else:
        with pytest.raises(ValueError) as error:
            adhoc.checked_statement(spark, sql)
        assert str(error.value) == reason


def test_structured_query(spark):
    def publish(session):
        session.range(500).selectExpr("id AS history_id", "current_date() AS d").createOrReplaceTempView(fx.HISTORY_VIEW)

    spark.range(3).createOrReplaceTempView("private_rows")
    session = adhoc.query_session(spark, publish)
    rows = adhoc.run_structured_query(session, "```sql\nSELECT * FROM v_listening_history ORDER BY history_id;\n```")
    assert len(rows) == 100 and rows[99]["history_id"] == 99
    assert adhoc.rows_as_json(rows[:1]).startswith('[{"history_id":0,"d":"')
    assert len(adhoc.run_structured_query(session, "select * from v_listening_history", max_rows=7)) == 7
    for other in ("private_rows", "parquet.`/tmp`"):
        with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND|not found|UNSUPPORTED"):
            adhoc.run_structured_query(session, f"select * from v_listening_history, {other}")


def test_timeout_interrupts(spark):
    def publish(session):
        slow = session.range(0, 200000, 1, 4).selectExpr(
            "id", "aggregate(sequence(1, 20000 + id % 7), 0D, (a, x) -> a + sqrt(x)) AS x"
        )
        slow.createOrReplaceTempView(fx.HISTORY_VIEW)

    session = adhoc.query_session(spark, publish)
    start = time.time()
    with pytest.raises(TimeoutError):
        adhoc.run_structured_query(session, "select sum(x) from v_listening_history", timeout_ms=500)
    assert time.time() - start < 20


# --- results and nested data -----------------------------------------------------------


def test_rows_as_json_column(spark):
    row = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, DATE '2024-02-03' AS c, 1.50 AS d, array('x') AS e")
    assert rows_as_json(row).first().json == '{"a":1,"b":null,"c":"2024-02-03","d":"1.50","e":["x"]}'


def test_nested_keys_go_at_every_level(spark):
    df = spark.sql(
        "SELECT 1 AS id, 2 AS secret, named_struct('secret', 1, 'in', array(named_struct('a', 1, 'secret', 2))) AS s, "
        "map('secret', named_struct('a', 1), 'kept', named_struct('a', 2)) AS m, "
        "CAST(NULL AS STRUCT<secret: INT, a: INT>) AS n"
    )
    out = drop_nested_keys(df, {"secret"})
    row = out.first().asDict(recursive=True)
    assert row == {"id": 1, "s": {"in": [{"a": 1}]}, "m": {"kept": {"a": 2}}, "n": None}


def test_nested_keys_go_from_variants(spark):
    rng = random.Random(4)

    def value(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice([None, True, 7, 1.5, "x", 'a "quoted\\\\" {[ text', [], {}, "é}"])
        if rng.random() < 0.5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        names = rng.sample(["secret", "a", "b c", "d.e", 'q"{', "hidden"], rng.randrange(4))
        return {name: value(depth - 1) for name in names}

    def without(v):
        if isinstance(v, dict):
            return {k: without(x) for k, x in v.items() if k not in ("secret", "hidden")}
        return [without(x) for x in v] if isinstance(v, list) else v

    deep = {"secret": 1, "a": []}
    for _ in range(14):
        deep = rng.choice([{"a": deep, "hidden": deep and 1}, [deep, 2]])
    values = [value(5) for _ in range(150)] + [deep]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id long, t string")
    v = F.parse_json("t")
    df = df.select("id", v.alias("v"), F.struct(F.array(v, v).alias("l"), F.lit(1).alias("secret")).alias("s"))
    out = drop_nested_keys(df, {"secret", "hidden"}).select("id", F.to_json("v").alias("v"), F.to_json("s").alias("s"))
    for row in out.collect():
        clean = without(values[row.id])
        assert json.loads(row.v) == clean and json.loads(row.s) == {"l": [clean, clean]}
    typed = spark.sql("SELECT to_variant_object(named_struct('d', DATE'2024-01-02', 'secret', 1)) AS v, CAST(NULL AS VARIANT) AS n")
    row = drop_nested_keys(typed, ["secret"]).selectExpr("schema_of_variant(v) AS kind", "n IS NULL AS none").first()
    assert tuple(row) == ("OBJECT<d: DATE>", True)
    assert drop_nested_keys(typed.limit(0), ["secret"]).count() == 0


def test_batch_search_leaves_nan_vectors_out(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0])] + [(f"n{i}", [float("nan"), 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "track_uri string, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.1])], "query_id bigint, vector array<double>")
    got = search.nearest_batch(df, queries, 3).collect()
    assert sorted((r.rank, r.track_uri) for r in got) == [(1, "a"), (2, "b")]


def test_batch_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "TILE", 1)
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "track_uri string, embedding array<double>")
    queries = spark.range(10).selectExpr("id AS query_id", "array(1.0D, double(id) / 4) AS vector")
    got = {r.query_id: r.track_uri for r in search.nearest_batch(df, queries, 1).collect()}
    assert got == {i: "a" if i <= 4 else "b" for i in range(10)}


def test_batch_search_by_task_and_by_tile_agree(spark, vectors, monkeypatch):
    """Ties, repeated rows, other widths, and queries and tracks without a direction."""
    data, df = vectors
    odd = [("nan", [float("nan")] * data.shape[1]), ("inf", [float("inf")] * data.shape[1]), ("short", [1.0, 2.0])]
    odd = spark.createDataFrame(odd, "track_uri string, embedding array<double>")
    df = df.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(odd)
    asked = [(q, [float(x) for x in data[q * 7]]) for q in range(40)]
    asked += [(90, [0.0] * data.shape[1]), (91, None), (92, [1.0, 2.5]), (93, [float("nan")]), (94, [])]
    asked = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    whole = sorted(map(tuple, search.nearest_batch(df, asked, 7).collect()))
    for q in range(40):
        got = [u for i, u, _, _ in sorted(whole, key=lambda r: r[3]) if i == q]
        assert got == [u for u, _ in brute(data, data[q * 7], 7)]
    assert [r[:2] for r in whole if r[0] >= 90] == [(92, "short")]
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    monkeypatch.setattr(search, "TILE", 100)
    monkeypatch.setattr(search, "CELLS", 64)
    assert sorted(map(tuple, search.nearest_batch(df, asked, 7).collect())) == whole
    assert search.nearest_batch(df.limit(0), asked, 7).count() == 0
    assert search.nearest_batch(df, asked.limit(0), 7).count() == 0


@pytest.mark.parametrize(
    "call",
    [
        "java_method('java.lang.System', 'getProperty', 'user.dir')",
        "`reflect`('java.lang.System', 'getProperty', 'user.dir')",
        "(SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir'))",
    ],
)
def test_java_methods_are_refused(spark, call):
    session = adhoc.query_session(spark, lambda s: s.range(3).createOrReplaceTempView("v_listening_history"))
    with pytest.raises(ValueError):
        adhoc.structured_query(session, f"SELECT {call} AS x FROM v_listening_history")
    assert adhoc.structured_query(session, "SELECT 'reflect(' AS x FROM v_listening_history").count() == 3
