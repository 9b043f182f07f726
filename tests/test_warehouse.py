"""Import into the warehouse: idempotence, ids, reset, enrichment, view, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_import_scan import EXPORT, OVERLAP, record, write
from tracklore.functions.encoders import encode_question, hashing_encoder
from tracklore.operators import quality, search
from tracklore.plans.import_history import import_history, open_history
from tracklore.sources.warehouse import Warehouse
from tracklore.streaming.ingest import stream_history


def features_of(spark, ids):
    rows = [(i, 0.1, 0.2, 0.3, 120.0, None, None, None, -5.0, None) for i in ids]
    schema = (
        "id string, valence double, energy double, danceability double, tempo double, "
        "acousticness double, instrumentalness double, liveness double, loudness double, "
        "speechiness double"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("load")
    exports = base / "exports"
    exports.mkdir()
    write(exports, "a.json", EXPORT)
    write(exports, "b.json", OVERLAP)
    write(exports, "c.json", json.dumps(EXPORT)[:-1])
    root = str(base / "warehouse")
    report = import_history(
        spark, str(exports), root,
        features=features_of(spark, ["k1", "k1", "k2", "unknown", "", None]),
        encoder=hashing_encoder(),
    )
    return exports, root, report


def test_report(loaded):
    assert loaded[2] == {
        "records_read": 16,
        "tracks": 9,
        "artists": 5,
        "plays": 12,
        "feature_candidates": 9,
        "features_upserted": 2,
        "embedding_candidates": 9,
        "embeddings_upserted": 9,
    }


def test_ids_are_dense_and_key_is_unique(spark, loaded):
    plays = Warehouse(spark, loaded[1]).star().played_history
    assert sorted(r.id for r in plays.collect()) == list(range(1, 13))
    assert quality.duplicate_keys(plays, ["track_uri", "played_at"]).count() == 0
    assert quality.all_orphans(Warehouse(spark, loaded[1]).star()).count() == 0


def test_view_over_the_warehouse(spark, loaded):
    view = {(r.track_uri, str(r.played_at)): r for r in open_history(spark, loaded[1]).collect()}
    assert len(view) == 12
    row = view[("spotify:track:k1", "2023-03-31 07:05:09")]
    assert (row.track_title, row.artist_names, row.tempo) == ("Slow Ferry", "Ines Mar", 120.0)
    assert str(row.played_time_seconds) == "64.250"
    assert row.duration_seconds is None and row.artist_genres is None
    assert view[("spotify:track:k3", "2023-03-31 21:55:00")].artist_names == "Unknown Artist"


def test_search_by_text(spark, loaded):
    star = Warehouse(spark, loaded[1]).star()
    question = encode_question(spark, "slow ferry. by ines mar.", hashing_encoder())
    hits = search.semantic_search(star, question, k=3).collect()
    assert len(hits) == 3 and hits[0].track == "Slow Ferry"
    assert hits[0].artists == ["Ines Mar"] and hits[0].artist_genres == []


def test_second_import_adds_nothing_then_only_what_is_new(spark, loaded, tmp_path):
    exports, root, first = loaded
    again = import_history(spark, str(exports), root, encoder=hashing_encoder())
    for key in ("tracks", "artists", "plays"):
        assert again[key] == first[key]
    assert again["feature_candidates"] == 7 and again["embeddings_upserted"] == 0
    titles = {r.uri: r.title for r in Warehouse(spark, root).read("tracks").collect()}
    write(tmp_path, "n.json", [
        record("2025-02-01T00:00:00Z", "spotify:track:k1", "Another title", "Ines Mar"),
        record("2025-02-01T01:00:00Z", "spotify:track:new", "New", "Someone"),
    ])
    third = import_history(spark, str(tmp_path), root, features=features_of(spark, ["new"]))
    assert (third["tracks"], third["plays"], third["features_upserted"]) == (10, 14, 1)
    assert third["embedding_candidates"] == 1 and third["embeddings_upserted"] == 0
    after = {r.uri: r.title for r in Warehouse(spark, root).read("tracks").collect()}
    assert {**titles, "spotify:track:new": "New"} == after
    ids = [r.id for r in Warehouse(spark, root).read("played_history").collect()]
    assert sorted(ids) == list(range(1, 15))
    assert open_history(spark, root).count() == 14


def test_reset_starts_over(spark, loaded, tmp_path):
    root = str(tmp_path / "w")
    write(tmp_path, "a.json", EXPORT)
    import_history(spark, str(tmp_path / "a.json"), root)
    write(tmp_path, "b.json", [record()])
    report = import_history(spark, str(tmp_path / "b.json"), root, reset=True)
    assert (report["tracks"], report["artists"], report["plays"]) == (1, 1, 1)
    assert [r.id for r in Warehouse(spark, root).read("played_history").collect()] == [1]
    assert Warehouse(spark, root).read("embeddings").count() == 0


def test_months_are_partitions_and_prune(spark, tmp_path):
    rows = [record(f"2025-{m:02}-03T00:00:00Z", f"spotify:track:t{m}") for m in range(1, 7)]
    write(tmp_path, "a.json", rows)
    root = str(tmp_path / "w")
    import_history(spark, str(tmp_path / "a.json"), root)
    plays = Warehouse(spark, root).read("played_history").filter(F.col("played_month") == "2025-03")
    assert len(plays.inputFiles()) == 6 and plays.count() == 1
    plan = plays._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(played_month" in plan


def test_overwrite_with_a_result_of_the_same_table(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    warehouse.append("track_artists", spark.createDataFrame([("a", "x"), ("b", "y")], "track_uri string, artist_uri string"))
    warehouse.overwrite("track_artists", warehouse.read("track_artists").filter("track_uri = 'a'"))
    assert [r.track_uri for r in warehouse.read("track_artists").collect()] == ["a"]


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    exports = tmp_path / "exports"
    exports.mkdir()
    root, checkpoint = str(tmp_path / "w"), str(tmp_path / "c")
    write(exports, "a.json", EXPORT)
    stream_history(spark, str(exports), root, checkpoint).awaitTermination()
    write(exports, "b.json", OVERLAP)
    write(exports, "bad.json", "[{")
    stream_history(spark, str(exports), root, checkpoint).awaitTermination()
    # A lost checkpoint replays every file; nothing is stored twice.
    stream_history(spark, str(exports), root, str(tmp_path / "c2")).awaitTermination()
    warehouse = Warehouse(spark, root)
    counts = [warehouse.read(n).count() for n in ("tracks", "artists", "track_artists", "played_history")]
    assert counts == [9, 5, 8, 12]


def test_stream_takes_the_same_files_as_a_batch(spark, tmp_path):
    """Own files only, beside folders named like partitions, like exports, or with odd names."""
    exports = tmp_path / "my exports [1]+2%20"
    for folder in ("year=2024", "sub", "inner.json"):
        (exports / folder).mkdir(parents=True)
        write(exports / folder, "hidden.json", [record(master_metadata_track_name="in " + folder)])
    write(exports, "a.json", EXPORT)
    write(exports, "b c+d.json", OVERLAP)
    write(exports, "notes.txt", EXPORT)
    stream_history(spark, str(exports), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    import_history(spark, str(exports), str(tmp_path / "b"))
    streamed, batch = Warehouse(spark, str(tmp_path / "s")), Warehouse(spark, str(tmp_path / "b"))
    for name in ("tracks", "artists", "track_artists", "played_history"):
        columns = [c for c in batch.read(name).columns if c not in ("updated_at", "inserted_at", "id")]
        got, want = (w.read(name).select(columns).collect() for w in (streamed, batch))
        assert sorted(map(str, got)) == sorted(map(str, want)) and want
    with pytest.raises(TypeError):
        stream_history(spark, str(exports), str(tmp_path / "s"))


def test_nothing_to_import(spark, tmp_path):
    report = import_history(spark, str(tmp_path / "absent"), str(tmp_path / "w"))
    assert set(report.values()) == {0}
    assert open_history(spark, str(tmp_path / "w")).count() == 0


def test_view_follows_its_tables(spark, tmp_path):
    """A stored profile is not used once a table behind it has changed."""
    root, store = str(tmp_path / "w"), None
    write(tmp_path, "a.json", [record()])
    import_history(spark, str(tmp_path / "a.json"), root)
    store = Warehouse(spark, root)
    assert store.profile() is not None and open_history(spark, root).count() == 1
    store.overwrite("artists", store.read("artists"))
    assert store.profile() is None and open_history(spark, root).count() == 1
    store.refresh_profile()
    store.reset()
    assert store.profile() is None and open_history(spark, root).count() == 0
