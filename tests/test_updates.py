"""Updates of stored tables: merged by readers, settled by themselves, seen by the view."""

import random

import pytest

from tracklore.operators.upsert import insert_or_update
from tracklore.plans.import_history import import_history, open_history, update_embeddings, update_features
from tracklore.functions.encoders import hashing_encoder
from tracklore.schema import FEATURE_COLUMNS
from tracklore.sources import warehouse as module
from tracklore.sources.warehouse import Warehouse, track_profile
from tests.test_import_scan import EXPORT, write

FEATURES = "track_uri string, tempo double, energy double"


def rows_of(df):
    return sorted(map(str, df.select("track_uri", "tempo", "energy").collect()))


def test_updates_equal_full_rewrites(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MAX_DELTAS", 2)
    rng, store = random.Random(1), Warehouse(spark, str(tmp_path / "w"))
    want = spark.createDataFrame([(f"t{i:02}", float(i), None) for i in range(60)], FEATURES)
    store.append("audio_features", want)
    shapes = set()
    for step in range(6):
        sent = [(f"t{rng.randrange(75):02}", rng.choice([None, float(step)]), rng.random()) for _ in range(4)]
        sent = list({row[0]: row for row in sent}.values())
        sent = spark.createDataFrame(sent, FEATURES)
        store.update("audio_features", sent, ["tempo", "energy"])
        want = spark.createDataFrame(insert_or_update(want, sent, "track_uri", ["tempo", "energy"]).collect(), FEATURES)
        assert rows_of(store.read("audio_features")) == rows_of(want)
        shapes.add(len(store.snapshot().updates("audio_features")))
    assert {1, 2} <= shapes and max(shapes) <= 2
    # A large one is written into the table.
    store.update("audio_features", want.selectExpr("track_uri", "tempo + 1 AS tempo", "energy"), ["tempo", "energy"])
    assert store.snapshot().updates("audio_features") == [] and len(store.snapshot().commits("audio_features")) == 1
    assert rows_of(store.read("audio_features")) == rows_of(want.selectExpr("track_uri", "tempo + 1 AS tempo", "energy"))


def test_an_update_keeps_other_columns_and_old_readers(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    store.append("audio_features", spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], FEATURES))
    opened = store.read("audio_features")
    rows = [("a", None, 5.0), ("n", 3.0, 4.0), (None, 9.0, 9.0), ("n", 3.0, 3.0)]
    store.update("audio_features", spark.createDataFrame(rows, FEATURES), ["tempo"])
    now = {r.track_uri: r for r in store.read("audio_features").collect()}
    assert {k: (r.tempo, r.energy) for k, r in now.items()} == {"a": (None, 2.0), "b": (1.0, 2.0), "n": (3.0, 4.0)}
    assert now["n"].updated_at and not now["a"].updated_at
    assert rows_of(opened) == rows_of(spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], FEATURES))
    store.vacuum(0)
    assert store.read("audio_features").count() == 3
    store.update("audio_features", spark.createDataFrame([], FEATURES), ["tempo"])
    store.overwrite("audio_features", store.read("audio_features").filter("track_uri = 'n'"))
    assert store.read("audio_features").count() == 1
    with pytest.raises(ValueError):
        store.update("track_artists", spark.createDataFrame([("a", "b")], "track_uri string, artist_uri string"), [])


def test_update_meets_another_writer(spark, tmp_path):
    """Rows are merged again when the table changed while they were written."""
    store, root = Warehouse(spark, str(tmp_path / "w")), str(tmp_path / "w")
    store.append("audio_features", spark.createDataFrame([("a", 1.0, 2.0)], FEATURES))
    keep, other = store._store, Warehouse(spark, root)

    def slow(name, rows):
        store._store = keep
        other.update("audio_features", spark.createDataFrame([("a", 7.0, 8.0)], FEATURES), ["energy"])
        return keep(name, rows)

    store._store = slow
    store.update("audio_features", spark.createDataFrame([("a", 5.0, 0.0)], FEATURES), ["tempo"])
    assert [(r.tempo, r.energy) for r in store.read("audio_features").collect()] == [(5.0, 8.0)]


def test_view_and_profile_follow_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MAX_DELTAS", 1)
    monkeypatch.setattr(module, "MAX_UPDATED", 99.0)
    root = str(tmp_path / "w")
    write(tmp_path, "a.json", EXPORT)
    import_history(spark, str(tmp_path / "a.json"), root, encoder=hashing_encoder())
    store = Warehouse(spark, root)
    uris = [r.uri for r in store.read("tracks").collect() if ":local:" not in r.uri]
    ids = [u.split(":")[-1] for u in uris]
    before = {r.track_uri: r.embedding for r in store.read("embeddings").collect()}
    open_history(spark, root)
    for tempo in (100.0, 101.0, 102.0):
        source = spark.createDataFrame(
            [(i, *[tempo] * len(FEATURE_COLUMNS)) for i in ids],
            "id string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS),
        )
        assert update_features(store, source) == len(ids)
        got = {r.track_uri: r.tempo for r in spark.table("v_listening_history").collect() if r.track_uri in uris}
        assert got and set(got.values()) == {tempo}
        store.refresh_profile()
        at = store.snapshot()
        assert at.profile_is_current()
        full = track_profile(at.star())
        assert sorted(map(str, store.profile().select(full.columns).collect())) == sorted(map(str, full.collect()))
    assert update_embeddings(store, hashing_encoder()) == len(before)
    after = {r.track_uri: r.embedding for r in store.read("embeddings").collect()}
    assert after.keys() == before.keys() and all(after[u] != before[u] for u in uris)
