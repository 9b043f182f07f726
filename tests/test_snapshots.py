"""Snapshots of the warehouse: views that stay, several writers, profile upkeep."""

import threading

import pytest
from pyspark.sql import functions as F

from tests.test_import_scan import EXPORT, OVERLAP, record, write
from tracklore.operators.adhoc import query_session, run_structured_query
from tracklore.plans.history_view import track_profile
from tracklore.plans.import_history import import_history, load_documents, open_history
from tracklore.sources import warehouse as warehouse_module
from tracklore.sources.history_json import read_documents
from tracklore.sources.manifests import Manifests
from tracklore.sources.warehouse import PROFILE, Warehouse
from tracklore.streaming.ingest import stream_history

COUNT = "SELECT count(*) AS n FROM v_listening_history"


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def documents(spark, tmp_path, name, rows):
    write(tmp_path, name, rows)
    return read_documents(spark, str(tmp_path / name))


def test_only_one_writer_creates_a_state(spark, tmp_path):
    stores = [Manifests(spark, str(tmp_path / "m")) for _ in range(4)]
    assert stores[0].latest()[0] == 0

    def work(store):
        for _ in range(5):
            store.commit(lambda s: {**s, "last_play_id": s["last_play_id"] + 1})

    threads = [threading.Thread(target=work, args=(s,)) for s in stores]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert stores[0].latest()[0] == 20 and stores[0].latest()[1]["last_play_id"] == 20
    assert stores[1].commit(lambda s: None) is None and stores[1].latest()[0] == 20


def test_opened_views_answer_and_published_ones_follow(spark, tmp_path):
    root, exports = str(tmp_path / "w"), tmp_path / "exports"
    exports.mkdir()
    import_history(spark, str(exports), root)
    opened = [open_history(spark, root)]
    session = query_session(spark, lambda s: open_history(s, root), Warehouse(spark, root).version)
    counts, published, asked = [0], [], []

    def look():
        opened.append(open_history(spark, root))
        counts.append(opened[-1].count())
        asked.append(run_structured_query(session, COUNT)[0]["n"])

    load_documents(Warehouse(spark, root), documents(spark, tmp_path, "a.json", [record()]))
    published.append(spark.table("v_listening_history").count())
    look()
    write(exports, "b.json", EXPORT)
    stream_history(spark, str(exports), root, str(tmp_path / "c")).awaitTermination()
    published.append(spark.table("v_listening_history").count())
    look()
    Warehouse(spark, root).reset()
    look()
    load_documents(Warehouse(spark, root), documents(spark, tmp_path, "d.json", [record()]))
    published.append(spark.table("v_listening_history").count())
    look()
    assert counts == [0, 1, counts[2], 0, 1] and counts[2] > 5
    assert published == [1, counts[2], 1] and asked == counts[1:]
    assert [view.count() for view in opened] == counts  # each as it was opened


def test_two_loads_at_once(spark, tmp_path):
    root = str(tmp_path / "w")
    sets = [
        [record(f"2025-01-{d:02}T00:00:00Z", f"spotify:track:t{d + k * 3}", "T", "A") for d in range(1, 9)] for k in range(3)
    ]
    frames = [documents(spark, tmp_path, f"{k}.json", rows) for k, rows in enumerate(sets)]
    failed = []

    def work(frame):
        try:
            load_documents(Warehouse(spark, root), frame)
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=work, args=(f,)) for f in frames]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    star = Warehouse(spark, root).star()
    ids = [r.id for r in star.played_history.collect()]
    assert len(set(ids)) == len(ids) == 24
    assert sorted(r.uri for r in star.tracks.collect()) == sorted({r["spotify_track_uri"] for s in sets for r in s})
    assert star.artists.count() == 1 and star.track_artists.count() == star.tracks.count()


@pytest.mark.parametrize("deltas", [1, 8])
def test_profile_upkeep_equals_a_full_build(spark, tmp_path, monkeypatch, deltas):
    monkeypatch.setattr(warehouse_module, "MAX_DELTAS", deltas)
    store = Warehouse(spark, str(tmp_path / "w"))
    same = lambda: rows_of(store.profile()) == rows_of(track_profile(store.star()))
    load_documents(store, documents(spark, tmp_path, "a.json", EXPORT))
    assert store.profile() is None
    store.refresh_profile()
    assert store.snapshot().profile_is_current() and same()
    changes = {
        "audio_features": [("spotify:track:k1", 99.0)],
        "track_artists": [("spotify:track:k2", "spotify:artist:x")],
        "artists": [("spotify:artist:x", "New name")],
        "tracks": [("spotify:track:brandnew", "Title")],
    }
    names = {"audio_features": "track_uri string, tempo double", "track_artists": "track_uri string, artist_uri string",
             "artists": "uri string, name string", "tracks": "uri string, title string"}
    for name, rows in changes.items():
        store.append(name, spark.createDataFrame(rows, names[name]))
        assert not store.snapshot().profile_is_current() and same()  # worked out by the reader
        before = store.snapshot().state["profile"]
        store.refresh_profile()
        after = store.snapshot().state["profile"]
        assert store.snapshot().profile_is_current() and same()
        if len(before["changes"]) < deltas:  # only what changed is written
            assert after["base"] == before["base"]
            assert store.read_commits(PROFILE, after["changes"][-1:]).count() == 1
        else:
            assert after["changes"] == [] and after["base"] != before["base"]
    assert store.profile().filter("track_uri = 'spotify:track:k2' AND artist_names LIKE '%New name%'").count() == 1
    store.overwrite("artists", store.read("artists").withColumn("name", F.upper("name")))
    assert store.profile() is None
    store.refresh_profile()
    assert same()


def test_compact_and_vacuum(spark, tmp_path):
    root = str(tmp_path / "w")
    store = Warehouse(spark, root)
    for k, rows in enumerate((EXPORT, OVERLAP, [record()])):
        load_documents(store, documents(spark, tmp_path, f"{k}.json", rows))
        store.refresh_profile()
    before = {n: rows_of(store.read(n)) for n in ("tracks", "played_history")}
    view, commits = rows_of(open_history(spark, root)), store.snapshot().commits("played_history")
    for name in before:
        store.compact(name)
        assert len(store.snapshot().commits(name)) == 1
    assert {n: rows_of(store.read(n)) for n in before} == before
    assert store.snapshot().profile_is_current() and rows_of(open_history(spark, root)) == view
    kept = open_history(spark, root)
    store.vacuum()  # all is younger than a day
    assert all(store._target(f"{root}/played_history/commit={c}")[1].exists(store._target(f"{root}/played_history/commit={c}")[0]) for c in commits)
    store.vacuum(keep_seconds=-1)
    number = store.version()
    assert [n for n, _ in Manifests(spark, f"{root}/manifests").listed()] == [number - 1, number]
    assert rows_of(kept) == view and {n: rows_of(store.read(n)) for n in before} == before
