"""Scan, normalisation and dimensions of export files."""

import json

import pytest
from pyspark.sql import functions as F

from tracklore.operators import dimensions, normalise
from tracklore.sources.history_json import explode_records, read_documents, scan_history


def record(ts="2025-01-02T10:30:00Z", uri="spotify:track:t1", title="T", artist="A", album="L", **kw):
    out = {
        "ts": ts,
        "spotify_track_uri": uri,
        "master_metadata_track_name": title,
        "master_metadata_album_artist_name": artist,
        "master_metadata_album_album_name": album,
        "ms_played": 1000,
    }
    out.update(kw)
    return {k: v for k, v in out.items() if v != "absent"}


EXPORT = [
    record("31/03/2023 07:00", "spotify:track:k9", "Undertow", "Ines Mar", "Tidewater"),
    record("2023-03-31T07:05:09Z", "spotify:track:k1", "Slow Ferry", "Ines Mar", "Tidewater", ms_played=64250),
    record("2023-03-31T07:09:40Z", None, "Łódka", "Żaneta Próchno", "Rzeka"),
    record("2023-03-31T07:13:00Z", None, "Lodka", "Zaneta Prochno", "Rzeka"),
    record("2023-03-31T07:20:30Z", "spotify:track:k2", "Granite Choir", "Ines Mar", "Tidewater", ms_played=-42),
    record("2023-03-31T21:55:00Z", "spotify:track:k3", "Granite Choir", None, "Loose Ends"),
    record("2023-04-01T00:00:00Z", None, None, "Ines Mar", "Tidewater"),
    record("2023-04-01T00:04:00Z", "spotify:track:k4", None, "Tomas Vell", None),
    record("2023-04-01T00:08:00Z", None, "Δρόμος", "Νίκη", "Φως"),
    record("2023-04-02T06:30:00Z", None, "Ferry Slip", "Tomas Vell", "Jetty"),
    record("", "spotify:track:k1", "Slow Ferry", "Ines Mar", "Tidewater"),
    record("2023-04-02T06:34:00Z", "spotify:track:k1", "Slow Ferry (live)", "Ines Mar", "Tidewater", ms_played=64250),
    record("2023-04-02T06:41:00Z", "spotify:track:k5", "Undertow", "Ines Mar", "Tidewater"),
]
# One play that EXPORT holds too, in another spelling, and two new ones.
OVERLAP = [
    record("2023-04-03T12:00:00Z", "spotify:track:k5", "Undertow", "Ines Mar", "Tidewater"),
    record("2023-03-31T09:05:09+02:00", "spotify:track:k1", "Slow Ferry", "Ines Mar", "Tidewater", ms_played=64250),
    record("2023-04-03T12:05:00Z", "spotify:track:k1", "Slow Ferry", "Ines Mar", "Tidewater", ms_played=64250),
]


def write(folder, name, content):
    text = content if isinstance(content, str) else json.dumps(content, ensure_ascii=False)
    (folder / name).write_text(text, encoding="utf-8")


def load(spark, path):
    return normalise.normalise(scan_history(read_documents(spark, str(path))))


def test_export_counts(spark, tmp_path):
    write(tmp_path, "a.json", EXPORT)
    rows = load(spark, tmp_path).cache()
    plays = normalise.valid_plays(rows)
    assert (rows.count(), plays.count()) == (13, 10)
    assert dimensions.track_rows(plays).count() == 9
    assert dimensions.artist_rows(plays).count() == 5
    assert dimensions.track_artist_rows(plays).count() == 8
    reasons = sorted(r.reason for r in normalise.rejected(rows).collect())
    assert reasons == ["invalid_timestamp", "invalid_timestamp", "missing_identity"]
    tracks = {r.uri: r for r in dimensions.track_rows(plays).collect()}
    assert tracks["spotify:track:k1"].title == "Slow Ferry" and tracks["spotify:track:k1"].duration_ms is None
    assert tracks["spotify:track:k4"].title == "Unknown Title"
    assert sorted(r.title for u, r in tracks.items() if ":local:" in u) == ["Ferry Slip", "Lodka", "Łódka", "Δρόμος"]
    played = {r.track_uri: r.playback_ms for r in plays.collect()}
    assert played["spotify:track:k1"] == 64250 and played["spotify:track:k2"] == 0
    assert "spotify:track:k3" not in {r.track_uri for r in dimensions.track_artist_rows(plays).collect()}


def test_faulty_files_do_not_affect_others(spark, tmp_path):
    write(tmp_path, "a.json", json.dumps(EXPORT)[:-1])
    write(tmp_path, "b.json", {"error": "not an array", "items": EXPORT})
    write(tmp_path, "c.json", json.dumps(EXPORT) + " trailing")
    write(tmp_path, "d.json", json.dumps(EXPORT) + json.dumps(EXPORT))
    write(tmp_path, "e.json", json.dumps(OVERLAP) + "," + json.dumps(OVERLAP))
    write(tmp_path, "f.json", "")
    write(tmp_path, "g.json", "null")
    write(tmp_path, "h.json", "﻿" + json.dumps(OVERLAP))
    (tmp_path / "i.json").write_bytes(b'[{"ts":"\xff"}]')
    write(tmp_path, "j.json", "[{'ts': 1}]")
    write(tmp_path, "k.json", "]" + json.dumps(OVERLAP))
    write(tmp_path, "l.json", "[]], [[]")
    write(tmp_path, "z.json", "\n " + json.dumps(OVERLAP, indent=2) + " \n")
    rows = load(spark, tmp_path).collect()
    assert {r.file_name for r in rows} == {"z.json"} and len(rows) == 3


def test_elements_that_are_not_objects(spark, tmp_path):
    write(tmp_path, "a.json", ["text", '{"ts": 1}', 12345, None, [record()], record()])
    rows = explode_records(read_documents(spark, str(tmp_path))).collect()
    assert [r.pos for r in rows] == [5]


def test_repeated_keys_and_non_numbers_keep_the_file(spark, tmp_path):
    text = json.dumps([record(uri="spotify:track:a")])
    twice = text.replace('"ms_played": 1000', '"ms_played": 1, "ms_played": 2')
    write(tmp_path, "a.json", twice)
    write(tmp_path, "b.json", text.replace("1000", "NaN"))
    rows = {r.file_name: r for r in load(spark, tmp_path).collect()}
    assert rows["a.json"].playback_ms == 2
    assert rows["b.json"].reason == "invalid_duration"


def test_discovery(spark, tmp_path):
    for name in ["b.json", "a.json", "notes.txt", "a b%+.json", "C.JSON"]:
        write(tmp_path, name, "[]")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub", "d.json", "[]")
    found = sorted(r.file_name for r in read_documents(spark, str(tmp_path)).collect())
    assert found == ["a b%+.json", "a.json", "b.json"]
    single = read_documents(spark, str(tmp_path / "notes.txt")).collect()
    assert [r.file_name for r in single] == ["notes.txt"]
    assert read_documents(spark, str(tmp_path / "absent")).count() == 0


def test_own_files_beside_folders_that_look_like_partitions(spark, tmp_path):
    folder = tmp_path / "from [1] {a}"
    (folder / "year=2024").mkdir(parents=True)
    write(folder, "a.json", [record()])
    write(folder / "year=2024", "b.json", [record()])
    assert [r.file_name for r in read_documents(spark, str(folder)).collect()] == ["a.json"]
    assert read_documents(spark, str(folder / "a.json")).count() == 1
    assert read_documents(spark, str(folder), "*.csv").count() == 0


@pytest.mark.parametrize(
    ("ms", "want"),
    [
        (77, 77), ("77", 77), (" 77 ", 77), ("+5", 5), ("1_000", 1000), (1.9, 1), (-1.9, 0),
        (True, 1), (False, 0), (1e3, 1000), (-3, 0), (0, 0),
        ("1.9", "invalid_duration"), ("", "invalid_duration"), ("x", "invalid_duration"),
        ([], "invalid_duration"), ({}, "invalid_duration"), (10**12, "invalid_duration"),
        (10**30, "invalid_duration"), (-(10**30), 0), (-1e16, 0), ("-99999999999999999999", 0), (None, "missing_duration"), ("absent", "missing_duration"),
    ],
)
def test_durations(spark, tmp_path, ms, want):
    write(tmp_path, "a.json", [record(ms_played=ms)])
    row = load(spark, tmp_path).first()
    assert (row.reason or row.playback_ms) == want


def test_values_of_other_types(spark, tmp_path):
    rows = [
        record(ts=123), record(ts=[]), record(uri=0), record(uri=False, title=None), record(uri=5),
        record(title=7), record(artist=[]), record(artist=["x"]), record(title="", uri=""), record(ts=""),
    ]
    write(tmp_path, "a.json", rows)
    got = [r.reason for r in load(spark, tmp_path).orderBy("pos").collect()]
    assert got == [
        "invalid_timestamp", "invalid_timestamp", None, "missing_identity", "wrong_type",
        "wrong_type", None, "wrong_type", "missing_identity", "invalid_timestamp",
    ]


def test_an_album_of_another_type_keeps_its_play(spark, tmp_path):
    albums = ["L", 7, 1.5, True, None, ["x"], {"a": 1}, ""]
    write(tmp_path, "a.json", [record(album=a) for a in albums])
    got = load(spark, tmp_path).orderBy("pos").collect()
    assert [r.reason for r in got] == [None] * 8
    assert [r.album_name for r in got] == ["L", "7", "1.5", "true", None, None, None, ""]


def test_first_row_wins_in_file_and_array_order(spark, tmp_path):
    write(tmp_path, "b.json", [record(title="B", artist="星空")])
    write(tmp_path, "a.json", [record(title="A1", artist="夜空"), record(title="A2")])
    plays = normalise.valid_plays(load(spark, tmp_path))
    for frame in (plays, plays.repartition(7)):
        assert [r.title for r in dimensions.track_rows(frame).collect()] == ["A1"]
        names = {r.uri: r.name for r in dimensions.artist_rows(frame).collect()}
        assert names["spotify:artist:local:"] == "夜空"
    assert dimensions.artist_rows(plays, collision_safe=True).count() == 3
