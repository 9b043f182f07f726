"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import cell_index, search

SCHEMA = "track_uri string, embedding array<float>"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(12, 16)) * 3
    data = np.vstack([centres[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16)), np.tile(centres[0], (40, 1))])
    data = data.astype("float32")
    rows = [(f"t{i:04}", [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [("zero", [0.0] * 16), ("none", None), ("short", [1.0]), ("nan", [float("nan")] * 16), ("empty", [])]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    path = str(tmp_path_factory.mktemp("index") / "cells")
    return data, df, cell_index.build(df, path, sample=700), path


def rows_of(df):
    return [(r.track_uri, r.cosine_distance and round(r.cosine_distance, 9)) for r in df.collect()]


def test_every_row_is_stored_once(stored):
    _, df, index, path = stored
    assert index.rows().select("track_uri").exceptAll(df.select("track_uri")).count() == 0
    assert index.rows().count() == df.count() and index.sizes.sum() == 1540
    assert len(index.cells) == 39
    again = cell_index.CellIndex(df.sparkSession, path)
    assert (again.sizes == index.sizes).all() and again.probes == index.probes > 0


def test_certain_search_is_exact_and_reads_few_cells(stored):
    data, df, index, _ = stored
    rng = np.random.default_rng(22)
    for query in [data[3], data[1510], rng.normal(size=16), -data[9]]:
        query = [float(x) for x in query]
        for k in (1, 10):
            assert rows_of(index.search(query, k, probes=1, certain=True)) == rows_of(search.nearest(df, query, k))
    plan = index.search([float(x) for x in data[3]], probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_enough_cells_for_k_rows_and_odd_queries(stored):
    data, df, index, _ = stored
    query = [float(x) for x in data[0]]
    assert index.search(query, 1200, probes=1).count() == 1200
    assert repr(rows_of(index.search(query, 5000))) == repr(rows_of(search.nearest(df, query, 5000)))
    for odd in ([0.0] * 16, [1.0], []):
        assert [u for u, _ in rows_of(index.search(odd, 3))] == [u for u, _ in rows_of(search.nearest(df, odd, 3))]


def test_batch_recall_and_agreement(stored, spark, monkeypatch):
    data, df, index, _ = stored
    monkeypatch.setattr(cell_index, "ROWS_PER_PIECE", 30)
    monkeypatch.setattr(cell_index, "QUERIES_PER_PIECE", 15)
    ids = list(range(0, 1540, 50))
    asked = [(i, [float(x) for x in data[i]]) for i in ids] + [(9001, [0.0] * 16), (9002, None), (9003, [1.0])]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    got = index.search_batch(queries, 10, probes=8).collect()
    assert {r.query_id for r in got} == set(ids) and len(got) == 10 * len(ids)
    for i in ids[:3] + ids[-1:]:
        own = [r.track_uri for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i]
        assert own == [u for u, _ in rows_of(index.search([float(x) for x in data[i]], 10, probes=8))]
    got = index.search_batch(queries).collect()  # as many probes as were found to be needed
    exact = search.nearest_batch(df, queries.filter("query_id < 9000"), 10).collect()
    hits = {(r.query_id, r.track_uri) for r in exact} & {(r.query_id, r.track_uri) for r in got}
    assert len(hits) >= 0.9 * len(exact)


def test_nothing_to_index(spark, tmp_path):
    index = cell_index.build(spark.createDataFrame([("a", None)], SCHEMA), str(tmp_path / "a"))
    assert [u for u, _ in rows_of(index.search([1.0, 2.0], 3))] == ["a"]
    none = cell_index.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))
    assert none.search([1.0], 3).count() == 0
    asked = spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<double>")
    assert none.search_batch(asked).count() == 0
