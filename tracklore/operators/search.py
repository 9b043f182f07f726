"""Similarity search over track embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.functions.vectors import distance_to, dot
from tracklore.operators.skew import broadcast_rows
from tracklore.plans.history_view import track_credits
from tracklore.schema import Star
from tracklore.session import stage

# So many query vectors may travel to every task.
QUERY_BLOCK = 4096
# Rows that a task keeps for all its queries together.
KEPT_PER_TASK = 1 << 20
# Distances worked out at once, and rows or queries of a tile.
CELLS = 1 << 22
TILE = 20_000


def nearest(embeddings: DataFrame, vector: list[float], k: int = fx.SEARCH_K) -> DataFrame:
    """The ``k`` tracks closest to ``vector``: (track_uri, cosine_distance).

    One scan of two columns; each task keeps its own ``k`` best. Distances without a
    value (zero or missing vectors) come last. Ties, up to rounding noise, go by URI.
    """
    return _closest(_distances(embeddings, vector)).limit(k)


def _distances(embeddings: DataFrame, vector: list[float]) -> DataFrame:
    distance = distance_to(F.col("embedding"), vector)
    return embeddings.select("track_uri", distance.alias("cosine_distance"))


def _closest(distances: DataFrame) -> DataFrame:
    return distances.orderBy(F.round("cosine_distance", 12).asc_nulls_last(), "track_uri")


def with_metadata(hits: DataFrame, star: Star, k: int) -> DataFrame:
    """Hits (at most ``k`` rows) with track, artist and feature columns."""
    hits = broadcast_rows(hits, k)
    tracks = star.tracks.select(
        F.col("uri").alias("track_uri"),
        F.col("title").alias("track"),
        F.col("album_name").alias("album"),
        F.col("release_date").cast("string").alias("release_date"),
        "popularity",
    )
    found = tracks.join(hits, "track_uri")
    bridge = star.track_artists.join(hits.select("track_uri"), "track_uri", "left_semi")
    credits = track_credits(bridge, star.artists).select(
        "track_uri",
        F.array_sort("names").alias("artists"),
        F.array_sort(F.array_distinct(F.array_compact("genres"))).alias("artist_genres"),
    )
    features = star.audio_features.select(
        "track_uri", "tempo", "energy", "danceability", "valence"
    ).join(hits.select("track_uri"), "track_uri", "left_semi")
    none = F.array().cast("array<string>")
    return found.join(credits, "track_uri", "left").join(features, "track_uri", "left").select(
        "track_uri",
        "track",
        "album",
        F.coalesce("artists", none).alias("artists"),
        F.coalesce("artist_genres", none).alias("artist_genres"),
        "release_date",
        "popularity",
        "tempo",
        "energy",
        "danceability",
        "valence",
        "cosine_distance",
    )


def semantic_search(star: Star, vector: list[float], k: int = fx.SEARCH_K) -> DataFrame:
    """The ``k`` nearest tracks with their metadata, nearest first.

    Distances are computed where the vectors lie; only they meet the tracks. The hits are
    written once, as three joins read them.
    """
    known = _distances(star.embeddings, vector).join(
        star.tracks.select(F.col("uri").alias("track_uri")), "track_uri", "left_semi"
    )
    hits = stage(_closest(known).limit(k), "hits")
    return _closest(with_metadata(hits, star, k))


def nearest_batch(
    embeddings: DataFrame, queries: DataFrame, k: int = fx.SEARCH_K
) -> DataFrame:
    """The ``k`` nearest tracks of each query, ranked; ties, rounded to 12 places, go by URI.

    ``queries`` (query_id bigint, vector array<float>) may hold any number of rows with ids
    of their own. Only pairs with a distance count: a query or track without a direction
    (missing, zero or broken vector) or of another width takes no part.

    Up to ``QUERY_BLOCK`` queries travel to every task (their number is checked first) and
    the embeddings stay where they lie. More of them are dealt, like the embeddings, to tiles
    by hashes; a task gets one tile of each and no query passes the driver. Either way a task
    keeps ``k`` rows per query over all it reads, compares a slice of rows with all its queries
    in one matrix product, and hands on ``k`` rows per query at its end, so no list of pairs
    is ever formed. For millions of queries use the stored index.
    """
    asked = _with_direction(queries.select("query_id", F.col("vector").alias("v")))
    known = _with_direction(embeddings.select("track_uri", F.col("embedding").alias("v")))
    few = max(1, KEPT_PER_TASK // k)
    count = asked.count()
    if count <= min(QUERY_BLOCK, few):
        partial = _by_task(known, asked, k)
    else:
        partial = _by_tile(known, asked, k, -(-count // min(TILE, few)), -(-known.count() // TILE))
    order = ["cosine_distance", "track_uri"]
    bucketed = partial.withColumn("_bucket", F.pmod(F.xxhash64("track_uri"), F.lit(256)))
    first = F.row_number().over(Window.partitionBy("query_id", "_bucket").orderBy(*order))
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return (
        bucketed.withColumn("_n", first)
        .filter(F.col("_n") <= k)
        .withColumn("rank", final)
        .filter(F.col("rank") <= k)
        .select("query_id", "track_uri", "cosine_distance", "rank")
    )


def _with_direction(rows: DataFrame) -> DataFrame:
    """Rows whose vector ``v`` has a finite length above zero."""
    length = dot(F.col("v"), F.col("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    return rows.filter(whole & (length > 0) & (length < float("inf")))


class _Nearest:
    """The ``k`` nearest rows of each query among all rows shown so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.distances = [np.empty(0)] * len(ids)
        self.uris = [np.empty(0, dtype=object)] * len(ids)
        self.worst = np.full(len(ids), np.inf)

    def show(self, uris: np.ndarray, vectors: np.ndarray) -> None:
        rows = max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, len(uris), rows):
            part = vectors[at : at + rows]
            lengths = np.linalg.norm(part, axis=1)
            # Rounded, so that equal vectors tie whatever their place in the product.
            distance = np.round(1.0 - (self.unit @ part.T) / lengths, 12)
            for q in np.nonzero(distance.min(axis=1) <= self.worst)[0]:
                self._merge(q, distance[q], uris[at : at + rows])

    def _merge(self, q: int, row: np.ndarray, uris: np.ndarray) -> None:
        limit = self.worst[q]
        if self.k < len(row):
            limit = min(limit, np.partition(row, self.k - 1)[self.k - 1])
        near = np.nonzero(row <= limit)[0]
        distances = np.concatenate([self.distances[q], row[near]])
        names = np.concatenate([self.uris[q], uris[near]])
        if len(names) >= self.k:
            keep = np.lexsort((names.astype(str), distances))[: self.k]
            distances, names = distances[keep], names[keep]
            self.worst[q] = distances[-1]
        self.distances[q], self.uris[q] = distances, names

    def rows(self) -> pa.Table:
        sizes = [len(d) for d in self.distances]
        return pa.table(
            {
                "query_id": pa.array(np.repeat(self.ids, sizes), type=pa.int64()),
                "track_uri": pa.array(np.concatenate(self.uris), type=pa.string()),
                "cosine_distance": pa.array(np.concatenate(self.distances), type=pa.float64()),
            }
        )


def _by_width(names: pa.Array, vectors: pa.ListArray):
    """(names, matrix) of the rows of each width; usually there is one."""
    names = names.to_numpy(zero_copy_only=False)
    ends = np.asarray(vectors.value_lengths())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
    starts = np.cumsum(ends) - ends
    for width in np.unique(ends):
        here = np.nonzero(ends == width)[0]
        yield int(width), names[here], flat[starts[here][:, None] + np.arange(width)]


def _column(table, place: int) -> pa.Array:
    column = table.column(place)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


_HITS = "query_id long, track_uri string, cosine_distance double"


def _by_task(known: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``k`` rows per query and task of ``known``; ``asked`` holds ``QUERY_BLOCK`` rows at most."""
    table = asked.select(F.col("query_id").cast("long"), "v").toArrow()
    blocks = {w: (ids, matrix) for w, ids, matrix in _by_width(_column(table, 0), _column(table, 1))}

    def best(batches):
        found = {w: _Nearest(ids, matrix, k) for w, (ids, matrix) in blocks.items()}
        for batch in batches:
            for width, uris, vectors in _by_width(batch.column(0), batch.column(1)):
                if width in found:
                    found[width].show(uris, vectors)
        for kept in found.values():
            yield from kept.rows().to_batches(max_chunksize=65_536)

    return known.mapInArrow(best, _HITS)


def _by_tile(known: DataFrame, asked: DataFrame, k: int, across: int, down: int) -> DataFrame:
    """``k`` rows per query and tile: every tile of queries meets every tile of embeddings."""
    down = max(1, down)

    def dealt(rows: DataFrame, name: str, own: str, tiles: int, other: str, others: int) -> DataFrame:
        tile = F.pmod(F.xxhash64(name, "v"), F.lit(tiles)).cast("int")
        meets = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return rows.withColumn(own, tile).withColumn(other, meets)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for width, ids, matrix in _by_width(_column(right, 0), _column(right, 1)):
            kept = _Nearest(ids, matrix, k)
            for other, uris, vectors in _by_width(_column(left, 0), _column(left, 1)):
                if other == width:
                    kept.show(uris, vectors)
            out.append(kept.rows())
        empty = pa.schema([("query_id", pa.int64()), ("track_uri", pa.string()), ("cosine_distance", pa.float64())])
        return pa.concat_tables(out) if out else empty.empty_table()

    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), "v")
    left = dealt(known, "track_uri", "_row", down, "_column", across).groupBy("_row", "_column")
    right = dealt(asked, "query_id", "_column", across, "_row", down).groupBy("_row", "_column")
    return left.cogroup(right).applyInArrow(best, _HITS)


class AnnIndex:
    """Approximate search by random-projection hashing.

    ``build`` hashes unit vectors into several tables once; a search reads only the
    buckets the query falls into, measures those vectors exactly, and falls back to the
    exact scan when the buckets hold fewer than ``k`` tracks.
    """

    def __init__(self, model, buckets: DataFrame):
        self.model = model
        self.buckets = buckets

    @classmethod
    def build(
        cls,
        embeddings: DataFrame,
        tables: int = 8,
        bucket_length: float = 0.6,
        seed: int = 42,
    ) -> AnnIndex:
        unit = _unit_vectors(embeddings)
        lsh = BucketedRandomProjectionLSH(
            inputCol="unit", outputCol="hashes", numHashTables=tables,
            bucketLength=bucket_length, seed=seed,
        )
        model = lsh.fit(unit)
        return cls(model, _bucket_rows(model, unit, "track_uri"))

    def search(self, embeddings: DataFrame, vector: list[float], k: int = fx.SEARCH_K) -> DataFrame:
        spark = embeddings.sparkSession
        query = spark.createDataFrame([("query", vector)], "track_uri string, embedding array<double>")
        wanted = _bucket_rows(self.model, _unit_vectors(query), "track_uri")
        # One row per hash table.
        wanted = F.broadcast(wanted.select("table_no", "bucket"))
        candidates = (
            self.buckets.join(wanted, ["table_no", "bucket"], "left_semi")
            .select("track_uri")
            .distinct()
        )
        measured = nearest(embeddings.join(candidates, "track_uri", "left_semi"), vector, k)
        if measured.count() < k:
            return nearest(embeddings, vector, k)
        return measured


def _unit_vectors(embeddings: DataFrame) -> DataFrame:
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    scaled = F.transform("embedding", lambda v: F.try_divide(v.cast("double"), F.col("_length")))
    return (
        embeddings.withColumn("_length", length)
        .filter(F.col("_length") > 0)
        .select("track_uri", array_to_vector(scaled).alias("unit"))
    )


def _bucket_rows(model, unit: DataFrame, key: str) -> DataFrame:
    # The outer form keeps Spark from filtering on hashes before vectors without length
    # are out of the way; every remaining vector has hashes.
    hashed = model.transform(unit).select(key, F.posexplode_outer("hashes").alias("table_no", "h"))
    return hashed.select(key, "table_no", vector_to_array("h")[0].cast("bigint").alias("bucket"))
