"""A stored vector index: an inverted file of k-means cells (V2).

Unit vectors are assigned to the nearest of some centres, and stored as Parquet with a
folder per cell. A search measures its distance to the centres, reads the nearest cells
only (partition pruning), and computes exact distances there. How many rows a cell holds
and how far its farthest one lies from the centre are stored with the centres, so a search
knows beforehand how many cells it needs for ``k`` rows, and a certain search can tell
which other cells might still hold a nearer row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.functions.vectors import dot
from tracklore.operators.search import nearest, nearest_batch
from tracklore.session import stage

# Centres travel to the driver and to every task: cells times width bounds them.
MAX_CELLS = 4096
# Centres are fitted on at most this many rows; every row is assigned and stored.
SAMPLE = 65_536
# Share of true neighbours that the probed cells hold, measured with so many stored rows.
RECALL = 0.95
CALIBRATION = 200
# A cell is measured in pieces of about so many rows and queries.
ROWS_PER_PIECE = 20_000
QUERIES_PER_PIECE = 20_000
# Rows whose vector has no direction: never near anything, last in every list.
_NOWHERE = -1
_ROUNDING = 1e-6


def _with_direction(embeddings: DataFrame, width: int) -> DataFrame:
    """Rows with their unit vector; null for a missing, zero or broken vector or another width."""
    vector = F.col("embedding")
    length = F.sqrt(dot(vector, vector))
    whole = (F.size(vector) == width) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v))
    unit = F.when(
        whole & (length > 0) & (length < float("inf")),
        F.transform(vector, lambda v: F.try_divide(v.cast("double"), length)),
    )
    return embeddings.select("track_uri", "embedding", unit.alias("unit"))


def build(
    embeddings: DataFrame,
    path: str,
    cells: int | None = None,
    sample: int = SAMPLE,
    seed: int = 42,
    recall: float = RECALL,
) -> CellIndex:
    """Store the index of (track_uri, embedding) below ``path``.

    By default there are about as many cells as a cell has rows, ``MAX_CELLS`` at most. A
    search probes as many as hold ``recall`` of the true neighbours of rows asked for.
    """
    spark = embeddings.sparkSession
    sizes = embeddings.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).count()
    common = sizes.orderBy(F.desc("count"), "width").first()  # one row a width
    width = common["width"] if common else 0
    rows = _with_direction(embeddings, width)
    known = rows.filter(F.col("unit").isNotNull()).select("track_uri", "embedding", array_to_vector("unit").alias("unit"))
    total = known.count()
    cells = min(MAX_CELLS, total, cells or max(1, round(total**0.5)))
    nowhere = rows.filter(F.col("unit").isNull()).select("track_uri", "embedding", F.lit(_NOWHERE).alias("cell"))
    if total:
        # A hash deals the sample; the limit only trims what chance adds.
        share = F.pmod(F.xxhash64("track_uri", F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 1.2 * sample / total)))
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="unit", predictionCol="cell").fit(
            known.filter(share).limit(sample)
        )
        centres = [np.asarray(c) for c in model.clusterCenters()]
        units = [(c / np.linalg.norm(c) if np.linalg.norm(c) > 0 else c).tolist() for c in centres]
        table = spark.createDataFrame(list(enumerate(units)), "cell int, centre array<double>")
        placed = model.transform(known).select("track_uri", "embedding", "cell", vector_to_array("unit").alias("unit"))
        # Cells are dealt to files by size: rebalancing splits the large ones.
        stored = placed.drop("unit").unionByName(nowhere)
    else:
        table = spark.createDataFrame([], "cell int, centre array<double>")
        placed, stored = None, nowhere
    stored.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    if placed is not None:
        away = F.acos(F.least(F.greatest(dot(F.col("unit"), F.col("centre")), F.lit(-1.0)), F.lit(1.0)))
        spans = placed.join(F.broadcast(table), "cell").groupBy("cell").agg(F.count("*").alias("size"), F.max(away).alias("radius"))
        table = table.join(spans, "cell")
    else:
        table = table.withColumns({"size": F.lit(0).cast("long"), "radius": F.lit(0.0)})
    table.coalesce(1).write.parquet(f"{path}/centres")
    index = CellIndex(spark, path, probes=1)
    index.probes = _probes_needed(index, embeddings, known, recall) if len(index.cells) > 1 else 1
    spark.createDataFrame([(index.probes,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    return index


def _probes_needed(index: CellIndex, embeddings: DataFrame, known: DataFrame, recall: float) -> int:
    """How many of the nearest cells hold ``recall`` of the true neighbours of some rows.

    Measured against an exact search for a fixed number of stored rows, which don't count
    as their own neighbours.
    """
    name = F.xxhash64("track_uri")
    asked = known.orderBy(F.xxhash64("track_uri", F.lit("asked")), "track_uri").limit(CALIBRATION)
    asked = stage(asked.select(name.alias("query_id"), vector_to_array("unit").alias("vector")), "asked")
    near = nearest_batch(embeddings, asked, fx.SEARCH_K + 1).filter(F.col("query_id") != name)
    cells = near.join(index.rows().select("track_uri", "cell"), "track_uri").select("query_id", "cell").collect()
    place = {}
    for row in asked.collect():  # CALIBRATION rows, and eleven times as many neighbours
        order = np.argsort(index._angles(row.vector), kind="stable")
        place[row.query_id] = {int(index.cells[c]): i + 1 for i, c in enumerate(order)}
    needed = np.sort([place[r.query_id][r.cell] for r in cells])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1


class CellIndex:
    """Searches of a stored index."""

    def __init__(self, spark: SparkSession, path: str, probes: int | None = None):
        self.spark = spark
        self.path = path
        found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MAX_CELLS rows at most
        self.cells = np.array([r.cell for r in found], np.int64)
        self.sizes = np.array([r["size"] for r in found], np.int64)
        self.radii = np.array([r.radius for r in found])
        self.centres = np.array([r.centre for r in found]) if found else np.zeros((0, 0))
        self.probes = probes or spark.read.parquet(f"{path}/probes").first().probes

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        schema = "track_uri string, embedding array<float>, cell int"
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        return stored if cells is None else stored.filter(F.col("cell").isin([int(c) for c in cells]))

    def _angles(self, vector: list[float]) -> np.ndarray | None:
        query = np.asarray(vector, float)
        length = np.linalg.norm(query)
        if len(query) != self.centres.shape[1] or not 0 < length < np.inf:
            return None
        return np.arccos(np.clip(self.centres @ (query / length), -1, 1))

    def search(
        self, vector: list[float], k: int = fx.SEARCH_K, probes: int | None = None, certain: bool = False
    ) -> DataFrame:
        """The ``k`` nearest of the ``probes`` nearest cells, or of as many more as hold
        ``k`` rows, with exact distances: (track_uri, cosine_distance).

        A ``certain`` search then also reads each cell that could hold a nearer row than
        the last one found: a row is never nearer than its centre less the cell's radius.
        A vector without direction has no distance to anything; it reads all rows.
        """
        probes = probes or self.probes
        angles = self._angles(vector)
        if angles is None or self.sizes.sum() < k:
            return nearest(self.rows(), vector, k)
        order = np.argsort(angles, kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1
        chosen = order[: max(probes, enough)]
        hits = nearest(self.rows(self.cells[chosen]), vector, k)
        if not certain or len(chosen) == len(order):
            return hits
        last = max(r.cosine_distance for r in hits.collect())  # k rows
        reach = np.arccos(np.clip(1 - last, -1, 1)) + _ROUNDING
        possible = np.flatnonzero(angles - self.radii <= reach)
        return nearest(self.rows(self.cells[np.union1d(chosen, possible)]), vector, k)

    def search_batch(self, queries: DataFrame, k: int = fx.SEARCH_K, probes: int | None = None) -> DataFrame:
        """(query_id, track_uri, cosine_distance, rank) for queries (query_id bigint, vector
        array) of any number; those without direction find nothing.

        Queries go to the cells they probe, in pieces: large cells and many queries are
        dealt to several tasks, and each piece keeps ``k`` rows a query.
        """
        spark, probes = self.spark, probes or self.probes
        shared = spark.sparkContext.broadcast((self.cells, self.sizes, self.centres))
        pieces = np.maximum(1, -(-self.sizes // ROWS_PER_PIECE))
        parts = max(1, -(-queries.count() // QUERIES_PER_PIECE))

        def probe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, sizes, centres = shared.value
            for batch in source:
                ids, kept, at = batch.column(0).to_pylist(), [], []
                for i, vector in enumerate(batch.column(1).to_pylist()):
                    v = np.array(vector or [], float)
                    length = np.linalg.norm(v)
                    if len(v) != centres.shape[1] or not 0 < length < np.inf or not len(cells):
                        continue
                    order = np.argsort(-(centres @ (v / length)), kind="stable")
                    enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
                    chosen = order[: max(probes, enough)]
                    kept += [i] * len(chosen)
                    at += cells[chosen].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in kept], pa.int64()),
                        batch.column(1).take(pa.array(kept, pa.int64())),
                        pa.array(at, pa.int32()),
                    ],
                    ["query_id", "vector", "cell"],
                )

        many = spark.createDataFrame([(int(c), int(p)) for c, p in zip(self.cells, pieces)], "cell int, pieces int")
        many = F.broadcast(many)  # a row a cell
        piece = F.pmod(F.xxhash64("track_uri"), F.col("pieces")).cast("int")
        rows = self.rows().join(many, "cell").select(
            "track_uri", "embedding", "cell", piece.alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        )
        asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
        asked = asked.mapInArrow(probe, "query_id long, vector array<double>, cell int").join(many, "cell")
        asked = asked.select(
            "query_id", "vector", "cell",
            F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"),
        )

        def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = {"query_id": [], "track_uri": [], "cosine_distance": []}
            if len(left) and len(right):
                uris = left["track_uri"].to_numpy()
                vectors = np.stack(left["embedding"].to_numpy()).astype(float)
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                for low in range(0, len(right), 256):
                    some = right.iloc[low : low + 256]
                    wanted = np.stack(some["vector"].to_numpy())
                    wanted = wanted / np.linalg.norm(wanted, axis=1, keepdims=True)
                    # Rounded, so that equal vectors tie whatever their place in the product.
                    for name, row in zip(some["query_id"], np.round(1.0 - wanted @ vectors.T, 12)):
                        limit = np.partition(row, k - 1)[k - 1] if k < len(row) else np.inf
                        keep = np.flatnonzero(row <= limit)
                        keep = keep[np.lexsort((uris[keep].astype(str), row[keep]))[:k]]
                        found["query_id"] += [name] * len(keep)
                        found["track_uri"] += uris[keep].tolist()
                        found["cosine_distance"] += row[keep].tolist()
            return pd.DataFrame(found).astype({"query_id": "int64", "track_uri": "object", "cosine_distance": "float64"})

        keys = ["cell", "piece", "part"]
        measured = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
            measure, "query_id long, track_uri string, cosine_distance double"
        )
        order = Window.partitionBy("query_id").orderBy("cosine_distance", "track_uri")  # k rows a piece
        return measured.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
