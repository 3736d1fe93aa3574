"""Approximate nearest chunks: vectors in trained cells, of which a question reads only the nearest.

Centroids are fitted by k-means on a bounded sample of the vectors; every vector goes to the cell of its nearest one,
which is a partition column on disk. A question reads the folders of the cells whose centroids are nearest and
compares exactly within them. How many that are is not guessed: the questions are asked against the sample, whose
nearest neighbours are known, and as many cells are read as hold the share of them that is wanted. Neighbours in a
sample are farther away than in the whole table and lie in more cells, so this errs on the side of reading more.
"""

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.operators.vector_search import (
    CANDIDATES, MAX_BROADCAST_QUERIES, _matrix, _unit, groups_of, nearest_rows, number_best, query_blocks,
)
from repoindex.session import scratch_path

# Rows of the sample, whatever the table; and cells, whose centroids every task gets.
SAMPLE_ROWS = 16_384
SAMPLE_NUMBERS = 8 << 20
MAX_CELLS = 2048
ROWS_PER_CELL = 39
ROUNDS = 12
# Share of the nearest neighbours that the cells read must hold, and questions it is measured on.
RECALL = 0.97
MEASURED_QUESTIONS = 512
# Zero vectors are near nothing; every question reads their cell, for they come last but do come.
NO_DIRECTION = -1

_GROUP = ["namespace", "kind"]
_KEYS = [*_GROUP, "id"]


@dataclass
class CellIndex:
    """Rows (namespace, kind, id, embedding, cell), the centroids by cell, the sample (namespace, kind, v) of unit vectors,
    and how many vectors it was taken from."""

    rows: DataFrame
    centroids: np.ndarray
    sample: pa.Table
    total: int

    def where(self, condition: Column) -> "CellIndex":
        """The index of some of the rows; centroids and sample stay those of all."""
        return replace(self, rows=self.rows.where(condition))

    def join_semi(self, keys: DataFrame, on: str) -> "CellIndex":
        return replace(self, rows=self.rows.join(keys, on, "left_semi").select(*self.rows.columns))


def sample_vectors(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` of the vectors and 64 MB of numbers, with the number of all vectors; chosen by a hash of their ids,
    so they are the same in any layout.

    A bound on the hash leaves few more than needed before anything is ordered.
    """
    chosen = vectors.where(F.exists("embedding", lambda x: x != 0)).select(
        F.pmod(F.xxhash64(*_KEYS), F.lit(1 << 30)).alias("h"), *_GROUP, "embedding")
    total, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    rows = max(1, min(rows, SAMPLE_NUMBERS // max(width, 1)))
    if total > rows:
        chosen = chosen.where(F.col("h") < int(min(1.2 * rows / total, 1.0) * (1 << 30)))
    return chosen.orderBy("h").limit(rows).select(*_GROUP, "embedding", F.lit(total).alias("total"))


def fit_cells(vectors: DataFrame, cells: int | None = None, rows: int = SAMPLE_ROWS, seed: int = 7) -> CellIndex:
    """Fit centroids on at most ``rows`` of the vectors and give every vector its cell, in one scan without a shuffle.

    By default there are as many cells as leave ``ROWS_PER_CELL`` sampled vectors to each, at most ``MAX_CELLS``. A table
    without a vector of a direction has no cell but that of the zero vectors.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "cell-sample")
    sample_vectors(vectors, rows).write.parquet(path)
    sample = spark.read.parquet(path)
    found = sample.toArrow()
    total = found["total"][0].as_py() if found.num_rows else 0
    units = _unit(_matrix(found["embedding"])) if found.num_rows else np.zeros((0, 0))
    found = found.select(_GROUP).append_column("v", _lists(units))
    if not found.num_rows:
        return CellIndex(vectors.select(*_KEYS, "embedding", F.lit(NO_DIRECTION).alias("cell")), units, found, total)
    cells = cells or min(MAX_CELLS, max(1, round(min(np.sqrt(4 * len(units)), len(units) / ROWS_PER_CELL))))
    if min(cells, len(units)) == 1:
        centroids = units[:1]
    else:
        features = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        model = KMeans(k=cells, distanceMeasure="cosine", maxIter=ROUNDS, seed=seed).fit(features)
        centroids = _unit(np.array(model.clusterCenters()))
    return CellIndex(with_cells(vectors, centroids), centroids, found, total)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1) * (matrix.shape[1] if len(matrix) else 0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel(), pa.float64()))


def with_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (namespace, kind, id, embedding, cell) by the nearest of the centroids, which are bounded and go to all tasks."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf(T.IntegerType())
    def cell(embeddings: pa.Array) -> pa.Array:
        if not len(embeddings):
            return pa.array([], pa.int32())
        units = _unit(_matrix(embeddings, shared.value.shape[1]))
        nearest = np.argmax(np.nan_to_num(units) @ shared.value.T, axis=1)
        return pa.array(np.where(np.isnan(units[:, 0]), NO_DIRECTION, nearest).astype(np.int32))

    return vectors.select(*_KEYS, "embedding", cell("embedding").alias("cell"))


def write_cells(index: CellIndex, path: str) -> None:
    """The index as Parquet, one folder per cell; AQE splits cells that hold very many rows into several files.

    Vectors are stored in single precision, as chunks have them.
    """
    spark = index.rows.sparkSession
    rows = index.rows.withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    centroids = pa.table({"cell": pa.array(np.arange(len(index.centroids)), pa.int64()), "v": _lists(index.centroids)})
    spark.createDataFrame(centroids).write.parquet(f"{path}/centroids")
    sample = spark.createDataFrame(index.sample).withColumn("total", F.lit(index.total))
    sample.write.parquet(f"{path}/sample")


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    sample = spark.read.parquet(f"{path}/sample").toArrow()
    rows = spark.read.schema(
        "namespace string, kind string, id string, embedding array<float>, cell int").parquet(f"{path}/rows")
    return CellIndex(rows, _matrix(centroids["v"]) if centroids.num_rows else np.zeros((0, 0)),
                     sample.select([*_GROUP, "v"]), sample["total"][0].as_py() if sample.num_rows else 0)


def cells_to_read(index: CellIndex, units: np.ndarray, k: int = CANDIDATES, recall: float = RECALL) -> int:
    """How many of its nearest cells a question must read so that, over the questions given, the share ``recall`` of
    their nearest neighbours is in them.

    Measured on the sample, per namespace and kind. Of a sample that holds a share of the vectors, that share of the k
    nearest stands for them, one at least.
    """
    units = units[~np.isnan(units).any(axis=1)][:MEASURED_QUESTIONS]
    if not len(units) or not index.sample.num_rows:
        return max(len(index.centroids), 1)
    place = np.empty((len(units), len(index.centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(units @ index.centroids.T), axis=1, kind="stable"),
                      np.arange(len(index.centroids))[None, :], axis=1)
    k = max(1, int(np.ceil(k * index.sample.num_rows / index.total)))
    needed = []
    for _, rows in groups_of(index.sample):
        there = _matrix(index.sample["v"].take(pa.array(rows)))
        homes = np.argmax(there @ index.centroids.T, axis=1)
        near = np.argsort(-(units @ there.T), axis=1, kind="stable")[:, :k]
        needed.append(np.take_along_axis(place, homes[near], axis=1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def probed_cells(index: CellIndex, units: np.ndarray, probes: int) -> dict[int, np.ndarray]:
    """Cell → lines of the questions that read it. A question without a direction reads all."""
    order = np.argsort(-(np.nan_to_num(units) @ index.centroids.T), axis=1, kind="stable")
    reads = np.zeros((len(units), len(index.centroids)), bool)
    np.put_along_axis(reads, order[:, :probes], True, axis=1)
    reads[np.isnan(units).any(axis=1)] = True
    found = {cell: np.flatnonzero(reads[:, cell]) for cell in range(len(index.centroids)) if reads[:, cell].any()}
    return {NO_DIRECTION: np.arange(len(units)), **found}


def cell_topk(index: CellIndex, queries: DataFrame, k: int = CANDIDATES, recall: float = RECALL,
              probes: int | None = None, block: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Approximate ``vector_topk`` with the same columns: exact distances, but only within the cells a question reads.

    ``probes`` says how many cells that are; by default as many as ``recall`` needs on the index's sample. Only folders that
    some question reads are read. A cell that holds a third of all vectors is only scanned, by as many tasks as hold it.
    """
    hits = []
    for asked in query_blocks(queries, block):
        if not asked.num_rows or not len(index.centroids):
            hits.append(nearest_rows(index.rows, asked, k))
            continue
        units = _unit(_matrix(asked["embedding"], index.centroids.shape[1]))
        cells = probed_cells(index, units, probes or cells_to_read(index, units, k, recall))
        hits.append(nearest_rows(index.rows.where(F.col("cell").isin(list(cells))), asked, k, cells))
    return number_best(reduce(DataFrame.unionByName, hits), k)


def recall_of(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, neighbours, found): of the exact hits of each question, how many the approximate ones hold."""
    keys = ["query_id", *_KEYS]
    held = exact.select(*keys).join(approximate.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return held.groupBy("query_id").agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
