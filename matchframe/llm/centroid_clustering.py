"""k-means on integer vectors; the nearest centroid is found by Orchard search.

* Search: every centroid has a list of the others by rising distance.  A vector starts at
  one centroid and walks down its list; a closer centroid makes it jump to the start of that
  one's list, looked-up centroids are marked and not computed again, and the walk stops at an
  entry strictly beyond twice the vector's present distance: by the triangle inequality
  neither it nor any later one can be as near.  Equal distances go to the smaller
  number.  The vectors of an Arrow batch walk side by side in NumPy.
* Numbers are integers throughout (``floor(scale * x)``), so distances, sums and means are exact
  and do not depend on how Spark deals the rows; twice a distance is four times its square.
* Rounds: tasks add up the vectors of every cluster, Spark adds ``k * dims`` sums a task, and the
  driver holds the ``k`` centroids and their ``k * k`` distances, both bounded by parameters.

Cases: vectors with another number of components, or with a null, infinite or NaN component,
are left out, as is a null vector; components beyond ``LARGEST`` count as ``LARGEST``, so that
no distance leaves 64 bits; with fewer vectors than ``k`` each becomes a centroid; empty clusters
keep their centroid; a null id is hashed as an empty text, and rows with one id count as often
as they occur, the lexically smallest vector first; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.plans.stages import staged
from matchframe.shipping import ship

LARGEST = 1 << 27
ROWS = 4_096


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each centroid's others by rising squared distance (equal ones by number), and those distances."""
    squares = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
    order = np.stack([np.lexsort((np.arange(len(row)), row)) for row in squares])
    return order, np.take_along_axis(squares, order, 1)


def orchard(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every vector and the squared distance."""
    n, k = len(vectors), len(centroids)
    at = np.zeros(n, np.int64)
    best = ((vectors - centroids[0]) ** 2).sum(1)
    place = np.zeros(n, np.int64)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    walking = np.arange(n)
    while True:
        walking = walking[place[walking] < k]
        here = at[walking], place[walking]
        walking = walking[squares[here] <= 4 * best[walking]]
        if not len(walking):
            return at, best
        other = order[at[walking], place[walking]]
        place[walking] += 1
        fresh = ~visited[walking, other]
        rows, other = walking[fresh], other[fresh]
        visited[rows, other] = True
        distance = ((vectors[rows] - centroids[other]) ** 2).sum(1)
        jumps = (distance < best[rows]) | ((distance == best[rows]) & (other < at[rows]))
        rows, other = rows[jumps], other[jumps]
        at[rows], best[rows], place[rows] = other, distance[jumps], 0


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], model, dims: int) -> Iterator[tuple]:
    centroids = model.value
    lists = neighbour_lists(centroids)
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            vectors = _matrix(part.column("v"), dims)
            yield part, vectors, *orchard(vectors, centroids, *lists)


def _sum(model, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.value)
        sums = np.zeros((k, dims + 1), np.int64)
        for _, vectors, cluster, _ in _blocks(batches, model, dims):
            np.add.at(sums, cluster, np.column_stack([vectors, np.ones(len(vectors), np.int64)]))
        cluster, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[cluster, place])], ["cluster", "place", "n"]
        )

    return run


def _assign(model, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in _blocks(batches, model, dims):
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"]
            )

    return run


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of each cluster's vectors.  Runs a job."""
    k, dims = centroids.shape
    model = vectors.sparkSession.sparkContext.broadcast(centroids)
    parts = vectors.select("v").mapInArrow(_sum(model, dims), "cluster int, place int, n long")
    totals = parts.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    model.destroy()
    sums = [[0] * (dims + 1) for _ in range(k)]
    for r in totals:
        sums[r["cluster"]][r["place"]] = int(r["n"])
    rows = [[x // row[-1] for x in row[:-1]] if row[-1] else old for row, old in zip(sums, centroids.tolist(), strict=True)]
    return np.array(rows, np.int64)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(id, v): the whole, finite vectors as integers."""
    kept = F.forall(vector_col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    at_most = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LARGEST)), F.lit(-LARGEST))
    whole = F.transform(vector_col, lambda x: at_most(x.cast("double")).cast("int"))
    return df.where((F.size(vector_col) == dims) & kept).select(F.col(id_col).alias("id"), whole.alias("v"))


def centroid_clusters(
    df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every whole vector.

    Starts with the ``k`` vectors whose ``seed:id`` has the smallest SHA-256.  Runs a job a round.
    """
    spark = df.sparkSession
    ship(spark)
    vectors = staged(integer_vectors(df, id_col, vector_col, dims, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        assigned = spark.createDataFrame([], schema)
    else:
        for _ in range(rounds):
            centroids = _means(vectors, centroids)
        model = spark.sparkContext.broadcast(centroids)
        assigned = staged(vectors.mapInArrow(_assign(model, dims), schema))
        model.destroy()
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = sums.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(total))
    out = assigned.join(F.broadcast(facts), "cluster")
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
