"""Centroids by rounds of nearest-centroid assignment, with Orchard's search.

Every centroid keeps the others in a list, nearest first. A vector walks along the list
of its best centroid so far, and jumps to the list of a closer one as soon as it
finds it; centroids it has measured already are marked and skipped. Once an entry
lies strictly beyond twice the vector's distance from the owner of the list, neither
it nor any later one can be as close, and the walk ends.

All components are whole numbers and all sums are exact, so results do not depend on
how the rows are dealt out. A round moves one partial sum per task, centroid and
component; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import common as C

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Largest component after scaling: four times a squared distance over 1,024 of them still fits 64 bits.
LARGEST = 1 << 24
#: Vectors that walk side by side.
WALKERS = 4096


class Orchard:
    """Nearest centroid of many vectors at once; of equally near ones that with the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        apart = np.empty((k, k), np.int64)
        for i in range(k):
            apart[i] = ((centroids - centroids[i]) ** 2).sum(1)
        self.list = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.list, 1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each vector."""
        n, k = len(vectors), len(self.centroids)
        best = np.zeros(n, np.int64)
        distance = ((vectors - self.centroids[0]) ** 2).sum(1) if k else np.zeros(n, np.int64)
        marked = np.zeros((n, k), bool)
        marked[:, :1] = True
        at = np.zeros(n, np.int64)  # place in the list of the best one
        walking = np.arange(n)
        while len(walking):
            # Off the list, or strictly beyond twice the distance (squared: four times).
            owner, place = best[walking], at[walking]
            inside = place < k
            owner, place, walking = owner[inside], place[inside], walking[inside]
            near = self.apart[owner, place] <= 4 * distance[walking]
            owner, place, walking = owner[near], place[near], walking[near]
            at[walking] += 1
            other = self.list[owner, place]
            new = ~marked[walking, other]
            who, other = walking[new], other[new]
            marked[who, other] = True
            far = ((vectors[who] - self.centroids[other]) ** 2).sum(1)
            closer = (far < distance[who]) | ((far == distance[who]) & (other < best[who]))
            who, other = who[closer], other[closer]
            best[who], distance[who], at[who] = other, far[closer], 0
        return best, distance


def whole_vectors(vectors: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have exactly ``dimensions`` finite components, and these as floor(scale * x)."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(size == dimensions)
    flat = vectors.take(pa.array(fits)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(fits), dimensions)  # null: not a number
    good = np.isfinite(x).all(axis=1)
    scaled = np.floor(x[good] * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling, distances would not be exact")
    return fits[good], scaled.astype(np.int64)


def _held(df: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """_key and _vector (whole numbers) of the vectors that are kept."""
    schema = T.StructType([df.schema["_key"], T.StructField("_vector", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole = whole_vectors(batch.column("_vector"), dimensions, scale)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dimensions)
            held = pa.ListArray.from_arrays(offsets, pa.array(whole.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows)), held], names=schema.names)

    return df.mapInArrow(run, schema)


def first_centroids(df: DataFrame, clusters: int, dimensions: int, scale: int, seed: int) -> np.ndarray:
    """The kept vectors whose hashed keys are least, by hash; equal keys by their components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256)
    chosen = (
        _held(df, dimensions, scale).withColumn("_hash", hashed).orderBy(F.asc_nulls_last("_hash"), "_vector").limit(clusters)
    )
    rows = [r["_vector"] for r in chosen.select("_vector").collect()]
    return np.array(rows, np.int64).reshape(len(rows), dimensions)


def _moved(df: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Centroids after a round: the floor of their vectors' mean; those without vectors stay."""
    k, dimensions = centroids.shape
    held = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(held.value)
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            _, whole = whole_vectors(batch.column("_vector"), dimensions, scale)
            for begin in range(0, len(whole), WALKERS):
                part = whole[begin : begin + WALKERS]
                best, _ = search.nearest(part)
                order = np.argsort(best, kind="stable")
                found, cut = np.unique(best[order], return_index=True)
                total[found] += np.add.reduceat(part[order], cut, axis=0)
                count += np.bincount(best, minlength=k)
        used = np.flatnonzero(count)
        cluster, place = np.repeat(used, dimensions), np.tile(np.arange(dimensions), len(used))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cluster.astype(np.int32)),
                pa.array(place.astype(np.int32)),
                pa.array(total[used].reshape(-1)),
                pa.array(np.repeat(count[used], dimensions)),
            ],
            names=["cluster", "place", "total", "size"],
        )

    parts = df.select("_vector").mapInArrow(run, "cluster int, place int, total long, size long")
    # One row per centroid and component, whatever the number of vectors.
    sums = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["place"]] = r["total"] // r["size"]
    return out


def fit(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> np.ndarray:
    """Centroids after ``rounds`` rounds over all kept vectors (fewer than ``clusters`` if there are fewer vectors)."""
    df = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    centroids = first_centroids(df, clusters, dimensions, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(df, centroids, scale)
    return centroids


def assign(
    vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """key, cluster and squared distance of every kept vector."""
    dimensions = centroids.shape[1]
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType(
        [vectors.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(held.value)
        for batch in batches:
            rows, whole = whole_vectors(batch.column("_vector"), dimensions, scale)
            for begin in range(0, len(whole), WALKERS):
                best, distance = search.nearest(whole[begin : begin + WALKERS])
                mine = pa.array(rows[begin : begin + WALKERS])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(mine), pa.array(best.astype(np.int32)), pa.array(distance)],
                    names=schema.names,
                )

    return vectors.select(key, F.col(vector).alias("_vector")).mapInArrow(run, schema)


def centroid_clusters(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly ``dimensions`` components of which none is null or not
    finite; other rows and null vectors give no row. Rows that share a key, null keys
    included, are vectors of their own; null keys come last in the choice of the first
    centroids. Ties go to the smaller centroid number, also between equal centroids.
    No kept vector gives no row; further columns are not read.
    """
    C.small_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    centroids = fit(vectors, key, vector, clusters, rounds, dimensions, scale, seed)
    found = C.keep(assign(vectors, centroids, key, vector, scale), "clusters")
    # One row per centroid.
    spread = {r["cluster"]: r["spread"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("spread")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(c, total, sum(spread.values()), hashes[c]) for c, total in spread.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
