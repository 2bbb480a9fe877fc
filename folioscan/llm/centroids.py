"""Centroid clustering by Lloyd's rounds, in whole numbers.

Vectors are written once as integers. In each round every task gets the centroids (at most ``clusters`` x ``dims``
numbers), assigns its vectors and keeps one sum for each centroid and component; only these sums are shuffled, so a
cluster that holds most vectors costs no more than others. Integer sums don't depend on the order of rows, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

#: Vectors that a task compares at once.
ROWS = 2048
#: Components beyond count as this, so that a component's sum over ROWS vectors fits 64 bits.
MOST = 2**50
MOST_LONG = 2**63 - 1

Centroids = Sequence[Sequence[int]]


def whole_vectors(df: DataFrame, dims: int = 64, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors with exactly ``dims`` components, none null, NaN or infinite; components are floor(scale * x)."""
    x, most = col(embedding), F.lit(float(MOST))
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False)))
    made = F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double") * scale, most), -most)))
    return df.filter((F.size(x) == dims) & finite).select(col(vec_id).cast("long").alias("vec_id"), made.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The ``clusters`` vectors (a bounded number) whose hash of seed and id is smallest; ties go by components."""
    place = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(place.alias("place"), "v").orderBy("place", "v").limit(clusters).collect()]


def distances(x: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Squared distances (rows x centroids), exact: in 64 bits where these suffice, else in Python's integers."""
    c = np.array(centroids, np.int64)
    far = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))) * 2
    if far * far * x.shape[1] > MOST_LONG:
        x, c = x.astype(object), c.astype(object)
    out = np.empty((len(x), len(c)), x.dtype)
    for k, centre in enumerate(c):
        gap = x - centre
        out[:, k] = (gap * gap).sum(axis=1) if x.dtype == object else np.einsum("ij,ij->i", gap, gap)
    return out


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            part = frame.iloc[at : at + ROWS]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def sums(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(cluster, dim, high, low, rows): one row for each component of a cluster. A sum is high * 2^32 + low."""
    clusters, dims = len(centroids), len(centroids[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((clusters, dims), object), np.zeros(clusters, np.int64)
        for _, x in _slices(frames):
            nearest = distances(x, centroids).argmin(axis=1)  # the lowest number on ties
            order = np.argsort(nearest, kind="stable")
            some, starts = np.unique(nearest[order], return_index=True)
            total[some] += np.add.reduceat(x[order], starts, axis=0).astype(object)
            rows += np.bincount(nearest, minlength=clusters)
        held = np.flatnonzero(rows)
        part = total[held].ravel()
        yield pd.DataFrame(
            {
                "cluster": np.repeat(held, dims).astype(np.int32),
                "dim": np.tile(np.arange(dims, dtype=np.int32), len(held)),
                "high": np.array([int(t) >> 32 for t in part], np.int64),
                "low": np.array([int(t) & 0xFFFFFFFF for t in part], np.int64),
                "rows": np.repeat(rows[held], dims),
            }
        )

    parts = vectors.select("v").mapInPandas(run, "cluster int, dim int, high long, low long, rows long")
    return parts.groupBy("cluster", "dim").agg(*[F.sum(c).alias(c) for c in ("high", "low", "rows")])


def lloyd_round(vectors: DataFrame, centroids: Centroids) -> list[list[int]]:
    """Every non-empty centroid becomes the floor of its vectors' mean. Collects clusters x dims sums."""
    new = [list(c) for c in centroids]
    for r in sums(vectors, centroids).collect():
        new[r.cluster][r.dim] = ((r.high << 32) + r.low) // r.rows
    return new


def fit(vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: str = "2:") -> list[list[int]]:
    """Centroids after ``rounds`` rounds over written ``vectors`` (vec_id, v); fewer where no round changes them any more.
    Without vectors there are none, with less than ``clusters`` each is one."""
    now = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if now else 0):
        before, now = now, lloyd_round(vectors, now)
        if now == before:
            break
    return now


def assign(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of each vector, on ties the smallest number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _slices(frames):
            every = distances(x, centroids)
            nearest = every.argmin(axis=1)
            least = np.minimum(every[np.arange(len(x)), nearest], MOST_LONG).astype(np.int64)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": nearest.astype(np.int32), "distance": least})

    return vectors.mapInPandas(run, "vec_id long, cluster int, distance long")


def cluster(
    df: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: str = "2:",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of long).

    Vectors with another number of components, or with a null, NaN or infinite one, are left out, as are null vectors.
    Rows that repeat an id are vectors of their own, a null id is hashed as an empty one and stays null. Components
    beyond 2^50 after scaling count as 2^50; distances and inertias beyond 64 bits are returned as the largest long. An
    empty table, or one without a kept vector, gives no rows; other columns are not read.
    """
    vectors = materialize(whole_vectors(df, dims, scale, vec_id, embedding), "lloyd-vectors")
    centroids = fit(vectors, clusters, rounds, seed)
    spark = df.sparkSession
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    assigned = materialize(assign(vectors, centroids), "lloyd-assigned")
    own = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    sums_ = {r.cluster: int(r["sum"]) for r in own.collect()}  # a row for each centroid at most
    rows = [(k, min(s, MOST_LONG), min(sum(sums_.values()), MOST_LONG), [int(x) for x in centroids[k]]) for k, s in sums_.items()]
    found = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_sha256(centroid: str = "centroid"):
    """Column: SHA-256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)

