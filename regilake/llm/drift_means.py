"""Operator 13: centroid clustering with geometric drift tightening.

Exact k-means over integer vectors (``floor(64 * x)`` of each component). A
vector keeps its centroid's number and a lower bound of its distance to every
other centroid. When the centroids move, each round needs only the vector's
distance to its own centroid, unless that reaches the loosened bound; such
ambiguous vectors are compared with all centroids.

The usual loosening is the largest drift of another centroid. Here it is less
(:func:`loosening`): a cluster's vectors lie in the sphere about its old
centroid through its farthest vector. In the plane of that centroid, another
centroid's old place ``a`` and its new one ``b``, vectors that come nearer by
``t`` lie on one branch of a hyperbola with foci ``a`` and ``b``, inside the
cone about its asymptotes with ``cos(angle) = t / |b - a|`` and its tip in the
middle between. So a sphere that is seen from there at an angle of at least
``theta`` from the direction of the drift comes nearer by ``|b - a| *
cos(theta)`` at most, and not at all from ``theta = pi / 2`` on.

Squared distances and sums are exact integers; the bounds are floating-point
numbers widened by ``SLACK``, and a vector is only spared a scan if its own
centroid is nearer beyond doubt.

Edge cases: vectors with another number of components, or with null or
non-finite ones, are left out; null vectors too. Fewer vectors than ``k`` give
as many centroids; equal vectors are clustered alike; a null ``vec_id`` is kept
and starts a centroid only after all others; rows of equal id start centroids
in order of their components. An empty table gives no rows, other columns are
ignored. A component of ``LARGEST`` or more is an error, since its squared
distances do not fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, needed, ship_package, table

K, DIMENSIONS, ROUNDS, SCALE = 16, 64, 3, 64
LARGEST, SLACK, BLOCK = 1 << 27, 1e-9, 8192


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): kept vectors, written once; v holds the integers, 4 bytes each."""
    ship_package(embeddings.sparkSession)

    def run(batches):
        for b in batches:
            vectors = b.column("embedding")
            full = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimensions), False)
            ids, vectors = b.column("vec_id").filter(full), vectors.filter(full)
            flat = pc.list_flatten(vectors)
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            # a null component has become NaN
            good = np.isfinite(x).all(axis=1)
            x = np.floor(x[good] * SCALE)
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"a component of {LARGEST} or more after scaling")
            packed = [v.tobytes() for v in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return materialize(needed(embeddings, "vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, v binary"), "means-vectors")


def unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, dimensions: int) -> np.ndarray:
    """The k vectors with the least SHA-256 of ``1:<vec_id>``."""
    code = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    # of equal ids the components decide; only k rows travel
    rows = vectors.select("v", code.alias("code")).orderBy(F.col("code").asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64).reshape(-1, dimensions)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c, as integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 21:
        a, b = x.astype(np.float64), c.astype(np.float64)  # whole numbers below 2 ** 53 throughout
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster: by how much any vector in the sphere about its old centroid may come nearer to some other centroid."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    drift, middle = np.sqrt(((new - old) ** 2).sum(axis=1)), (old + new) / 2
    out = np.zeros(len(old))
    for i, r in enumerate(radius):
        to = old[i] - middle
        away = np.sqrt((to ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((to * (new - old)).sum(axis=1) / (away * drift), -1, 1))
            theta = angle - np.arcsin(np.clip(r / away, 0, 1)) - SLACK
        nearer = np.where((away > r) & (theta > 0), drift * np.cos(np.clip(theta, 0, np.pi / 2)), drift)
        nearer = np.where(drift == 0, 0.0, nearer)
        nearer[i] = 0.0
        out[i] = nearer.max(initial=0) * (1 + SLACK) + SLACK
    return out


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None = None, bound: np.ndarray | None = None):
    """(cluster, squared distance, lower bound of the distance to the others, scanned) of each vector.

    With clusters and bounds from before, only ambiguous vectors are compared with all centroids.
    """
    n = len(x)
    scan = np.ones(n, bool)
    if cluster is None:
        cluster, bound, distance = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    else:
        cluster, bound = cluster.copy(), bound.copy()
        distance = ((x - centroids[cluster]) ** 2).sum(axis=1)
        scan = np.sqrt(distance) * (1 + SLACK) >= bound
    if scan.any():
        all_ = squared(x[scan], centroids)
        cluster[scan] = best = all_.argmin(axis=1)  # of equal ones the first
        distance[scan] = all_[np.arange(len(all_)), best]
        all_[np.arange(len(all_)), best] = np.iinfo(np.int64).max
        bound[scan] = np.sqrt(all_.min(axis=1)) * (1 - SLACK)
    return cluster, distance, bound, scan


STATE = "v binary, cluster int, distance long, bound double, scanned boolean"


def assigned(rows: DataFrame, centroids: np.ndarray, loosened: np.ndarray | None) -> DataFrame:
    """(vec_id, v, cluster, distance, bound, scanned), written once."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = unpacked(b.column("v"), dimensions)
                if loosened is None:
                    found = assign(x, centroids)
                else:
                    cluster = b.column("cluster").to_numpy().astype(np.int64)
                    found = assign(x, centroids, cluster, b.column("bound").to_numpy() * (1 - SLACK) - loosened[cluster])
                cluster, distance, bound, scan = found
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance),
                                                  pa.array(bound), pa.array(scan)], names=["vec_id", "v", "cluster", "distance", "bound", "scanned"])

    return materialize(rows.mapInArrow(run, f"vec_id {kind}, {STATE}"), "means-state")


def sums(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, component sums and greatest squared distance of each cluster; a task sends k * (dimensions + 1) rows at most."""
    def run(batches):
        total, count, far = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x, cluster = unpacked(b.column("v"), dimensions), b.column("cluster").to_numpy()
                order = np.argsort(cluster, kind="stable")
                own, begin = np.unique(cluster[order], return_index=True)
                total[own] += np.add.reduceat(x[order], begin, axis=0)
                count[own] += np.diff([*begin, len(x)])
                far[own] = np.maximum(far[own], np.maximum.reduceat(b.column("distance").to_numpy()[order], begin))
        found = np.flatnonzero(count)
        cell = pd.DataFrame({"cluster": np.repeat(found, dimensions + 1), "at": np.tile(np.arange(-1, dimensions), len(found)),
                             "n": np.column_stack([count, total])[found].ravel(), "far": np.repeat(far[found], dimensions + 1)})
        yield pa.RecordBatch.from_pandas(cell, preserve_index=False)

    parts = state.select("v", "cluster", "distance").mapInArrow(run, "cluster long, at long, n long, far long")
    total, count, far = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():
        far[r.cluster] = r.far
        if r.at < 0:
            count[r.cluster] = r.n
        else:
            total[r.cluster, r.at] = r.n
    return count, total, far


def cluster_vectors(embeddings: DataFrame, k: int = K, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, v, cluster, distance, bound, scanned`` after the last assignment, and the centroids."""
    rows = whole_vectors(embeddings, dimensions)
    centroids, loosened = first_centroids(rows, k, dimensions), None
    if not len(centroids):
        return rows.selectExpr("*", "0 AS cluster", "0L AS distance", "0D AS bound", "false AS scanned"), centroids
    for _ in range(rounds):
        rows = assigned(rows, centroids, loosened)
        count, total, far = sums(rows, len(centroids), dimensions)
        moved = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        loosened = loosening(centroids, moved, np.sqrt(far.astype(np.float64)) * (1 + SLACK))
        centroids = moved
    return assigned(rows, centroids, loosened), centroids


def op13_drift_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    # the inertia is summed over clusters that are summed over the vectors: K rows
    own = {r.cluster: r.n for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    known = [(i, own.get(i, 0), sum(own.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    clusters = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(clusters), "cluster") \
               .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> str:
    """The same by plain scans: every vector against every centroid in each round."""
    out = [f"""
WITH kept AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v AS m
    FROM kept QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS (
    SELECT row, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT row, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r})
    GROUP BY row)""")
        if r < rounds:
            out.append(f"""
s{r} AS (
    SELECT c, pos, CAST(sum(x) AS BIGINT) AS total, count(*) AS n
    FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY c, pos),
c{r + 1} AS (
    SELECT born.c, coalesce(any_value(f.m), any_value(last.m)) AS m
    FROM c0 AS born JOIN c{r} AS last ON born.c = last.c
    LEFT JOIN (SELECT c, list((total - ((total % n) + n) % n) // n ORDER BY pos) AS m FROM s{r} GROUP BY c) f ON f.c = born.c
    GROUP BY born.c)""")
    return ",".join(out) + f"""
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


ORACLE = _oracle()
