"""Clustering around centroids over exact integers, by matrix products.

Vectors are scaled, floored and packed into blocks of bounded size, which are written once. Squared distances of a block
to all centroids come from |x|^2 - 2 x.c + |c|^2, one matrix product a block. Where the magnitudes of a group of rows and a group of
centroids keep every term and partial sum below 2^53, the product runs in float64 (BLAS) and is exact; beyond that
64-bit integers are used, and beyond those Python's. Rows and centroids are grouped by magnitude, so a few large ones do not
slow down the others.

A round is one `treeAggregate` over the RDD of blocks: each task adds up its blocks' sums and counts by cluster, partial
results (k x dimensions integers, whatever the number of vectors) are combined in a tree, and the driver divides. Only the centroids are sent to tasks.

The first centroids are the vectors with the smallest sha256 of `2:` and the id. Ties of distance go to the smaller
centroid number; an empty centroid stays as it is; a mean is floored.

Edge cases: vectors that are null, of another length, or with null, NaN or infinite components (also after scaling) take no
part. A null id draws as an empty one; rows that share an id are separate vectors, those with equal hashes are ordered by their components.
With fewer vectors than k there are fewer centroids; an empty table gives an empty result. Equal vectors that are all
first centroids leave all but the first of them empty. Further columns are ignored. Distances and their sums are exact; those that 64 bits don't hold are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

# Number of centroids, rounds, components and the scale.
K, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: Rows of a block.
BLOCK = 4096

Centroids = list[list[int]]


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and embedding (array of double) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) != float("inf")))
    return vectors.where((F.size("embedding") == dimensions) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); float64 holds these integers exactly."""
    return np.floor(scale * x)


def packed(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """Blocks: ids, m (the integers as a binary, 16 bits each where they fit, else float64) and n. At most BLOCK rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            m = np.concatenate(parts)
            small = m.min() >= -(2**15) and m.max() < 2**15
            columns = [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([m.astype(np.int16 if small else np.float64).tobytes()], pa.binary()), pa.array([len(m)], pa.int32())]
            ids.clear(), parts.clear()
            return pa.RecordBatch.from_arrays(columns, ["ids", "m", "n"])

        rows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - rows)
                at, rows = at + part.num_rows, rows + part.num_rows
                ids.append(part.column(0)), parts.append(_scaled(part.column(1).flatten().to_numpy().reshape(-1, dimensions), scale))
                if rows == BLOCK:
                    yield block()
                    rows = 0
        if rows:
            yield block()

    return vectors.mapInArrow(run, "ids array<long>, m binary, n int")


def unpacked(data: bytes, n: int, dimensions: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * n * dimensions else np.float64
    return np.frombuffer(data, dtype=kind).reshape(n, dimensions).astype(np.float64)


def _integers(x: np.ndarray) -> np.ndarray:
    """Python's integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x (integers in float64) to those of c (Python's integers), in a type that holds them exactly."""
    top = lambda m: max(abs(int(m.min())), abs(int(m.max())))
    bound = x.shape[1] * (top(x) + top(c)) ** 2
    if bound < 2**53:
        x, c = x, c.astype(np.float64)
    elif bound < 2**63:
        x, c = x.astype(np.int64), c.astype(np.int64)
    else:
        x = _integers(x)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (the first of equals) of every row, and the squared distances (int64, or Python's integers where needed)."""
    n, dimensions = x.shape
    limit = isqrt(2**53 // dimensions) // 2
    c = np.array(centroids, dtype=object)
    small_rows = np.abs(x).max(axis=1) < limit
    small_cols = np.array([max(abs(v) for v in row) < limit for row in centroids])
    cluster, best = np.full(n, -1, dtype=np.int64), None
    for rows in (np.flatnonzero(small_rows), np.flatnonzero(~small_rows)):
        if not len(rows):
            continue
        found = None
        for cols in (np.flatnonzero(small_cols), np.flatnonzero(~small_cols)):
            if not len(cols):
                continue
            d = distances(x[rows], c[cols])
            at = d.argmin(axis=1)
            d, at = d[np.arange(len(rows)), at], cols[at]
            d = d.astype(np.int64) if d.dtype == np.float64 else d
            if found is not None:
                closer = (d < found[0]) | ((d == found[0]) & (at < found[1]))
                d, at = np.where(closer, d, found[0]), np.where(closer, at, found[1])
            found = d, at
        if best is None:
            best = np.zeros(n, dtype=found[0].dtype)
        elif found[0].dtype == object:
            best = best.astype(object)
        best[rows], cluster[rows] = found
    return cluster, best


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums by cluster, as Python's integers."""
    if len(x) * np.abs(x).max() < 2**53:
        member = (cluster == np.arange(k)[:, None]).astype(np.float64)
        return _integers(member @ x)
    out = np.zeros((k, x.shape[1]), dtype=object)
    for row, at in zip(_integers(x), cluster, strict=True):
        out[at] += row
    return out


def _added(a, b):
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))


def totals(blocks: DataFrame, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """By centroid: vectors, componentwise sums, and summed distance (Python's integers). None without vectors."""
    k, dimensions = len(centroids), len(centroids[0])

    def add(so_far, block):
        x = unpacked(bytes(block.m), block.n, dimensions)
        cluster, d = nearest(x, centroids)
        spread = np.zeros(k, dtype=object)
        for at in np.unique(cluster):
            spread[at] = sum(d[cluster == at].tolist())
        return _added(so_far, (np.bincount(cluster, minlength=k).astype(object), _sums(x, cluster, k), spread))

    return blocks.select("m", "n").rdd.treeAggregate(None, add, _added)


def first_centroids(vectors: DataFrame, k: int, scale: int) -> Centroids:
    """The k vectors with the smallest sha256 of `2:` and the id."""
    draw = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(draw.alias("draw"), "embedding").orderBy("draw", "embedding").limit(k).collect()
    return [[int(v) for v in _scaled(np.array(r.embedding), scale)] for r in rows]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(x: int) -> int | None:
    return x if x < 2**63 else None


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (its components) of every vector that takes part."""
    rows = kept(vectors, dimensions, scale)
    blocks = settle(packed(rows, dimensions, scale), "vector-blocks")
    centroids = first_centroids(rows, k, scale)
    found = None
    for _ in range(rounds if centroids else 0):
        counts, sums, _ = totals(blocks, centroids)
        centroids = [[s // n for s in sums[i]] if n else centroids[i] for i, n in enumerate(counts)]
    if centroids:
        found = totals(blocks, centroids)[2].tolist()
    told = [str(x) for row in centroids for x in row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = [int(x) for x in told]
        own = [flat[i : i + dimensions] for i in range(0, len(flat), dimensions)]
        for batch in batches:
            for block in batch.to_pylist():
                at, d = nearest(unpacked(block["m"], block["n"], dimensions), own)
                inertia = pa.array([_long(found[i]) for i in range(len(own))], pa.int64())
                columns = [
                    pa.array(block["ids"], pa.int64()), pa.array(at, pa.int32()), pa.array([_long(x) for x in d.tolist()], pa.int64()), inertia.take(pa.array(at)),
                    pa.array([_long(sum(found))] * block["n"], pa.int64()), pa.array([",".join(map(str, c)) for c in own]).take(pa.array(at)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid string")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cluster(table(spark, sf_dir, "embeddings"))
    return d.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _round_sql(r: int) -> str:
    """d{r}: every vector's nearest centroid of c{r}; c{r+1}: the new centroids."""
    square = f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"
    return f"""d{r} AS MATERIALIZED (SELECT rid, vec_id, v, arg_min(k, d * {K} + k) AS k, min(d)::BIGINT AS d FROM (SELECT rid, vec_id, v.v AS v, k, {square} AS d FROM v, c{r} c) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
    SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM d{r}) GROUP BY k, i) GROUP BY k) m ON m.k = c.k)"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS k, v FROM v QUALIFY k < {K}),
{", ".join(_round_sql(r) for r in range(ROUNDS + 1))}
SELECT vec_id, d.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY d.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM d{ROUNDS} d JOIN c{ROUNDS} c ON c.k = d.k
"""
