"""Centroid clustering by sort-means (Phillips, Acceleration of K-Means and Related Clustering Algorithms, 2002).

Vectors become integers, floor(64 * x). Each round orders, for every centroid, the others by their distance from it. A
vector looks at the centroids in the order of its previous one and stops at the first that lies strictly beyond twice the
distance to that previous one: by the triangle inequality none from there on can be nearer, nor as near. Of equally near
centroids the smaller number wins. A task emits its vectors with their assignments and, behind them, one row of exact
partial sums a centroid, so a round reads the vectors once; the sums are added up by cluster and component, and only
k x 64 of these reach the driver. Rounds hand over written tables; a lost executor costs a new read.

All arithmetic is exact: in 64-bit integers where components are below 2^27, else in Python's integers; sums travel as two
decimals, of multiples of 2^60 and of what is left.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left aside, and so are
those with a component of 2^128 and more in size, which no array of floats has; a null vec_id is hashed as empty text, and
of equal hashes the vector that sorts first starts; repeated rows are vectors each; distances and inertias beyond a long
are its largest value; with fewer than k vectors there are as many centroids as vectors; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_written, table, written

#: Components below this in size have squared distances that fit 64 bits.
SMALL = 1 << 27
LARGEST = (1 << 63) - 1
LIMB = 60


def integers(flat: np.ndarray, dims: int) -> np.ndarray:
    """floor(64 x) of doubles, a row for each vector: 64-bit integers if all are small, else Python's."""
    q = np.floor(64.0 * flat.astype(np.float64)).reshape(-1, dims)
    if not len(q) or np.abs(q).max() < SMALL:
        return q.astype(np.int64)
    return np.array([[int(x) for x in row] for row in q.tolist()], dtype=object)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of all, itself first, by distance from it, and these squared distances."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.array([sorted(range(len(centroids)), key=lambda j: (j != i, apart[i, j], j)) for i in range(len(centroids))], dtype=np.int64)
    return order, np.array([apart[i, order[i]] for i in range(len(centroids))], dtype=apart.dtype)


def assign(q: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid and squared distance, and how many distances were computed."""
    if q.dtype == object or centroids.dtype == object:
        q, centroids = q.astype(object), centroids.astype(object)
    order, apart = orders(centroids)
    cluster, distance, asked = before.copy(), np.zeros(len(q), dtype=q.dtype), 0
    for c in np.unique(before).tolist():
        rows = np.flatnonzero(before == c)
        anchor = ((q[rows] - centroids[c]) ** 2).sum(1)
        best, at = anchor.copy(), np.full(len(rows), c, dtype=np.int64)
        left = np.arange(len(rows))
        asked += len(rows)
        for other, far in zip(order[c, 1:].tolist(), apart[c, 1:].tolist(), strict=True):
            left = left[far <= 4 * anchor[left]]  # squared: beyond twice the distance
            if not len(left):
                break
            d = ((q[rows[left]] - centroids[other]) ** 2).sum(1)
            asked += len(left)
            nearer = ((d < best[left]) | ((d == best[left]) & (other < at[left]))).astype(bool)
            best[left[nearer]], at[left[nearer]] = d[nearer], other
        cluster[rows], distance[rows] = at, best
    return cluster, distance, asked


def packed(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < SMALL for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def usable(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """vec_id and vector of the rows that are kept."""
    v = F.col(column).cast("array<double>")
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**128)))
    kind = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast(kind).alias("vector"))


def _round(state: DataFrame, centroids: np.ndarray, dims: int, sums: bool) -> DataFrame:
    """vec_id, vector, cluster and distance of every row of state; with ``sums`` a row for each cluster a task has met behind
    these, with its number of vectors and their sums in two parts."""
    kind = dict(state.dtypes)["vector"]
    arrow = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())
    part = pa.list_(pa.decimal128(38, 0))
    names = ["vec_id", "vector", "cluster", "distance", "n", "high", "low"]
    has_before = "cluster" in state.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims), dtype=object)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for batch in it:
            vectors = batch.column("vector")
            q = integers(vectors.flatten().to_numpy(zero_copy_only=False), dims)
            before = batch.column("cluster").to_numpy().astype(np.int64) if has_before else np.zeros(len(q), dtype=np.int64)
            cluster, distance, _ = assign(q, before, centroids)
            for c in np.unique(cluster).tolist():
                total[c] += q[cluster == c].sum(0).astype(object)
                counts[c] += (cluster == c).sum()
            none = pa.nulls(len(q), pa.int64()), pa.nulls(len(q), part), pa.nulls(len(q), part)
            capped = pa.array([min(int(d), LARGEST) for d in distance], pa.int64()) if distance.dtype == object else pa.array(distance)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors.cast(arrow), pa.array(cluster, pa.int32()), capped, *none], names)
        own = np.flatnonzero(counts) if sums else []
        if len(own):
            limbs = [[[Decimal(int(x) >> LIMB if n == 0 else int(x) & ((1 << LIMB) - 1)) for x in total[c]] for c in own] for n in range(2)]
            nothing = pa.nulls(len(own), pa.int64()), pa.nulls(len(own), arrow)
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(own, pa.int32()), pa.nulls(len(own), pa.int64()), pa.array(counts[own]), *(pa.array(x, part) for x in limbs)], names)

    return state.mapInArrow(run, f"vec_id long, vector {kind}, cluster int, distance long, n long, high array<decimal(38,0)>, low array<decimal(38,0)>")


def sort_means(vectors: DataFrame, k: int = 16, rounds: int = 3, column: str = "embedding", dims: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that is kept, written, and the final centroids."""
    kept = usable(vectors, column, dims)
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "vector").limit(k).collect()
    centroids = [[int(x) for x in integers(np.array(r.vector, dtype=np.float64), dims)[0]] for r in first]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), dtype=np.int64)
    state, last = kept, None
    for _ in range(rounds):
        now = written(_round(state, packed(centroids), dims, sums=True))
        if last is not None:
            drop_written(last)
        each = now.where("n is not null").select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "s"))
        added = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
        for r in added.collect():  # k x dims rows
            centroids[r.cluster][r.dim] = ((int(r.high) << LIMB) + int(r.low)) // r.n
        state = now.where("n is null").select("vec_id", "vector", "cluster")
        last = now
    out = written(_round(state, packed(centroids), dims, sums=False).select("vec_id", "cluster", "distance"))
    if last is not None:
        drop_written(last)
    return out, packed(centroids)


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """The rows of sort_means() with their cluster's inertia, that of all, and a digest of the centroid."""
    rows, centroids = sort_means(vectors, **options)
    spark = vectors.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    exact = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    capped = lambda x: min(int(x), LARGEST)
    whole = capped(sum(r.s for r in exact))
    sums = {r.cluster: capped(r.s) for r in exact}
    named = spark.createDataFrame([(i, sums.get(i, 0), whole, d) for i, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The same rounds in plain SQL: every vector against every centroid."""
    out = [
        "WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "u AS (SELECT r, unnest(range(64)) AS dim, unnest(q) AS x FROM v)",
        f"c0 AS (SELECT n, q FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS n, q FROM v) WHERE n < {k})",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, n := n)) AS best FROM (SELECT r, n, {distance} AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            out.append(f"s{i} AS (SELECT best.n AS n, dim, sum(x) AS s, count(*) AS m FROM a{i} JOIN u USING (r) GROUP BY ALL)")
            out.append(f"m{i} AS (SELECT n, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY dim) AS q FROM s{i} GROUP BY n)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON c.n = m.n)")
    last = f"a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.n = a.best.n"
    return ",\n".join(out) + f"\nSELECT vec_id, c.n::INTEGER AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY c.n)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM {last}"


OP13_SQL = _sql()
