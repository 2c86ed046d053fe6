"""Centroid clustering of integer vectors by Exponion search.

Components become integers floor(SCALE * x), so sums, centroids and squared distances are exact and don't
depend on how rows are dealt out. Each vector carries its centroid, an upper bound of the distance to it
and a lower bound of the distance to every other one. After centroids moved, the bounds move along; where
they still tell the nearest centroid, nothing is computed. Otherwise only the centroids inside a ball
around the vector's centroid are scanned, found in that centroid's list of the others by distance; the ball
of twice the upper bound plus the distance to the centroid's neighbour holds the nearest two. Bounds are
rounded outwards, the ball includes its surface and a bound must be strictly less to save work, so ties
are seen and go to the smaller number.

A pass over the vectors is one mapInArrow: it writes the vectors with their new bounds, and the sums of
each task's vectors by centroid as rows of the same table. Vectors are never shuffled. The driver holds the
centroids: CLUSTERS rows, also those of the seeds and of the sums.

Kept are vectors with exactly the asked number of components, none of them null, infinite, not a number or
beyond LARGEST in size after scaling (a squared distance would not fit a long). Null vectors aren't kept.
Null vec_id: kept, never a seed before others. Repeated rows: one result each, each counts. Fewer vectors
than centroids: as many centroids as vectors. An empty table, or one without a kept vector: no rows. Other
columns are ignored. inertia is null if it exceeds a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.common import new_path, remove

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
LARGEST = 1 << 27
#: Products of vectors with components up to this are exact as float64.
FLOATS = 1 << 20
#: Bounds are rounded outwards by this part of them.
SLACK = 1e-12
ROWS = "kind int, vec_id long, q array<int>, cluster int, upper double, lower double, distance long, sums array<long>"


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the kept vectors of vectors (vec_id, embedding) as integers."""
    good = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False)))  # not true of NaN, which is greatest
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == components)).where(good)
    return kept.select(F.col("vec_id").cast("long"), q.alias("q"))


def seeds(whole: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors with the smallest digests of salt and vec_id, null ids last."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = whole.select("q", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "q").limit(clusters).collect()
    return np.array([r.q for r in first], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each of c, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= FLOATS:
        dots = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        return (x * x).sum(1)[:, None] - 2 * dots + (c * c).sum(1)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids with what a search needs: each one's list of all by distance, itself first, and its nearest other."""

    def __init__(self, c: np.ndarray):
        self.c, k = c, len(c)
        apart = np.sqrt(squared(c, c).astype(np.float64))
        self.order = np.lexsort((np.arange(k) != np.arange(k)[:, None], apart), axis=1)
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.nearest = self.apart[:, 1] if k > 1 else np.full(k, np.inf)

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Set a, upper and lower to the nearest centroid of each x and its bounds; the number of distances computed."""
        half = self.nearest[a] / 2 * (1 - SLACK)
        at = np.flatnonzero(~(upper < np.maximum(half, lower)))
        upper[at] = np.sqrt(own_squared(x[at], self.c[a[at]]).astype(np.float64)) * (1 + SLACK)
        at = at[~(upper[at] < np.maximum(half[at], lower[at]))]
        n, k = len(at), len(self.c)
        radius = (2 * upper[at] + self.nearest[a[at]]) * (1 + SLACK)
        for j in np.unique(a[at]):
            mine = a[at] == j
            rows, inside = at[mine], np.searchsorted(self.apart[j], radius[mine], side="right")
            reach = np.ceil(np.log2(np.maximum(inside, 1))).astype(int)  # lists are cut at powers of two
            for level in np.unique(reach):
                r, near = rows[reach == level], np.sort(self.order[j][: min(1 << level, k)])
                d = squared(x[r], self.c[near])
                n += d.size
                best = d.argmin(1)  # of equal ones the first, which has the smaller number
                a[r] = near[best]
                upper[r] = np.sqrt(d[np.arange(len(r)), best].astype(np.float64)) * (1 + SLACK)
                lower[r] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SLACK) if len(near) > 1 else np.inf
        return n


def moved_bounds(a: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> None:
    """Loosen bounds by how far the own centroid, and the farthest moved other one, have moved."""
    by_size = np.argsort(moved)
    most, next_ = moved[by_size[-1]], moved[by_size[-2]] if len(moved) > 1 else 0.0
    upper += moved[a]
    upper *= 1 + SLACK
    lower -= np.where(a == by_size[-1], next_, most)
    lower -= np.abs(lower) * SLACK


def _pass(rows: DataFrame, c: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """Assign all rows; moved: how far each centroid is from where it was at the pass before, None at the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Centroids(c)
        k, width = c.shape
        sums = np.zeros((k, width + 1), np.int64)
        for b in batches:
            n = b.num_rows
            x = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(n, width).astype(np.int64)
            if moved is None:
                a, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
                d = squared(x, c)
                a[:] = d.argmin(1)
                upper[:] = np.sqrt(d[np.arange(n), a].astype(np.float64)) * (1 + SLACK)
                lower[:] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SLACK) if k > 1 else np.inf
            else:
                a, upper, lower = (b.column(name).to_numpy(zero_copy_only=False).astype(t) for name, t in (("cluster", np.int64), ("upper", float), ("lower", float)))
                moved_bounds(a, upper, lower, moved)
                found.assign(x, a, upper, lower)
            none = lambda kind: pa.nulls(n, kind)
            distance = pa.array(own_squared(x, c[a])) if last else none(pa.int64())
            if not last:
                by = np.argsort(a, kind="stable")
                cut = np.flatnonzero(np.diff(a[by], prepend=-1))
                sums[a[by][cut], :width] += np.add.reduceat(x[by], cut, axis=0) if n else 0
                sums[:, width] += np.bincount(a, minlength=k)
            q = none(pa.list_(pa.int32())) if last else b.column("q")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), b.column("vec_id"), q, pa.array(a.astype(np.int32)), pa.array(upper), pa.array(lower), distance, none(pa.list_(pa.int64()))],
                ["kind", "vec_id", "q", "cluster", "upper", "lower", "distance", "sums"],
            )
        if sums[:, -1].any():
            none = lambda kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), none(pa.int64()), none(pa.list_(pa.int32())), pa.array(np.arange(k, dtype=np.int32)), none(pa.float64()), none(pa.float64()), none(pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64()))],
                ["kind", "vec_id", "q", "cluster", "upper", "lower", "distance", "sums"],
            )

    return rows.mapInArrow(run, ROWS)


def _moved_to(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after a pass: exact floors of the means; those without a vector stay."""
    parts = rows.where("kind = 1").select("cluster", F.posexplode("sums").alias("i", "s"))
    total = parts.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {(r.cluster, r.i): int(r.s) for r in total}
    width, out = c.shape[1], c.copy()
    for j in range(len(c)):
        if n := sums.get((j, width), 0):
            out[j] = [sums[j, i] // n for i in range(width)]
    return out


def cluster(whole: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every row of whole (vec_id, q) and the centroids after rounds rounds."""
    spark = whole.sparkSession
    c = seeds(whole, clusters, salt)
    if not len(c):
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), c
    rows, moved, old = whole, None, None
    for i in range(rounds + 1):
        path = new_path(spark, "clustering")
        _pass(rows, c, moved, i == rounds).write.parquet(path)
        if old:
            remove(spark, old)
        table = spark.read.schema(ROWS).parquet(path)
        rows, old = table.where("kind = 0").select("vec_id", "q", "cluster", "upper", "lower"), path
        if i < rounds:
            now = _moved_to(table, c)
            moved = np.sqrt(own_squared(now, c).astype(np.float64)) * (1 + SLACK)
            c = now
    return table.select("vec_id", "cluster", "distance"), c


def clustered(whole: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "2:") -> DataFrame:
    """cluster() with cluster_inertia, inertia and centroid_sha256; a row of these for each centroid is sent to all tasks."""
    spark = whole.sparkSession
    found, c = cluster(whole, clusters, rounds, salt)
    per = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    told = [(j, fits(s), fits(sum(per.values())), digest(c[j])) for j, s in per.items()]
    each = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clustered(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def _sql() -> str:
    steps = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, q FROM v QUALIFY j < 40)"""
    for i in range(ROUNDS + 1):
        steps += f""",
a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, min(struct_pack(d := d, j := j)) AS best
  FROM (SELECT vec_id, v.q, j, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c) GROUP BY vec_id)"""
        if i < ROUNDS:
            steps += f""",
s{i} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT best.j AS j, unnest(range(64)) AS i, unnest(q) AS x FROM a{i}) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT j, coalesce(m.q, c.q) AS q
  FROM c{i} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{i} GROUP BY j) m USING (j))"""
    return (
        steps
        + f"""
SELECT vec_id, CAST(best.j AS INTEGER) AS "cluster", CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.j = a.best.j"""
    )


OP11_SQL = _sql()
