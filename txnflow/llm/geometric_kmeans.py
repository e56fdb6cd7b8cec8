"""Exact K-means with bounds that are loosened by geometry.

Every vector carries, from round to round, its centroid, an upper bound of the distance to it, and a lower bound of the distance to any other
centroid. While the upper bound stays below the lower one its centroid is the nearest and no distance is computed. Otherwise the distance to
its own centroid is, and if that doesn't settle it the vector is ambiguous and compared with all centroids, in whole numbers.

When centroids move, an upper bound grows by the drift of its own centroid. Lower bounds shrink by less than the drift of the others
(drift tightening). The vectors of cluster i lie in a sphere around centroid i whose radius is their largest upper bound. How much nearer
can another centroid, moved from a to b, have come to a point x of that sphere? Distances to a and b depend only on where x lies in a plane
with both, and with m halfway between a and b the difference is

    |x - a| - |x - b| = 2 (x - m) . (b - a) / (|x - a| + |x - b|) <= |b - a| cos(angle at m between x and b), or 0,

since |x - a| + |x - b| >= 2 |x - m|. The point of the sphere with the smallest such angle lies in the plane of a, b and the sphere's centre:
its angle is that of the centre less asin(radius / distance of the centre from m). Where m lies in the sphere, or the angle falls to 0, the
full drift remains. Clusters that a centroid moves past or away from lose little or nothing.

Centroids are means rounded down, kept as whole numbers by the driver (as many as clusters); the sums behind them change only by the
vectors that change their cluster. A round stores the vectors with their bounds and removes those of the round before, so that a lost
executor costs one round at most. Tasks send one row for each cluster.

Components are whole numbers, floor(scale * x). Vectors that are null, of another length, or hold a null or non-finite component are left
out. Rows count one by one, also with equal or null ids; as starting points null ids come last, and equal ids are ordered by their vectors. With fewer
vectors than clusters there are fewer centroids. Ties go to the centroid with the smaller number.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.vectors import slices, usable, whole_numbers
from txnflow.workspace import job_scope, materialize, release

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
#: Components are taken in steps of 1 / SCALE.
SCALE = 1024
#: Mixed into the hash that picks the first centroids.
SEED = "3"
#: Bounds are doubles; comparisons leave this share, and this much besides, for their rounding.
SLACK, LEAST_SLACK = 1e-9, 1e-6
_STATE = "row, vector binary, cluster int, upper double, lower double, distance bigint"
_STATS = "stat struct<cluster:int,n:bigint,radius:double,inertia:bigint,scanned:bigint,sums:array<bigint>>"


def _largest(dims: int) -> int:
    """Components beyond it could take a squared distance beyond 64 bits."""
    return int(1.5e9 / math.sqrt(max(dims, 1)))


def drift_bounds(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer centroid j can have come to any point of cluster i's sphere, for all i and j.

    ``radius`` is around the centroids ``before``; a cluster without points has none (negative).
    """
    k = len(before)
    drift = np.sqrt(((after - before) ** 2).sum(1))
    middle = (before + after) / 2
    wide = radius * (1 + SLACK) + LEAST_SLACK
    out = np.tile(drift, (k, 1))
    for i in range(k):
        for j in range(k):
            if not drift[j] or radius[i] < 0:
                out[i, j] = 0.0
                continue
            to_centre = before[i] - middle[j]
            distance = math.sqrt(float((to_centre ** 2).sum()))
            if distance <= wide[i]:
                continue
            cosine = float(to_centre @ (after[j] - before[j])) / (distance * drift[j])
            angle = math.acos(min(1.0, max(-1.0, cosine))) - math.asin(wide[i] / distance)
            # The slack covers the rounding of the two angles.
            out[i, j] = min(drift[j], drift[j] * (max(0.0, math.cos(max(0.0, angle))) + 1e-7))
    return out


def _distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids."""
    out = np.empty((len(values), len(centroids)), np.int64)
    for j, centroid in enumerate(centroids):
        apart = values - centroid
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


def _apart(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether a vector's own centroid is nearer than any other beyond doubt."""
    return upper * (1 + SLACK) + LEAST_SLACK < lower * (1 - SLACK)


def assigned(values: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray,
             centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids with new bounds, and how many vectors were compared with all centroids.

    ``cluster`` may hold -1 for vectors without bounds. Bounds must hold for ``centroids``.
    """
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    unsure = np.flatnonzero((cluster < 0) | ~_apart(upper, lower))
    own = unsure[cluster[unsure] >= 0]
    apart = values[own] - centroids[cluster[own]]
    upper[own] = np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(np.float64))
    settled = own[_apart(upper[own], lower[own])]
    ambiguous = np.setdiff1d(unsure, settled, assume_unique=True)
    squares = _distances(values[ambiguous], centroids)
    cluster[ambiguous] = squares.argmin(1) if len(ambiguous) else 0
    nearest = np.sort(squares, axis=1)
    upper[ambiguous] = np.sqrt(nearest[:, 0].astype(np.float64))
    lower[ambiguous] = np.sqrt(nearest[:, 1].astype(np.float64)) if squares.shape[1] > 1 else np.inf
    return cluster, upper, lower, len(ambiguous)


def _step(points: DataFrame, row: str, dims: int, centroids: np.ndarray, own_drift: np.ndarray, loss: np.ndarray, last: bool) -> DataFrame:
    """Points with their new centroids and bounds, and each task's changes of every cluster as rows with a ``stat``.

    A lower bound loses the most that any other centroid can have gained on its cluster's sphere (``loss``). The last step
    also has every vector's exact distance.
    """
    k = len(centroids)

    def moved(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, change = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        radius, inertia, scanned = np.full(k, -1.0), np.zeros(k, np.int64), 0
        kind = None
        for batch in slices(stream, dims):
            kind = batch.column(0).type
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
            was = batch.column(2).to_numpy()
            known = np.maximum(was, 0)
            upper = batch.column(3).to_numpy() + own_drift[known]
            lower = np.maximum(batch.column(4).to_numpy() - loss[known], 0.0)
            now, upper, lower, n = assigned(values, was, upper, lower, centroids)
            scanned += n
            changed = np.flatnonzero(now != was)
            np.add.at(sums, now[changed], values[changed])
            np.add.at(change, now[changed], 1)
            left = changed[was[changed] >= 0]
            np.subtract.at(sums, was[left], values[left])
            np.subtract.at(change, was[left], 1)
            np.maximum.at(radius, now, upper)
            distance = np.full(len(now), -1, np.int64)
            if last:
                apart = values - centroids[now]
                distance = np.einsum("ij,ij->i", apart, apart)
                np.add.at(inertia, now, distance)
            nothing = pa.nulls(len(now), stat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(now, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance), nothing], names)
        if kind is not None:
            rows = [{"cluster": j, "n": int(change[j]), "radius": radius[j], "inertia": int(inertia[j]),
                     "scanned": scanned if j == 0 else 0, "sums": sums[j].tolist()} for j in range(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, t) for t in (kind, pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64())] + [pa.array(rows, stat)], names)

    names = ["row", "vector", "cluster", "upper", "lower", "distance", "stat"]
    stat = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("inertia", pa.int64()),
                      ("scanned", pa.int64()), ("sums", pa.list_(pa.int64()))])
    schema = f"{_STATE.replace('row', f'row {row}', 1)}, {_STATS}"
    return points.select("row", "vector", "cluster", "upper", "lower").mapInArrow(moved, schema)


def _points(vectors: DataFrame, column: str, keep, dims: int, scale: int) -> tuple[DataFrame, str]:
    """Vectors as packed whole numbers without bounds, and the type of ``row``."""
    source = vectors.where(usable(column, dims)).select(F.struct(*keep).alias("row"), F.col(column).alias("vector"))
    row = source.schema["row"].dataType.simpleString()

    def packed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, dims):
            values = whole_numbers(batch.column(1), dims, scale, _largest(dims)).astype(np.int32)
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(np.full(n, -1), pa.int32()),
                 pa.array(np.zeros(n)), pa.array(np.zeros(n))], ["row", "vector", "cluster", "upper", "lower"])

    return source.mapInArrow(packed, f"row {row}, vector binary, cluster int, upper double, lower double"), row


def _changes(stored: DataFrame) -> tuple[dict[int, tuple], dict[tuple[int, int], int]]:
    """Per cluster (vectors gained, radius, inertia, vectors scanned), and by cluster and place the change of the sums."""
    stats = stored.where(F.col("stat").isNotNull()).select("stat.*")
    by_cluster = stats.groupBy("cluster").agg(F.sum("n"), F.max("radius"), F.sum("inertia"), F.sum("scanned")).collect()
    by_place = (stats.select("cluster", F.posexplode("sums").alias("place", "change")).groupBy("cluster", "place").agg(F.sum("change")).collect())
    return {r[0]: tuple(r)[1:] for r in by_cluster}, {(r[0], r[1]): r[2] for r in by_place}


def clustered(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS,
              dims: int = DIMS, scale: int = SCALE, seed: str = SEED, log: list | None = None) -> DataFrame:
    """``row`` (a struct of ``key``), cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept.

    ``log`` gets, for each round, how many vectors were compared with all centroids.
    """
    spark = vectors.sparkSession
    with job_scope(spark) as scope:
        points, row = _points(vectors, column, [key], dims, scale)
        table = points = materialize(points, "points")
        name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"row.`{key}`").cast("string")), 256)
        # The packed bytes only order rows of one id.
        first = points.orderBy(name.asc_nulls_last(), "vector").select("vector").limit(clusters).collect()
        k = len(first)
        centroids = np.array([np.frombuffer(r[0], np.int32) for r in first], np.int64).reshape(k, dims)
        sums, sizes = [[0] * dims for _ in range(k)], [0] * k
        own_drift, loss = np.zeros(k), np.zeros(k)
        inertia: dict[int, int] = {}
        for turn in range(rounds + 1 if k else 0):
            stored = materialize(_step(points, row, dims, centroids, own_drift, loss, turn == rounds), "points")
            release(table)
            table, points = stored, stored.where(F.col("stat").isNull())
            gained, changed = _changes(stored)
            if log is not None:
                log.append(sum(g[3] for g in gained.values()))
            for (j, place), change in changed.items():
                sums[j][place] += change
            for j, g in gained.items():
                sizes[j] += g[0]
            if turn == rounds:
                inertia = {j: g[2] for j, g in gained.items()}
                break
            moved = np.array([[t // sizes[j] for t in sums[j]] if sizes[j] else centroids[j].tolist() for j in range(k)], np.int64)
            radius = np.array([gained.get(j, (0, -1.0))[1] for j in range(k)])
            gain = drift_bounds(centroids.astype(np.float64), moved.astype(np.float64), radius)
            np.fill_diagonal(gain, 0.0)
            loss = gain.max(1)
            own_drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64))
            centroids = moved
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

        def of_cluster(values: list, kind: str) -> F.Column:
            return F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

        return scope.keep(points.select(
            "row", "cluster", (F.col("distance") if k else F.lit(0).cast("bigint")).alias("distance"),
            of_cluster([inertia.get(j, 0) for j in range(k)], "bigint").alias("cluster_inertia"),
            F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256")), "clustered")


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept."""
    return clustered(embeddings.select("vec_id", "embedding")).select("row.*", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    """The same by comparing every vector with every centroid in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} as materialized (
  select vec_id, arg_min(cluster, distance * {clusters} + cluster) as cluster, min(distance) as distance
  from (select k.vec_id, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance
        from kept k, centroids{r} c)
  group by vec_id)""")
        if r < rounds:
            steps.append(f"""
centroids{r + 1} as materialized (
  select c.cluster, coalesce(m.v, c.v) as v
  from centroids{r} c left join (
    select cluster, list((total - ((total % n) + n) % n) // n order by place) as v
    from (select cluster, place, sum(x)::bigint as total, count(*) as n
          from (select n.cluster, unnest(k.v) as x, unnest(range(1, {dims} + 1)) as place from near{r} n join kept k using (vec_id))
          group by cluster, place)
    group by cluster) m using (cluster))""")
    return f"""
with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(embedding) = {dims}
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
centroids0 as materialized (
  select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, v
  from kept order by sha256('{seed}:' || vec_id) limit {clusters}),{",".join(steps)},
hashed as (select cluster, sha256(array_to_string(v, ',')) as centroid_sha256 from centroids{rounds})
select vec_id, cluster::integer as cluster, distance,
  (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256
from near{rounds} join hashed using (cluster)"""


ORACLE_SQL = _oracle()
