"""Exact k-means over integer vectors by balls.

A cluster is a ball: its centroid and a radius that holds all its members. A
member at distance d of its centroid can only be nearer to (or as near to)
another centroid that lies within 2d of its own. So

1. the neighbours of a ball are the centroids within twice its radius,
2. members nearer than half the way to the first neighbour are the stable core
   and are compared with nothing,
3. the rest lie in annuli between half distances of neighbours in order; a
   member is compared with the neighbours whose half distance it reaches.

Distances are squared integers throughout, so assignments (ties go to the
smaller number) are those of the plain method. After the centroids have moved, a
ball's radius is bounded by its old radius and the way its centroid went, so a
round is one pass over the vectors, without a shuffle, and one aggregate whose
result is a row for each cluster. Each round's table is written to the shared
folder, and the one before it is deleted. The driver holds the centroids: at
most ``MOST_CLUSTERS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, session_of

#: Most centroids that the driver and every task hold.
MOST_CLUSTERS = 4096
#: Components are integers below this, so that a squared distance is a long.
MOST = 1 << 27


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to a centre."""
    d = points.shape[1]
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centre).max(initial=0)))
    if 4 * d * most * most < 1 << 53:  # every partial sum is an integer that a double holds
        diff = points.astype(np.float64) - centre
        return np.einsum("ij,ij->i", diff, diff).astype(np.int64)
    diff = points.astype(np.int64) - centre
    return np.einsum("ij,ij->i", diff, diff)


@dataclass
class Balls:
    """Centroids with their neighbours; ``compared`` counts distances to neighbours."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]  # of each ball, nearest first
    apart: list[np.ndarray]  # their squared distances
    compared: int = 0

    @classmethod
    def of(cls, centroids: np.ndarray, radius: list[int | None]) -> Balls:
        """``radius``: a whole number that is no less than the ball's radius; None: no bound is known."""
        near, apart = [], []
        for j, r in enumerate(radius):
            d = squared(centroids, centroids[j])
            held = (d <= 4 * r * r) if r is not None and 4 * r * r < 1 << 63 else np.ones(len(d), bool)
            held[j] = False
            at = np.flatnonzero(held)
            at = at[np.argsort(d[at], kind="stable")]
            near.append(at)
            apart.append(d[at])
        return cls(centroids, near, apart)

    def assign(self, points: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and squared distance of every point, from the cluster it was in."""
        best, dist = cluster.copy(), np.zeros(len(points), np.int64)
        order = np.argsort(cluster, kind="stable")
        edges = np.flatnonzero(np.diff(cluster[order], prepend=-1)) if len(order) else []
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[a:b]
            j = int(cluster[rows[0]])
            own = squared(points[rows], self.centroids[j])
            dist[rows] = own
            # the annulus: how many neighbours lie within twice the point's distance
            annulus = np.searchsorted(self.apart[j], 4 * own, side="right")
            out = np.argsort(-annulus, kind="stable")
            rows, annulus = rows[out], annulus[out]
            for c, i in enumerate(self.neighbours[j]):
                n = int(np.searchsorted(-annulus, -c, side="left"))  # those whose annulus is beyond c
                if n == 0:
                    break
                at = rows[:n]
                d = squared(points[at], self.centroids[i])
                self.compared += n
                better = (d < dist[at]) | ((d == dist[at]) & (i < best[at]))
                best[at[better]], dist[at[better]] = i, d[better]
        return best, dist


def integer_vectors(vectors: DataFrame, scale: int, dim: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vector (array<int>, floor(scale * x)) of the rows with ``dim`` components, none null or non-finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False)))
    large = F.exists(v, lambda x: F.abs(x * scale) >= float(MOST))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    return rows.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component is {MOST} or more after scaling")).cast("array<int>")).otherwise(whole).alias("vector"))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _assigned(balls: Balls, dim: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            best, dist = balls.assign(_matrix(batch.column(1), dim), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(dist)], names=["vec_id", "vector", "cluster", "distance"])

    return run


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; null ids come last, ties by components."""
    digest: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("digest"), "vector").orderBy(F.asc_nulls_last("digest"), "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", scratch_group: str = "ballkmeans") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (array) of every usable vector.

    Vectors of another length than ``dim``, null ones and those with a null or
    non-finite component take no part; a component of 2**27 or more after scaling
    is an error, as its distances would be no longs. Repeated rows, and rows of
    one id, are vectors of their own; a null id is kept and comes last among the
    first centroids. Fewer vectors than ``k`` give fewer centroids; equal
    centroids leave the one with the greater number empty, and it stays. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    if not 0 < k <= MOST_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MOST_CLUSTERS}")
    spark = session_of(vectors)
    scratch = Scratch(spark, scratch_group)
    id_type = vectors.schema[id_col].dataType
    plain = T.StructType([T.StructField("vec_id", id_type), T.StructField("vector", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    now = scratch.table("kept", integer_vectors(vectors, scale, dim, id_col, vec_col).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}))
    centroids, before = first_centroids(now, k, seed), "kept"
    radius: list[int | None] = [None] * len(centroids)
    sums = [F.sum(F.element_at("vector", i + 1).cast("long")).alias(f"s{i}") for i in range(dim)]
    stats: dict[int, dict] = {}
    for r in range(rounds + 1 if len(centroids) else 0):
        now = scratch.table(f"round-{r}", now.mapInArrow(_assigned(Balls.of(centroids, radius), dim), plain))
        scratch.drop(before)
        before = f"round-{r}"
        wanted = [] if r == rounds else [F.count("*").alias("n"), F.max("distance").alias("far"), *sums]
        stats = {x["cluster"]: x.asDict() for x in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), *wanted).collect()}
        if r == rounds:
            break
        moved = centroids.copy()
        for j, x in stats.items():
            moved[j] = [x[f"s{i}"] // x["n"] for i in range(dim)]
        way = ((moved - centroids) ** 2).sum(axis=1)
        radius = [isqrt(stats[j]["far"]) + 1 + isqrt(int(way[j])) + 1 if j in stats else 0 for j in range(len(centroids))]
        centroids = moved
    total = sum(int(x["inertia"]) for x in stats.values())
    if total >= 1 << 63:
        raise OverflowError("the inertia is no long")
    about = [(j, int(x["inertia"]), total, [int(v) for v in centroids[j]]) for j, x in stats.items()]
    # a row for each cluster
    table = F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>"))
    return now.join(table, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: str = "centroid") -> Column:
    return F.sha2(F.concat_ws(",", F.transform(centroid, lambda x: x.cast("string"))), 256)


def plain_kmeans(points: dict, k: int, rounds: int, seed: int) -> tuple[dict, np.ndarray]:
    """For tests: the same by comparing everything. ``points``: id -> list of integers; ids are distinct."""
    ids = list(points)
    p = np.array([points[i] for i in ids], np.int64)
    start = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest())[:k]
    c = p[start]
    for r in range(rounds + 1):
        d = ((p[:, None] - c[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        if r < rounds:
            c = np.array([p[at == j].sum(axis=0) // (at == j).sum() if (at == j).any() else c[j] for j in range(len(c))])
    return {i: (int(a), int(d[x, a])) for x, (i, a) in enumerate(zip(ids, at, strict=True))}, c


def cluster_sql(k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1) -> str:
    """The same over table ``embeddings`` for an independent engine, by comparing everything."""
    apart = "list_sum(list_transform(list_zip(p.v, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    ctes = [
        f"kept as materialized (select vec_id, row_number() over () as rid, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings"
        f" where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim})",
        f"c0 as materialized (select row_number() over (order by h nulls last, v) - 1 as c, v as w from (select sha256('{seed}:' || vec_id::varchar) as h, v from kept) order by c limit {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} as materialized (select rid, any_value(vec_id) as vec_id, any_value(v) as v, min(d * {k} + c) % {k} as c, min(d * {k} + c) // {k} as d from (select p.rid, p.vec_id, p.v, c.c, {apart} as d from kept p cross join c{r} c) group by rid)")
        if r < rounds:
            ctes.append(f"m{r} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as w from (select c, i, sum(v[i])::hugeint as s, count(*) as n from a{r}, range(1, {dim + 1}) as t(i) group by c, i) group by c)")
            ctes.append(f"c{r + 1} as materialized (select o.c, coalesce(m.w, o.w) as w from c{r} o left join m{r} m on m.c = o.c)")
    return "with " + ",\n".join(ctes) + (
        f"\nselect a.vec_id, a.c::int as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,"
        f" sha256(array_to_string(c.w, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on c.c = a.c"
    )
