"""Approximate nearest neighbours by cosine with vantage-point trees.

Vectors are scaled to length one: the nearest by cosine are then the nearest
by Euclidean distance, which is a metric. A tree's node has a vantage point and
the median distance to it, which divide the rest. A query skips a side if the
triangle inequality, relaxed by ``factor``, says that it holds nothing nearer
than the k-th found: a side is searched only where gap <= factor * distance.
Factor one is exact; less is faster. How much less depends on the vectors: where
no factor is given, the least one is taken that reaches the wanted recall when
vectors of the sample are searched for others of it (``tuned_factor``).

There are two levels. A top tree over a bounded sample (``sample_rows`` vectors
of least hash, on the driver) divides space into cells; every vector is
indexed, in the cell it falls in, and a cell of more than ``shard_rows`` vectors
is cut into shards by a hash. Each shard builds a tree of its own. A query first
goes to its own cell only; the k-th distance found there says by the same
relaxed inequality which other cells it has to visit. So cells grow in number
with the input, and a query visits those near it.

Vectors of one direction that differ by a power of two only (equal ones above
all) are one point with its k+1 least ids, which is all that can matter; queries
of one direction are searched once. So a vector that a third of all rows share
is a point like any other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, partitions_for, session_of

#: Distances of points whose cosines with a query may round to the same value differ by less.
TIE = 1e-7


class Tree:
    """A vantage-point tree over rows of ``points`` (all of length one); ``compared`` counts distances of searches."""

    def __init__(self, points: np.ndarray, leaf: int = 64, seed: int = 0):
        self.points, self.leaf, self.compared = points, leaf, 0
        self.rng = np.random.default_rng(seed)
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (begin, end, -1, ...) of leaves, or (vantage, median, inner, outer)
        stack, self.root = [(0, len(points), None, 0)], 0
        while stack:
            a, b, parent, side = stack.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][2 + side] = at
            if b - a <= leaf:
                self.nodes.append([None, (a, b), 0, 0])
                continue
            v = self._vantage(a, b)
            i = a + v
            self.order[[a, i]] = self.order[[i, a]]
            d = distances(points[self.order[a + 1 : b]], points[self.order[a]][None])[:, 0]
            mid = len(d) // 2
            by = np.argpartition(d, mid)
            self.order[a + 1 : b] = self.order[a + 1 : b][by]
            self.nodes.append([int(self.order[a]), float(d[by[mid]]), 0, 0])
            stack.append((a + 1, a + 1 + mid, at, 0))
            stack.append((a + 1 + mid, b, at, 1))

    def _vantage(self, a: int, b: int, tries: int = 4, sample: int = 128) -> int:
        """Of a few points, the one whose distances to a sample spread most."""
        rows = self.order[a:b]
        pick = self.rng.choice(len(rows), size=min(tries, len(rows)), replace=False)
        some = self.rng.choice(len(rows), size=min(sample, len(rows)), replace=False)
        return int(pick[np.argmax(distances(self.points[rows[some]], self.points[rows[pick]]).std(axis=0))])

    def search(self, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and rows of the k nearest points found (fewer: inf, -1) for each query.

        ``bound``: nothing farther than this matters to a query.
        """
        n = len(queries)
        bound = np.full(n, np.inf) if bound is None else bound
        best, rows = np.full((n, k), np.inf), np.full((n, k), -1)

        def offer(q: np.ndarray, d: np.ndarray, points: np.ndarray) -> None:
            self.compared += d.size
            together = np.concatenate([best[q], d], axis=1)
            names = np.concatenate([rows[q], np.broadcast_to(points, d.shape)], axis=1)
            top = np.argpartition(together, k - 1, axis=1)[:, :k]
            best[q] = np.take_along_axis(together, top, 1)
            rows[q] = np.take_along_axis(names, top, 1)

        def visit(node: int, q: np.ndarray) -> None:
            vantage, what, inner, outer = self.nodes[node]
            if vantage is None:
                own = self.order[what[0] : what[1]]
                if len(own):
                    offer(q, distances(queries[q], self.points[own]), own)
                return
            d = distances(queries[q], self.points[[vantage]])
            offer(q, d, np.array([vantage]))
            d = d[:, 0]
            near = d < what
            for child, here in ((inner, near), (outer, ~near)):
                if here.any():
                    visit(child, q[here])
            reach = factor * np.minimum(best[q].max(axis=1), bound[q])
            cross = np.abs(d - what) <= reach + TIE
            for child, here in ((outer, near & cross), (inner, ~near & cross)):
                if here.any():
                    visit(child, q[here])

        if n:
            visit(0, np.arange(n))
        return best, rows

    def cells(self) -> dict[int, int]:
        """Numbers of the leaves, which are the cells that the tree divides space into."""
        return {node: i for i, node in enumerate(at for at, x in enumerate(self.nodes) if x[0] is None)}

    def route(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): a query's own cell and those within ``reach`` of it by the triangle inequality; own ones come first."""
        number, own, others = self.cells(), [], []
        stack = [(0, np.arange(len(queries)), np.ones(len(queries), bool))]
        while stack:
            node, q, home = stack.pop()
            vantage, what, inner, outer = self.nodes[node]
            if vantage is None:
                for to, pick in ((own, q[home]), (others, q[~home])):
                    to.append((pick, np.full(len(pick), number[node])))
                continue
            d = distances(queries[q], self.points[[vantage]])[:, 0]
            near, cross = d < what, np.abs(d - what) <= reach[q] + TIE
            for child, side in ((inner, near), (outer, ~near)):
                here = side | cross
                if here.any():
                    stack.append((child, q[here], home[here] & side[here]))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*own, *others, strict=True)) if own or others else (np.zeros(0, np.int64),) * 2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def directions(m: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, exactly, so that the largest component is in [1/2, 1)."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None]) + 0.0 if len(m) else m


def units(m: np.ndarray) -> np.ndarray:
    m = directions(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(m) else m


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision; vectors are only rescaled by powers of two."""
    a, b = directions(a), directions(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part: no null, zero or non-finite vectors."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))).where(F.exists(v, lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    """Vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(m: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))


def _by_length(batch, at: int):
    """The batch in parts with vectors of one length in column ``at``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    length = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for dim in np.unique(length):
        yield int(dim), batch.take(pa.array(np.flatnonzero(length == dim)))


def _directed(batches):
    import pyarrow as pa

    for batch in batches:
        for dim, part in _by_length(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(part.num_rows, dim, np.int32)), _lists(directions(_matrix(part.column(1))))], names=["vec_id", "dim", "vector"])


def _routed(trees):
    """A point's cell."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for dim, part in _by_length(batch, 1):
                q = units(_matrix(part.column(1)))
                at, cell = trees.value[dim].route(q, np.full(len(q), -1.0))
                home = np.empty(len(q), np.int64)
                home[at] = cell
                yield pa.RecordBatch.from_arrays([pa.array(home), *part.columns], names=["cell", *part.schema.names])

    return run


def _visits(trees, factor: float):
    """(point, vector, bound) of queries in all cells but their own that they have to visit."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for dim, part in _by_length(batch, 1):
                bound = part.column(2).to_numpy(zero_copy_only=False)
                at, cell = trees.value[dim].route(units(_matrix(part.column(1))), factor * bound)
                _, home = np.unique(at, return_index=True)  # a query's own cell comes first
                away = np.ones(len(at), bool)
                away[home] = False
                at, cell = at[away], cell[away]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(c.take(pa.array(at)) for c in part.columns)], names=["cell", "point", "vector", "bound"])

    return run


def answers(c: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, factor: float, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of at least the k best points found of each query; ties of the k-th all come.

    ``c``, ``q``: directions. Where more points than were asked for may tie,
    all points are compared.
    """
    tree, unit, out = Tree(units(c)), units(q), []
    for lo in range(0, len(q), block):
        some = slice(lo, lo + block)
        d, rows = tree.search(unit[some], k + 8, factor, bound[some])
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        full = np.flatnonzero((d.max(axis=1) <= kth + TIE) & (len(c) > k + 8))
        row, col = np.nonzero(rows >= 0)
        point = rows[row, col]
        keep = (d[row, col] <= np.minimum(kth[row], bound[some][row]) + TIE) & ~np.isin(row, full)
        row, point = row[keep], point[keep]
        for i in full.tolist():
            near = np.flatnonzero(distances(unit[some][[i]], tree.points)[0] <= kth[i] + TIE)
            row, point = np.append(row, np.full(len(near), i)), np.append(point, near)
        out.append((row + lo, point))
    row, point = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
    return row, point, cosine(q[row], c[point])


def tuned_factor(sample: np.ndarray, top: Tree, k: int, recall: float, queries: int = 96, most: int = 4096, steps: int = 7) -> float:
    """The least factor, to 1/128, at which vectors of the sample find ``recall`` of their k+1 nearest in it.

    What is lost is the product of two: by cells of ``top`` that aren't visited,
    with the distance of the k-th in a query's own cell as its bound, and by
    sides of a shard's tree that aren't searched.
    """
    few, shard = sample[:queries], sample[:most]
    apart, inside = distances(few, sample), distances(few, shard)
    wanted = min(k + 1, len(shard))
    goal, near = np.sort(apart, axis=1)[:, wanted - 1], np.sort(inside, axis=1)[:, wanted - 1]
    home = np.empty(len(sample), np.int64)
    at, cell = top.route(sample, np.full(len(sample), -1.0))
    home[at] = cell
    own = np.where(home[None] == home[: len(few), None], apart, np.inf)
    bound = np.sort(own, axis=1)[:, wanted - 1]
    tree = Tree(shard)

    def reached(factor: float) -> float:
        d, _ = tree.search(few, wanted, factor)
        by_tree = (d <= near[:, None] + TIE).sum() / (wanted * len(few))
        row, to = top.route(few, factor * bound)
        seen = np.zeros((len(few), int(home.max()) + 1), bool)
        seen[row, to] = True
        hit = (apart <= goal[:, None] + TIE) & seen[np.arange(len(few))[:, None], home[None]]
        return by_tree * min(1.0, hit.sum() / (wanted * len(few)))

    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if reached(mid) >= recall else (mid, high)
    return high


FOUND = "point long, vec_id long, score double"


def _answer(k: int, factor: float):
    """The k+1 best vectors of each query of a shard; rows are sorted by shard, points before queries."""

    def search(points: list, queries: list):
        import pyarrow as pa

        c, q = (np.concatenate([_matrix(b.column(3)) for b in x]) for x in (points, queries))
        name = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in queries])
        bound = np.concatenate([b.column(5).to_numpy(zero_copy_only=False) for b in queries])
        ids = [i for b in points for i in b.column(4).to_pylist()]
        count = np.array([len(i) for i in ids])
        flat, first = np.array([i for x in ids for i in x], np.int64), np.cumsum(count) - count
        row, point, score = answers(c, q, bound, k + 1, factor)
        n = count[point]
        row, score = np.repeat(row, n), np.repeat(score, n)
        vec_id = flat[np.repeat(first[point], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((vec_id, -score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        top = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k + 1
        return pa.RecordBatch.from_arrays([pa.array(name[row[top]]), pa.array(vec_id[top]), pa.array(score[top])], names=["point", "vec_id", "score"])

    def run(batches):
        now, points, queries, waiting = None, [], [], 0
        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            query = batch.column(1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (query[1:] != query[:-1])])) if len(shard) else []
            for a, b in zip(edge, np.append(edge[1:], len(shard)) if len(shard) else [], strict=True):
                if shard[a] != now or waiting > 65_536:
                    if points and queries:
                        yield search(points, queries)
                    queries, waiting = [], 0
                    if shard[a] != now:
                        now, points = shard[a], []
                (queries if query[a] else points).append(batch.slice(a, b - a))
                waiting += (b - a) * bool(query[a])
        if points and queries:
            yield search(points, queries)

    return run


def nearest(vectors: DataFrame, k: int = 5, query_modulus: int = 50, factor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 4096, sample_rows: int = 16_384, recall: float = 0.97, scratch_group: str = "vptree") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest found of each query.

    Queries are the rows whose id is divisible by ``query_modulus``; candidates
    are all rows but the query's own (and any other row of the same id).
    Nearness is the largest cosine in double precision, ties to the smaller
    id. Null ids, and vectors null, empty, zero or with a null or non-finite
    component take no part. Vectors meet vectors of the same length only.
    Repeated rows are one. An empty table gives no rows; other columns are
    ignored, whatever their names. At factor one the result is exact; without a
    factor, the one of the commonest length that reaches ``recall`` on the sample.
    """
    spark = session_of(vectors)
    scratch = Scratch(spark, scratch_group)
    rows = usable(vectors, id_col, vec_col).where("vec_id is not null").mapInArrow(_directed, "vec_id long, dim int, vector array<double>").distinct()
    rows = scratch.table("rows", rows.withColumn("hash", F.xxhash64("vector")))
    nth = F.row_number().over(Window.partitionBy("dim", "hash", "vector").orderBy("vec_id"))
    least = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    points = scratch.table("points", least.groupBy("dim", "hash", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    if points.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # the top trees, one for each length of vectors that enough of the sample has
    n = points.count()
    drawn = points.select("dim", "vector").orderBy("hash", "dim").limit(sample_rows)
    sample: dict[int, list] = {}
    for dim, vector in drawn.toLocalIterator():
        sample.setdefault(dim, []).append(vector)
    wanted = max(1, min(-(-n // shard_rows), sample_rows // 8))
    trees = {dim: Tree(units(np.array(m)), leaf=max(8, -(-len(m) // max(1, round(wanted * len(m) / min(n, sample_rows)))))) for dim, m in sample.items()}
    if factor is None:
        common = max(sample, key=lambda dim: (len(sample[dim]), -dim))
        factor = tuned_factor(units(np.array(sample[common])), trees[common], k, recall)
    divided = any(len(t.cells()) > 1 for t in trees.values())
    lone = Tree(np.zeros((1, 1)))  # a length that the sample hasn't: one cell
    trees = spark.sparkContext.broadcast(_Trees(trees, lone))

    routed = scratch.table("cells", points.select(F.lit(0).cast("long").alias("point"), "vector", "dim", "hash", "ids").mapInArrow(_routed(trees), "cell long, point long, vector array<double>, dim int, hash long, ids array<bigint>"))
    # as many rows as there are cells, and cells are bounded by the sample for each length
    shards = routed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    shards = scratch.table("shards", shards)
    shard = lambda number: F.xxhash64("dim", "cell", number.cast("long"))
    dealt_points = routed.join(shards, ["dim", "cell"]).select(shard(F.pmod("hash", "shards")).alias("shard"), F.lit(False).alias("is_query"), "point", "vector", "ids", F.lit(0.0).alias("bound"))
    asked = rows.where(F.pmod("vec_id", F.lit(query_modulus)) == 0).groupBy("dim", "hash", "vector").agg(F.min("vec_id").alias("point"))
    asked = scratch.table("asked", asked)
    parts = partitions_for(spark, n, shard_rows)

    def searched(name: str, queries: DataFrame) -> DataFrame:
        """The k+1 best found of each query (cell, point, vector, dim, bound)."""
        each = queries.join(shards, ["dim", "cell"]).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        each = each.select(shard(F.col("number")).alias("shard"), F.lit(True).alias("is_query"), "point", "vector", F.lit(None).cast("array<bigint>").alias("ids"), "bound")
        dealt = dealt_points.union(each).repartition(parts, "shard").sortWithinPartitions("shard", "is_query")
        return scratch.table(name, best_of(dealt.mapInArrow(_answer(k, factor), FOUND), k + 1))

    def best_of(found: DataFrame, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("point").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")

    own = asked.select("point", "vector", "dim").mapInArrow(_routed(trees), "cell long, point long, vector array<double>, dim int")
    near = searched("near", own.withColumn("bound", F.lit(float("inf"))))
    if not divided:  # no other cells
        return _ranked(rows, asked, near, query_modulus, k)
    kth = near.groupBy("point").agg(F.when(F.count("*") > k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).alias("bound"))
    bounded = asked.join(kth, "point", "left").select("point", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    away = bounded.mapInArrow(_visits(trees, factor), "cell long, point long, vector array<double>, bound double").withColumn("dim", F.size("vector"))
    return _ranked(rows, asked, best_of(near.union(searched("far", away)), k + 1), query_modulus, k)


def _ranked(rows: DataFrame, asked: DataFrame, found: DataFrame, query_modulus: int, k: int) -> DataFrame:
    """The k best of each query that aren't its own row."""
    ids = rows.where(F.pmod("vec_id", F.lit(query_modulus)) == 0).select("dim", "hash", "vector", F.col("vec_id").alias("query_id")).join(asked, ["dim", "hash", "vector"]).select("query_id", "point").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = ids.join(found, "point").where("vec_id <> query_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class _Trees:
    """Top trees by length of vectors; a length without one has a single cell."""

    def __init__(self, trees: dict[int, Tree], lone: Tree):
        self.trees, self.lone = trees, lone

    def __getitem__(self, dim: int) -> Tree:
        return self.trees.get(dim, self.lone)
