"""Registered queries of graph partitions and weighted draws; their SQL states what must hold of any right result."""

from __future__ import annotations

from pyspark.sql import functions as F

from nadir.operators import graphs
from nadir.operators import sampling as S
from nadir.operators import splits as X
from nadir.operators.ordering import settled

from .catalog import T, lines, pair_partitions, query

# customers and parts of one last digit are linked by their orders, and by a few lines across digits
_LINKS = "SELECT 'c' || (o_custkey % 300) AS a, 'p' || (l_partkey % 100) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 = l_partkey % 10 OR (l_linenumber = 7 AND l_partkey % 20 = 1)"


def links(spark, d):
    both = lines(spark, d).join(T(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_custkey % 10 = l_partkey % 10 or (l_linenumber = 7 AND l_partkey % 20 = 1)")
    return both.select(F.concat(F.lit("c"), (F.col("o_custkey") % 300).cast("string")).alias("a"), F.concat(F.lit("p"), (F.col("l_partkey") % 100).cast("string")).alias("b"))


@query(f"WITH l AS ({_LINKS}) SELECT count(*) AS n_rows, (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l)) AS n_nodes, CAST(0 AS BIGINT) AS nodes_in_two_folds, true AS parts_within_five_percent, true AS leaves_out_a_third_of_the_hash FROM l")
def split_cold_both_graph(spark, d):
    """Parts of the graph as folds, beside parts by hash."""
    rows = settled(links(spark, d).groupBy("a", "b").agg(F.count("*").alias("n")))  # a row for each link, however often it comes
    where = graphs.balanced_parts(rows, "a", "b", weight="n")
    fold = F.element_at(F.array(*map(F.lit, graphs.part_folds(10, 42, X.DEFAULT))), F.col("part") + 1)
    side = lambda key: where.select(F.col("node").alias(key), fold.alias(f"f{key}"))
    kept = rows.join(side("a"), "a").join(side("b"), "b").withColumn("fold", F.when(F.col("fa") == F.col("fb"), F.col("fa")))
    crossing = kept.where("fold is not null").select(F.explode(F.array("a", "b")).alias("x"), "fold").groupBy("x").agg(F.countDistinct("fold").alias("n")).where("n > 1").agg(F.count("*").alias("nodes_in_two_folds"))
    sizes = where.groupBy("part").count().agg(F.sum("count").alias("n_nodes"), ((F.max("count") <= 1.05 * F.sum("count") / 10) & (F.min("count") >= 0.95 * F.sum("count") / 10)).alias("parts_within_five_percent"))
    unplaced = F.coalesce(F.sum(F.when(F.col("fold").isNull(), F.col("n"))), F.lit(0))
    by_hash = X.partition_both(rows, "a", "b").agg(unplaced.alias("hashed"))
    left = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), unplaced.alias("out"))
    one = left.crossJoin(by_hash).crossJoin(sizes).crossJoin(crossing)  # single rows
    return one.select("n_rows", "n_nodes", "nodes_in_two_folds", "parts_within_five_percent", (F.col("out") * 3 <= F.col("hashed")).alias("leaves_out_a_third_of_the_hash"))


_DRAW = "CAST('0x' || substr(md5('42:' || i || ':{s}'), 1, 15) AS BIGINT) % (SELECT CAST(sum(w) AS BIGINT) FROM w{s})"


@query(f"""WITH t AS (SELECT DISTINCT o_custkey AS a, l_partkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), wa AS (SELECT a AS k, count(*) AS w FROM t GROUP BY 1), wb AS (SELECT b AS k, count(*) AS w FROM t GROUP BY 1),
 ca AS (SELECT k, w, sum(w) OVER (ORDER BY md5('42:' || k), k) - w AS c FROM wa), cb AS (SELECT k, w, sum(w) OVER (ORDER BY md5('42:' || k), k) - w AS c FROM wb),
 d AS (SELECT i, {_DRAW.format(s='a')} AS ua, {_DRAW.format(s='b')} AS ub FROM range(0, 6000) r(i)),
 f AS (SELECT ca.k AS a, cb.k AS b, min(i) AS draw FROM d JOIN ca ON ua >= ca.c AND ua < ca.c + ca.w JOIN cb ON ub >= cb.c AND ub < cb.c + cb.w GROUP BY 1, 2)
 SELECT a, b, draw FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = f.a AND t.b = f.b) ORDER BY draw LIMIT 300""")
def degree_weighted_pairs(spark, d):
    """Customers and parts without an order between them, drawn by their degrees."""
    tested = lines(spark, d).join(T(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    degree = lambda c: tested.groupBy(c).agg(F.count("*").alias("w"))
    return S.weighted_pairs(degree("a"), degree("b"), tested, 300)


@query("""WITH s AS (SELECT l_partkey, l_suppkey, l_returnflag, l_quantity, CASE WHEN l_linenumber = 6 THEN -1 ELSE 1 END AS g FROM lineitem)
 SELECT l_partkey, l_suppkey, CAST(sum(g) AS BIGINT) AS n, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,4)) * g) AS DOUBLE), 4) AS total, CASE WHEN sum(CASE WHEN l_returnflag = 'A' THEN g ELSE 0 END) > 0 THEN 'A' WHEN sum(CASE WHEN l_returnflag = 'N' THEN g ELSE 0 END) > 0 THEN 'N' WHEN sum(CASE WHEN l_returnflag = 'R' THEN g ELSE 0 END) > 0 THEN 'R' END AS best_tier
 FROM s GROUP BY 1, 2 HAVING sum(g) > 0""")
def incremental_pair_rollup(spark, d):
    """Pairs by merging three batches, one of them twice, into a bucketed table; sixth lines are withdrawals."""
    import uuid

    from nadir.operators.steps import shared_dir
    from nadir.streaming.merge import PairRollup

    rows = lines(spark, d).select("l_orderkey", F.col("l_partkey").cast("long").alias("l_partkey"), F.col("l_suppkey").cast("long").alias("l_suppkey"), "l_returnflag", "l_quantity", "l_linenumber")
    roll = PairRollup(spark, f"{shared_dir(spark)}/nadir-rollup-{uuid.uuid4().hex[:12]}", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", ["A", "N", "R"], buckets=8)
    for batch in (0, 1, 2, 1):
        roll.apply(rows.where(F.col("l_orderkey") % 3 == batch), F.col("l_linenumber") == 6, batch, partitions=pair_partitions(spark, d))
    return roll.read().withColumn("total", F.round(F.col("total").cast("double"), 4))
