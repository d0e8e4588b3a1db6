"""The registered queries of the library and their SQL for an independent engine.

The driver's tables stand in for the domain's: line items are evidence, parts
and suppliers the two kinds of entity, return flags tiers, orders studies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nadir.functions import columns as C
from nadir.operators import evidence as E
from nadir.operators import metrics as M
from nadir.operators import pairs as P
from nadir.operators import posttrain as R
from nadir.operators import quality as Q
from nadir.operators import sampling as S
from nadir.operators import splits as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

T = lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            # count_if gives a huge integer there, count a long as here
            _SQL[f.__name__] = " ".join(sql.split()).replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- shared pieces -----------------------------------------------------------



def tier_column() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "gold").when(flag == "N", "silver").when(flag == "R", "bronze")


TIER_SQL = "CASE l_returnflag WHEN 'A' THEN 'gold' WHEN 'N' THEN 'silver' WHEN 'R' THEN 'bronze' END"
BEST_SQL = f"CASE min(CASE {TIER_SQL} WHEN 'gold' THEN 1 WHEN 'silver' THEN 2 WHEN 'bronze' THEN 3 END) WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END"


def study_column() -> Column:
    return F.nullif("l_linenumber", F.lit(7))


def zip_column() -> Column:
    return F.round((F.col("l_discount") - 0.05) * 400, 6)


ZIP_SQL = "round((l_discount - 0.05) * 400, 6)"
SYN_SQL = "CASE WHEN {z} > 10 THEN 'strongly_synergistic' WHEN {z} > 5 THEN 'synergistic' WHEN {z} >= -5 THEN 'additive' WHEN {z} >= -10 THEN 'antagonistic' WHEN {z} IS NOT NULL THEN 'strongly_antagonistic' END"


def md5_sql(seed: int, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) + "))"


def cut_sql(rank: str, total: str, ratios=X.DEFAULT) -> str:
    train = f"CAST(floor({total} * CAST({ratios[0]} AS DOUBLE)) AS BIGINT)"
    return f"CASE WHEN {rank} <= {train} THEN 'train' WHEN {rank} <= {train} + CAST(floor({total} * CAST({ratios[1]} AS DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "lineitem")


def part_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs with their degrees."""
    return P.rollup(lines(spark, d), P.PairSpec("l_partkey", "l_suppkey", {"n": F.count("*")}), pair_partitions(spark, d))


PS_SQL = """WITH p AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
 ps AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS a_degree, count(*) OVER (PARTITION BY l_suppkey) AS b_degree FROM p)"""
EVIDENCE_PAIR = ("l_orderkey", "l_linenumber")

# --- pair tables -------------------------------------------------------------


@query(f"""SELECT l_partkey, l_suppkey, count(DISTINCT coalesce(nullif(l_linenumber, 7), -1)) AS num_studies, count(DISTINCT l_linestatus) AS num_sources, {BEST_SQL} AS best_tier,
 CASE WHEN bool_or(l_linenumber = 1) THEN 'hard' WHEN bool_or(l_linenumber = 2) THEN 'conditional' WHEN bool_or(l_linenumber = 3) THEN 'methodological' ELSE 'hypothesis' END AS best_result,
 CAST(min(year(l_shipdate)) AS INTEGER) AS earliest_year, round(avg(l_quantity), 6) AS avg_value, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value,
 count(*) OVER (PARTITION BY l_partkey) AS a_degree, count(*) OVER (PARTITION BY l_suppkey) AS b_degree FROM lineitem GROUP BY l_partkey, l_suppkey""")
def pair_rollup_basic(spark, d):
    n = F.col("l_linenumber")
    return P.rollup(lines(spark, d), P.PairSpec("l_partkey", "l_suppkey", {
        "num_studies": C.study_count(study_column()), "num_sources": C.source_count("l_linestatus"), "best_tier": C.best_of(tier_column()),
        "best_result": C.any_precedence([(n == 1, "hard"), (n == 2, "conditional"), (n == 3, "methodological")], "hypothesis"),
        "earliest_year": F.min(F.year("l_shipdate")), "avg_value": F.round(F.avg("l_quantity"), 6), "min_value": F.min("l_extendedprice"), "max_value": F.max("l_extendedprice"),
    }), pair_partitions(spark, d))


@query("""WITH c AS (SELECT l_partkey, l_suppkey, l_linestatus || l_returnflag AS cat, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
 m AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY n DESC, cat) AS r FROM c),
 p AS (SELECT l_partkey, l_suppkey, count(DISTINCT nullif(l_linenumber, 7)) AS num_trials, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 END) WHEN 3 THEN '1-URGENT' WHEN 2 THEN '2-HIGH' WHEN 1 THEN '3-MEDIUM' END AS highest_phase
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
 SELECT p.l_partkey, p.l_suppkey, num_trials, highest_phase, cat AS primary_category FROM p JOIN m ON p.l_partkey = m.l_partkey AND p.l_suppkey = m.l_suppkey AND r = 1""")
def pair_rollup_mode_phase(spark, d):
    rows = lines(spark, d).join(T(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spec = P.PairSpec("l_partkey", "l_suppkey", {"num_trials": C.study_count(study_column(), null_is_study=False), "highest_phase": C.highest_of(F.col("o_orderpriority"), ("3-MEDIUM", "2-HIGH", "1-URGENT"))}, degrees=None)
    mode = P.mode_per_group(lines(spark, d).withColumn("cat", F.concat("l_linestatus", "l_returnflag")), ["l_partkey", "l_suppkey"], "cat", "primary_category")
    return P.rollup(rows, spec).join(mode, ["l_partkey", "l_suppkey"])


def pair_partitions(spark, d):
    """Partitions for pairs of lines: their number grows with the lines, so that a task's share doesn't."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines(spark, d).count() // 400_000))


def supplier_pairs(spark, d):
    parts = pair_partitions(spark, d)
    a = lines(spark, d).select("l_orderkey", F.col("l_suppkey").alias("s1"), F.col("l_quantity").alias("q"))
    b = lines(spark, d).select("l_orderkey", F.col("l_suppkey").alias("s2"))
    return a.repartition(parts, "l_orderkey").join(b.repartition(parts, "l_orderkey"), "l_orderkey").where("s1 < s2")


def linked_suppliers(spark, d):
    """Distinct pairs of suppliers; few come twice in a task, so they are shuffled before they are made distinct."""
    return supplier_pairs(spark, d).select("s1", "s2").repartition(pair_partitions(spark, d), "s1", "s2").distinct()


SUP_SQL = "sp AS (SELECT a.l_orderkey, a.l_suppkey AS s1, b.l_suppkey AS s2, a.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey)"


@query(f"""WITH {SUP_SQL}, p AS (SELECT s1, s2, count(DISTINCT l_orderkey) AS num_experiments, min(q) AS min_score, max(q) AS max_score FROM sp GROUP BY 1, 2),
 g AS (SELECT e, count(DISTINCT o) AS deg FROM (SELECT s1 AS e, s2 AS o FROM p UNION ALL SELECT s2, s1 FROM p) GROUP BY 1)
 SELECT p.*, x.deg AS a_degree, y.deg AS b_degree FROM p JOIN g x ON s1 = x.e JOIN g y ON s2 = y.e""")
def pair_rollup_symmetric(spark, d):
    return P.rollup(supplier_pairs(spark, d), P.PairSpec("s1", "s2", {"num_experiments": F.countDistinct("l_orderkey"), "min_score": F.min("q"), "max_score": F.max("q")}, symmetric=True), pair_partitions(spark, d))


@query(f"""SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS num_screens, {BEST_SQL} AS best_tier, min(l_discount) AS min_effect, max(l_discount) AS max_effect, round(avg(l_discount), 6) AS avg_effect FROM lineitem GROUP BY 1, 2""")
def pair_rollup_effect(spark, d):
    spec = P.PairSpec("l_partkey", "l_suppkey", {"num_screens": F.countDistinct("l_orderkey"), "best_tier": C.best_of(tier_column(), C.TIERS[:3]), "min_effect": F.min("l_discount"), "max_effect": F.max("l_discount"), "avg_effect": F.round(F.avg("l_discount"), 6)}, degrees=None)
    return P.rollup(lines(spark, d), spec, pair_partitions(spark, d))


@query("""SELECT l_partkey, l_suppkey, count(*) AS num_submissions, count(DISTINCT o_custkey) AS num_submitters, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_conflict, max(l_tax) AS max_frequency
 FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' GROUP BY 1, 2""")
def pair_rollup_conflict(spark, d):
    done = T(spark, d, "orders").where("o_orderstatus = 'F'")
    rows = lines(spark, d).join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    spec = P.PairSpec("l_partkey", "l_suppkey", {"num_submissions": F.count("*"), "num_submitters": F.countDistinct("o_custkey"), "has_conflict": F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), "max_frequency": F.max("l_tax")}, degrees=None)
    return P.rollup(rows, spec, pair_partitions(spark, d))


_share = lambda k: f"avg(CASE WHEN {k} THEN 1.0 ELSE 0.0 END)"
_ANT, _SYN, _ADD = "k IN ('antagonistic', 'strongly_antagonistic')", "k IN ('synergistic', 'strongly_synergistic')", "k = 'additive'"
CONSENSUS_SQL = f"CASE WHEN {_share(_ANT)} > 0.5 THEN 'antagonistic' WHEN {_share(_SYN)} > 0.5 THEN 'synergistic' WHEN {_share(_ADD)} > 0.5 THEN 'additive' ELSE 'context_dependent' END"


@query(f"""WITH e AS (SELECT *, {SYN_SQL.format(z=ZIP_SQL)} AS k FROM lineitem)
 SELECT l_partkey, l_suppkey, count(*) AS num_measurements, round(avg({ZIP_SQL}), 6) AS avg_zip, round({_share(_ANT)}, 6) AS antagonism_fraction, round({_share(_SYN)}, 6) AS synergy_fraction, {CONSENSUS_SQL} AS consensus_class FROM e GROUP BY 1, 2""")
def pair_rollup_synergy(spark, d):
    rows = lines(spark, d).withColumn("z", zip_column()).withColumn("k", C.synergy_class(F.col("z")))
    k = F.col("k")
    spec = P.PairSpec("l_partkey", "l_suppkey", {"num_measurements": F.count("*"), "avg_zip": F.round(F.avg("z"), 6), "antagonism_fraction": F.round(C.fraction(k.isin("antagonistic", "strongly_antagonistic")), 6), "synergy_fraction": F.round(C.fraction(k.isin("synergistic", "strongly_synergistic")), 6), "consensus_class": C.consensus_class(k)}, degrees=None)
    return P.rollup(rows, spec, pair_partitions(spark, d))


@query(f"""WITH t AS (SELECT l_partkey, l_suppkey, c_nationkey, round(avg({ZIP_SQL}), 6) AS avg_zip, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
 SELECT *, {SYN_SQL.format(z='avg_zip')} AS synergy_class FROM t""")
def triple_rollup(spark, d):
    rows = lines(spark, d).join(T(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy("l_partkey", "l_suppkey", "c_nationkey").agg(F.round(F.avg(zip_column()), 6).alias("avg_zip"), F.count("*").alias("n"))
    return out.withColumn("synergy_class", C.synergy_class(F.col("avg_zip")))


@query(f"""WITH {SUP_SQL}, p AS (SELECT DISTINCT s1, s2 FROM sp), i AS (SELECT DISTINCT l_suppkey AS e, l_partkey % 50 AS g FROM lineitem), n AS (SELECT e, count(*) AS n FROM i GROUP BY 1),
 s AS (SELECT s1, s2, count(*) AS shared FROM p JOIN i x ON s1 = x.e JOIN i y ON s2 = y.e AND x.g = y.g GROUP BY 1, 2)
 SELECT p.s1, p.s2, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / nullif(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(shared, 0), 0), 6) AS jaccard FROM p LEFT JOIN n a ON s1 = a.e LEFT JOIN n b ON s2 = b.e LEFT JOIN s ON s.s1 = p.s1 AND s.s2 = p.s2""")
def target_jaccard(spark, d):
    items = lines(spark, d).select(F.col("l_suppkey").alias("e"), (F.col("l_partkey") % 50).alias("g"))
    return P.partner_jaccard(linked_suppliers(spark, d), items, "s1", "s2", "e", "g").withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {SUP_SQL} SELECT e AS entity, count(DISTINCT o) AS degree FROM (SELECT s1 AS e, s2 AS o FROM sp UNION ALL SELECT s2, s1 FROM sp) GROUP BY 1")
def degree_two_sided(spark, d):
    return P.two_sided_degree(supplier_pairs(spark, d), "s1", "s2", pair_partitions(spark, d))


# --- filters and joins -------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, {TIER_SQL} AS tier FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def tier_floor_filter(spark, d):
    tier = tier_column()
    return lines(spark, d).where(C.rank_of(tier, C.TIERS) <= 2).select("l_orderkey", "l_linenumber", tier.alias("tier"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 10 END AS p, CASE l_linenumber WHEN 1 THEN '>' WHEN 3 THEN '>=' ELSE '=' END AS rel, l_extendedprice AS v, CASE WHEN l_tax > 0.02 THEN 'nM' ELSE 'uM' END AS u FROM lineitem),
 b AS (SELECT l_orderkey, l_linenumber, CASE WHEN p IS NOT NULL AND p < 4.5 THEN 'quantitative' WHEN p IS NULL AND rel IN ('>', '>=') AND v >= 10000 AND u = 'nM' THEN 'right_censored' END AS branch FROM e) SELECT * FROM b WHERE branch IS NOT NULL""")
def censored_predicate(spark, d):
    n = F.col("l_linenumber")
    p, rel = F.when(n % 2 == 0, F.col("l_quantity") / 10), F.when(n == 1, ">").when(n == 3, ">=").otherwise("=")
    branch = C.inactive_branch(p, rel, F.col("l_extendedprice"), F.when(F.col("l_tax") > 0.02, "nM").otherwise("uM"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", branch.alias("branch")).where("branch is not null")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'Ki' WHEN l_extendedprice / 1000 >= 40 THEN 'IC50' WHEN l_tax * 1000 > 40 THEN 'EC50' END AS metric, CASE WHEN l_quantity > 40 THEN l_quantity WHEN l_extendedprice / 1000 >= 40 THEN l_extendedprice / 1000 WHEN l_tax * 1000 > 40 THEN l_tax * 1000 END AS value FROM lineitem""")
def first_qualifying_metric(spark, d):
    got = C.first_qualifying([("Ki", F.lit("="), F.col("l_quantity")), ("IC50", F.lit(">"), F.col("l_extendedprice") / 1000), ("EC50", F.lit("="), F.col("l_tax") * 1000)], 40)
    return lines(spark, d).select("l_orderkey", "l_linenumber", got.alias("g")).select("l_orderkey", "l_linenumber", F.col("g.name").alias("metric"), F.col("g.value").alias("value"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '5-LOW' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def human_fallback_filter(spark, d):
    known = T(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(True).alias("known"))
    joined = T(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.where((F.col("o_orderpriority") == "1-URGENT") | ((F.col("o_orderpriority") == "5-LOW") & F.col("known"))).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, p_brand, s_name, n_name, l_quantity, 0 AS y FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'""")
def star_export(spark, d):
    rows = lines(spark, d).where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))
    return rows.join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(T(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(T(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "p_brand", "s_name", "n_name", "l_quantity", F.lit(0).alias("y"))


@query(f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {md5_sql(42, 'o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
 SELECT o.o_orderkey, {cut_sql('r', 'n')} AS random, CASE WHEN year(o_orderdate) < 1995 THEN 'train' WHEN year(o_orderdate) < 1997 THEN 'val' ELSE 'test' END AS temporal FROM orders o JOIN r ON o.o_orderkey = r.o_orderkey""")
def split_pivot_export(spark, d):
    base = T(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    both = X.random_split(base, ["o_orderkey"]).select("o_orderkey", F.lit("random").alias("strategy"), "fold").unionByName(X.temporal(base, "y", 1995, 1997).select("o_orderkey", F.lit("temporal").alias("strategy"), "fold"))
    return X.pivot_folds(both, "o_orderkey", ["random", "temporal"])


@query(f"WITH {SUP_SQL} SELECT DISTINCT s1, s2, a.s_name AS name_a, b.s_name AS name_b FROM sp JOIN supplier a ON s1 = a.s_suppkey JOIN supplier b ON s2 = b.s_suppkey")
def double_dim_join(spark, d):
    s = T(spark, d, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("s1"), F.col("s_name").alias("name_a")), s.select(F.col("s_suppkey").alias("s2"), F.col("s_name").alias("name_b"))
    return linked_suppliers(spark, d).join(a, "s1").join(b, "s2").select("s1", "s2", "name_a", "name_b")


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN c THEN 'silver' ELSE tier END AS tier, CASE WHEN c THEN 1 ELSE 0 END AS upgraded FROM (SELECT e.*, {TIER_SQL} AS tier, l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = e.l_partkey AND x.l_suppkey = e.l_suppkey AND x.l_linestatus <> e.l_linestatus AND x.l_quantity > 20) AS c FROM lineitem e)""")
def self_concordance_upgrade(spark, d):
    rows = lines(spark, d).withColumn("tier", tier_column())
    return E.concordance_upgrade(rows, ["l_partkey", "l_suppkey"], "l_linestatus", "tier", F.col("l_returnflag") == "R", F.col("l_quantity") > 20).select("l_orderkey", "l_linenumber", "tier", "upgraded")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_has_result(spark, d):
    return T(spark, d, "orders").join(lines(spark, d).where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_excluded_source(spark, d):
    return T(spark, d, "orders").join(lines(spark, d).where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT c_custkey, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_suppkey = c_custkey), (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey)) AS resolved FROM customer""")
def fallback_key_join(spark, d):
    return E.fallback_join(T(spark, d, "customer").select("c_custkey", "c_nationkey"), T(spark, d, "supplier"), [("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey")], "s_suppkey", "resolved").select("c_custkey", "resolved")


@query("""WITH q AS (SELECT DISTINCT substr(n_name, 1, length(n_name) - 1) AS q FROM nation), s AS (SELECT q AS query, n_name AS match, jaro_winkler_similarity(q, n_name) AS s FROM q JOIN nation ON abs(length(q) - length(n_name)) <= 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, match) AS r FROM s WHERE s >= 0.9) SELECT query, match, round(s, 6) AS similarity FROM r WHERE r = 1""")
def fuzzy_match(spark, d):
    n = T(spark, d, "nation").select("n_name")
    q = n.select(F.expr("substr(n_name, 1, length(n_name) - 1)").alias("q"))
    return E.fuzzy_match(q, "q", n, "n_name").withColumn("similarity", F.round("similarity", 6))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN n_nationkey WHEN n_nationkey < 15 THEN n_nationkey + 100 END AS resolved, CASE WHEN n_nationkey < 5 THEN 'exact' WHEN n_nationkey < 15 THEN 'cache' END AS stage FROM nation")
def staged_resolution(spark, d):
    n = T(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    exact, cache = n.where("k < 5").select(F.col("k").alias("name"), F.col("k").alias("id")), n.where("k < 15").select(F.col("k").alias("name"), (F.col("k") + 100).alias("id"))
    return E.staged_lookup(n, "k", [("exact", exact), ("cache", cache)])


@query("SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier")
def union_distinct_ids(spark, d):
    return lines(spark, d).select(F.col("l_suppkey").alias("k")).union(T(spark, d, "supplier").select("s_suppkey")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_keys(spark, d):
    return T(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(T(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_tested(spark, d):
    return T(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(T(spark, d, "orders").select("o_custkey"))


@query("SELECT l_suppkey AS e, count(*) AS n FROM (SELECT l_suppkey FROM lineitem UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1")
def union_all_degree(spark, d):
    return lines(spark, d).select(F.col("l_suppkey").alias("e")).unionAll(T(spark, d, "supplier").select("s_suppkey")).groupBy("e").agg(F.count("*").alias("n"))


# --- aggregates and windows --------------------------------------------------


@query("SELECT o_custkey, category FROM (SELECT o_custkey, o_orderpriority AS category, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def mode_category(spark, d):
    return P.mode_per_group(T(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "category")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def argmin_per_group(spark, d):
    best = lines(spark, d).groupBy("l_orderkey").agg(F.min(F.struct("l_quantity", "l_linenumber")).alias("b"))
    return best.select("l_orderkey", "b.l_linenumber", "b.l_quantity")


@query("SELECT l_partkey, l_suppkey AS primary_b, n FROM (SELECT l_partkey, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def argmax_primary(spark, d):
    n = lines(spark, d).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    best = n.groupBy("l_partkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "l_suppkey")).alias("b"))
    return best.select("l_partkey", F.col("b.l_suppkey").alias("primary_b"), (-F.col("b.m")).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def rank_tuple_best(spark, d):
    pr = F.col("o_orderpriority")
    rank = F.struct(F.when(pr == "1-URGENT", 1).when(pr == "2-HIGH", 2).otherwise(3).alias("a"), (-F.col("o_totalprice")).alias("b"), "o_orderkey")
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.min(rank).alias("r")).select("o_custkey", "r.o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def dedup_first(spark, d):
    return P.first_per_group(T(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH u AS (SELECT o_custkey AS k, o_orderkey AS v, 0 AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F') SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, v) AS r FROM u) WHERE r = 1""")
def upsert_last_wins(spark, d):
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    return E.last_writer_wins(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), ["k"], ["v"]).select("k", "v")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k)""")
def upsert_first_wins(spark, d):
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    return E.first_writer_wins(o.where("o_orderstatus = 'F'").select("k", "v"), o.where("o_orderstatus <> 'F'").select("k", "v"), ["k"], ["v"])


@query("SELECT l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1")
def percent_of_total(spark, d):
    return Q.percent_of_total(lines(spark, d), "l_returnflag").withColumn("percent", F.round("percent", 6))


@query("SELECT l_linestatus, count(*) AS n, round(count(a) / count(*), 6) AS a_filled, round(count(b) / count(*), 6) AS b_filled FROM (SELECT l_linestatus, nullif(l_linenumber, 1) AS a, CASE WHEN l_tax > 0.04 THEN l_tax END AS b FROM lineitem) GROUP BY 1")
def completeness_profile(spark, d):
    rows = lines(spark, d).select("l_linestatus", F.nullif("l_linenumber", F.lit(1)).alias("a"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("b"))
    return Q.completeness(rows, ["l_linestatus"], ["a", "b"]).withColumns({c: F.round(c, 6) for c in ("a_filled", "b_filled")})


@query("SELECT l_linestatus, count_if(l_returnflag = 'A') AS \"A\", count_if(l_returnflag = 'N') AS \"N\", count_if(l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def crosstab_fold(spark, d):
    return Q.crosstab(lines(spark, d), "l_linestatus", "l_returnflag", ["A", "N", "R"])


@query("SELECT o_custkey, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, count(*) AS n FROM orders GROUP BY 1 HAVING min(year(o_orderdate)) BETWEEN 1990 AND 1994")
def having_year(spark, d):
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first_year"), F.count("*").alias("n")).where(F.col("first_year").between(1990, 1994))


@query("SELECT event_type, count(DISTINCT user_id) AS n_seeds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(stddev_pop(value), 6) AS std_pop FROM events GROUP BY 1")
def seed_summary(spark, d):
    return M.run_summary(T(spark, d, "events"), ["event_type"], "user_id", "value").withColumns({c: F.round(c, 6) for c in ("mean", "std", "std_pop")})


@query("SELECT l_partkey, CASE WHEN count(*) = 1 THEN 0.0 ELSE round(stddev_samp(l_quantity), 6) END AS std FROM lineitem GROUP BY 1")
def std_or_zero(spark, d):
    return lines(spark, d).groupBy("l_partkey").agg(F.round(C.std_or_zero(F.col("l_quantity")), 6).alias("std"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def topk_entities(spark, d):
    return lines(spark, d).groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query(f"SELECT {TIER_SQL} AS tier, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY CASE {TIER_SQL} WHEN 'gold' THEN 1 WHEN 'silver' THEN 2 WHEN 'bronze' THEN 3 END")
def order_by_rank_case(spark, d):
    return lines(spark, d).groupBy(tier_column().alias("tier")).agg(F.count("*").alias("n")).orderBy(C.rank_of(F.col("tier"), C.TIERS))


@query(f"SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {md5_sql(42, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 5")
def cap_per_entity(spark, d):
    return S.capped(lines(spark, d), "l_suppkey", EVIDENCE_PAIR, 5).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""WITH e AS (SELECT list_distinct(quantile_cont(CAST(l_quantity AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS q, quantile_cont(CAST(l_quantity AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS i FROM lineitem)
 SELECT l_orderkey, l_linenumber, CAST(len(list_filter(i, lambda x: x < l_quantity)) AS INTEGER) AS bin FROM lineitem, e""")
def qcut_bins(spark, d):
    return X.quantile_bins(lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 5).select("l_orderkey", "l_linenumber", F.col("bin").cast("int").alias("bin"))


@query(f"{PS_SQL} SELECT l_partkey, l_suppkey, CAST(floor(log2(greatest(a_degree, 1))) AS INTEGER) AS a_bin, CAST(floor(log2(greatest(b_degree, 1))) AS INTEGER) AS b_bin FROM ps")
def log2_bins(spark, d):
    return part_supplier(spark, d).select("l_partkey", "l_suppkey", S.log2_bin(F.col("a_degree")).alias("a_bin"), S.log2_bin(F.col("b_degree")).alias("b_bin"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, d):
    return lines(spark, d).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))


@query("SELECT l_suppkey, list_aggregate(list_sort(list(DISTINCT l_returnflag)), 'string_agg', ',') AS flags FROM lineitem GROUP BY 1")
def collect_per_group(spark, d):
    return lines(spark, d).groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


# --- splits ------------------------------------------------------------------

RANK_SQL = "row_number() OVER ({by}ORDER BY {md5}, {keys})"


@query(f"SELECT o_orderkey, {cut_sql('r', 'n')} AS fold FROM (SELECT o_orderkey, {RANK_SQL.format(by='', md5=md5_sql(42, 'o_orderkey'), keys='o_orderkey')} AS r, count(*) OVER () AS n FROM orders)")
def split_random(spark, d):
    return X.random_split(T(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query(f"SELECT o_orderkey, o_orderpriority, {cut_sql('r', 'n')} AS fold FROM (SELECT o_orderkey, o_orderpriority, {RANK_SQL.format(by='PARTITION BY o_orderpriority ', md5=md5_sql(42, 'o_orderkey'), keys='o_orderkey')} AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)")
def split_random_stratified(spark, d):
    return X.random_split(T(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], by=["o_orderpriority"])


ENTITY_SQL = "(SELECT e, " + cut_sql("r", "n") + " AS fold FROM (SELECT e, row_number() OVER (ORDER BY {md5}, e) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {c} AS e FROM {t} WHERE {c} IS NOT NULL)))"


@query(f"SELECT o_orderkey, fold FROM orders JOIN {ENTITY_SQL.format(md5=md5_sql(42, 'e'), c='o_custkey', t='orders')} ON e = o_custkey")
def split_cold_entity(spark, d):
    return X.cold_entity(T(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "fold")


@query(f"""WITH g AS (SELECT o_custkey AS e, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT e, n, coalesce(sum(n) OVER (ORDER BY {md5_sql(42, 'e')}, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM g),
 v AS (SELECT sum(n) AS tr FROM f WHERE b < t * CAST(0.7 AS DOUBLE)) SELECT o_orderkey, CASE WHEN b < t * CAST(0.7 AS DOUBLE) THEN 'train' WHEN b - tr < t * CAST(0.1 AS DOUBLE) THEN 'val' ELSE 'test' END AS fold FROM orders JOIN f ON e = o_custkey, v""")
def split_cold_greedy(spark, d):
    return X.cold_greedy(T(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "fold")


_RANK_FOLD = "CASE {f} WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"


@query(f"""SELECT l_orderkey, l_linenumber, CASE greatest({_RANK_FOLD.format(f='a.fold')}, {_RANK_FOLD.format(f='b.fold')}) WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS fold FROM lineitem
 JOIN {ENTITY_SQL.format(md5=md5_sql(42, 'e'), c='l_partkey', t='lineitem')} a ON a.e = l_partkey JOIN {ENTITY_SQL.format(md5=md5_sql(43, 'e'), c='l_suppkey', t='lineitem')} b ON b.e = l_suppkey""")
def split_max_rank(spark, d):
    return X.max_rank(lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "fold")


def _part_fold(c: str) -> str:
    p = f"(CAST('0x' || substr(md5(concat_ws(':', '42', CAST({c} AS VARCHAR))), 1, 4) AS INTEGER) % 10)"
    return f"CASE WHEN {p} < 7 THEN 0 WHEN {p} < 8 THEN 1 ELSE 2 END"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN CASE a WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END END AS fold FROM (SELECT l_orderkey, l_linenumber, {_part_fold('l_partkey')} AS a, {_part_fold('l_suppkey')} AS b FROM lineitem)")
def split_cold_both_exclude(spark, d):
    return X.partition_both(lines(spark, d), "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "fold")


@query("SELECT o_orderkey, CASE WHEN y IS NULL OR y < 1995 THEN 'train' WHEN y < 1997 THEN 'val' ELSE 'test' END AS fold FROM (SELECT o_orderkey, nullif(year(o_orderdate), 1996) AS y FROM orders)")
def split_temporal(spark, d):
    return X.temporal(T(spark, d, "orders").select("o_orderkey", F.nullif(F.year("o_orderdate"), F.lit(1996)).alias("y")), "y", 1995, 1997).select("o_orderkey", "fold")


@query("""WITH g AS (SELECT p_brand AS f, count(*) AS n FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1), c AS (SELECT f, coalesce(sum(n) OVER (ORDER BY n DESC, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM g)
 SELECT p_partkey, CASE WHEN b IS NULL THEN NULL WHEN b < t * CAST(0.7 AS DOUBLE) THEN 'train' WHEN b < t * CAST(0.7999999999999999 AS DOUBLE) THEN 'val' ELSE 'test' END AS fold FROM part LEFT JOIN c ON f = p_brand""")
def split_running_total(spark, d):
    rows = T(spark, d, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("family"))
    return X.running_total(rows, "family").select("p_partkey", "fold")


@query(f"""{PS_SQL}, m AS (SELECT max(ln(1 + a_degree)) AS ma, max(ln(1 + b_degree)) AS mb FROM ps), c AS (SELECT l_partkey, l_suppkey, CAST(floor(ln(1 + a_degree) / (ma + 1e-9) * 5) AS INTEGER) AS a_bin, CAST(floor(ln(1 + b_degree) / (mb + 1e-9) * 5) AS INTEGER) AS b_bin FROM ps, m),
 r AS (SELECT *, row_number() OVER (PARTITION BY a_bin, b_bin ORDER BY {md5_sql(42, 'l_partkey', 'l_suppkey')}, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY a_bin, b_bin) AS n FROM c) SELECT l_partkey, l_suppkey, a_bin, b_bin, {cut_sql('r', 'n')} AS fold FROM r""")
def split_degree_2d(spark, d):
    return X.degree_grid(part_supplier(spark, d), ["l_partkey", "l_suppkey"], "a_degree", "b_degree").select("l_partkey", "l_suppkey", "a_bin", "b_bin", "fold")


@query(f"""{PS_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(CAST(a_degree AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM ps), b AS (SELECT l_partkey, l_suppkey, len(list_filter(list_slice(q, 2, -2), lambda x: x < a_degree)) AS bin FROM ps, e),
 r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {md5_sql(42, 'l_partkey', 'l_suppkey')}, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY bin) AS n FROM b) SELECT l_partkey, l_suppkey, CAST(bin AS INTEGER) AS bin, {cut_sql('r', 'n')} AS fold FROM r""")
def split_degree_quantile(spark, d):
    return X.degree_quantile(part_supplier(spark, d), ["l_partkey", "l_suppkey"], "a_degree").select("l_partkey", "l_suppkey", F.col("bin").cast("int").alias("bin"), "fold")


@query(f"""WITH h AS (SELECT c_mktsegment AS held FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), r AS (SELECT c_custkey, c_mktsegment = held AS t, row_number() OVER (PARTITION BY c_mktsegment = held ORDER BY {md5_sql(42, 'c_custkey')}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment = held) AS n FROM customer, h)
 SELECT c_custkey, CASE WHEN t THEN 'test' WHEN r <= greatest(1, floor(n * CAST(0.1 AS DOUBLE))) THEN 'val' ELSE 'train' END AS fold FROM r""")
def split_leave_one_out(spark, d):
    return X.leave_one_group_out(T(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], "c_mktsegment").select("c_custkey", "fold")


@query(f"""SELECT o_orderkey, o_orderpriority, CASE WHEN r <= 5 THEN 'fewshot' WHEN r <= 15 THEN 'val' ELSE 'test' END AS fold FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {md5_sql(42, 'o_orderkey')}, o_orderkey) AS r FROM orders) WHERE r <= 65""")
def split_llm(spark, d):
    return X.few_shot(T(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 5, 10, 50, ["o_orderpriority"])


# --- samples and data sets ---------------------------------------------------

CONFLICT_SQL = "pos AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), neg AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')"


def _sides(spark, d):
    rows = lines(spark, d)
    return tuple(rows.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey").distinct() for f in "AN")


@query(f"WITH {CONFLICT_SQL} SELECT *, 1 AS label FROM (SELECT * FROM pos EXCEPT SELECT * FROM neg) UNION ALL SELECT *, 0 FROM (SELECT * FROM neg EXCEPT SELECT * FROM pos)")
def conflict_free_merge(spark, d):
    pos, neg = S.conflict_free(*_sides(spark, d), ["l_partkey", "l_suppkey"])
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def _first(table: str, n: str, label: int) -> str:
    return f"SELECT l_partkey, l_suppkey, {label} AS label FROM (SELECT *, row_number() OVER (ORDER BY {md5_sql(42, 'l_partkey', 'l_suppkey')}, l_partkey, l_suppkey) AS r FROM {table}), k WHERE r <= {n}"


def _sample_sql(ratio: int) -> str:
    return f"WITH {CONFLICT_SQL}, k AS (SELECT least((SELECT count(*) FROM pos), (SELECT count(*) FROM neg) // {ratio}) AS k) {_first('pos', 'k', 1)} UNION ALL {_first('neg', f'k * {ratio}', 0)}"


@query(_sample_sql(1))
def balanced_sample(spark, d):
    return S.balanced(*_sides(spark, d), ["l_partkey", "l_suppkey"])


@query(_sample_sql(10))
def realistic_sample(spark, d):
    return S.balanced(*_sides(spark, d), ["l_partkey", "l_suppkey"], 10)


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem")
def three_class(spark, d):
    rows = lines(spark, d)
    return rows.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.lit(0).alias("label")).unionByName(rows.where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", F.lit(1).alias("label"))).unionByName(rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.lit(2).alias("label")))


@query("SELECT l_partkey, count_if(l_returnflag = 'A') AS n_active, count_if(l_returnflag = 'R') AS n_inactive FROM lineitem GROUP BY 1 HAVING count_if(l_returnflag = 'A') >= 1 AND count_if(l_returnflag = 'R') >= 1")
def conditional_entities(spark, d):
    return lines(spark, d).groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("n_active"), F.count_if(F.col("l_returnflag") == "R").alias("n_inactive")).where("n_active >= 1 and n_inactive >= 1")


@query(f"""{PS_SQL}, b AS (SELECT *, CAST(floor(log2(greatest(a_degree, 1))) AS INTEGER) AS bin FROM ps), tgt AS (SELECT bin, count(*) AS n FROM b WHERE l_partkey % 10 = 0 GROUP BY 1), q AS (SELECT bin, n, CAST(floor(300 * n / sum(n) OVER ()) AS BIGINT) AS q, row_number() OVER (ORDER BY n DESC, bin) AS r FROM tgt),
 z AS (SELECT bin, q + CASE WHEN r <= 300 - (SELECT sum(q) FROM q) THEN 1 ELSE 0 END AS q FROM q), pool AS (SELECT l_partkey, l_suppkey, bin, row_number() OVER (PARTITION BY bin ORDER BY {md5_sql(42, 'l_partkey', 'l_suppkey')}, l_partkey, l_suppkey) AS r FROM b WHERE l_partkey % 10 <> 0)
 SELECT l_partkey, l_suppkey, pool.bin FROM pool JOIN z ON pool.bin = z.bin WHERE r <= z.q""")
def degree_matched_quota(spark, d):
    rows = part_supplier(spark, d).withColumn("bin", S.log2_bin(F.col("a_degree")))
    return S.quota_matched(rows.where("l_partkey % 10 = 0"), rows.where("l_partkey % 10 <> 0"), "bin", 300, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "bin")


@query(f"""SELECT l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey, -ln((CAST('0x' || substr({md5_sql(42, 'l_partkey', 'l_suppkey')}, 1, 12) AS BIGINT) + 1) / CAST(281474976710656 AS DOUBLE)) / n AS k FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) ORDER BY k, l_partkey, l_suppkey LIMIT 200""")
def weighted_sample(spark, d):
    return S.weighted(lines(spark, d).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")), F.col("n"), ["l_partkey", "l_suppkey"], 200).select("l_partkey", "l_suppkey")


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 0 WHEN o_totalprice > 200000 THEN 1 WHEN o_totalprice > 100000 THEN 2 END AS lv FROM orders), c AS (SELECT lv, sum(count(*)) OVER (ORDER BY lv) AS s FROM t WHERE lv IS NOT NULL GROUP BY 1), m AS (SELECT coalesce(min(lv), 2) AS lv FROM c WHERE s >= 5000)
 SELECT o_orderkey, t.lv AS relax_level FROM t, m WHERE t.lv <= m.lv""")
def relaxation_cascade(spark, d):
    p = F.col("o_totalprice")
    return S.relaxed(T(spark, d, "orders"), [p > 300000, p > 200000, p > 100000], 5000).select("o_orderkey", "relax_level")


# --- metrics -----------------------------------------------------------------


def scored(spark, d):
    """Labels with a score that has ties: the text's length in hundreds."""
    docs = T(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).cast("double").alias("score"), "lang", "source")
    return T(spark, d, "labels").join(docs, "doc_id")


SCORED_SQL = "sc AS (SELECT l.doc_id, quality, toxic, floor(n_chars / 100) AS score, lang, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
CURVE_SQL = f"""WITH {SCORED_SQL}, g AS (SELECT score, count_if(quality = 1) AS pos, count_if(quality <> 1) AS neg FROM sc WHERE quality IS NOT NULL GROUP BY 1),
 cv AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g)"""


@query(f"{CURVE_SQL} SELECT round(sum(neg * (tp - pos + pos / 2)) / (max(np) * max(nn)), 6) AS auroc FROM cv")
def metric_auroc(spark, d):
    return M.auroc(scored(spark, d), "quality", "score").select(F.round("auroc", 6).alias("auroc"))


@query(f"{CURVE_SQL} SELECT round(sum(pos / np * tp / (tp + fp)), 6) AS auprc FROM cv")
def metric_auprc(spark, d):
    return M.auprc(scored(spark, d), "quality", "score").select(F.round("auprc", 6).alias("auprc"))


@query(f"""WITH {SCORED_SQL}, c AS (SELECT lang, CAST(count_if(quality = 1 AND score >= 20) AS DOUBLE) AS tp, CAST(count_if(quality = 0 AND score < 20) AS DOUBLE) AS tn, CAST(count_if(quality = 0 AND score >= 20) AS DOUBLE) AS fp, CAST(count_if(quality = 1 AND score < 20) AS DOUBLE) AS fn FROM sc GROUP BY 1)
 SELECT lang, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def metric_mcc(spark, d):
    return M.mcc(scored(spark, d), "quality", F.when(F.col("score") >= 20, 1).otherwise(0), ["lang"]).withColumn("mcc", F.round("mcc", 6))


@query(f"""{CURVE_SQL}, bd AS (SELECT fp, tp, np, nn, coalesce(lead(fp) OVER w - 2 * fp + lag(fp) OVER w, 1) <> 0 OR coalesce(lead(tp) OVER w - 2 * tp + lag(tp) OVER w, 1) <> 0 AS k FROM cv WINDOW w AS (ORDER BY fp, tp)),
 xy AS (SELECT fp / nn AS x, tp / np AS y FROM bd WHERE k UNION ALL SELECT 0.0, 0.0), bo AS (SELECT b, (SELECT max(x) FROM xy WHERE x <= b) AS x0, (SELECT min(x) FROM xy WHERE x > b) AS x1 FROM (VALUES (0.001), (0.1)) v(b)),
 eb AS (SELECT CAST(b AS DOUBLE) AS x, (SELECT max(y) FROM xy WHERE x = x0) + ((SELECT min(y) FROM xy WHERE x = x1) - (SELECT max(y) FROM xy WHERE x = x0)) / (x1 - x0) * (b - x0) AS y FROM bo), p AS (SELECT x, y FROM xy WHERE x > 0.001 AND x < 0.1 UNION ALL SELECT x, y FROM eb),
 s AS (SELECT (log10(x) - log10(lag(x) OVER (ORDER BY x, y))) * (y + lag(y) OVER (ORDER BY x, y)) / 2 AS a FROM p) SELECT round(sum(a) / 2, 6) AS log_auc FROM s""")
def metric_logauc(spark, d):
    return M.log_auc(scored(spark, d), "quality", "score").select(F.round("log_auc", 6).alias("log_auc"))


_RANKED = f"WITH {SCORED_SQL}, rk AS (SELECT quality, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) OVER () AS p FROM sc WHERE quality IS NOT NULL)"


@query(f"""{_RANKED}, s AS (SELECT sum(CASE WHEN quality = 1 THEN exp(-20.0 * r / n) ELSE 0 END) AS s, CAST(max(n) AS DOUBLE) AS n, CAST(max(p) AS DOUBLE) AS p FROM rk)
 SELECT round(s / (p / n * (1 - exp(-20.0)) / (exp(20.0 / n) - 1)) * (p / n * (1 - exp(-20.0)) / (1 + exp(-20.0) - exp(-20.0 * p / n) - exp(-20.0 * (1 - p / n)))) - exp(-20.0 * (1 - p / n)) / (1 - exp(-20.0 * (1 - p / n))), 6) AS bedroc FROM s""")
def metric_bedroc(spark, d):
    return M.bedroc(scored(spark, d), "quality", "score", "doc_id").select(F.round("bedroc", 6).alias("bedroc"))


@query(f"{_RANKED} SELECT round(sum(CASE WHEN quality = 1 AND r <= greatest(1, ceil(n * 5.0 / 100)) THEN 1 ELSE 0 END) / max(greatest(1, ceil(n * 5.0 / 100))) / (CAST(max(p) AS DOUBLE) / max(n)), 6) AS enrichment FROM rk")
def metric_ef(spark, d):
    return M.enrichment(scored(spark, d), "quality", "score", "doc_id", 5.0).select(F.round("enrichment", 6).alias("enrichment"))


def answers(spark, d):
    """Events as answers of models to items: gold is a hash of the item, every seventh answer isn't parsed."""
    pred = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("event_id") * 7 % 4 + 1).cast("int")))
    return T(spark, d, "events").select((F.col("user_id") % 5).alias("model"), (F.col("event_id") % 200).alias("item"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.floor(F.col("event_id") / 3) % 4 + 1).cast("int")).alias("gold"), pred.alias("pred"), "event_type", "value")


ANSWERS_SQL = "an AS (SELECT user_id % 5 AS model, event_id % 200 AS item, substr('ABCD', CAST(event_id // 3 % 4 + 1 AS INTEGER), 1) AS gold, CASE WHEN event_id % 7 <> 0 THEN substr('ABCD', CAST(event_id * 7 % 4 + 1 AS INTEGER), 1) END AS pred, event_type, value FROM events)"


@query(f"""WITH {ANSWERS_SQL}, v AS (SELECT model, gold, pred FROM an WHERE pred IS NOT NULL), k AS (SELECT model, k, sum(t) AS t, sum(q) AS q, sum(h) AS h FROM (SELECT model, gold AS k, 1 AS t, 0 AS q, CASE WHEN gold = pred THEN 1 ELSE 0 END AS h FROM v UNION ALL SELECT model, pred, 0, 1, 0 FROM v) GROUP BY 1, 2)
 SELECT model, round(sum(h) / sum(t), 6) AS accuracy, round(avg(2 * h / (t + q)), 6) AS macro_f1, round(sum(2 * h / (t + q) * t) / sum(t), 6) AS weighted_f1, round((CAST(sum(h) AS DOUBLE) * sum(t) - sum(CAST(t * q AS DOUBLE))) / sqrt((CAST(sum(t) AS DOUBLE) * sum(t) - sum(CAST(q * q AS DOUBLE))) * (CAST(sum(t) AS DOUBLE) * sum(t) - sum(CAST(t * t AS DOUBLE)))), 6) AS mcc FROM k GROUP BY 1""")
def metric_multiclass_f1(spark, d):
    return M.multiclass(answers(spark, d), "gold", "pred", ["model"]).select("model", *(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "mcc")))


@query(f"WITH {ANSWERS_SQL} SELECT model, round(avg(CASE WHEN pred IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS parse_rate, count(*) AS n FROM an GROUP BY 1")
def metric_parse_rate(spark, d):
    return M.parse_rate(answers(spark, d), "pred", ["model"]).withColumn("parse_rate", F.round("parse_rate", 6))


def _bias(spark, d):
    tested = lambda c: F.when(F.col(c).isin("A", "B"), "tested").when(F.col(c).isNotNull(), "untested")
    return answers(spark, d).withColumn("g", tested("gold")).withColumn("p", tested("pred"))


BIAS_SQL = f"WITH {ANSWERS_SQL}, b AS (SELECT event_type, item, CASE WHEN gold IN ('A', 'B') THEN 1 ELSE 0 END AS g, CASE WHEN pred IN ('A', 'B') THEN 1.0 ELSE 0.0 END AS p FROM an WHERE pred IS NOT NULL)"
_BIAS_COLS = "round(avg(CASE WHEN g = 0 THEN p END) - avg(CASE WHEN g = 1 THEN p END), 6) AS pbs, round(avg(CASE WHEN g = 0 THEN p END), 6) AS p_pos_given_neg, round(avg(CASE WHEN g = 1 THEN p END), 6) AS p_pos_given_pos, count_if(g = 1) AS n_true_pos, count_if(g = 0) AS n_true_neg"


def _round_bias(df):
    return df.withColumns({c: F.round(c, 6) for c in ("pbs", "p_pos_given_neg", "p_pos_given_pos")})


@query(f"{BIAS_SQL} SELECT {_BIAS_COLS} FROM b")
def pbs(spark, d):
    return _round_bias(M.publication_bias(_bias(spark, d), "g", "p"))


@query(f"{BIAS_SQL} SELECT event_type, {_BIAS_COLS} FROM b GROUP BY 1")
def pbs_by_tier(spark, d):
    return _round_bias(M.publication_bias(_bias(spark, d), "g", "p", ["event_type"]))


@query(f"WITH {ANSWERS_SQL} SELECT item, round(1 - avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS difficulty, count(*) AS n_models FROM an GROUP BY 1")
def item_difficulty(spark, d):
    return M.item_difficulty(answers(spark, d), "item", F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("int")).withColumn("difficulty", F.round("difficulty", 6))


@query(f"WITH {ANSWERS_SQL}, m AS (SELECT model, item, avg(value) AS v FROM an GROUP BY 1, 2) SELECT a.model AS m1, b.model AS m2, count(*) AS n_common, round(corr(a.v, b.v), 5) AS correlation FROM m a JOIN m b ON a.item = b.item AND a.model < b.model GROUP BY 1, 2 HAVING count(*) >= 10")
def model_correlation(spark, d):
    per = answers(spark, d).groupBy("model", "item").agg(F.avg("value").alias("v"))
    return M.model_correlation(per, "model", "item", "v").where("n_common >= 10").withColumn("correlation", F.round("correlation", 5))


@query("""WITH r AS (SELECT CAST(l_linenumber AS DOUBLE) AS x, CAST(1 + l_suppkey % 7 AS DOUBLE) AS y, l_returnflag FROM lineitem) SELECT l_returnflag, round(1 - avg((x - y) * (x - y)) / (avg(x * x) + avg(y * y) - 2 * avg(x) * avg(y)), 6) AS kappa, round(corr(x, y), 5) AS pearson, round(avg(abs(x - y)), 6) AS mad, count(*) AS n FROM r GROUP BY 1""")
def quadratic_kappa(spark, d):
    rows = lines(spark, d).select("l_returnflag", F.col("l_linenumber").alias("x"), (1 + F.col("l_suppkey") % 7).alias("y"))
    return M.quadratic_kappa(rows, "x", "y", ["l_returnflag"]).withColumns({"kappa": F.round("kappa", 6), "pearson": F.round("pearson", 5), "mad": F.round("mad", 6)})


@query(f"WITH {ANSWERS_SQL} SELECT CASE WHEN pred IS NULL THEN 'parse_failure' WHEN pred = gold THEN 'correct' WHEN gold = 'B' AND pred = 'A' THEN 'positivity_bias' WHEN gold = 'A' AND pred = 'B' THEN 'false_alarm' ELSE 'wrong_class' END AS error, count(*) AS n FROM an GROUP BY 1")
def error_taxonomy(spark, d):
    return M.error_taxonomy(answers(spark, d), "gold", "pred", "A", "B")


@query(f"WITH {ANSWERS_SQL} SELECT model, round(avg(CASE WHEN item < 100 THEN CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END END), 6) AS acc_early, round(avg(CASE WHEN item >= 100 THEN CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END END), 6) AS acc_late FROM an GROUP BY 1")
def contamination_gap(spark, d):
    rows = answers(spark, d).withColumn("period", F.when(F.col("item") < 100, "early").otherwise("late"))
    out = M.contamination_gap(rows, F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("int"), "period", "early", "late", ["model"])
    return out.select("model", F.round("acc_early", 6).alias("acc_early"), F.round("acc_late", 6).alias("acc_late"))


@query("""WITH m AS (SELECT l_returnflag AS source, round(avg(CASE WHEN l_linestatus = 'F' THEN l_tax END), 6) AS "F", round(avg(CASE WHEN l_linestatus = 'O' THEN l_tax END), 6) AS "O" FROM lineitem GROUP BY 1) SELECT * FROM m""")
def transfer_matrix(spark, d):
    out = M.transfer_matrix(lines(spark, d), "l_returnflag", "l_linestatus", "l_tax", ["F", "O"])
    return out.select(F.col("l_returnflag").alias("source"), F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


# --- audits ------------------------------------------------------------------


@query(f"WITH f AS {ENTITY_SQL.format(md5=md5_sql(42, 'e'), c='o_custkey', t='orders')} SELECT count_if(fold = 'train') AS n_train, count_if(fold = 'test') AS n_test, CAST(0 AS BIGINT) AS n_leaked FROM f")
def leakage_check(spark, d):
    return Q.leakage(X.cold_entity(T(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey"), "o_custkey")


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag AS f FROM lineitem) SELECT a.f AS source_a, b.f AS source_b, count(*) AS n_shared FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.f < b.f GROUP BY 1, 2""")
def source_overlap(spark, d):
    return Q.source_overlap(lines(spark, d), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("SELECT count(*) AS n, count_if(l_quantity > 20) AS legacy_rows, count(DISTINCT CASE WHEN l_quantity > 20 THEN l_partkey END) AS legacy_keys, count_if(l_quantity > 40) AS strict_rows, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) AS strict_keys FROM lineitem")
def policy_audit(spark, d):
    return Q.policy_audit(lines(spark, d), {"legacy": F.col("l_quantity") > 20, "strict": F.col("l_quantity") > 40}, "l_partkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 AND l_tax < 0.01 THEN 'quantity,tax' WHEN l_quantity > 45 THEN 'quantity' ELSE 'tax' END AS violations FROM lineitem WHERE l_quantity > 45 OR l_tax < 0.01")
def record_validation(spark, d):
    out = Q.violations(lines(spark, d), {"quantity": F.col("l_quantity") <= 45, "tax": F.col("l_tax") >= 0.01})
    return out.select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations"))


# --- scalar functions --------------------------------------------------------


def _case(rules, column):
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{n}'" for n, p in rules) + " ELSE 'other' END"


@query(f"SELECT doc_id, {_case(C.FAILURE_KEYWORDS, 'text')} AS category FROM documents")
def keyword_cascade(spark, d):
    return T(spark, d, "documents").select("doc_id", C.keyword_class(F.col("text")).alias("category"))


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'unknown' WHEN regexp_matches(text, '{C.CLINICAL}', 'i') THEN 'clinical_failure' WHEN regexp_matches(text, '{C.EXTERNAL}', 'i') THEN 'external_event' WHEN regexp_matches(text, '{C.ADMINISTRATIVE}', 'i') THEN 'administrative' ELSE 'clinical_failure' END AS termination FROM documents")
def termination_type(spark, d):
    return T(spark, d, "documents").select("doc_id", C.termination_type(F.col("text")).alias("termination"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '>' WHEN 2 THEN '<=' ELSE '=' END AS relation, CAST(l_quantity AS DOUBLE) AS value FROM lineitem")
def parse_relation(spark, d):
    n = F.col("l_linenumber")
    raw = F.concat(F.when(n == 1, "> ").when(n == 2, "<=").otherwise(""), F.col("l_quantity").cast("string"), F.lit(" nM"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", C.relation_of(raw).alias("relation"), C.number_of(raw).alias("value"))


@query("SELECT o_orderkey, strftime(CASE o_orderkey % 3 WHEN 2 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d') AS parsed FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3")
def parse_date_multi(spark, d):
    k, dt = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 3, "not a date").when(k % 3 == 0, F.date_format(dt, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(dt, "MMMM d, yyyy")).otherwise(F.date_format(dt, "MMMM yyyy"))
    return T(spark, d, "orders").select("o_orderkey", F.date_format(C.parse_date(text), "yyyy-MM-dd").alias("parsed"))


@query("SELECT l_orderkey, l_linenumber, substr(sha1(concat_ws('|', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), coalesce(nullif(l_returnflag, 'R'), ''))), 1, 16) AS source_id FROM lineitem")
def sha1_source_id(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", C.source_id(F.col("l_partkey"), F.col("l_suppkey"), F.nullif("l_returnflag", F.lit("R"))).alias("source_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_lenient(spark, d):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\n"))
    return T(spark, d, "events").select("event_id", C.lenient_json(wrapped, "k long")["k"].alias("k"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END AS other FROM orders")
def one_hot(spark, d):
    v = C.one_hot(F.col("o_orderstatus"), ["F", "O"])
    return T(spark, d, "orders").select("o_orderkey", v[0].alias("f"), v[1].alias("o"), v[2].alias("other"))


@query("""WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS v FROM embeddings), f AS (SELECT v FROM b ORDER BY vec_id LIMIT 1)
 SELECT vec_id, round(list_sum(list_transform(list_zip(b.v, f.v), lambda p: p[1] * p[2])) / list_sum(list_transform(list_zip(b.v, f.v), lambda p: greatest(p[1], p[2]))), 6) AS tanimoto FROM b, f""")
def tanimoto(spark, d):
    rows = T(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("v"))
    first = rows.agg(F.min_by("v", "vec_id").alias("f"))
    return rows.join(F.broadcast(first)).select("vec_id", F.round(C.tanimoto(F.col("v"), F.col("f")), 6).alias("tanimoto"))


@query("""WITH m AS (SELECT l_suppkey % 10 AS drug, l_linenumber - 1 AS i, CAST(l_partkey % 4 AS INTEGER) AS j, avg(l_discount * 8) AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3) SELECT c.drug, round(avg(c.v - (a.v + b.v - a.v * b.v)), 6) AS bliss_excess, count(*) AS n_cells FROM m c JOIN m a ON a.drug = c.drug AND a.i = c.i AND a.j = 0 JOIN m b ON b.drug = c.drug AND b.j = c.j AND b.i = 0 WHERE c.i > 0 AND c.j > 0 GROUP BY 1""")
def bliss_excess(spark, d):
    m = lines(spark, d).where("l_linenumber <= 4").groupBy((F.col("l_suppkey") % 10).alias("drug"), (F.col("l_linenumber") - 1).alias("i"), (F.col("l_partkey") % 4).cast("int").alias("j")).agg(F.avg(F.col("l_discount") * 8).alias("v"))
    return E.bliss_excess(m, ["drug"], "i", "j", "v").withColumn("bliss_excess", F.round("bliss_excess", 6))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN q > -0.2 AND d < 0.3 AND r THEN 'gold' WHEN q > -0.5 AND d < 0.5 THEN 'silver' ELSE 'bronze' END AS tier FROM (SELECT l_orderkey, l_linenumber, -l_quantity / 50 AS q, CASE WHEN l_linenumber = 7 THEN 1.0 ELSE l_discount * 8 END AS d, l_returnflag = 'A' AS r FROM lineitem)")
def essentiality_tier(spark, d):
    dep = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 8)
    return lines(spark, d).select("l_orderkey", "l_linenumber", C.essentiality_tier(-F.col("l_quantity") / 50, dep, F.col("l_returnflag") == "A").alias("tier"))


@query("SELECT l_orderkey, l_linenumber, round(9 - log10(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 1000.0 END), 6) AS p FROM lineitem")
def unit_to_p(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", "nM").when(F.col("l_returnflag") == "N", " uM").otherwise("furlong")
    return lines(spark, d).select("l_orderkey", "l_linenumber", F.round(C.p_value_of(C.to_nanomolar(F.col("l_quantity"), unit)), 6).alias("p"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'B' END AS letter, CASE event_id % 4 WHEN 0 THEN 'untested' WHEN 1 THEN 'tested' END AS tested FROM events")
def answer_parsers(spark, d):
    k = F.col("event_id") % 4
    letter = F.when(k == 0, " a ").when(k == 1, "I think the answer is (c) here").when(k == 2, "(B) it is").otherwise("no idea")
    tested = F.when(k == 0, "It has not been tested.\nreason").when(k == 1, "Tested\nassay").otherwise("unclear")
    return T(spark, d, "events").select("event_id", C.choice_letter(letter).alias("letter"), C.tested_answer(tested).alias("tested"))


@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """The streaming aggregate's batch form: hourly windows."""
    w = F.window("ts", "1 hour")
    return T(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def _contains(table, column):
    return "CASE WHEN coalesce(text, '') = '' THEN 'other' " + " ".join(f"WHEN {' OR '.join(f"contains(lower({column}), '{w}')" for w in words)} THEN '{n}'" for n, words in table) + " ELSE 'other' END"


@query(f"SELECT doc_id, {_contains(C.AREAS, 'text')} AS area, CASE WHEN coalesce(text, '') = '' THEN 'unknown' ELSE {_contains(C.COMPARTMENTS, 'text')} END AS compartment FROM documents")
def area_and_compartment(spark, d):
    t = F.col("text")
    return T(spark, d, "documents").select("doc_id", C.substring_class(t, C.AREAS).alias("area"), C.substring_class(t, C.COMPARTMENTS, missing="unknown").alias("compartment"))


# --- post-training -----------------------------------------------------------


@query("""SELECT o_custkey, CAST(max(o_orderkey) FILTER (WHERE o_totalprice = hi) AS VARCHAR) AS chosen, CAST(min(o_orderkey) FILTER (WHERE o_totalprice = lo) AS VARCHAR) AS rejected, round(max(hi) - min(lo), 2) AS score_gap
 FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 2 GROUP BY 1 HAVING max(hi) - min(lo) >= 1000""")
def preference_pairs(spark, d):
    out = R.preference_pairs(T(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 1000)
    return out.select("o_custkey", F.col("chosen").cast("string").alias("chosen"), F.col("rejected").cast("string").alias("rejected"), F.round("score_gap", 2).alias("score_gap"))


@query(f"""SELECT conv_id, turn, 'be brief' AS system, text AS prompt, role AS answer FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY {md5_sql(42, 'conv_id', 'turn')}, conv_id, turn) AS r FROM conversations) WHERE r <= 50""")
def sft_records(spark, d):
    out = R.sft_records(T(spark, d, "conversations"), ["conv_id", "turn"], F.lit("be brief"), F.col("text"), F.col("role"), ["role"], 50)
    m = F.col("messages")
    return out.select("conv_id", "turn", m[0]["content"].alias("system"), m[1]["content"].alias("prompt"), m[2]["content"].alias("answer"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END END AS choice, CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END END AS tested, CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 2 / 3.0 END END AS evidence, CASE WHEN event_id % 2 = 0 OR event_id % 3 <> 0 THEN 0.5 ELSE 0.0 END AS format FROM events""")
def reward_functions(spark, d):
    i = F.col("event_id")
    task = F.when(i % 2 == 0, "l1").otherwise("l4")
    text = F.when(i % 3 == 0, "Answer: B, of course").otherwise("It is untested: D. The assay has no IC50.")
    text = F.when((i % 2 == 1) & (i % 3 == 0), "no idea at all").otherwise(text)
    return T(spark, d, "events").select(
        "event_id", R.choice_reward(text, F.lit("b"), task).alias("choice"), R.tested_reward(text, F.lit("Untested"), task).alias("tested"),
        R.evidence_reward(text, task, ["assay", "IC50", "trial"]).alias("evidence"), R.format_reward(text, task).alias("format"),
    )


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey % 5) FILTER (WHERE l_linenumber <= 4) AS g, list(DISTINCT l_suppkey % 5) FILTER (WHERE l_linenumber >= 3) AS p FROM lineitem GROUP BY 1)
 SELECT round(avg(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS schema_compliance, round(avg(CASE WHEN p IS NOT NULL AND len(g) > 0 THEN 2 * len(list_intersect(g, p)) / (len(g) + len(p)) END), 6) AS entity_f1, count(p) AS n_valid, count(*) AS n_total FROM g""")
def extraction_scores(spark, d):
    v, n = (F.col("l_suppkey") % 5).cast("string"), F.col("l_linenumber")
    sets = lines(spark, d).groupBy("l_orderkey").agg(F.collect_set(F.when(n <= 4, v)).alias("g"), F.collect_set(F.when(n >= 3, v)).alias("p")).withColumn("p", F.when(F.size("p") > 0, F.col("p")))
    out = R.extraction_scores(sets, "g", "p")
    return out.select(F.round("schema_compliance", 6).alias("schema_compliance"), F.round("entity_f1", 6).alias("entity_f1"), "n_valid", "n_total")


@query("SELECT l_returnflag, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_pop(l_tax), 6) AS l_tax_std, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std, round(avg((l_tax + l_discount) / 2), 6) AS overall_mean, round(stddev_pop((l_tax + l_discount) / 2), 6) AS overall_std, count(*) AS n FROM lineitem GROUP BY 1")
def judge_summary(spark, d):
    out = R.judge_summary(lines(spark, d), ["l_tax", "l_discount"], ["l_returnflag"])
    return out.select("l_returnflag", *(F.round(c, 6).alias(c) for c in out.columns if c.endswith(("_mean", "_std"))), "n")


@query(f"WITH {ANSWERS_SQL}, m AS (SELECT median(value) AS m FROM an) SELECT CASE WHEN value > m THEN 'high' ELSE 'low' END AS popularity, CASE WHEN item < 100 THEN 'early' ELSE 'late' END AS period, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM an, m GROUP BY 1, 2")
def contamination_grid(spark, d):
    rows = answers(spark, d).withColumn("period", F.when(F.col("item") < 100, "early").otherwise("late"))
    return R.contamination_grid(rows, F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("int"), "value", "period").withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH s AS (SELECT l_returnflag, l_linenumber, avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS r, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS o FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS n_seeds, round(100 * (avg(o) - avg(r)) / abs(avg(r)), 6) AS inflation_percent FROM s WHERE r IS NOT NULL AND o IS NOT NULL GROUP BY 1""")
def matched_inflation(spark, d):
    return R.matched_inflation(lines(spark, d), ["l_returnflag"], "l_linenumber", "l_linestatus", "l_quantity", "F", "O").withColumn("inflation_percent", F.round("inflation_percent", 6))


@query("""WITH x AS (SELECT l_returnflag, avg(CASE WHEN l_linestatus = 'F' THEN l_tax END) AS b, avg(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS a FROM lineitem GROUP BY 1) SELECT l_returnflag, round(b, 6) AS tax_before, round(a, 6) AS tax_after, round(a - b, 6) AS tax_delta FROM x""")
def before_after(spark, d):
    mean = lambda s: lines(spark, d).where(F.col("l_linestatus") == s).groupBy("l_returnflag").agg(F.avg("l_tax").alias("tax"))
    out = R.before_after(mean("F"), mean("O"), ["l_returnflag"], ["tax"])
    return out.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("tax_before", "tax_after", "tax_delta")))


from nadir.plans import catalog_builders, catalog_cells, catalog_graphs  # noqa: E402, F401  they register more queries with what is above
