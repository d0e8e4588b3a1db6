"""Steps whose figures must not grow faster than their input: other plans, same rows."""

import random

from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_large_bucket_is_merged_by_several_tasks(spark, tmp_path, monkeypatch):  # F7
    from nadir.streaming import merge

    monkeypatch.setattr(merge, "TASK_ROWS", 50)
    roll = merge.PairRollup(spark, str(tmp_path / "t"), "a", "b", "t", "v", ["x"], buckets=2)
    rows = spark.range(400).select((F.col("id") % 20).alias("a"), F.col("id").alias("b"), F.lit("x").alias("t"), F.lit(1).alias("v"))
    for batch in (0, 1, 1):
        roll.apply(rows.where(F.col("b") % 2 == batch), F.lit(False), batch, partitions=3)
    assert rows_of(roll.read().select("a", "b", "n")) == sorted([(i % 20, i, 1) for i in range(400)], key=str)
    assert len(roll.table.read().inputFiles()) > 2


def test_degrees_and_few_sources_make_no_rows(spark):  # F10, F13
    from nadir.functions import columns as C
    from nadir.operators import pairs as P

    df = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "y", 1), (1, 1, None, 2), (1, 2, None, None), (2, 2, "x", 3), (None, 2, "x", 3)], "a long, b long, s string, study int")
    measures = {"studies": F.countDistinct("study"), "sources": C.source_count("s")}
    plain = P.rollup(df, P.PairSpec("a", "b", measures, degrees=None), 3)
    assert plain.columns == ["a", "b", "studies", "sources"] and dict(plain.dtypes)["sources"] == "bigint"
    assert "Expand" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(plain) == [(1, 1, 2, 2), (1, 2, 0, 0), (2, 2, 1, 1)]
    want = [(1, 1, 2, 2, 2, 1), (1, 2, 0, 0, 2, 2), (2, 2, 1, 1, 1, 2)]
    for most in (1 << 17, 0):
        P.MOST_BROADCAST, held = most, P.MOST_BROADCAST
        for parts in (None, 3):
            assert rows_of(P.rollup(df, P.PairSpec("a", "b", measures), parts).select("a", "b", "studies", "sources", "a_degree", "b_degree")) == want
        P.MOST_BROADCAST = held


def test_tested_items_by_limits(spark, monkeypatch):  # F12
    from nadir.operators import builders as B

    rng = random.Random(1)
    # the last period has fewer spread values than rows wanted, one of them null
    rows = [(i, rng.choice([1990, 1992, 1999]), rng.choice([None, 1, 2]) if i % 3 else rng.randrange(40), rng.choice([True, False, None])) for i in range(400)]
    df = spark.createDataFrame([(i, y, s % 3 if y == 1999 and s is not None else s, p) for i, y, s, p in rows], "k long, y int, s int, p boolean")
    take = lambda: B.tested_items(df, "y", {"early": (None, 1995, 60), "late": (1996, None, 9), "none": (2010, None, 5)}, ["k"], "s", F.col("p"))
    got = take()
    assert got.columns == ["k", "y", "s", "p", "period", "answer"] and got.count() == 69
    limited = rows_of(got)
    monkeypatch.setattr(B, "MOST_LIMIT", 0)
    assert rows_of(take()) == limited


def test_edges_are_distinct_before_they_are_named(spark):  # F20
    from nadir.operators import quality as Q

    names = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z"), (4, "w")], "k long, name string")
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (1, 3), (4, 4), (1, 9), (None, 2), (2, 2)], "a long, b long")
    for parts in (None, 3):
        assert rows_of(Q.edge_list(links, "a", "b", names, "k", "name", parts)) == [("w", "z"), ("x", "y")]



def test_parts_of_weighted_links(spark):  # F19
    from nadir.operators import graphs

    rng = random.Random(3)
    links = spark.createDataFrame([(f"n{rng.randrange(12)}", rng.choice([None, *(f"n{k}" for k in range(12))])) for _ in range(60)], "a string, b string")
    weighted = links.groupBy("a", "b").agg(F.count("*").alias("n"))
    small = {"levels": 1, "rounds": 2, "refine": 1}
    assert rows_of(graphs.balanced_parts(weighted, "a", "b", 2, weight="n", **small)) == rows_of(graphs.balanced_parts(links, "a", "b", 2, **small))


def test_untested_items_of_distinct_pairs(spark):  # F14, F17
    from nadir.operators import builders as B
    from nadir.operators.pairs import PairSpec, rollup

    rng = random.Random(2)
    known = spark.createDataFrame([(rng.randrange(12), rng.randrange(30)) for _ in range(90)] + [(None, 3)], "a long, b long")
    once = known.distinct()
    for kinds in ((8, 0), (0, 8), (5, 5), (0, 0)):
        want = B.untested_items(rollup(known, PairSpec("a", "b", {"n": F.count("*")})), "a", "b", ("a_degree", "b_degree"), known, *kinds, (6, 9), 2)
        got = B.untested_items(once.where("a is not null"), "a", "b", None, once, *kinds, (6, 9), 2, known_once=True)
        assert got.columns == ["a", "b", "kind", "answer"] and rows_of(got) == rows_of(want) and got.count() == sum(kinds)


def test_items_of_texts_in_batches(spark):  # F18
    import pyarrow as pa

    from nadir.functions import columns as C

    rng = random.Random(4)
    item = lambda: rng.choice(["", "a", "a=", "=", "=b", "a=b=c", "é=1", "a-=2", "a\0=3", f"k{rng.randrange(9)}={rng.randrange(9)}", f"k{rng.randrange(9)}"])
    texts = [None, "", ";;"] * 90 + [";".join(item() for _ in range(rng.randrange(40))) for _ in range(500)] + [f"k={'v' * 100000};" * 3]
    rng.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1).select("id", C.info_map(F.col("t")).alias("m"))

    def plain(text):
        found = {}
        for x in text.split(";"):
            if x:
                key, sign, value = x.partition("=")
                found[key] = value if sign else None
        return found

    got = rows.select("id", "m", F.map_keys("m").alias("k")).collect()
    assert [r["m"] for r in sorted(got)] == [None if t is None else plain(t) for t in texts]
    assert all(r["k"] == sorted(r["k"], key=str.encode) for r in got if r["k"])
    batch = C._last_values.func
    assert batch(pa.array([], pa.binary())).to_pylist() == [] and batch(pa.array([None, b""], pa.binary())).to_pylist() == [None, []]


def test_texts_as_info_fields(spark, tmp_path):  # F18
    import duckdb

    from nadir.plans import catalog_cells  # noqa: F401
    from nadir.plans.catalog import oracle_sql, queries

    # (flag) as a value counts as its SQL counts it; keys sort by themselves, not with their values
    texts = ["ae(flag) b", "be1 b be2 b-e3 b", "e eee; x=1;y", "", " ;", None, "ßeé ß-e"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["info_of_texts"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 1 and "substring_index" not in plan
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows_of(got) == sorted(con.sql(oracle_sql()["info_of_texts"]).fetchall(), key=str)
