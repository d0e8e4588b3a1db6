import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nadir.streaming import merge

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def table(spark, tmp_path, buckets=8):
    return merge.MergeTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert content(t) == []
    last = merge.keep_last(["k"], ["v"])
    assert t.merge(frame(spark, [(i, "a") for i in range(40)] + [(None, "n")]), last, 0)
    before = t.manifest()["folders"]
    assert t.merge(frame(spark, [(7, "b"), (7, "c")]), last, 1)
    after = t.manifest()["folders"]
    assert sum(before[b] != after[b] for b in after) == 1 and set(before) == set(after)
    assert (7, "b") in content(t) and len(content(t)) == 41
    # replay
    assert not t.merge(frame(spark, [(7, "z")]), last, 1) and (7, "b") in content(t)
    assert t.merge(frame(spark, [(7, "q"), (99, "q")]), merge.keep_first(["k"], ["v"]), 2)
    assert (7, "b") in content(t) and (99, "q") in content(t)
    assert sorted(map(tuple, t.read(1).collect()), key=str) == sorted([(i, "a") for i in range(40)] + [(None, "n")], key=str)
    assert t.merge(frame(spark, []), last, 3) and len(content(t)) == 42


def test_a_killed_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    last = merge.keep_last(["k"], ["v"])
    t.merge(frame(spark, [(1, "a"), (2, "a")]), last, 0)

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(merge.MergeTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            t.merge(frame(spark, [(1, "x"), (3, "x")]), last, 1)
    assert content(t) == [(1, "a"), (2, "a")]
    assert t.merge(frame(spark, [(1, "x"), (3, "x")]), last, 1)
    assert content(t) == [(1, "x"), (2, "a"), (3, "x")]
    assert t.vacuum(keep=1) > 0 and content(t) == [(1, "x"), (2, "a"), (3, "x")]
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit(t.manifest())


def test_a_stream_of_evidence_equals_the_batch(spark, tmp_path):
    """Three files, the second one once more in the third, late rows and withdrawals; and a batch that comes again."""
    rows = [(i, i % 5, i % 3, ("gold", "silver", None)[i % 7 % 3], i * 1.5, i % 11 == 10, f"2024-01-01 0{i // 40}:{i % 40:02d}:00") for i in range(120)]
    # what is withdrawn was counted before, under another event
    rows += [(1000 + r[0], r[1], r[2], r[3], r[4], False, r[6]) for r in rows if r[5]]
    df = spark.createDataFrame(rows, "e long, a long, b long, tier string, v double, gone boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    src = tmp_path / "in"
    parts = [df.where("e % 3 = 0"), df.where("e % 3 = 1"), df.where("e % 3 = 2").unionByName(df.where("e % 3 = 1"))]
    roll = merge.PairRollup(spark, str(tmp_path / "r"), "a", "b", "tier", "v", ["gold", "silver"], buckets=4)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(df.schema).parquet(str(src))
        q = roll.follow(stream, F.col("gone"), "e", "ts", "5 hours").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    one = merge.PairRollup(spark, str(tmp_path / "one"), "a", "b", "tier", "v", ["gold", "silver"], buckets=3)
    one.apply(df, F.col("gone"))
    want = sorted(map(tuple, one.read().collect()))
    assert sorted(map(tuple, roll.read().collect())) == want and len(want) == 15
    last = roll.table.manifest()["batches"]["stream"]
    assert not roll.apply(parts[1], F.col("gone"), last, "stream") and sorted(map(tuple, roll.read().collect())) == want
    sizes = df.groupBy("a", "b").agg(F.sum(F.when(F.col("gone"), -1).otherwise(1)).alias("n")).collect()
    assert {(r["a"], r["b"]): r["n"] for r in sizes} == {(x[0], x[1]): x[2] for x in want}
