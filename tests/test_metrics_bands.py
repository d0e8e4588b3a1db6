import numpy as np
from pyspark.sql import functions as F

from nadir.operators import metrics, ordering


def test_bands_are_bounded(spark):
    """A million distinct scores, and one score with a string key: no band holds many."""
    many = ordering.in_bands(spark.range(1_000_000).select((F.hash("id") / 7.0).alias("s"), "id"), [F.desc("s"), "id"])
    sizes = [r["count"] for r in many.groupBy("band").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2 * ordering.WINDOW_ROWS
    one = ordering.in_bands(spark.range(300_000).select(F.lit(0.5).alias("s"), F.concat(F.lit("scaffold-"), F.col("id").cast("string")).alias("k")), [F.desc("s"), "k"], rows_per_band=20_000)
    assert max(r["count"] for r in one.groupBy("band").count().collect()) <= 40_000


def test_metrics_over_many_bands(spark, monkeypatch):
    rng = np.random.default_rng(0)
    y, s, g = rng.integers(0, 2, 3000), rng.integers(0, 900, 3000) / 900, rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(a), float(b), int(c), f"k{i}") for i, (a, b, c) in enumerate(zip(y, s, g, strict=True))], "y int, s double, g int, k string")
    plain = metrics.all_by_fold(df, "y", "s", "k", "g").orderBy("g").collect()
    monkeypatch.setattr(ordering.in_bands, "__defaults__", (100, 1 << 14))
    assert metrics.curve(df, "y", "s", ["g"]).select("band").distinct().count() > 15
    again = metrics.all_by_fold(df, "y", "s", "k", "g").orderBy("g").collect()
    for a, b in zip(plain, again, strict=True):
        assert all(abs(x - z) < 1e-9 for x, z in zip(a, b, strict=True))
        own = [(b_, a_) for a_, b_, c_ in zip(y, s, g, strict=True) if c_ == a["g"]]
        pos, neg = [b_ for b_, a_ in own if a_], [b_ for b_, a_ in own if not a_]
        p, n = np.array(pos)[:, None], np.array(neg)[None]
        assert abs(a["auroc"] - ((p > n) + 0.5 * (p == n)).mean()) < 1e-9


def test_model_correlation_is_that_of_the_join(spark):
    rng = np.random.default_rng(4)
    rows = [(f"m{m}", int(i), None if (m + i) % 17 == 0 else float(1000 + (m * i) % 7 + rng.normal())) for m in range(6) for i in range(80) if (m * i) % 5]
    rows += [("m1", 3, 4.0), ("m1", 3, 5.0), (None, 3, 1.0), ("m2", None, 1.0)] + [("flat", i, 0.1) for i in range(80)]
    df = spark.createDataFrame(rows, "m string, i long, v double")
    key = lambda out: {(r["m1"], r["m2"]): (r["n_common"], r["correlation"]) for r in out.collect()}
    got = key(metrics.model_correlation(df, "m", "i", "v"))
    a, b = df.toDF("m1", "i", "x"), df.toDF("m2", "i", "y")
    pairs = a.join(b, "i").where("m1 < m2").groupBy("m1", "m2").agg(F.count("*").alias("n_common"), F.collect_list(F.struct("x", "y")).alias("v"))
    want = {}
    for r in pairs.collect():
        x, y = np.array([(p["x"], p["y"]) for p in r["v"] if p["x"] is not None and p["y"] is not None]).T
        flat = len(set(x)) == 1 or len(set(y)) == 1
        want[r["m1"], r["m2"]] = (r["n_common"], float("nan") if flat or r["n_common"] < 10 else np.corrcoef(x, y)[0, 1])
    assert got.keys() == want.keys()
    for k, (n, c) in want.items():
        assert got[k][0] == n and (np.isnan(c) and np.isnan(got[k][1]) or abs(c - got[k][1]) < 1e-9)
    assert metrics.model_correlation(df.limit(0), "m", "i", "v").count() == 0
