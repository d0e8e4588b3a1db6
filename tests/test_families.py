import numpy as np
import pytest
from pyspark.sql import functions as F

from nadir.operators import splits

RATIOS = splits.DEFAULT


def one_by_one(sizes, rule):
    total, have, out = sum(sizes.values()), [0, 0, 0], {}
    for name in sorted(sizes, key=lambda f: (-sizes[f], f)):
        n = sizes[name]
        if rule == "best_fit":
            k = next((k for k in (0, 1) if have[k] + n <= total * RATIOS[k]), 2)
        else:
            k = min(range(3), key=lambda k: (have[k] / total - RATIOS[k], k))
        have[k] += n
        out[name] = splits.FOLDS[k]
    return out


def test_shares_of_a_run_are_those_of_the_rule():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, have, m = int(rng.integers(1, 9)), rng.integers(0, 60, size=3), 80
        total = int(have.sum()) + n * m
        now, counts = have.astype(np.int64).copy(), []
        c = np.zeros(3, np.int64)
        for _ in range(m):
            counts.append(c.copy())
            k = min(range(3), key=lambda k: (now[k] / total - RATIOS[k], k))
            now[k] += n
            c[k] += 1
        got = splits.shared_out(np.arange(m), np.full(m, n), np.repeat(have[None].astype(np.int64), m, 0), total, RATIOS)
        assert (got == np.array(counts)).all()


@pytest.mark.parametrize("rule", ["best_fit", "underfilled"])
def test_families_one_after_another(spark, rule):
    rng = np.random.default_rng(1)
    sizes = {f"family-{i:04d}": int(x) for i, x in enumerate(np.minimum(40, rng.zipf(1.7, size=500)))}
    df = spark.createDataFrame([(f, i) for f, n in sizes.items() for i in range(n)] + [(None, 1)], "f string, i long")
    out = splits.family_greedy(df, "f", rule)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "") and "REPARTITION_BY_NUM" not in plan
    got = {r["f"]: r["fold"] for r in out.select("f", "fold").distinct().collect()}
    assert got.pop(None) is None and got == one_by_one(sizes, rule)


def test_running_total_with_one_prefix(spark):
    """Names that all begin alike, most of one size: places come from ranges of the order, none of which holds most families."""
    df = spark.createDataFrame([(f"scaffold-{i:05d}", j) for i in range(3000) for j in range(1 + (i % 50 == 0))], "f string, i long")
    placed, runs = splits.family_places(df, "f")
    assert runs == [(2, 60), (1, 2940)]
    assert sorted(r["place"] for r in placed.where("n = 1").collect()) == list(range(2940))
    got = dict(splits.running_total(df, "f").select("f", "fold").distinct().collect())
    order = [f"scaffold-{i:05d}" for i in range(0, 3000, 50)] + [f"scaffold-{i:05d}" for i in range(3000) if i % 50]
    before, total = 0, 3060
    for f in order:
        assert got[f] == ("train" if before < total * RATIOS[0] else "val" if before < total * (RATIOS[0] + RATIOS[1]) else "test")
        before += 2 if int(f[-5:]) % 50 == 0 else 1
    assert splits.running_total(df.limit(0), "f").count() == 0 and splits.family_greedy(df.limit(0), "f").count() == 0
    assert splits.family_greedy(df.where(F.col("i") < 0), "f", "underfilled").count() == 0
