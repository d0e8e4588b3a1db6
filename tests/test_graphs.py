import numpy as np
import pytest

from nadir.operators import graphs, splits


def planted(n=600, parts=6, inside=7, across=1, seed=0):
    rng = np.random.default_rng(seed)
    group = rng.permutation(n) % parts
    of = [np.flatnonzero(group == g) for g in range(parts)]
    edges = [(int(v), int(rng.choice(of[group[v]]))) for v in range(n) for _ in range(inside)]
    edges += [(int(v), int(rng.integers(0, n))) for v in range(n) for _ in range(across)]
    return edges


def cut(edges, part):
    return sum(part[a] != part[b] for a, b in edges)


def test_planted_parts_are_found(spark):
    edges = planted()
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["part"] for r in graphs.balanced_parts(df, "a", "b", parts=6).collect()}
    again = {r["node"]: r["part"] for r in graphs.balanced_parts(df.repartition(7), "b", "a", parts=6).collect()}
    assert got == again and set(got) == {x for e in edges for x in e}
    sizes = np.bincount(list(got.values()), minlength=6)
    assert abs(sizes - len(got) / 6).max() <= 0.05 * len(got) / 6
    hashed = {v: hash((v, "x")) % 6 for v in got}
    assert cut(edges, got) * 3 <= cut(edges, hashed)


def test_rows_between_folds_are_left_out_and_no_node_crosses(spark):
    edges = planted(200, 5, 6, 1, 1) + [(None, 3), (5, None), (9, 9)]
    out = graphs.cold_both_graph(spark.createDataFrame(edges, "a long, b long"), "a", "b", parts=5, levels=2, rounds=2, refine=2).collect()
    assert len(out) == len(edges)
    fold = {}
    for r in out:
        for x in (r["a"], r["b"]):
            if r["fold"] is not None:
                assert fold.setdefault(x, r["fold"]) == r["fold"]
    assert all(r["fold"] is None for r in out if r["a"] is None or r["b"] is None)
    assert {r["fold"] for r in out} <= {"train", "val", "test", None}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2)], [(0, i) for i in range(1, 60)], [(2 * i, 2 * i + 1) for i in range(50)]])
def test_odd_graphs(spark, edges):
    """None, a loop, one link, a star, and pairs that can't be coarsened."""
    got = graphs.balanced_parts(spark.createDataFrame(edges, "a long, b long"), "a", "b", parts=5, levels=1, rounds=2, refine=1).collect()
    assert {r["node"] for r in got} == {x for e in edges for x in e} and len(got) == len({r["node"] for r in got})
    if len(got) >= 50:
        sizes = np.bincount([r["part"] for r in got], minlength=5)
        assert sizes.max() - sizes.min() <= 2 + 0.1 * len(got) / 5


def test_dispatch(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "a long, b long")
    assert splits.apply_split(df, "cold_both_graph", first="a", second="b", one_kind=False, parts=2, levels=1, rounds=1, refine=1).count() == 3


def test_weighted_pairs(spark):
    from collections import Counter

    from nadir.operators import sampling

    weights = {i: 1 + (i % 7) ** 2 for i in range(60)} | {100: 0, 101: None}
    side = spark.createDataFrame(list(weights.items()), "k long, w long")
    tested = [(i, (i * 7) % 60) for i in range(60)]
    out = sampling.weighted_pairs(side, side.toDF("m", "v"), spark.createDataFrame(tested, "k long, m long"), 500).collect()
    pairs = [(r["a"], r["b"]) for r in out]
    assert len(set(pairs)) == 500 and not set(pairs) & set(tested) and [r["draw"] for r in out] == sorted(r["draw"] for r in out)
    total = sum(w or 0 for w in weights.values())
    for end in (0, 1):  # ends of the first draws, before repeats matter much, follow the weights
        seen = Counter(p[end] % 7 for p in pairs[:300])
        for m in range(7):
            share = sum(w or 0 for i, w in weights.items() if i % 7 == m and i < 60) / total
            assert abs(seen[m] - 300 * share) < 4 * (300 * share * (1 - share)) ** 0.5 + 3
    one = sampling.weighted_pairs(side, side.toDF("m", "v"), spark.createDataFrame([], "k long, m long"), 200, one_kind=True).collect()
    assert len(one) == 200 and all(r["a"] < r["b"] for r in one)
    few = sampling.weighted_pairs(side.where("k < 2"), side.where("k < 2").toDF("m", "v"), spark.createDataFrame([(0, 0)], "k long, m long"), 100)
    assert {(r["a"], r["b"]) for r in few.collect()} == {(0, 1), (1, 0), (1, 1)}
    assert sampling.weighted_pairs(side.limit(0), side.toDF("m", "v"), spark.createDataFrame([], "k long, m long"), 5).count() == 0
