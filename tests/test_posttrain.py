import pytest
from pyspark.sql import functions as F

from nadir.operators import posttrain as R
from nadir.operators import textclass


def test_preferences_need_two_answers_and_a_gap(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9), (2, "c", 0.5), (3, "d", 0.4), (3, "e", 0.5)], "q long, a string, s double")
    assert [tuple(r)[:3] for r in R.preference_pairs(df, "q", "a", "s").collect()] == [(1, "b", "a")]


def test_set_f1_edges(spark):
    df = spark.createDataFrame([(["a"], None), (["a", "b"], ["b", "c"]), ([], ["a"])], "g array<string>, p array<string>")
    assert [r[0] for r in df.select(R.set_f1(F.col("g"), F.col("p"))).collect()] == [0.0, 0.5, None]


def test_classifier_learns_and_falls_back(spark):
    rows = [(i, ("slow enrollment of patients" if i % 2 else "toxic adverse event") + f" site {i % 7}", "enrollment" if i % 2 else "safety") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model, accuracy = textclass.train(df, "text", "label", "id", folds=2, features=256, iterations=5)
    assert model is not None and accuracy > 0.95
    new = spark.createDataFrame([(1, "adverse toxic"), (2, None)], "id long, text string")
    assert textclass.classify(new, "text", "label", model).orderBy("id").first()["label"] == "safety"
    assert textclass.train(df.limit(50), "text", "label", "id") == (None, None)
    assert [r["label"] for r in textclass.classify(new, "text", "label").orderBy("id").collect()] == ["safety", "other"]


@pytest.mark.parametrize("places", [1 << 20, 64, 3])  # few places make a third pass
def test_vocabulary_is_exact_and_a_tie_goes_to_the_lesser_term(spark, monkeypatch, places):
    monkeypatch.setattr(textclass, "PLACES", places)
    import collections
    import random
    import re

    rng = random.Random(4)
    texts = [None, "", "The and of", *(" ".join(rng.choice(["Alpha", "beta,", "the", "x", "gamma-2", "délta", "is"]) for _ in range(rng.randint(0, 30))) for _ in range(200))]
    counts = collections.Counter()
    for t in texts:
        kept = [w for w in re.findall(r"\w+", (t or "").lower()) if len(w) >= 2 and w not in textclass.STOP_WORDS]
        counts.update(kept)
        counts.update(f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for most in (1, 7, 1000):
        assert list(map(tuple, textclass.vocabulary(df, "text", most).collect())) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]


def test_classifier_without_a_term_falls_back(spark):
    df = spark.createDataFrame([(i, "the" if i % 2 else None, "a" if i % 3 else "b") for i in range(120)], "id long, text string, label string")
    assert textclass.train(df, "text", "label", "id", folds=2) == (None, None)


def test_more_labelled_rows_than_the_bound_are_sampled(spark):
    df = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", "a" if i % 2 else "b") for i in range(200)], "id long, text string, label string")
    model, accuracy = textclass.train(df, "text", "label", "id", folds=2, most_rows=100, iterations=3)
    assert model is not None and accuracy == 1.0
