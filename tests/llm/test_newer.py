"""Ball k-means, importance resampling and Feistel shards against brute force, with the awkward rows of each."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nadir.llm import ballkmeans, feistel, importance, queries

SCHEMA = "doc_id long, text string, source string"
CLASH = ["cluster", "distance", "vector", "row", "slot", "shard", "tie", "id", "part", "block", "rank", "score", "weight", "c0", "base", "n"]


def clashing(df):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH))


# --- ball k-means ------------------------------------------------------------


def test_balls_assign_as_the_plain_method_and_compare_less():
    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 60, size=(40, 12))
    points = (centres[rng.integers(0, 40, 4000)] + rng.integers(-6, 7, size=(4000, 12))).astype(np.int64)
    c = points[:40].copy()
    c[7] = c[3]  # equal centroids
    at = np.zeros(len(points), np.int32)
    balls = ballkmeans.Balls.of(c, [None] * len(c))
    at, dist = balls.assign(points, at)
    d = ((points[:, None] - c[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    radius = [math.isqrt(int(dist[at == j].max())) + 1 if (at == j).any() else 0 for j in range(len(c))]
    balls = ballkmeans.Balls.of(c, radius)
    again, _ = balls.assign(points, at)
    assert (again == at).all() and balls.compared < 0.3 * points.shape[0] * len(c)


def test_squared_is_exact_for_large_components():
    p = np.array([[ballkmeans.MOST - 1] * 64, [-ballkmeans.MOST + 1] * 64], np.int64)
    assert ballkmeans.squared(p, p[0]).tolist() == [0, 64 * (2 * (ballkmeans.MOST - 1)) ** 2]


def test_cluster(spark):
    rng = np.random.default_rng(1)
    m = (rng.normal(size=(8, 64))[rng.integers(0, 8, 400)] + 0.4 * rng.normal(size=(400, 64))).astype(np.float32)
    m[40:160] = m[40]  # a vector that a third of the rows share
    odd = [(900, None), (901, [0.5] * 63), (902, [float("nan")] + [0.0] * 63), (903, [None] + [0.0] * 63), (904, [float("inf")] * 64), (905, [])]
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(400)] + odd, "vec_id long, embedding array<float>")
    points = {i: np.floor(m[i].astype(np.float64) * 64).astype(np.int64).tolist() for i in range(400)}
    want, c = ballkmeans.plain_kmeans(points, 16, 3, 1)
    for frame in (df, clashing(df).repartition(5)):
        got = ballkmeans.cluster(frame).withColumn("sha", ballkmeans.centroid_digest()).collect()
        assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in got} == want and len(got) == 400
        inertia = Counter()
        for a, d in want.values():
            inertia[a] += d
        for r in got:
            assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
            assert r["sha"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_cluster_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert ballkmeans.cluster(spark.createDataFrame([], schema)).count() == 0
    assert ballkmeans.cluster(spark.createDataFrame([(1, None)], schema)).count() == 0
    rows = [(None, [1.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64), (3, [-1.0] * 64)]
    got = sorted((r["vec_id"] is None, r["vec_id"], r["distance"]) for r in ballkmeans.cluster(spark.createDataFrame(rows, schema)).collect())
    assert got == [(False, 2, 0), (False, 2, 0), (False, 3, 0), (True, None, 0)]
    with pytest.raises(Exception, match="after scaling"):
        ballkmeans.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema))
    with pytest.raises(ValueError, match="k must be"):
        ballkmeans.cluster(spark.createDataFrame([], schema), k=0)


# --- importance resampling ---------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, buckets=10_000):
    of = lambda t: Counter(zlib.crc32(f.encode()) % buckets for f in runs(t)[1])
    own, aim = [of(t) for _, t in docs], sum((of(t) for t in target), Counter())
    s = sum(own, Counter())
    S, T = sum(s.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for (i, t), c in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * n for b, n in c.items())
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(runs(t)[0])])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_crc_of_spans_and_joins():
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(0, 256, size=int(n)).astype(np.uint8)) for n in rng.integers(0, 200, size=300)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    crc = importance.span_crcs(data, ends - [len(p) for p in parts], ends)
    assert crc.tolist() == [zlib.crc32(p) for p in parts]
    both = importance.joined(crc[:-1], crc[1:], np.array([len(p) for p in parts[1:]]))
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:], strict=False)]


def test_packed_integers():
    for v in ([], [0], [255, 256, 3], [1 << 40, 5, 0]):
        assert importance.unpack(importance.pack(np.array(v, np.int64))).tolist() == v


def test_resample(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdE9é-,"), size=rng.integers(1, 7))) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(vocab, size=n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, text(30_000)), (1004, "x" * 100_000 + " y z " * 20), (None, text(40)), (7, docs[7][1]), (7, text(30))]
    docs += [(2000 + i, docs[5][1] + text(25)) for i in range(40)]
    target = [text(50) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t, "a") for i, t in docs], SCHEMA)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    want = plain_resample(docs, target)
    for frame, given in ((df, aim), (clashing(df).repartition(7), clashing(aim).repartition(3))):
        assert sorted(map(tuple, importance.resample(frame, given).collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 5
    assert importance.resample(df.limit(0), aim).count() == 0
    assert sorted(map(tuple, importance.resample(df, aim.limit(0)).collect()), key=str) == plain_resample(docs, [])


def test_resample_many_blocks(spark, monkeypatch):
    """More blocks than a cell holds: cells of one part share its sums."""
    rows = [(i, f"w{i % 7} the the w{i % 13} " * (6 + i % 5)) for i in range(600)]
    aim = spark.createDataFrame([(1, "w3 the the w5 w3")], "item_id long, text string")
    monkeypatch.setattr(importance, "CELL_BLOCKS", 2)
    got = importance.resample(spark.createDataFrame([(i, t, "a") for i, t in rows], SCHEMA).repartition(12), aim)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, ["w3 the the w5 w3"])


def test_resample_cells_meet_over_many_partitions(spark):
    """A cell's postings and sums are in one partition, also if there are several: their keys have one type."""
    rows = [(i, f"w{i % 7} the the w{i % 13} " * (6 + i % 5)) for i in range(100)]
    docs, aim = spark.createDataFrame([(i, t, "a") for i, t in rows], SCHEMA), spark.createDataFrame([(1, "w3 the the w5 w3")], "item_id long, text string")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        assert sorted(map(tuple, importance.resample(docs, aim).collect()), key=str) == plain_resample(rows, ["w3 the the w5 w3"])
    finally:
        spark.conf.set(name, before)


# --- Feistel shards ----------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 40, 41, 1000, 4097])
def test_permutation(spark, n):
    f = feistel.Feistel(n)
    want = [f.of(i) for i in range(n)]
    assert sorted(want) == list(range(n)) and [f.of(x, back=True) for x in want] == list(range(n))
    got = spark.range(n).select("id", f.column(F.col("id")).alias("to")).withColumn("back", f.column(F.col("to"), back=True)).orderBy("id").collect()
    assert [r["to"] for r in got] == want and all(r["id"] == r["back"] for r in got)


def test_permutation_of_many(spark):
    n = 10**14 + 3
    f = feistel.Feistel(n)
    some = [0, 1, n - 1, n // 2, 12345678901234]
    df = spark.createDataFrame([(x,) for x in some], "x long")
    assert [r[0] for r in df.select(f.column(F.col("x"))).collect()] == [f.of(x) for x in some] and [f.of(f.of(x), True) for x in some] == some


def checked(rows, docs, shards):
    n = len(docs)
    assert len(rows) == n
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values()) if len(slots) == shards else [0]) <= 1


def test_assign(spark):
    docs = [(i, f"text {i} é" * (i % 9)) for i in range(500)] + [(None, None), (None, "a"), (3, None), (3, ""), (4, "z" * 200_000)]
    docs += [(77, "the same")] * 300  # rows of which a third are one
    df = spark.createDataFrame([(i, t, "a") for i, t in docs], SCHEMA)
    one, two = feistel.assign(df).collect(), feistel.assign(clashing(df).repartition(9)).collect()
    checked(one, docs, 40)
    key = lambda r: str((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]))
    assert sorted(map(key, one)) == sorted(map(key, two))
    f = feistel.Feistel(len(docs))
    assert all(f.of(r["row"]) == r["slot"] * 40 + r["shard"] for r in one)
    assert feistel.assign(df.limit(0)).count() == 0


def test_write_shards(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(203)] + [(None, None), (5, "text 5")]
    df = clashing(spark.createDataFrame([(i, t, "a") for i, t in docs], SCHEMA))
    out = feistel.write_shards(df, str(tmp_path / "out"), shards=8, files_per_shard=3)
    rows = out.select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(docs)
    again = feistel.write_shards(df.repartition(6), str(tmp_path / "again"), shards=8, files_per_shard=3).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and set(df.columns) == set(out.columns)
    assert sorted(Counter(r["shard"] for r in rows).values()) == [25] * 3 + [26] * 5


# --- against SQL on the given tables -----------------------------------------


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op13_feistel_shards"])
def test_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    plain = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False)), key=str)
    assert plain(got) == plain(want)


# --- the tuned factor of the nearest-neighbour search ------------------------


def test_tuned_factor_prunes_clusters_and_keeps_recall(spark):
    """64 dimensions: where vectors lie in clusters most pairs are pruned, on the distributed path recall stays."""
    from nadir.llm import vptree

    rng = np.random.default_rng(8)
    c = rng.normal(size=(60, 64))
    m = c[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 64))
    u = vptree.units(m)
    top = vptree.Tree(u, leaf=1000)
    factor = vptree.tuned_factor(u, top, 5, 0.97)
    tree = vptree.Tree(u[:4096])
    tree.search(u[:96], 6, factor)
    assert tree.compared < 0.5 * 96 * 4096 and factor < 0.85
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(6000)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(df, shard_rows=1024, sample_rows=4096).collect()}
    q = np.arange(0, 6000, 50)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -9
    want = {(int(i), int(j)) for r, i in enumerate(q) for j in np.argsort(-s[r])[:5]}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


# --- hot ids and repeated sentences in earlier operators ---------------------


def test_a_null_id_on_many_rows_is_divided(spark, tmp_path):
    from nadir.llm import mixing, tokenfile
    from nadir.llm.queries import vocabulary

    df = spark.createDataFrame([(None, f"word{i} and some more words", "a") for i in range(3000)], SCHEMA)
    out = mixing.mix(df, shard_tokens=500).collect()
    assert len(out) == 3000 and abs(sum(r["taken"] for r in out) - sum(r["size"] for r in out)) <= 300
    path = str(tmp_path / "tokens")
    tokenfile.write_token_files(df, path, vocabulary("word_bpe_49k.json"), rows_per_file=500)
    assert spark.read.parquet(path).select("file").distinct().count() >= 4
    assert tokenfile.document_digests(spark, path).count() == 3000


def test_sentences_of_one_normal_form(spark):
    from nadir.llm import licenses

    df = spark.createDataFrame([(1, "Licensed under the X License. Foo.", "a")], SCHEMA)
    got = licenses.scan(df, ["Licensed under the X License.", "LICENSED under the x license"], [("X", (2,))]).first()
    assert (got["sentence_ids"], got["licences"], got["unmatched"]) == ("1", "X", "")


def test_pipeline_near_dedup_checks_the_links_of_fingerprints(spark, tmp_path, monkeypatch):
    import corpus_pipeline as c
    from nadir.llm import scratch, shinglesets, simhash

    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), size=6))
    base = [[word() for _ in range(400)] for _ in range(6)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)] + [(10 + k, " ".join([*b, word()])) for k, b in enumerate(base)] + [(50, "x y"), (51, "X y"), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # pairs span the components of op9
    pairs = [(r["a"], r["b"]) for r in simhash.linked_keys(docs, "doc_id", scratch.Scratch(spark, "test-links")).collect()]
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert label == {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} and len(set(label.values())) < len(rows) - 1
    # the stage asks for them, and a proposed pair counts only if it is similar
    asked, found = [], simhash.linked_keys
    monkeypatch.setattr(simhash, "linked_keys", lambda *a: asked.append(a[1]) or found(*a))
    assert sorted(r["doc_id"] for r in c.drop_near_duplicates(spark, docs, "").collect()) == [*range(6), 50, 52]
    assert asked == ["doc_set"]
    wrong = lambda keyed, key, s: keyed.select(F.min(key).alias("a"), F.max(key).alias("b"))
    assert shinglesets.representatives(docs, "test-wrong", wrong).count() == 8
