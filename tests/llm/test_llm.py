"""The training-data operators against brute force on small frames, with the awkward rows of each."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nadir.llm import chat, components, katz, licenses, linededup, mixing, pieces, quality, scratch, simhash, tokenfile, vptree
from nadir.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["rank", "lines", "row", "nth", "c0", "text_hash", "fold", "h1", "part", "n_lines"]


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 1) % 5 else None, None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH)) if extra else df


def awkward():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghé"), size=rng.integers(2, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocab, size=n))
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "no id at all here"), (5, "Same line of five words\n" * 3), (6, "x" * 300_000), (7, text(40_000)), (8, "a b " * 500)]
    base = text(120)
    out += [(10, base), (11, base), (12, base + " tail"), (13, base.upper()), (14, "\n".join(text(12) for _ in range(30)))]
    out += [(20 + i, text(60) + "\n" + text(9) + "\n\n" + base[:200]) for i in range(25)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward(), extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") if lower else text or ""
    return WORD.findall(t)


# --- mixing ------------------------------------------------------------------


def test_sainte_lague_takes_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(30):
        t = rng.integers(0, 50, size=5).astype(float).tolist()
        most, seats = rng.integers(0, 9, size=5).tolist(), int(rng.integers(0, 25))
        want, got = [0] * 5, mixing.sainte_lague(t, seats, most)
        for _ in range(min(seats, sum(m for x, m in zip(t, most, strict=True) if x > 0))):
            i = max((i for i in range(5) if t[i] > 0 and want[i] < most[i]), key=lambda i: (t[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert got == want


def test_capped_shares():
    out = mixing.capped_shares([10, 100, 5, 0], [5, 2, 1, 9], 3)
    assert abs(sum(out) - 115) < 1e-9 and all(o <= 3 * s + 1e-9 for o, s in zip(out, [10, 100, 5, 0], strict=True))


def test_mix(spark, docs, empty):
    out = mixing.mix(docs, shard_tokens=2000).collect()
    assert len(out) == docs.count() and sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, shard_tokens=2000).collect()))
    by = defaultdict(list)
    for r in out:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["passes"] * r["size"] + sum(p["length"] for p in r["pieces"])
        by[r["source"]].append(r)
    for rows in by.values():
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(32, 0.02 * rows[0]["target"])
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(docs, shard_tokens=2000)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.select("text").collect()) == sum(r["taken"] for r in out)


def test_mix_of_nothing_but_nulls(spark):
    out = mixing.mix(frame(spark, [(1, None), (None, "")])).collect()
    assert [r["taken"] for r in out] == [0, 0]


# --- nearest neighbours ------------------------------------------------------


def test_tree_with_factor_one_is_exact():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(3000, 8))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    _, got = vptree.Tree(p, leaf=16).search(p[:50], 5, 1.0)
    want = np.argsort(vptree.distances(p[:50], p), axis=1, kind="stable")[:, :5]
    assert all(set(g) == set(w) for g, w in zip(got.tolist(), want.tolist(), strict=True))


def test_nearest(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 8))
    m[100:160] = m[50]  # many equal vectors
    rows = [(i, m[i].tolist()) for i in range(400)] + [(900, None), (950, [0.0] * 8), (1000, [float("nan")] * 8), (1050, [1.0, None] + [0.0] * 6), (1100, []), (None, m[0].tolist()), (1150, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for r in vptree.nearest(df, shard_rows=40, sample_rows=100, factor=1.0).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(out) == {i for i in range(0, 400, 50)}  # the lone vector of two dimensions has no candidates
    for q, got in out.items():
        s = vptree.cosine(np.repeat(m[[q]], 400, 0), m)
        want = sorted((x for x in range(400) if x != q), key=lambda x: (-s[x], x))[:5]
        assert [i for i, _ in got] == want and all(abs(v - s[i]) < 1e-15 for i, v in got)
    assert vptree.nearest(df.where("vec_id is null")).count() == 0
    few = vptree.nearest(df.where("vec_id in (50, 3, 4)")).collect()
    assert [r["rank"] for r in few] == [1, 2]
    clash = df.select("*", *(F.lit(1).alias(c) for c in (*CLASH, "dim", "hash", "vector", "cell", "point", "ids", "bound")))
    assert sorted(map(str, vptree.nearest(clash, factor=1.0).collect())) == sorted(map(str, vptree.nearest(df.union(df), factor=1.0).collect()))


@pytest.mark.parametrize("factor", [0.7, 1.0])
def test_scaled_copies_tie_to_the_least_ids(spark, factor):
    v = np.random.default_rng(4).normal(size=8)
    rows = [(0, v.tolist())] + [(i, (v * 2.0 ** (i % 13 - 6)).tolist()) for i in range(1, 31)] + [(i, (v * i).tolist()) for i in range(31, 49)]
    out = vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), factor=factor).orderBy("rank").collect()
    m = np.array([x for _, x in rows])
    s = vptree.cosine(np.repeat(m[:1], len(m), 0), m)
    assert [r["vec_id"] for r in out] == sorted(range(1, 49), key=lambda x: (-s[x], x))[:5]


def clusters(n, dim=16, centres=60, seed=9):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, dim))


def test_recall_at_the_production_factor(spark):
    """On clustered vectors, over several cells and shards: recall at 5, and the share of pairs that are compared."""
    m = clusters(9000)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in vptree.nearest(df, shard_rows=1000).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit, hits = vptree.units(m), 0
    for q in range(0, 9000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:5].tolist()))
    assert hits / (5 * 180) >= 0.9
    tree = vptree.Tree(unit)
    tree.search(unit[::50], 6, 0.85)
    assert tree.compared < 0.5 * 180 * 9000


# --- Katz --------------------------------------------------------------------


def test_katz_against_brute_force(spark, docs):
    rows = docs.where("doc_id is not null").select("doc_id", "text").collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    token = [(r["doc_id"], [*words(r["text"], True), "</s>"]) for r in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for k, t in token:
        if not held(k):
            for v, w in zip(["<s>", *t], t, strict=False):
                uni[w] += 1
                bi[v, w] += 1
                ctx[v] += 1
    n, size = sum(uni.values()), len(uni)
    d1, d2 = (katz.good_turing([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in (uni, bi))
    cut = lambda d, c: d[c] * c if c <= 5 else c
    lost = n - sum(cut(d1, c) for c in uni.values())
    den, unk = (n, lost / n) if lost > 1e-9 else (n + 1, 1 / (n + 1))
    p1 = lambda w: cut(d1, uni[w]) / den if w in uni else unk
    after = defaultdict(list)
    for (v, w), c in bi.items():
        after[v].append((w, c))
    weight = {}
    for v, seen in after.items():
        left = ctx[v] - sum(cut(d2, c) for _, c in seen)
        base = ctx[v] if left > 1e-9 else ctx[v] + 1
        weight[v] = ((left if left > 1e-9 else 1) / base / (1 - sum(p1(w) for w, _ in seen)), base)
        total = sum(cut(d2, c) / base for _, c in seen) + weight[v][0] * (sum(p1(w) for w in uni if (v, w) not in bi) + unk)
        assert abs(total - 1) < 1e-9
    want = []
    for k, t in token:
        s = sum(math.log10(cut(d2, bi[v, w]) / weight[v][1] if (v, w) in bi else (weight[v][0] if v in weight else 1.0) * p1(w)) for v, w in zip(["<s>", *t], t, strict=False))
        want.append((k, held(k), len(t), sum(w in uni for w in t), n, round(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (size + 1))) for w in t), 4), round(s, 4)))
    out = katz.score_with_holdout(docs.where("doc_id is not null")).collect()
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in out]
    assert sorted(got) == sorted(want)


def test_katz_edges(spark, empty):
    assert katz.score_with_holdout(empty).count() == 0
    one = katz.score_with_holdout(frame(spark, [(None, None)])).collect()
    assert [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"]) for r in one] == [(None, False, 1, 1)]


# --- licences ----------------------------------------------------------------


def test_licences(spark, docs, empty):
    mit = "\n".join(licenses.SENTENCES[:3])
    wrapped = licenses.SENTENCES[0].replace(" and ", "\nand ") + "\n\n" + licenses.SENTENCES[1]
    texts = [(1, mit), (2, wrapped), (3, "heading\nReleased under the MIT License.\nmore"), (4, licenses.SENTENCES[2]), (5, None), (6, "This license is mine."), (7, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    out = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts, extra=True)).collect()}
    assert [out[i]["licences"] for i in range(1, 8)] == ["MIT", "MIT", "MIT", "", "", "", "MIT,CC-BY-NC-4.0"]
    assert out[4]["unmatched"] == "3" and out[1]["sentence_ids"] == "1,2,3" and out[6]["n_known"] == 0
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs).count() == docs.count()


def test_every_licence_rule_and_comment_headers(spark):
    runs = ["".join(f"<{n}>" for n in run) for _, run in licenses.RULES]
    texts = [(i, "\n\n".join(licenses.SENTENCES[n - 1] for n in run)) for i, (_, run) in enumerate(licenses.RULES)]
    out = {r["doc_id"]: r["licences"] for r in licenses.scan(frame(spark, texts)).collect()}
    for i, own in enumerate(runs):
        left, names = own, []
        for (name, _), run in zip(licenses.RULES, runs, strict=True):
            if run in left:
                left = left.replace(run, "|")
                names += [name] * (name not in names)
        assert out[i] == ",".join(names), licenses.RULES[i]
    for mark in ("#", "//", " *", ";;"):
        header = "\n".join(f"{mark} {x}".rstrip() for x in ("\n\n".join(licenses.SENTENCES[:2]) + "\n").split("\n"))
        assert licenses.scan(frame(spark, [(1, header)])).first()["licences"] == "MIT", mark
    own = licenses.scan(frame(spark, [(1, "This software is ours. Ask first.")]), ["This software is ours."], [("Ours", (1,))]).first()
    assert (own["licences"], own["n_known"]) == ("Ours", 1)


def test_licences_match_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    want = sorted(map(tuple, con.execute(licenses.scan_sql()).fetchdf().astype(str).values.tolist()))
    got = licenses.scan(spark.read.parquet(path))
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want


# --- line dedup --------------------------------------------------------------


def kept_lines(rows):
    """Brute force over (doc_id, text), doc_id null first, then line, then text."""
    lines = []
    for i, (k, t) in enumerate(rows):
        for n, x in enumerate((t or "").split("\n")):
            if words(x):
                lines.append(((k is not None, k or 0), n, i, frozenset(words(x))))
    gone, seen = set(), []
    for key, n, i, s in sorted(lines, key=lambda x: (x[0], x[1], x[2])):
        if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
            gone.add((i, n))
        seen.append(s)
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) if t else t for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("witnesses", [1, 3])
def test_line_dedup(spark, witnesses):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(30)]
    near = lambda k: " ".join(w if rng.random() > 0.05 else f"x{k}{j}" for j, w in enumerate(base))
    texts = [(i, "\n".join([near(i), "short one", "", " ".join(rng.choice(base, 6)), f"only here {i} and {i * 7} there"])) for i in range(80)]
    texts += [(200, None), (201, ""), (202, " \n "), (None, "null comes first\nshort one"), (5000, "\n".join(f"t{i} " * 4 + str(i) for i in range(300)))]
    out, lines, taken = linededup.dedup_lines(frame(spark, texts, extra=True), witnesses=witnesses)
    got = {r["doc_id"]: r for r in out.collect()}
    want = kept_lines(texts)
    assert {k: got[k]["text"] for k, _ in texts} == {k: w for (k, _), w in zip(texts, want, strict=True)}
    assert lines == "_n_lines" and out.columns[:15] == frame(spark, texts, extra=True).columns
    assert got[5000]["n_chars"] == len(got[5000]["text"])


def test_line_dedup_of_repeated_rows_and_empty(spark, empty):
    out, _, taken = linededup.dedup_lines(frame(spark, [(1, "a b c\n\nd e f"), (1, "a b c\n\nd e f")]))
    assert sorted(r["text"] for r in out.collect()) == ["", "a b c\n\nd e f"]
    assert linededup.dedup_lines(empty)[0].count() == 0


def test_counts_beyond_32_bits_and_lines_of_one_frequent_word(spark):
    rows = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "slice int, k int")

    def table(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            z = zstandard.ZstdCompressor()
            raw = [z.compress(np.full((1 << linededup.BUCKET_BITS) // linededup.SLICES, 0xFFFFFFF0, np.uint32).tobytes()) for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["slice", "payload"])

    total = linededup._combined(rows.mapInArrow(table, "slice int, payload binary"), "u4", False)
    width = (1 << linededup.BUCKET_BITS) // linededup.SLICES
    assert total[0] == 2 * 0xFFFFFFF0 and total[width] == 0xFFFFFFF0 and total[2 * width] == 0
    # one word in half of all lines, and the only one that some lines share
    texts = [(i, "\n".join([f"hot a{i} b{i}", f"hot c{i % 3} d{i % 3} e f g", f"k{i} l{i}", "hot"])) for i in range(120)]
    out, _, _ = linededup.dedup_lines(frame(spark, texts))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {k: w for (k, _), w in zip(texts, kept_lines(texts), strict=True)}


# --- pieces ------------------------------------------------------------------


def test_pieces_are_lossless_and_reproducible(spark, docs, empty):
    model = vocabulary("piece_bpe_32k.model")
    texts = [(1, "Hello  world\n▁x 日本語𝄞 é"), (2, None), (3, ""), (4, " "), (1, "Hello  world\n▁x 日本語𝄞 é")]
    df = docs.select("doc_id", "text").unionByName(frame(spark, texts).select("doc_id", "text"))
    a, b = pieces.encode(df, model).collect(), pieces.encode(df.repartition(3), model).collect()
    assert all(r["lossless"] for r in a) and sorted(map(str, a)) == sorted(map(str, b))
    assert all(r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes()) for r in a)
    back = pieces.decode(pieces.encode(df, model), model)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert pieces.encode(empty, model).count() == 0
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert sp.decode(next(r["ids"] for r in a if r["doc_id"] == 10)) == next(r["text"] for r in df.collect() if r["doc_id"] == 10)


def test_pieces_follow_their_distribution():
    import pyarrow as pa
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = {sp.id_to_piece(i): i for i in range(sp.get_piece_size())}
    weight = {}

    def walk(rest, ids, w):
        if not rest:
            weight[ids] = math.exp(w)
        for n in range(1, len(rest) + 1):
            if rest[:n] in vocab:
                walk(rest[n:], (*ids, vocab[rest[:n]]), w - 0.2 * math.log1p(-sp.get_score(vocab[rest[:n]])))

    walk("▁hello", (), 0.0)
    n, seen = 40_000, Counter()
    for ids, count in pieces.PieceModel(path, 0.2).encode(pa.array(["hello"] * n), np.arange(n).astype(np.uint64)):
        at = 0
        for c in count.tolist():
            seen[tuple(ids[at : at + c].tolist())] += 1
            at += c
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for k, w in weight.items():
        p = w / total
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


# --- quality -----------------------------------------------------------------


def test_quality_against_brute_force(spark, docs, empty):
    for r in quality.verdicts(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        t, w = r["text"] or "", words(r["text"])
        n = len(w)
        twice = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
        cover = {j for i in range(n - 7) if twice[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, dup = set(), 0
        for x in t.split("\n"):
            dup += bool(words(x)) and x in lines
            lines.add(x)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)), r["doc_id"]
        longest = 0
        while n - longest > 0 and len({hash(tuple(w[i : i + longest + 1])) for i in range(n - longest)}) < n - longest and n < 2000:
            longest += 1
        if n < 2000:  # the longest run of words found twice, and the verdict that follows
            assert r["longest_repeat"] == longest and r["covered_words"] == len(cover), r["doc_id"]
            assert r["kept"] == (n >= 20 and 100 * len(cover) <= 30 * n and longest <= 100)
        assert r["base_failed"] == (n < 20 or 100 * len(cover) > 30 * n) and not (r["kept"] and r["base_failed"])
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality.verdicts(docs).where("kept").collect())
    assert quality.verdicts(empty).count() == 0 and quality.kept_documents(empty).count() == 0


def test_longest_repeats():
    rng = np.random.default_rng(4)
    for _ in range(40):
        rows = np.sort(rng.integers(0, 3, size=60))
        w = rng.integers(0, 3, size=60).astype(np.uint64)
        got = quality.repeat_lengths(rows, w)
        for i in range(60):
            end = np.flatnonzero(rows == rows[i])[-1] + 1
            best = 0
            for j in np.flatnonzero(rows == rows[i]):
                k = 0
                while j != i and max(i, j) + k < end and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best


# --- token files -------------------------------------------------------------


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(6)
    for ids in (rng.integers(0, 6, size=5000), np.full(999, 3), np.zeros(0, np.int64), np.array([1])):
        seq, rules = tokenfile.repair(ids, 10)
        assert not len(seq) or max(Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)).values(), default=0) < 6
        assert len(tokenfile.repair(ids, 10, max_rounds=1)[0]) >= len(seq)
        block = tokenfile.Block(10, rules.astype("<u4").tobytes(), tokenfile.expansion_lengths(rules, 10).astype("<u4").tobytes(), seq.astype("<u4").tobytes(), 4)
        assert (block.ids(0, len(ids)) == ids).all() and len(seq) <= len(ids)
        for a in range(0, len(ids), 97):
            assert (block.ids(a, min(a + 13, len(ids))) == ids[a : a + 13]).all()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [(1, "It's <|endoftext|> ÀÉ é x\x0by 'll"), (100, "ΣΑΣ İstanbul 12 a.b!"), (-3, "first")]
    df = docs.select("doc_id", "text").unionByName(frame(spark, texts).select("doc_id", "text"))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()), r) for r in df.collect())
    want, at = [], 0
    for _, r in rows:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokenfile.encode_and_read_back(df, path, block_ids=5000, rows_per_file=8).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokenfile.encode_and_read_back(empty, path).count() == 0


AWKWARD_WORDS = "The the THE. é É Éa ÀÉ, straße ÿ × ÷ a×b it's IT'S 'll don't x1y 12 3.14 a.b a. . .. ?! ;; e\u0301 e\u0301. \u00a0x <|endoftext|> <|endoftext|>. Σας İ ŒUVRE œ ½ 日本 a\u200bb ... Word!? (a) -- a- -a ß ẞ"


@pytest.mark.parametrize("change", ["none", "keep case", "no splitting rule"])
def test_text_encoder_gives_what_the_tokenizer_gives(tmp_path, change):
    """By words, by words with case kept, or by whole texts, as the file's declared steps allow."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    declared = json.loads(open(vocabulary("word_bpe_49k.json")).read())
    if change == "keep case":
        declared["normalizer"]["normalizers"].pop()
    if change == "no splitting rule":
        declared["pre_tokenizer"]["pretokenizers"].pop(0)
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(declared))
    tok, encoder = Tokenizer.from_file(str(path)), tokenfile.TextEncoder(str(path), most=40)
    assert encoder.by_word == (change != "no splitting rule") and encoder.fold == (change != "keep case")
    rng = np.random.default_rng(8)
    texts = [None, "", " ", *AWKWARD_WORDS.split(" "), AWKWARD_WORDS, AWKWARD_WORDS.upper(), *(" ".join(rng.choice(AWKWARD_WORDS.split(" "), 9)) for _ in range(60)), "x" * 5000]
    for _ in range(2):  # unknown words, then known ones
        got = [(ids.tolist(), count.tolist()) for ids, count in encoder.batch(pa.array(texts), 1)]
        want = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert [i for ids, _ in got for i in ids] == [i for w in want for i in w]
        assert [n for _, count in got for n in count] == [len(w) for w in want]


# --- near duplicates ---------------------------------------------------------


def brute_components(prints, radius):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_near_duplicates(spark, docs, empty):
    import xxhash

    rows = docs.select("doc_id", "text").collect()
    prints = []
    for r in rows:
        w = words(r["text"], True)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = brute_components(prints, 4)
    group = defaultdict(list)
    for r, x in zip(rows, label, strict=True):
        if r["doc_id"] is not None:
            group[x].append(r["doc_id"])
    want = sorted(str((r["doc_id"], f"{p:016x}", min(group[x], default=None))) for r, p, x in zip(rows, prints, label, strict=True))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [1 << 15, 40])
def test_links_span_all_components(spark, hot):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, size=6, dtype=np.int64)
    flip = lambda x: int(x) ^ sum(1 << int(b) for b in rng.choice(63, size=rng.integers(0, 4), replace=False))
    prints = sorted({flip(centre[i % 6]) for i in range(400)} | {int(x) for x in rng.integers(0, 1 << 63, size=200, dtype=np.int64)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    s = scratch.Scratch(spark, "test")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, s, 4, hot), s).collect()}
    label = brute_components(prints, 4)
    assert [roots.get(p, p) for p in prints] == [prints[x] for x in label]


def test_thresholds_keep_the_pigeonhole():
    together = np.full((64, 64), 25.0) + np.eye(64) * 25
    for n in (10, 10**5, 10**9):
        plan = simhash.plan_index(n, together, 4)
        assert sum(t + 1 for _, t in plan) == 5 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


# --- chat --------------------------------------------------------------------


def conversations(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "user", None), (1, 2, "assistant", "[INST] </s> <\\|end|> \\ é"), (1, 3, "user", "x"), (1, 4, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (None, 0, None, "n"), (3, None, "we\nird\\", "t"), (3, None, "we\nird\\", "t")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"turn {i} <|turn|>") for i in range(200)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("position"), F.lit("q").alias("span"))


def test_chat_round_trip(spark):
    df = conversations(spark)
    by = defaultdict(list)
    for r in df.collect():
        by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: r for r in chat.format_and_read_back(df).collect()}
    assert set(got) == set(by)
    for k, turns in by.items():
        turns.sort()
        learned = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[k]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"], r["rewritten"]) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest(), False)
        assert r["formatted_chars"] == len(chat.render_turns([{"role": role, "text": t} for *_, role, t in turns]))
    assert chat.format_and_read_back(df.where("false")).count() == 0


def test_escapes_are_reversible():
    for t in ("<|end|>", "<\\|end|>", "<\\\\|end|>", "[INST][/INST]", "[\\INST]", "</s></s>", "\\", "<", "a<|turn|>b"):
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_history_rewriting_is_seen():
    strip = lambda turns: "".join(f"<{t['role']}>{t['text'] if i == len(turns) - 1 else '...'}\n" for i, t in enumerate(turns))
    r = chat.Renderer(strip)
    assert r.add("user", "hello")[3] is False and r.add("assistant", "there")[3] is True
    whole = chat.Renderer(lambda turns: "<s>" + "".join(f"[{t['role']}]{t['text']}|" for t in turns))
    span, a, b, bad = whole.add("user", "q")
    assert (span, a, bad) == ("<s>[user]q|", None, False)
    span, a, b, bad = whole.add("assistant", "answer")
    assert span[a:b] == "answer" and not bad


def test_a_rewrite_far_back_is_seen():
    late = lambda turns: "".join("[gone]" if i == 1 and len(turns) > 70 else f"[{t['role']}]{t['text']}|" for i, t in enumerate(turns))
    r = chat.Renderer(late)
    assert [r.add("user", f"turn {i}")[3] for i in range(75)] == [i == 70 for i in range(75)]
    numbered = lambda turns: "".join(f"{i}:{turns[0]['text']}:{t['text']}\n" for i, t in enumerate(turns))
    r = chat.Renderer(numbered)
    assert [r.add("assistant", f"t{i}") for i in range(70)][69] == ("69:t0:t69\n", 6, 9, False)
    own, whole = chat.Renderer(chat.render_turns), chat.Renderer(lambda turns: chat.render_turns(turns))
    assert all(own.add(role, f"<s> {i}") == whole.add(role, f"<s> {i}") for i, role in enumerate(["user", "assistant"] * 70))


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    rng = np.random.default_rng(9)
    text = lambda: "\n".join(" ".join("".join(rng.choice(list("abcdefgh"), size=6)) for _ in range(15)) for _ in range(4))
    rows = [(i, text()) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1].replace("a", "b", 1)), (102, "too short"), (103, None), (104, "again and again " * 40)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").distinct().collect()) for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert ids[1] == [*range(60), 100, 101] and 100 not in ids[2] and 101 not in ids[3] and ids[3] == [*range(60)]
    assert seen[5].where("not lossless").count() == 0 and seen[5].count() == seen[4].count()
    assert sorted(map(str, c.run(spark, str(tmp_path)).collect())) == sorted(map(str, seen[5].collect()))


def near_frame(spark):
    """Chains of copies at Jaccard 0.75 to 1, short texts, and unrelated ones with null or repeated doc_ids."""
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefgh"), size=6))
    rows = []
    for g in range(40):
        base = [word() for _ in range(int(rng.integers(40, 160)))]
        rows.append(base)
        for _ in range(int(rng.integers(1, 5))):
            base = list(base)
            for at in rng.choice(len(base), size=int(rng.integers(1, 5)), replace=False):
                base[at] = word()
            rows.append(base)
    hub = [word() for _ in range(120)]
    rows += [[*hub[:k], word(), *hub[k:]] for k in range(20, 100, 20)] + [hub, ["one"], ["One"], ["two"], []]
    out = [(1000 - i, " ".join(w)) for i, w in enumerate(rows)]
    out += [(None, " ".join(word() for _ in range(30))) for _ in range(3)] + [(5000, " ".join(word() for _ in range(30))) for _ in range(2)]
    out += [(None, out[0][1].upper() + " tail"), (None, None)]
    return frame(spark, out, extra=True)


def test_pipeline_near_duplicates_at_four_fifths(spark):
    import corpus_pipeline as c

    docs = near_frame(spark)
    rows = docs.select("doc_id", "text").collect()
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r["text"], True)) else set() for r in rows]
    label, changed = list(range(len(rows))), True
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    group = defaultdict(list)
    for r, x in zip(rows, label, strict=True):
        group[x].append((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["doc_id"], r["text"]))
    got = c.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(str(min(g)[3:]) for g in group.values())
    assert c.drop_near_duplicates(spark, docs.where("false"), "").count() == 0


def test_pipeline_near_dedup_keeps_unrelated_rows_that_share_an_id(spark):
    import corpus_pipeline as c

    texts = [" ".join(f"{g}{i}" for i in range(20)) for g in "abcdef"]
    docs = frame(spark, [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (None, texts[5])])
    got = sorted(str((r["doc_id"], r["text"])) for r in c.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(str(x) for x in [*((None, t) for t in texts[:3]), (7, texts[3]), (7, texts[4]), (8, texts[5])])
    assert c.drop_near_duplicates(spark, docs.where("doc_id = 100"), "").count() == 0
