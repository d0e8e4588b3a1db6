"""SimHash near-duplicates found by a generalised pigeonhole index.

Fingerprints: majority bits of the 64-bit XXH64 values of word shingles.
Links: fingerprints at ``radius`` or fewer differing bits. Equal fingerprints
are merged first, so exact copies cost nothing further.

Search. Correlated bits are grouped into m partitions of the 64 bits. If
thresholds t_1..t_m (each -1 or more) have sum(t_i + 1) = radius + 1, two
linked fingerprints differ in at most t_i bits of some partition i. A dynamic
programme allots unequal thresholds by the candidate counts estimated from the
bits' frequencies, for every m, and the cheapest plan is taken. Each
fingerprint is filed under its own value of every partition and probes the
greater values within t_i bits (one of two linked values is the lesser).
What meets in a bucket is verified; a bucket gives a spanning forest of its
links, not all pairs. Buckets over ``hot`` entries are divided into blocks,
each pair of which is a bucket of its own.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components
from .scratch import Scratch, partitions_for, session_of

BITS = 64


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fingerprint long) of every row: A-Z lower-cased, words joined by a space.

    Fewer words than a shingle: the whole sequence is the one shingle. No word
    or null text: fingerprint zero. A bit is 1 if it is set in over half the
    values, repeats included. Rows are independent; repeated rows give equal
    rows.
    """
    session_of(docs)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle_words), schema)


def _fingerprints(width: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        h64 = xxhash.xxh64_intdigest

        def majority(values: list[int]) -> int:
            ones = np.zeros(BITS, np.int64)
            for at in range(0, len(values), 1 << 16):
                part = np.array(values[at : at + (1 << 16)], dtype="<u8")
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])

        for batch in W.trimmed(batches):
            prints = []
            for text in batch.column(1).to_pylist():
                words = text.encode().lower().split() if text else []
                if not words:
                    prints.append(0)
                    continue
                joined = b" ".join(words)
                n = len(words)
                if n <= width:
                    prints.append(majority([h64(joined, 42)]))
                    continue
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                prints.append(majority([h64(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fingerprint"])

    return run


# --- the plan of the index ---------------------------------------------------


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 counts of bits set together, over all fingerprints."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((BITS, BITS))
        n = 0
        for batch in W.trimmed(batches):
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.column(0).slice(at, 1 << 14).to_numpy(zero_copy_only=False).astype("<i8")
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = dict(prints.select("fingerprint").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())  # 4097 rows at any size
    return cells.get(BITS * BITS, 0), np.array([cells.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` equal groups, each grown from a seed by the greatest mean correlation."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        want = len(left) // (parts - k)
        seed = max(left, key=lambda b: (corr[b, left].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < want:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def plan_index(n: int, together: np.ndarray, radius: int, probe_cost: float = 200.0) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds; groups with threshold -1 are left out.

    Costs are in verified candidates; a probe (a row that is shuffled and
    sorted) counts as ``probe_cost`` of them.
    """
    p = np.diag(together) / max(n, 1)
    best, plan = math.inf, []
    for parts in range(2, radius + 2):
        groups = group_bits(n, together, parts)
        cost = []
        for group in groups:
            within = np.zeros(radius + 2)
            within[0] = 1.0
            for b in group:  # bits of a random pair that differ: Poisson binomial
                d = 2 * p[b] * (1 - p[b])
                within[1:] = within[1:] * (1 - d) + within[:-1] * d
                within[0] *= 1 - d
            near = np.cumsum(within)
            cost.append([0.0] + [n * n / 2 * near[t] + probe_cost * n * (1 + sum(math.comb(len(group), j) for j in range(1, t + 1)) / 2) for t in range(radius + 1)])
        # least cost of groups k.. with so much of radius + 1 still to allot
        least: list[list[tuple[float, int]]] = [[(0.0 if need == 0 else math.inf, 0) for need in range(radius + 2)]]
        for c in reversed(cost):
            least.append([min((c[x] + least[-1][need - x][0], x) for x in range(need + 1)) for need in range(radius + 2)])
        total, need = least[-1][radius + 1][0], radius + 1
        if total < best:
            best, plan = total, []
            for k, group in enumerate(groups):
                x = least[parts - k][need][1]
                need -= x
                if x:
                    plan.append((group, x - 1))
    return plan


# --- probing -----------------------------------------------------------------


def _entries(plan: list[tuple[list[int], int]]):
    """(key, fingerprint): key is the partition and a value of its bits."""
    flips = []
    for group, t in plan:
        masks = [sum(1 << i for i in c) for j in range(1, t + 1) for c in combinations(range(len(group)), j)]
        flips.append(np.array(masks, dtype=np.uint64))

    def run(batches):
        import pyarrow as pa

        for batch in W.trimmed(batches):
            for at in range(0, batch.num_rows, 1 << 12):
                fps = batch.column(0).slice(at, 1 << 12).to_numpy(zero_copy_only=False).astype("<i8")
                u = fps.view("<u8")
                for k, (group, _) in enumerate(plan):
                    value = np.zeros(len(u), np.uint64)
                    for i, b in enumerate(group):
                        value |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
                    tag = np.uint64(k << 40)
                    keys, own = [value | tag], [fps]
                    for m in flips[k]:
                        near = value ^ m
                        up = near > value
                        keys.append(near[up] | tag)
                        own.append(fps[up])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(own))], names=["key", "fp"])

    return run


def _links(radius: int):
    """Spanning links of each run of equal keys; input is sorted by (key, fp)."""
    wide = 48

    def forest(u: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, left = [], u
        while len(left) > 1:
            front, left = [left[0]], left[1:]
            while front and len(left):
                near = np.bitwise_count(left ^ front[-1]) <= radius
                head = front.pop()
                if near.any():
                    got = left[near]
                    out.append((np.full(len(got), head), got))
                    front.extend(got)
                    left = left[~near]
        return out

    def run(batches):
        import pyarrow as pa

        def linked(key: np.ndarray, fp: np.ndarray):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            room = np.repeat(first + size, size) - np.arange(len(key)) - 1  # followers in the same run
            large = size > wide
            in_large = np.repeat(large, size)
            at = np.flatnonzero((room > 0) & ~in_large)
            pairs = []
            step = 1
            while len(at):
                ok = (np.bitwise_count(fp[at] ^ fp[at + step]) <= radius) & (fp[at] != fp[at + step])
                pairs.append((fp[at[ok]], fp[at[ok] + step]))
                step += 1
                at = at[room[at] >= step]
            for f, s in zip(first[large], size[large], strict=True):
                pairs.extend(forest(np.unique(fp[f : f + s])))
            a = np.concatenate([x for x, _ in pairs] or [np.zeros(0, np.uint64)]).astype("<u8").view("<i8")
            b = np.concatenate([x for _, x in pairs] or [np.zeros(0, np.uint64)]).astype("<u8").view("<i8")
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        keys, fps = [], []
        for batch in W.trimmed(batches):
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys.append(key)
            fps.append(fp.view("<u8") if fp.dtype == np.int64 else fp.astype("<u8"))
            if len(key) and keys[0][0] != key[-1]:  # the last run may go on in the next batch
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(key, key[-1], side="left"))
                yield linked(key[:cut], fp[:cut])
                keys, fps = [key[cut:]], [fp[cut:]]
        if keys and sum(map(len, keys)):
            yield linked(np.concatenate(keys), np.concatenate(fps))

    return run


def links(prints: DataFrame, scratch: Scratch, radius: int = 4, hot: int = 1 << 15) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every component at ``radius``."""
    spark = prints.sparkSession
    n, together = bit_counts(prints)
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    plan = plan_index(n, together, radius)
    entries = prints.select("fingerprint").mapInArrow(_entries(plan), "key long, fp long")
    per = sum(1 + sum(math.comb(len(g), j) for j in range(1, t + 1)) / 2 for g, t in plan)
    buckets = 1 << 16  # a bound on what the driver gets: only buckets that are full can hold a hot key
    full = [r[0] for r in entries.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).count().where(F.col("count") > hot).collect()]
    rows = entries
    if full and n * per > hot:
        many = entries.where(F.pmod(F.xxhash64("key"), F.lit(buckets)).isin(full)).groupBy("key").count().where(F.col("count") > hot)
        many = scratch.table("hot", many.select("key", F.ceil(F.col("count") / hot).cast("int").alias("blocks")))
        marked = entries.join(many, "key", "left")
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
        pair = F.transform(others, lambda j: F.xxhash64("key", F.least(block, j), F.greatest(block, j)).bitwiseOR(F.lit(-(1 << 63))))
        rows = marked.select(F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pair)).alias("key"), "fp")
    dealt = rows.repartition(partitions_for(spark, int(n * per), 2_000_000), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_links(radius), "a long, b long").distinct()


def linked_keys(texts: DataFrame, key: str, scratch: Scratch, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """(a, b), a < b: keys of ``texts`` (key long, text) whose fingerprints link; the pairs span every component, and aren't all of its pairs.

    Keys of one fingerprint are linked to the least of them, and least keys of
    linked fingerprints to each other. A key may come with several texts.
    """
    session_of(texts)
    prints = scratch.table("prints", fingerprints(texts.select(F.col(key).alias("doc_id"), "text"), shingle_words).distinct())
    distinct = scratch.table("distinct", prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    edges = links(distinct, scratch, radius)
    same = prints.join(distinct, "fingerprint").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    end = lambda x: distinct.select(F.col("fingerprint").alias(x), F.col("least").alias(f"key_{x}"))
    across = edges.join(end("a"), "a").join(end("b"), "b").select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
    return same.unionAll(across).where("a < b").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4, scratch_group: str = "simhash") -> DataFrame:
    """(doc_id, fingerprint string, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links, the row's own
    included; fingerprint is 16 lower-case hex digits. Null text and text
    without words have fingerprint zero and link like any other. Null doc_id:
    least of all only where its component has no other. Repeated rows come
    out as often as they came; extra columns are ignored; an empty table gives
    no rows.
    """
    spark = session_of(docs)
    scratch = Scratch(spark, scratch_group)
    prints = scratch.table("prints", fingerprints(docs, shingle_words))
    distinct = scratch.table("distinct", prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    edges = links(distinct, scratch, radius)
    roots = scratch.table("roots", components(edges, scratch).withColumnRenamed("node", "fingerprint"))
    named = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.table("classes", named.join(least, "root").select("fingerprint", "component_id"))
    return prints.join(classes, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
