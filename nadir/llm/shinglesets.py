"""Near-duplicate documents by an exact set-similarity join of word shingles.

A document is the set of its shingles of five words, A-Z lower-cased; fewer
words are one shingle, no word (or null text) is the empty set. Documents are
linked at a Jaccard similarity of at least 4/5. Equal sets are merged first
and told apart by 64-bit hashes, as shingles are.

The join orders the shingles of a set by rarity (the count of a shingle's
bucket among 2**22) and files the set under each of its first
``size - ceil(4/5 size) + 1`` that occur elsewhere: two similar sets share one.
What meets passes the length and positional filters and a bound from the number
of shingles under which two sets meet, then one on the symmetric difference from
parity signatures, all exact; Jaccard is verified on whole sets made from the
texts. Only components are
asked for. The first round checks the pairs that fingerprints link (``simhash``),
where they are given; the second tries pairs with the least set of a posting list
and with the set before, some n pairs in a group of n near copies; the third
tries every pair left. Neither of these tries a pair whose ends are connected
already. No candidate is lost; a passage that is most of many otherwise different documents costs pairs
in the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components
from .linededup import _bitmap, _bucket, _by_rarity, _combined, _in_bloom, _slices, fewer_tasks
from .scratch import Scratch, partitions_for, rest_hash, session_of

WIDTH = 5
SIGNATURE = 1024
ENTRY = "token long, doc_set long, size int, place int"
PAIR = "a long, b long"
Linked = Callable[[DataFrame, str, Scratch], DataFrame]
MET = "a long, b long, met long, need long"


def shingles(part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every shingle of lower-cased texts, repeats included, in order of rows."""
    starts, ends, rows = W.scan(part, own)
    h = W.hash_spans(part, starts, ends)
    count = np.bincount(rows, minlength=len(own) - 1)
    first = np.cumsum(count) - count
    row, value = [], []
    for width in range(1, WIDTH + 1):
        at = first[count == width] if width < WIDTH else np.flatnonzero(np.arange(len(h)) - first[rows] <= count[rows] - WIDTH)
        s = np.full(len(at), width, np.uint64)
        for j in range(width):
            s = W.mix((s ^ h[at + j]) * W._K1 + W._K3)
        row.append(rows[at])
        value.append(s)
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


class ShingleSets:
    """The distinct shingles of each of some texts, in order of rows, with the hash and size of each set."""

    def __init__(self, part: np.ndarray, own: np.ndarray):
        row, value = shingles(part, own)
        self.key = W.mix(value ^ W.mix(row.astype(np.uint64) + W._K1))
        self.key, one = np.unique(self.key, return_index=True)
        order = np.argsort(row[one], kind="stable")
        self.key, one = self.key[order], one[order]
        self.row, self.value = row[one], value[one]
        self.size = np.bincount(self.row, minlength=len(own) - 1)
        hashed = np.zeros(len(own) - 1, np.uint64)
        some = np.flatnonzero(self.size)
        if len(some):
            hashed[some] = np.add.reduceat(W.mix(self.value + W._K1), (np.cumsum(self.size) - self.size)[some])
        self.hash = hashed.view(np.int64)

    def parities(self) -> list[bytes]:
        """SIGNATURE bits of each set; every shingle flips one, so two sets differ in at least as many shingles as bits."""
        out = []
        for low in range(0, len(self.size), 1024):
            some = slice(*np.searchsorted(self.row, (low, low + 1024)))
            n = min(1024, len(self.size) - low)
            cell = (self.row[some] - low) * SIGNATURE + (self.value[some] & np.uint64(SIGNATURE - 1)).astype(np.int64)
            odd = (np.bincount(cell, minlength=n * SIGNATURE) & 1).astype(bool).reshape(n, SIGNATURE)
            out.extend(x.tobytes() for x in np.packbits(odd, axis=1))
        return out


def _parts(column):
    """Texts of a column in parts: their place, bytes and offsets."""
    data, offsets = W.flat(column, lower=True)
    for a, b in W.chunks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def with_set(docs: DataFrame) -> DataFrame:
    """(doc_set long, row): the hash of each row's shingle set, and the row itself."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([T.StructField("doc_set", T.LongType()), row.schema["row"]])

    def run(batches):
        import pyarrow as pa

        for batch in W.trimmed(batches):
            found = [ShingleSets(part, own).hash for _, _, part, own in _parts(batch.column(0).field("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.int64)])), batch.column(0)], names=["doc_set", "row"])

    return row.mapInArrow(run, schema)


def _among(rows: DataFrame, bits, wanted: bool = True) -> DataFrame:
    """Rows whose first column, a long, is in a bitmap (or surely isn't in what it was made of)."""

    def run(batches):
        import pyarrow as pa

        for batch in W.trimmed(batches):
            yield batch.take(pa.array(np.flatnonzero(_in_bloom(bits.value, batch.column(0).to_numpy(zero_copy_only=False)) == wanted)))

    return rows.mapInArrow(run, rows.schema)


def _count_shingles(batches):
    """How often shingles of each bucket come: at least the number of their documents."""
    table, some = np.zeros(1 << 22, np.uint32), False
    for batch in W.trimmed(batches):
        for _, _, part, own in _parts(batch.column(0)):
            np.add.at(table, _bucket(shingles(part, own)[1]), np.uint32(1))
            some = True
    if some:
        yield _slices(table)


def _entries(counts):
    """Each set under the shingles of its prefix that may occur in other documents."""

    def run(batches):
        import pyarrow as pa

        table = counts.value
        for batch in W.trimmed(batches):
            for _, _, part, own in _parts(batch.column(0)):
                s = ShingleSets(part, own)
                first = np.zeros(len(s.size), bool)
                first[np.unique(s.hash, return_index=True)[1]] = True
                kept = first[s.row]
                row, value = s.row[kept], s.value[kept]
                often = table[_bucket(value)]
                order = _by_rarity(row, often, value)
                row, value, often = row[order], value[order], often[order]
                start = np.flatnonzero(np.diff(row, prepend=-1))
                place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
                size = s.size[row]
                pick = (place < size - (4 * size + 4) // 5 + 1) & (often > 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (value[pick].view(np.int64), s.hash[row[pick]], size[pick].astype(np.int32), place[pick].astype(np.int32))], names=["token", "doc_set", "size", "place"])

    return run


# --- posting lists -----------------------------------------------------------


def _runs(batches):
    """Columns of a sorted table, cut only where the first changes."""
    held: list[tuple[np.ndarray, ...]] = []

    def joined(parts):
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    for batch in W.trimmed(batches):
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
        if not len(cols[0]):
            continue
        held.append(cols)
        if held[0][0][0] != cols[0][-1]:
            whole = joined(held)
            cut = int(np.searchsorted(whole[0], whole[0][-1], side="left"))
            yield [c[:cut] for c in whole]
            held = [tuple(c[cut:] for c in whole)]
    if held:
        yield joined(held)


def _once(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Without rows that repeat the token and set of the row before."""
    fresh = np.ones(len(cols[0]), bool)
    fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    return [c[fresh] for c in cols]


def _shared(batches):
    """Posting lists of at least two sets."""
    import pyarrow as pa

    for cols in _runs(batches):
        cols = _once(cols)
        same = cols[0][1:] == cols[0][:-1]
        more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in cols], names=["token", "doc_set", "size", "place"])


def _pairs(doc_set, size, place, a, b):
    """Those of the pairs of rows (a, b) that the length and positional filters let through.

    ``met``: under how many shingles; ``need``: under how many they meet at least if they are similar.
    """
    import pyarrow as pa

    na, nb, pa_, pb = (x.astype(np.int64) for x in (size[a], size[b], place[a], place[b]))
    common = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    ok = (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * common >= 4 * (na + nb))
    x, y = doc_set[a[ok]], doc_set[b[ok]]
    x, y = np.minimum(x, y), np.maximum(x, y)
    sizes = na[ok] + nb[ok]
    # shared elements that are not in both prefixes lie in the rest of the set whose prefix ends first
    rest = np.maximum(*((4 * n + 4) // 5 - 1 for n in (na[ok], nb[ok])))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(fresh)
    met = np.diff(np.append(at, len(x)))
    need = ((4 * sizes + 8) // 9 - rest)[order][at]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (x[at], y[at], met, need)], names=["a", "b", "met", "need"])


def _stars(batches):
    """Each set with the least of its posting list and class of sizes, and with the one before; sorted by (token, size, set)."""
    for cols in _runs(batches):
        token, doc_set, size, place = _once(cols)
        level = np.floor(np.log(size) / np.log(1.25)).astype(np.int64)
        at = np.arange(len(token))
        same = np.concatenate([[False], token[1:] == token[:-1]])
        new = ~same | np.concatenate([[True], level[1:] != level[:-1]])
        least = np.maximum.accumulate(np.where(new, at, 0))
        far, near = at[least != at], at[same]
        yield _pairs(doc_set, size, place, np.concatenate([least[far], near - 1]), np.concatenate([far, near]))


def _crossing(batches, most: int = 1 << 20):
    """All pairs in a posting list with different roots; sorted by (token, root, set)."""
    for token, doc_set, size, place, root in _runs(batches):
        n = len(token)
        run = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        group = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (root[1:] != root[:-1])]))
        run_end = np.repeat(np.append(run[1:], n), np.diff(np.append(run, n)))
        group_end = np.repeat(np.append(group[1:], n), np.diff(np.append(group, n)))
        at = np.flatnonzero(run_end > group_end)
        left = run_end[at] - group_end[at]
        done = np.cumsum(left)
        total = int(done[-1]) if len(done) else 0
        for low in range(0, total, most):
            k = np.arange(low, min(low + most, total))
            own = np.searchsorted(done, k, side="right")
            yield _pairs(doc_set, size, place, at[own], group_end[at[own]] + k - (done[own] - left[own]))


def _signed(batches):
    """(doc_set, size, signature) of sets, from a text of each."""
    import pyarrow as pa

    for batch in W.trimmed(batches):
        for a, b, part, own in _parts(batch.column(1)):
            s = ShingleSets(part, own)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s.size.astype(np.int64)), pa.array(s.parities(), pa.binary())], names=["doc_set", "size", "signature"])


def _may_be_similar(batches):
    """The pairs whose signatures differ in no more bits than similar sets of their sizes may."""
    import pyarrow as pa

    for batch in W.trimmed(batches):
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
        u, v = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64) for i in (3, 5))
        at = pa.array(np.flatnonzero(9 * np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64) <= na + nb))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


def _similar(batches):
    """The pairs (a, b) whose texts have a Jaccard similarity of at least 4/5."""
    import pyarrow as pa

    for batch in W.trimmed(batches):
        (left, lo), (right, ro) = (W.flat(batch.column(i), lower=True) for i in (2, 3))
        held = [np.zeros(0, np.int64)]
        for a, b in W.chunks(lo + ro):
            x = ShingleSets(left[lo[a] : lo[b]], lo[a : b + 1] - lo[a])
            y = ShingleSets(right[ro[a] : ro[b]], ro[a : b + 1] - ro[a])
            common = np.bincount(x.row[np.isin(x.key, y.key)], minlength=b - a)
            held.append(a + np.flatnonzero(9 * common >= 4 * (x.size + y.size)))
        at = pa.array(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


def set_components(keyed: DataFrame, scratch: Scratch, linked: Linked | None = None) -> DataFrame:
    """(doc_set, root) of the shingle sets of ``keyed`` (doc_set, text) that are linked to another one.

    ``linked`` proposes pairs of sets (a, b) that are checked before all others.
    """
    spark = keyed.sparkSession
    texts = keyed.select("text")
    table = _combined(fewer_tasks(texts).mapInArrow(_count_shingles, "slice int, payload binary"), "uint32", bitwise=False)
    most = int(table.sum(dtype=np.uint64)) // 5
    counts = spark.sparkContext.broadcast(np.minimum(table, 0xFFFFFFFF).astype(np.uint32))
    parts = partitions_for(spark, most, 2_000_000)

    def posting_lists() -> DataFrame:
        dealt = texts.mapInArrow(_entries(counts), ENTRY).repartition(parts, "token").sortWithinPartitions("token", "size", "doc_set")
        return scratch.table("shared", dealt.mapInArrow(_shared, ENTRY))

    shared = posting_lists()
    scratch.release()

    def verified(name: str, pairs: DataFrame) -> DataFrame:
        pairs = scratch.table(f"{name}-pairs", pairs)
        scratch.release()
        ends = pairs.select(F.col("a").alias("doc_set")).union(pairs.select("b"))
        # a text of each set; the bitmap keeps all other texts from being shuffled
        needed = _among(keyed, _bitmap(spark, ends)).join(ends.distinct(), "doc_set", "left_semi").groupBy("doc_set").agg(F.min("text").alias("text"))
        needed = scratch.table(f"{name}-texts", needed)
        signed = scratch.table(f"{name}-signed", needed.select("doc_set", "text").mapInArrow(_signed, "doc_set long, size long, signature binary"))
        ends = [signed.select(F.col("doc_set").alias(x), F.col("size").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab"]
        close = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "sa", "nb", "sb")
        pairs = scratch.table(f"{name}-close", close.mapInArrow(_may_be_similar, PAIR))
        both = pairs.join(needed.select(F.col("doc_set").alias("a"), F.col("text").alias("ta")), "a").join(needed.select(F.col("doc_set").alias("b"), F.col("text").alias("tb")), "b")
        out = scratch.table(f"{name}-links", both.select("a", "b", "ta", "tb").mapInArrow(_similar, PAIR))
        for used in ("texts", "signed", "close"):
            scratch.drop(f"{name}-{used}")
        return out

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends aren't connected yet."""
        root = lambda x: roots.select(F.col("doc_set").alias(x), F.col("root").alias(f"r{x}"))
        return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    def stars() -> DataFrame:
        return shared.repartition(parts, "token").sortWithinPartitions("token", "size", "doc_set").mapInArrow(_stars, MET).select("a", "b").distinct()

    def crossing() -> DataFrame:
        rooted = shared.join(roots, "doc_set", "left").select("token", "doc_set", "size", "place", F.coalesce("root", "doc_set").alias("root"))
        met = rooted.repartition(parts, "token").sortWithinPartitions("token", "root", "doc_set").mapInArrow(_crossing, MET)
        return met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need")).where("met >= need").select("a", "b")

    if linked is None:
        links = verified("stars", stars())
    else:
        links = verified("prints", linked(keyed, "doc_set", scratch))
        roots = scratch.table("print-roots", components(links, scratch, "cc-prints").withColumnRenamed("node", "doc_set"))
        scratch.release()
        links = links.union(verified("stars", apart(stars())))
    scratch.release()
    roots = scratch.table("roots", components(links, scratch, "cc-stars").withColumnRenamed("node", "doc_set"))
    links = links.union(verified("crossing", crossing()))
    scratch.drop("shared")
    scratch.release()
    return scratch.table("all-roots", components(links, scratch, "cc-all").withColumnRenamed("node", "doc_set"))


def with_component(docs: DataFrame, scratch_group: str = "shingles") -> DataFrame:
    """(root long, row) of every row of ``docs`` (text, any more columns): rows of a component share a root."""
    spark = session_of(docs)
    scratch = Scratch(spark, scratch_group)
    keyed = scratch.table("keyed", with_set(docs))
    roots = set_components(keyed.select("doc_set", F.col("row.text").alias("text")), scratch)
    return keyed.join(roots, "doc_set", "left").select(F.coalesce("root", "doc_set").alias("root"), "row")


def representatives(docs: DataFrame, scratch_group: str = "shingles", linked: Linked | None = None) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text, any more columns): that of the least doc_id, null last, then of the least text.

    Rows that are alike in both differ by a hash of all columns. Only rows whose
    shingle set has a link or comes more than once (and the few that a bitmap
    takes for such) are grouped, by an aggregate that leaves a row of each
    component to each task before anything is shuffled; all others stay as they are.
    ``linked``: see ``set_components``.
    """
    spark = session_of(docs)
    scratch = Scratch(spark, scratch_group)
    keyed = scratch.table("keyed", with_set(docs))
    roots = set_components(keyed.select("doc_set", F.col("row.text").alias("text")), scratch, linked)
    again = keyed.groupBy("doc_set").agg(F.count("*").alias("n")).where("n > 1").select("doc_set")
    bits = _bitmap(spark, again.union(roots.select("doc_set")))
    alone = _among(keyed, bits, wanted=False).select("row")
    grouped = _among(keyed, bits).join(roots, "doc_set", "left").withColumn("root", F.coalesce("root", "doc_set"))
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), rest_hash("row", docs.schema).alias("rest"))
    first = grouped.groupBy("root").agg(F.min_by("row", order).alias("row"))
    return alone.unionAll(first.select("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
