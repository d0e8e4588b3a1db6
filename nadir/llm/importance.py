"""Target-distribution importance resampling over hashed word runs.

A document's features are its runs of one to three words, hashed into buckets.
A bucket's gain is the scaled logarithm of its share in the target corpus over
that in the source corpus; a document's weight is the sum of its features'
gains, and documents are drawn by weight plus Gumbel noise.

1. Texts are taken apart once. Each block of up to ``BLOCK_DOCS`` documents is
   written as inverted postings (bucket, document, count), packed in one row for
   each part of the buckets; each task adds its sums by bucket. The target's
   texts give sums only.
2. Sums are added by (corpus, bucket), so a bucket that every document has is a
   few rows a task long before it is shuffled.
3. Postings are shuffled by cell: a part of the buckets and a share of the blocks,
   so that a cell is some ``CELL_BLOCKS`` rows however many documents hold a bucket. Each
   cell is co-grouped with the sums of its part in both corpora, computes its
   buckets' gains from them, and emits what each document of a block gets.
4. Those contributions are reduced by document: a block has one row for each part.
5. Scores are put in order by range partitions; counts of partitions give ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .scratch import Scratch, partitions_for, session_of

#: Bounds of a block of documents whose postings are packed together.
BLOCK_DOCS, BLOCK_FEATURES = 1024, 1 << 20
#: Blocks that a cell has on average.
CELL_BLOCKS = 64
#: Rows of a range partition of scores.
ORDER_ROWS = 1 << 20

# Bytes of words after lower-casing are digits, small letters and all of other code points.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 byte table, and for each bit of a length the tables that move a checksum past that many bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)

    def past_zero(c: np.ndarray) -> np.ndarray:
        return byte[c & 0xFF] ^ (c >> 8)

    at = np.arange(256, dtype=np.uint32)
    moves = np.stack([past_zero(at << np.uint32(8 * k)) for k in range(4)])[None]  # past one byte
    for _ in range(39):
        last = moves[-1]
        moves = np.concatenate([moves, np.stack([_moved(x, last) for x in last])[None]])
    return byte, moves


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


_BYTE, _MOVES = _crc_tables()


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of texts end to end, from those of both and the second one's length in bytes."""
    out = first.copy()
    bits = int(length.max(initial=0)).bit_length()
    for k in range(bits):
        at = np.flatnonzero((length >> k) & 1)
        out[at] = _moved(out[at], _MOVES[k])
    return out ^ second


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = 48) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    size = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, long), kind="stable")
    at, n, c = starts[order], np.minimum(size, long)[order], crc
    for j in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -j, side="left"))  # spans of more than j bytes
        c[:m] = _BYTE[(c[:m] ^ data[at[:m] + j]) & 0xFF] ^ (c[:m] >> 8)
    out = np.empty(len(starts), np.uint32)
    out[order] = ~c
    for i in np.flatnonzero(size > long):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it is in."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = np.concatenate([[False], _WORD[data], [False]])
    cut = np.zeros(len(data) + 2, bool)
    cut[offsets + 1] = True  # no word crosses from one row into the next
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[1:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[2:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every run of one to three words, and the words of each row; ``data`` is lower-cased."""
    starts, ends, rows = word_spans(data, offsets)
    size = ends - starts
    one = span_crcs(data, starts, ends)
    blank = ~(_BYTE[(~one ^ np.uint32(32)) & 0xFF] ^ (~one >> 8))  # each word and a blank
    two = rows[1:] == rows[:-1]
    first = np.flatnonzero(two)
    pair = joined(blank[first], one[first + 1], size[first + 1])
    three = np.flatnonzero(two[1:] & two[:-1])
    at = np.zeros(len(rows), np.int64)
    at[first] = np.arange(len(first))
    triple = joined(blank[three], pair[at[three + 1]], size[three + 1] + 1 + size[three + 2])
    row = np.concatenate([rows, rows[first], rows[three]])
    return row, np.concatenate([one, pair, triple]) % np.uint32(buckets), np.bincount(rows, minlength=len(offsets) - 1)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in planes of bytes, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.reshape(-1).view("<i8")


BLOCKS = "part int, block long, n_docs int, keys binary, counts binary, doc_ids array<long>, n_words array<long>, n_features array<long>, sums array<long>"


def _blocks(parts: int, buckets: int, postings: bool):
    """Packed postings of each block and part; at the end the task's sums by part."""
    width = -(-buckets // parts)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in BLOCKS.split(", ")]
        task, made, sums = TaskContext.get().partitionId(), 0, np.zeros(parts * width, np.int64)
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_docs", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), *((n, pa.list_(pa.int64())) for n in names[5:])])
        for batch in batches:
            data, offsets = words.flat(batch.column(1), lower=True)
            ids = batch.column(0)
            for lo, hi in words.chunks(offsets, BLOCK_FEATURES * 2):
                for a in range(lo, hi, BLOCK_DOCS):
                    b = min(hi, a + BLOCK_DOCS)
                    own = offsets[a : b + 1] - offsets[a]
                    row, bucket, n_words = features(data[offsets[a] : offsets[b]], own, buckets)
                    sums[:buckets] += np.bincount(bucket, minlength=buckets)
                    if not postings:
                        continue
                    keys, counts = np.unique(bucket.astype(np.int64) * (b - a) + row, return_counts=True)
                    cuts = np.searchsorted(keys, np.arange(parts + 1) * width * (b - a))
                    n_features = np.bincount(row, minlength=b - a)
                    rows = []
                    for p in range(parts):
                        k = keys[cuts[p] : cuts[p + 1]]
                        rows.append((p, task << 33 | made, b - a, pack(np.diff(k, prepend=p * width * (b - a))), pack(counts[cuts[p] : cuts[p + 1]])))
                    made += 1
                    columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=False)]
                    about = [[x] + [None] * (parts - 1) for x in (ids.slice(a, b - a).to_pylist(), n_words.tolist(), n_features.tolist())]
                    columns += [pa.array(x, pa.list_(pa.int64())) for x in about] + [pa.nulls(parts, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
            words.trim()
        if sums.any():
            columns = [pa.array(range(parts), pa.int32()), *(pa.nulls(parts, f.type) for f in list(schema)[1:-1]), pa.array(sums.reshape(parts, width).tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def gain(t: int, s: int, target: int, source: int, buckets: int) -> int:
    return math.floor(1000 * math.log((float(t) + 1) * (float(source) + buckets) / ((float(s) + 1) * (float(target) + buckets))))


def _contributions(parts: int, buckets: int, source: int, target: int):
    """What each document of a cell's blocks gets from the cell's buckets."""
    width = -(-buckets // parts)

    def run(left, right):
        import pyarrow as pa

        names = ["block", "n_docs", "part_weights", "doc_ids", "n_words", "n_features"]
        t, s = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for corpus, at, n in zip(right["is_target"].to_pylist(), right["at"].to_pylist(), right["n"].to_pylist(), strict=True):
            (t if corpus else s)[at] = n
        gains = np.array([gain(int(x), int(y), target, source, buckets) for x, y in zip(t, s, strict=True)], np.int64)
        weights = []
        for p, n, k, c in zip(*(left[x].to_pylist() for x in ("part", "n_docs", "keys", "counts")), strict=True):
            key = np.cumsum(unpack(k))  # from the part's first bucket on
            own = np.zeros(n, np.int64)
            np.add.at(own, key % n, gains[key // n] * unpack(c))
            weights.append(own.tolist())
        columns = [left["block"].combine_chunks(), left["n_docs"].combine_chunks(), pa.array(weights, pa.list_(pa.int64())), *(left[x].combine_chunks() for x in names[3:])]
        return pa.Table.from_arrays(columns, names=names)

    return run


CONTRIBUTION_INPUT = ("part", "block", "n_docs", "keys", "counts", "doc_ids", "n_words", "n_features")
CONTRIBUTIONS = "block long, n_docs int, part_weights array<long>, doc_ids array<long>, n_words array<long>, n_features array<long>"


def noise(seed: int, doc_id: Column) -> Column:
    """Scaled Gumbel noise, from the first digits of sha256 of ``seed:doc_id``; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, buckets: int = 10_000, parts: int = 40, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``, written to the shared folder.

    ``docs``' ids must be integers. Null and empty texts have no features and
    weight 0; repeated rows are rows of their own; an empty table gives no rows, an
    empty target is one without features.
    """
    spark = session_of(docs)
    scratch = scratch or Scratch(spark, "importance")
    pick = lambda df, i, t: df.select((F.col(i).cast("long") if i else F.lit(None).cast("long")).alias("doc_id"), F.col(t).alias("text"))
    blocks = scratch.table("blocks", pick(docs, id_col, text_col).mapInArrow(_blocks(parts, buckets, True), BLOCKS))
    aims = pick(target, None, target_text).mapInArrow(_blocks(parts, buckets, False), BLOCKS)
    sums = blocks.where("sums is not null").select(F.lit(False).alias("is_target"), "part", "sums").union(aims.select(F.lit(True), "part", "sums"))
    # a row for each corpus and bucket
    sums = scratch.table("sums", sums.select("is_target", "part", F.posexplode("sums").alias("at", "n")).groupBy("is_target", "part", "at").agg(F.sum("n").alias("n")))
    total = {r["is_target"]: r["n"] for r in sums.groupBy("is_target").agg(F.sum("n").alias("n")).collect()}

    blocks = blocks.where("block is not null")
    n = blocks.where("part = 0").count()
    shares = max(1, -(-n // CELL_BLOCKS))
    # both sides' cells are longs: Spark hashes an int otherwise, and a cogroup doesn't cast its keys
    cell = lambda share: F.col("part").cast("long") * shares + share.cast("long")
    postings = blocks.select(cell(F.pmod(F.xxhash64("block"), F.lit(shares))).alias("cell"), *CONTRIBUTION_INPUT)
    both = sums.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(cell(F.col("share")).alias("cell"), "is_target", "at", "n")
    given = postings.groupBy("cell").cogroup(both.groupBy("cell")).applyInArrow(_contributions(parts, buckets, total.get(False, 0), total.get(True, 0)), CONTRIBUTIONS)
    # one row for each part of a block
    whole = given.groupBy("block").agg(F.collect_list("part_weights").alias("weights"), *(F.max(c).alias(c) for c in ("doc_ids", "n_words", "n_features")))
    weight = F.transform(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.aggregate("weights", F.lit(0).cast("long"), lambda sum_, w: sum_ + w[i]))
    rows = whole.select("block", F.explode(F.arrays_zip("doc_ids", "n_words", "n_features", weight.alias("weight"))).alias("r"))
    return scratch.table("weighed", rows.select(F.col("r.doc_ids").alias("doc_id"), "r.n_words", "r.n_features", F.col("r.weight").alias("weight")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, scratch_group: str = "importance", **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for those not drawn.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100)
    with the highest scores are drawn, ties to smaller doc_id (null last); equal
    rows may swap ranks. See ``weigh`` for nulls and empty tables.
    """
    spark = session_of(docs)
    scratch = Scratch(spark, scratch_group)
    rows = weigh(docs, target, scratch=scratch, **options)
    rows = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed, F.col("doc_id"))).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    rows = scratch.table("scored", rows.withColumn("tie", F.monotonically_increasing_id()))
    n, able = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("able").cast("long")), F.lit(0))).first()
    draw = percent * able // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    # an id holds a partition's number above its 33rd bit and the index in it below
    placed = rows.repartitionByRange(partitions_for(spark, n, ORDER_ROWS), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    placed = scratch.table("placed", placed)
    part = F.shiftright("id", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    base = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    place = F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part).join(F.broadcast(base), "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(place <= draw, place).alias("rank"))
