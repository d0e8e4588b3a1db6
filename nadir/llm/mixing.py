"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Every document's size is its number of words; sizes are summed by source.
2. Weights share out all words; a target stops at ``max_repeats`` times its
   source's size and the excess is reshared by weight until none is above.
3. Each source is divided into shards by a hash of the document's id and text,
   in proportion to its size, so that a source with a third of all rows, or an
   id that many of them share, is many shards. There are at most ``max_shards`` shards and one more per source.
4. Equal-token blocks are seats: Sainte-Lague (highest quotient T/(2k+1))
   allots them to sources by target, then within a source to its shards by
   size, which gives each shard an integer quota.
5. In a shard, documents lie end to end in an order seeded by their ids. A
   quota of q over n blocks is q // n whole passes and a run of q % n blocks
   that starts at a seeded block and goes round. The order being random, the
   run is a random selection, and what a document gives is found without
   listing blocks.

Only (id, source, size) is shuffled, never text.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, rest_hash, session_of

WORD = r"[^\x20\x09-\x0D]+"


def capped_shares(sizes: list[int], weights: list[float], max_repeats: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``max_repeats`` times its size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / total > max_repeats * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(max_repeats * sizes[i])
        free.difference_update(above)
        left -= sum(out[i] for i in above)
    return out


def sainte_lague(targets: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients target/(2k+1), at most ``most[i]`` each; ties go to the lower index.

    All quotients above a bound found by bisection are granted at once and the
    few that remain one by one, so the time doesn't depend on ``seats``.
    """
    seats = min(seats, sum(m for t, m in zip(targets, most, strict=True) if t > 0))

    def above(bound: float) -> list[int]:
        return [min(m, max(0, int((t / bound + 1) // 2))) if t > 0 else 0 for t, m in zip(targets, most, strict=True)]

    low, high = 0.0, 2.0 * max([0.0, *targets]) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(above(mid)) > seats:
            low = mid
        else:
            high = mid
    got = above(high)
    heap = [(-t / (2 * got[i] + 1), i) for i, t in enumerate(targets) if t > 0 and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-targets[i] / (2 * got[i] + 1), i))
    return got


def _seeded(seed: int, source: str | None, shard: int, below: int) -> int:
    digest = hashlib.sha256(f"{seed}\0{source is None}\0{source}\0{shard}".encode()).digest()
    return int.from_bytes(digest[:8], "big") % max(1, below)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_repeats: int = 3,
    block_tokens: int = 16,
    shard_tokens: int = 1 << 16,
    max_shards: int = 4096,
    max_sources: int = 100_000,
    seed: int = 20240,
    scratch_group: str = "mix",
) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, text, source; other columns are ignored).

    Sources in code-point order, null last, take ``weights`` in turn. Returns
    doc_id, text_hash, source, size, source_size, target, taken, passes (times
    the whole text is taken) and pieces: further runs of words of the text, as
    (start, length) in words.

    Null text has size 0 and is never taken; null doc_id and null source are
    values like others; a repeated row is a row of its own, and equal rows may
    swap what they give. An empty table gives no rows. More than
    ``max_sources`` sources raise an error: weights are set by hand per source,
    and that bound is what the driver holds.
    """
    spark = session_of(docs)
    scratch = Scratch(spark, scratch_group)
    sized = scratch.table(
        "sizes",
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.xxhash64("text").alias("text_hash"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
    )
    totals = [(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).limit(max_sources + 1).collect()]
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    words = sum(n for _, n in totals)
    targets = capped_shares([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], max_repeats)
    wanted = max(1, min(max_shards, -(-words // shard_tokens)))
    parts = [max(1, -(-n * wanted // max(1, words))) for _, n in totals]

    source_row = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("parts", T.IntegerType())])
    by_source = spark.createDataFrame([(s, n, t, p) for (s, n), t, p in zip(totals, targets, parts, strict=True)], source_row)
    sharded = sized.join(F.broadcast(by_source), sized["source"].eqNullSafe(by_source["source"])).select(
        "doc_id", sized["source"], "text_hash", "size", "source_size", "target", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("parts")).cast("int").alias("shard")
    )
    shards: dict[str | None, list[tuple[int, int]]] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("size")).collect():  # at most max_shards and one per source
        shards.setdefault(r[0], []).append((r[1], r[2]))

    blocks = [sum(-(-n // block_tokens) for _, n in shards[s]) for s, _ in totals]
    quotas = sainte_lague(targets, round(sum(targets) / block_tokens), [max_repeats * b for b in blocks])
    rows = []
    for (s, n), quota in zip(totals, quotas, strict=True):
        own = sorted(shards[s])
        full = [-(-size // block_tokens) for _, size in own]
        for (shard, size), q, count in zip(own, sainte_lague([float(x) for _, x in own], quota, [max_repeats * f for f in full]), full, strict=True):
            passes, rest = divmod(q, count) if count else (0, 0)
            first = _seeded(seed, s, shard, count)
            over = max(0, first + rest - count)
            rows.append((s, shard, passes, first * block_tokens, min(size, (first + rest - over) * block_tokens), min(size, over * block_tokens)))
    shard_row = T.StructType([T.StructField("q_source", T.StringType()), T.StructField("q_shard", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("passes", "a1", "b1", "b2"))])
    quota_table = spark.createDataFrame(rows, shard_row)

    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sharded.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(F.broadcast(quota_table), placed["source"].eqNullSafe(quota_table["q_source"]) & (placed["shard"] == quota_table["q_shard"]))

    def overlap(a: F.Column, b: F.Column) -> F.Column:
        return F.struct((F.greatest(a, F.col("start")) - F.col("start")).alias("start"), (F.least(b, F.col("start") + F.col("size")) - F.greatest(a, F.col("start"))).alias("length"))

    pieces = F.filter(F.array(overlap(F.col("a1"), F.col("b1")), overlap(F.lit(0), F.col("b2"))), lambda p: p["length"] > 0)
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", "passes", pieces.alias("pieces")).select(
        "doc_id", "text_hash", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["length"])).alias("taken"),
        "passes", "pieces",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: columns of ``docs``, each row as often and as far as the mix takes it.

    A row comes once for every whole pass and once for every further piece,
    whose text runs from its first to its last word; rows not taken go.
    ``n_chars``, if there is one, is counted anew.
    """
    taken = mix(docs, **options).where("taken > 0").select("doc_id", "text_hash", "passes", "pieces")
    alike = Window.partitionBy("doc_id", "text_hash")
    right = taken.withColumn("nth", F.row_number().over(alike.orderBy("passes", "pieces"))).select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), F.col("nth").alias("m_nth"), "passes", "pieces")
    left = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("nth", F.row_number().over(alike.orderBy(rest_hash("row", docs.schema))))
    joined = left.join(right, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")) & (F.col("nth") == F.col("m_nth")))
    run = "array<struct<start:bigint,length:bigint>>"
    whole = F.transform(F.sequence(F.lit(1), F.col("passes").cast("int")), lambda _: F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("length")))
    runs = F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.array().cast(run)), F.col("pieces").cast(run))
    # positions, not names, carry the columns: any name may be among them
    flat = joined.select("row", F.explode(runs).alias("run")).select(*(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("run.start").alias("start"), F.col("run.length").alias("length"))
    return flat.mapInArrow(_cut(docs.schema), docs.schema)


def _cut(schema: T.StructType):
    names = schema.names
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            cols = batch.columns
            out = []
            for text, start, length in zip(cols[text_at].to_pylist(), cols[-2].to_pylist(), cols[-1].to_pylist(), strict=True):
                if length >= 0 and text is not None:
                    begin = end = 0
                    for i, m in enumerate(word.finditer(text)):
                        if i == start:
                            begin = m.start()
                        if i == start + length - 1:
                            end = m.end()
                            break
                    text = text[begin:end]
                out.append(text)
            own = list(cols[: len(names)])
            own[text_at] = pa.array(out, pa.string())
            if chars_at is not None:
                own[chars_at] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(own[chars_at].type)
            yield pa.RecordBatch.from_arrays(own, names=names)

    return run
