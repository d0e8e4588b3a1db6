"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only.

1. Rows get their place, 0 to N-1, in the order of their keys. The rows' short
   columns are written once and range-partitioned by key; a row's place is the
   number of rows in earlier partitions plus its index in its own, so no window
   meets a whole key or table. Equal rows differ by an arbitrary number, so a key
   that a third of all rows share is dealt over many tasks; which of them comes
   first doesn't show.
2. A Feistel network over pairs (L, R) in [0, a) x [0, b), with a * b >= N,
   permutes a * b places; one that lands at N or beyond is sent through again
   until it lands below N (cycle walking), which is a permutation of [0, N).
   Fewer than a places lie beyond N, so a walk takes fewer than a steps, and all
   but one in sqrt(N) rows take one.
3. Shard and slot are the new place modulo and divided by the number of shards:
   counts are at most one apart, slots have no gaps, and both can be computed
   from a row's number, or the number from them, without looking at the data.

Round functions are integer arithmetic below 2**62, the same in any language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions_for, session_of

PRIME = (1 << 31) - 1
#: Steps of a walk that are tried; all there can be up to 4096 rows, and beyond that more take a chance of 64 ** -64.
STEPS = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


@dataclass(frozen=True)
class Feistel:
    """A seeded permutation of 0 to ``n`` - 1."""

    n: int
    seed: int = 20240
    rounds: int = 6

    def __post_init__(self):
        if not 0 <= self.n < 1 << 60:
            raise ValueError("the number of rows must be below 2**60")
        if self.rounds % 2:
            raise ValueError("the number of rounds must be even")

    @property
    def sides(self) -> tuple[int, int]:
        a = isqrt(max(0, self.n - 1)) + 1
        return a, max(1, -(-self.n // a))

    def keys(self) -> list[tuple[int, int, int]]:
        """Multiplier and two summands of each round, from the seed."""
        digests = [hashlib.sha256(f"{self.seed}:{i}".encode()).digest() for i in range(self.rounds)]
        return [tuple(1 + int.from_bytes(d[8 * j : 8 * j + 8], "big") % (PRIME - 1) for j in range(3)) for d in digests]

    def of(self, x: int, back: bool = False) -> int:
        """The new place of a row number, or with ``back`` the row number of a place."""
        a, b = self.sides
        turns = list(enumerate(self.keys()))
        while True:
            left, right = x % a, x // a
            for i, (m, c, d) in reversed(turns) if back else turns:
                y = ((left if i % 2 else right) % PRIME * m + c) % PRIME
                f = (y * y % PRIME * y + d) % PRIME
                f = -f if back else f
                left, right = (left, (right + f) % b) if i % 2 else ((left + f) % a, right)
            x = right * a + left
            if x < self.n:
                return x

    def column(self, row: Column, back: bool = False) -> Column:
        """The same for a column of longs from 0 to ``n`` - 1."""
        a, b = self.sides
        # a round turns (x, y) into (y, x + f(y)), so that after an even number of rounds the sides are in place
        rounds = [F.array(*(F.lit(v).cast("long") for v in (*key, b if i % 2 else a))) for i, key in enumerate(self.keys())]

        def mixed(x: Column, k: Column) -> Column:
            y = (x % PRIME * k[0] + k[1]) % PRIME
            return (y * y % PRIME * y + k[2]) % PRIME

        def turn(s: Column, k: Column) -> Column:
            if back:
                return F.array((s[1] + k[3] - mixed(s[0], k) % k[3]) % k[3], s[0])
            return F.array(s[1], (s[0] + mixed(s[1], k)) % k[3])

        def walk(x: Column) -> Column:
            return F.aggregate(F.array(*(rounds[::-1] if back else rounds)), F.array(x % F.lit(a).cast("long"), div(x, a)), turn, lambda s: s[1] * F.lit(a).cast("long") + s[0])

        def on(x: Column) -> Column:
            steps = F.sequence(F.lit(1), F.lit(min(STEPS, max(1, a * b - self.n))))
            lost = F.raise_error(F.lit("a walk took too many steps")).cast("long")
            return F.aggregate(steps, x, lambda y, _: F.when(y < self.n, y).otherwise(walk(y)), lambda y: F.when(y < self.n, y).otherwise(lost))

        return let(walk(row.cast("long")), lambda x: F.when(x < self.n, x).otherwise(on(x)))


def numbered(rows: DataFrame, keys: Sequence[str], scratch: Scratch, name: str = "row", rows_per_partition: int = 1 << 20) -> tuple[DataFrame, int]:
    """``rows`` with their place from 0 in the order of ``keys`` (nulls last), and how many there are.

    The place of equal rows among each other is arbitrary. ``rows`` is written once
    as it is and once in order.
    """
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}  # names of the caller may be any
    plain = rows.toDF(*names.values()).withColumn("tie", F.monotonically_increasing_id())
    plain = scratch.table(f"{name}-plain", plain)
    n = plain.count()
    parts = partitions_for(rows.sparkSession, n, rows_per_partition)
    order = [F.asc_nulls_last(names[k]) for k in keys] + [F.asc("tie")]
    # an id holds a partition's number above its 33rd bit and the index in it below
    placed = plain.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    placed = scratch.table(f"{name}-placed", placed.drop("tie"))
    part = F.shiftright("id", 33)
    # a row for each partition
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    out = placed.withColumn("part", part).join(F.broadcast(base), "part")
    place = F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(*(F.col(new).alias(old) for old, new in names.items()), place.alias(name)), n


def text_columns(text: str = "text") -> dict[str, Column]:
    """size (UTF-8 bytes and 16 more) and text_crc32 of a text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return {"size": (F.octet_length(whole) + 16).cast("long"), "text_crc32": F.crc32(whole.cast("binary"))}


def assign(docs: DataFrame, shards: int = 40, seed: int = 20240, id_col: str = "doc_id", text_col: str = "text", scratch_group: str = "feistel") -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot of every row, without moving any text.

    Rows are numbered by doc_id (null last), size and crc32. A null text is
    empty; repeated rows and rows of one id are rows of their own, each with a
    slot; rows that differ in none of the three may swap places, which doesn't show.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(session_of(docs), scratch_group)
    own = text_columns(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), own["size"].alias("size"), own["text_crc32"].alias("text_crc32"))
    placed, n = numbered(rows, ("doc_id", "size", "text_crc32"), scratch)
    at = Feistel(n, seed).column(F.col("row"))
    return placed.withColumn("at", at).select("doc_id", "size", "text_crc32", "row", (F.col("at") % shards).cast("int").alias("shard"), div(F.col("at"), shards).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20240, id_col: str = "doc_id", text_col: str = "text", files_per_shard: int = 1, scratch_group: str = "feistel") -> DataFrame:
    """Write all columns of ``docs`` in shuffled order, in folders ``shard=N``, and return a frame that reads them.

    Rows are numbered by id, text hash and text (null last), so the files are the
    same however the input is divided. Within a file rows are in the order of column
    ``slot``; a shard's files hold consecutive slots. Columns named shard or slot
    are replaced.
    """
    scratch = Scratch(session_of(docs), scratch_group)
    rows = docs.drop("shard", "slot").withColumns({"_id": F.col(id_col), "_hash": F.xxhash64(text_col), "_text": F.col(text_col).isNull()})
    placed, n = numbered(rows, ("_id", "_hash", "_text"), scratch, "_row", 1 << 16)
    at = Feistel(n, seed).column(F.col("_row"))
    each = max(1, -(-(-(-n // shards)) // files_per_shard))
    cut = placed.withColumn("_at", at).drop("_id", "_hash", "_text", "_row").withColumns({"shard": (F.col("_at") % shards).cast("int"), "slot": div(F.col("_at"), shards)}).drop("_at")
    dealt = cut.withColumn("_file", div(F.col("slot"), each)).repartition(shards * files_per_shard, "shard", "_file").sortWithinPartitions("shard", "_file", "slot")
    dealt.drop("_file").write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def assign_sql(shards: int = 40, seed: int = 20240, passes: int = 6) -> str:
    """``assign`` over table ``documents`` for an independent engine.

    It has no crc32 of its own: bytes go through the polynomial's table one by
    one. A walk of more than ``passes`` passes shows as a slot that another row has.
    """
    keep, parts, now = "doc_id, size, text_crc32, n, a, b", [], "sides"
    for w in range(passes):
        old = "place" if w else "row"
        parts.append(f"w{w}_0 as (select {keep}, {old} as old, {old} % a as l, {old} // a as r from {now})")
        keys = Feistel(1, seed).keys()
        for i, (m, c, d) in enumerate(keys):
            y = f"(({'l' if i % 2 else 'r'} % {PRIME} * {m} + {c}) % {PRIME})"
            f = f"(({y} * {y}) % {PRIME} * {y} + {d}) % {PRIME}"
            parts.append(f"w{w}_{i + 1} as (select {keep}, old, {f'l, (r + {f}) % b as r' if i % 2 else f'(l + {f}) % a as l, r'} from w{w}_{i})")
        parts.append(f"p{w} as (select {keep}, {'case when old < n then old else r * a + l end' if w else 'r * a + l'} as place from w{w}_{len(keys)})")
        now = f"p{w}"
    walks = ",\n".join(parts)
    return f"""
with steps as (select list(c order by n) as t from (
  select n, list_reduce(list_prepend(n, range(8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(n))),
own as (select doc_id, strlen(coalesce(text, '')) + 16 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as bytes from documents),
crcs as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) as text_crc32 from own, steps),
counted as (select *, row_number() over (order by doc_id nulls last, size, text_crc32) - 1 as row, count(*) over () as n from crcs),
sides as (select *, floor(sqrt(n - 1))::bigint + 1 as a, (n + floor(sqrt(n - 1))::bigint) // (floor(sqrt(n - 1))::bigint + 1) as b from counted),
{walks}
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (place % {shards})::int as shard, (place // {shards})::bigint as slot, null::int as grown_shard from {now}"""
