"""Exact global order without a single-task window.

A window over a whole table runs in one task. Here a coarse key cuts the order
into buckets, bucket totals (a small table) give each bucket its offset, and
the window runs within buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int, *keys: str) -> Column:
    """The order that stands for a seeded shuffle: MD5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))


def hash_rank(df: DataFrame, seed: int, keys: Sequence[str], by: Sequence[str] = (), name: str = "rank", total: str | None = None) -> DataFrame:
    """1-based rank of each row in seeded order within ``by``; with ``total``, the rows there are.

    Buckets are the first three digits of the hash: at most 4096 for each value
    of ``by``.
    """
    keyed = df.withColumn("_h", hash_key(seed, *keys)).withColumn("_b", F.substring("_h", 1, 3))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_p{i}") for i, c in enumerate(by)]
    names = [f"_p{i}" for i in range(len(by))]
    keyed = keyed.select("*", *parts)
    counts = keyed.groupBy(*names, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*names, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*names)).alias("_total"))
    inside = Window.partitionBy(*names, "_b").orderBy("_h", *keys)
    out = keyed.join(offsets, [*names, "_b"]).withColumn(name, F.col("_base") + F.row_number().over(inside))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_h", "_b", "_base", "_total", *names)


def same(by: Sequence[str], prefix: str = "_j") -> list[Column]:
    """Null-safe equality of columns and their copies under a prefix, for joins that keep null groups."""
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(by)]


def copies(by: Sequence[str], prefix: str = "_j") -> list[Column]:
    return [F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(by)]


def first_n(df: DataFrame, n: int | Column, seed: int, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` rows (of each ``by``) in seeded order, or all if there are fewer.

    A fixed ``n`` of all rows is a limit over the order, so only ``n`` rows of
    each task are shuffled, as long as that is few.
    """
    if not by and isinstance(n, int) and n <= 10_000:
        return df.withColumn("_h", hash_key(seed, *keys)).orderBy("_h", *keys).limit(n).drop("_h")
    return hash_rank(df, seed, keys, by, "_r").where(F.col("_r") <= n).drop("_r")


def running_before(df: DataFrame, bucket: Column, order: Sequence[Column | str], amounts: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Sums of columns over all rows that come before, by buckets that follow the order.

    ``amounts`` maps new names to the columns summed. ``bucket`` must not
    decrease along ``order``. Rows with a null in ``by`` are a group.
    """
    keyed = df.withColumn("_b", bucket)
    sums = keyed.groupBy(*by, "_b").agg(*(F.sum(c).alias(f"_s{i}") for i, c in enumerate(amounts.values())))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*copies(by), F.col("_b").alias("_jb"), *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(amounts))))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(base, [*same(by), F.col("_b") == F.col("_jb")])
    for i, (name, c) in enumerate(amounts.items()):
        out = out.withColumn(name, F.col(f"_o{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_b", "_jb", *(f"_j{i}" for i in range(len(by))), *(f"_o{i}" for i in range(len(amounts))))


def neighbour(df: DataFrame, bucket: Column, order: str, values: Sequence[str], name: str, by: Sequence[str] = (), ahead: bool = False) -> DataFrame:
    """A struct of ``values`` of the row before (or after) along ``order``; null at the end. ``bucket`` follows the order."""
    keyed, held = df.withColumn("_b", bucket), F.struct(*values)
    ends = keyed.groupBy(*by, "_b").agg((F.min_by if ahead else F.max_by)(held, F.col(order)).alias("_e"))
    along = Window.partitionBy(*by).orderBy("_b")
    step = F.lead if ahead else F.lag
    edge = ends.select(*copies(by), F.col("_b").alias("_jb"), step("_e").over(along).alias("_e"))
    inside = Window.partitionBy(*by, "_b").orderBy(order)
    out = keyed.join(edge, [*same(by), F.col("_b") == F.col("_jb")])
    return out.withColumn(name, F.coalesce(step(held).over(inside), F.col("_e"))).drop("_b", "_jb", "_e", *(f"_j{i}" for i in range(len(by))))


#: Rows that one window may hold without being divided.
WINDOW_ROWS = 1 << 16


def in_bands(df: DataFrame, order: Sequence[Column | str], rows_per_band: int = WINDOW_ROWS, most_bands: int = 1 << 14) -> DataFrame:
    """Rows with ``band``: their range partition of a total order, as many as the rows need. Written and read back.

    Spark's sampled splitters follow the whole order and not one column of it,
    so a value that many rows share is divided by what comes after it.
    """
    rows = settled(df)
    n = rows.count()
    if n <= rows_per_band:
        return rows.withColumn("band", F.lit(0))
    parts = min(most_bands, -(-n // rows_per_band))
    return settled(rows.repartitionByRange(parts, *order).withColumn("band", F.spark_partition_id()), rows)


def ordinal(df: DataFrame, order: Sequence[Column | str], name: str, rows_per_partition: int = 1 << 20) -> DataFrame:
    """Rows with their 0-based place in a total order, by range partitions of the whole order: no bucket depends on how values look.

    Rows must be distinct in ``order``.
    """
    rows = settled(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_partition))
    # an id holds a partition's number above its 33rd bit and the index in it below
    placed = settled(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), rows)
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    out = placed.withColumn("_part", part).join(F.broadcast(base), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_base", "_id")


def settled(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """The frame written to the session's shared folder, so that later steps start from its rows; what ``replaces`` was read from is deleted."""
    from .steps import Steps

    return Steps(df.sparkSession, "settled").table(df, replaces)
