"""Evidence to pair tables: one roll-up, with a specification for each domain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import settled


@dataclass(frozen=True)
class PairSpec:
    """What a pair table holds. ``symmetric`` pairs have one kind of end: the lesser comes first, degrees count both ends; None: no degrees."""

    a: str
    b: str
    measures: dict[str, Column] = field(default_factory=dict)
    symmetric: bool = False
    degrees: tuple[str, str] | None = ("a_degree", "b_degree")


def rollup(evidence: DataFrame, spec: PairSpec, partitions: int | None = None) -> DataFrame:
    """A row for each pair with the measures of its evidence and the degree of each end.

    Null ends are dropped. Degrees are sums over the pair table, joined back:
    an end with very many pairs is aggregated in parts. The pair table is
    written once, and so are its degrees: where these are few they are broadcast
    to it, and it isn't shuffled again. ``partitions`` is for evidence of pairs that
    seldom come twice, which are shuffled as they are into so many; measures should
    count distinct values of one column then, as two make rows of each of both.
    """
    rows = evidence.where(F.col(spec.a).isNotNull() & F.col(spec.b).isNotNull())
    if spec.symmetric:
        low, high = F.least(spec.a, spec.b), F.greatest(spec.a, spec.b)
        rows = rows.where(F.col(spec.a) != F.col(spec.b)).withColumns({spec.a: low, spec.b: high})
    if partitions:
        rows = rows.repartition(partitions, spec.a, spec.b)
    pairs = rows.groupBy(spec.a, spec.b).agg(*(c.alias(n) for n, c in spec.measures.items()))
    if spec.degrees is None:
        return pairs
    pairs = settled(pairs)
    if spec.symmetric:
        # a pair comes once here
        degree = settled(pairs.select(F.explode(F.array(spec.a, spec.b)).alias("entity")).groupBy("entity").agg(F.count("*").alias("degree")))
        da, db = degree.select(F.col("entity").alias(spec.a), F.col("degree").alias(spec.degrees[0])), degree.select(F.col("entity").alias(spec.b), F.col("degree").alias(spec.degrees[1]))
    else:
        da, db = (settled(pairs.groupBy(end).agg(F.count("*").alias(name))) for end, name in zip((spec.a, spec.b), spec.degrees, strict=True))
    return _with_degree(_with_degree(pairs, da, spec.a, partitions), db, spec.b, partitions)


#: Degrees up to which they are broadcast to their pairs.
MOST_BROADCAST = 1 << 17


def _with_degree(pairs: DataFrame, degree: DataFrame, end: str, partitions: int | None) -> DataFrame:
    """Pairs with the degree of an end, which is written; pairs are neither sorted nor held."""
    if degree.count() <= MOST_BROADCAST:
        return pairs.join(F.broadcast(degree), end)
    if partitions:
        pairs, degree = pairs.repartition(partitions, end), degree.repartition(partitions, end)
    return pairs.join(degree.hint("shuffle_hash"), end)


def two_sided_degree(pairs: DataFrame, a: str, b: str, partitions: int | None = None) -> DataFrame:
    """entity, degree: distinct partners of every end of symmetric pairs.

    Pairs are made distinct once, not for each end; degrees are then counts.
    """
    turned = F.col(a).isNull() | (F.col(b) < F.col(a))
    once = pairs.select(F.when(turned, F.col(b)).otherwise(F.col(a)).alias("a"), F.when(turned, F.col(a)).otherwise(F.col(b)).alias("b"))
    once = (once.repartition(partitions, "a", "b") if partitions else once).distinct()
    end = lambda x, y: F.struct(F.col(x).alias("entity"), F.col(y).alias("other"))
    ends = once.select(F.explode(F.array_distinct(F.array(end("a", "b"), end("b", "a")))).alias("e")).select("e.*")
    return ends.groupBy("entity").agg(F.count("other").alias("degree"))


def mode_per_group(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, ties to the least; counted before it is ranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in an explicit order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


#: Distinct items up to which an entity's items are bits of one row.
MOST_BITS = 4096


def partner_jaccard(pairs: DataFrame, partners: DataFrame, a: str, b: str, entity: str, item: str) -> DataFrame:
    """Jaccard of the items of both ends of each pair; null where neither end has any.

    Items are numbered, and an entity's are bits of one row: a pair meets the rows
    of its ends, and no row for each item they share is made. These rows are
    written, so they are broadcast where they are few. With more than
    ``MOST_BITS`` items that would be wide, and ends meet by item.
    """
    sizes = partners.select(entity, item).where(F.col(entity).isNotNull()).distinct()
    items = settled(sizes.select(item).where(F.col(item).isNotNull()).distinct())
    many = items.count()
    na, nb, s = (F.coalesce(F.col(c), F.lit(0)) for c in ("_na", "_nb", "shared"))
    done = lambda out: out.withColumn("shared", s).withColumn("jaccard", s / F.nullif(na + nb - s, F.lit(0)))
    if many > MOST_BITS:
        n = sizes.groupBy(entity).agg(F.count("*").alias("n"))
        shared = (
            pairs.select(a, b).distinct()
            .join(sizes.select(F.col(entity).alias(a), F.col(item).alias("_i")), a)
            .join(sizes.select(F.col(entity).alias(b), F.col(item).alias("_i")), [b, "_i"])
            .groupBy(a, b).agg(F.count("*").alias("shared"))
        )
        out = pairs.join(n.select(F.col(entity).alias(a), F.col("n").alias("_na")), a, "left").join(n.select(F.col(entity).alias(b), F.col("n").alias("_nb")), b, "left").join(shared, [a, b], "left")
        return done(out).drop("_na", "_nb")
    numbered = items.withColumn("_p", F.row_number().over(Window.orderBy(item)) - 1)  # at most MOST_BITS rows
    placed = sizes.join(F.broadcast(numbered), item, "left")  # a null item counts, but is shared by none
    words = [F.bit_or(F.when(F.floor(F.col("_p") / 64) == w, F.expr("shiftleft(1L, cast(_p % 64 as int))")).otherwise(F.lit(0).cast("long"))) for w in range(-(-many // 64))]
    rows = settled(placed.groupBy(entity).agg(F.count("*").alias("n"), F.array(*words).cast("array<long>").alias("bits")))
    out = pairs
    for end, tag in ((a, "a"), (b, "b")):
        out = out.join(rows.select(F.col(entity).alias(end), F.col("n").alias(f"_n{tag}"), F.col("bits").alias(f"_bits{tag}")), end, "left")
    both = F.zip_with("_bitsa", "_bitsb", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long"))
    return done(out.withColumn("shared", F.aggregate(both, F.lit(0).cast("long"), lambda t, x: t + x))).drop("_na", "_nb", "_bitsa", "_bitsb")


#: log2 of a sketch's registers, and the standard error of its estimate that follows.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / (1 << SKETCH_BITS) ** 0.5


def sketched(rows: DataFrame, by: Sequence[str], distinct: dict[str, str]) -> DataFrame:
    """The finest groups with a mergeable sketch of the distinct values of each column (name -> column), to be stored.

    A sketch is some kilobytes however many values it has seen; null values don't count.
    """
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(name) for name, c in distinct.items()))


def cube_of_sketches(stored: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows and estimated distinct values of every combination of groups, merged from stored sketches alone; null in ``by`` stands for all, too."""
    return stored.cube(*by).agg(F.sum("n").alias("n"), *(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in names))


def cube_of_distinct(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(cell array<string>, all int, name): exact distinct values in every combination of groups.

    Rows are made distinct once, at the finest groups, and each value then names the
    cells it is in; ``all`` has a bit for each group that stands for all of them.
    A null in ``by`` is a group of its own, told from all by its bit; null values
    don't count.
    """
    fine = rows.select(*by, value).distinct()
    each = fine.groupBy(value).agg(F.collect_list(F.struct(*by)).alias("_in"))
    named = lambda g: F.array(*(F.struct(F.array(*(F.lit(None).cast("string") if m >> i & 1 else g[c].cast("string") for i, c in enumerate(by))).alias("cell"), F.lit(m).alias("all")) for m in range(1 << len(by))))
    return each.select(value, F.explode(F.array_distinct(F.flatten(F.transform("_in", named)))).alias("_c")).groupBy("_c.cell", "_c.all").agg(F.count(value).alias(name))
