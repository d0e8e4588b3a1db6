"""Builders of benchmark items: candidate pools, quotas by difficulty, tested and untested pairs, shares, few-shot sets.

All samples are exact and in the seeded order of ``ordering.hash_key``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import first_n, hash_key, hash_rank, settled
from .sampling import untested_pairs


def candidate_pool(facts: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]], always: Sequence[Column] = (), optional: Sequence[Column | None] = ()) -> DataFrame:
    """Facts with their dimensions (frame, key, join kind) that pass all fixed predicates and those optional ones that are given."""
    rows = facts
    for table, key, how in dimensions:
        rows = rows.join(table, key, how)
    tests = [*always, *(c for c in optional if c is not None)]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def by_difficulty(pool: DataFrame, difficulty: Column, shares: dict[str, int], keys: Sequence[str], spread: str, once: str | None = None, seed: int = 42) -> DataFrame:
    """Exactly the wanted number of each difficulty, one row to each value of ``spread`` as far as those go.

    Rows that are first of their ``spread`` value come before all others, so
    duplicates are used only where there are too few. ``once``: a value that
    may come only once over all difficulties; it stays with the first of
    ``shares`` that has it. A difficulty with too few rows gives what it has.
    """
    rows = pool.withColumn("difficulty", difficulty).where(F.col("difficulty").isin(*shares))
    if once is not None:
        order = F.coalesce(*(F.when(F.col("difficulty") == k, i) for i, k in enumerate(shares)))
        first = Window.partitionBy(once).orderBy(order, hash_key(seed, *keys), *keys)
        rows = rows.withColumn("_o", F.row_number().over(first)).where("_o = 1").drop("_o")
    own = Window.partitionBy("difficulty", spread).orderBy(hash_key(seed, *keys), *keys)
    rows = rows.withColumn("_again", (F.row_number().over(own) > 1).cast("int"))
    # firsts in seeded order, then the others: ranks of the others follow the number of firsts
    ranked = hash_rank(rows, seed, keys, ["difficulty", "_again"], "_r")
    firsts = rows.where("_again = 0").groupBy(F.col("difficulty").alias("_d")).agg(F.count("*").alias("_n"))  # a row for each difficulty
    ranked = ranked.join(firsts, F.col("difficulty") == F.col("_d"), "left").withColumn("_r", F.col("_r") + F.when(F.col("_again") == 1, F.coalesce("_n", F.lit(0))).otherwise(0))
    wanted = F.coalesce(*(F.when(F.col("difficulty") == k, n) for k, n in shares.items()))
    return ranked.where(F.col("_r") <= wanted).drop("_r", "_again", "_d", "_n")


def tested_items(pairs: DataFrame, year: str, periods: dict[str, tuple[int | None, int | None, int]], keys: Sequence[str], spread: str, prefer: Column, seed: int = 42) -> DataFrame:
    """Tested pairs of each period (from, before, number), one to each value of ``spread`` first, preferred rows before the rest.

    Up to ``MOST_LIMIT`` rows a period come by limits that every task applies before
    anything is shuffled. Rows that aren't first of their spread value are looked at
    only in periods with fewer values than rows wanted.
    """
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col(year) >= lo) & (F.lit(True) if hi is None else F.col(year) < hi)
    period = F.coalesce(*(F.when(inside(lo, hi), name) for name, (lo, hi, _) in periods.items()))
    rows = pairs.withColumn("period", period).where(F.col("period").isNotNull())
    most = max(n for *_, n in periods.values())
    if most <= MOST_LIMIT:
        return _tested_by_limits(rows, {k: v[2] for k, v in periods.items()}, most, keys, spread, prefer, seed).withColumn("answer", F.lit("tested"))
    own = Window.partitionBy("period", spread).orderBy(hash_key(seed, *keys), *keys)
    again = (F.row_number().over(own) > 1).cast("int") * 2 + F.when(F.coalesce(prefer, F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("_c", again)
    counts = rows.groupBy(F.col("period").alias("_p"), F.col("_c").alias("_k")).agg(F.count("*").alias("_n"))  # four rows a period at most
    before = Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = hash_rank(rows, seed, keys, ["period", "_c"], "_r").join(F.broadcast(counts), (F.col("period") == F.col("_p")) & (F.col("_c") == F.col("_k")))
    wanted = F.coalesce(*(F.when(F.col("period") == k, v[2]) for k, v in periods.items()))
    return ranked.where(F.col("_base") + F.col("_r") <= wanted).drop("_c", "_p", "_k", "_n", "_base", "_r").withColumn("answer", F.lit("tested"))


#: Rows a group up to which Spark limits a ranked group in every task (``spark.sql.optimizer.windowGroupLimitThreshold``), over two.
MOST_LIMIT = 500


def _tested_by_limits(rows: DataFrame, wanted: dict[str, int], most: int, keys: Sequence[str], spread: str, prefer: Column, seed: int) -> DataFrame:
    names = [c for c in rows.columns]
    rows = rows.withColumns({"_h": hash_key(seed, *keys), "_c": F.when(F.coalesce(prefer, F.lit(False)), 0).otherwise(1)})

    def top(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n)

    firsts = settled(top(rows, ["period", spread], ["_h", *keys], 1).drop("_r"))
    had = dict(firsts.groupBy("period").count().collect())  # a row for each period
    limit = lambda ns: F.coalesce(*(F.when(F.col("period") == k, n) for k, n in ns.items()))
    out = top(firsts, ["period"], ["_c", "_h", *keys], most).where(F.col("_r") <= limit(wanted))
    lacking = {k: n - had[k] for k, n in wanted.items() if 0 < had.get(k, 0) < n}
    if lacking:
        # fewer than ``most`` of these are firsts; one row of each is taken out
        best = top(rows.where(F.col("period").isin(*lacking)), ["period"], ["_c", "_h", *keys], 2 * most).drop("_r")
        own = ["period", spread, *keys]
        twice = best.withColumn("_k", F.row_number().over(Window.partitionBy(*own).orderBy("_c")))
        marked = firsts.select(*(F.col(c).alias(f"_j{i}") for i, c in enumerate(own)), F.lit(1).alias("_k"))
        others = twice.join(marked, [*(F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate(own)), twice["_k"] == marked["_k"]], "left_anti")
        out = out.unionByName(top(others.drop("_k"), ["period"], ["_c", "_h", *keys], most).where(F.col("_r") <= limit(lacking)))
    return out.select(*names)


def _degree(pairs: DataFrame, entity: str, degree: str | None) -> DataFrame:
    return pairs.groupBy(entity).agg((F.max(degree) if degree else F.count("*")).alias("_d"))


def well_known(pairs: DataFrame, entity: str, degree: str | None, most: int) -> DataFrame:
    """The ``most`` entities of the greatest degree (ties to the least), a top-k. Without a column of degrees they are numbers of pairs."""
    top = _degree(pairs, entity, degree)
    return top.orderBy(F.desc("_d"), entity).limit(most).select(entity)


def untested_items(pairs: DataFrame, a: str, b: str, degrees: tuple[str, str] | None, known: DataFrame, n_trick: int, n_obvious: int, top: tuple[int, int] = (2000, 500), few: int = 10, seed: int = 42, known_once: bool = False) -> DataFrame:
    """Pairs that nobody tested: ``trick`` of two well-known ends, ``obvious`` of a well-known and a little-studied one.

    ``degrees`` None: pairs are distinct, and an end's degree is the number of its
    pairs. ``known_once``: ``known`` is distinct and written.
    """
    da, db = degrees or (None, None)
    if not known_once and n_trick + n_obvious > 0:
        known = settled(known.select(a, b).distinct())
    left = settled(well_known(pairs, a, da, top[0]))
    right = well_known(pairs, b, db, top[1])
    little = _degree(pairs, b, db).where(F.col("_d") <= few).select(b)
    kinds = (("trick", right, n_trick, seed), ("obvious", little, n_obvious, seed + 1))
    parts = [untested_pairs(left, settled(side) if n > 0 else side, known, n, s, known_once=True).withColumn("kind", F.lit(kind)) for kind, side, n, s in kinds]
    return parts[0].unionByName(parts[1]).withColumn("answer", F.lit("untested"))


def essential_positives(dependency: DataFrame, effect: DataFrame, keys: Sequence[str], common: DataFrame, entity: str, at_least: float = 0.5) -> DataFrame:
    """Cells of a dependency matrix in long form (keys, value) from a probability on, with their effect and whether the entity is essential in common."""
    dep = dependency.where(F.col("value") >= at_least).withColumnRenamed("value", "dependency")
    both = dep.join(effect.withColumnRenamed("value", "effect"), list(keys), "left")
    marked = both.join(common.select(entity).distinct().withColumn("_common", F.lit(True)), entity, "left")
    return marked.withColumn("essentiality", F.when(F.col("_common"), "common_essential").otherwise("selective_essential")).drop("_common")


def viable(universe: DataFrame, positives: DataFrame, entity: str, ends: tuple[str, str]) -> DataFrame:
    """Entities of a universe that are in one positive pair at least, at either end."""
    seen = positives.select(F.explode(F.array(*ends)).alias(entity)).distinct()
    return universe.select(entity).distinct().join(seen, entity, "left_semi")


def zero_evidence_pairs(universe: DataFrame, entity: str, linked: DataFrame, ends: tuple[str, str], n: int, degrees: DataFrame | None = None, least_degree: int = 1, seed: int = 42) -> DataFrame:
    """``n`` pairs of one kind of entity (the lesser first) that aren't linked; with ``degrees`` (entity, degree), of well-connected ends only.

    The pairs are drawn from the numbered places of the product, which is never made.
    """
    side = universe.select(entity).distinct()
    if degrees is not None:
        side = side.join(degrees.where(F.col("degree") >= least_degree).select(entity), entity, "left_semi")
    side = settled(side)
    a, b = ends
    known = linked.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    # a place stands for an ordered pair: the two orders and the diagonal count as known
    both = known.union(known.select(F.col(b).alias(a), F.col(a).alias(b)).select(a, b)).union(side.select(F.col(entity).alias(a), F.col(entity).alias(b)))
    drawn = untested_pairs(side.select(F.col(entity).alias(a)), side.select(F.col(entity).alias(b)), both, 2 * n + 64, seed)
    return first_n(drawn.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct(), n, seed, [a, b])


def share_capped(pool: DataFrame, group: Column, most: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``most`` rows for which ``group`` holds, and all others."""
    marked = pool.withColumn("_g", F.coalesce(group, F.lit(False)))
    held = first_n(marked.where("_g"), most, seed, keys)
    return held.unionByName(marked.where("not _g")).drop("_g")


def two_class_balance(pool: DataFrame, klass: str, first: str, second: str, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows, half of each class; what one class lacks the other fills."""
    counts = dict(pool.where(F.col(klass).isin(first, second)).groupBy(klass).count().collect())  # two rows
    n = min(n, sum(counts.values()))
    n_first = min(n // 2, counts.get(first, 0))
    n_second = min(n - n_first, counts.get(second, 0))
    n_first = min(n - n_second, counts.get(first, 0))
    parts = [first_n(pool.where(F.col(klass) == k), m, seed, keys) for k, m in ((first, n_first), (second, n_second))]
    return parts[0].unionByName(parts[1])


def class_sample(pool: DataFrame, klass: str, most: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each class."""
    return first_n(pool.where(F.col(klass).isNotNull()), most, seed, keys, [klass])


def few_shot_examples(items: DataFrame, klass: str, keys: Sequence[str], which: int, n: int = 3, seed: int = 42) -> DataFrame:
    """The ``which``-th set of ``n`` examples of each class, in an order seeded by the set; a small class starts over."""
    ranked = hash_rank(items, seed + which, keys, [klass], "_r", "_n")
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct((j + 1).alias("example"), ((F.lit(which * n) + j) % F.col("_n") + 1).alias("place")))
    chosen = ranked.withColumn("_p", F.explode(places)).where(F.col("_p.place") == F.col("_r"))
    return chosen.withColumn("example", F.col("_p.example")).drop("_r", "_n", "_p")


def matched_by_quantile(target: DataFrame, pool: DataFrame, degree: str, n: int, keys: Sequence[str], bins: int = 10, seed: int = 42) -> DataFrame:
    """``n`` rows of ``pool`` whose degrees follow ``target`` over its quantile bins."""
    from .sampling import quota_matched
    from .splits import exact_quantiles

    edges = exact_quantiles(target, degree, [i / bins for i in range(bins + 1)])[1:-1]
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(degree))) if edges else F.lit(0)
    return quota_matched(target.withColumn("bin", place), pool.withColumn("bin", place), "bin", n, keys, seed)
