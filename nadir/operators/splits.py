"""Fold assignment. Seeded order is that of MD5 hashes; cuts are floor(n * ratio)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cold_both_graph
from .ordering import hash_rank, in_bands, ordinal, running_before

Ratios = tuple[float, float, float]
DEFAULT: Ratios = (0.7, 0.1, 0.2)
FOLDS = ("train", "val", "test")


def _cut(rank: Column, total: Column, ratios: Ratios) -> Column:
    train = F.floor(total * F.lit(float(ratios[0])))
    return F.when(rank <= train, "train").when(rank <= train + F.floor(total * F.lit(float(ratios[1]))), "val").otherwise("test")


def fold_rank(fold: Column) -> Column:
    return F.when(fold == "train", 0).when(fold == "val", 1).when(fold == "test", 2)


def _name(rank: Column) -> Column:
    return F.when(rank == 0, "train").when(rank == 1, "val").when(rank == 2, "test")


def random_split(df: DataFrame, keys: Sequence[str], seed: int = 42, ratios: Ratios = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Exact shares of all rows, or of each stratum in ``by``."""
    return hash_rank(df, seed, keys, by, "_r", "_n").withColumn("fold", _cut(F.col("_r"), F.col("_n"), ratios)).drop("_r", "_n")


def entity_folds(df: DataFrame, entity: str, seed: int = 42, ratios: Ratios = DEFAULT) -> DataFrame:
    """Each distinct non-null entity with its fold, by number of entities."""
    return random_split(df.where(F.col(entity).isNotNull()).select(entity).distinct(), [entity], seed, ratios)


def cold_entity(df: DataFrame, entity: str, seed: int = 42, ratios: Ratios = DEFAULT) -> DataFrame:
    """All rows of an entity share a fold; rows without one have none."""
    return df.join(entity_folds(df, entity, seed, ratios), entity, "left")


def cold_greedy(df: DataFrame, entity: str, seed: int = 42, ratios: Ratios = DEFAULT) -> DataFrame:
    """Entities in seeded order fill train until it has its share of rows, then val, then test.

    An entity goes where the rows before it leave off, so a fold may overshoot.
    """
    from .ordering import hash_key

    sizes = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("_n")).withColumn("_h", hash_key(seed, entity))
    total = sizes.agg(F.sum("_n").alias("_total"))
    filled = running_before(sizes, F.substring("_h", 1, 3), ["_h", entity], {"_before": "_n"}).join(F.broadcast(total))  # one row
    before, n = F.col("_before"), F.col("_total")
    # val begins with the first entity after train is full
    train = filled.where(before < n * F.lit(float(ratios[0]))).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_train"))
    filled = filled.join(F.broadcast(train))
    fold = F.when(before < n * F.lit(float(ratios[0])), "train").when(before - F.col("_train") < n * F.lit(float(ratios[1])), "val").otherwise("test")
    return df.join(filled.select(entity, fold.alias("fold")), entity, "left")


def max_rank(df: DataFrame, first: str, second: str, seed: int = 42, ratios: Ratios = DEFAULT, one_kind: bool = False) -> DataFrame:
    """Cold for both ends: the later of the ends' folds. ``one_kind``: both ends are drawn from one population."""
    if one_kind:
        ends = df.select(F.explode(F.array(first, second)).alias("_e"))
        folds = entity_folds(ends, "_e", seed, ratios)
        fa, fb = folds.select(F.col("_e").alias(first), F.col("fold").alias("_fa")), folds.select(F.col("_e").alias(second), F.col("fold").alias("_fb"))
    else:
        fa = entity_folds(df, first, seed, ratios).withColumnRenamed("fold", "_fa")
        fb = entity_folds(df, second, seed + 1, ratios).withColumnRenamed("fold", "_fb")
    joined = df.join(fa, first, "left").join(fb, second, "left")
    return joined.withColumn("fold", _name(F.greatest(fold_rank(F.col("_fa")), fold_rank(F.col("_fb"))))).drop("_fa", "_fb")


def partition_both(df: DataFrame, first: str, second: str, parts: int = 10, seed: int = 42, ratios: Ratios = DEFAULT) -> DataFrame:
    """Cold for both ends by parts of the entities: rows whose ends are in different folds have none.

    Parts are hashed: the same guarantee as by parts of the graph
    (``graphs.cold_both_graph``), with more rows left out.
    """
    part = lambda c: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string"))), 1, 4), 16, 10).cast("int") % parts
    fold = lambda p: F.when(p < int(parts * ratios[0]), 0).when(p < int(parts * ratios[0]) + max(1, int(parts * ratios[1])), 1).otherwise(2)
    a, b = fold(part(first)), fold(part(second))
    return df.withColumn("fold", F.when(a == b, _name(a)))


def temporal(df: DataFrame, year: str, train_before: int, val_before: int) -> DataFrame:
    """train < train_before <= val < val_before <= test; a null year is train."""
    y = F.col(year)
    return df.withColumn("fold", F.when(y.isNull() | (y < train_before), "train").when(y < val_before, "val").otherwise("test"))


def family_places(df: DataFrame, family: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Families (family, n, place) with their place among those of their size, by name; and how many each size has, largest first.

    There are at most sqrt(2 * rows) different sizes, so that list is small.
    """
    sizes = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("n"))
    placed = ordinal(sizes, [F.desc("n"), F.asc(family)], "_at")
    runs = sorted(map(tuple, placed.groupBy("n").agg(F.count("*").alias("m")).collect()), reverse=True)
    before, first = [], 0
    for n, m in runs:
        before.append((n, first))
        first += m
    table = F.broadcast(df.sparkSession.createDataFrame(before, "n long, _first long"))
    return placed.join(table, "n").withColumn("place", F.col("_at") - F.col("_first")).drop("_at", "_first"), runs


def running_total(df: DataFrame, family: str, ratios: Ratios = DEFAULT) -> DataFrame:
    """Families from the largest (ties to the least name) by the rows before each; rows without a family have no fold."""
    placed, runs = family_places(df, family)
    total, have, begins = sum(n * m for n, m in runs), 0, []
    for n, m in runs:
        begins.append((n, have))
        have += n * m
    table = F.broadcast(df.sparkSession.createDataFrame(begins, "n long, _rows long"))  # a row for each size
    before = F.col("_rows") + F.col("place") * F.col("n")
    fold = F.when(before < total * float(ratios[0]), "train").when(before < total * float(ratios[0] + ratios[1]), "val").otherwise("test")
    return df.join(placed.join(table, "n").select(family, fold.alias("fold")), family, "left")


def degree_grid(df: DataFrame, keys: Sequence[str], first: str, second: str, bins: int = 5, seed: int = 42, ratios: Ratios = DEFAULT) -> DataFrame:
    """Random within cells of equal-width bins of log1p of two degrees."""
    top = df.agg(F.max(F.log1p(F.col(first))).alias("_ma"), F.max(F.log1p(F.col(second))).alias("_mb"))
    cell = lambda c, m: F.floor(F.log1p(F.col(c)) / (F.col(m) + 1e-9) * bins).cast("int")
    cells = df.join(F.broadcast(top)).withColumns({"a_bin": cell(first, "_ma"), "b_bin": cell(second, "_mb")}).drop("_ma", "_mb")
    return random_split(cells, keys, seed, ratios, ["a_bin", "b_bin"])


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """0-based bin by distinct interpolated quantiles; the first bin holds its lower edge. Equal values share a bin, null has none."""
    edges = exact_quantiles(df, value, [i / bins for i in range(bins + 1)])
    place = F.size(F.filter(F.array(*map(F.lit, edges[1:-1])), lambda e: e < F.col(value))) if len(edges) > 2 else F.lit(0)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), place))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Distinct interpolated quantiles, exact: values are counted first, then found by their ranks in bands of the order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = in_bands(counts, ["v"])
    placed = running_before(counts, F.col("band"), ["v"], {"before": "n"})
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    at = [s * (total - 1) for s in shares]
    ranks = sorted({int(p) for p in at} | {min(int(p) + 1, total - 1) for p in at})
    hit = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    found = placed.agg(*(F.max(F.when(hit(r), F.col("v"))).alias(f"r{r}") for r in ranks)).first()
    value_at = {r: found[f"r{r}"] for r in ranks}
    out: list[float] = []
    for p in at:
        low, high = value_at[int(p)], value_at[min(int(p) + 1, total - 1)]
        x = low if p == int(p) else low * (1 - (p - int(p))) + high * (p - int(p))
        if x not in out:
            out.append(x)
    return out


def degree_quantile(df: DataFrame, keys: Sequence[str], degree: str, bins: int = 5, seed: int = 42, ratios: Ratios = DEFAULT) -> DataFrame:
    """Random within quantile bins of a degree."""
    return random_split(quantile_bins(df, degree, bins), keys, seed, ratios, ["bin"])


def leave_one_group_out(df: DataFrame, keys: Sequence[str], group: str, held_out: str | None = None, seed: int = 42, val_share: float = 0.1) -> DataFrame:
    """test is a group (the largest, ties to the least name), val max(1, share) of the rest, train what remains."""
    if held_out is None:
        sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
        held = sizes.agg(F.min_by(group, F.struct(-F.col("_n"), F.col(group))).alias("_held"))
        df = df.join(F.broadcast(held))
    else:
        df = df.withColumn("_held", F.lit(held_out))
    marked = df.withColumn("_test", F.coalesce(F.col(group) == F.col("_held"), F.lit(False))).drop("_held")
    ranked = hash_rank(marked, seed, keys, ["_test"], "_r", "_n")
    val = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(val_share)))
    return ranked.withColumn("fold", F.when(F.col("_test"), "test").when(F.col("_r") <= val, "val").otherwise("train")).drop("_test", "_r", "_n")


def few_shot(df: DataFrame, keys: Sequence[str], shots: int, val: int, test: int, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """fewshot, val and test in seeded order (within ``by``); the rest is left out."""
    r = F.col("_r")
    ranked = hash_rank(df, seed, keys, by, "_r").where(r <= shots + val + test)
    return ranked.withColumn("fold", F.when(r <= shots, "fewshot").when(r <= shots + val, "val").otherwise("test")).drop("_r")


def fitting(have: int, n: int, most: float, of: int) -> int:
    """How many of ``of`` families of size ``n`` fit one after another into a fold with ``have`` rows."""
    c = min(of, max(0, int((most - have) // n)))
    while c < of and have + (c + 1) * n <= most:
        c += 1
    while c and have + c * n > most:
        c -= 1
    return c


def shared_out(place: np.ndarray, n: np.ndarray, have: np.ndarray, total: int, ratios: Ratios) -> np.ndarray:
    """How many of the first ``place`` families of size ``n`` each fold gets by the rule of the fold that lacks most.

    A fold's t-th family comes when it lacks (have + t * n) / total - ratio, so the
    choices are those values of the folds merged in order: a level to which all
    folds fill up gives the counts but for a few, which are then set right one by one.
    """
    share = np.array(ratios)
    lack = share * total - have
    active = np.ones(have.shape, bool)
    for _ in range(len(ratios)):
        level = (place * n - np.where(active, lack, 0).sum(axis=1)) / np.maximum(1, active.sum(axis=1))
        active &= level[:, None] + lack > 0
    counts = np.where(active, np.maximum(0, (level[:, None] + lack) // n[:, None]), 0).astype(np.int64)
    key = lambda c: (have + c * n[:, None]) / total - share
    rows, kinds = np.arange(len(place)), np.arange(len(ratios))
    while True:
        due = key(counts)
        nxt = due.argmin(axis=1)  # ties go to the first fold
        last = np.where(counts > 0, key(counts - 1), -np.inf)
        top = last.max(axis=1)
        end = np.where(last == top[:, None], kinds, -1).max(axis=1)  # and so the last of equals came last
        spare = counts.sum(axis=1) - place
        over = (top > due[rows, nxt]) | ((top == due[rows, nxt]) & (end > nxt))
        less, more = (spare > 0) | ((spare == 0) & over), (spare < 0) | ((spare == 0) & over)
        if not (less | more).any():
            return counts
        counts[rows[less], end[less]] -= 1
        counts[rows[more], nxt[more]] += 1


def family_greedy(df: DataFrame, family: str, rule: str = "best_fit", seed: int | None = None, ratios: Ratios = DEFAULT) -> DataFrame:
    """Families one after another by ``best_fit`` (skip a full fold) or ``underfilled`` (the fold that lacks most).

    Largest first, ties to the least name: inside a run of families of one size
    the choices follow from the state at its beginning by arithmetic, and there are
    at most sqrt(2 * rows) runs, so the driver goes through the sizes and every
    family finds its fold by its place in its run. In seeded order (``seed``) each
    choice hangs on all before it; the rule itself then runs on one worker, in one
    stream of narrow rows that is never gathered.
    """
    if seed is not None:
        return _seeded_greedy(df, family, rule, seed, ratios)
    placed, runs = family_places(df, family)
    total = sum(n * m for n, m in runs)
    have, states = [0, 0, 0], []
    for n, m in runs:
        if rule == "best_fit":
            train = fitting(have[0], n, total * ratios[0], m)
            val = fitting(have[1], n, total * ratios[1], m - train)
            got = [train, val, m - train - val]
        else:
            got = shared_out(np.array([m]), np.array([n]), np.array([have], np.int64), total, ratios)[0].tolist()
        states.append((n, *have, *got))
        have = [h + c * n for h, c in zip(have, got, strict=True)]
    table = F.broadcast(df.sparkSession.createDataFrame(states, "n long, h0 long, h1 long, h2 long, c0 long, c1 long, c2 long"))  # a row for each size
    rows = placed.join(table, "n")
    if rule == "best_fit":
        fold = F.when(F.col("place") < F.col("c0"), "train").when(F.col("place") < F.col("c0") + F.col("c1"), "val").otherwise("test")
    else:
        @F.pandas_udf("int")
        def turn(place: pd.Series, n: pd.Series, h0: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
            held, size = np.stack([h0, h1, h2], axis=1).astype(np.int64), n.to_numpy(np.int64)
            counts = shared_out(place.to_numpy(np.int64), size, held, total, ratios)
            return pd.Series(((held + counts * size[:, None]) / total - np.array(ratios)).argmin(axis=1).astype(np.int32))

        fold = _name(turn("place", "n", "h0", "h1", "h2"))
    return df.join(rows.select(family, fold.alias("fold")), family, "left")


def _seeded_greedy(df: DataFrame, family: str, rule: str, seed: int, ratios: Ratios) -> DataFrame:
    from .ordering import hash_key

    sizes = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    kind = df.schema[family].dataType.simpleString()

    def run(batches):
        have = [0, 0, 0]

        def best_fit(n: int) -> int:
            return next((k for k in (0, 1) if have[k] + n <= total * ratios[k]), 2)

        def underfilled(n: int) -> int:
            return min(range(3), key=lambda k: (have[k] / total - ratios[k], k))

        choose = {"best_fit": best_fit, "underfilled": underfilled}[rule]
        for pdf in batches:
            folds = []
            for n in pdf["n"].tolist():
                k = choose(n)
                have[k] += n
                folds.append(FOLDS[k])
            yield pdf.assign(fold=folds)[[family, "fold"]]

    folds = sizes.repartition(1).sortWithinPartitions(hash_key(seed, family), F.col(family)).mapInPandas(run, f"`{family}` {kind}, fold string")
    return df.join(folds, family, "left")


def gene_groups(df: DataFrame, group: str, seed: int = 42, ratios: Ratios = DEFAULT) -> DataFrame:
    """Cold by groups of one end only, each to the fold that lacks most. The other end may cross folds: this is no split cold for both."""
    return family_greedy(df, group, "underfilled", seed, ratios)


def cold_primary(df: DataFrame, key: str, triples: DataFrame, entity: str, seed: int = 42, ratios: Ratios = DEFAULT) -> DataFrame:
    """Cold by each key's primary entity: the one it has most rows with in ``triples`` (ties to the least)."""
    counts = triples.groupBy(key, entity).agg(F.count("*").alias("_n"))
    primary = counts.groupBy(key).agg(F.min_by(entity, F.struct(-F.col("_n"), F.col(entity))).alias("primary"))
    return cold_entity(df.join(primary, key, "left"), "primary", seed, ratios)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "random": random_split, "cold_entity": cold_entity, "cold_greedy": cold_greedy, "max_rank": max_rank, "partition_both": partition_both, "cold_both_graph": cold_both_graph, "temporal": temporal,
    "running_total": running_total, "degree_grid": degree_grid, "degree_quantile": degree_quantile, "leave_one_group_out": leave_one_group_out, "few_shot": few_shot, "family_greedy": family_greedy, "gene_groups": gene_groups, "cold_primary": cold_primary,
}


def apply_split(df: DataFrame, strategy: str, **options) -> DataFrame:
    """Dispatch by name."""
    return STRATEGIES[strategy](df, **options)


def latest_version(definitions: DataFrame, name: str = "split_name") -> DataFrame:
    """Of split names with a ``_vN`` ending, the row with the greatest N for each base; none is version 0."""
    version = F.coalesce(F.nullif(F.regexp_extract(name, r"_v(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    rows = definitions.withColumn("base", F.regexp_replace(name, r"_v\d+$", "")).withColumn("version", version)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("version"), name))).where("_r = 1").drop("_r")


def apply_bundle(df: DataFrame, bundle: dict[str, tuple[str, dict]]) -> DataFrame:
    """Several splits of one frame at once: a column ``split_<name>`` for each name of (strategy, options)."""
    out = df
    for name, (strategy, options) in bundle.items():
        out = apply_split(out, strategy, **options).withColumnRenamed("fold", f"split_{name}")
        out = out.drop(*(c for c in out.columns if c not in df.columns and not c.startswith("split_")))
    return out


def register(assignments: DataFrame | None, new: DataFrame, name: str, strategy: str, key: str, seed: int, ratios: Ratios = DEFAULT) -> DataFrame:
    """Long assignments (split_name, strategy, seed, ratios, key, fold) with those of ``name`` replaced."""
    rows = new.where(F.col("fold").isNotNull()).select(F.lit(name).alias("split_name"), F.lit(strategy).alias("strategy"), F.lit(seed).alias("seed"), F.lit("/".join(map(str, ratios))).alias("ratios"), F.col(key).alias("key"), "fold")
    return rows if assignments is None else assignments.where(F.col("split_name") != name).unionByName(rows)


def pivot_folds(assignments: DataFrame, key: str, strategies: Sequence[str]) -> DataFrame:
    """One row for each key, a column for each strategy."""
    return assignments.groupBy(key).pivot("strategy", list(strategies)).agg(F.first("fold"))
