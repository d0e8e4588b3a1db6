"""Audits: leakage, overlap, completeness, profiles, validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leakage(df: DataFrame, entity: str, fold: str = "fold") -> DataFrame:
    """Distinct entities of train, of test, and of both: the last must be 0 for a cold split."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.bool_or(F.col(fold) == "train").alias("tr"), F.bool_or(F.col(fold) == "test").alias("te"))
    return per.agg(F.count_if(F.col("tr")).alias("n_train"), F.count_if(F.col("te")).alias("n_test"), F.count_if(F.col("tr") & F.col("te")).alias("n_leaked"))


def source_overlap(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Distinct keys that each two sources share, by the sets of sources of each key."""
    sets = df.groupBy(*keys).agg(F.array_sort(F.collect_set(source)).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    first = sets.select(F.explode("s").alias("source_a"), "s", "n")
    return first.select("source_a", F.explode("s").alias("source_b"), "n").where("source_a < source_b").groupBy("source_a", "source_b").agg(F.sum("n").alias("n_shared"))


def completeness(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Share of non-null values of each column in each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *((F.count(c) / F.count("*")).alias(f"{c}_filled") for c in columns))


def percent_of_total(df: DataFrame, by: str) -> DataFrame:
    """Rows and percent of all rows for each value, null included."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def policy_audit(df: DataFrame, policies: dict[str, Column], unique: str) -> DataFrame:
    """In one pass, rows and distinct keys that each policy's predicate lets through."""
    out = [c for n, p in policies.items() for c in (F.count_if(F.coalesce(p, F.lit(False))).alias(f"{n}_rows"), F.countDistinct(F.when(p, F.col(unique))).alias(f"{n}_keys"))]
    return df.agg(F.count("*").alias("n"), *out)


def schema_difference(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns whose presence or type differs, without reading a row."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return sorted(c for c in a.keys() | b.keys() if a.get(c) != b.get(c))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break; a rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())))
    return df.withColumn("violations", broken).where(F.size("violations") > 0)


def fold_summary(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Rows and share of each fold of each split column; rows without a fold don't count."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.col(s).alias("fold")) for s in splits))).alias("x")).select("x.*").where("fold is not null")
    counts = long.groupBy("split", "fold").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))  # a few rows


def leakage_report(evidence: DataFrame, pairs: DataFrame, keys: Sequence[str], source: str, sources: str, cold: dict[str, str], splits: Sequence[str]) -> DataFrame:
    """All checks of a release in one long frame (section, name, detail, value).

    Sizes, rows by source, folds by split, leaked entities of cold splits
    (split to entity), keys that two sources share, pairs by number of sources.
    """
    def rows(section: str, df: DataFrame, name: Column, detail: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), detail.cast("string").alias("detail"), value.cast("double").alias("value"))

    none = F.lit(None)
    out = [
        rows("size", evidence.agg(F.count("*").alias("n")), F.lit("evidence"), none, F.col("n")),
        rows("size", pairs.agg(F.count("*").alias("n")), F.lit("pairs"), none, F.col("n")),
        *(rows("size", pairs.agg(F.countDistinct(k).alias("n")), F.lit(k), none, F.col("n")) for k in keys),
        rows("source", evidence.groupBy(source).agg(F.count("*").alias("n")), F.col(source), none, F.col("n")),
        rows("fold", fold_summary(pairs, splits), F.col("split"), F.col("fold"), F.col("n")),
        *(rows("leaked", leakage(pairs, entity, split), F.lit(split), F.lit(entity), F.col("n_leaked")) for split, entity in cold.items()),
        rows("overlap", source_overlap(evidence, keys, source), F.col("source_a"), F.col("source_b"), F.col("n_shared")),
        rows("sources", pairs.groupBy(sources).agg(F.count("*").alias("n")), F.col(sources), none, F.col("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), out)


def profile(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """A data set's profile in one long frame (section, name, detail, value): filled cells, ranges, values, and rows that a flag names."""
    n = F.count("*")
    wide = df.agg(n.alias("rows"), *(F.count(c).alias(f"filled|{c}") for c in df.columns), *(f(c).cast("double").alias(f"{k}|{c}") for c in numbers for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"flag|{k}") for k, c in flags.items()))
    cells = F.explode(F.array(*(F.struct(F.substring_index(F.lit(c), "|", 1).alias("section"), F.when(F.contains(F.lit(c), F.lit("|")), F.substring_index(F.lit(c), "|", -1)).alias("name"), F.lit(None).cast("string").alias("detail"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns)))
    out = wide.select(cells.alias("x")).select("x.*")
    for c in categories:
        out = out.unionByName(df.groupBy(c).agg(n.alias("n")).select(F.lit("value").alias("section"), F.lit(c).alias("name"), F.col(c).cast("string").alias("detail"), F.col("n").cast("double").alias("value")))
    return out


def qc_sample(df: DataFrame, rules: dict[str, Column], keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Of the rows that break each rule, ``n`` in seeded order, with the rule's name."""
    from .ordering import first_n

    broken = F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()))))
    return first_n(df.withColumn("rule", broken), n, seed, keys, ["rule"])


def domain_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two domains, those of both, and their percent of the left; keys are compared in upper case."""
    side = lambda df, name: df.select(F.upper(F.trim(F.col(key).cast("string"))).alias("k")).where("k is not null").distinct().withColumn(name, F.lit(1))
    both = side(left, "l").join(side(right, "r"), "k", "full_outer")
    nl, nr, nb = F.count("l"), F.count("r"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.agg(nl.alias("n_left"), nr.alias("n_right"), nb.alias("n_both"), (100.0 * nb / F.greatest(nl, F.lit(1))).alias("percent"))


def overlap_by_class(pairs: DataFrame, shared: Column, klass: str, measures: dict[str, Column]) -> DataFrame:
    """Pairs with and without something shared: their number, measures, and rows of each class."""
    return pairs.where(F.col(klass).isNotNull()).groupBy(F.when(F.coalesce(shared, F.lit(False)), "shared").otherwise("no_shared").alias("overlap"), klass).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in measures.items()))


def edge_list(links: DataFrame, a: str, b: str, names: DataFrame, key: str, name: str, partitions: int | None = None) -> DataFrame:
    """Undirected edges (low, high) of named nodes from links of keys: both ends must be named, loops and repeats go.

    Links of nodes with a name are made distinct by their keys before they are named. ``partitions`` is for
    links that seldom come twice in a task, which are shuffled as they are into so many.
    """
    ends = [names.select(F.col(key).alias(c), F.col(name).alias(f"_{c}")) for c in (a, b)]
    for c in (a, b):
        links = links.join(names.select(F.col(key).alias(c)), c, "left_semi")
    once = links.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    once = (once.repartition(partitions, a, b) if partitions else once).distinct()
    joined = once.join(ends[0], a).join(ends[1], b).where(F.col(f"_{a}") != F.col(f"_{b}"))
    return joined.select(F.least(f"_{a}", f"_{b}").alias("low"), F.greatest(f"_{a}", f"_{b}").alias("high")).distinct()


def fresh_runs(runs: DataFrame, affected: Column, modified: str, since: Column) -> DataFrame:
    """Runs without those that are affected by a change and older than it."""
    return runs.where(~(F.coalesce(affected, F.lit(False)) & F.coalesce(F.col(modified) < since, F.lit(False))))


def filtered_results(runs: DataFrame, **wanted: Sequence | None) -> DataFrame:
    """Runs whose columns have one of the values given; None filters nothing."""
    tests = [F.col(c).isin(*values) for c, values in wanted.items() if values is not None]
    return runs.where(reduce(lambda a, b: a & b, tests)) if tests else runs
