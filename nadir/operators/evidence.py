"""Evidence layer: normalise, deduplicate, upsert, upgrade tiers, resolve names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nadir.functions.parsers import clean_drug_name

from .names import fuzzy_match
from .pairs import first_per_group


def first_writer_wins(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Insert-or-ignore: the first row of each key in ``order``; existing keys stay as they are. Null keys match null."""
    fresh = first_per_group(incoming, list(keys), list(order))
    if existing is None:
        return fresh
    e, f = existing.alias("e"), fresh.alias("f")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return existing.unionByName(f.join(e, same, "left_anti"))


def last_writer_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Insert-or-replace: incoming rows supersede existing ones; among them the first in ``order``."""
    both = existing.withColumn("_p", F.lit(1)).unionByName(incoming.withColumn("_p", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("_p", *order)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def concordance_upgrade(evidence: DataFrame, keys: Sequence[str], source: str, tier: str, upgrade: Column, support: Column, new_tier: str = "silver") -> DataFrame:
    """Rows under ``upgrade`` whose key has a supporting row of another source get ``new_tier``."""
    backing = evidence.where(support).groupBy(*keys).agg(F.min(source).alias("_s0"), F.max(source).alias("_s1"))
    joined = evidence.join(backing, list(keys), "left")
    other = F.coalesce((F.col("_s0") != F.col(source)) | (F.col("_s1") != F.col(source)), F.lit(False))
    changed = F.coalesce(upgrade, F.lit(False)) & other
    return joined.withColumn("upgraded", changed.cast("int")).withColumn(tier, F.when(changed, new_tier).otherwise(F.col(tier))).drop("_s0", "_s1")


def tier_chain(df: DataFrame, tier: str, has_result: Column, has_p_value: Column) -> DataFrame:
    """bronze becomes silver with a result, then silver becomes gold with a p-value."""
    first = df.withColumn(tier, F.when((F.col(tier) == "bronze") & has_result, "silver").otherwise(F.col(tier)))
    return first.withColumn(tier, F.when((F.col(tier) == "silver") & has_p_value, "gold").otherwise(F.col(tier)))


def staged_lookup(names: DataFrame, name: str, stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Resolve names by stages (label, frame of name and id): each stage sees what the ones before left.

    The lookup side is one row a name (the least id), so no row multiplies.
    """
    left, done = names, None
    for label, table in stages:
        key, value = table.columns
        one = table.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("resolved"))
        tried = left.join(one, F.col(name) == F.col("_k"), "left").drop("_k")
        hit = tried.where("resolved is not null").withColumn("stage", F.lit(label))
        done = hit if done is None else done.unionByName(hit)
        left = tried.where("resolved is null").drop("resolved")
    rest = left.withColumn("resolved", F.lit(None).cast(dict(done.dtypes)["resolved"])).withColumn("stage", F.lit(None).cast("string"))
    return done.unionByName(rest)


def resolve_names(names: DataFrame, name: str, exact: DataFrame, cache: DataFrame, vocabulary: DataFrame, overrides: DataFrame, least: float = 0.9) -> DataFrame:
    """Names with ``resolved`` and ``stage``: by exact synonyms, then a cache, then the nearest name of a vocabulary, then overrides.

    All four are frames of a cleaned name and an id. Names are cleaned first;
    each stage sees what the ones before left. Only unresolved distinct names
    meet the vocabulary.
    """
    cleaned = names.withColumn("_clean", clean_drug_name(F.col(name)))
    left = cleaned.select("_clean").distinct()
    for table in (exact, cache):
        left = left.join(table.select(F.col(table.columns[0]).alias("_clean")), "_clean", "left_anti")
    key, value = vocabulary.columns
    near = fuzzy_match(left, "_clean", vocabulary, key, least).join(vocabulary.groupBy(F.col(key).alias("match")).agg(F.min(value).alias("id")), "match").select("query", "id")
    return staged_lookup(cleaned, "_clean", [("exact", exact), ("cache", cache), ("fuzzy", near), ("override", overrides)]).drop("_clean")


def with_controls(df: DataFrame, controls: Sequence[tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Columns of control frames (frame, keys, columns) beside the rows, null where a frame has no such key; of several rows of a key the least values count."""
    out = df
    for table, keys, columns in controls:
        out = out.join(table.groupBy(*keys).agg(*(F.min(c).alias(c) for c in columns)), list(keys), "left")
    return out


def fallback_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], value: str, name: str) -> DataFrame:
    """The value found by the first pair of (left key, right key) that matches."""
    out, found = left, []
    for i, (lk, rk) in enumerate(keys):
        one = right.where(F.col(rk).isNotNull()).groupBy(F.col(rk).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(one, F.col(lk) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*(f"_k{i}" for i in range(len(keys))), *(f"_v{i}" for i in range(len(keys))))


def bliss_excess(long: DataFrame, by: Sequence[str], i: str, j: str, value: str) -> DataFrame:
    """Mean of observed minus expected inhibition of a dose matrix in long form, over cells with both doses.

    Dose 0 rows and columns are the single agents; values are inhibition in [0, 1].
    """
    alone_i = long.where(F.col(j) == 0).select(*by, i, F.col(value).alias("_a"))
    alone_j = long.where(F.col(i) == 0).select(*by, j, F.col(value).alias("_b"))
    cells = long.where((F.col(i) > 0) & (F.col(j) > 0)).join(alone_i, [*by, i]).join(alone_j, [*by, j])
    return cells.groupBy(*by).agg(F.avg(F.col(value) - (F.col("_a") + F.col("_b") - F.col("_a") * F.col("_b"))).alias("bliss_excess"), F.count("*").alias("n_cells"))
