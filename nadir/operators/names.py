"""Nearest names by Jaro-Winkler similarity, over an inverted index of character counts.

A similarity fixes how many characters two names of given lengths must share,
as multisets. Names are taken apart into (character, occurrence) tokens in one
order, rare ones first; the tokens that two names share then begin within a
short prefix of both. The smallest two that they share (one, where that prefix is long) are the
key at which the pair meets, so a pair meets once. Any order is exact, so the
table of frequent tokens, which is bounded, decides about speed alone.

Names with the same first three characters may share a longer prefix, which
raises the similarity; they have a key of their own, which the three characters
are part of, and its bound on shared characters is lower than for other pairs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FREQUENT = 512  # tokens whose order is by their counts; all others come first
_LONG = 64  # pairs with a longer name are scored one by one
_WIDE = 12  # characters outside the shared ones above which one token is a key


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity, prefix weight 0.1 over at most four characters."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, first = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, f in zip(b, free, strict=True) if not f]
    m, swapped = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _codes(names: list[str], width: int) -> np.ndarray:
    """Code points in rows of one width, padded with zeros."""
    flat = np.frombuffer("".join(n.ljust(width, "\0") for n in names).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.reshape(len(names), width)


def _scores(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many short pairs at once, by the same arithmetic."""
    n, la, lb = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    left, right = _codes(a, max(4, int(la.max()))), _codes(b, max(4, int(lb.max())))
    at = np.arange(right.shape[1])
    free, used = at < lb[:, None], np.zeros(left.shape, bool)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    rows = np.arange(n)
    for i in range(int(la.max())):
        may = free & (right == left[:, i : i + 1]) & (np.abs(at - i) <= reach) & (i < la)[:, None]
        j = may.argmax(axis=1)
        hit = may[rows, j]
        free[rows[hit], j[hit]] = False
        used[hit, i] = True
    taken = (at < lb[:, None]) & ~free
    m = used.sum(axis=1)
    width = int(m.max()) if n else 0
    one = np.take_along_axis(left, np.argsort(~used, axis=1, kind="stable"), 1)[:, :width]
    two = np.take_along_axis(right, np.argsort(~taken, axis=1, kind="stable"), 1)[:, :width]
    swapped = ((one != two) & (np.arange(width) < m[:, None])).sum(axis=1) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        jaro = (m / la + m / lb + (m - swapped) / m) / 3
    same = (left[:, :4] == right[:, :4]) & (np.arange(4) < np.minimum(la, lb)[:, None])
    out = jaro + np.cumprod(same, axis=1).sum(axis=1) * 0.1 * (1 - jaro)
    equal = np.fromiter((x == y for x, y in zip(a, b, strict=True)), bool, n)
    return np.where(equal, 1.0, np.where(m > 0, out, 0.0))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity of two columns of names that aren't empty."""
    out = np.zeros(len(a))
    long = (np.maximum(a.str.len(), b.str.len()) > _LONG).to_numpy()
    for i in np.flatnonzero(long):
        out[i] = jaro_winkler(a.iloc[i], b.iloc[i])
    short = np.flatnonzero(~long)
    for k in range(0, len(short), 4096):
        part = short[k : k + 4096]
        out[part] = _scores(a.iloc[part].tolist(), b.iloc[part].tolist())
    return pd.Series(out)


def _shared(a: int, b: int, jaro: float) -> int:
    """Characters that names of these lengths must share for a Jaro similarity, all in the same order."""
    return max(1, ceil((3 * jaro - 1) * a * b / (a + b) - 1e-9))


def _tokens(name: str, order: dict[str, int]) -> list[str]:
    """The name's characters, numbered from their second occurrence on, rare ones first."""
    seen: dict[str, int] = {}
    out = []
    for c in name:
        k = seen[c] = seen.get(c, 0) + 1
        out.append(c if k == 1 else f"{c}{k}")
    return sorted(out, key=lambda t: (order.get(t, -1), t))


@lru_cache(maxsize=65536)
def _plan(own: int, other: int, jaro: float) -> tuple[int, int] | None:
    """Length of the prefix of tokens and number of tokens in a key; None where the lengths can't reach the similarity."""
    m = _shared(own, other, jaro)
    if m > min(own, other):
        return None
    size = 2 if m > 1 and max(own, other) - m <= _WIDE else 1
    return own - m + size, size


def _keyed(names: DataFrame, column: str, order: dict[str, int], least: float, gap: int, block: int, query: bool) -> DataFrame:
    """A row for each name and key, with the prefix of tokens that the key was taken from."""
    bounds = (("=", (least - 0.4) / 0.6), ("<", (least - 0.2) / 0.8))

    def keys(batches):
        for batch in batches:
            rows = []
            for name in batch[column]:
                tokens, own = _tokens(name, order), len(name)
                for other in range(max(1, own - gap), own + gap + 1):
                    lengths = f"{own},{other}" if query else f"{other},{own}"
                    for kind, jaro in bounds:
                        found = _plan(own, other, jaro)
                        if found is None:
                            continue
                        prefix = tokens[: found[0]]
                        start = name[: max(3, block)] if kind == "=" else name[:block]
                        stem = f"{kind}{found[1]}{lengths},{len(start)}{start}"
                        rows += [(name, "\t".join([stem, *pick]), prefix) for pick in combinations(prefix, found[1])]
                        if len(rows) > 20000:
                            yield pd.DataFrame(rows, columns=[column, "_key", f"_{column}"])
                            rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[column, "_key", f"_{column}"])

    return names.select(column).mapInPandas(keys, f"{column} string, _key string, _{column} array<string>")


def candidates(queries: DataFrame, names: DataFrame, least: float, length_gap: int, block_prefix: int = 0) -> DataFrame:
    """Pairs (query, match) of distinct names that share the characters they must, each once; the frames have these columns."""
    chars = names.select(F.explode(F.split("match", "")).alias("c"), "match").groupBy("match", "c").count()
    tokens = chars.select("c", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("k"))
    token = F.when(F.col("k") == 1, F.col("c")).otherwise(F.concat("c", F.col("k").cast("string")))
    common = tokens.groupBy(token.alias("t")).count().orderBy(F.desc("count"), "t").limit(_FREQUENT).collect()
    order = {r["t"]: len(common) - i for i, r in enumerate(common)}
    left = _keyed(queries, "query", order, least, length_gap, block_prefix, True)
    right = _keyed(names, "match", order, least, length_gap, block_prefix, False)
    n = F.substring("_key", 2, 1).cast("int")
    common_first = F.slice(F.array_intersect("_query", "_match"), F.lit(1), n)
    first = F.col("_key").endswith(F.concat(F.lit("\t"), F.array_join(common_first, "\t"))) & (F.size(common_first) == n)
    other = F.col("_key").startswith("=") | (F.substring("query", 1, 3) != F.substring("match", 1, 3))
    return left.join(right, "_key").where(other & first).select("query", "match")


def fuzzy_match(queries: DataFrame, query: str, names: DataFrame, name: str, least: float = 0.9, length_gap: int = 5, block_prefix: int = 0) -> DataFrame:
    """query, match, similarity: the best name of Jaro-Winkler ``least`` or more (over 0) whose length is within the gap.

    Candidates are all names of such a length that share enough characters; ties
    go to the least name. Null and empty names take no part. A ``block_prefix`` over 0 also asks
    for that many equal first characters, which loses matches that differ there.
    """
    if least <= 0:
        raise ValueError("least must be over 0")
    q = queries.select(F.col(query).alias("query")).distinct().where("query <> ''")
    n = names.select(F.col(name).alias("match")).distinct().where("match <> ''")
    # characters that the other name has, too, bound the matching ones; a common prefix adds 0.4 of the rest at most
    shared = F.expr("least(length(query) - length(translate(query, match, '')), length(match) - length(translate(match, query, '')))")
    may = shared / F.length("query") + shared / F.length("match") >= 3 * (least - 0.4) / 0.6 - 1 - 1e-9
    pairs = candidates(q, n, least, length_gap, block_prefix).where(may)
    scored = pairs.withColumn("similarity", similarity("query", "match")).where(F.col("similarity") >= least)
    best = scored.groupBy("query").agg(F.min_by(F.struct("match", "similarity"), F.struct(-F.col("similarity"), F.col("match"))).alias("b"))
    return best.select("query", "b.match", "b.similarity")
