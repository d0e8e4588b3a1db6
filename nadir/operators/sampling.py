"""Exact, seeded sampling and negative builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import first_n, hash_key, hash_rank, running_before, settled


def balanced(positives: DataFrame, negatives: DataFrame, keys: Sequence[str], ratio: int = 1, seed: int = 42) -> DataFrame:
    """All of what is scarce, and exact numbers of the rest: ``ratio`` negatives to a positive, labelled 1 and 0.

    Too few negatives cut the positives to what they match.
    """
    n_pos, n_neg = positives.count(), negatives.count()
    want_pos = min(n_pos, n_neg // ratio)
    pos = first_n(positives, want_pos, seed, keys).withColumn("label", F.lit(1))
    neg = first_n(negatives, want_pos * ratio, seed, keys).withColumn("label", F.lit(0))
    return pos.unionByName(neg)


def conflict_free(positives: DataFrame, negatives: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without the keys that are in both."""
    both = positives.select(*keys).intersect(negatives.select(*keys))
    return positives.join(both, list(keys), "left_anti"), negatives.join(both, list(keys), "left_anti")


def capped(df: DataFrame, entity: str, keys: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each entity, in seeded order."""
    w = Window.partitionBy(entity).orderBy(hash_key(seed, *keys), *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def untested_pairs(a_side: DataFrame, b_side: DataFrame, tested: DataFrame, n: int, seed: int = 42, oversample: float = 2.0, known_once: bool = False) -> DataFrame:
    """``n`` pairs of the two sides' keys that aren't tested, in seeded order of the pair.

    The cross product is never made: candidate places of it are drawn by hash
    from its row numbers in ever larger blocks until enough untested pairs are
    found. The sides are frames of one key column; places are 0-based ranks.
    ``known_once``: ``tested`` is distinct and written already. Of it only what is
    among the candidates is shuffled, as long as these are few.
    """
    a, b = a_side.columns[0], b_side.columns[0]
    if n <= 0:
        return a_side.crossJoin(b_side).limit(0)
    spark = a_side.sparkSession
    left = settled(hash_rank(a_side.distinct(), seed, [a], name="_i").withColumn("_i", F.col("_i") - 1))
    right = settled(hash_rank(b_side.distinct(), seed + 1, [b], name="_j").withColumn("_j", F.col("_j") - 1))
    na, nb = left.count(), right.count()
    known = tested.select(a, b) if known_once else settled(tested.select(a, b).distinct())
    room = na * nb
    want = min(room, int(n * oversample) + known.count() * n // max(1, room) + 16)
    found = None
    while True:
        # a multiplicative walk visits every place of the product once
        step = next(s for s in range(int(room * 0.6180339887) | 1, room * 2 + 3, 2) if _coprime(s, room)) if room > 2 else 1
        places = spark.range(want).select((F.col("id").cast("decimal(38,0)") * F.lit(step) + F.lit(seed)).alias("_x"))
        place = F.col("_x") % F.lit(room)
        cells = places.select(F.floor(place / nb).cast("long").alias("_i"), (place % nb).cast("long").alias("_j"))
        pairs = settled(cells.join(left, "_i").join(right, "_j").select(a, b))
        found = settled(pairs.join(known.join(pairs, [a, b], "left_semi"), [a, b], "left_anti"), found)
        if want >= room or found.count() >= n:
            return first_n(found, n, seed, [a, b])
        want = min(room, want * 2)


def _coprime(x: int, y: int) -> bool:
    import math

    return math.gcd(x, y) == 1


def quota_matched(target: DataFrame, pool: DataFrame, bin_col: str, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows of ``pool`` whose bins follow the bins of ``target``.

    Each bin's quota is floor(n * share); what remains goes one by one to the
    largest bins (ties to the lesser bin). A bin with too few rows gives what it has.
    """
    counts = target.groupBy(bin_col).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    quota = counts.join(F.broadcast(total)).withColumn("_q", F.floor(F.lit(n) * F.col("_n") / F.col("_t")))
    rest = quota.agg((F.lit(n) - F.sum("_q")).alias("_rest"))
    by_size = Window.orderBy(F.desc("_n"), bin_col)  # over bins, a handful of rows
    quota = quota.withColumn("_r", F.row_number().over(by_size)).join(F.broadcast(rest)).withColumn("_q", F.col("_q") + F.when(F.col("_r") <= F.col("_rest"), 1).otherwise(0))
    ranked = hash_rank(pool, seed, keys, [bin_col], "_r")
    return ranked.join(quota.select(bin_col, "_q"), bin_col).where(F.col("_r") <= F.col("_q")).drop("_r", "_q")


def log2_bin(degree: Column) -> Column:
    """floor(log2) of a degree; below 1 is bin 0."""
    return F.floor(F.log2(F.greatest(degree, F.lit(1)))).cast("int")


def weighted(df: DataFrame, weight: Column, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement with chances by weight: the least of -ln(u)/w, u from the row's hash."""
    u = (F.conv(F.substring(hash_key(seed, *keys), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))
    return df.withColumn("_k", -F.log(u) / weight).where(weight > 0).orderBy("_k", *keys).limit(n).drop("_k")


def draw_number(seed: int, draw: Column, side: str, below: int) -> Column:
    """A number from 0 to ``below`` - 1 for each draw: the first 60 bits of MD5(seed:draw:side)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), F.lit(side)))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(below).cast("long"))


def weighted_pairs(a_side: DataFrame, b_side: DataFrame, tested: DataFrame, n: int, seed: int = 42, one_kind: bool = False, most_tries: int = 64) -> DataFrame:
    """``n`` untested pairs whose ends are drawn by weight: (a, b, draw), in the order of their draws.

    The sides are frames of a key and an integer weight; keys of one side are
    distinct, and those with a null, zero or negative weight are never drawn. Draw i
    is a number below the sum of weights on either side, and a key owns a
    range of those numbers; both are cut into cells, so that the join of draws and
    ranges is an equi-join and the product of the sides is never made. A tested pair,
    one drawn before, and with ``one_kind`` a key with itself, is no result
    (and a pair's ends are put in order). Draws go on in blocks until there are
    ``n``; fewer come only if ``most_tries`` times ``n`` draws haven't found them, or
    there are no more. The result doesn't depend on the blocks.
    """
    a, b = a_side.columns[0], b_side.columns[0]
    spark = a_side.sparkSession
    sides = []
    for tag, side in (("a", a_side), ("b", b_side)):
        key, weight = side.columns
        own = side.select(F.col(key).alias("key"), F.col(weight).cast("long").alias("w")).where("w > 0 and key is not null")
        total, keys = own.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count("*")).first()
        if not total:
            return spark.createDataFrame([], "draw long").join(a_side.select(a).limit(0)).join(b_side.select(F.col(b).alias("_b")).limit(0)).select(F.col(a).alias("a"), F.col("_b").alias("b"), "draw")
        width = max(1, total // (2 * keys))
        ranges = running_before(own.withColumn("h", hash_key(seed, "key")), F.substring("h", 1, 3), ["h", "key"], {"begin": "w"})
        # all cells together are as many as keys and twice that
        cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("begin") + F.col("w") - 1) / width))))
        sides.append((tag, settled(cells.select("key", "begin", "w", "cell")), total, width, keys))
    room = sides[0][4] * sides[1][4]
    known = tested.select(F.col(a if a in tested.columns else tested.columns[0]).alias("a"), F.col(b if b in tested.columns and b != a else tested.columns[1]).alias("b"))
    known = settled((_ordered(known) if one_kind else known).distinct())
    found, have, begin = None, 0, 0
    while True:
        size = min(n * most_tries - begin, max(16, int((n - have) * 1.5)) if begin == 0 else max(begin, 16))
        pairs = spark.range(begin, begin + size).withColumnRenamed("id", "draw")
        for tag, cells, total, width, _ in sides:
            numbered = pairs.withColumn("u", draw_number(seed, F.col("draw"), tag, total)).withColumn("cell", F.floor(F.col("u") / width))
            pairs = numbered.join(cells, "cell").where((F.col("u") >= F.col("begin")) & (F.col("u") < F.col("begin") + F.col("w"))).drop("u", "cell", "begin", "w").withColumnRenamed("key", tag)
        if one_kind:
            pairs = _ordered(pairs.where("a <> b"))
        fresh = pairs.groupBy("a", "b").agg(F.min("draw").alias("draw")).join(known, ["a", "b"], "left_anti")
        both = fresh if found is None else found.unionByName(fresh).groupBy("a", "b").agg(F.min("draw").alias("draw"))
        found = settled(both, found)
        have, begin = found.count(), begin + size
        if have >= n or have >= room or begin >= n * most_tries:
            return found.orderBy("draw").limit(n) if n <= 10_000 else _first_draws(found, n)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})


def _first_draws(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` least draws, by exact counts of runs of draws."""
    run = 1 << 16
    before = running_before(found.withColumn("one", F.lit(1)), F.floor(F.col("draw") / run), ["draw"], {"before": "one"})
    return before.where(F.col("before") < n).select("a", "b", "draw")


def with_replacement(df: DataFrame, klass: str, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of each class; a short class is repeated."""
    sizes = df.groupBy(klass).agg(F.count("*").alias("_n"))
    times = F.ceil(F.lit(n) / F.col("_n")).cast("int")
    many = df.join(sizes, klass).withColumn("_c", F.explode(F.sequence(F.lit(1), times))).drop("_n")
    return first_n(many.withColumn("_o", F.col("_c")), n, seed, ["_o", *keys], [klass]).drop("_c", "_o")


def backfilled_quota(df: DataFrame, klass: str, level: str, quotas: dict[str, int], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Quotas of each class by level; a level's shortfall is filled from the class's other rows."""
    ranked = hash_rank(df, seed, keys, [klass, level], "_r")
    quota = F.coalesce(*(F.when(F.col(level) == k, F.lit(q)) for k, q in quotas.items()), F.lit(0))
    marked = ranked.withColumn("_in", F.col("_r") <= quota)
    filled = marked.where("_in").groupBy(klass).agg(F.count("*").alias("_got"))
    spare = hash_rank(marked.where("not _in"), seed + 1, keys, [klass], "_s").join(filled, klass, "left")
    more = spare.where(F.col("_s") <= F.lit(sum(quotas.values())) - F.coalesce("_got", F.lit(0)))
    return marked.where("_in").select(*df.columns).unionByName(more.select(*df.columns))


def relaxed(df: DataFrame, levels: Sequence[Column], n: int) -> DataFrame:
    """Rows by the strictest filter, widened one level at a time until there are ``n``; relax_level says which."""
    level = F.coalesce(*(F.when(c, i) for i, c in enumerate(levels)))
    tagged = df.withColumn("relax_level", level).where(F.col("relax_level").isNotNull())
    counts = dict(tagged.groupBy("relax_level").count().collect())  # a row for each level
    total, last = 0, 0
    for i in range(len(levels)):
        last, total = i, total + counts.get(i, 0)
        if total >= n:
            break
    return tagged.where(F.col("relax_level") <= last)


def two_sided_cap(df: DataFrame, a: str, b: str, keys: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """Rows in seeded order, each kept while both its ends have fewer than ``most`` kept rows.

    Decided by stretches of the order, each some times the ones before it: an
    end is closed once ``most`` of its rows are kept, and the rows that are left of
    closed ends go before the next stretch is looked at. Ends may be of one kind.
    """
    rest = settled(df)
    n, ends = rest.count(), rest.select(F.explode(F.array(a, b)).alias("_end")).agg(F.approx_count_distinct("_end")).first()[0]
    kept, done = None, 0
    upto = max(most * ends, CAP_ROWS) / max(1, n)  # rows are evenly spread over the order
    while True:
        last = upto >= 1
        h = hash_key(seed, *keys)
        before = F.substring(h, 1, 8) < F.lit(f"{int(min(upto, 1) * (1 << 32)):08x}")
        state = (rest if last else rest.where(before)).select(*df.columns, h.alias("_h"), F.lit(None).cast("boolean").alias("_kept"))
        kept = _first_at_both(settled(state if kept is None else kept.unionByName(state)), a, b, keys, most)
        if last:
            return kept.select(*df.columns)
        full = settled(kept.select(F.explode(F.array(a, b)).alias("_end")).groupBy("_end").agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select("_end"))
        left = rest.where(~before)
        for end in (a, b):
            left = left.join(full.withColumnRenamed("_end", "_full"), F.col(end) == F.col("_full"), "left_anti")
        rest = settled(left, rest)
        m = rest.count()
        # a stretch holds four times as many rows as the one before it
        done += 1
        upto = 1.0 if not m else min(1.0, upto + (1 - upto) * max(most * ends, CAP_ROWS) * 4**done / m)


#: Least rows of the first stretch of ``two_sided_cap``.
CAP_ROWS = 1 << 16


def _first_at_both(state: DataFrame, a: str, b: str, keys: Sequence[str], most: int) -> DataFrame:
    """Kept rows of a stretch and of those before it, whose kept rows it holds, too.

    Decided in rounds with the same result as one after another: a row surely
    stays if the kept and the open rows before it are fewer than ``most`` at
    both ends, and surely goes if the kept ones before it are ``most`` at one.
    The first open row of all is always decided.
    """
    columns = state.columns
    while not state.where(F.col("_kept").isNull()).isEmpty():
        tag = F.struct("_h", *keys)
        at = state.select(F.explode(F.array(F.col(a), F.col(b))).alias("_end"), tag.alias("_tag"), F.col("_kept").isNotNull().cast("int").alias("_k"), F.lit(1).alias("_one"))
        before = running_before(at, F.substring("_tag._h", 1, 3), ["_tag"], {"_kept_before": "_k", "_all_before": "_one"}, ["_end"])
        worst = before.groupBy("_tag").agg(F.max("_kept_before").alias("_kb"), F.max("_all_before").alias("_ab"))
        joined = state.withColumn("_tag", tag).join(worst, "_tag", "left")
        verdict = F.when(F.col("_kept").isNotNull(), F.col("_kept")).when(F.col("_ab") < most, True).when(F.col("_kb") >= most, False)
        # rows that went don't matter any more
        state = settled(joined.withColumn("_kept", verdict).select(*columns).where(F.coalesce("_kept", F.lit(True))), state)
    return state
