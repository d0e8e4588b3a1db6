"""Balanced partition of a graph: parts of about equally many nodes that few edges cross.

All work is joins and aggregates over an edge table; nothing but tables of a
row for each part, or each pair of parts, reaches the driver, and a bounded number of
large clusters.

1. Coarsening: every node begins as a cluster of its own. In rounds, half of the
   clusters (by a hash) join the neighbouring cluster that most of their edges
   lead to, as long as that is below a part's size. Clusters become the nodes of
   a smaller graph, and so on until it hardly shrinks.
2. Packing: large clusters go to the emptiest part, largest first; the many small
   ones fill what is left in hashed order.
3. Balance: parts above the bound give the nodes that lose least to parts below.
4. Refinement: in rounds, nodes ask for the part that most of their edges lead
   to. Between two parts as many may go as come, best gains first, and some more
   while sizes stay within the bounds.

Rounds are synchronous and every tie is decided by a hash, so the same edges
give the same parts however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_before
from .steps import Steps

#: Large clusters are those above a part's size over this; at most so many times the number of parts exist.
LARGE = 32


def _hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def _even(node: str, turn: int) -> Column:
    return F.pmod(_hash(node, F.lit(turn)), F.lit(2)) == 0


def _wishes(edges: DataFrame, nodes: DataFrame, turn: int, salt: int) -> DataFrame:
    """node, label, w, to, gain of the nodes of a turn that have more edges to another label than to their own."""
    votes = edges.join(nodes.select(F.col("node").alias("b"), F.col("label").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("e").alias("s"))
    held = votes.join(nodes, "node")
    other = F.col("to") != F.col("label")
    best = held.groupBy("node", "label", "w").agg(
        F.coalesce(F.max(F.when(~other, F.col("s"))), F.lit(0)).alias("own"),
        F.max(F.when(other, F.struct("s", _hash("to", F.lit(salt)).alias("h"), "to"))).alias("best"),
    )
    wish = best.where(F.col("best.s") > F.col("own")).select("node", "label", "w", F.col("best.to").alias("to"), (F.col("best.s") - F.col("own")).alias("gain"))
    return wish.where(_even("node", turn))


def _in_order(df: DataFrame, by: list[str], name: str, amount: str) -> DataFrame:
    """Sum of ``amount`` over the wishes of a group that come before, best gains first."""
    keyed = df.withColumn("h", _hash("node"))
    bucket = F.struct((-F.col("gain")).alias("g"), F.shiftrightunsigned("h", 56).alias("p"))
    return running_before(keyed.withColumn("order", F.struct((-F.col("gain")).alias("g"), F.shiftrightunsigned("h", 56).alias("p"), "h", "node")), bucket, ["order"], {name: amount}, by).drop("h", "order")


def _cluster(edges: DataFrame, nodes: DataFrame, most: int, rounds: int, steps: Steps) -> DataFrame:
    """nodes with ``label``: clusters of at most ``most`` weight."""
    now = nodes.withColumn("label", F.col("node"))
    before, still = None, 0
    for turn in range(rounds):
        sizes = now.groupBy(F.col("label").alias("to")).agg(F.sum("w").alias("size"))
        asked = _in_order(_wishes(edges, now, turn, 0), ["to"], "before", "w")
        taken = asked.join(sizes, "to").where(F.col("size") + F.col("before") + F.col("w") <= most).select("node", F.col("to").alias("moved"))
        now = steps.table(now.join(taken, "node", "left").select("node", "w", F.coalesce("moved", "label").alias("label"), F.col("moved").isNotNull().alias("moved")), before)
        before = now
        still = still + 1 if now.where("moved").isEmpty() else 0
        if still == 2:  # neither half moves any more
            break
        now = now.drop("moved")
    return now.select("node", "w", "label")


def _packed(clusters: DataFrame, parts: int, total: int) -> DataFrame:
    """label, part of every cluster (node, w)."""
    size = -(-total // parts)
    bar = max(1, size // LARGE)
    # each is above a share of the whole, so there are at most parts * (LARGE + 1)
    large = clusters.where(F.col("w") > bar).select("node", "w", _hash("node").alias("h")).collect()
    filled, chosen = [0] * parts, []
    for r in sorted(large, key=lambda r: (-r["w"], r["h"])):
        p = min(range(parts), key=lambda i: (filled[i], i))
        filled[p] += r["w"]
        chosen.append((r["node"], p))
    spark = clusters.sparkSession
    first = spark.createDataFrame(chosen, f"label {clusters.schema['node'].dataType.simpleString()}, part int")
    # the room of each part, end to end
    room, ends = 0, []
    for p in range(parts):
        room += max(0, size - filled[p])
        ends.append(room)
    small = clusters.where(F.col("w") <= bar).withColumn("h", _hash("node"))
    placed = running_before(small, F.shiftrightunsigned("h", 52), ["h", "node"], {"before": "w"})
    at = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("before"))), F.lit(parts - 1))
    return first.unionByName(placed.select(F.col("node").alias("label"), at.cast("int").alias("part")))


def _sizes(nodes: DataFrame, parts: int) -> list[int]:
    got = dict(nodes.groupBy("label").count().collect())
    return [got.get(p, 0) for p in range(parts)]


def _balanced(edges: DataFrame, nodes: DataFrame, parts: int, least: int, most: int, steps: Steps) -> DataFrame:
    """Parts above ``most`` give those that lose least to the parts below; all are within the bounds then."""
    sizes = _sizes(nodes, parts)
    total = sum(sizes)
    aim = [total // parts + (p < total % parts) for p in range(parts)]
    if all(least <= s <= most for s in sizes):
        return nodes
    give = [max(0, s - a) for s, a in zip(sizes, aim, strict=True)]
    room, ends = 0, []
    for s, a in zip(sizes, aim, strict=True):
        room += max(0, a - s)
        ends.append(room)
    inside = edges.join(nodes.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").join(nodes.select(F.col("node").alias("a"), "label"), "a").where("l = label").groupBy(F.col("a").alias("node")).agg(F.sum("e").alias("gain"))
    held = nodes.join(inside, "node", "left").withColumn("gain", -F.coalesce("gain", F.lit(0)).cast("long")).withColumn("one", F.lit(1))
    quota = F.element_at(F.array(*map(F.lit, give)), F.col("label") + 1)
    out = _in_order(held, ["label"], "before", "one").where(F.col("before") < quota)
    offset = F.element_at(F.array(*(F.lit(sum(give[:p])) for p in range(parts))), F.col("label") + 1)
    place = offset + F.col("before")
    to = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= place))
    moved = out.select("node", to.cast("int").alias("moved"))
    return steps.table(nodes.join(moved, "node", "left").select("node", "w", F.coalesce("moved", "label").alias("label")), nodes)


def _refined(edges: DataFrame, nodes: DataFrame, parts: int, least: int, most: int, rounds: int, steps: Steps) -> DataFrame:
    for turn in range(rounds):
        sizes = _sizes(nodes, parts)
        asked = steps.table(_wishes(edges, nodes, turn, 1).withColumn("one", F.lit(1)))
        flows = {(r["label"], r["to"]): r["n"] for r in asked.groupBy("label", "to").agg(F.count("*").alias("n")).collect()}  # a row for each pair of parts
        if not flows:
            steps.drop(asked)
            break
        allowed = [(i, j, min(n, min(n, flows.get((j, i), 0)) + max(0, min(most - sizes[j], sizes[i] - least)) // parts)) for (i, j), n in flows.items()]
        table = F.broadcast(edges.sparkSession.createDataFrame(allowed, "label int, to int, allowed long"))
        taken = _in_order(asked, ["label", "to"], "before", "one").join(table, ["label", "to"]).where(F.col("before") < F.col("allowed")).select("node", F.col("to").alias("moved"))
        nodes = steps.table(nodes.join(taken, "node", "left").select("node", "w", F.coalesce("moved", "label").alias("label")), nodes)
        steps.drop(asked)
    return nodes


def balanced_parts(links: DataFrame, a: str, b: str, parts: int = 10, slack: float = 0.04, levels: int = 3, rounds: int = 4, refine: int = 4, weight: str | None = None) -> DataFrame:
    """node, part (0 to ``parts`` - 1) of every end of ``links``, by the steps above.

    Both ends are of one kind and type. Part sizes stay within ``slack`` of the
    mean, or within one node where that is less. Links from a node to itself and
    with a null end count for nothing, though the other end of a link is a
    node; repeated links weigh as often as they come, or by the whole numbers of ``weight``.
    """
    steps = Steps(links.sparkSession, "graph")
    # links are read once, and most repeats go before anything is shuffled
    plain = steps.table(links.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("e")))
    ends = steps.table(plain.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct().withColumn("w", F.lit(1).cast("long")))
    one_way = plain.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("e").alias("e"))
    edges = steps.table(one_way.unionAll(one_way.select(F.col("b"), F.col("a"), "e")))
    total = ends.count()
    if not total:
        return ends.select("node", F.lit(0).alias("part"))
    most = max(-(-total // parts), int(total / parts * (1 + slack)))
    least = min(total // parts, -int(-total / parts * (1 - slack)))

    graph, small, n, trail = edges, ends, total, []
    for _ in range(levels):
        found = _cluster(graph, small, most, rounds, steps)
        trail.append(found)
        labels = found.select("node", "label")
        merged = steps.table(found.groupBy(F.col("label").alias("node")).agg(F.sum("w").alias("w")))
        left = graph.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        graph = steps.table(left.where("la <> lb").groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("e").alias("e")))
        small, m = merged, merged.count()
        if m > 0.9 * n or m <= parts:
            break
        n = m
    where = _packed(small, parts, total)
    for found in reversed(trail):  # from clusters of clusters down to nodes
        where = found.join(where, "label").select(F.col("node").alias("label"), "part")
    nodes = steps.table(where.select(F.col("label").alias("node"), F.lit(1).cast("long").alias("w"), F.col("part").alias("label")))
    nodes = _balanced(edges, nodes, parts, least, most, steps)
    nodes = _refined(edges, nodes, parts, least, most, refine, steps)
    return nodes.select("node", F.col("label").alias("part"))


def part_folds(parts: int, seed: int, ratios: tuple[float, float, float]) -> list[str]:
    """The fold of each part: parts in seeded order fill train, then val, then test."""
    import hashlib

    order = sorted(range(parts), key=lambda p: hashlib.md5(f"{seed}:{p}".encode()).hexdigest())
    train, val = int(parts * ratios[0]), int(parts * ratios[1])
    fold = {p: "train" if i < train else "val" if i < train + val else "test" for i, p in enumerate(order)}
    return [fold[p] for p in range(parts)]


def cold_both_graph(df: DataFrame, first: str, second: str, parts: int = 10, seed: int = 42, ratios: tuple[float, float, float] = (0.7, 0.1, 0.2), one_kind: bool = True, **options) -> DataFrame:
    """Cold for both ends: parts of the graph are folds; rows whose ends are in different folds have none.

    ``one_kind`` false: ends of one value but different columns are different nodes.
    """
    tag = (lambda c, k: F.col(c)) if one_kind else (lambda c, k: F.when(F.col(c).isNotNull(), F.concat(F.lit(k), F.col(c).cast("string"))))
    keyed = df.withColumns({"_a": tag(first, "a"), "_b": tag(second, "b")})
    where = balanced_parts(keyed, "_a", "_b", parts, **options)
    fold = F.element_at(F.array(*map(F.lit, part_folds(parts, seed, ratios))), F.col("part") + 1)
    side = lambda key, name: where.select(F.col("node").alias(key), fold.alias(name))
    joined = keyed.join(side("_a", "_fa"), "_a", "left").join(side("_b", "_fb"), "_b", "left")
    return joined.withColumn("fold", F.when(F.col("_fa") == F.col("_fb"), F.col("_fa"))).drop("_a", "_b", "_fa", "_fb")
