"""Evaluation metrics as aggregates: a frame in, a row for each group out.

Ranking metrics start from the curve: one row for each distinct score of a
group, with what lies above it. Continuous scores make that as long as the
rows, so no window runs over all of it: range partitions of it, as many as it
needs, are bands, totals of bands give offsets, windows run within bands.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import copies, in_bands, neighbour, ordinal, running_before, same, settled


def _nan() -> Column:
    return F.lit("NaN").cast("double")


def _pearson(x: Column, y: Column) -> Column:
    """Correlation over rows with both values; NaN for a constant side or no rows."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b)), _nan())


def curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """by, score, pos, neg, tp, fp (above or at the score), n_pos, n_neg, band. Null labels and scores are left out.

    One pass over the rows; ``band`` is a range of groups and scores, the highest first,
    of about as many scores as a window may hold. All metrics of one frame
    can be had of one curve: give it to them in place of the frame.
    """
    if {"tp", "fp", "n_pos", "n_neg", "band"} <= set(df.columns):
        return df
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    points = rows.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    points = in_bands(points, [*by, F.desc("score")])
    run = running_before(points, F.col("band"), [F.desc("score")], {"tp": "pos", "fp": "neg"}, by).withColumns({"tp": F.col("tp") + F.col("pos"), "fp": F.col("fp") + F.col("neg")})
    totals = points.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if not by:
        return run.join(F.broadcast(totals))  # one row
    return run.join(totals.select(*copies(by), "n_pos", "n_neg"), same(by)).drop(*(f"_j{i}" for i in range(len(by))))


def _two_classes(value: Column) -> Column:
    return F.when((F.first("n_pos") > 0) & (F.first("n_neg") > 0), value).otherwise(_nan())


def auroc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; NaN for one class."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)) / (F.first("n_pos") * F.first("n_neg"))
    return curve(df, label, score, by).groupBy(*by).agg(_two_classes(area).alias("auroc"))


def auprc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision by steps of recall; NaN for one class."""
    steps = F.sum(F.col("pos") / F.col("n_pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve(df, label, score, by).groupBy(*by).agg(_two_classes(steps).alias("auprc"))


def log_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), low: float = 0.001, high: float = 0.1) -> DataFrame:
    """Area under the curve over log10 of the false positive rate in [low, high], over its width.

    Points inside a straight run of the curve are dropped first, as that
    changes the area on the logarithmic axis; steps that reach over an end of
    the range are cut there.
    """
    points = curve(df, label, score, by).withColumn("_o", -F.col("score"))
    two = points.where("n_pos > 0 and n_neg > 0")
    after = neighbour(two, F.col("band"), "_o", ["pos", "neg"], "_next", by, ahead=True)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    bend = first | F.col("_next").isNull() | (F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg"))
    kept = neighbour(after.where(bend).drop("_next"), F.col("band"), "_o", ["fp", "tp"], "_last", by)
    x0, y0 = F.coalesce(F.col("_last.fp"), F.lit(0)) / F.col("n_neg"), F.coalesce(F.col("_last.tp"), F.lit(0)) / F.col("n_pos")
    x1, y1 = F.col("fp") / F.col("n_neg"), F.col("tp") / F.col("n_pos")
    a, b = F.greatest(x0, F.lit(low)), F.least(x1, F.lit(high))
    at = lambda x: y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    piece = F.when(a < b, (F.log10(b) - F.log10(a)) * (at(a) + at(b)) / 2).otherwise(0.0)
    area = kept.groupBy(*by).agg((F.sum(piece) / (math.log10(high) - math.log10(low))).alias("log_auc"))
    if not by:
        return area.select(F.coalesce("log_auc", _nan()).alias("log_auc"))
    groups = points.select(*by).distinct()
    return groups.join(area.select(*copies(by), "log_auc"), same(by), "left").select(*by, F.coalesce("log_auc", _nan()).alias("log_auc"))


def ranked(df: DataFrame, label: str, score: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """by, score, label, rank (from the highest score, ties by key), n, n_pos.

    Ranks are places in range partitions of (by, score, key), so neither a
    group, nor a score that all rows share, is one window, whatever the key's type.
    Rows of one score and key come with their positives last.
    """
    if {"rank", "n", "n_pos", "label", "score"} <= set(df.columns):
        return df
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*by, F.col(score).alias("score"), F.col(label).alias("label"), F.col(key).alias("_key"))
    placed = settled(ordinal(rows, [*by, F.desc("score"), "_key", "label"], "_at"))
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("n_pos"))
    if by:
        joined = placed.join(groups.select(*copies(by), "_first", "n", "n_pos"), same(by)).drop(*(f"_j{i}" for i in range(len(by))))
    else:
        joined = placed.join(F.broadcast(groups))  # one row
    return joined.withColumn("rank", F.col("_at") - F.col("_first") + 1).drop("_at", "_first", "_key")


def bedroc(df: DataFrame, label: str, score: str, key: str, by: Sequence[str] = (), alpha: float = 20.0) -> DataFrame:
    """Early-recognition score in [0, 1]; NaN without positives, 1 if all are; ties by key."""
    s, n, p = F.sum(F.when(F.col("label") == 1, F.exp(-alpha * F.col("rank") / F.col("n"))).otherwise(0.0)), F.first("n"), F.first("n_pos")
    ra = p / n
    rie = s / (ra * (1 - math.exp(-alpha)) / F.expm1(alpha / n))
    scale = ra * (1 - math.exp(-alpha)) / (1 + math.exp(-alpha) - F.exp(-alpha * ra) - F.exp(-alpha * (1 - ra)))
    tail = F.exp(-alpha * (1 - ra)) / (1 - F.exp(-alpha * (1 - ra)))
    value = F.when(p == 0, _nan()).when(p == n, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), rie * scale - tail)))
    return ranked(df, label, score, key, by).groupBy(*by).agg(value.alias("bedroc"))


def enrichment(df: DataFrame, label: str, score: str, key: str, percent: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Rate of positives among the first max(1, ceil(percent)) rows over the rate among all; ties by key."""
    top = F.greatest(F.lit(1), F.ceil(F.first("n") * percent / 100))
    rows = ranked(df, label, score, key, by)
    best = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100))
    hits = F.sum(F.when((F.col("rank") <= best) & (F.col("label") == 1), 1).otherwise(0))
    return rows.groupBy(*by).agg(F.when(F.first("n_pos") > 0, hits / top / (F.first("n_pos") / F.first("n"))).otherwise(_nan()).alias("enrichment"))


def binary_counts(label: Column, predicted: Column) -> dict[str, Column]:
    c = lambda a, b: F.sum(F.when((label == a) & (predicted == b), 1).otherwise(0)).cast("double")
    return {"tp": c(1, 1), "tn": c(0, 0), "fp": c(0, 1), "fn": c(1, 0)}


def mcc(df: DataFrame, label: str, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Matthews correlation of 0/1 labels and predictions; NaN if either has one class."""
    counts = df.groupBy(*by).agg(*(c.alias(n) for n, c in binary_counts(F.col(label), predicted).items()))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(*by, F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(_nan()).alias("mcc"))


def multiclass(df: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 over all classes seen, multiclass MCC (0 if undefined). Unparsed (null) predictions are left out."""
    rows = df.where(F.col(predicted).isNotNull() & F.col(gold).isNotNull())
    cells = rows.groupBy(*by, F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    both = cells.select(*by, F.explode(F.array(F.struct(F.col("g").alias("k"), F.col("c").alias("gold"), F.lit(0).cast("long").alias("pred"), F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("gold"), F.col("c").alias("pred"), F.lit(0).cast("long").alias("hit")))).alias("x")).select(*by, "x.*")
    per = both.groupBy(*by, "k").agg(F.sum("gold").alias("t"), F.sum("pred").alias("q"), F.sum("hit").alias("h"))
    f1 = F.when(F.col("t") + F.col("q") > 0, 2 * F.col("h") / (F.col("t") + F.col("q"))).otherwise(0.0)
    s, c = F.sum("t").cast("double"), F.sum("h").cast("double")
    tq, tt, qq = F.sum(F.col("t").cast("double") * F.col("q")), F.sum(F.col("t").cast("double") * F.col("t")), F.sum(F.col("q").cast("double") * F.col("q"))
    den = F.sqrt((s * s - qq) * (s * s - tt))
    return per.groupBy(*by).agg((c / s).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("t")) / s).alias("weighted_f1"), F.when(den > 0, (c * s - tq) / den).otherwise(0.0).alias("mcc"))


def parse_rate(df: DataFrame, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(F.col(predicted).isNotNull(), 1.0).otherwise(0.0)).alias("parse_rate"), F.count("*").alias("n"))


def publication_bias(df: DataFrame, gold: str, predicted: str, by: Sequence[str] = (), positive: str = "tested", negative: str = "untested") -> DataFrame:
    """P(positive | gold negative) - P(positive | gold positive) of parsed predictions; NaN if either is empty."""
    p, g = F.lower(F.trim(F.col(predicted))), F.lower(F.trim(F.col(gold)))
    hit = F.when(p == positive, 1.0).otherwise(0.0)
    rate = lambda k: F.avg(F.when(g == k, hit))
    out = df.where(F.col(predicted).isNotNull()).groupBy(*by).agg(rate(negative).alias("p_pos_given_neg"), rate(positive).alias("p_pos_given_pos"), F.count_if(g == positive).alias("n_true_pos"), F.count_if(g == negative).alias("n_true_neg"))
    ok = (F.col("n_true_pos") > 0) & (F.col("n_true_neg") > 0)
    fill = lambda c: F.when(ok, F.col(c)).otherwise(_nan())
    return out.select(*by, F.when(ok, F.col("p_pos_given_neg") - F.col("p_pos_given_pos")).otherwise(_nan()).alias("pbs"), fill("p_pos_given_neg").alias("p_pos_given_neg"), fill("p_pos_given_pos").alias("p_pos_given_pos"), "n_true_pos", "n_true_neg")


def item_difficulty(df: DataFrame, item: str, correct: Column) -> DataFrame:
    """1 - mean correctness over models."""
    return df.groupBy(item).agg((1 - F.avg(correct.cast("double"))).alias("difficulty"), F.count("*").alias("n_models"))


def model_correlation(df: DataFrame, model: str, item: str, value: str, least_common: int = 10) -> DataFrame:
    """Pearson correlation of each two models over their common items; NaN below ``least_common`` items or for a constant side.

    Answers are shuffled by item once, as lists; their pairs are made in the task
    that has the list and go into its partial aggregates, so what is shuffled is
    linear in the answers and a row for each pair of models a task. Null models and
    items count for nothing, a null value only as common. A model that answers an
    item twice is paired as often.
    """
    rows = df.where(F.col(model).isNotNull() & F.col(item).isNotNull())
    answers = rows.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(value).alias("x")))).alias("l"))  # at most as many as models answer
    one = answers.select("l", F.posexplode("l").alias("i", "a"))
    two = one.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b")).where("a.m < b.m")
    pairs = two.groupBy(F.col("a.m").alias("m1"), F.col("b.m").alias("m2")).agg(F.count("*").alias("n_common"), _pearson(F.col("a.x"), F.col("b.x")).alias("_c"))
    return pairs.select("m1", "m2", "n_common", F.when(F.col("n_common") >= least_common, F.col("_c")).otherwise(_nan()).alias("correlation"))


def quadratic_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa with quadratic weights, Pearson correlation and mean absolute difference of two raters."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n, sx, sy = F.count("*").cast("double"), F.sum(x), F.sum(y)
    seen = F.sum((x - y) * (x - y)) / n
    # the expected squared difference of independent raters needs only moments
    chance = F.sum(x * x) / n + F.sum(y * y) / n - 2 * (sx / n) * (sy / n)
    return df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.when(chance > 0, 1 - seen / chance).otherwise(_nan()).alias("kappa"), _pearson(x, y).alias("pearson"), F.avg(F.abs(x - y)).alias("mad"), F.count("*").alias("n"))


def contamination_gap(df: DataFrame, correct: Column, period: str, early: str, late: str, by: Sequence[str] = (), flag_above: float = 0.15) -> DataFrame:
    """Accuracy on early minus late items, and whether it is over the flag's bound."""
    acc = lambda k: F.avg(F.when(F.col(period) == k, correct.cast("double")))
    gap = F.col("acc_early") - F.col("acc_late")
    return df.groupBy(*by).agg(acc(early).alias("acc_early"), acc(late).alias("acc_late")).withColumn("gap", gap).withColumn("flagged", F.coalesce(gap > flag_above, F.lit(False)))


def error_taxonomy(df: DataFrame, gold: str, predicted: str, positive: str, negative: str) -> DataFrame:
    """Counts of correct, parse_failure, positivity_bias (negative called positive), false_alarm (the reverse), wrong_class."""
    g, p = F.col(gold), F.col(predicted)
    kind = F.when(p.isNull(), "parse_failure").when(p == g, "correct").when((g == negative) & (p == positive), "positivity_bias").when((g == positive) & (p == negative), "false_alarm").otherwise("wrong_class")
    return df.groupBy(kind.alias("error")).agg(F.count("*").alias("n"))


def transfer_matrix(df: DataFrame, source: str, target: str, value: str, targets: Sequence[str]) -> DataFrame:
    """Mean value by source (rows) and target (columns), and each source's mean over targets."""
    wide = df.groupBy(source).pivot(target, list(targets)).agg(F.avg(value))
    cells = [F.col(f"`{t}`") for t in targets]
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cells), F.lit(0))
    return wide.withColumn("row_mean", sum((F.coalesce(c, F.lit(0.0)) for c in cells), F.lit(0.0)) / F.nullif(known, F.lit(0)))


def run_summary(df: DataFrame, keys: Sequence[str], seed: str, value: str) -> DataFrame:
    """Seeds, mean, sample and population deviation; NaN values are ignored."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.countDistinct(seed).alias("n_seeds"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"))


def all_by_fold(df: DataFrame, label: str, score: str, key: str, fold: str = "fold", threshold: float = 0.5) -> DataFrame:
    """Every ranking metric, and MCC at a threshold, for each fold: all of one curve and one ranking."""
    points, rows = settled(curve(df, label, score, [fold])), settled(ranked(df, label, score, key, [fold]))
    out = auroc(points, label, score, [fold])
    predicted = F.when(F.col(score) >= threshold, 1).otherwise(0)
    for part in (auprc(points, label, score, [fold]), log_auc(points, label, score, [fold]), bedroc(rows, label, score, key, [fold]), enrichment(rows, label, score, key, 1.0, [fold]), mcc(df, label, predicted, [fold])):
        out = out.join(part, fold, "left")
    return out


def per_class_accuracy(df: DataFrame, gold: str, predicted: str, klass: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy of parsed predictions in each class."""
    return df.where(F.col(predicted).isNotNull()).groupBy(*by, klass).agg(F.avg(F.when(F.col(gold) == F.col(predicted), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))


# Words that make evidence substantive.
EVIDENCE_WORDS = ("chembl", "pubchem", "bindingdb", "doi", "pmid", "assay", "ic50", "ki", "kd")


def tested_block(df: DataFrame, gold: str, answer: str, evidence: str, period: str, early: str, late: str, by: Sequence[str] = (), words: Sequence[str] | Column = EVIDENCE_WORDS, longer_than: int = 50, flag_above: float = 0.15) -> DataFrame:
    """All figures of tested/untested answers: parse rate, accuracy, F1 of tested, MCC, evidence cited, accuracy by period, gap, flag.

    Unparsed answers count in the parse rate only. Evidence is cited if it is
    longer than 50 characters and has one of the words (in lower case, or an
    array column of such); its rate is over rightly tested answers, 0 without any.
    """
    a, g, e = F.col(answer), F.col(gold), F.col(evidence)
    cell = lambda x, y: F.count_if((g == x) & (a == y)).cast("double")
    known = a.isNotNull()
    cited = (F.length(e) > longer_than) & F.exists(words if isinstance(words, Column) else F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(e), w))
    both = (a == "tested") & (g == "tested")
    at = lambda p: F.avg(F.when(known & (F.col(period) == p), (a == g).cast("double")))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_total"), F.count(a).alias("n_valid"), F.avg(known.cast("double")).alias("parse_rate"), F.coalesce(F.avg(F.when(known, (a == g).cast("double"))), F.lit(0.0)).alias("accuracy"),
        cell("tested", "tested").alias("_tp"), cell("untested", "untested").alias("_tn"), cell("untested", "tested").alias("_fp"), cell("tested", "untested").alias("_fn"),
        F.coalesce(F.avg(F.when(both, F.coalesce(cited, F.lit(False)).cast("double"))), F.lit(0.0)).alias("evidence_rate"), at(early).alias("accuracy_early"), at(late).alias("accuracy_late"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("_tp", "_tn", "_fp", "_fn"))
    den, gap = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.col("accuracy_early") - F.col("accuracy_late")
    out = out.withColumns({"f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), "mcc": F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0), "gap": gap, "flagged": F.coalesce(gap > flag_above, F.lit(False))})
    return out.drop("_tp", "_tn", "_fp", "_fn")


def key_set_f1(gold: Column, predicted: Column, aliases: dict[str, str] | None = None) -> Column:
    """F1 of the field names of two JSON objects: 1 if both have none, 0 if one has none or the prediction is null.

    Old names are folded into new ones where the new one isn't there.
    """
    def names(text: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
        for old, new in (aliases or {}).items():
            renamed = F.array_append(F.array_remove(keys, old), new)
            keys = F.when(F.array_contains(keys, old) & ~F.array_contains(keys, new), renamed).otherwise(keys)
        return F.array_distinct(keys)

    g, p = names(gold), names(predicted)
    hit, ng, np_ = F.size(F.array_intersect(g, p)), F.size(g), F.size(p)
    return F.when(predicted.isNull(), 0.0).when((ng == 0) & (np_ == 0), 1.0).otherwise(F.coalesce(2.0 * hit / F.nullif(ng + np_, F.lit(0)), F.lit(0.0)))


def transfer_gain(df: DataFrame, source: str, target: str, value: str, baseline: DataFrame) -> DataFrame:
    """Mean value of each source and target minus the target's baseline (target, baseline), with the best source of each target."""
    cells = df.groupBy(source, target).agg(F.avg(value).alias("value"))
    best = cells.groupBy(target).agg(F.min_by(source, F.struct(-F.col("value"), F.col(source))).alias("best_source"))
    joined = cells.join(baseline.select(F.col(target), F.col("baseline")), target, "left").join(best, target)
    return joined.select(source, target, "value", (F.col("value") - F.col("baseline")).alias("gain"), "best_source")
