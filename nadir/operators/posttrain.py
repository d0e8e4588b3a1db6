"""Post-training records and rewards, structured-answer metrics, judge and contamination summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nadir.functions import columns as C

from .sampling import first_n
from .splits import exact_quantiles


def chat(*turns: tuple[str, Column]) -> Column:
    """A list of messages from (role, content)."""
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))


def sft_records(items: DataFrame, keys: Sequence[str], system: Column, prompt: Column, answer: Column, by: Sequence[str] = (), most: int | None = None, seed: int = 42) -> DataFrame:
    """Supervised records: messages of system, user and assistant; at most ``most`` of each ``by``, in seeded order."""
    rows = items if most is None else first_n(items, most, seed, keys, by)
    return rows.select(*keys, *[c for c in by if c not in keys], chat(("system", system), ("user", prompt), ("assistant", answer)).alias("messages"))


def reward_prompts(items: DataFrame, keys: Sequence[str], system: Column, prompt: Column, gold: Column) -> DataFrame:
    """Prompt messages with the gold answer a verifier needs."""
    return items.select(*keys, chat(("system", system), ("user", prompt)).alias("prompt"), gold.alias("gold_answer"))


def preference_pairs(answers: DataFrame, item: str, answer: str, score: str, min_gap: float = 0.5) -> DataFrame:
    """The best against the worst answer of each item with two or more, if their scores are ``min_gap`` apart.

    Ties go to the answer that sorts first as worst and last as best.
    """
    s = F.struct(F.col(score).alias("s"), F.col(answer).alias("a"))
    ends = answers.where(F.col(score).isNotNull()).groupBy(item).agg(F.max(s).alias("best"), F.min(s).alias("worst"), F.count("*").alias("n"))
    gap = F.col("best.s") - F.col("worst.s")
    return ends.where((F.col("n") >= 2) & (gap >= min_gap)).select(item, F.col("best.a").alias("chosen"), F.col("worst.a").alias("rejected"), gap.alias("score_gap"))


def choice_reward(response: Column, gold: Column, task: Column) -> Column:
    """1 for the right letter, 0 for a wrong or unparsed one; null for other tasks."""
    return F.when(task == "l1", F.when(C.choice_letter(response, "ABCDE") == F.upper(gold), 1.0).otherwise(0.0))


def tested_reward(response: Column, gold: Column, task: Column) -> Column:
    return F.when(task == "l4", F.when(C.tested_answer(response) == F.lower(gold), 1.0).otherwise(0.0))


def evidence_reward(response: Column, task: Column, keywords: Sequence[str]) -> Column:
    """Distinct keywords named, a third each, at most 1; null for other tasks."""
    hits = sum((F.when(F.contains(F.lower(response), F.lit(k.lower())), 1).otherwise(0) for k in keywords), F.lit(0))
    return F.when(task == "l4", F.least(hits / 3.0, F.lit(1.0)))


def format_reward(response: Column, task: Column) -> Column:
    letter = F.substring(response, 1, 50).rlike(r"\b[A-E]\b")
    word = F.substring(response, 1, 100).rlike(r"(?i)\b(tested|untested)\b")
    return F.when(task == "l1", F.when(letter, 0.5).otherwise(0.0)).when(task == "l4", F.when(word, 0.5).otherwise(0.0))


def set_f1(gold: Column, predicted: Column) -> Column:
    """F1 of two arrays as sets; null for an empty gold set, 0 without a hit."""
    g, p = F.array_distinct(gold), F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(g, p))
    return F.when(F.size(g) > 0, 2 * hit / (F.size(g) + F.size(p)))


def extraction_scores(df: DataFrame, gold: str, predicted: str, fields: Sequence[tuple[str, str]] = (), by: Sequence[str] = ()) -> DataFrame:
    """schema_compliance, entity_f1 and field_accuracy of structured answers.

    ``predicted`` is null where nothing could be parsed; ``fields`` are pairs of
    gold and predicted columns compared as lower-case text where both are known.
    """
    ok = F.col(predicted).isNotNull()
    same = [F.when(ok & F.col(g).isNotNull() & F.col(p).isNotNull(), F.when(F.lower(F.col(g).cast("string")) == F.lower(F.col(p).cast("string")), 1.0).otherwise(0.0)) for g, p in fields]
    n_fields = sum((F.count(s) for s in same), F.lit(0))
    hits = sum((F.coalesce(F.sum(s), F.lit(0.0)) for s in same), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.avg(ok.cast("double")).alias("schema_compliance"),
        F.coalesce(F.avg(F.when(ok, set_f1(F.col(gold), F.col(predicted)))), F.lit(0.0)).alias("entity_f1"),
        F.when(n_fields > 0, hits / n_fields).otherwise(0.0).alias("field_accuracy"),
        F.count_if(ok).alias("n_valid"), F.count("*").alias("n_total"),
    )


def judge_summary(df: DataFrame, dimensions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each dimension and of the mean over complete rows; 0 where there is none."""
    total = sum((F.col(d) for d in dimensions), F.lit(0.0)) / len(dimensions)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [x for name, c in [*((d, F.col(d)) for d in dimensions), ("overall", total)] for x in (zero(F.avg(c)).alias(f"{name}_mean"), zero(F.stddev_pop(c)).alias(f"{name}_std"))]
    return df.groupBy(*by).agg(*out, F.count("*").alias("n"))


def contamination_grid(df: DataFrame, correct: Column, popularity: str, period: str) -> DataFrame:
    """Accuracy by popularity (above the median or not; null is unknown) and period."""
    middle = exact_quantiles(df, popularity, [0.5])
    above = F.when(F.col(popularity).isNull(), "unknown").when(F.col(popularity) > F.lit(middle[0] if middle else None), "high").otherwise("low")
    return df.groupBy(above.alias("popularity"), F.col(period).alias("period")).agg(F.avg(correct.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def before_after(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values before and after, and what they gained."""
    b, a = (f.select(*keys, *(F.col(v).alias(f"{v}_{n}") for v in values)) for f, n in ((before, "before"), (after, "after")))
    return b.join(a, list(keys)).select("*", *((F.col(f"{v}_after") - F.col(f"{v}_before")).alias(f"{v}_delta") for v in values))


def matched_inflation(df: DataFrame, keys: Sequence[str], seed: str, condition: str, value: str, reference: str, other: str) -> DataFrame:
    """100 * (other - reference) / |reference| of means over the seeds that both conditions have."""
    both = df.where(F.col(condition).isin(reference, other)).groupBy(*keys, seed).agg(F.avg(F.when(F.col(condition) == reference, F.col(value))).alias("r"), F.avg(F.when(F.col(condition) == other, F.col(value))).alias("o"))
    m = both.where("r is not null and o is not null").groupBy(*keys).agg(F.avg("r").alias("r"), F.avg("o").alias("o"), F.count("*").alias("n_seeds"))
    return m.select(*keys, "n_seeds", (100 * (F.col("o") - F.col("r")) / F.greatest(F.abs("r"), F.lit(1e-12))).alias("inflation_percent"))
