"""Text classification: TF-IDF of words and pairs of words, linear SVM one against the rest, keyword rules behind it.

The features are the most frequent terms of the labelled rows, at most
``features`` (10,000 unless given) of all one- and two-word terms, by their number of
occurrences, ties in order of code points. They are counted where the rows are;
only the vocabulary itself, which that number bounds, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nadir.functions.columns import FAILURE_KEYWORDS, keyword_class

from .ordering import hash_rank
from .steps import Steps

# fixed values: words that carry no topic
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few "
    "for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once "
    "only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()


MOST_TERMS = 10_000
PLACES = 1 << 20  # of the table of counts


def _cut(text: str) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=STOP_WORDS, locale="en_US"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
    ]


def _occurrences(df: DataFrame, text: str) -> DataFrame:
    """(term, place): a row for each occurrence, with the term's place in the table of counts."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for stage in _cut("_text"):
        rows = stage.transform(rows)
    # the outer form, as the other one adds a filter that cuts every text a second time
    terms = rows.select(F.explode_outer("_terms").alias("term")).where("term is not null")
    return terms.select("term", F.pmod(F.xxhash64("term"), F.lit(PLACES)).cast("int").alias("place"))


def _cutoff(counted: DataFrame, most: int) -> int:
    """The number of occurrences of the last of the ``most`` most frequent terms; one if there are fewer."""
    sizes = counted.groupBy("n").agg(F.count("*").alias("terms")).orderBy(F.desc("n")).limit(most).collect()
    for r in sizes:
        most -= r["terms"]
        if most <= 0:
            return r["n"]
    return 1


def vocabulary(df: DataFrame, text: str, most: int = MOST_TERMS) -> DataFrame:
    """(term, n) of the ``most`` most frequent one- and two-word terms without stop words; ties go to the lesser term. Null texts have none.

    Exact, in two or three passes: the first counts the places of a hash table of
    fixed size, the second the terms of the fullest places. A place that holds
    fewer occurrences than the last term found can't hold a better one; any other
    place's terms are counted by a third pass. So rare terms are never shuffled.
    """
    steps, terms = Steps(df.sparkSession, "vocabulary"), _occurrences(df, text)
    places = steps.table(terms.groupBy("place").agg(F.count("*").alias("n")))
    first = steps.table(places.orderBy(F.desc("n"), "place").limit(4 * most).select("place"))
    count = lambda chosen: terms.join(F.broadcast(chosen), "place").groupBy("term").agg(F.count("*").alias("n"))  # noqa: E731  at most PLACES integers
    counted = steps.table(count(first))
    least = _cutoff(counted, most)
    rest = steps.table(places.where(F.col("n") >= least).join(F.broadcast(first), "place", "left_anti").select("place"))
    if not rest.isEmpty():
        counted = counted.unionByName(steps.table(count(rest)))
        least = _cutoff(counted, most)
    return counted.where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most)


def _features(rows: DataFrame, text: str, most: int) -> list | None:
    """Stages that make TF-IDF vectors of the terms of these rows; None without any."""
    terms = [r["term"] for r in vocabulary(rows, text, most).collect()]
    if not terms:
        return None
    model = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_tf")
    return [*_cut(text), model, IDF(inputCol="_tf", outputCol="_x")]


def train(df: DataFrame, text: str, label: str, key: str, folds: int = 5, features: int = MOST_TERMS, least_rows: int = 100, least_accuracy: float = 0.6, iterations: int = 20, seed: int = 42, most_rows: int = 1_000_000):
    """(model or None, cross-validated accuracy). None below ``least_rows`` rows or ``least_accuracy``: use the rules then.

    Of more than ``most_rows`` labelled rows those of the least seeded hashes are fitted on. A fold's
    vocabulary comes from the rows outside it. Labels go by their frequency, ties by name.
    """
    rows = df.where(F.col(label).isNotNull()).select(key, F.coalesce(text, F.lit("")).alias(text), F.col(label).cast("string").alias("_label"))
    if rows.limit(least_rows).count() < least_rows:
        return None, None
    ranked = hash_rank(rows, seed, [key], name="_r").where(F.col("_r") <= most_rows).withColumn("_fold", F.col("_r") % folds)

    def fit(part: DataFrame):
        shape = _features(part, text, features)
        if shape is None:
            return None
        stages = [*shape, StringIndexer(inputCol="_label", outputCol="_y", handleInvalid="keep"), OneVsRest(classifier=LinearSVC(maxIter=iterations), featuresCol="_x", labelCol="_y", predictionCol="_p")]
        return Pipeline(stages=stages).fit(part)

    hits = total = 0
    for k in range(folds):
        model, part = fit(ranked.where(F.col("_fold") != k)), ranked.where(F.col("_fold") == k)
        if model is None:
            return None, None
        names = F.array(*map(F.lit, model.stages[-2].labels))
        told = F.get(names, F.col("_p").cast("int"))
        got = model.transform(part).agg(F.count_if(told == F.col("_label")), F.count("*")).first()
        hits, total = hits + got[0], total + got[1]
    accuracy = hits / total
    return (fit(ranked) if accuracy >= least_accuracy else None), accuracy


def classify(df: DataFrame, text: str, label: str, model=None, rules: Sequence[tuple[str, str]] = FAILURE_KEYWORDS) -> DataFrame:
    """``df`` with the model's label, or that of the rules without a model."""
    if model is None:
        return df.withColumn(label, keyword_class(F.coalesce(F.col(text), F.lit("")), rules))
    names = model.stages[-2].labels
    out = model.transform(df.withColumn(text, F.coalesce(text, F.lit(""))).withColumn("_label", F.lit(None).cast("string")))
    return out.select(*(c for c in df.columns if c != label), F.get(F.array(*map(F.lit, names)), F.col("_p").cast("int")).alias(label))
