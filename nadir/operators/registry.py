"""The domains of evidence as a table that drives their evaluation.

Answers of all domains come in one frame with a ``domain`` column; what differs
between domains (the field that holds the right answer, how many choices
a question has, names of the early and the late period, words that make
evidence substantive, whether answers carry evidence) is joined from the table, a row
for each domain, so all domains are evaluated in one pass.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nadir.functions.columns import choice_letter, tested_answer
from nadir.functions.parsers import tested_evidence

from .metrics import multiclass, parse_rate, tested_block


@dataclass(frozen=True)
class Domain:
    domain: str
    label: str
    gold_field: str
    class_field: str
    choices: int
    early: str
    late: str
    has_evidence: bool
    training: bool
    evidence_words: tuple[str, ...]
    judged: tuple[str, ...]


# Fields, periods and words of each domain's data sets.
DOMAINS = (
    Domain("dti", "Drug-Target Interaction", "correct_answer", "class", 4, "pre_2023", "post_2024", True, True, ("ChEMBL", "PubChem", "BindingDB", "IC50", "Ki", "Kd", "pChEMBL", "bioassay", "PMID", "DOI"), ("accuracy", "reasoning", "completeness", "specificity")),
    Domain("ct", "Clinical Trial Failure", "gold_answer", "gold_category", 5, "pre_2020", "post_2023", True, True, ("NCT", "clinicaltrials.gov", "Phase", "trial", "FDA", "EMA", "DSMB", "interim analysis"), ("accuracy", "reasoning", "completeness", "specificity")),
    Domain("ppi", "Protein-Protein Interaction", "gold_answer", "gold_category", 4, "pre_2015", "post_2020", True, True, ("UniProt", "HuRI", "BioGRID", "IntAct", "STRING", "co-IP", "yeast two-hybrid", "co-fractionation", "PMID"), ("biological_plausibility", "structural_reasoning", "mechanistic_completeness", "specificity")),
    Domain("ge", "Gene Essentiality", "gold_answer", "gold_category", 4, "old_release", "new_release", False, True, ("DepMap", "CRISPR", "RNAi", "Chronos", "DEMETER", "gene effect", "dependency score", "cell line"), ("biological_plausibility", "pathway_reasoning", "context_specificity", "mechanistic_depth")),
    Domain("vp", "Variant Pathogenicity", "gold_answer", "gold_category", 4, "pre_2020", "post_2023", True, False, ("ClinVar", "gnomAD", "CADD", "REVEL", "AlphaMissense", "ACMG", "PVS1", "PM2", "PP3", "BA1", "ClinGen"), ("population_reasoning", "computational_evidence", "functional_reasoning", "gene_disease_specificity")),
)


def frame(spark: SparkSession, domains: tuple[Domain, ...] = DOMAINS) -> DataFrame:
    """A row for each domain."""
    rows = [{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(d).items()} for d in domains]
    return spark.createDataFrame(rows, "domain string, label string, gold_field string, class_field string, choices int, early string, late string, has_evidence boolean, training boolean, evidence_words array<string>, judged array<string>")


def described(answers: DataFrame, domains: tuple[Domain, ...] = DOMAINS) -> DataFrame:
    """Answers of known domains with ``gold``, ``gold_class`` and the domain's own columns; a field that the frame hasn't is null."""
    def first(fields: set[str], chosen: str) -> Column:
        return F.coalesce(*(F.when(F.col(chosen) == f, F.col(f).cast("string")) for f in sorted(fields) if f in answers.columns), F.lit(None).cast("string"))

    joined = answers.join(F.broadcast(frame(answers.sparkSession, domains)), "domain")
    return joined.withColumns({"gold": first({d.gold_field for d in domains}, "gold_field"), "gold_class": first({d.class_field for d in domains}, "class_field")})


def evaluate_tested(answers: DataFrame, response: str, period: str, by: tuple[str, ...] = ("model",), domains: tuple[Domain, ...] = DOMAINS) -> DataFrame:
    """All figures of tested/untested answers for each domain and ``by``: what ``tested_block`` gives, by the domain's periods and words."""
    rows = described(answers, domains)
    when = F.when(F.col(period) == F.col("early"), "early").when(F.col(period) == F.col("late"), "late")
    rows = rows.withColumns({"_answer": tested_answer(F.col(response)), "_evidence": F.when(F.col("has_evidence"), tested_evidence(F.col(response))), "_period": when, "_words": F.transform("evidence_words", F.lower)})
    return tested_block(rows, "gold", "_answer", "_evidence", "_period", "early", "late", ["domain", *by], words=F.col("_words"))


def evaluate_choices(answers: DataFrame, response: str, by: tuple[str, ...] = ("model",), domains: tuple[Domain, ...] = DOMAINS) -> DataFrame:
    """Parse rate, accuracy, F1s and MCC of multiple-choice answers for each domain and ``by``; letters are as many as the domain's choices."""
    letters = {d.choices: "ABCDEFGHIJ"[: d.choices] for d in domains}
    parsed = F.coalesce(*(F.when(F.col("choices") == n, choice_letter(F.col(response), x)) for n, x in letters.items()), F.lit(None).cast("string"))
    rows = described(answers, domains).withColumn("_letter", parsed)
    keys = ["domain", *by]
    return parse_rate(rows, "_letter", keys).join(multiclass(rows, "gold", "_letter", keys), keys, "left")
