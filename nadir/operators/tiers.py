"""Confidence tiers, inclusion rules and classes of the evidence sources, as column expressions and small stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and thresholds that results depend on.
PHYSICAL_METHODS = ("MI:0004", "MI:0006", "MI:0019", "MI:0030", "MI:0096", "MI:0114", "MI:0071", "MI:0676")
REVIEWED = ("practice guideline", "reviewed by expert panel")
MULTIPLE_SUBMITTERS = "criteria provided, multiple submitters, no conflicts"
VARIANT_TYPES = ("single nucleotide variant", "Deletion", "Insertion", "Indel", "Duplication")
NO_ALLELE = ("", "na", "-", "-1")
SEVERITY = {"missense": 3.0, "nonsense": 5.0, "frameshift": 5.0, "splice": 4.0, "synonymous": 1.0}
BINARY_CONSENSUS = {"antagonistic": 0, "additive": 0, "synergistic": 1, "context_dependent": 0}
THREE_CONSENSUS = {"antagonistic": 0, "additive": 1, "synergistic": 2}


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- tiers -------------------------------------------------------------------


def bioassay_tier(p_value: Column, confirmatory: Column, unit: Column, value: Column) -> Column:
    return F.when(p_value.isNotNull() & _true(confirmatory), "gold").when(p_value.isNotNull() | (unit.isNotNull() & value.isNotNull()), "silver").otherwise("bronze")


def comment_tier(source: Column) -> Column:
    return F.when(source == "activity_comment", "bronze").otherwise("silver")


def method_tier(method: Column, physical: Sequence[str] = PHYSICAL_METHODS) -> Column:
    return F.when(method.isin(*physical), "gold").otherwise("silver")


def knockdown_tier(score: Column, reference: Column, silver_above: float = -0.5) -> Column:
    return F.when((score > silver_above) & _true(reference), "silver").otherwise("bronze")


def review_tier(status: Column) -> Column:
    s = F.lower(F.trim(status))
    return F.when(s.isin(*REVIEWED), "gold").when(s == MULTIPLE_SUBMITTERS, "silver").otherwise("bronze")


def review_evidence(status: Column, submitters: Column) -> Column:
    s = F.lower(F.trim(status))
    return F.when(s.isin(*REVIEWED), "expert_reviewed").when((s == MULTIPLE_SUBMITTERS) | (submitters >= 3), "multi_submitter_concordant").otherwise("single_submitter")


def review_method(tier: Column) -> Column:
    return F.when(tier == "gold", "review_status").when(tier == "silver", "submitter_concordance").otherwise("single_submission")


def endpoint_tier(phase: Column, has_results: Column) -> Column:
    return F.when(phase.isin("phase_3", "phase_4") & _true(has_results), "gold").when(phase.isin("phase_2", "phase_2_3", "phase_3"), "silver").otherwise("bronze")


def dose_matrix_tier(concentrations: Column, matrix: Column) -> Column:
    """(tier, evidence) as a struct."""
    full = _true(matrix & (concentrations >= 3))
    return F.struct(F.when(full, "bronze").otherwise("copper").alias("tier"), F.when(full, "dose_response_matrix").otherwise("single_concentration").alias("evidence"))


def staged_classification(stages: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Results of several stages in one frame with ``stage``: a stage adds only keys that no earlier one has.

    Later stages fill gaps: of each, rows whose keys are covered go by an anti-join.
    """
    done: DataFrame | None = None
    for name, rows in stages:
        fresh = rows if done is None else rows.join(done.select(*keys).distinct(), list(keys), "left_anti")
        fresh = fresh.withColumn("stage", F.lit(name))
        done = fresh if done is None else done.unionByName(fresh)
    return done


# --- inclusion ---------------------------------------------------------------


def in_list(value: Column, terms: Sequence[str]) -> Column:
    """Whether a value is one of configured terms; null is not."""
    return _true(value.isin(*terms))


def effect_included(effect: Column, dependency: Column | None = None, above: float = -0.8, below: float = 0.5) -> Column:
    """effect > -0.8 or dependency < 0.5; a null dependency excludes nothing by itself."""
    return _true(effect > above) | (_true(dependency < below) if dependency is not None else F.lit(False))


def common_and_new(sites: DataFrame, frequency: str, known: DataFrame, locus: Sequence[str], above: float = 0.01) -> DataFrame:
    """Sites over an allele frequency whose locus isn't known yet."""
    return sites.where(F.col(frequency) > above).join(known.select(*locus).distinct(), list(locus), "left_anti")


def sane_alleles(variants: DataFrame, longest: int = 200) -> DataFrame:
    """GRCh38 variants of the allowed types with a locus: position, ref and alt from the VCF columns if both alleles are there, else from the others."""
    absent = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*NO_ALLELE)
    vcf = ~absent("ReferenceAlleleVCF") & ~absent("AlternateAlleleVCF")
    either = lambda a, b: F.when(vcf, F.col(a)).otherwise(F.col(b))
    located = variants.where((F.col("Assembly") == "GRCh38") & F.col("Type").isin(*VARIANT_TYPES) & (F.coalesce("VariationID", F.lit("")) != ""))
    located = located.withColumns({"ref": either("ReferenceAlleleVCF", "ReferenceAllele"), "alt": either("AlternateAlleleVCF", "AlternateAllele"), "position": either("PositionVCF", "Start").try_cast("long")})
    whole = ~absent("ref") & ~absent("alt") & F.col("position").isNotNull() & (F.coalesce("Chromosome", F.lit("")) != "")
    return located.where(whole & (F.length("ref") <= longest) & (F.length("alt") <= longest))


def missed_endpoint(p_value: Column, at: float = 0.05) -> Column:
    """Whether a p-value is one (in [0, 1]) and over the level."""
    return _true(p_value.between(0, 1) & (p_value > at))


def is_drug(kind: Column, name: Column, kinds: Sequence[str] = ("drug", "biologic", "combination")) -> Column:
    return _true(kind.isin(*kinds) & ~F.lower(name).like("%placebo%"))


# --- classes and labels ------------------------------------------------------


def mapped(value: Column, labels: dict[str, int]) -> Column:
    """Label of a value; null for any other."""
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in labels.items()))


def pathogenicity_class(cadd: Column, revel: Column) -> Column:
    """``A`` over 20 with REVEL over 0.5 or unknown, ``C`` from 10 to 20, else null."""
    return F.when((cadd > 20) & (revel.isNull() | (revel > 0.5)), "A").when(cadd.between(10, 20), "C")


def zip_band(score: Column) -> Column:
    return F.when(score > 10, "A").when(score >= -5, "B").when(score >= -10, "C").when(score.isNotNull(), "D")


def mean_severity(kind: Column, weights: dict[str, float] = SEVERITY, otherwise: float = 2.0) -> Column:
    """Aggregate: mean of a weight for each consequence."""
    out = None
    for name, w in weights.items():
        out = (F if out is None else out).when(kind == name, F.lit(w))
    return F.avg(out.otherwise(F.lit(otherwise)))
