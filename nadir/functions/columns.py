"""Column expressions: ordered enums, tiers, classes, parsers, units. All but ``info_map`` stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Orders and thresholds that results depend on.
TIERS = ("gold", "silver", "bronze", "copper")
PHASES = ("not_applicable", "early_phase_1", "phase_1", "phase_1_2", "phase_2", "phase_2_3", "phase_3", "phase_4")
UNIT_TO_NM = {"nm": 1.0, "nanomolar": 1.0, "um": 1e3, "µm": 1e3, "micromolar": 1e3, "mm": 1e6, "millimolar": 1e6, "m": 1e9, "molar": 1e9}
FAILURE_KEYWORDS = (
    ("safety", r"safe|toxic|adverse|death|fatal|SAE|SUSAR|side.?effect|hepato|cardio|liver"),
    ("efficacy", r"efficac|futili|lack.?of.?effect|ineffect|no.?benefit|negative|primary.?endpoint.?not|did.?not.?meet|failed.?to.?demonstrate"),
    ("pharmacokinetic", r"pharmacokinetic|PK|bioavailab|ADME|absorption|metabolism|drug.?drug.?interaction|DDI"),
    ("enrollment", r"enroll|recruit|accrual|low.?participation|insufficient.?patient|slow.?enroll|unable.?to.?enroll"),
    ("strategic", r"strategic|business|commercial|sponsor|portfolio|company|financial|merger|acquisition|decision|funding|priority"),
    ("regulatory", r"regulat|FDA|EMA|approval|IND|clinical.?hold|CRL"),
    ("design", r"design|protocol|amendment|endpoint.?change|sample.?size|inadequate.?power|statistical"),
)
CLINICAL = r"efficac|futili|safe|toxic|adverse|endpoint|fail|no.?benefit|lack.?of|pharmacokinetic|negative.?result|death|dsmb"
EXTERNAL = r"covid|pandemic|earthquake|hurricane|natural.?disaster|war"
ADMINISTRATIVE = r"business|strategic|sponsor|funding|portfolio|company|administrative|logistic|resource|decision.?to"
SYNERGY_BANDS = ((10.0, "strongly_synergistic"), (5.0, "synergistic"))
NUMBER = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
CODE_NAME = r"(?i)^[A-Z]{2,5}-\d+"
UNPLAYED = r"(?i)\bplacebo\b|\bsaline\b|\bsham\b|\bstandard\s+(?:of\s+)?care\b|\bno\s+intervention\b"
UNTESTED = ("untested", "not tested", "not been tested", "never been tested", "never tested", "hasn't been tested", "has not been tested", "no testing", "no evidence of testing")


# Keywords of therapeutic areas and compartments, first hit wins.
AREAS = (
    ("oncology", ("cancer", "tumor", "tumour", "carcinoma", "lymphoma", "leukemia", "melanoma", "sarcoma", "myeloma", "glioma", "neoplasm")),
    ("cardiology", ("heart", "cardiac", "coronary", "atrial", "hypertension", "myocardial", "arrhythmia", "angina")),
    ("neurology", ("alzheimer", "parkinson", "epilepsy", "seizure", "multiple sclerosis", "neuropathy", "stroke", "migraine", "dementia")),
    ("psychiatry", ("depression", "anxiety", "schizophrenia", "bipolar", "ptsd")),
    ("infectious", ("hiv", "hepatitis", "tuberculosis", "malaria", "covid", "influenza")),
    ("metabolic", ("diabetes", "obesity", "metabolic syndrome", "hyperlipidemia")),
    ("respiratory", ("asthma", "copd", "pulmonary", "lung fibrosis")),
    ("autoimmune", ("rheumatoid", "lupus", "crohn", "colitis", "psoriasis")),
)
COMPARTMENTS = (
    ("nucleus", ("nucleus", "nuclear")), ("extracellular", ("extracellular", "secreted")), ("mitochondria", ("mitochondri",)), ("er", ("endoplasmic",)), ("golgi", ("golgi",)),
    ("plasma_membrane", ("plasma membrane", "cell membrane")), ("cytoplasm", ("cytoplasm", "cytosol")), ("membrane", ("membrane",)),
)


def substring_class(text: Column, table: Sequence[tuple[str, Sequence[str]]], otherwise: str = "other", missing: str | None = None) -> Column:
    """The first name one of whose words the lower-cased text contains; null and empty text are ``missing``."""
    t = F.lower(text)
    out = F.when(F.coalesce(text, F.lit("")) == "", missing or otherwise)
    for name, parts in table:
        out = out.when(reduce(lambda a, b: a | b, (F.contains(t, F.lit(p)) for p in parts)), name)
    return out.otherwise(otherwise)


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """1-based place of a value in an ordered enum; unknown or null gives null."""
    return reduce(lambda w, x: w.when(value == x[1], x[0]), enumerate(order[1:], 2), F.when(value == order[0], 1))


def unrank(rank: Column, order: Sequence[str]) -> Column:
    """The enum value at a 1-based place; null outside."""
    return F.when((rank >= 1) & (rank <= len(order)), F.element_at(F.array(*map(F.lit, order)), rank.cast("int")))


def best_of(value: Column, order: Sequence[str] = TIERS) -> Column:
    """Aggregate: the first value of the order that a group has; unknown values are skipped."""
    return unrank(F.min(rank_of(value, order)), order)


def highest_of(value: Column, order: Sequence[str] = PHASES) -> Column:
    """Aggregate: the last value of the order that a group has."""
    return unrank(F.max(rank_of(value, order)), order)


def any_precedence(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Aggregate: the first name whose condition holds for any row."""
    out = None
    for condition, name in cases:
        out = (F if out is None else out).when(F.bool_or(F.coalesce(condition, F.lit(False))), name)
    return out.otherwise(otherwise)


def study_count(study: Column, null_is_study: bool = True) -> Column:
    """Aggregate: distinct studies; all null studies count as one, unless ``null_is_study`` is off."""
    return F.countDistinct(F.coalesce(study, F.lit(-1)) if null_is_study else study)


def source_count(source: Column | str) -> Column:
    """Aggregate: distinct sources without null, of which there are few: they are held as a set, so no rows are made for a second distinct count."""
    return F.size(F.collect_set(source)).cast("long")


def fraction(condition: Column) -> Column:
    """Aggregate: share of all rows, those with a null condition included."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def std_or_zero(value: Column) -> Column:
    """Aggregate: sample deviation, 0 for a single value."""
    return F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of a symmetric pair, lesser first."""
    return F.least(a, b), F.greatest(a, b)


def synergy_class(score: Column) -> Column:
    return (
        F.when(score > 10, "strongly_synergistic").when(score > 5, "synergistic").when(score >= -5, "additive").when(score >= -10, "antagonistic").when(score.isNotNull(), "strongly_antagonistic")
    )


def combo_class(score: Column) -> Column:
    return F.when(score > 50, "strongly_synergistic").when(score > 20, "synergistic").when(score >= -20, "additive").when(score >= -50, "antagonistic").when(score.isNotNull(), "strongly_antagonistic")


def consensus_class(klass: Column) -> Column:
    """Aggregate: the class over half of all rows, else context_dependent; graded classes count with their kind."""
    share = lambda *names: fraction(klass.isin(*names))
    return (
        F.when(share("antagonistic", "strongly_antagonistic") > 0.5, "antagonistic")
        .when(share("synergistic", "strongly_synergistic") > 0.5, "synergistic")
        .when(share("additive") > 0.5, "additive")
        .otherwise("context_dependent")
    )


def essentiality_tier(effect: Column, dependency: Column, reference: Column) -> Column:
    dep = F.coalesce(dependency, F.lit(1.0))
    return F.when((effect > -0.2) & (dep < 0.3) & reference, "gold").when((effect > -0.5) & (dep < 0.5), "silver").otherwise("bronze")


def affinity_class(p: Column) -> Column:
    return F.when(p <= 5, "inactive").when(p >= 7, "active").when(p.isNotNull(), "borderline")


def inactive_branch(p: Column, relation: Column, value: Column, unit: Column) -> Column:
    """Which branch of the inactivity predicate holds: quantitative, right_censored, or null."""
    return F.when(p.isNotNull() & (p < 4.5), "quantitative").when(p.isNull() & relation.isin(">", ">=") & (value >= 10000) & (unit == "nM"), "right_censored")


def first_qualifying(candidates: Sequence[tuple[str, Column, Column]], threshold: float) -> Column:
    """(name, value) of the first candidate (name, relation, value) that is inactive.

    A censored value counts from the threshold on, an exact one above it.
    """
    tests = [F.when((rel.isin(">", ">=") & (v >= threshold)) | ((rel == "=") & (v > threshold)), F.struct(F.lit(name).alias("name"), v.alias("value"))) for name, rel, v in candidates]
    return F.coalesce(*tests)


def human_taxid(text: Column) -> Column:
    """Whether a possibly multi-valued taxonomy cell holds 9606."""
    return F.coalesce(F.exists(F.split(F.trim(text), r"[;,/|\s]+"), lambda t: F.coalesce(F.floor(t.try_cast("double")) == 9606, F.lit(False))), F.lit(False))


def relation_of(raw: Column) -> Column:
    """``>``, ``>=``, ``<``, ``<=`` or ``=`` at the start of a censored value; none is ``=``."""
    got = F.regexp_extract(F.trim(raw), "^([<>]=?)", 1)
    return F.when(got == "", "=").when(got.isNull(), "=").otherwise(got)


def number_of(raw: Column) -> Column:
    """The first number of a text, or null."""
    return F.nullif(F.regexp_extract(raw, NUMBER, 1), F.lit("")).try_cast("double")


def to_nanomolar(value: Column, unit: Column) -> Column:
    key = F.lower(F.regexp_replace(F.trim(unit), " ", ""))
    return value * F.try_element_at(F.create_map(*(F.lit(x) for kv in UNIT_TO_NM.items() for x in kv)), key)


def p_value_of(nanomolar: Column) -> Column:
    """9 - log10 of a concentration in nM; null unless positive."""
    return F.when(nanomolar > 0, 9 - F.log10(nanomolar))


def snake(name: str) -> str:
    import re

    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def parse_date(text: Column) -> Column:
    """``2022-05-01``, ``March 15, 2021`` or ``January 2020`` (its first day); else null."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    long_form = F.when(t.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), F.try_to_timestamp(t, F.lit("MMMM d, yyyy")))
    month = F.when(t.rlike(r"^[A-Za-z]+ \d{4}$"), F.try_to_timestamp(F.concat(F.lit("1 "), t), F.lit("d MMMM yyyy")))
    return F.coalesce(iso, long_form, month).cast("date")


def year_in(text: Column) -> Column:
    """The first four-digit year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")


def source_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts joined by bars; null parts are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16)


def keyword_class(text: Column, rules: Sequence[tuple[str, str]] = FAILURE_KEYWORDS, otherwise: str = "other") -> Column:
    """The first rule whose pattern a text has, regardless of case."""
    out = None
    for name, pattern in rules:
        out = (F if out is None else out).when(text.rlike(f"(?i){pattern}"), name)
    return out.otherwise(otherwise)


def termination_type(reason: Column) -> Column:
    hit = lambda p: reason.rlike(f"(?i){p}")
    return (
        F.when(F.coalesce(F.trim(reason), F.lit("")) == "", "unknown").when(hit(CLINICAL), "clinical_failure").when(hit(EXTERNAL), "external_event").when(hit(ADMINISTRATIVE), "administrative").otherwise("clinical_failure")
    )


def first_label(labels: Column, precedence: Sequence[str], otherwise: str = "other") -> Column:
    """The first name of ``precedence`` that an array has."""
    return F.coalesce(*(F.when(F.array_contains(labels, p), p) for p in precedence), F.lit(otherwise))


def is_code_name(name: Column) -> Column:
    return F.trim(name).rlike(CODE_NAME)


def is_non_drug(name: Column) -> Column:
    return F.coalesce(name.rlike(UNPLAYED), F.lit(False))


def choice_letter(response: Column, letters: str = "ABCD") -> Column:
    """The letter that a free answer to a multiple-choice question names, or null."""
    t = F.trim(response)
    pick = lambda p, x=t: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    c = f"[{letters}]"
    up = F.upper(t)
    found = F.coalesce(
        F.when(up.rlike(f"^{c}$"), up),
        pick(rf"(?i)(?:answer|choice)\s*(?:is|:)\s*\(?({c})\)?"), pick(rf"(?i)\(({c})\)"), pick(rf"(?i)^({c})\."), pick(rf"(?i)^({c})\)"),
        F.when(F.substring(up, 1, 1).rlike(c), F.substring(up, 1, 1)), pick(rf"\b({c})\b", up),
    )
    return F.upper(found)


def tested_answer(response: Column) -> Column:
    """tested, untested or null from the first line of an answer."""
    first = F.lower(F.trim(F.substring_index(F.trim(response), "\n", 1)))
    return F.when(reduce(lambda a, b: a | b, (F.contains(first, F.lit(p)) for p in UNTESTED)), "untested").when(F.contains(first, F.lit("tested")), "tested")


def lenient_json(response: Column, schema: str) -> Column:
    """A struct from an answer that may have code fences and words around its JSON object."""
    bare = F.regexp_replace(F.trim(response), r"```\w*\s*", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, although lambdas inside would compute it for each element."""
    return F.transform(F.array(value), use)[0]


@F.arrow_udf(T.MapType(T.BinaryType(), T.BinaryType()))
def _last_values(texts: pa.Array) -> pa.Array:
    """Bytes as maps of their items, by one sort of (text, key) a slice of texts, which keeps the items' order within a key."""
    maps = []
    for start in range(0, len(texts) or 1, 256):
        part = texts[start : start + 256]
        split = pc.split_pattern(part, b";")
        text, items = pc.list_parent_indices(split), pc.list_flatten(split)
        some = pc.not_equal(items, b"")
        text, halves = text.filter(some).to_numpy(), pc.split_pattern(items.filter(some), b"=", max_splits=1)
        n = pc.list_value_length(halves).to_numpy(zero_copy_only=False)
        first = np.cumsum(n) - n
        keys = pc.list_flatten(halves).take(pa.array(first)).dictionary_encode()
        rank = np.empty(len(keys.dictionary), np.int64)
        rank[pc.array_sort_indices(keys.dictionary).to_numpy()] = np.arange(len(rank))
        group = text * len(rank) + rank[keys.indices.to_numpy()]
        order = np.argsort(group, kind="stable")
        last = order[np.diff(group[order], append=-1) != 0]
        values = pc.list_flatten(halves).take(pa.array(first[last] + 1, mask=n[last] == 1))
        ends = np.cumsum(np.bincount(text[last], minlength=len(part)))
        offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append(part.is_null().to_numpy(zero_copy_only=False), False))
        maps.append(pa.MapArray.from_arrays(offsets, keys.take(pa.array(last)).dictionary_decode(), values))
    return pa.concat_arrays(maps)


def info_map(text: Column) -> Column:
    """``k=v;k2=v2`` as a map, a repeated key with its last value; a key without a value maps to null, empty items go.

    In Arrow batches, as Catalyst's array functions are interpreted for every item; so no lambda's variable can be the text.
    """
    return _last_values(text.cast("binary")).cast("map<string,string>")


def one_hot(value: Column, categories: Sequence[str]) -> Column:
    """0/1 for each category and a last place for anything else."""
    known = [F.when(value == c, 1).otherwise(0) for c in categories]
    return F.array(*known, F.when(value.isin(*categories), 0).otherwise(1))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over united set bits of two arrays of 0/1."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) | (y > 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(either > 0, both / either).otherwise(0.0)


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
