"""Parsers of accessions, names, variants and answers as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and labels that results depend on.
UNIPROT = r"^[OPQ][0-9][A-Z0-9]{3}[0-9]$|^[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}$"
ACCESSION_PREFIXES = ("sp", "tr", "uniprotkb")
DOSAGE = r"(?i)\s*[\(\[]\s*\d+\s*(?:mg|ug|µg|ml|g|mcg|iu|%)\b[^\)\]]*[\)\]]"
SALT = r"(?i)\s+(?:hydrochloride|hcl|sodium|potassium|acetate|sulfate|mesylate|maleate|fumarate|tartrate|citrate|besylate|tosylate|dihydrochloride|monohydrate|succinate|phosphate|nitrate|chloride|bromide|calcium|magnesium|disodium|dipotassium)\s*$"
TRAILING_PARENTHESES = r"\s*\(.*\)\s*$"
CONSEQUENCES = (
    ("missense_variant", "missense"), ("missense variant", "missense"), ("nonsense", "nonsense"), ("stop gained", "nonsense"), ("synonymous_variant", "synonymous"), ("synonymous variant", "synonymous"),
    ("frameshift_variant", "frameshift"), ("frameshift variant", "frameshift"), ("splice_site_variant", "splice"), ("splice site variant", "splice"), ("splice_donor_variant", "splice"), ("splice_acceptor_variant", "splice"),
    ("inframe_deletion", "inframe_indel"), ("inframe_insertion", "inframe_indel"), ("inframe deletion", "inframe_indel"), ("inframe insertion", "inframe_indel"), ("missense", "missense"), ("(p.", "missense"),
)
ACMG = r"\b(BA1|BS[1-4]|BP[1-7]|PP3|PM[1-6]|PS[1-4]|PVS1)\b"
MEDGEN_CUI = r"\b(CN?\d{6,8})\b"
CODING = r"(N[MR]_[\d.]+)(?:\([^)]+\))?(:[cgrnomp]\.\S+)"
PROTEIN = r"\((p\.\w+)\)"
GLUED_PROTEIN = r"\s*\(p\..*\)\s*$"
WITH_LABEL = r"^([A-Za-z0-9_]+)\(([^)]+)\)"
WITHOUT_STATE = r"(?s)^(.*?)(?:-(?:phosphorylated|nonphosphorylated).*)?$"
INFO_ID = r"ID=([^,>]+)"
INFO_FORMAT = r'Format: ([^"]+)'
ANNOTATION_IDS = ("vep", "CSQ", "vep_annotation")
CLASSIFICATIONS = (
    ("benign", "benign"), ("likely benign", "likely_benign"), ("benign/likely benign", "benign/likely_benign"), ("pathogenic", "pathogenic"), ("likely pathogenic", "likely_pathogenic"),
    ("pathogenic/likely pathogenic", "pathogenic/likely_pathogenic"), ("uncertain significance", "uncertain_significance"),
)
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: Kyte and Doolittle's hydropathy of the amino acids.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def accession_token(text: Column) -> Column:
    """One accession from ``sp|P00533|EGFR``, ``P00533; Q9Y6K9`` or a bare one; null for empty, none, nan and null."""
    t = F.trim(text)
    parts = F.filter(F.transform(F.split(t, r"\|"), lambda x: F.trim(x)), lambda p: p != "")
    piped = F.when((F.size(parts) >= 2) & F.lower(F.try_element_at(parts, F.lit(1))).isin(*ACCESSION_PREFIXES), F.try_element_at(parts, F.lit(2))).otherwise(F.try_element_at(parts, F.lit(1)))
    token = F.when(F.contains(t, F.lit("|")), piped).otherwise(t)
    first = F.regexp_extract(F.trim(F.regexp_replace(token, r"(?s)[;,/].*", "")), r"^(\S*)", 1)
    return F.when(~F.lower(t).isin("", "none", "nan", "null"), _filled(first))


def uniprot_accession(text: Column) -> Column:
    """A valid accession without its isoform suffix, else null."""
    bare = F.substring_index(F.trim(text), "-", 1)
    return F.when(bare.rlike(UNIPROT), bare)


def clean_drug_name(name: Column) -> Column:
    """Lower case, without dosage in brackets, trailing parentheses or a salt's name; null is empty."""
    t = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), DOSAGE, "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, TRAILING_PARENTHESES, ""), SALT, "")))


def gene_and_mutation(name: Column) -> tuple[Column, Column]:
    """``ABL1(E255K)-phosphorylated`` as (gene, mutation); labels of domains or species are no mutations."""
    label = _filled(F.regexp_extract(name, WITH_LABEL, 2))
    gene = F.coalesce(_filled(F.regexp_extract(name, WITH_LABEL, 1)), F.regexp_extract(name, WITHOUT_STATE, 1))
    return gene, F.when(label.rlike(r"^[A-Z]\d"), label)


def hgvs(name: Column) -> tuple[Column, Column]:
    """Coding notation (without the gene's symbol) and protein notation of a variant's name; null where there is none."""
    coding = F.concat(F.regexp_extract(name, CODING, 1), F.regexp_extract(name, CODING, 2))
    return _filled(F.regexp_replace(coding, GLUED_PROTEIN, "")), _filled(F.regexp_extract(name, PROTEIN, 1))


def consequence(name: Column) -> Column:
    """The first consequence named in a text, else ``other``."""
    t = F.lower(F.coalesce(name, F.lit("")))
    return reduce(lambda w, x: w.when(F.contains(t, F.lit(x[0])), x[1]), CONSEQUENCES[1:], F.when(F.contains(t, F.lit(CONSEQUENCES[0][0])), CONSEQUENCES[0][1])).otherwise("other")


def classification(raw: Column) -> Column:
    """Normal name of a clinical significance, null for any other."""
    t = F.lower(F.trim(raw))
    return F.coalesce(*(F.when(t == k, v) for k, v in CLASSIFICATIONS))


def codes_in(text: Column, pattern: str = ACMG) -> Column:
    """Sorted distinct matches of a pattern with one group."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))))


def phenotypes(ids: Column, names: Column) -> Column:
    """An array of (medgen_cui, omim_id, orphanet_id, mondo_id, name): groups of ids, and the names at the same places.

    Groups with neither MedGen nor OMIM go; a place without a name has null.
    """
    missing = lambda c, *words: F.coalesce(c, F.lit("")).isin("", "na", *words)

    def record(group: Column) -> Column:
        items = F.transform(F.split(group, ","), lambda x: F.trim(x))
        pick = lambda kind: F.try_element_at(F.transform(F.filter(items, lambda x: F.startswith(x, F.lit(f"{kind}:"))), lambda x: F.substring(x, len(kind) + 2, 1 << 20)), F.lit(-1))
        return F.struct(pick("MedGen").alias("medgen_cui"), pick("OMIM").alias("omim_id"), pick("Orphanet").alias("orphanet_id"), pick("MONDO").alias("mondo_id"))

    groups = F.filter(F.transform(F.split(ids, r"\|"), record), lambda r: r["medgen_cui"].isNotNull() | r["omim_id"].isNotNull())
    titles = F.filter(F.transform(F.split(names, r"\|"), lambda x: F.trim(x)), lambda n: n != "")
    known = F.when(missing(names, "not provided"), F.array().cast("array<string>")).otherwise(titles)
    found = F.transform(groups, lambda r, i: F.struct(r["medgen_cui"].alias("medgen_cui"), r["omim_id"].alias("omim_id"), r["orphanet_id"].alias("orphanet_id"), r["mondo_id"].alias("mondo_id"), F.try_element_at(known, i + 1).alias("name")))
    return F.when(~missing(ids), found)


def truncate_words(text: Column, most: int, mark: str = " [...]") -> Column:
    """At most ``most`` characters, cut at the last blank before, with a mark if anything was cut."""
    cut = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*\z", ""), F.lit(mark)))


def annotation(csq: Column, fields: Sequence[str], alt: Column | None = None) -> Column:
    """A map of the first annotation of an annotated INFO value that is of the allele (or names none); empty values go.

    ``fields``: the names that the file's header gives, in order; a repeated name
    stands for its last place.
    """
    places = {name: i for i, name in enumerate(fields)}
    entries = F.transform(F.split(csq, ","), lambda x: F.split(x, r"\|"))
    if alt is not None and "Allele" in places:
        own = lambda e: F.coalesce(F.get(e, F.lit(places["Allele"])), F.lit(""))
        entries = F.filter(entries, lambda e: (own(e) == "") | (own(e) == alt))
    first = F.get(entries, F.lit(0))
    values = F.map_from_arrays(F.array(*map(F.lit, places)), F.array(*(F.get(first, F.lit(i)) for i in places.values()))) if places else F.create_map().cast("map<string,string>")
    return F.when(first.isNotNull(), F.map_filter(values, lambda k, v: F.coalesce(v != "", F.lit(False))))


def annotation_spec(header_line: str) -> tuple[str, list[str]] | None:
    """The INFO id and field names that a ``##INFO`` line of annotations declares."""
    import re

    name, form = re.search(INFO_ID, header_line), re.search(INFO_FORMAT, header_line)
    if not name or not form or name[1] not in ANNOTATION_IDS:
        return None
    return name[1], [f.strip() for f in form[1].split("|")]


def amino_acid_composition(sequence: Column) -> Column:
    """Share of each of the 20 amino acids among them; zeros for none."""
    counts = [F.length(F.regexp_replace(F.coalesce(sequence, F.lit("")), f"[^{a}]", "")) for a in AMINO_ACIDS]
    total = sum(counts[1:], counts[0])
    return F.array(*(F.when(total > 0, n / total).otherwise(0.0) for n in counts))


def looked_up(key: Column, table: dict[str, float]) -> Column:
    """A constant of a small table, null for any other key."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def substitution(ref: Column, alt: Column, matrix: dict[tuple[str, str], float]) -> Column:
    """A substitution matrix's value of two amino acids, in either order."""
    table = {f"{a}{b}": v for (a, b), v in matrix.items()}
    return F.coalesce(looked_up(F.concat(ref, alt), table), looked_up(F.concat(alt, ref), table))


def hydropathy_change(ref: Column, alt: Column) -> Column:
    """Hydropathy of the new amino acid minus that of the old one."""
    return looked_up(alt, HYDROPATHY) - looked_up(ref, HYDROPATHY)


def dummies(value: Column, categories: Sequence[str], prefix: str) -> list[Column]:
    """A 0/1 column for each category; null is 0 in all."""
    return [F.coalesce((value == c).cast("int"), F.lit(0)).alias(f"{prefix}_{c}") for c in categories]


def tested_evidence(response: Column) -> Column:
    """What an answer says after its first line; null if nothing."""
    bare = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    t = bare(response)
    return F.when(F.contains(t, F.lit("\n")), _filled(bare(F.regexp_replace(t, r"(?s)\A[^\n]*\n", ""))))


def template(pattern: str, **columns: Column) -> Column:
    """Text with ``{name}`` replaced by columns; a null column is ``unknown``."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(pattern):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("unknown")))
    return F.concat(*parts) if parts else F.lit("")


def lines_of(*rows: tuple[str, Column]) -> Column:
    """``label: value`` lines; those whose value is null are left out."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), value.cast("string")) for label, value in rows))
