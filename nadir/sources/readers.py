"""Readers for the raw layouts: delimited text, wide matrices, line formats, identifier lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nadir.functions.columns import snake


def resolve_columns(df: DataFrame, wanted: dict[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Canonical names from aliases, compared in snake case; missing optional columns are null strings."""
    have = {snake(c): c for c in reversed(df.columns)}
    out = []
    for name, aliases in wanted.items():
        found = next((have[snake(a)] for a in (name, *aliases) if snake(a) in have), None)
        if found is None and name in required:
            raise ValueError(f"no column for {name} among {df.columns}")
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def delimited(spark: SparkSession, path: str, sep: str = "\t", schema: T.StructType | str | None = None, header: bool = True, columns: Sequence[str] | None = None, comment: str | None = None) -> DataFrame:
    """Text with a separator; compressed by suffix. Without a schema every column is a string, never inferred."""
    reader = spark.read.option("sep", sep).option("header", header).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    return df.select(*columns) if columns else df


def optional_table(spark: SparkSession, path: str, schema: T.StructType, read) -> DataFrame:
    """``read(path)``, or an empty frame of the schema if there is nothing at the path."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(sc._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return read(path)


def has_header(first_line: str, names: Sequence[str], sep: str = "\t") -> bool:
    """Whether a first line holds column names rather than values."""
    cells = {snake(c) for c in first_line.split(sep)}
    return bool(cells & {snake(n) for n in names})


def detect_header(spark: SparkSession, path: str, names: Sequence[str], sep: str = "\t") -> DataFrame:
    """A table that may or may not have a header line; without one the names are given."""
    first = spark.read.text(path).first()
    if first is not None and has_header(first[0], names, sep):
        return delimited(spark, path, sep)
    return delimited(spark, path, sep, T.StructType([T.StructField(n, T.StringType()) for n in names]), header=False)


def wide_matrix(df: DataFrame, index: str, variable: str = "variable", value: str = "value") -> DataFrame:
    """A matrix with an index column as (index, variable, value) rows; null cells go."""
    cells = [c for c in df.columns if c != index]
    return df.select(F.col(f"`{index}`").alias(index), *(F.col(f"`{c}`").cast("double").alias(c) for c in cells)).unpivot([f"`{index}`"], [f"`{c}`" for c in cells], variable, value).where(F.col(value).isNotNull())


def symbol_and_id(name: str = "variable"):
    """``SYMBOL (123)`` as (symbol, id)."""
    return F.regexp_extract(name, r"^(.*?)\s*\(\d+\)$", 1).alias("symbol"), F.regexp_extract(name, r"\((\d+)\)$", 1).try_cast("long").alias("entrez_id")


def omics_features(expression: DataFrame, copy_number: DataFrame, mutation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Three long frames (keys, value) side by side; what a frame lacks is 0."""
    named = [f.select(*keys, F.col("value").alias(n)) for f, n in ((expression, "expression"), (copy_number, "copy_number"), (mutation, "mutation"))]
    out = named[0].join(named[1], list(keys), "full_outer").join(named[2], list(keys), "full_outer")
    return out.na.fill(0.0, ["expression", "copy_number", "mutation"])


def mitab(spark: SparkSession, path: str) -> DataFrame:
    """Negative interactions of PSI-MI TAB 2.7: both accessions, detection method, publication. Column 36 says ``true``."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(cells.alias("c")).where(F.size("c") >= 36).where(F.lower(F.trim(F.col("c")[35])) == "true")
    accession = lambda i: F.nullif(F.regexp_extract(F.col("c")[i], r"uniprotkb:([A-Z0-9]+)", 1), F.lit(""))
    return rows.select(accession(0).alias("protein_a"), accession(1).alias("protein_b"), F.nullif(F.regexp_extract(F.col("c")[6], r"(MI:\d{4})", 1), F.lit("")).alias("method"), F.nullif(F.regexp_extract(F.col("c")[8], r"pubmed:(\d+)", 1), F.lit("")).alias("pubmed_id"))


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """Two columns split by any white space."""
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(c.alias("c")).where(F.size("c") >= 2).select(F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))


def id_mapping(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One value a key: the first in an explicit order."""
    from nadir.operators.pairs import first_per_group

    return first_per_group(df.where(F.col(key).isNotNull()), [key], list(order)).select(key, value)


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """A row for each alternate allele: locus, alleles and INFO as a map (of a repeated key the last value), with its place for Number=A fields."""
    from nadir.functions.columns import info_map

    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(c.alias("c")).where(F.size("c") >= 8)
    base = rows.select(F.regexp_replace(F.col("c")[0], "^chr", "").alias("chromosome"), F.col("c")[1].cast("long").alias("position"), F.col("c")[3].alias("ref"), F.posexplode(F.split(F.col("c")[4], ",")).alias("allele", "alt"), info_map(F.col("c")[7]).alias("info"))
    return base.where(~F.col("alt").rlike(r"^[<*.]|[\[\]]"))


def per_allele(info: str, key: str, allele: str = "allele"):
    """The value of a Number=A field for this allele."""
    return F.try_element_at(F.split(F.col(info)[key], ","), F.col(allele) + 1)


def gene_rows(df: DataFrame, index: str, variable: str = "cell_line", value: str = "value") -> DataFrame:
    """A matrix with a row for each gene, ``SYMBOL (id)``, as (symbol, entrez_id, cell_line, value) rows; null cells and rows without an id go."""
    long = wide_matrix(df, index, variable, value)
    return long.select(*symbol_and_id(index), variable, value).where("entrez_id is not null")


def screen_matrix(df: DataFrame, index: str) -> DataFrame:
    """A primary drug screen, a row for each cell line: (model_id, compound, log_fold_change); a column's name ends at ``::``."""
    long = wide_matrix(df, index, "_c", "log_fold_change")
    return long.select(F.trim(F.col(index)).alias("model_id"), F.substring_index(F.trim("_c"), "::", 1).alias("compound"), "log_fold_change")


def screen_summary(df: DataFrame, values: Sequence[str] = ("auc", "ic50", "ec50")) -> DataFrame:
    """A secondary drug screen in long form: (model_id, compound, values), with the names of older releases as fallback; rows without either key go."""
    have = set(df.columns)
    first = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    number = lambda n: (F.col(n).try_cast("double") if n in have else F.lit(None).cast("double")).alias(n)
    out = df.select(first("depmap_id", "row_name").alias("model_id"), F.substring_index(first("broad_id", "column_name"), "::", 1).alias("compound"), *(number(v) for v in values))
    return out.where("model_id is not null and compound is not null")


def scored_links(spark: SparkSession, path: str) -> DataFrame:
    """Links split by blanks with a header line and a score in the third column."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(c.alias("c")).where(F.size("c") >= 3)
    return rows.select(F.col("c")[0].alias("a"), F.col("c")[1].alias("b"), F.col("c")[2].try_cast("int").alias("score")).where("score is not null")


def link_degrees(links: DataFrame, least: int = 0) -> DataFrame:
    """Distinct partners of every end of links with a score from ``least`` on."""
    from nadir.operators.pairs import two_sided_degree

    return two_sided_degree(links.where(F.col("score") >= least).where("a <> b"), "a", "b")


def vcf_annotation_spec(spark: SparkSession, path: str) -> tuple[str, list[str]] | None:
    """INFO id and field names of the annotations that a VCF's header declares; the last declaration counts."""
    from nadir.functions.parsers import ANNOTATION_IDS, INFO_FORMAT, INFO_ID, annotation_spec

    line = F.col("value")
    declared = spark.read.text(path).where(line.startswith("##INFO=") & F.regexp_extract(line, INFO_ID, 1).isin(*ANNOTATION_IDS) & line.rlike(INFO_FORMAT))
    last = declared.withColumn("at", F.monotonically_increasing_id()).agg(F.max_by("value", "at")).first()[0]
    return annotation_spec(last) if last is not None else None


def variant_summary(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a summary release, a row each: locus, gene, names, class, tier, submitters and phenotypes. GRCh38 and small variants only."""
    from nadir.functions import parsers as A
    from nadir.operators import tiers as K

    rows = K.sane_alleles(delimited(spark, path).withColumnRenamed("#AlleleID", "AlleleID"))
    coding, protein = A.hgvs(F.col("Name"))
    return rows.select(
        F.col("VariationID").try_cast("long").alias("variation_id"), F.col("Chromosome").alias("chromosome"), "position", "ref", "alt", F.col("GeneSymbol").alias("gene_symbol"), F.when(F.col("GeneID") != "-1", F.col("GeneID").try_cast("long")).alias("gene_id"),
        coding.alias("hgvs_coding"), protein.alias("hgvs_protein"), A.consequence(F.col("Name")).alias("consequence"), A.classification(F.col("ClinicalSignificance")).alias("classification"), K.review_tier(F.col("ReviewStatus")).alias("tier"),
        F.coalesce(F.col("NumberSubmitters").try_cast("int"), F.lit(0)).alias("submitters"), A.phenotypes(F.col("PhenotypeIDS"), F.col("PhenotypeList")).alias("phenotypes"),
    )


def submission_summary(spark: SparkSession, path: str, variants: DataFrame | None = None) -> DataFrame:
    """Submissions: comment lines go, but for the one that begins ``#VariationID`` and a tab, which is the header. ``variants``: only those of its variation_id."""
    from nadir.functions import columns as C
    from nadir.functions import parsers as A

    text = spark.read.text(path)
    header = text.where(F.col("value").startswith("#VariationID\t")).first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    names = header[0].lstrip("#").split("\t")
    cells = F.split("value", "\t")
    rows = text.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(*(F.nullif(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))
    scv = "SCV" if "SCV" in names else "ClinVarAccession"
    get = lambda n: F.col(n) if n in names else F.lit(None).cast("string")
    year = F.regexp_extract(get("DateLastEvaluated"), r"^(\d{4})-", 1).try_cast("int")
    out = rows.select(
        F.col("VariationID").try_cast("long").alias("variation_id"), F.substring_index(get(scv), ".", 1).alias("accession"), get("Submitter").alias("submitter"), A.classification(get("ClinicalSignificance")).alias("classification"), get("ReviewStatus").alias("review_status"),
        F.coalesce(F.when(year.between(1990, 2030), year), C.year_in(get("DateLastEvaluated"))).alias("year"), A.codes_in(F.concat_ws(" ", get("Description"), get("ExplanationOfInterpretation"), get("ClinicalSignificance"))).alias("acmg"), A.codes_in(get("ReportedPhenotypeInfo"), A.MEDGEN_CUI).alias("medgen_cuis"),
    ).where("variation_id is not null")
    return out if variants is None else out.join(variants.select("variation_id").distinct(), "variation_id", "left_semi")


def sniffed(spark: SparkSession, path: str, seps: Sequence[str] = ("\t", ",")) -> DataFrame:
    """Delimited text with the first of the separators that its first line holds."""
    first = spark.read.text(path).first()
    sep = next((s for s in seps if first is not None and s in first[0]), seps[-1])
    return delimited(spark, path, sep)


def zipped(spark: SparkSession, path: str, member: str | None = None, sep: str = "\t") -> DataFrame:
    """A table in a zip archive (its only member, or the one named), a row of strings each.

    An archive can't be divided, so each is one row of bytes (2 GB at most, else
    Spark raises an error) in one task, which unpacks it line by line; several
    archives under a path are read side by side. Each one's first line is its
    header, and that of the first path names the columns. Other suffixes are read
    as text, compressed or not.
    """
    if not path.endswith(".zip"):
        return delimited(spark, path, sep)

    def lines(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/")]
                    if member is None and len(names) != 1:
                        raise ValueError(f"an archive with {len(names)} members needs a member's name")
                    with io.TextIOWrapper(archive.open(member or names[0]), "utf-8") as text:
                        header = True
                        while block := text.readlines(1 << 20):
                            rows = pd.DataFrame({"value": [x.rstrip("\r\n") for x in block], "header": False})
                            rows.loc[0, "header"], header = header, False
                            yield rows

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string, header boolean")
    header = text.where("header").first()
    if header is None:
        raise ValueError(f"an empty table in {path}")
    cells = F.split("value", sep)
    return text.where("not header").select(*(F.get(cells, F.lit(i)).alias(n.lstrip("\ufeff")) for i, n in enumerate(header[0].split(sep))))


def sheet(spark: SparkSession, path: str, wanted: dict[str, Sequence[str]], most: int = 1_000_000) -> DataFrame:
    """Identifier columns of a small spreadsheet, as strings, read on the driver; more than ``most`` rows raise an error. Needs pandas' spreadsheet engine."""
    import pandas as pd

    pdf = pd.read_excel(path, dtype=str)
    if len(pdf) > most:
        raise ValueError(f"a sheet has at most {most} rows")
    return resolve_columns(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` string" for c in pdf.columns)), wanted)


def config(path: str) -> dict:
    """A configuration of nested mappings and lists in YAML, or JSON by its suffix; driver-side."""
    import json
    from pathlib import Path

    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the yaml package") from e
    return yaml.safe_load(text)


class Connector:
    """What fetches a source to a path before it is read; network access is left to the user's own subclass."""

    def fetch(self, source: str, to: str) -> str:
        raise NotImplementedError("subclass it with the access that your site allows")


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """A gene to a line, ``SYMBOL (id)`` or a bare symbol; comments and blank lines go."""
    t = F.trim("value")
    return spark.read.text(path).select(t.alias("t")).where("t <> '' and t not like '#%'").select(F.regexp_replace("t", r"\s*\(\d+\)$", "").alias("symbol")).distinct()


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def run_results(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """``*/results.json`` under a root, with the run's folder and the file's time."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/results.json")
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/results\.json$", 1).alias("run"), F.col("_metadata.file_modification_time").alias("modified"))
