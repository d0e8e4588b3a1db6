"""Sinks: Parquet, JSON lines, light CSV, metric and report files, tables for papers."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def light_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Only some columns, read from storage as such."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns as ``a_x`` columns, to any depth."""
    while any(t.startswith("struct") for _, t in df.dtypes):
        out = []
        for f in df.schema.fields:
            if f.dataType.typeName() == "struct":
                out += [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}{sep}{g}") for g in f.dataType.names]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
    return df


def report(df: DataFrame, most: int = 10_000) -> str:
    """A small frame as JSON; NaN and infinities are null. More than ``most`` rows raise an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")

    def plain(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps([plain(r.asDict(recursive=True)) for r in rows], default=str)


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small frame as a Markdown table."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in json_rows(df)])


def latex(df: DataFrame, digits: int = 3) -> str:
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = [" & ".join(map(show, r)) + r" \\" for r in json_rows(df)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\", r"\midrule", *body, r"\end{tabular}"])


def json_rows(df: DataFrame, most: int = 10_000) -> list[tuple]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table for print has at most {most} rows")
    return [tuple(r) for r in rows]


def croissant(name: str, description: str, df: DataFrame) -> str:
    """Metadata of a data set as JSON-LD with its fields."""
    fields = [{"@type": "cr:Field", "name": c, "dataType": t} for c, t in df.dtypes]
    return json.dumps({"@context": {"@vocab": "https://schema.org/", "cr": "http://mlcommons.org/croissant/"}, "@type": "Dataset", "name": name, "description": description, "recordSet": [{"@type": "cr:RecordSet", "name": name, "field": fields}]}, indent=1)


def ordered(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet files that follow one another in the order of the keys."""
    df.orderBy(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def merged(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Upsert by columns: rows of known keys take the incoming values of ``update`` (where not null), new keys are added."""
    names = existing.columns
    new = incoming.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"_n_{c}") for c in names), F.lit(True).alias("_in"))
    both = existing.withColumn("_old", F.lit(True)).join(new, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "full_outer")
    old = F.coalesce(F.col("_old"), F.lit(False))
    value = lambda c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in update else F.col(c)
    return both.select(*(F.when(old, value(c)).otherwise(F.col(f"_n_{c}")).alias(c) for c in names))


def dataset_card(name: str, tables: dict[str, DataFrame], licence: str, notes: str = "") -> str:
    """A data set's description in Markdown with YAML metadata: each table's rows and columns."""
    out = ["---", f"pretty_name: {name}", f"license: {licence}", "---", "", f"# {name}", ""]
    for title, df in tables.items():
        out += [f"## {title}", "", f"{df.count()} rows", "", "| column | type |", "| --- | --- |", *(f"| {c} | {t} |" for c, t in df.dtypes), ""]
    return "\n".join([*out, notes]).rstrip() + "\n"
