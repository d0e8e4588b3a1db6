"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, sampled pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which
is its predecessor's result written as Parquet and read again. All but the last
return the columns of ``docs``. A stage's own intermediate tables are deleted
when the next stage starts, since by then its result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nadir.llm import linededup, mixing, pieces, quality, scratch, shinglesets, simhash
from nadir.llm.queries import vocabulary

_GROUP = "pipeline-stage"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whole."""
    scratch.clear(_GROUP)
    return quality.kept_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; those left without any word go."""
    scratch.clear(_GROUP)
    out, _, taken = linededup.dedup_lines(docs, scratch_group=_GROUP)
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where((F.col(taken) == 0) | has_words).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 of five-word shingles: that of the least doc_id.

    Links come from SimHash fingerprints at 4 or fewer differing bits, each
    checked by its Jaccard similarity. Similar texts may differ in more bits, so an
    exact join follows over what the fingerprints haven't connected.
    Of several rows of a group with that doc_id the one whose text sorts first
    stays; null doc_id comes last. Rows that only share an id, or have none,
    all stay.
    """
    scratch.clear(_GROUP)
    return shinglesets.representatives(docs, scratch_group=_GROUP, linked=simhash.linked_keys)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix of sources takes them."""
    scratch.clear(_GROUP)
    return mixing.mixed_documents(docs, scratch_group=_GROUP)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text, which decode to it."""
    scratch.clear(_GROUP)
    keep = tuple(c for c in ("lang", "source", "n_chars") if c in docs.columns)
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), keep=keep)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("sampled pieces", sample_pieces),
]

#: Similarity joins, fingerprints and sampling from a piece lattice aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    between = scratch.Scratch(spark, "pipeline-run")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = between.table(str(k), docs)
    return docs
