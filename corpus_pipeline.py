"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents
that it keeps, with the columns of `documents`. The last one adds the places in the mix.

Defined for odd rows: a null or empty text has no language and goes in the first stage; given to a later one
it stays (near copies: one of those without a word stays). A null lang is never learned, a null source is a
source of its own, rows without doc_id are nobody's copy, lose no line and stay. Rows that share a doc_id
are one document to the near-copy stage, which keeps the one of least content hash, the same whenever a task
runs again; the other stages treat each row for itself. Ties go to the least doc_id there, to the first
name among languages and sources. An empty table gives an empty table. Very long texts go whole; extra columns
pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontamination, language_id, line_dedup, mixing, similar_texts
from quillmark.llm.queries import held_out
from quillmark.plans.staging import drop_staged, staged
from quillmark.sources.tables import table


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage for documents with any further columns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in COLUMNS else f"extra_{k}" for k, c in enumerate(docs.columns)]
        kept = stage(spark, docs.toDF(*plain), sf_dir)
        added = [c for c in kept.columns if c not in plain]
        back = [F.col(own).alias(f"{c}_input" if c in added else c) for own, c in zip(plain, docs.columns, strict=True)]
        return kept.select(*back, *added)

    return run


@carrying
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undecided go; lang stays as it was labelled."""
    dictionaries = language_id.learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return language_id.decided(docs, dictionaries)


@carrying
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for one document; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long") if "n_chars" in docs.columns else F.lit(None)).select(*docs.columns)


@carrying
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by SimHash or by a 5-word similarity of 0.8 or more."""
    return similar_texts.keep_one(docs).select(*docs.columns)


@carrying
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@carrying
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix of sources, by the exact weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to `documents`, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_staged(before)
        before = docs
    return docs


#: Compression, SimHash and Pfair scheduling have no SQL; tests hold the run against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
