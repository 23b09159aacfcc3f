"""A training-corpus pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet in the
shared folder and read back as the next one's ``docs``. All but the last return the
columns of ``docs``; once a stage's output is written its input's files go.

Defined cases, of every stage: a row with a null or empty text fails the quality rules, so later stages see texts of 20 words or
more; a null doc_id, source or language is kept as it is, a null source being a source of its own; equal rows pass the rules alike, and
one of them stays after the second stage; extra columns under any name go through all stages but the last; with no documents every stage
returns no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datastrata.llm import decontaminate, jaccard_join, mixing, quality, token_output
from datastrata.llm.common import free, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go, and so do lines that too many documents of a host have."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document of smallest doc_id of each group stays."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target takes it; the last one of a source in part."""
    return mixing.mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the binary format and read back, a row per document."""
    return token_output.token_output(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            free(before)
    return docs


#: The tokenizer and the components of near duplicates are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
