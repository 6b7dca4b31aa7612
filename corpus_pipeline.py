"""The corpus pipeline: toxic documents go, near-duplicates collapse, contaminated documents go, sources are mixed, token ids are written.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs.

Defined results: null and empty texts are clean, have no near-duplicates and no passages; the mix, which is one of words,
leaves them out. Rows of a null doc_id go through each stage, but collapse with none. Of the rows
that repeat a doc_id the near-duplicate stage leaves one at most. Null sources are a source, the last. Extra columns pass through all stages
but the last, whatever their names. A text of any length is read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common, decontamination, mixing, near_dups, queries, token_files, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return near_dups.clean(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents as often as it takes them."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, and from them each document's place, tokens and checksum."""
    path = common.Scratch(spark, "tokenfiles").path
    token_files.write(docs, path, str(queries.tokenizer_path()), end_id=1)
    return token_files.read(spark, path)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dups", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]
#: No SQL: the first stage is a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
