"""The queries of the training-data operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, lm, mixing, near_dups, neighbours, oracle, secrets, substrings, token_counts, token_files, toxicity

VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), str(tokenizer_path()))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.groups(documents(spark, sf_dir), 3, 85)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.Scratch(spark, "tokenfiles").path
    token_files.write(documents(spark, sf_dir), path, str(tokenizer_path()), end_id=1)
    return token_files.read(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(substrings.remove_repeats(documents(spark, sf_dir)))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_lm_scores": op3_lm_scores,
    "op4_near_dups": op4_near_dups,
    "op5_secrets": op5_secrets,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_substrings": op8_substrings,
    "op9_neighbours": op9_neighbours,
    "op10_decontamination": op10_decontamination,
}
ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
