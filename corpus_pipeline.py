"""From raw documents to mixed, tokenised training rows. Each stage works on all the stage before kept; every stage is written and read again.

    quality rules      documents below the floors or far from their language and source go
    n-gram join        one document of each class of near copies stays
    secret scans       secrets are replaced by a mark
    mixing             documents as often as the mixture draws them, in output shards
    BPE                token ids

Rows with null ids, null or empty texts and repeated rows are treated as each operator's docstring says. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe_rounds, chosen_path, mixing_tree, robust_rules, secret_index
from logloom.llm.tables import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return robust_rules.apply_rules(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_index.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing_tree.mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe_rounds.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return tokens.withColumn("n_tokens", F.size("bpe_ids").cast("bigint"))


STAGES = [("quality_rules", quality_rules), ("ngram_join", ngram_join), ("secret_scans", secret_scans), ("mixing", mixing), ("bpe", bpe)]
ORACLE_SQL = None  # robust estimates, classes of near copies and merges are no SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
