"""Intermediate tables in the folder all executors share, and input columns by name only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import configure, shared_folder


BATCH_ROWS = "2000"  # rows of an Arrow batch: with long texts the default of 10,000 is much memory per worker


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once, go on from the files: a lost executor repeats a read, and nothing is computed twice."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_key(*cols, seed: int = 0):
    """Non-negative 63-bit hash of columns, the same wherever and whenever it is computed."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(docs: DataFrame, *prefixes: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with every column that begins like one of the operator's own renamed, and a function that gives a result the columns of `docs` back."""
    other = {c: f"aside{i}_{c}" for i, c in enumerate(docs.columns) if c.lower().startswith(prefixes)}
    return docs.withColumnsRenamed(other), lambda df: df.select(*(quoted(other.get(c, c)).alias(c) for c in docs.columns))


def own_columns(docs: DataFrame, prefix: str, results: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` without columns called like a result and with other columns of the operator's prefix renamed, and a function that gives those their names back."""
    docs = docs.drop(*(quoted(c) for c in docs.columns if c.lower() in results))
    other = {c: f"aside{i}_{c}" for i, c in enumerate(docs.columns) if c.lower().startswith(prefix)}
    return docs.withColumnsRenamed(other), lambda df: df.withColumnsRenamed({new: old for old, new in other.items()})
