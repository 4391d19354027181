"""Reading item tables by dataset, config and split; writing result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_docs(spark: SparkSession, path: str, name: str | None = None, split: str | None = None, fmt: str = "parquet", name_column: str = "dataset_name", split_column: str = "split") -> DataFrame:
    """One split of one config of a dataset. The filters reach the scan; on partition columns they prune folders."""
    docs = spark.read.format(fmt).load(path)
    if name is not None:
        docs = docs.where(F.col(name_column) == name)
    return docs if split is None else docs.where(F.col(split_column) == split)


def union_configs(frames: list[DataFrame]) -> DataFrame:
    """Rows of several configs; a field that one of them lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def eval_split(docs: DataFrame, test: str | None = "test", validation: str | None = "validation", by: str = "task") -> DataFrame:
    """For each task its test rows, or its validation rows if it has no test rows; None names no split."""
    if test is None or validation is None:
        return docs.where(F.col("split") == (test or validation)) if test or validation else docs.where(F.lit(False))
    has = docs.groupBy(F.col(by).alias("by")).agg(F.max(F.col("split") == test).alias("has_test"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(by).alias("own"))  # columns of any names are kept
    chosen = F.when(F.col("has_test"), F.lit(test)).otherwise(F.lit(validation))
    return rows.join(has, F.col("own") == F.col("by")).where(F.col("doc.split") == chosen).select("doc.*")


def fewshot_split(docs: DataFrame, split: str | None = "train") -> DataFrame:
    """Rows of the few-shot split; None means there is no pool."""
    return docs.where(F.col("split") == split) if split is not None else docs.where(F.lit(False))


def write_results(df: DataFrame, path: str, by: str = "task") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def limit_docs(docs: DataFrame, n: int, by: str = "task", order: str = "doc_id") -> DataFrame:
    """The first ``n`` rows of each task."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return docs.select(F.struct("*").alias("doc"), place.alias("place")).where(F.col("place") <= n).select("doc.*")  # columns of any names are kept
