"""The registry and the readers that its queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.plans.staging import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where there is one, its SQL."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round6(column: Column) -> Column:
    return F.round(column, 6)


def quarter(i: Column) -> Column:
    """Quarter ``i`` (from 0) of the text, by characters; the last one has the rest."""
    size = F.floor(F.length("text") / 4).cast("int")
    return F.col("text").substr(1 + i * size, F.when(i == 3, F.length("text")).otherwise(size))


#: The same in SQL, of a variable ``i``.
QUARTER_SQL = "substring(text, 1 + i * (length(text) // 4), CASE WHEN i = 3 THEN length(text) ELSE length(text) // 4 END)"


def mc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in multiple-choice outputs: model, task, doc_id, idx, gold, loglik, choice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task"), "text")
    rows = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("model")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"))
    return rows.select(
        "model", "task", "doc_id", "idx", (F.col("doc_id") % 4).cast("int").alias("gold"),
        (-((F.col("doc_id") * 7919 + F.col("idx") * 104729 + F.col("model") * 1299709) % 1000) / F.lit(100.0)).alias("loglik"),
        quarter(F.col("idx")).alias("choice"),
    )


#: The same rows in SQL, as common table expression ``resp``.
MC_SQL = f"""resp AS (SELECT m AS model, lang AS task, doc_id, i AS idx, doc_id % 4 AS gold,
  -((doc_id * 7919 + i * 104729 + m * 1299709) % 1000)::DOUBLE / 100.0 AS loglik,
  {QUARTER_SQL} AS choice
  FROM documents, (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest([0, 1, 2, 3]) AS i))"""


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in generations: doc_id, task, pred (the text), ref (a benchmark item; items take turns)."""
    items = table(spark, sf_dir, "benchmark")
    refs = items.select("item_id", F.col("text").alias("ref"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("lang").alias("task"), F.col("text").alias("pred"), (F.col("doc_id") % items.agg(F.count("*")).scalar()).alias("item_id"))
    return docs.join(refs, "item_id").drop("item_id")


#: The same rows in SQL, as common table expression ``gen``.
GEN_SQL = """gen AS (SELECT d.doc_id, d.lang AS task, d.text AS pred, b.text AS ref
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""
