"""Readers and column helpers shared by the corpus operators."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the contracts: space and 0x09 to 0x0D.
SPACE = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_of(column: str | Column, folds: int) -> Column:
    """crc32 of the identifier written as text, modulo ``folds`` (a null id is in fold 0)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def words_of(column: Column) -> Column:
    """Words between ASCII white space, lower-cased in A-Z alone."""
    return F.filter(F.split(F.translate(column, UPPER, LOWER), SPACE), lambda w: w != "")


def fold(identifier: object, folds: int) -> int:
    """``fold_of`` for one Python value."""
    return 0 if identifier is None else zlib.crc32(str(identifier).encode()) % folds


def labelled_ids(labels: DataFrame, label: str, max_per_class: int) -> DataFrame:
    """_id and y (0 or 1) of at most ``max_per_class`` labelled rows a class: those with the smallest id hashes.

    Labels other than 0 and 1 and null ids are left out; an id labelled twice counts with its largest label.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id IS NOT NULL AND y IN (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    picked = [clean.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class) for y in (0, 1)]
    return picked[0].unionByName(picked[1])
