"""Gapless global row numbers and prefix sums without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.plans.staging import staged


def global_rank(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds ``name``: the 0-based place of each row by ``order`` among all rows (of its ``group``).

    Rows are range-partitioned by (group, order), counted per partition, and numbered inside their
    partition on top of the counts before it. Only the counts (partitions x groups rows, so ``group``
    must have few values and no nulls) are broadcast. A group with most of the rows spreads over many
    partitions because ``order`` is part of the range key; ``order`` should end in a unique column.
    ``total`` names an extra column with the number of rows (of the group).
    """
    ranged = staged(df.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_pid", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(*group)).alias("_total")
    )
    inside = Window.partitionBy("_pid", *group).orderBy(*order)
    ranked = ranged.join(F.broadcast(offsets), ["_pid", *group]).withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
    ranked = ranked.withColumn(total, F.col("_total")) if total else ranked
    return ranked.drop("_pid", "_offset", "_total")


def prefix_sums(df: DataFrame, value: str, order: Sequence[str], group: Sequence[str], name: str = "before") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each row by ``order`` in its ``group`` (0 for the first).

    Rows are range-partitioned by (group, order), so a large group spreads over many partitions; each adds up its own part, and the sums of the parts before
    it (partitions x groups rows, broadcast) are put on top. Pass narrow rows: they are staged. Null groups are a group.
    """
    ranged = staged(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.sum(value).over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(offsets), same).withColumn(name, F.col("_offset") + F.coalesce(inside, F.lit(0))).select(*df.columns, name)
