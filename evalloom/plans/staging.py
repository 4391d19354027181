"""Cutting lineage with tables in the cluster's shared folder.

Multi-pass operators write what several later passes read as Parquet into the folder named by
``spark.checkpoint.dir`` and read it back. An executor that dies later costs only its running tasks:
no pass depends on blocks kept by one machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting for deleting a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Temporary folders of applications in one process that name no shared folder.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    Reads ``spark.checkpoint.dir``. Where it is unset and Spark runs in one process (tests), a temporary
    folder takes its place for this session; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="evalloom-")
        found = _LOCAL[context.applicationId]
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/evalloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside have their shuffle files deleted as soon as they end.

    Otherwise the files of every finished pass fill the executors' disks until the driver happens to collect its garbage. Only
    queries that are run once belong inside; the session's own value is put back.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out again in turn if it has fewer partitions than the cluster has cores; for work that costs much more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back from there; the shuffle files of the write are gone then. ``options`` are of the writer."""
    path = fresh_path(df.sparkSession, name)
    with releasing(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
