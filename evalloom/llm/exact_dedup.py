"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes one run: its rows' SHA-256 digests in order, equal ones merged, written to the shared folder. In each
round ``fan_in`` runs are merged into one by a heap over their files, which are sorted already, so nothing is shuffled or sorted
again. A merged run is cut by ranges of the digest into as many slices as runs went into it, and a task merges one slice: it reads
that range from every run, and row-group statistics spare it the rest of their files. Digests are uniform, so a task holds the same share of rows in
every round and no round gathers a whole run in one place. After the last round one run is left, in slices.

Copies merge inside their partition before the first exchange and again in every round, so a text with a
third of all rows crosses the network as one row a run. A task holds a few thousand rows of each of its files. Rounds are written
by Spark's own writer, so a task that is run again changes nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import text_of
from evalloom.llm.warc import open_store
from evalloom.plans.staging import staged

RUN_SCHEMA = "digest binary, size long, check long, keep_id long, n long, run long, slice long"
KEY = ["digest", "size", "check"]
#: Most tasks of a round; each has several slices beyond that.
MOST_TASKS = 20_000
#: Rows that a task reads from a run at a time, and the bytes of a run file's row groups.
BATCH, ROW_GROUP = 4096, 8 << 20
_ARROW = pa.schema([("digest", pa.binary()), *((c, pa.int64()) for c in ("size", "check", "keep_id", "n", "run", "slice"))])

Row = tuple[bytes, int, int, int | None, int]


def combined(rows: Iterable[Row]) -> Iterator[Row]:
    """Sorted rows (digest, size, check, keep_id, n) with those of one text made one.

    The digest names a text; its size and an independent 64-bit hash verify it. Rows that differ in one of
    them are never merged. The largest identifier and the sum of counts stay.
    """
    for key, same in groupby(rows, itemgetter(0, 1, 2)):
        keep_id, n = None, 0
        for row in same:
            n += row[4]
            if row[3] is not None and (keep_id is None or row[3] > keep_id):
                keep_id = row[3]
        yield (*key, keep_id, n)


def rows_of(batch: pa.RecordBatch) -> Iterator[Row]:
    return zip(*(batch.column(c).to_pylist() for c in (*KEY, "keep_id", "n")), strict=True)


def batches_of(rows: Iterable[Row], run: int, part: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append((*row, run, part))
        if len(held) == BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def first_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's rows, sorted by run and key, as runs of slice 0."""
    rows = ((r, *row) for batch in batches for r, row in zip(batch.column("run").to_pylist(), rows_of(batch), strict=True))
    for run, part in groupby(rows, itemgetter(0)):
        yield from batches_of(combined(row[1:] for row in part), run, 0)


def slice_start(part: int, slices: int) -> bytes:
    """The smallest digest of a slice, cut to eight bytes; past the last slice it is larger than any digest."""
    return b"\xff" * 33 if part == slices else ((part << 64) // slices).to_bytes(8, "big")


def sorted_rows(path: str, run: int, low: bytes, high: bytes) -> Iterator[Row]:
    """The rows of a run in one file whose digest is at least ``low`` and below ``high``, in order."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as source, pq.ParquetFile(source, pre_buffer=False) as file:
        groups = []
        for g in range(file.metadata.num_row_groups):
            columns = {c.path_in_schema: c.statistics for c in map(file.metadata.row_group(g).column, range(file.metadata.num_columns))}
            runs, keys = columns["run"], columns["digest"]
            far = runs is not None and runs.has_min_max and not runs.min <= run <= runs.max
            apart = runs is not None and runs.has_min_max and runs.min == runs.max and keys is not None and keys.has_min_max and (keys.max < low or keys.min >= high)
            if not (far or apart):
                groups.append(g)
        for batch in file.iter_batches(BATCH, row_groups=groups, columns=[f.name for f in _ARROW]):
            for r, row in zip(batch.column("run").to_pylist(), rows_of(batch), strict=True):
                if r == run and low <= row[0] < high:
                    yield row


def merge_round(slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges, for every row (run, slice, files: path and run) of a plan, the slice's range of these runs."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                low, high = slice_start(job["slice"], slices), slice_start(job["slice"] + 1, slices)
                parts = [sorted_rows(f["path"], f["run"], low, high) for f in job["files"]]
                yield from batches_of(combined(heapq.merge(*parts, key=itemgetter(0, 1, 2))), job["run"], job["slice"])

    return merge


def digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    body = text_of(text_column)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("size"), F.xxhash64(body).alias("check")
    )


def merged_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per distinct text: digest, size, check, keep_id (largest identifier), n (rows)."""
    rows = digests(docs, id_column, text_column)
    sorted_parts = rows.select(*KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.spark_partition_id().cast("long").alias("run")).sortWithinPartitions("run", *KEY)
    level = _written(sorted_parts.mapInArrow(first_run, RUN_SCHEMA))
    runs = (level.agg(F.max("run")).first()[0] or 0) + 1  # as they were written, whatever plan made them
    slices = 1
    while runs > 1:
        slices, runs = slices * fan_in, -(-runs // fan_in)
        files = level.select(F.struct(F.col("_metadata.file_path").alias("path"), "run").alias("file"), F.col("slice").alias("of")).distinct()
        jobs = files.select(F.floor(F.col("file.run") / fan_in).alias("run"), F.explode(F.sequence(F.col("of") * fan_in, F.col("of") * fan_in + fan_in - 1)).alias("slice"), "file")
        plan = jobs.groupBy("run", "slice").agg(F.collect_list("file").alias("files"))  # fan_in files at most
        level = _written(plan.repartition(min(runs * slices, MOST_TASKS), "run", "slice").sortWithinPartitions("run", "slice").mapInArrow(merge_round(slices), RUN_SCHEMA))
    return level.drop("run", "slice")


def _written(level: DataFrame) -> DataFrame:
    return staged(level, "digest-runs", **{"parquet.block.size": str(ROW_GROUP)})


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty. Of equal texts the row with the
    largest identifier stays. A null identifier is smaller than any other; a group of null identifiers
    alone keeps them. Rows that repeat the kept identifier with the same text are all marked kept. An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    kept = merged_digests(docs, id_column, text_column, fan_in)
    return (
        digests(docs, id_column, text_column)
        .join(kept, KEY)
        .select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )
