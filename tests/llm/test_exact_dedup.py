import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from evalloom.llm.exact_dedup import batches_of, combined, exact_dedup, merged_digests, slice_start, sorted_rows

SCHEMA = "doc_id long, text string, digest string, run long, keep_id string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force_over_many_runs(spark):
    random.seed(3)
    big = 2**53 + 1
    rows = [(big + i, random.choice([None, "", "a", "A", "a ", "é", "x" * 200_000, f"t{i % 7}"])) for i in range(300)]
    rows += [(None, "only null"), (None, "a"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, "d", 1, "k") for r in rows], SCHEMA).repartition(11)
    for fan_in in (2, 3, 16):
        got = exact_dedup(docs, fan_in=fan_in).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    shuffled = docs.groupBy("doc_id", "text", "run").count().withColumn("text", F.col("text"))  # an adaptive shuffle makes the runs
    distinct = list(dict.fromkeys(rows))
    assert sorted(map(tuple, exact_dedup(shuffled, fan_in=2).collect()), key=str) == brute(distinct)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_run_is_read_by_ranges_in_order(tmp_path):
    random.seed(5)
    rows = sorted((random.randbytes(32), 1, i, i if i % 5 else None, 1) for i in range(5000))
    path = f"{tmp_path}/runs.parquet"
    batches = [b for run in (0, 1, 4) for b in batches_of(rows, run, 0)]
    pq.write_table(pa.Table.from_batches(batches), path, row_group_size=300)
    for slices in (1, 3, 64):
        edges = [slice_start(i, slices) for i in range(slices + 1)]
        parts = [list(sorted_rows(path, 4, a, b)) for a, b in zip(edges, edges[1:], strict=False)]
        assert [r for part in parts for r in part] == rows and max(map(len, parts)) < 2 * len(rows) / slices + 50
    assert list(sorted_rows(path, 2, b"", b"\xff" * 33)) == []


def test_only_rows_equal_in_everything_merge():
    a = bytes(32)
    rows = [(a, 1, 7, None, 1), (a, 1, 7, 5, 2), (a, 1, 7, None, 1), (a, 1, 8, 3, 1), (a, 2, 8, None, 1)]
    assert list(combined(rows)) == [(a, 1, 7, 5, 4), (a, 1, 8, 3, 1), (a, 2, 8, None, 1)]


def test_a_digest_stands_in_one_row_after_the_last_round(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text")).repartition(20)
    kept = merged_digests(docs, fan_in=3).collect()
    texts = {r.text for r in docs.collect()}
    assert len(kept) == len(texts) == len({bytes(r.digest) for r in kept}) and sum(r.n for r in kept) == 3000 and max(r.n for r in kept) == 1000
