"""Packing documents into token-budget batches with optimal length buckets.

The histogram of all lengths, a row for each different one, goes to the driver; it has no more rows than the longest text has tokens.
Dynamic programming over it finds the bucket boundaries with the least padding (each row padded to its bucket's length). The best
last cut moves on with the length, so each layer is solved by halving: the middle length first, then both sides between its neighbours' cuts. Rows are numbered inside their bucket by global ranks and cut into batches of
as many rows as the token budget holds at that length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import SPACE, text_of
from evalloom.plans.ranking import global_rank
from evalloom.plans.staging import staged


def token_count(text: Column) -> Column:
    """Words between ASCII white space; counted without building a word that is not there."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bucket lengths that minimise padding over different ``lengths`` (ascending) with ``counts`` rows each.

    At most ``buckets`` boundaries, each one of the lengths; the last is the largest length. Ties take the earliest cut.
    """
    n = len(lengths)
    if not n:
        return []
    # whole numbers: float sums of a large corpus would tell near ties apart wrongly
    rows, size = [np.concatenate([[0], np.cumsum(x.astype(object) if float(lengths[-1]) * float(counts.sum()) > 2**62 else x.astype(np.int64))]) for x in (counts, lengths * counts)]
    best = lengths * rows[1:] - size[1:]
    cuts = []
    for _ in range(1, min(buckets, n)):
        held = np.concatenate([[0], best])  # held[i]: the first i lengths are done
        after, cut = np.empty_like(best), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j, last) + 1)
            cost = held[i] + lengths[j] * (rows[j + 1] - rows[i]) - (size[j + 1] - size[i])
            at = int(np.argmin(cost))
            after[j], cut[j] = cost[at], i[at]
            todo += [(lo, j - 1, first, cut[j]), (j + 1, hi, cut[j], last)]
        cuts.append(cut)
        best = after
    out, end = [], n - 1
    for cut in reversed(cuts):
        out.append(int(lengths[end]))
        end = int(cut[end]) - 1
        if end < 0:
            break
    else:
        out.append(int(lengths[end]))
    return sorted(out)


def pack(docs: DataFrame, buckets: int = 8, token_budget: int = 16_384, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket (0 is the shortest), bucket_length, batch, slot, padding.

    A batch holds ``token_budget // bucket_length`` rows, one at least: a text longer than the budget is a batch of its own and
    is neither cut nor dropped. Batches are numbered from 0 in each bucket, rows of a bucket in order of length, then
    identifier (null first), so a batch holds neighbours in length. Null and empty texts have no tokens and are
    packed like others. Boundaries are optimal among all lengths.
    """
    sized = staged(docs.select(F.col(id_column).cast("long").alias("doc_id"), token_count(text_of(text_column)).alias("n_tokens"), F.xxhash64(text_of(text_column)).alias("tie")), "lengths")
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("rows")).orderBy("n_tokens").toPandas()  # a row for each different length
    ends = optimal_boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["rows"].to_numpy(np.int64), buckets)
    bucket, length = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, end in reversed(list(enumerate(ends))):
        bucket, length = F.when(F.col("n_tokens") <= end, F.lit(i)).otherwise(bucket), F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(length)
    placed = global_rank(sized.withColumn("bucket", F.coalesce(bucket, F.lit(0))).withColumn("bucket_length", F.coalesce(length, F.lit(0))), ["n_tokens", "doc_id", "tie"], ["bucket"], name="place")
    held = F.greatest(F.floor(F.lit(token_budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("place") / held).cast("long").alias("batch"), (F.col("place") % held).cast("long").alias("slot"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding")
    )
