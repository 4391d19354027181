import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from evalloom.llm.packing import optimal_boundaries, pack

SCHEMA = "doc_id long, text string, bucket string, place long, tie long"


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= x) - x for x in lengths)


def test_boundaries_are_optimal():
    random.seed(1)
    for _ in range(40):
        lengths = [random.randrange(0, 30) for _ in range(random.randrange(1, 40))]
        k = random.randrange(1, 6)
        tops, counts = np.unique(lengths, return_counts=True)
        ends = optimal_boundaries(tops, counts, k)
        best = min(padding(lengths, [*c, max(lengths)]) for n in range(k) for c in combinations(sorted(set(lengths)), n))
        assert len(ends) <= k and ends[-1] == max(lengths) and padding(lengths, ends) == best
    assert optimal_boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


def test_long_lengths_are_exact_too():
    """Every pair of cuts tried, over lengths up to 20,000."""
    rng = np.random.default_rng(3)
    tops = np.sort(rng.choice(20_000, 120, replace=False)) + 1
    counts = rng.integers(1, 50, 120)
    lengths = np.repeat(tops, counts)
    cost = lambda ends: int((np.array(ends)[np.searchsorted(ends, lengths)] - lengths).sum())
    best = min(cost([int(a), int(b), int(tops[-1])]) for a, b in combinations(tops[:-1], 2))
    assert cost(optimal_boundaries(tops, counts, 3)) == best
    huge = optimal_boundaries(tops, counts.astype(np.int64) * 2**50, 3)
    assert cost(huge) == best


def test_batches_respect_the_budget(spark):
    random.seed(2)
    sizes = [0, 0, 1, 5000, 700] + [random.randrange(0, 90) for _ in range(300)]
    rows = [(i, "\x0b ".join(["w"] * n) if n else random.choice([None, "", "  "]), "b", 1, 2) for i, n in enumerate(sizes)]
    rows += [(3, "w", "b", 1, 2), (3, "w", "b", 1, 2), (None, "w w", "b", 1, 2)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), buckets=4, token_budget=200).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_tokens) for r in got if r.doc_id is not None) == sorted([*enumerate(sizes), (3, 1), (3, 1)])
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_length - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for members in batches.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].bucket_length <= 200
    for b in {k[0] for k in batches}:
        full = max(200 // max(1, next(r.bucket_length for r in got if r.bucket == b)), 1)
        counts = [len(batches[b, i]) for i in range(len([k for k in batches if k[0] == b]))]
        assert all(c == full for c in counts[:-1])
    ends = sorted({r.bucket_length for r in got})
    lengths = [r.n_tokens for r in got]
    assert sum(r.padding for r in got) == padding(lengths, ends)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([(1, "a", "b", 1, 1)], SCHEMA).where(F.lit(False))).collect() == []
