"""Vector codes against plain Lloyd rounds on integers, where vectors are awkward, and what moves between owners."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from evalloom.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes as loops: assign every part, then average, round by round."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array([math.floor(4096 * x) for x in r[1]], np.int32).tobytes()))
    cut = [[[math.floor(4096 * float(x)) for x in r[1][len(r[1]) // parts * p : len(r[1]) // parts * (p + 1)]] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                if k in own:
                    members = [c[p] for c, o in zip(cut, own, strict=True) if o == k]
                    books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for r, x in zip(kept, errors, strict=True):
        labels[r[2]] += x
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), x, labels[r[2]], sha) for r, f, x in zip(kept, found, errors, strict=True)), key=str)


def result(rows):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in rows.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 16))
    rows = [(i, (centres[i * i % 9] + rng.normal(size=16) * 0.3).astype(np.float32).tolist(), [None, 1, 2][i % 3], "x") for i in range(300)]
    rows += [(1000 + i, rows[5][1], 7, "x") for i in range(150)]  # a third of all rows are one vector
    rows += [(2000, None, 1, "x"), (2001, [1.0] * 15 + [None], 1, "x"), (2002, [float("nan")] + [0.0] * 15, 1, "x"), (2003, [float("-inf")] * 16, 1, "x"), (2004, [], 1, "x")]
    rows += [rows[3], rows[3], (None, [0.5] * 16, None, "x"), (5, rows[7][1], 2, "x")]  # repeated rows, a null and a repeated identifier
    assert result(v.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i), -0.5, 0.25, 1e-9], None, "x") for i in range(3)]
    assert result(v.vector_codes(spark.createDataFrame(rows, SCHEMA), parts=2)) == plain(rows, parts=2)
    assert v.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert v.vector_codes(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vectors_of_other_lengths_are_left_out_and_huge_components_bounded(spark):
    rows = [(1, [0.0] * 8, 1, "x"), (2, [0.0] * 16, 1, "x"), (3, [3e38] * 8, 1, "x"), (4, [0.5] * 7, 1, "x")]
    found = {r.vec_id: r.error for r in v.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == {1, 3} and all(x >= 0 for x in found.values())


def test_ties_go_to_the_lower_entry():
    books = np.array([[[0], [2], [2]]], np.int64)
    entry, error = v.nearest(np.array([[1], [2], [3]], np.int64), np.zeros(3, np.int64), books)
    assert entry.tolist() == [0, 1, 1] and error.tolist() == [1, 0, 1]


def test_only_parts_that_change_entry_migrate(spark):
    rng = np.random.default_rng(3)
    x = np.clip(rng.normal(size=(400, 8)) * 4096, -9e6, 9e6).astype(np.int32)
    kept = spark.createDataFrame([(i, x[i].tobytes()) for i in range(400)], "row long, x binary")
    first = x[:4].astype(np.int64).reshape(4, 2, 4).transpose(1, 0, 2)
    parts = [(i, p, x[i].astype(np.int64)[4 * p : 4 * p + 4]) for i in range(400) for p in range(2)]
    codes, books = v.lloyd(kept, first, 4)
    near = lambda part, book: v.nearest(part[2][None], np.array([part[1]]), book)[0][0]
    entries = [[near(part, b) for part in parts] for b in books]
    resident = codes._jdf.queryExecution().analyzed().toString()
    assert resident.count("Relation") == 4  # the first owners, and one file set for each further round
    final = {(r.row, r.part): r.entry for r in codes.collect()}
    assert final == {(i, p): e for (i, p, _), e in zip(parts, entries[-1], strict=True)}
    moved = [sum(a != b for a, b in zip(*pair, strict=True)) for pair in zip(entries[:4], entries[1:4], strict=False)]
    where = [f for f in codes.inputFiles() if "owned" in f]
    assert spark.read.parquet(*{f.rsplit("/", 1)[0] for f in where}).count() == len(parts) + sum(moved)


def test_label_errors_beyond_the_broadcast(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 5 else None, [i % 7], i) for i in range(200)], "vec_id long, label int, codes array<long>, error long")
    one, two = (sorted((r.vec_id, r.label_error) for r in v.with_label_error(rows, most).collect()) for most in (1000, 1))
    assert one == two and len(one) == 200


def test_owners_of_a_large_entry_are_many(spark):
    rows = spark.range(1000).selectExpr("id AS row", "0L AS part", "0L AS entry", "X'00000000' AS x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would share a file
    try:
        owned = v.owned(rows, 16, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [spark.read.parquet(f).count() for f in owned.inputFiles()]
    assert sum(sizes) == 1000 and len(sizes) == 4 and max(sizes) < 600
