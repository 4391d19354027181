import random

import numpy as np
import pytest

from evalloom.llm import quality, queries
from evalloom.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, y string, kept int"


def test_views():
    assert quality.text_view(None).sum() == 0 == quality.text_view("ab").sum()
    assert np.isclose((quality.text_view("some text é") ** 2).sum(), 1)
    long = "abc" * 3_000_000
    assert np.count_nonzero(quality.text_view(long)) <= 3
    assert quality.meta_view(None, None, None).sum() == 3


def test_views_teach_each_other():
    random.seed(1)
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2040)
    a, b = rng.normal(size=(2040, 20)), rng.normal(size=(2040, 20))
    a[:, 0] += 2.5 * (2 * y - 1)
    b[:, 0] += 2.5 * (2 * y - 1)
    few, rest = slice(0, 40), slice(40, 2040)
    model = quality.cotrain((a[few], b[few]), y[few], lambda w: quality.handed_over((a[rest], b[rest]), w, 0.97), rounds=6, ridge=1.0)
    alone = quality.fit_logistic(b[few], y[few], 1.0)
    right = lambda p: ((p > 0.5) == y[rest]).mean()
    assert min(model.exchanged) > 100
    both = right(model.probability(a[rest], b[rest]))
    assert both > 0.95 and both > right(quality.margin(a[rest], quality.fit_logistic(a[few], y[few], 1.0)) + 0.5)
    assert right(quality.margin(b[rest], model.meta) + 0.5) >= right(quality.margin(b[rest], alone) + 0.5)


def test_sums_add_up_and_match_plain_loops():
    rng = np.random.default_rng(2)
    views, w = (rng.normal(size=(60, 3)), rng.normal(size=(60, 2))), [rng.normal(size=4) * 2, rng.normal(size=3) * 2]
    whole = quality.handed_over(views, w, 0.8)
    assert np.allclose(whole, sum(quality.handed_over((views[0][i : i + 7], views[1][i : i + 7]), w, 0.8) for i in range(0, 60, 7)))
    for taker, view in enumerate(quality.taken(whole, [4, 3])):
        for label, (n, g, h) in enumerate(view):
            own = []
            for i in range(60):
                p = 1 / (1 + np.exp(-(views[1 - taker][i] @ w[1 - taker][:-1] + w[1 - taker][-1])))
                if (p if label else 1 - p) >= 0.8:
                    own.append(np.append(views[taker][i], 1))
            q = [1 / (1 + np.exp(-(x @ w[taker]))) for x in own]
            assert n == len(own) > 0
            assert np.allclose(g, sum((c - label) * x for c, x in zip(q, own, strict=True)))
            assert np.allclose(h, sum(c * (1 - c) * np.outer(x, x) for c, x in zip(q, own, strict=True)))


@pytest.fixture(scope="module")
def rows():
    random.seed(6)
    out = []
    for i in range(500):
        words = [random.choice(["alpha", "beta", "gamma", "delta"]) + str(random.randrange(90)) for _ in range(random.randrange(30, 90))]
        text = " ".join(f"{w}###" if i % 4 == 0 and random.random() < 0.5 else w for w in words)
        out.append((i, text, random.choice(["en", None]), f"s{random.randrange(5)}", len(text), "s", "y", 1))
    return out


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, "s", "y", 1), (900, "", "en", "s", 0, "s", "y", 1), (900, "", "en", "s", 0, "s", "y", 1), (901, "alpha1 " * 200_000, "en", "s", 1, "s", "y", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, quality.train(docs, labels)).collect()}
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in range(300, 500)]) > 0.95
    assert got[901].kept and all(0 <= r.score <= 1 for r in got.values()) and None in got
    assert quality.train(docs, labels.limit(0)) is None
    # the exchange over Spark equals the one over all rows in memory, however the rows are dealt out
    views = lambda part: (np.array([quality.text_view(r[1]) for r in part]), np.array([quality.meta_view(*r[2:5]) for r in part]))
    w = [np.full(quality.TEXT_DIMS + 1, 0.3), np.full(quality.META_DIMS + 1, 0.8)]
    want = quality.handed_over(views(rows), w, 0.9)
    for parts in (1, 7):
        some = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert np.allclose(quality.gathered(some, w, 0.9), want)
    assert not quality.gathered(some.limit(0), w, 0.9).any()
    model, again = quality.train(docs, labels), quality.train(docs.repartition(5), labels)
    assert np.allclose(model.text, again.text) and model.exchanged == again.exchanged and max(model.exchanged) > 0
    assert quality.classify(docs.limit(0), None).collect() == []
    assert {r.score for r in quality.classify(docs, None).collect()} == {0.5}


def test_whole_query_matches_one_process(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = {r[0]: quality.text_view(r[1]).astype(np.float32) for r in rows}
    meta = {r[0]: quality.meta_view(*r[2:5]).astype(np.float32) for r in rows}
    learn = [r[0] for r in rows if fold(r[0], 3) != 1]
    views = lambda ids: (np.array([text[i] for i in ids], float), np.array([meta[i] for i in ids], float))
    known = [i for i in learn if i < 240]
    known.sort(key=lambda i: (quality.xxhash.xxh32_intdigest(text[i].tobytes()), text[i].tobytes(), meta[i].tobytes(), int(i % 4 != 0)))
    pool = views([i for i in learn if i >= 240])
    model = quality.cotrain(views(known), np.array([int(i % 4 != 0) for i in known]), lambda w: quality.handed_over(pool, w, 0.97))
    want = model.probability(*views([r[0] for r in rows]))
    got = {r.doc_id: r for r in queries.op8_quality(spark, str(tmp_path)).collect()}
    assert np.allclose([got[r[0]].score for r in rows], want, atol=1e-4)
    assert [got[r[0]].held_out for r in rows] == [fold(r[0], 3) == 1 for r in rows]
