import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evalloom.llm import ppm
from evalloom.llm.common import fold

SCHEMA = "doc_id long, text string, score string, word int"


class Plain:
    """PPM by dictionaries, byte by byte."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            data = bytes([10]) * order + t
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.after[k, data[i - k : i]][data[i]] += 1

    def probability(self, context, byte):
        gone, p = set(), 1.0
        for k in range(self.order, -1, -1):
            seen = self.after.get((k, context[len(context) - k :]))
            if not seen:
                continue
            rest = {b: n for b, n in seen.items() if b not in gone}
            if rest:
                whole = sum(rest.values()) + len(rest)
                if byte in rest:
                    return p * rest[byte] / whole
                p *= len(rest) / whole
            gone |= set(seen)
        return p / (256 - len(gone))

    def log10(self, t):
        data = bytes([10]) * self.order + t
        return sum(math.log10(self.probability(data[i - self.order : i], data[i])) for i in range(self.order, len(data)))


def joined(text):
    return b" ".join(ppm.words(text)) + b"\n"


@pytest.fixture(scope="module")
def rows():
    random.seed(2)
    words = ["Tha", "tho", "éa", "ba", "bab", "x" * 40, "q\x0bz", "  ", "\t"]
    made = [(i, " ".join(random.choices(words, k=random.randrange(0, 30)))) for i in range(120)]
    return made + [(200, None), (201, ""), (202, ""), (202, ""), (None, "tha tho"), (203, "never seen words zz"), (204, "tha " * 20_000)]


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_matches_brute_force(spark, rows, head, monkeypatch):
    monkeypatch.setattr(ppm, "COUNT_PIECE", 500)
    monkeypatch.setattr(ppm, "SCORE_PIECE", 300)
    train = [t for i, t in rows if fold(i, 7) != 2]
    plain = Plain([joined(t) for t in train], 3)
    counts = Counter(w for t in train for w in [*ppm.words(t), b""])
    n, v = sum(counts.values()), len(counts)
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    got = sorted(ppm.score_texts(docs, F.coalesce(crc != 2, F.lit(True)), order=3, head_words=head, head_nodes=20 * head).collect(), key=str)
    assert len(got) == len(rows)
    by_id = {i: t for i, t in rows}
    for r in got:
        tokens = [*ppm.words(by_id[r.doc_id]), b""]
        assert r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r.score == pytest.approx(plain.log10(joined(by_id[r.doc_id])), rel=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("abra cadabra",), ("abc abd",), ("bra",)], "text string")
    trie = ppm.trie_of(ppm.counts(docs, 2), 2)
    contexts = (b"ab", b"zz", b"\n\n", b"ra", b"a ")
    every = spark.createDataFrame([(int.from_bytes(c + bytes([b]), "big"),) for c in contexts for b in range(256)], "code long")
    sums = trie.log10(every).groupBy(F.shiftright("code", 8)).agg(F.sum(F.pow(F.lit(10.0), F.col("log"))).alias("p")).collect()
    assert len(sums) == 5 and all(r.p == pytest.approx(1) for r in sums)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab", "s", 1)], SCHEMA)
    r = ppm.score_texts(docs, F.lit(False)).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score == pytest.approx(-3 * math.log10(256))
    assert ppm.score_texts(docs.limit(0), F.lit(True)).collect() == []


def test_cut_keeps_the_bound(spark):
    df = spark.createDataFrame([(n,) for n in [1, 1, 2, 3, 3, 9000, 10_000, 20_000]], "n long")
    for limit in range(9):
        cut = ppm.count_cut(df, limit)
        assert df.where(F.col("n") >= cut).count() <= limit
    assert ppm.count_cut(df, 8) == 1 and ppm.count_cut(df, 6) == 2
