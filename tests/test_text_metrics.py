"""N-gram counts against plain counters, several references, resampled corpus metrics, user aggregates."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import hooks
from evalloom.operators import metrics as m
from evalloom.operators import text_metrics as x


def grams(units, n):
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def texts(rng, n, words=("ab", "abc", "b", "é", "zz\t", "\x1c", "😀", "")):
    return [" ".join(rng.choices(words, k=rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("rows", [1, 7, 600])
def test_bleu_counts_with_several_references(rows):
    rng = random.Random(rows)
    preds, refs = texts(rng, rows), [texts(rng, rng.randrange(4)) for _ in range(rows)]
    got = x.bleu_counts(preds, refs)
    for i in range(rows):
        p, own = x._WORD.findall(preds[i]), [x._WORD.findall(r) for r in refs[i]]
        for n in range(1, 5):
            most = Counter()
            for r in own:
                most |= grams(r, n)
            assert got[i, 2 * n - 2] == (grams(p, n) & most).total() and got[i, 2 * n - 1] == max(0, len(p) - n + 1)
        near = min((abs(len(r) - len(p)), len(r)) for r in own)[1] if own else 0
        assert got[i, -2:].tolist() == [len(p), near]


@pytest.mark.parametrize("rows", [1, 5, 400])
def test_chrf_counts_with_several_references(rows):
    rng = random.Random(rows)
    preds, refs = texts(rng, rows), [texts(rng, rng.randrange(3)) for _ in range(rows)]
    got = x.chrf_counts(preds, refs)

    def plain(p, r):
        out = []
        for n in range(1, 7):
            a, b = grams("".join(p.split()), n), grams("".join(r.split()), n)
            out += [(a & b).total(), a.total(), b.total()]
        return out

    def score(c):
        used = [(a / b, a / d) for a, b, d in zip(c[::3], c[1::3], c[2::3], strict=True) if b and d]
        p, r = (sum(v) / len(used) for v in zip(*used, strict=True)) if used else (0, 0)
        return 5 * p * r / (4 * p + r) if p + r else 0.0

    for i in range(rows):
        tables = [plain(preds[i], r) for r in refs[i]]
        want = max(tables, key=score) if tables else [v if k % 3 == 1 else 0 for k, v in enumerate(plain(preds[i], ""))]
        assert score(got[i].tolist()) == pytest.approx(score(want)) and (len(tables) > 1 or got[i].tolist() == want)
    assert x.chrf_scores(got) == pytest.approx([score(c) for c in got.tolist()])


def test_clipped_counts_of_many_rows_and_sides():
    rng = np.random.default_rng(1)
    row, side, gram = rng.integers(0, 900, 40_000), rng.integers(0, 5, 40_000), x.mixed(rng.integers(0, 3, 40_000).astype(np.uint64))
    counts = Counter(zip(row.tolist(), gram.tolist(), side.tolist(), strict=True))
    want = np.zeros(900, int)
    for r, g in {(r, g) for r, g, _ in counts}:
        want[r] += min(counts[r, g, 0], max(counts[r, g, s] for s in range(1, 5)))
    assert x.clipped(row, side, gram, 900).tolist() == want.tolist()
    assert x.clipped(row[:0], side[:0], gram[:0], 3).tolist() == [0, 0, 0]


def test_references_as_texts_or_arrays(spark):
    rows = spark.createDataFrame([("t", "a b c d e", "a b c d e", ["x", "a b c d e", None]), ("t", None, None, None), ("t", "a b x d", "a b c d", ["a b c d", "b x d e"])], "task string, pred string, one string, many array<string>")
    single, several = (x.bleu(rows, "pred", c, ["task"], order=2).first().bleu for c in ("one", "many"))
    assert single == pytest.approx(math.sqrt(8 / 9 * 5 / 7)) and several == pytest.approx(math.sqrt(9 / 9 * 7 / 7))
    assert x.chrf(rows, "pred", "many", ["task"]).first().chrf > x.chrf(rows, "pred", "one", ["task"]).first().chrf
    assert x.ter(rows, "pred", "many", ["task"]).first().ter == pytest.approx(1 / ((1 + 5 + 0) / 3 + 4))


def weights_of(spark, rows, replicates, seed=42):
    keys = [r.k for r in rows.select(F.xxhash64("doc_id").alias("k"), "doc_id").orderBy("doc_id").collect()]
    return m.poisson_weights(np.array(keys).astype(np.uint64), replicates, seed)


def test_macro_f1_equals_a_plain_bootstrap_with_the_same_weights(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["s", None]), rng.choice("abc"), rng.choice("abcd") if i % 9 else None) for i in range(240)]
    rows = spark.createDataFrame(data, "doc_id long, task string, gold string, pred string")
    got = {r.task: (r.stderr, r.n) for r in m.bootstrap_macro_f1(rows.repartition(5), ["task"], replicates=50).collect()}
    w = weights_of(spark, rows, 50)
    for task in ("s", None):
        own = [(i, g, p) for i, t, g, p in data if t == task and p is not None]
        values = []
        for b in range(50):
            f1 = []
            for k in "abcd":
                tp, sides = (sum(w[i, b] * v for i, v in parts) for parts in ([(i, g == p == k) for i, g, p in own], [(i, (g == k) + (p == k)) for i, g, p in own]))
                f1 += [2 * tp / sides] if sides else []
            values.append(sum(f1) / len(f1))
        assert got[task] == (pytest.approx(np.std(values)), len(own))


def test_corpus_bleu_equals_a_plain_bootstrap_with_the_same_weights(spark):
    rng = random.Random(5)
    data = [(i, "t", " ".join(rng.choices("abcd", k=12)), " ".join(rng.choices("abcd", k=11))) for i in range(80)]
    rows = spark.createDataFrame(data, "doc_id long, task string, pred string, ref string")
    got = x.bootstrap_bleu(rows.repartition(3), "pred", "ref", ["task"], order=2, replicates=40).first()
    counts, w = x.bleu_counts([d[2] for d in data], [[d[3]] for d in data], 2), weights_of(spark, rows, 40)
    sums = w.T @ counts
    values = [math.exp((math.log(s[0] / s[1]) + math.log(s[2] / s[3])) / 2 + min(0, 1 - s[5] / s[4])) for s in sums.tolist()]
    assert (got.stderr, got.n) == (pytest.approx(np.std(values)), 80)


def test_replicates_without_groups_and_with_many(spark):
    rows = spark.createDataFrame([(i, i % 40, float(i)) for i in range(400)], "doc_id long, g long, v double")
    state = {"w": F.lit(1), "wx": F.col("v")}
    mean = F.col("wx") / F.nullif(F.col("w"), F.lit(0.0))
    assert m.bootstrap(rows, [], state, mean, replicates=30).first().n == 400
    one = sorted(map(tuple, m.bootstrap(rows, ["g"], state, mean, replicates=30).collect()))
    held, m.HELD = m.HELD, 200
    try:
        two = sorted(map(tuple, m.bootstrap(rows.repartition(7), ["g"], state, mean, replicates=30).collect()))
    finally:
        m.HELD = held
    assert [r[0] for r in one] == list(range(40)) and np.allclose(np.array(one), np.array(two))


class Middle:
    """Median of the means of blocks, with a check that no state sees many rows at once."""

    @staticmethod
    def update(state, rows):
        for b, v in zip(rows["block"], rows["value"], strict=True):
            if v == v and v is not None:
                s, n = state.get(b, (0.0, 0))
                state[b] = (s + v, n + 1)
        return state

    @staticmethod
    def merge(a, b):
        return {k: (a.get(k, (0, 0))[0] + b.get(k, (0, 0))[0], a.get(k, (0, 0))[1] + b.get(k, (0, 0))[1]) for k in {*a, *b}}

    @staticmethod
    def finish(state):
        return float(np.median([s / n for s, n in state.values()])) if state else None


@pytest.mark.parametrize("fan_in", [2, 32])
def test_user_aggregates_are_merged_in_a_tree(spark, fan_in):
    rng = random.Random(6)
    data = [(rng.choice(["a", "a", "a", None, "b"]), i % 3, i % 5, float(rng.randrange(100)) if i % 11 else None) for i in range(3000)] + [("only nulls", 1, 1, None)]
    rows = spark.createDataFrame(data, "task string, part int, block int, value double").repartition(9)
    aggregate = hooks.Aggregate(("block", "value"), dict, Middle.update, Middle.merge, Middle.finish)
    got = {(r.task, r.part): r.value for r in hooks.merged(rows, aggregate, ["task", "part"], fan_in).collect()}
    want = {}
    for task, part, block, value in data:
        blocks = want.setdefault((task, part), {})
        if value is not None:
            blocks.setdefault(block, []).append(value)
    assert got == {k: pytest.approx(np.median([np.mean(v) for v in b.values()])) if b else None for k, b in want.items()}
    states = hooks.partial_states(rows, aggregate, ["task", "part"])
    assert states.groupBy("key").count().agg(F.max("count")).first()[0] <= 9  # a state for each task, not for each row


def test_aggregates_beside_metrics(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), (None, 1, 7.0)], "task string, block int, value double")
    hooks.register_aggregate("middle_value", hooks.Aggregate(("block", "value"), dict, Middle.update, Middle.merge, Middle.finish))
    hooks.register_metric("most", lambda df: F.col("value"), F.max)
    out = hooks.evaluate(rows, ["middle_value", "most"], ["task"])
    assert out.columns == ["task", "middle_value", "most"] and {r.task: (r.middle_value, r.most) for r in out.collect()} == {"a": (3.0, 4.0), None: (7.0, 7.0)}
    assert hooks.evaluate(rows, ["most", "middle_value"], []).first().asDict() == {"most": 7.0, "middle_value": pytest.approx(np.median([4.5, 4.0]))}
    assert hooks.evaluate(rows.limit(0), ["middle_value"], ["task"]).collect() == []


def distance(a, b):
    """Edit distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (w != y))
    return row[-1]


def test_edit_tables():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(80))] for _ in "ab")
        table = x.Table(a, b)
        for i in {0, len(a), rng.randrange(len(a) + 1)}:
            assert table.distances(table.at(i), i).tolist() == [distance(a[:i], b[:j]) for j in range(len(b) + 1)]
        assert x.edits(a, b) == distance(a, b)
        same = rng.randrange(len(a) + 1)
        other = a[:same] + [rng.randrange(3) for _ in range(rng.randrange(40))]
        table.change(other, same)
        assert table.kept == x.Table(other, b).kept


def loose(a, b):
    """Words that a longest common subsequence leaves, by the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out_a, out_b, i, j = [True] * len(a), [True] * len(b), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out_a[i] = out_b[j] = False
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out_a, out_b


def plain_ter(words, target, reach=50):
    """Greedy shifts, each tried with a whole edit table."""
    moves, cost = 0, distance(words, target)
    while cost > 1:
        best, (out_a, out_b) = None, loose(words, target)
        for n in range(min(10, len(words)), 0, -1):
            for i in range(len(words) - n + 1):
                for at in range(len(target) - n + 1):
                    if at != i and abs(at - i) <= reach and target[at : at + n] == words[i : i + n] and any(out_a[i : i + n]) and any(out_b[at : at + n]):
                        rest = words[:i] + words[i + n :]
                        moved = rest[:at] + words[i : i + n] + rest[at:]
                        saved = cost - distance(moved, target)
                        if saved > 1 and (best is None or saved > best[0]):
                            best = (saved, moved)
        if best is None:
            break
        moves, cost, words = moves + 1, cost - best[0], best[1]
    return [float(moves + cost), float(len(target))]


def moved(rng, b, times, reach):
    a = list(b)
    for _ in range(times):
        if len(a) > 4:
            i, n = rng.randrange(len(a) - 3), rng.randrange(1, 4)
            run = a[i : i + n]
            del a[i : i + n]
            at = min(len(a), max(0, i + rng.randrange(-reach, reach + 1)))
            a[at:at] = run
    return a


def test_shifts_equal_whole_tables():
    rng = random.Random(2)
    for _ in range(250):
        b = [rng.choice("abcdefgh"[: rng.choice([2, 4, 8])]) for _ in range(rng.randrange(16))]
        a = moved(rng, b, rng.randrange(4), 12)
        for _ in range(rng.randrange(3) if a else 0):
            a[rng.randrange(len(a))] = rng.choice("abz")
        out = x.aligned(a, b)
        assert tuple(map(list, out)) == loose(a, b)
        assert x.ter_counts(" ".join(a), " ".join(b)) == plain_ter(a, b)


def test_long_pairs_and_limited_tries():
    rng = random.Random(3)
    b = [f"w{rng.randrange(2000)}" for _ in range(6000)]
    a = moved(rng, b, 8, 40)
    began = time.monotonic()
    cost = x.ter_counts(" ".join(a), " ".join(b))[0]
    assert 0 < cost <= 16 and time.monotonic() - began < 60
    assert x.ter_counts(" ".join(a), " ".join(b), max_tries=0)[0] >= cost
    words = [f"u{i}" for i in range(200)]
    assert x.ter_counts(" ".join([*words, "b", "a"]), "a b")[1] == 2.0 and x.ter_counts("a b", " ".join([*words, "b", "a"])) == [201.0, 202.0]
    same = "a " * 3000
    assert x.ter_counts(same, same + "b") == [1.0, 3001.0] and x.ter_counts("", "a b") == [2.0, 2.0] and x.ter_counts("a", "") == [1.0, 0.0]
    assert x.ter_counts("b " + same, same + "b", max_tries=50)[0] <= 2


def test_no_shift_is_tried_that_cannot_save_edits(monkeypatch):
    monkeypatch.setattr(x, "aligned", lambda a, b: pytest.fail("a shift was looked for"))
    a = [f"w{i % 7}" if i % 5 else "the" for i in range(400)]
    b = ["a" if w == "the" and i % 2 else w for i, w in enumerate(a)]
    assert x.ter_counts(" ".join(a), " ".join(b)) == [40.0, 400.0]
    assert x.ter_counts(" ".join(a), " ".join(w for w in b if w != "the")) == [80.0, 360.0]


def test_measured_rows_are_cut_by_rows_and_characters(spark, monkeypatch):
    rows = [(0, None, ["a"]), (1, "a b", None), (2, "x" * 90, ["y" * 90, None]), (3, "", []), *[(i, "é" * (i % 9), ["b"] * (i % 3)) for i in range(4, 300)]]
    df = spark.createDataFrame(rows, "i int, p string, r array<string>").coalesce(1)
    told = lambda p, r: np.array([[len(p), sum(map(len, p)) + sum(len(t) for own in r for t in own), len(a), len(own)] for a, own in zip(p, r, strict=True)], float)
    got = {r.i: r.v for r in df.select("i", x.measured(told, F.col("p"), F.col("r")).alias("v")).collect()}
    assert [v[2:] for _, v in sorted(got.items())] == [[len(p or ""), len(r or [])] for _, p, r in rows]
    assert max(v[0] for v in got.values()) == x.ROWS
    long = df.where("i < 2").select("i", F.lit("z" * x.UNITS).alias("p"), "r")
    assert [r.v[0] for r in long.select(x.measured(told, F.col("p"), F.col("r")).alias("v")).collect()] == [1, 1]
    assert df.where("i < 0").select(x.measured(told, F.col("p"), F.col("r")).alias("v")).collect() == []


def test_equal_texts_and_units_stay_in_a_cache():
    rng = random.Random(9)
    preds, refs = texts(rng, 60), [texts(rng, 2) for _ in range(60)]
    refs = [[p, *own] if i % 3 else [*own, p] for i, (p, own) in enumerate(zip(preds, refs, strict=True))]
    got = x.chrf_counts(preds, refs)
    want = [["".join(p.split()), *(len("".join(p.split())) - n for n in range(6))] for p in preds]
    assert [[max(0, c) for c in w[1:]] for w in want] == got[:, ::3].tolist() == got[:, 1::3].tolist() and x.UNITS <= 1 << 16
