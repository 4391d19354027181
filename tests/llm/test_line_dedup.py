import random

import pytest
from pyspark.sql import functions as F

import evalloom.llm.line_dedup as line_module
from evalloom.llm.line_dedup import drop_similar_lines, line_dedup, parity

SCHEMA = "doc_id long, text string, pos string, row int, line string, _gone int, gone int, held int"


def brute(rows, percent=80):
    """Removed places of every row: an earlier equal or similar line, other rows with the same id and text apart."""
    lines = []
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines += [(i, t, p, frozenset(x.lower().split())) for p, x in enumerate((t or "").split("\n"))]
    gone, seen = {}, []
    for i, t, p, k in lines:
        if k and any(len(k & o) * (100 + percent) >= percent * (len(k) + len(o)) for o in seen):
            gone.setdefault((i, t), []).append(p)
        if k:
            seen.append(k)
    return {(i, t or ""): gone.get((i, t or ""), []) for i, t in rows}


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "The", "of"] * 40
    hot = random.choices(vocabulary, k=40)
    out = []
    for i in range(150):
        lines = [" ".join(random.choices(vocabulary, k=random.randrange(1, 25))) for _ in range(random.randrange(1, 5))]
        variant = list(hot)
        for _ in range(random.randrange(0, 9)):
            variant[random.randrange(40)] = random.choice([f"new{random.randrange(9999)}", "the"])
        lines.insert(random.randrange(len(lines) + 1), " ".join(variant))
        if i % 3 == 0:
            lines.append("one very common line")
        out.append((i, "\n".join(lines)))
    out += [(200, None), (201, ""), (202, "\n\n"), (203, "a b c d"), (204, "a b c d e"), (205, "a b c"), (206, "É x\tÉ"), (207, "é X"), (208, "long " + " ".join(f"t{i}" for i in range(30_000)))]
    return [*out, out[3], (None, "x y z w v"), (300, "x y z w v q")]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_matches_brute_force(spark, rows, percent):
    want = brute(rows, percent)
    docs = spark.createDataFrame([(*r, "p", 1, "l", 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    got = sorted(((r.doc_id, r.n_lines, r.n_kept, r.n_removed, r.removed_lines) for r in line_dedup(docs, percent).collect()), key=str)
    expected = []
    for i, t in rows:
        g, n = want[i, t or ""], (t or "").count("\n") + 1
        expected.append((i, n, n - len(g), len(g), ",".join(map(str, g))))
    assert got == sorted(expected, key=str)
    if percent != 80:
        return
    cut = drop_similar_lines(docs)
    assert cut.columns == docs.columns and cut.drop("text").distinct().count() == len({r[0] for r in rows})
    after = sorted(((r.doc_id, r.text) for r in cut.collect()), key=str)
    text = lambda i, t: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i, t])
    assert after == sorted(((i, text(i, t)) for i, t in rows), key=str)


def test_small_sets_and_bad_thresholds(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a b c d")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup(docs, 50).collect()} == {1: 0, 2: 1, 3: 1}
    assert {r.doc_id: r.n_removed for r in line_dedup(docs, 75).collect()} == {1: 0, 2: 0, 3: 1}
    with pytest.raises(ValueError, match="percent"):
        line_dedup(docs, 0)


def test_work_in_a_hot_group_is_linear(spark, monkeypatch):
    """Five times as many near copies of a line make about five times as many pairs, not twenty-five times."""

    def pairs(copies):
        rng, made = random.Random(5), []
        base = [f"b{i}" for i in range(40)]
        rows = [(0, " ".join(base))]
        for i in range(1, copies):
            line = list(base)
            for _ in range(rng.randrange(1, 5)):
                line[rng.randrange(40)] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(line)))
        original = line_module.staged
        monkeypatch.setattr(line_module, "staged", lambda df, name: (made.append((name, original(df, name))), made[-1][1])[1])
        line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count()
        monkeypatch.setattr(line_module, "staged", original)
        return sum(df.count() for name, df in made if name in ("line-pairs", "line-meetings"))

    few, many = pairs(200), pairs(1000)
    assert many <= 6 * few


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "p", 1, "l", 2, 3, 4)], SCHEMA).where(F.lit(False))
    assert line_dedup(docs).collect() == [] and drop_similar_lines(docs).collect() == []


def test_parity_looks_its_bits_up(spark):
    """Each word flips one of 128 bits, read from an array instead of shifted for every word; sets differ in as many words at least as in bits."""
    random.seed(3)
    sets = [[], [0], [63], [64], [127], [-1], [5, 5 + 128], *([random.randrange(-(1 << 63), 1 << 63) for _ in range(random.randrange(1, 60))] for _ in range(20))]
    df = spark.createDataFrame([(x,) for x in sets], "codes array<long>").select("codes", *[c.alias(n) for c, n in zip(parity(F.col("codes")), ("even", "odd"), strict=True)])
    for r in df.collect():
        want = [0, 0]
        for c in r.codes:
            want[c >> 6 & 1] ^= 1 << (c & 63)
        assert (r.even % (1 << 64), r.odd % (1 << 64)) == (want[1], want[0])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "shift" not in plan.lower()


def test_words_of_equal_lines_are_split_once(spark, monkeypatch):
    """Equal lines become one class before their words are split, no text is split a second time for a filter, and equal sets in other lines are found."""
    plans, original = {}, line_module.staged
    monkeypatch.setattr(line_module, "staged", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), original(df, name))[1])
    docs = spark.createDataFrame([(i, f"the same line\nalone{i} x{i}") for i in range(30)] + [(30, "line  THE same same\n \nalone")], "doc_id long, text string")
    got = {r.doc_id: r.removed_lines for r in line_dedup(docs).collect()}
    assert got == {0: ""} | {i: "0" for i in range(1, 31)}
    assert all("size(split(" not in plan for plan in plans.values())
    tables = [plan for plan in plans.values() if "lower(line" in plan and "Generate" in plan]
    assert tables and all(0 <= plan.find("lower(line") < plan.find("Aggregate") for plan in tables)
