"""Hand-worked cases: ties, nulls, empty texts, scripts, single classes, small groups."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from evalloom.functions import hooks
from evalloom.functions import template as t
from evalloom.operators import corpus, metrics, postfilter, prepare, requests, rollup, scores
from evalloom.operators import text_metrics as x
from evalloom.plans.ranking import global_rank, prefix_sums
from evalloom.sources import tables


def one(spark, column, schema=None, row=None):
    df = spark.createDataFrame([row], schema) if schema else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_templates(spark):
    assert one(spark, t.render("a {x} b {y}!"), "x string, y int", (None, 3)) == "a  b 3!"
    assert one(spark, t.strip(F.lit("   a b\n\t"))) == "a b"
    assert one(spark, t.slice_text(F.lit("abcdef"), F.lit(1), F.lit(4))) == "bcd"
    assert one(spark, t.lettered_options(F.array(*map(F.lit, "xyz")))) == "A. x\nB. y\nC. z"
    with pytest.raises(Exception, match="only 4 letters for choices: 5"):
        one(spark, t.lettered_options(F.array(*map(F.lit, "vwxyz"))))
    assert one(spark, t.lettered_options(F.array(*map(F.lit, "vwxyz")), "ABCDE")).endswith("E. z")
    assert one(spark, t.ensure_period(F.lit(" a. "))) == "a." and one(spark, t.ensure_period(F.lit("a"))) == "a."
    tokens = F.array(F.lit("a\nb"), F.lit(" c"))
    assert one(spark, t.squash_tokens(tokens)) == "a b c" and one(spark, t.squash_tokens(tokens, "")) == "ab c"
    with pytest.raises(ValueError):
        t.first_defined(spark.range(1), "nope")


def test_preparation(spark):
    assert one(spark, prepare.label_from_one_based("a"), "a string", ("3",)) == 2
    assert one(spark, prepare.label_from_one_based("a"), "a string", ("x",)) is None
    assert one(spark, prepare.threshold_label("a", "b", 5.5), "a double, b double", (2.5, 3.0)) == 0
    with pytest.raises(Exception, match="no label"):
        one(spark, prepare.map_label("a", {1: "x"}), "a int", (2,))
    text = "a ) 1 , b ) 2 , c ) x, y , d ) 4 , e ) none of these , "
    assert one(spark, prepare.parse_options("o"), "o string", (text,)) == ["1", "2", "x", "4", "none of these"]
    docs = spark.createDataFrame([(i, list("abcd"), i % 4) for i in range(20)], "doc_id long, choices array<string>, gold int")
    rows = prepare.permute_choices(docs, 1).collect()
    assert all(sorted(r.choices) == list("abcd") and r.choices[r.gold] == "abcd"[r.doc_id % 4] for r in rows)
    assert len({tuple(r.choices) for r in rows}) > 3
    wide = spark.createDataFrame([(1, "a", "b", None)], "id long, x string, y string, z string")
    pairs = prepare.parallel_pairs(wide, "id", {"x": "x", "y": "y", "z": "z"})
    assert sorted((r.src, r.tgt) for r in pairs.collect()) == [("x", "y"), ("y", "x")]


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "assistant", "d")], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in prepare.turn_limits(turns, 2, 1).orderBy("turn").collect()] == [0, 1, 2, 3]
    messages = prepare.raw_chat(turns.repartition(3)).first().messages
    assert [m.content for m in messages] == list("sabcd")
    masked = corpus.redact_contacts(spark.createDataFrame([("mail me a.b@c.org or +49 170 1234567, telegram: @some_one",)], "text string")).first()
    assert masked.contacts == 3 and masked.text == "mail me [EMAIL] or [PHONE], [MESSENGER]"


def test_splits_and_limits(spark):
    docs = spark.createDataFrame([("a", "test", 1), ("a", "validation", 2), ("b", "validation", 3), ("b", "train", 4)], "task string, split string, doc_id long")
    assert sorted(r.doc_id for r in tables.eval_split(docs).collect()) == [1, 3]
    assert sorted(r.doc_id for r in tables.eval_split(docs, test=None).collect()) == [2, 3]
    assert tables.eval_split(docs, None, None).count() == 0 == tables.fewshot_split(docs, None).count()
    assert sorted(r.doc_id for r in tables.limit_docs(docs, 1).collect()) == [1, 3]


def test_choices_scores(spark):
    rows = [("m", "t", 1, 0, 1, -1.0, "aa"), ("m", "t", 1, 1, 1, -1.0, "b"), ("m", "t", 2, 0, 1, float("nan"), "a"), ("m", "t", 2, 1, 1, -1.0, "a"), ("m", "t", 3, 0, 0, -2.0, "aaaa"), ("m", "t", 3, 1, 0, -1.5, "")]
    df = spark.createDataFrame(rows, "model string, task string, doc_id long, idx int, gold int, loglik double, choice string")
    got = {r.doc_id: r.value for r in scores.acc(df).collect()}
    assert got == {1: 0.0, 2: None, 3: 0.0}  # ties take the lowest index, NaN gives no score
    assert {r.doc_id: r.value for r in scores.acc_norm(df).collect()} == {1: 0.0, 2: None, 3: 1.0}
    mass = scores.mc2(df.where("doc_id <> 2").withColumn("is_true", F.col("idx") == 1))
    assert {r.doc_id: round(r.value, 6) for r in mass.collect()} == {1: 0.5, 3: round(math.exp(0) / (1 + math.exp(-0.5)), 6)}
    far = df.withColumn("loglik", F.when(F.col("idx") == 0, -5000.0).otherwise(-5001.0)).withColumn("is_true", F.col("idx") == 0)
    assert round(scores.mc2(far).first().value, 6) == round(1 / (1 + math.exp(-1)), 6)


def test_text_scores(spark):
    f1 = lambda a, b: round(one(spark, scores.token_f1(F.lit(a), F.lit(b))), 6)
    assert f1("a a b", "a b b") == round(2 * 2 / 6, 6) and f1("", "") == 1.0 and f1("", "a") == 0.0
    assert one(spark, scores.contains_fraction(F.lit("The CAT"), F.array(F.lit("cat"), F.lit("dog")))) == 0.5
    assert one(spark, scores.per_character(F.lit("你好 a"))) == ["你", "好", "a"]
    assert one(spark, postfilter.stop_at(F.lit("ab\ncd.e"), [".", "\n"])) == "ab" and one(spark, postfilter.stop_at(F.lit("ab"), [])) == "ab"
    assert one(spark, postfilter.normalize_answer(F.lit("The  “Cat”, a dog!"))) == "cat dog"
    assert one(spark, postfilter.normalize_answer(F.lit("L'été la mer"), "fr")) == "lété mer"
    assert one(spark, postfilter.normalize_answer(F.lit("الكتاب، ال"), "ar")) == "كتاب ال" and one(spark, postfilter.normalize_answer(F.lit("những con mèo"), "vi")) == "con mèo"
    assert one(spark, scores.token_f1(F.lit("你好"), F.lit("你们"), scores.per_character)) == 0.5
    assert one(spark, postfilter.extract_choice_letter(F.lit("Answer: (C)."))) == "C" and one(spark, postfilter.extract_choice_letter(F.lit("none"))) is None
    p, r, f = scores.set_f1(F.col("a"), F.col("b"))
    df = spark.createDataFrame([([1, 1, 2], [2, 3]), ([], []), ([], [1])], "a array<int>, b array<int>").select(p.alias("p"), r.alias("r"), f.alias("f"))
    assert sorted(map(tuple, df.collect())) == [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (1.0, 1.0, 1.0)]


def test_class_metrics_on_one_class(spark):
    df = spark.createDataFrame([("t", 1, 1), ("t", 1, 1), ("u", 0, 1), ("u", 1, 0), ("v", None, 1)], "task string, gold int, pred int")
    assert {r.task: r.mcc for r in metrics.mcc(df, ["task"]).collect()} == {"t": 0.0, "u": -1.0}
    assert {r.task: r.macro_f1 for r in metrics.macro_f1(df, ["task"]).collect()} == {"t": 1.0, "u": 0.0}
    assert metrics.mcc(df, []).first().mcc == pytest.approx(-1 / 3)
    assert df.where("task = 'u'").agg(metrics.f1_binary(F.col("gold"), F.col("pred"))).first()[0] == 0.0
    assert spark.range(1).agg(metrics.mean_stderr("id")).first()[0] is None


def test_bootstrap_agrees_with_the_closed_form(spark):
    random.seed(42)
    df = spark.createDataFrame([("t", i, random.random()) for i in range(1000)], "task string, doc_id long, value double")
    closed = df.agg(metrics.mean_stderr("value")).first()[0]
    rows = metrics.bootstrap_stderr(df, ["task"], replicates=100_000).collect()
    assert rows[0].n == 1000 and rows[0].stderr == pytest.approx(closed, abs=1e-4)
    few = [metrics.bootstrap_stderr(df.repartition(n), ["task"], replicates=200).first().stderr for n in (1, 7)]
    assert few[0] == pytest.approx(few[1], rel=1e-9)


def test_corpus_text_metrics(spark):
    rows = spark.createDataFrame([("t", "the cat sat on the mat", "the cat sat on a mat"), ("t", None, "a b"), ("s", "a b c d e", "a b c d e")], "task string, pred string, ref string")
    bleu = {r.task: r.bleu for r in x.bleu(rows, "pred", "ref", ["task"]).collect()}
    want = math.exp(sum(map(math.log, (5 / 6, 3 / 5, 2 / 4, 1 / 3))) / 4 + 1 - 8 / 6)
    assert bleu["s"] == pytest.approx(1) and bleu["t"] == pytest.approx(want)
    assert {r.task: r.chrf for r in x.chrf(rows, "pred", "ref", ["task"]).collect()}["s"] == pytest.approx(1)
    sums = x.chrf_counts(["the cat sat on the mat", ""], [["the cat sat on a mat"], ["a b"]]).sum(0, keepdims=True)
    assert {r.task: r.chrf for r in x.chrf(rows, "pred", "ref", ["task"]).collect()}["t"] == pytest.approx(x.chrf_scores(sums)[0])
    ter = {r.task: r.ter for r in x.ter(rows, "pred", "ref", ["task"]).collect()}
    assert ter == {"s": 0.0, "t": (1 + 2) / 8}
    assert x.ter_counts("c d a b", "a b c d") == [1.0, 4.0]
    assert 0 < x.smoothed_bleu_4(rows.where("task = 's'"), "pred", "ref", ["task"]).first().bleu <= 1


def test_chrf_and_bleu_match_plain_counts(spark):
    """Whole corpora, by list counts and the published formulas."""
    random.seed(9)
    rows = [(random.choice("tu"), " ".join(random.choices(["ab", "abc", "b", "é", "zz\t"], k=random.randrange(12))), " ".join(random.choices(["ab", "abc", "c", "é"], k=random.randrange(12)))) for _ in range(40)]
    df = spark.createDataFrame([*rows, ("t", None, "ab")], "task string, pred string, ref string")
    chrf = {r.task: r.chrf for r in x.chrf(df, "pred", "ref", ["task"]).collect()}
    bleu = {r.task: r.bleu for r in x.bleu(df, "pred", "ref", ["task"]).collect()}
    grams = lambda s, n: [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]
    for task in "tu":
        own = [(p or "", r) for t, p, r in [*rows, ("t", None, "ab")] if t == task]
        sums = {}
        for unit in ("char", "word"):
            for n in range(1, 7):
                pairs = [[grams("".join(s.split()) if unit == "char" else s.split(), n) for s in pair] for pair in own]
                sums[unit, n] = (sum(min(a.count(g), b.count(g)) for a, b in pairs for g in set(a)), sum(len(a) for a, _ in pairs), sum(len(b) for _, b in pairs))
        used = [v for (unit, _), v in sums.items() if unit == "char" and v[1] and v[2]]
        precision, recall = sum(m / a for m, a, _ in used) / len(used), sum(m / b for m, _, b in used) / len(used)
        assert chrf[task] == pytest.approx(5 * precision * recall / (4 * precision + recall))
        words = [sums["word", n] for n in range(1, 5)]
        penalty = min(0.0, 1 - words[0][2] / words[0][1])
        assert bleu[task] == pytest.approx(math.exp(sum(math.log(m / a) for m, a, _ in words) / 4 + penalty) if all(w[0] for w in words) else 0.0)


def test_pass_at_k_and_advantage(spark):
    attempts = spark.createDataFrame([(1, True), (1, False), (1, False), (2, False)], "p long, ok boolean")
    assert {r.p: r.pass_at_k for r in metrics.pass_at_k(attempts, 2, "p", "ok").collect()} == {1: pytest.approx(1 - 1 / 3), 2: None}
    rewards = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "p long, r double")
    assert sorted(round(v.advantage, 6) for v in metrics.group_normalized_advantage(rewards, "p", "r").collect()) == [-0.707107, 0.0, 0.707107]


def test_requests(spark):
    items = spark.createDataFrame([("t", 1, "q1", ["x", "y"], "z"), ("t", 2, "q2", ["x"], "z"), ("u", 3, "q3", [], "z")], "task string, doc_id long, prompt string, choices array<string>, target string")
    reqs = requests.mc_requests(items)
    a = {r.task: r.fingerprint for r in requests.request_fingerprint(reqs).collect()}
    b = {r.task: r.fingerprint for r in requests.request_fingerprint(reqs.repartition(5).orderBy(F.desc("idx"))).collect()}
    changed = reqs.withColumn("context", F.when(F.col("doc_id") == 1, "q1 ").otherwise(F.col("context")))
    assert a == b and a["t"] != requests.request_fingerprint(changed).first().fingerprint
    twin = reqs.unionByName(reqs.withColumn("task", F.lit("v")))
    assert requests.equal_request_sets(requests.request_fingerprint(twin)).first().tasks == ["t", "v"]
    pool = spark.createDataFrame([("t", 1, "e1"), ("t", 2, "e2"), ("t", 5, "e5")], "task string, doc_id long, example string")
    shots = {r.doc_id: r.prompt for r in requests.fewshot_exclude_self(items, pool, 2).collect()}
    assert shots == {1: "e2\n\ne5\n\nq1", 2: "e1\n\ne5\n\nq2", 3: "q3"}
    assert "CartesianProduct" not in requests.fewshot_first_n(items, pool, 2)._jdf.queryExecution().toString()


def test_groups(spark):
    edges = spark.createDataFrame([("top", "g"), ("g", "a"), ("g", "b"), ("g", "b"), ("top", "a"), ("loop", "pool"), ("pool", "loop")], "parent string, child string")
    reach = {(r.parent, r.child): r.depth for r in rollup.expand_groups(edges).collect()}
    assert reach == {("top", "g"): 1, ("g", "a"): 1, ("g", "b"): 1, ("top", "a"): 1, ("top", "b"): 2, ("loop", "pool"): 1, ("pool", "loop"): 1, ("loop", "loop"): 2, ("pool", "pool"): 2}
    results = spark.createDataFrame([("m", "a", "none", "acc", 1.0, 1), ("m", "b", "none", "acc", 0.0, 3)], "model string, task string, filter string, metric string, value double, n long")
    assert {r.group: r.value for r in rollup.group_mean_weighted(results, edges).collect()} == {"g": 0.25, "top": 1.0}
    assert {r.group: r.value for r in rollup.group_mean_unweighted(results, edges, use_leaves=True).collect()} == {"g": 0.5, "top": 0.5}
    filters = results.unionByName(results.withColumn("filter", F.lit("strict")).withColumn("value", F.lit(0.5)))
    assert {(r.group, r.filter): r.value for r in rollup.group_mean_weighted(filters, edges).collect()} == {("g", "none"): 0.25, ("top", "none"): 1.0, ("g", "strict"): 0.5, ("top", "strict"): 0.5}
    ranks = rollup.leaderboard(spark.createDataFrame([("g", "ppl", "a", 2.0), ("g", "ppl", "b", 1.0), ("g", "ppl", "c", None)], "group string, metric string, model string, value double"), ["ppl"])
    assert {r.model: r.rank for r in ranks.collect()} == {"b": 1, "a": 2, "c": 3}


def test_deep_groups_and_cycles(spark):
    chain = [(f"g{i}", f"g{i + 1}") for i in range(40)] + [("g40", "a"), ("x", "y"), ("y", "x"), ("y", "a"), ("over", "x")]
    edges = spark.createDataFrame([*chain, ("short", "g40"), ("short", "b"), ("long", "g40"), ("long", "short")], "parent string, child string")
    reach = {(r.parent, r.child): r.depth for r in rollup.expand_groups(edges).collect()}
    assert reach["g0", "a"] == 41 and reach["x", "x"] == 2 and reach["over", "a"] == 3 and reach["long", "g40"] == 1
    results = spark.createDataFrame([("m", "a", "none", "acc", 1.0, 1), ("m", "b", "none", "acc", 0.0, 1)], "model string, task string, filter string, metric string, value double, n long")
    spec = edges.select(F.col("parent").alias("group"), F.lit("acc").alias("metric"), F.lit(False).alias("weight_by_size"), F.lit(None).cast("array<string>").alias("filters")).distinct()
    got = {r.group: r.value for r in rollup.roll_up(results, edges, spec).collect()}
    assert got == {**{f"g{i}": 1.0 for i in range(41)}, "short": 0.5, "long": 0.75}  # cycles and what stands on them have no value
    assert rollup.roll_up(results, edges.limit(0), spec).collect() == []


def test_overlap_matches_counters(spark):
    random.seed(8)
    rows = [(random.choices("abcde", k=random.randrange(12)), random.choices("abcdf", k=random.randrange(12))) for _ in range(60)] + [([], []), (["x"] * 3000 + list(map(str, range(3000))), ["x"] * 5000)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", scores.overlap(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == (Counter(r.a) & Counter(r.b)).total() for r in df.collect())


def test_bootstrap_weights_are_poisson():
    w = metrics.poisson_weights(np.arange(4000, dtype=np.uint64), 500, 7)
    assert w.mean() == pytest.approx(1, abs=5e-3) and w.var() == pytest.approx(1, abs=1e-2)
    assert [(w == k).mean() for k in range(4)] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=2e-3)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def haystacks_of(docs, bucket, length):
    """By loops: texts of a bucket in order of their ids, as long as one begins before the end."""
    out = {}
    for i, t in sorted(docs):
        held = out.setdefault(bucket(i), [])
        if sum(len(x) + 1 for x in held) < length:
            held.append(t or "")
    return {k: " ".join(v)[:length] for k, v in out.items()}


@pytest.mark.parametrize("length", [1, 7, 1500, 4000])
def test_haystacks_match_loops_and_no_window_spans_a_bucket(spark, length):
    rng = random.Random(length)
    docs = [(i, None if i % 17 == 3 else "ab" * rng.randrange(0, 4 + i % 90)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    made = corpus.haystacks(df, F.col("doc_id") % 3, length)
    assert {r.bucket: r.haystack for r in made.collect()} == haystacks_of(docs, lambda i: i % 3, length)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan
    shuffled = corpus.haystacks(df, F.col("doc_id") % 3, length, max_broadcast=0)
    assert {r.bucket: r.haystack for r in shuffled.collect()} == haystacks_of(docs, lambda i: i % 3, length)


def test_prefix_sums_of_one_large_group_are_made_in_parts(spark):
    df = spark.range(20_000).selectExpr("IF(id % 10 = 0, NULL, 1) AS g", "id", "id % 7 AS v").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = prefix_sums(df, "v", ["id"], ["g"])
        rows = made.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums = Counter()
    for r in sorted(rows, key=lambda r: r.id):
        assert r.before == sums[r.g]
        sums[r.g] += r.v
    assert len(rows) == 20_000 and made.columns == ["g", "id", "v", "before"]


def test_global_rank_is_gapless_and_spread(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id"))
    rows = global_rank(df.repartition(7), ["id"], ["g"], name="k", total="n").collect()
    for g in (0, 1):
        own = sorted((r.id, r.k) for r in rows if r.g == g)
        assert [k for _, k in own] == list(range(len(own))) and {r.n for r in rows if r.g == g} == {len(own)}


def test_user_metric_and_hook(spark):
    hooks.register_metric("mean_len", lambda df: F.length("text"), F.avg)
    df = spark.createDataFrame([("a", "xx"), ("a", "xxxx")], "task string, text string")
    assert hooks.evaluate(df, ["mean_len"], ["task"]).first().mean_len == 3.0
    assert hooks.task_hook(df, lambda d: d.limit(1), lambda d: d.drop("text")).columns == ["task"]


def test_contamination_with_and_without_broadcast(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "Intro " + " ".join(words[:20]) + " tail"), (2, " ".join(words[:12])), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words).upper()), (8, "short")], "item_id long, text string")
    for limit in (0, 100):
        hits = corpus.contamination_hits(docs, items, max_broadcast=limit)
        assert sorted(map(tuple, hits.collect())) == [(1, 7, p) for p in range(1, 9)]
        assert "CartesianProduct" not in hits._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in corpus.mask_corpus(docs, hits).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in corpus.mask_corpus(docs, hits, "cut").collect()} == {1: "Intro  tail", 2: " ".join(words[:12]), 3: None}
    assert {r.item_id: (r.contaminated, r.docs) for r in corpus.contaminated_items(hits, items).collect()} == {7: (True, 1), 8: (False, 0)}


def cut_by_loops(text, places, n, mark=""):
    """Characters of the covered words, and between two covered neighbours, taken out one by one."""
    found = [m.span() for m in regex.finditer(r"[\p{L}\p{N}_]+", text)]
    covered = sorted({p + k for p in places for k in range(n)})
    out, at = "", 0
    for first in [c for c in covered if c - 1 not in covered]:
        last = first
        while last + 1 in covered:
            last += 1
        out, at = out + text[at : found[first][0]] + mark, found[last][1]
    return out + text[at:]


def test_cutting_keeps_every_other_character(spark):
    rng = random.Random(5)
    pieces = ["Hello", ", ", "World! ", "İstanbul", "—", "don't ", "_x_", "\n\n", "Good-bye: ", "ünï", "\u0301", " 12.5% ", "End", "."]
    rows = []
    for i in range(60):
        text = "".join(rng.choices(pieces, k=rng.randrange(0, 40)))
        size = len(regex.findall(r"[\p{L}\p{N}_]+", text))
        rows.append((i, text, "x", sorted({rng.randrange(size - 2) for _ in range(rng.randrange(0, 5))}) if size > 2 else []))
    docs = spark.createDataFrame([(i, t, x, "c") for i, t, x, _ in rows], "doc_id long, text string, pos string, _spans string")
    hits = spark.createDataFrame([(i, 9, p) for i, _, _, places in rows for p in places + places[:1]], "doc_id long, item_id long, pos int")
    for mark in ("", "[CUT]"):
        got = corpus.mask_corpus(docs, hits, "cut", n=3, mark=mark)
        assert got.columns == docs.columns
        assert {r.doc_id: r.text for r in got.collect()} == {i: cut_by_loops(t, places, 3, mark) for i, t, _, places in rows}


def test_word_spans_join_overlaps_and_neighbours(spark):
    hits = spark.createDataFrame([(1, 0), (1, 2), (1, 5), (1, 9), (1, 9), (2, 4)], "doc_id long, pos int")
    assert sorted((r.doc_id, r.first, r.last) for r in corpus.word_spans(hits, 3).collect()) == [(1, 0, 7), (1, 9, 11), (2, 4, 6)]


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_run_hashes_are_of_the_words_in_order(spark, n):
    rng = random.Random(n)
    texts = [[rng.choice("abcAB") for _ in range(size)] for size in (0, 1, n - 1, n, 40, 200)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "i int, w array<string>").select("i", corpus.run_hashes(F.col("w"), n).alias("h")).collect()
    found = [(tuple(x.lower() for x in texts[r.i][p : p + n]), h) for r in rows for p, h in enumerate(r.h)]
    assert all(len(r.h) == max(0, len(texts[r.i]) - n + 1) for r in rows)
    assert len(set(found)) == len({g for g, _ in found}) == len({h for _, h in found})


@pytest.mark.parametrize("limit", [0, 2_000_000])
def test_hot_ngrams_are_joined_in_parts(spark, limit):
    boiler = " ".join(f"b{i}" for i in range(13))
    docs = [(i, f"own{i} {boiler.upper()} x{i} y" if i % 2 else " ".join(f"z{i}q{k}" for k in range(20))) for i in range(400)] + [(1, f"own1 {boiler.upper()} x1 y")]
    items = [(i, f"{boiler}, item{i}") for i in range(300)] + [(999, docs[2][1])]
    hits = corpus.contamination_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast=limit, places=50, sharers=40)
    want = Counter((i, j, 1) for i in range(1, 400, 2) for j in range(300)) + Counter((2, 999, p) for p in range(8))
    assert Counter(map(tuple, hits.collect())) == want
    assert "CartesianProduct" not in hits._jdf.queryExecution().toString()
    if not limit:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            parts = hits.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(parts) == 4 and max(r["count"] for r in parts) < 0.7 * want.total()  # one n-gram has nearly all rows


def test_candidates_are_verified_on_words(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    grams = corpus.gram_rows(docs, "doc_id", "text", 3)
    made = corpus.worded(grams.withColumn("h", F.lit(7).cast("long")), docs, "doc_id", "text", 3)
    assert sorted((r.pos, r.gram) for r in made.collect()) == [(0, "a b c"), (1, "b c d")]


def test_columns_of_any_names_survive(spark):
    docs = spark.createDataFrame([("a", "test", 1, "p", "h", "u"), ("a", "test", 2, "q", "h", "u")], "task string, split string, doc_id long, _place string, _has_test string, by string")
    for made in (tables.limit_docs(docs, 1), tables.eval_split(docs).where("doc_id = 1")):
        assert made.columns == docs.columns and tuple(made.first()) == ("a", "test", 1, "p", "h", "u")
    turns = spark.createDataFrame([(1, 0, "user", "x", "y"), (1, 1, "user", "x", "y")], "conv_id long, turn long, role string, _user string, _assistant string")
    assert list(map(tuple, prepare.turn_limits(turns, 1, 1).collect())) == [(1, 0, "user", "x", "y")]


def test_needle_variants(spark):
    pool = spark.createDataFrame([(b, f"k{i}", f"v{b}{i}") for b in (0, 1) for i in range(6 - 4 * b)], "bucket long, key string, value string")
    made = lambda kind: sorted(map(tuple, corpus.needles(pool, kind, 3).collect()))
    assert made("single") == [(0, "k0", "v00", True), (1, "k0", "v10", True)]
    assert made("multikey") == [(0, "k0", "v00", True), (0, "k1", "v01", False), (0, "k2", "v02", False), (1, "k0", "v10", True), (1, "k1", "v11", False)]
    assert made("multivalue") == [(0, "k0", "v00", True), (0, "k0", "v01", True), (0, "k0", "v02", True), (1, "k0", "v10", True), (1, "k0", "v11", True)]
    assert [r[3] for r in made("multiquery")] == [True] * 5
    with pytest.raises(ValueError, match="variant"):
        corpus.needles(pool, "other")
    stacks = spark.createDataFrame([(0, "x" * 40)], "bucket long, haystack string")
    row = corpus.needle_dataset(stacks, corpus.needles(pool, "multivalue", 3)).first()
    assert row.answers == ["v00", "v01", "v02"] and row.question.endswith("for k0?") and row.prompt.count("x") == 40


def test_rouge_over_references(spark):
    assert one(spark, scores.rouge1_any(F.lit("a b c"), F.array(F.lit("x"), F.lit("A b"), F.lit(None).cast("string")))) == pytest.approx(0.8)
    assert one(spark, scores.rouge1_any(F.lit("a"), F.array().cast("array<string>"))) is None


def test_token_f1_over_references_matches_counters(spark, monkeypatch):
    monkeypatch.setattr(scores, "TOKENS", 20)  # some rows at a time
    rng = random.Random(4)
    made = lambda: rng.choice([None, "", " ".join(rng.choices("abc", k=rng.randrange(9)))])
    rows = [(i, made(), rng.choice([None, [made() for _ in range(rng.randrange(4))]])) for i in range(200)]

    def f1(a, b):
        a, b = (a or "").split(), (b or "").split()
        return 1.0 if not a and not b else 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))

    df = spark.createDataFrame(rows, "i int, pred string, refs array<string>")
    got = {r.i: r.f1 for r in df.select("i", scores.token_f1_any(F.col("pred"), F.col("refs")).alias("f1")).collect()}
    assert got == {i: max((f1(p, r) for r in refs), default=None) if refs is not None else None for i, p, refs in rows}
    empty = df.limit(0).select(scores.token_f1_any(F.col("pred"), F.col("refs")).alias("f1"))
    assert empty.collect() == []


def times_cut(df, cut):
    """How often the optimised plan works out ``cut``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(cut)


def test_token_f1_any_cuts_each_text_once(spark):
    df = spark.createDataFrame([("a b", ["a", "b c"])], "pred string, refs array<string>")
    assert times_cut(df.select(scores.token_f1_any(F.col("pred"), F.col("refs")).alias("f1")), "split(") == 2


def test_rouge1_any_cuts_each_text_once(spark):
    df = spark.createDataFrame([("a b", ["a", "b c"])], "pred string, refs array<string>")
    assert times_cut(df.select(scores.rouge1_any(F.col("pred"), F.col("refs")).alias("f1")), "regexp_extract_all(") == 2


def test_token_f1_cuts_each_text_once(spark):
    df = spark.createDataFrame([("a b", "b c")], "pred string, ref string")
    assert times_cut(df.select(scores.token_f1(F.col("pred"), F.col("ref")).alias("f1")), "split(") == 2
