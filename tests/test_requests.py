"""Stored requests, bounded few-shot pools, and trees of request hashes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom.operators import requests as r

ITEMS = "task string, doc_id long, prompt string, choices array<string>"


def items_of(spark, n=60):
    return spark.createDataFrame([("t" if i % 3 else "u", i, f"prompt {i} " * 5, [f"c{i}.{k}" for k in range(i % 5)]) for i in range(n)], ITEMS)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_requests_join_without_an_exchange(spark, no_broadcast):
    items = items_of(spark)
    stored = r.store_mc_requests(items, 4)
    plain, read = r.mc_requests(items), stored.read(spark)
    assert sorted(map(tuple, read.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    prints = lambda rows: sorted(map(tuple, r.request_fingerprint(rows).collect()))
    assert prints(read) == prints(plain)
    assert spark.table(stored.contexts).count() == items.count()  # every prompt once
    given = plain.where("doc_id <> 4").select("task", "doc_id", "idx", (F.col("doc_id") * 10 + F.col("idx")).alias("loglik"))
    joined = stored.with_responses(spark, r.store_responses(given, 4))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.join(given, ["task", "doc_id", "idx"]).select(joined.columns).collect()))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def smallest_by_loops(rows, wanted):
    groups = {}
    for g, o in rows:
        groups.setdefault(g, []).append(o)
    return Counter((g, o) for g, held in groups.items() for o in sorted(held, key=lambda x: (x is not None, x or 0))[: wanted if isinstance(wanted, int) else wanted.get(g, 0)])


@pytest.mark.parametrize("wanted", [0, 1, 7, 1500, {"a": 3, "b": 0, "c": 2000, "zz": 4}, {}])
def test_smallest_rows_of_each_group(spark, wanted):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(400)])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "task string, doc_id long").repartition(3)
    assert Counter(map(tuple, r.smallest(df, "task", "doc_id", wanted).collect())) == smallest_by_loops(rows, wanted)


def test_tasks_pass_on_bounded_numbers_of_rows(spark):
    df = spark.range(0, 40_000, numPartitions=4).selectExpr("IF(id % 2 = 0, 'a', 'b') AS task", "id AS doc_id", "repeat('x', 100) AS example")
    shots = r._first(df, {"a": 1200, "b": 3})
    assert {x.task: [s.doc_id for s in x.shots] for x in shots.collect()} == {"a": list(range(0, 2400, 2)), "b": [1, 3, 5]}
    few = r.smallest(df, "task", "doc_id", {"a": 1200, "b": 3})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few = few.select("*")
        few.collect()
        graph = few._jdf.queryExecution().executedPlan()
        found = []

        def walk(node):
            if node.nodeName().startswith("Exchange"):
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))

        walk(graph)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found and 0 < max(found) <= 4 * (1200 + 3)  # four tasks, of 40,000 rows


def test_shots_of_repeated_and_null_identifiers(spark):
    pool = spark.createDataFrame([("t", 1, "b"), ("t", 1, "a"), ("t", 1, "c"), ("t", None, "n"), ("t", 2, "d"), (None, 5, "x")], "task string, doc_id long, example string")
    assert [s.example for s in r._first(pool, 3).where("task = 't'").first().shots] == ["n", "a", "b"]
    for most in (0, 100):
        assert [s.example for s in r._first(pool, {"t": 5}, max_broadcast=most).first().shots] == ["n", "a", "b", "c", "d"]
    items = spark.createDataFrame([("t", 9, "q"), ("u", 8, "p")], "task string, doc_id long, prompt string")
    assert {x.doc_id: x.prompt for x in r.num_fewshot(items, pool, {"t": 2}).collect()} == {9: "n\n\na\n\nq", 8: "p"}


def test_trees_tell_where_versions_differ(spark):
    old = r.mc_requests(items_of(spark))
    new = old.withColumn("context", F.when(F.col("doc_id") == 9, "other").otherwise(F.col("context"))).where("NOT (doc_id = 7 AND idx = 1)")
    new = new.unionByName(old.where("doc_id = 3 AND idx = 0"))  # once more
    trees = [{(x.task, x.node): (x.requests, x.hash) for x in r.request_tree(side, digits=2).collect()} for side in (old, new, old.repartition(5).orderBy(F.desc("idx")))]
    assert trees[0] == trees[2]
    changes = {(x.task, x.doc_id, x.idx, x.change, x.copies) for x in r.request_changes(old, new, digits=2).collect()}
    want = {("u", 9, k, c, 1) for k in range(4) for c in ("removed", "added")} | {("t", 7, 1, "removed", 1), ("u", 3, 0, "added", 1)}
    assert changes == want and r.request_changes(old, new, digits=2, max_broadcast=0).count() == len(want)
    assert r.request_changes(old, old).collect() == []
    touched = {node for tree in (0, 1) for node, v in trees[tree].items() if trees[1 - tree].get(node) != v}
    assert ("u", "") in touched and ("t", "") in touched and len(touched) <= 2 + 10
    assert sum(n for (task, node), (n, _) in trees[0].items() if node == "") == old.count()


def test_nodes_of_too_many_requests_are_an_error(spark):
    with pytest.raises(Exception, match="more digits"):
        r.request_tree(r.mc_requests(items_of(spark)), digits=1, most=2).collect()


def test_sums_that_agree_still_differ_in_the_tree(spark):
    """Requests with the same sums of hash parts cannot be told apart by sums; the tree has the hashes themselves."""
    rows = spark.createDataFrame([("t", 1, "a", "x"), ("t", 2, "b", "x")], "task string, doc_id long, context string, output_type string")
    one, two = (r.request_tree(rows.where(c), digits=1, fields=("context",)).where("node = ''").first().hash for c in ("doc_id = 1", "doc_id = 2"))
    assert one != two


def test_items_of_a_frequent_task_stay_apart(spark):
    items = spark.range(400).selectExpr("IF(id % 50 = 0, 'few', 'many') AS task", "id AS doc_id", "concat('p', id) AS prompt")
    pool = items.selectExpr("task", "doc_id", "concat('e', doc_id) AS example")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = r.fewshot_first_n(items, pool, 2)
        assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()  # only shots are moved
        apart = r._before(items, r._first(pool, 2), F.col("shots"), "\n\n", max_bytes=0)
        plan = apart._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "_salt" in plan
        want = {x.doc_id: ("e0\n\ne50\n\n" if x.doc_id % 50 == 0 else "e1\n\ne2\n\n") + x.prompt for x in items.collect()}
        assert {x.doc_id: x.prompt for x in near.collect()} == want == {x.doc_id: x.prompt for x in apart.collect()}
        assert near.columns == apart.columns == ["task", "doc_id", "prompt"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("shots", [lambda i, p: r.fewshot_exclude_self(i, p, 2), lambda i, p: r.num_fewshot(i.where("doc_id <> 0"), p.where("doc_id not in (1)"), {"t": 2})], ids=["exclude_self", "num"])
def test_other_few_shot_forms_move_no_items(spark, shots):
    items = spark.range(100).selectExpr("'t' AS task", "id AS doc_id", "concat('p', id) AS prompt", "concat('e', id) AS example")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = shots(items.drop("example"), items.drop("prompt"))
        assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {x.prompt for x in near.where("doc_id = 1").collect()} == {"e0\n\ne2\n\np1"}
