"""Queries over item scores and task metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import metrics as m
from evalloom.operators import scores
from evalloom.queries.registry import MC_SQL, mc_responses, query, round6, table



@query(
    "w1_multiple_choice",
    f"""WITH {MC_SQL}, b AS (SELECT model, task, doc_id, max(gold) AS gold, max(loglik) AS top FROM resp GROUP BY ALL),
        v AS (SELECT b.model, b.task, b.doc_id, (min(r.idx) = b.gold)::INTEGER::DOUBLE AS value FROM b JOIN resp r ON r.model = b.model AND r.task = b.task AND r.doc_id = b.doc_id AND r.loglik = b.top GROUP BY b.model, b.task, b.doc_id, b.gold),
        t AS (SELECT model, task, avg(value) AS acc, stddev_samp(value) / sqrt(count(*)) AS stderr, count(*) AS n FROM v GROUP BY model, task)
        SELECT model, task, round(acc, 6) AS acc, round(stderr, 6) AS stderr, n FROM t
        UNION ALL SELECT model, 'all', round(sum(acc * n) / sum(n), 6), NULL, sum(n)::BIGINT FROM t GROUP BY model""",
)
def w1(spark, sf):
    """Accuracy per language and its size-weighted mean."""
    value = scores.acc(mc_responses(spark, sf))
    tasks = value.groupBy("model", "task").agg(m.mean("value").alias("acc"), m.mean_stderr("value").alias("stderr"), F.count("*").alias("n"))
    whole = tasks.groupBy("model").agg((F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("acc"), F.sum("n").alias("n")).select("model", F.lit("all").alias("task"), "acc", F.lit(None).cast("double").alias("stderr"), "n")
    return tasks.unionByName(whole).select("model", "task", round6(F.col("acc")).alias("acc"), round6(F.col("stderr")).alias("stderr"), "n")


def picked(score: str) -> str:
    return f"v AS (SELECT model, task, doc_id, gold, idx FROM resp QUALIFY row_number() OVER (PARTITION BY model, task, doc_id ORDER BY {score} DESC, idx) = 1)"


@query("f1_acc", f"WITH {MC_SQL}, {picked('loglik')} SELECT model, task, doc_id, (idx = gold)::INTEGER::DOUBLE AS value FROM v")
def f1(spark, sf):
    return scores.acc(mc_responses(spark, sf))


@query("f2_acc_norm", f"WITH {MC_SQL}, {picked('loglik / greatest(length(choice), 1)')} SELECT model, task, doc_id, (idx = gold)::INTEGER::DOUBLE AS value FROM v")
def f2(spark, sf):
    return scores.acc_norm(mc_responses(spark, sf))


@query("f2_acc_norm_bytes", f"WITH {MC_SQL}, {picked('loglik / greatest(strlen(choice), 1)')} SELECT model, task, doc_id, (idx = gold)::INTEGER::DOUBLE AS value FROM v")
def f2_bytes(spark, sf):
    return scores.acc_norm(mc_responses(spark, sf), "byte")


@query("f3_mc2", f"WITH {MC_SQL} SELECT model, task, doc_id, round(sum(exp(loglik)) FILTER (idx % 2 = doc_id % 2) / sum(exp(loglik)), 6) AS value FROM resp GROUP BY ALL")
def f3(spark, sf):
    rows = mc_responses(spark, sf).withColumn("is_true", F.col("idx") % 2 == F.col("doc_id") % 2)
    return scores.mc2(rows).withColumn("value", round6(F.col("value")))


@query("f6_set_f1", """WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS gold, list_distinct(coalesce(list(l_partkey) FILTER (l_linenumber % 2 = 1), [])) AS pred FROM lineitem GROUP BY l_orderkey),
    c AS (SELECT *, len(list_intersect(gold, pred))::DOUBLE AS common FROM s)
    SELECT l_orderkey, round(CASE WHEN len(pred) = 0 THEN 0.0 ELSE common / len(pred) END, 6) AS precision, round(common / len(gold), 6) AS recall,
           round(CASE WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (len(pred) + len(gold)) END, 6) AS f1 FROM c""")
def f6(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("gold"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey"))).alias("pred"))
    p, r, f = scores.set_f1(F.col("pred"), F.col("gold"))
    return sets.select("l_orderkey", round6(p).alias("precision"), round6(r).alias("recall"), round6(f).alias("f1"))


def perplexity_rows(spark, sf):
    return scores.rolling_likelihood(table(spark, sf, "documents").select("doc_id", F.col("source").alias("task"), "text", (F.col("n_chars") * -0.7).alias("loglik")))


PPL_SQL = r"r AS (SELECT doc_id, source AS task, n_chars * -0.7::DOUBLE AS loglik, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words, strlen(text) AS bytes FROM documents)"


@query("f9_rolling_likelihood", f"WITH {PPL_SQL} SELECT doc_id, words, bytes, round(loglik, 6) AS loglik FROM r")
def f9(spark, sf):
    return perplexity_rows(spark, sf).select("doc_id", "words", "bytes", round6(F.col("loglik")).alias("loglik"))


@query("f10_minimal_pair_pref", f"WITH {MC_SQL}, two AS (SELECT * FROM resp WHERE idx < 2), v AS (SELECT model, task, idx FROM two QUALIFY row_number() OVER (PARTITION BY model, task, doc_id ORDER BY loglik DESC, idx) = 1) SELECT model, task, round(avg((idx = 0)::INTEGER), 6) AS share, count(*) AS n FROM v GROUP BY ALL")
def f10(spark, sf):
    return scores.minimal_pair_pref(mc_responses(spark, sf).where("idx < 2"), ["model", "task"]).withColumn("share", round6(F.col("share")))


@query("f11_greedy_and_perplexity", f"WITH {MC_SQL} SELECT model, task, round(avg((doc_id % 3 = 0)::INTEGER), 6) AS greedy_acc, round(exp(-avg(loglik)), 3) AS perplexity FROM resp WHERE idx = 0 GROUP BY ALL")
def f11(spark, sf):
    rows = mc_responses(spark, sf).where("idx = 0")
    return rows.groupBy("model", "task").agg(round6(scores.greedy_acc(F.col("doc_id") % 3 == 0)).alias("greedy_acc"), F.round(scores.target_perplexity(F.col("loglik")), 3).alias("perplexity"))


@query("g1_mean", f"WITH {MC_SQL}, {picked('loglik')} SELECT model, task, round(avg((idx = gold)::INTEGER), 6) AS acc FROM v GROUP BY ALL")
def g1(spark, sf):
    return scores.acc(mc_responses(spark, sf)).groupBy("model", "task").agg(round6(m.mean("value")).alias("acc"))


@query("g2_mean_stderr", f"WITH {MC_SQL}, {picked('loglik')} SELECT model, task, round(stddev_samp((idx = gold)::INTEGER) / sqrt(count(*)), 6) AS stderr FROM v GROUP BY ALL")
def g2(spark, sf):
    return scores.acc(mc_responses(spark, sf)).groupBy("model", "task").agg(round6(m.mean_stderr("value")).alias("stderr"))


@query("g3_bootstrap_stderr")
def g3(spark, sf):
    return m.bootstrap_stderr(scores.acc(mc_responses(spark, sf)), ["model", "task"], replicates=1000)


@query("g3_bootstrap_macro_f1")
def g3_macro_f1(spark, sf):
    return m.bootstrap_macro_f1(multi(spark, sf, "doc_id"), ["task"], replicates=1000)


BINARY_SQL = "b AS (SELECT d.lang AS task, l.quality AS gold, (d.n_chars > 1000)::INTEGER AS pred FROM documents d JOIN labels l USING (doc_id))"
MULTI_SQL = "b AS (SELECT source AS task, lang AS gold, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'en' END AS pred FROM documents)"
F1_SQL = """c AS (SELECT task, gold AS k FROM b UNION SELECT task, pred FROM b),
  f AS (SELECT c.task, k, sum((gold = k AND pred = k)::INTEGER) AS tp, sum((gold = k)::INTEGER) AS s, sum((pred = k)::INTEGER) AS q FROM c JOIN b ON b.task = c.task GROUP BY ALL),
  s AS (SELECT task, s, 2.0::DOUBLE * tp / (s + q) AS f1 FROM f)"""


def binary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("task"), (F.col("n_chars") > 1000).cast("int").alias("pred"))
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold")), "doc_id")


def multi(spark, sf, *more):
    return table(spark, sf, "documents").select(*more, F.col("source").alias("task"), F.col("lang").alias("gold"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise("en").alias("pred"))


@query("g4_f1_binary", f"WITH {BINARY_SQL}, t AS (SELECT task, sum((gold = 1 AND pred = 1)::INTEGER) AS tp, sum((gold = 1)::INTEGER) + sum((pred = 1)::INTEGER) AS sides FROM b GROUP BY task) SELECT task, round(CASE WHEN sides = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / sides END, 6) AS f1 FROM t")
def g4(spark, sf):
    return binary(spark, sf).groupBy("task").agg(round6(m.f1_binary(F.col("gold"), F.col("pred"))).alias("f1"))


@query("g5_macro_f1", f"WITH {MULTI_SQL}, {F1_SQL} SELECT task, round(avg(f1), 6) AS macro_f1 FROM s GROUP BY task")
def g5(spark, sf):
    return m.macro_f1(multi(spark, sf), ["task"]).withColumn("macro_f1", round6(F.col("macro_f1")))


@query("g6_weighted_f1", f"WITH {MULTI_SQL}, {F1_SQL} SELECT task, round(sum(f1 * s) / sum(s), 6) AS weighted_f1 FROM s GROUP BY task")
def g6(spark, sf):
    return m.weighted_f1(multi(spark, sf), ["task"]).withColumn("weighted_f1", round6(F.col("weighted_f1")))


MCC_SQL = """k AS (SELECT task, gold AS k FROM b UNION SELECT task, pred FROM b), n AS (SELECT task, count(*)::DOUBLE AS s, sum((gold = pred)::INTEGER)::DOUBLE AS c FROM b GROUP BY task),
  e AS (SELECT k.task, k, sum((gold = k)::INTEGER)::DOUBLE AS t, sum((pred = k)::INTEGER)::DOUBLE AS q FROM k JOIN b ON b.task = k.task GROUP BY ALL),
  p AS (SELECT task, sum(t * q) AS tq, sum(t * t) AS tt, sum(q * q) AS qq FROM e GROUP BY task)
  SELECT task, round(CASE WHEN (s * s - qq) * (s * s - tt) = 0 THEN 0.0 ELSE (c * s - tq) / sqrt((s * s - qq) * (s * s - tt)) END, 6) AS mcc FROM n JOIN p USING (task)"""


@query("g7_mcc_binary", f"WITH {BINARY_SQL}, {MCC_SQL}")
def g7(spark, sf):
    return m.mcc(binary(spark, sf), ["task"]).withColumn("mcc", round6(F.col("mcc")))


@query("g7_mcc_multiclass", f"WITH {MULTI_SQL}, {MCC_SQL}")
def g7_multi(spark, sf):
    return m.mcc(multi(spark, sf), ["task"]).withColumn("mcc", round6(F.col("mcc")))


@query("g12_perplexities", f"WITH {PPL_SQL} SELECT round(exp(-sum(loglik) / sum(words)), 4) AS word_perplexity, round(exp(-sum(loglik) / sum(bytes)), 6) AS byte_perplexity, round(-sum(loglik) / (sum(bytes) * ln(2)), 6) AS bits_per_byte FROM r")
def g12(spark, sf):
    out = perplexity_rows(spark, sf).agg(*m.perplexities())
    return out.select(F.round("word_perplexity", 4).alias("word_perplexity"), round6(F.col("byte_perplexity")).alias("byte_perplexity"), round6(F.col("bits_per_byte")).alias("bits_per_byte"))


@query("g13_pass_at_k", "WITH p AS (SELECT user_id, count(*) AS n, sum((event_type = 'purchase')::INTEGER)::BIGINT AS c FROM events GROUP BY user_id) SELECT user_id, n, c, CASE WHEN n >= 2 THEN round(1 - (greatest(n - c, 0)::DOUBLE / n) * (greatest(n - c - 1, 0)::DOUBLE / (n - 1)), 6) END AS pass_at_2, round(1 - greatest(n - c, 0)::DOUBLE / n, 6) AS pass_at_1 FROM p")
def g13(spark, sf):
    attempts = table(spark, sf, "events").select("user_id", (F.col("event_type") == "purchase").alias("passed"))
    return m.pass_at_k(attempts, (1, 2), "user_id", "passed").select("user_id", "n", "c", *[round6(F.col(f"pass_at_{k}")).alias(f"pass_at_{k}") for k in (1, 2)])


@query("g14_score_by_band", "SELECT source, CASE WHEN n_chars < 1000 THEN '0-1000' WHEN n_chars < 4000 THEN '1000-4000' ELSE '4000+' END AS band, round(avg(doc_id % 10), 6) AS score, count(*) AS n FROM documents GROUP BY ALL")
def g14(spark, sf):
    docs = table(spark, sf, "documents").select("source", m.length_band(F.col("n_chars"), (1000, 4000)).alias("band"), (F.col("doc_id") % 10).alias("value"))
    return docs.groupBy("source", "band").agg(round6(m.mean("value")).alias("score"), F.count("*").alias("n"))


@query("g15_group_normalized_advantage", "WITH s AS (SELECT event_id, value, avg(value) OVER w AS a, coalesce(stddev_samp(value) OVER w, 0) AS d FROM events WINDOW w AS (PARTITION BY user_id)) SELECT event_id, round(CASE WHEN d = 0 THEN 0.0 ELSE (value - a) / d END, 5) AS advantage FROM s")
def g15(spark, sf):
    return m.group_normalized_advantage(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", F.round("advantage", 5).alias("advantage"))
