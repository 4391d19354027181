"""Queries over group roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.operators import rollup as u
from evalloom.operators import scores
from evalloom.queries.registry import MC_SQL, mc_responses, query, round6, table

RESULTS_SQL = f"""{MC_SQL}, pick AS (SELECT r.model, d.lang || ':' || d.source AS task, r.doc_id, (r.idx = r.gold)::INTEGER::DOUBLE AS value, d.lang, d.source
    FROM (SELECT * FROM resp QUALIFY row_number() OVER (PARTITION BY model, task, doc_id ORDER BY loglik DESC, idx) = 1) r JOIN documents d USING (doc_id)),
  results AS (SELECT model, task, 'none' AS filter, 'acc' AS metric, avg(value) AS value, count(*) AS n FROM pick GROUP BY model, task
    UNION ALL SELECT model, task, 'strict_match', 'acc', avg(CASE WHEN doc_id % 2 = 0 THEN value ELSE 0 END), count(*) FROM pick GROUP BY model, task
    UNION ALL SELECT model, task, 'none', 'loss', avg(1 - value) + model / 10.0, count(*) FROM pick GROUP BY model, task)"""
EDGES_SQL = """edges AS (SELECT DISTINCT 'lang_' || lang AS parent, lang || ':' || source AS child FROM documents
    UNION ALL SELECT DISTINCT 'family_' || left(source, 4), lang || ':' || source FROM documents
    UNION ALL SELECT DISTINCT 'all', 'lang_' || lang FROM documents UNION ALL SELECT DISTINCT 'all', 'lang_' || lang FROM documents WHERE lang = 'en'
    UNION ALL SELECT DISTINCT 'top', 'all' FROM documents UNION ALL SELECT DISTINCT 'top', 'lang_' || lang FROM documents WHERE lang = 'fr')"""


def picks(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return scores.acc(mc_responses(spark, sf)).drop("task").join(docs, "doc_id").withColumn("task", F.concat("lang", F.lit(":"), "source"))


def results(spark, sf) -> DataFrame:
    rows = picks(spark, sf).select("*", F.explode(F.array(
        F.struct(F.lit("none").alias("filter"), F.lit("acc").alias("metric"), F.col("value").alias("v")),
        F.struct(F.lit("strict_match").alias("filter"), F.lit("acc").alias("metric"), F.when(F.col("doc_id") % 2 == 0, F.col("value")).otherwise(0.0).alias("v")),
        F.struct(F.lit("none").alias("filter"), F.lit("loss").alias("metric"), (1 - F.col("value") + F.col("model") / 10.0).alias("v")),
    )).alias("s"))
    return rows.groupBy("model", "task", "s.filter", "s.metric").agg(F.avg("s.v").alias("value"), F.count("*").alias("n"))


def edges(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "source").distinct()
    task, lang = F.concat("lang", F.lit(":"), "source"), F.concat(F.lit("lang_"), "lang")
    parts = [
        docs.select(lang.alias("parent"), task.alias("child")), docs.select(F.concat(F.lit("family_"), F.substring("source", 1, 4)).alias("parent"), task.alias("child")),
        docs.select(F.lit("all").alias("parent"), lang.alias("child")), docs.where("lang = 'en'").select(F.lit("all").alias("parent"), lang.alias("child")),
        docs.select(F.lit("top").alias("parent"), F.lit("all").alias("child")), docs.where("lang = 'fr'").select(F.lit("top").alias("parent"), lang.alias("child")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def plain(spark, sf) -> DataFrame:
    return results(spark, sf).where("filter = 'none' AND metric = 'acc'")


REACH_SQL = "reach AS (SELECT parent, child FROM edges UNION SELECT r.parent, e.child FROM reach r JOIN edges e ON e.parent = r.child)"


@query("h1_expand_groups", f"WITH RECURSIVE {EDGES_SQL}, {REACH_SQL} SELECT DISTINCT parent, child FROM reach")
def h1(spark, sf):
    return u.expand_groups(edges(spark, sf)).select("parent", "child")


@query("h2_group_mean_weighted", f"WITH {RESULTS_SQL}, {EDGES_SQL} SELECT parent AS \"group\", model, filter, metric, round(sum(value * n) / sum(n), 6) AS value, sum(n)::BIGINT AS n FROM (SELECT DISTINCT * FROM edges) e JOIN results r ON r.task = e.child GROUP BY ALL")
def h2(spark, sf):
    return u.group_mean_weighted(results(spark, sf), edges(spark, sf)).withColumn("value", round6(F.col("value")))


@query("h3_group_mean_unweighted", f"WITH {RESULTS_SQL}, {EDGES_SQL} SELECT parent AS \"group\", model, filter, metric, round(avg(value), 6) AS value, sum(n)::BIGINT AS n FROM (SELECT DISTINCT * FROM edges) e JOIN results r ON r.task = e.child GROUP BY ALL")
def h3(spark, sf):
    return u.group_mean_unweighted(results(spark, sf), edges(spark, sf)).withColumn("value", round6(F.col("value")))


@query("h3_group_mean_over_leaves", f"WITH RECURSIVE {RESULTS_SQL}, {EDGES_SQL}, {REACH_SQL} SELECT parent AS \"group\", model, filter, metric, round(avg(value), 6) AS value, sum(n)::BIGINT AS n FROM (SELECT DISTINCT parent, child FROM reach) e JOIN results r ON r.task = e.child GROUP BY ALL")
def h3_leaves(spark, sf):
    return u.group_mean_unweighted(results(spark, sf), edges(spark, sf), use_leaves=True).withColumn("value", round6(F.col("value")))


SPEC_SQL = """spec AS (SELECT DISTINCT parent AS g, 'acc' AS metric, parent <> 'all' AS weighted, CASE WHEN parent LIKE 'family%' THEN 'strict_match' END AS f FROM edges WHERE parent <> 'lang_de'
    UNION ALL SELECT 'lang_en', 'loss', true, NULL)"""


def spec(spark, sf) -> DataFrame:
    groups = edges(spark, sf).select(F.col("parent").alias("group")).distinct().where("group <> 'lang_de'")
    only = F.when(F.col("group").startswith("family"), F.array(F.lit("strict_match")))
    weight = F.when(F.col("group") == "all", F.lit(False))
    return groups.select("group", F.lit("acc").alias("metric"), weight.alias("weight_by_size"), only.alias("filters")).unionByName(
        groups.where("group = 'lang_en'").select("group", F.lit("loss").alias("metric"), F.lit(True).alias("weight_by_size"), F.lit(None).cast("array<string>").alias("filters"))
    )


STEP = "SELECT r.model, s.g AS task, r.filter, r.metric, CASE WHEN s.weighted THEN sum(r.value * r.n) / sum(r.n) ELSE avg(r.value) END AS value, sum(r.n) AS n FROM (SELECT DISTINCT * FROM edges) e JOIN spec s ON s.g = e.parent JOIN {0} r ON r.task = e.child AND r.metric = s.metric AND (s.f IS NULL OR s.f = r.filter) WHERE e.parent {1} GROUP BY r.model, s.g, s.weighted, r.filter, r.metric"
LOW, ALL, TOP = "NOT IN ('all', 'top')", "= 'all'", "= 'top'"
ROLL_SQL = f"""WITH {RESULTS_SQL}, {EDGES_SQL}, {SPEC_SQL},
  one AS ({STEP.format('results', LOW)}), two AS ({STEP.format('one', ALL)}), low AS (SELECT * FROM one UNION ALL SELECT * FROM two), three AS ({STEP.format('low', TOP)})
  SELECT model, task AS "group", filter, metric, round(value, 6) AS value, n::BIGINT AS n FROM (SELECT * FROM low UNION ALL SELECT * FROM three)"""


def rolled(spark, sf) -> DataFrame:
    return u.roll_up(results(spark, sf), edges(spark, sf), spec(spark, sf)).withColumn("value", round6(F.col("value"))).select("model", "group", "filter", "metric", "value", "n")


@query("h4_several_metrics", f"{ROLL_SQL} WHERE task = 'lang_en'")
def h4(spark, sf):
    return rolled(spark, sf).where("group = 'lang_en'")


@query("h5_filter_roll_up", f"{ROLL_SQL} WHERE task LIKE 'family%'")
def h5(spark, sf):
    return rolled(spark, sf).where("group LIKE 'family%'")


@query("h6_delta", f"WITH {MC_SQL}, v AS (SELECT model, doc_id, idx = gold AS hit FROM resp QUALIFY row_number() OVER (PARTITION BY model, doc_id ORDER BY loglik DESC, idx) = 1) SELECT a.model, round(avg(a.hit::INTEGER - b.hit::INTEGER), 6) AS delta, count(*) AS n FROM v a JOIN v b ON b.model = a.model AND b.doc_id = a.doc_id + 1 WHERE b.doc_id % 2 = 1 GROUP BY a.model")
def h6(spark, sf):
    value = scores.acc(mc_responses(spark, sf)).select("model", "doc_id", "value")
    other = value.where("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - 1)
    return u.delta(value, other).withColumn("delta", round6(F.col("delta")))


@query("h7_nested_roll_up", ROLL_SQL)
def h7(spark, sf):
    """Duplicate members, a member of two parents, a group without a spec, nested groups."""
    return rolled(spark, sf)


@query("h8_leaderboard", f"WITH {RESULTS_SQL}, r AS (SELECT task AS \"group\", metric, model, round(value, 6) AS value FROM results WHERE filter = 'none') SELECT *, rank() OVER (PARTITION BY \"group\", metric ORDER BY CASE WHEN metric = 'loss' THEN -value ELSE value END DESC)::INTEGER AS rank FROM r")
def h8(spark, sf):
    rows = results(spark, sf).where("filter = 'none'").select(F.col("task").alias("group"), "metric", "model", round6(F.col("value")).alias("value"))
    return u.leaderboard(rows, ["loss"])


@query("h9_breakdown", f"WITH {RESULTS_SQL} SELECT CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS source, grouping(lang, source)::BIGINT AS level, round(avg(value), 6) AS value, count(*) AS n FROM pick GROUP BY CUBE (lang, source)")
def h9(spark, sf):
    return u.breakdown(picks(spark, sf), ["lang", "source"]).withColumn("value", round6(F.col("value")))


@query("h10_version_compare", f"WITH {RESULTS_SQL} SELECT task, metric, round(max(value) FILTER (model = 0), 6) AS v0, round(max(value) FILTER (model = 1), 6) AS v1, round(max(value) FILTER (model = 2), 6) AS v2 FROM results WHERE filter = 'none' GROUP BY ALL")
def h10(spark, sf):
    rows = results(spark, sf).where("filter = 'none'").select("task", "metric", F.col("model").alias("version"), round6(F.col("value")).alias("value"))
    return u.version_compare(rows, [0, 1, 2])


@query("h11_prompt_summary", f"WITH {RESULTS_SQL}, p AS (SELECT lang AS task, 'acc' AS metric, doc_id % 5 AS prompt, avg(value) AS value FROM pick GROUP BY ALL) SELECT task, metric, round(max(value), 6) AS best, round(min(value), 6) AS worst, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS spread, arg_max(prompt, value) AS best_prompt FROM (SELECT * FROM p ORDER BY prompt) GROUP BY ALL")
def h11(spark, sf):
    rows = picks(spark, sf).groupBy(F.col("lang").alias("task"), F.lit("acc").alias("metric"), (F.col("doc_id") % 5).alias("prompt")).agg(F.avg("value").alias("value"))
    return u.prompt_summary(rows).select("task", "metric", *[round6(F.col(c)).alias(c) for c in ("best", "worst", "mean", "spread")], "best_prompt")
