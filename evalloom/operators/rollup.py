"""Rolling task results up through groups.

Group tables are small (a row for each membership), results have a row for each model, task and metric; the joins are planned by size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.plans.staging import staged


def expand_groups(edges: DataFrame) -> DataFrame:
    """parent, child, depth: every node that a group reaches, with the shortest way; edges (parent, child) may repeat or form cycles.

    Ways of up to d steps are joined with each other to ways of up to 2d, until nothing changes: a few rounds however deep the groups are, and
    cycles end. Each round is staged, since the next reads it twice.
    """
    reached = staged(edges.select("parent", "child").distinct().withColumn("depth", F.lit(1)), "reached")
    size = None
    while size != (size := reached.agg(F.count("*"), F.sum("depth")).first()):
        longer = reached.alias("a").join(reached.alias("b"), F.col("a.child") == F.col("b.parent")).select(F.col("a.parent").alias("parent"), F.col("b.child").alias("child"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        reached = staged(reached.unionByName(longer).groupBy("parent", "child").agg(F.min("depth").alias("depth")), "reached")
    return reached


def heights(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Height of each group over its lowest member: one more than the highest group in it. Groups on a cycle, or above one, have none."""
    groups = {parent for parent, _ in pairs}
    within: dict[str, set[str]] = {g: set() for g in groups}
    above: dict[str, set[str]] = {g: set() for g in groups}
    for parent, child in pairs:
        if child in groups:
            within[parent].add(child)
            above[child].add(parent)
    out = {g: 1 for g in groups if not within[g]}
    todo = list(out)
    while todo:
        child = todo.pop()
        for parent in above[child]:
            within[parent].discard(child)
            out[parent] = max(out.get(parent, 0), out[child] + 1)
            if not within[parent]:
                todo.append(parent)
    return {g: h for g, h in out.items() if not within[g]}


def leaves(edges: DataFrame) -> DataFrame:
    """parent, child: the tasks under each group, those that are no groups themselves."""
    return expand_groups(edges).join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_anti").select("parent", "child")


def _members(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Results of direct members, each member once; a member without results brings nulls."""
    once = edges.select("parent", "child").dropDuplicates(["parent", "child"])
    return once.join(results, once["child"] == results["task"], "left")


def group_mean_weighted(results: DataFrame, edges: DataFrame, keys: Sequence[str] = ("model", "filter", "metric")) -> DataFrame:
    """group, keys, value, n: members' values weighted by their sizes n; members without a value are left out."""
    rows = _members(results, edges).where(F.col("value").isNotNull())
    return rows.groupBy(F.col("parent").alias("group"), *keys).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def group_mean_unweighted(results: DataFrame, edges: DataFrame, keys: Sequence[str] = ("model", "filter", "metric"), use_leaves: bool = False) -> DataFrame:
    """group, keys, value, n: the plain mean over listed members, or over all tasks below with ``use_leaves``."""
    rows = _members(results, leaves(edges) if use_leaves else edges).where(F.col("value").isNotNull())
    return rows.groupBy(F.col("parent").alias("group"), *keys).agg(F.avg("value").alias("value"), F.sum("n").alias("n"))


def roll_up(results: DataFrame, edges: DataFrame, spec: DataFrame) -> DataFrame:
    """Group results from the bottom up by ``spec`` (group, metric, weight_by_size or null, filters or null).

    A group has a value for each metric and filter its spec names (null filters: all; null weight: by size); a listed member may be a
    group with a value of its own, at any depth. Groups without a spec have none, nor have groups on a cycle or above one. Each member counts once.

    Memberships describe tasks and go to the driver, which orders the groups; results stay on the cluster. They are staged once, and levels are steps of one plan with
    broadcast memberships; of deeper groups every third level is staged, so that plans stay short.
    """
    columns = ["model", "task", "filter", "metric", "value", "n"]
    pairs = [(r.parent, r.child) for r in edges.select("parent", "child").distinct().collect()]
    level_of = heights(pairs)
    wanted = staged(spec.select(F.col("group").alias("parent"), F.col("metric").alias("m"), F.coalesce("weight_by_size", F.lit(True)).alias("weighted"), "filters"), "group-specs")  # as small as the group table
    levels = sorted(set(level_of.values()))
    done = staged(results.select(*columns), "results").withColumn("_group", F.lit(False))
    for i, level in enumerate(levels):
        now = edges.sparkSession.createDataFrame([p for p in pairs if level_of.get(p[0]) == level], "parent string, child string").join(F.broadcast(wanted), "parent")
        rows = now.join(done, (F.col("child") == F.col("task")) & (F.col("m") == F.col("metric"))).where(F.col("value").isNotNull() & (F.col("filters").isNull() | F.array_contains("filters", F.col("filter"))))
        value = F.when(F.first("weighted"), F.sum(F.col("value") * F.col("n")) / F.sum("n")).otherwise(F.avg("value"))
        made = rows.groupBy("model", "parent", "filter", "metric").agg(value.alias("value"), F.sum("n").alias("n")).withColumnRenamed("parent", "task").select(*columns)
        done = done.unionByName(made.withColumn("_group", F.lit(True)))
        done = staged(done, "group-results") if i % 3 == 2 and level != levels[-1] else done  # what stands below is then read, not worked out again
    return done.where("_group").drop("_group").withColumnRenamed("task", "group")


def delta(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("model",), item: str = "doc_id") -> DataFrame:
    """keys, delta, n: the mean of a - b over the items that both score."""
    return a.select(*keys, item, F.col("value").alias("_a")).join(b.select(*keys, item, F.col("value").alias("_b")), [*keys, item]).groupBy(*keys).agg(F.avg(F.col("_a") - F.col("_b")).alias("delta"), F.count("*").alias("n"))


def leaderboard(results: DataFrame, lower_is_better: Sequence[str] = (), by: Sequence[str] = ("group", "metric")) -> DataFrame:
    """Adds ``rank``: 1 for the best value of each group and metric; equal values share a rank."""
    signed = F.when(F.col("metric").isin(list(lower_is_better)), -F.col("value")).otherwise(F.col("value")) if lower_is_better else F.col("value")
    return results.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(signed.desc_nulls_last())))


def breakdown(scores: DataFrame, dimensions: Sequence[str], value: str = "value") -> DataFrame:
    """dimensions, level, value, n: means for all combinations of dimensions; a dimension summed over is "(all)".

    ``level`` is the grouping id, which tells a summed-over dimension from a null one.
    """
    total = scores.cube(*dimensions).agg(F.avg(value).alias("value"), F.count(value).alias("n"), F.grouping_id().alias("level"), *[F.grouping(d).alias(f"_{d}") for d in dimensions])
    named = [F.when(F.col(f"_{d}") == 1, F.lit("(all)")).otherwise(F.col(d).cast("string")).alias(d) for d in dimensions]
    return total.select(*named, F.col("level").cast("long").alias("level"), "value", "n")


def version_compare(results: DataFrame, versions: Sequence[object], keys: Sequence[str] = ("task", "metric")) -> DataFrame:
    """One row per task and metric with a column v<version> for each; versions are never averaged together."""
    wide = results.groupBy(*keys).pivot("version", list(versions)).agg(F.max("value"))
    return wide.select(*keys, *[F.col(f"`{v}`").alias(f"v{v}") for v in versions])


def prompt_summary(results: DataFrame, keys: Sequence[str] = ("task", "metric")) -> DataFrame:
    """keys, best, worst, mean, spread, best_prompt over prompt wordings; the first of equally good prompts."""
    return results.groupBy(*keys).agg(
        F.max("value").alias("best"), F.min("value").alias("worst"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.max_by("prompt", F.struct("value", -F.col("prompt"))).alias("best_prompt")
    )


