"""User metrics and user hooks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.plans.staging import staged


@dataclass(frozen=True)
class Metric:
    """A value for each row and an aggregate over values; both are column functions (a pandas UDF is one too)."""

    per_doc: Callable[[DataFrame], Column]
    aggregate: Callable[[str], Column]


@dataclass(frozen=True)
class Aggregate:
    """A metric with a state of its own that can be merged: what no formula over sums expresses.

    ``columns`` of some rows of a group reach ``update`` as a pandas frame, in any number of parts; ``merge`` puts two states together, and ``finish`` makes the
    number (None for none). States are pickled, so their size should not grow with the rows; the order of updates and merges is not fixed.
    """

    columns: Sequence[str]
    zero: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


METRICS: dict[str, Metric] = {}
AGGREGATES: dict[str, Aggregate] = {}


def register_metric(name: str, per_doc: Callable[[DataFrame], Column], aggregate: Callable[[str], Column]) -> None:
    METRICS[name] = Metric(per_doc, aggregate)


def register_aggregate(name: str, aggregate: Aggregate) -> None:
    AGGREGATES[name] = aggregate


def partial_states(df: DataFrame, aggregate: Aggregate, by: Sequence[str]) -> DataFrame:
    """key (the group as JSON), state: a state for each group and task, updated batch by batch."""
    columns = list(aggregate.columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[str, Any] = {}
        for batch in batches:
            for key, own in batch.groupby("key", sort=False):
                values = own.drop(columns="key").set_axis(columns, axis=1).reset_index(drop=True)
                states[key] = aggregate.update(states[key] if key in states else aggregate.zero(), values)
        yield pd.DataFrame({"key": list(states), "state": [pickle.dumps(s) for s in states.values()]}, dtype=object)

    given = df.select(group_key(by), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    return given.mapInPandas(work, "key string, state binary")


def group_key(by: Sequence[str]) -> Column:
    """The group as one text that is never null, nulls included."""
    return F.to_json(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("all")), {"ignoreNullFields": "false"}).alias("key")


def merged(df: DataFrame, aggregate: Aggregate, by: Sequence[str], fan_in: int = 32) -> DataFrame:
    """by, value: states of tasks merged in a tree, at most about ``fan_in`` of a group in one place at a time."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        state = reduce(aggregate.merge, map(pickle.loads, rows["state"]))
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "state": [pickle.dumps(state)]}, dtype=object)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"].astype(object), "value": pd.Series([aggregate.finish(pickle.loads(s)) for s in batch["state"]], dtype="float64")})

    states = staged(partial_states(df, aggregate, by), "states")
    while (most := states.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > 1:
        parts = -(-most // fan_in)
        salted = states.withColumn("salt", F.floor(F.rand() * parts)) if parts > 1 else states.withColumn("salt", F.lit(0))
        states = staged(salted.groupBy("key", "salt").applyInPandas(merge, "key string, state binary"), "states")
    groups = df.select(*by, group_key(by)).distinct() if by else df.sparkSession.range(1).select(group_key(by))
    return groups.join(states.mapInPandas(finish, "key string, value double"), "key", "left").select(*by, "value")


def evaluate(df: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by with a column for each registered metric. Metrics of column functions are computed in one aggregation; each aggregate with a state of its own is merged
    apart and joined by the groups. Null groups are groups."""
    plain = [m for m in metrics if m in METRICS]
    valued = df.withColumns({f"_m_{m}": METRICS[m].per_doc(df) for m in plain})
    out = valued.groupBy(*by).agg(*[METRICS[m].aggregate(f"_m_{m}").alias(m) for m in plain]) if plain else df.select(*by).distinct() if by else None
    for name in (m for m in metrics if m not in METRICS):
        own = merged(df, AGGREGATES[name], by).withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(by)}).withColumnRenamed("value", name)
        if not by:
            out = own if out is None else out.withColumn(name, own.select(name).scalar())
            continue
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)])
        out = out.join(own, same, "left").drop(*[f"_g{i}" for i in range(len(by))])
    return out.select(*by, *metrics)


def task_hook(df: DataFrame, *hooks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` after each hook in turn."""
    for hook in hooks:
        df = df.transform(hook)
    return df
