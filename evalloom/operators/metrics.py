"""Task-level metrics as combinable aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(value: str) -> Column:
    return F.avg(value)


def mean_stderr(value: str) -> Column:
    """Sample standard deviation over the root of n; null for fewer than two values."""
    return F.when(F.count(value) > 1, F.stddev_samp(value) / F.sqrt(F.count(value)))


def poisson_weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """A Poisson(1) weight for each key and replicate: hashed to a number from 0 to 1, of which the distribution is inverted."""
    z = keys[:, None] ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for add in (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), np.uint64(0)):
        z = z + add
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(odd)
        z = z ^ (z >> np.uint64(31))
    upto = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))
    return np.searchsorted(upto, (z >> np.uint64(11)) / 2.0**53, "right").astype(float)


#: Numbers of group sums that a task holds at most before it passes them on, and weights that it draws at once.
HELD, DRAWN = 1 << 24, 1 << 17


def bootstrap_replicates(rows: DataFrame, by: Sequence[str], state: Mapping[str, Column], key: str = "doc_id", replicates: int = 1000, seed: int = 42) -> DataFrame:
    """by, replicate, and the weighted sum of every column of ``state`` in that replicate of a Poisson bootstrap.

    Any metric that is a formula over sums can be resampled so: means, cells of a confusion table, n-gram counts. Every row draws its own Poisson(1) weights for all
    replicates from a hash of (seed, its key, the replicate), so the result does not depend on the partitioning. Tasks draw the weights of some rows as a matrix,
    multiply it with their states and add that up for each group; only these sums are shuffled. Nulls in a state count as 0.
    """
    names, columns = list(by), list(state)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def frames() -> Iterator[pd.DataFrame]:
            for group, held in sums.items():
                named = {k: pd.Series([g if g == g else None] * replicates, dtype=object) for k, g in zip(names, group, strict=True)}  # pandas has NaN for null
                yield pd.DataFrame({**named, "replicate": np.arange(replicates), **{f"s{i}": held[i] for i in range(len(columns))}})
            sums.clear()

        for batch in batches:
            for group, own in batch.groupby(names, dropna=False, sort=False) if names else [((), batch)]:
                if group not in sums and (len(sums) + 1) * len(columns) * replicates > HELD:
                    yield from frames()
                held = sums.setdefault(group, np.zeros((len(columns), replicates)))
                keys, step = own["_key"].to_numpy().astype(np.uint64), max(1, DRAWN // replicates)
                values = own[[f"s{i}" for i in range(len(columns))]].to_numpy(float)
                for i in range(0, len(keys), step):
                    held += values[i : i + step].T @ poisson_weights(keys[i : i + step], replicates, seed)
        yield from frames()

    given = rows.select(*names, F.xxhash64(key).alias("_key"), *[F.coalesce(state[c].cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(columns)])
    fields = ", ".join([f"`{n}` {t}" for n, t in given.select(*names).dtypes] + ["replicate int"] + [f"s{i} double" for i in range(len(columns))])
    return given.mapInPandas(draw, fields).groupBy(*names, "replicate").agg(*[F.sum(f"s{i}").alias(c) for i, c in enumerate(columns)])


def bootstrap(rows: DataFrame, by: Sequence[str], state: Mapping[str, Column], metric: Column, key: str = "doc_id", replicates: int = 1000, seed: int = 42) -> DataFrame:
    """by, stderr, n: the population standard deviation of ``metric``, a formula over the sums of ``state``, over the replicates; n counts rows."""
    drawn = bootstrap_replicates(rows, by, state | {"_rows": F.lit(1)}, key, replicates, seed)
    spread = drawn.select(*by, metric.alias("_m")).groupBy(*by).agg(F.stddev_pop("_m").alias("stderr"))
    counts = rows.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    return spread.join(counts, reduce(and_, same)).select(*by, "stderr", "n") if by else spread.withColumn("n", F.lit(rows.count()))


def bootstrap_stderr(scores: DataFrame, by: Sequence[str], value: str = "value", key: str = "doc_id", replicates: int = 1000, seed: int = 42) -> DataFrame:
    """by, stderr, n: standard error of the mean by a Poisson bootstrap. Null values are left out."""
    sums = {"_w": F.lit(1), "_wx": F.col(value)}
    return bootstrap(scores.where(F.col(value).isNotNull()), by, sums, F.col("_wx") / F.nullif(F.col("_w"), F.lit(0.0)), key, replicates, seed)


def bootstrap_macro_f1(rows: DataFrame, by: Sequence[str], gold: str = "gold", pred: str = "pred", key: str = "doc_id", replicates: int = 1000, seed: int = 42, max_classes: int = 1000) -> DataFrame:
    """by, stderr, n: standard error of macro F1, with a replicate's true positives, golds and predictions of each class as state.

    Rows without a gold or predicted class are left out. The classes are read first; more than ``max_classes`` are an error.
    """
    known = rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    classes = [r.k for r in known.select(F.explode(F.array(gold, pred)).alias("k")).distinct().limit(max_classes + 1).collect()]
    if len(classes) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    state, f1, there = {}, F.lit(0.0), F.lit(0)
    for i, k in enumerate(classes):
        is_gold, is_pred = F.col(gold) == F.lit(k), F.col(pred) == F.lit(k)
        state |= {f"_tp{i}": (is_gold & is_pred).cast("int"), f"_sides{i}": is_gold.cast("int") + is_pred.cast("int")}
        f1, there = f1 + ratio(2 * F.col(f"_tp{i}"), F.col(f"_sides{i}")), there + (F.col(f"_sides{i}") > 0).cast("int")
    return bootstrap(known, by, state, f1 / F.nullif(there, F.lit(0)), key, replicates, seed)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for 0 / 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1_binary(gold: Column, pred: Column, positive: object = 1) -> Column:
    """F1 of one class (an aggregate); rows without a gold or predicted class are left out."""
    count = lambda c: F.sum(F.when(c & gold.isNotNull() & pred.isNotNull(), 1.0).otherwise(0.0))
    tp = count((gold == positive) & (pred == positive))
    return ratio(2 * tp, 2 * tp + count((gold != positive) & (pred == positive)) + count((gold == positive) & (pred != positive)))


def confusion(rows: DataFrame, by: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def class_f1(rows: DataFrame, by: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """by, class, f1, support for every class among golds or predictions, from the table of (gold, pred) counts."""
    cells = confusion(rows, by, gold, pred)
    right = F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("g").alias("class"), right.alias("tp"), F.col("n").alias("gold_n"), F.lit(0).cast("long").alias("pred_n")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("gold_n"), F.col("n").alias("pred_n")))).alias("s"))
    sums = sides.groupBy(*by, F.col("s.class").alias("class")).agg(F.sum("s.tp").alias("tp"), F.sum("s.gold_n").alias("support"), F.sum("s.pred_n").alias("predicted"))
    return sums.select(*by, "class", ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "support")


def macro_f1(rows: DataFrame, by: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """by, macro_f1: the plain mean over classes that occur among golds or predictions."""
    return class_f1(rows, by, gold, pred).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def weighted_f1(rows: DataFrame, by: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """by, weighted_f1: the mean over classes weighted by their golds."""
    return class_f1(rows, by, gold, pred).groupBy(*by).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def mcc(rows: DataFrame, by: Sequence[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """by, mcc: the correlation of golds and predictions over all classes; 0 where one side has one class alone."""
    if not by:
        return mcc(rows.withColumn("_all", F.lit(0)), ["_all"], gold, pred).drop("_all")
    cells = confusion(rows, by, gold, pred)
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("g").alias("k"), F.col("n").alias("t"), F.lit(0).cast("long").alias("q")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("t"), F.col("n").alias("q")))).alias("s"))
    classes = sides.groupBy(*by, "s.k").agg(F.sum("s.t").cast("double").alias("t"), F.sum("s.q").cast("double").alias("q"))
    parts = classes.groupBy(*by).agg(F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    whole = cells.groupBy(*by).agg(F.sum("n").cast("double").alias("s"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    square = (F.col("s") * F.col("s") - F.col("qq")) * (F.col("s") * F.col("s") - F.col("tt"))
    return whole.join(parts, list(by)).select(*by, ratio(F.col("c") * F.col("s") - F.col("tq"), F.sqrt(square)).alias("mcc"))


def perplexities() -> list[Column]:
    """word_perplexity, byte_perplexity and bits_per_byte of columns loglik, words, bytes: ratios of sums (aggregates)."""
    ll, words, octets = F.sum("loglik"), F.sum("words"), F.sum("bytes")
    return [F.exp(-ll / words).alias("word_perplexity"), F.exp(-ll / octets).alias("byte_perplexity"), (-ll / (octets * F.log(F.lit(2.0)))).alias("bits_per_byte")]


def pass_at_k(attempts: DataFrame, k: int | Sequence[int], problem: str, passed: str) -> DataFrame:
    """problem, n, c, pass_at_k: 1 - C(n - c, k) / C(n, k), as a product; null with fewer than k attempts.

    Several k give columns pass_at_<k> from one aggregation.
    """
    counts = attempts.groupBy(problem).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("c"))

    def at(k: int) -> Column:
        miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(F.col("n") - F.col("c") - i, F.lit(0)) / (F.col("n") - i))
        return F.when(F.col("n") >= k, 1 - miss)

    return counts.withColumn("pass_at_k", at(k)) if isinstance(k, int) else counts.withColumns({f"pass_at_{x}": at(x) for x in k})


def length_band(length: Column, edges: Sequence[int] = (4000, 8000)) -> Column:
    """Band of a length, as text: below the first edge, between two, or from the last on."""
    band = F.lit(f"{edges[-1]}+")
    for low, high in reversed(list(zip([0, *edges[:-1]], edges, strict=True))):
        band = F.when(length < high, F.lit(f"{low}-{high}")).otherwise(band)
    return band


def group_normalized_advantage(rewards: DataFrame, prompt: str, reward: str) -> DataFrame:
    """Adds ``advantage``: (reward - mean) / standard deviation within the prompt; 0 where there is no spread."""
    group = Window.partitionBy(prompt)
    spread = F.coalesce(F.stddev_samp(reward).over(group), F.lit(0.0))
    return rewards.withColumn("advantage", F.when(spread == 0, 0.0).otherwise((F.col(reward) - F.avg(reward).over(group)) / spread))
