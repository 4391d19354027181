"""Scores of single items from model outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = ("model", "task", "doc_id")


def _best(score: Column) -> Column:
    """Index with the largest score, the lowest one of ties; null if any score is missing or not a number."""
    bad = F.max(F.coalesce(F.isnan(score) | score.isNull(), F.lit(True)))
    return F.when(~bad, F.max_by("idx", F.struct(score, -F.col("idx"))))


def acc(responses: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    """keys, value: 1 where the likeliest choice is ``gold``. One combinable aggregate, no window."""
    best = responses.groupBy(*keys).agg(_best(F.col("loglik")).alias("best"), F.first("gold").alias("gold"))
    return best.select(*keys, (F.col("best") == F.col("gold")).cast("double").alias("value"))


def acc_norm(responses: DataFrame, unit: str = "char", keys: Sequence[str] = ITEM) -> DataFrame:
    """As ``acc`` with log-likelihood per character (or ``byte``) of the choice; an empty choice counts as length 1."""
    length = F.greatest(F.length("choice") if unit == "char" else F.octet_length("choice"), F.lit(1))
    best = responses.groupBy(*keys).agg(_best(F.col("loglik") / length).alias("best"), F.first("gold").alias("gold"))
    return best.select(*keys, (F.col("best") == F.col("gold")).cast("double").alias("value"))


def mc2(responses: DataFrame, keys: Sequence[str] = ITEM) -> DataFrame:
    """keys, value: probability of the true choices (column is_true) among all, from log-likelihoods; choices without one are left out.

    An item's choices meet once, as an array, and the largest log-likelihood is taken out before exponentiating.
    """
    choice = F.when(F.col("loglik").isNotNull(), F.struct("loglik", F.coalesce("is_true", F.lit(False)).alias("is_true")))
    held = responses.groupBy(*keys).agg(F.sort_array(F.collect_list(choice)).alias("c"))  # as many as an item has choices
    mass = lambda c: F.exp(c["loglik"] - F.element_at("c", -1)["loglik"])
    total = lambda chosen: F.aggregate("c", F.lit(0.0), lambda s, c: s + chosen(c))
    value = F.when(F.size("c") > 0, total(lambda c: F.when(c["is_true"], mass(c)).otherwise(0.0)) / total(mass))
    return held.select(*keys, value.alias("value"))


def exact_match(pred: Column, target: Column, ignore_case: bool = False, ignore_punctuation: bool = False) -> Column:
    """1.0 for equal texts; a missing prediction does not match."""

    def shape(c: Column) -> Column:
        c = F.lower(c) if ignore_case else c
        return F.regexp_replace(c, r"[\p{P}\p{S}]", "") if ignore_punctuation else c

    return F.coalesce((shape(pred) == shape(target)).cast("double"), F.lit(0.0))


def bag(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def per_character(text: Column) -> Column:
    """Tokens of scripts written without spaces: each character that is not white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: ~c.rlike(r"(?U)^\s*$"))


#: Tokens that are counted at once; a longer row is counted alone.
TOKENS = 1 << 16


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def common_tokens(ours: pa.ListArray, theirs: pa.ListArray, of: np.ndarray) -> np.ndarray:
    """How many tokens each list of ``theirs`` has in common with list ``of`` it of ``ours``, counted as often as both have them. No list is null.

    Tokens become numbers, and one sort of each side counts them for many lists at once; a list is counted once for all that it is compared with.
    """
    n_ours, n_theirs = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ours, theirs))
    code = pa.concat_arrays([ours.flatten(), theirs.flatten()]).dictionary_encode(null_encoding="encode")
    width, number = max(1, len(code.dictionary)), code.indices.to_numpy().astype(np.int64)
    mine, n_mine = _counted(np.repeat(np.arange(len(ours)), n_ours) * width + number[: n_ours.sum()])
    cells, n_cells = _counted(np.repeat(np.arange(len(theirs)), n_theirs) * width + number[n_ours.sum() :])
    if not len(mine) or not len(cells):
        return np.zeros(len(theirs), np.int64)
    row, token = np.divmod(cells, width)
    wanted = of[row] * width + token
    place = np.minimum(np.searchsorted(mine, wanted), len(mine) - 1)
    both = np.where(mine[place] == wanted, np.minimum(n_mine[place], n_cells), 0)
    return np.bincount(row, both, len(theirs)).astype(np.int64)


def _common(ours: pa.ListArray, theirs: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first one, then for each of their token lists its row, the tokens that it and ours have in common, ours, and its own.

    ``ours`` has one list a row, ``theirs`` an array of lists; null ones are empty here.
    """
    ours = pc.fill_null(ours, pa.scalar([], ours.type))
    size = pc.list_value_length(ours).to_numpy(zero_copy_only=False).astype(np.int64)
    held = pc.fill_null(pc.list_value_length(theirs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = pc.fill_null(theirs.flatten(), pa.scalar([], ours.type)) if len(theirs) else theirs.flatten()
    own, begin = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(held)])
    upto = np.concatenate([[0], np.cumsum(size)]) + np.concatenate([[0], np.cumsum(own)])[begin]
    i = 0
    while i < len(ours):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + TOKENS, "right")) - 1)
        row = np.repeat(np.arange(j - i), held[i:j])
        found = common_tokens(ours[i:j], lists[begin[i] : begin[j]], row)
        yield i, row, found, size[i:j][row], own[begin[i] : begin[j]]
        i = j


def overlap(a: Column, b: Column) -> Column:
    """Common tokens of two arrays of texts, counted as often as both have them; null if one is null."""

    @F.arrow_udf("int")
    def common(ours: pa.Array, theirs: pa.Array) -> pa.Array:
        out = np.zeros(len(ours), np.int32)
        for i, row, found, _, _ in _common(ours, theirs):
            out[i + row] = found
        return pa.array(out)

    return F.when(a.isNotNull() & b.isNotNull(), common(a, F.array(b)))


def bag_f1(pred: Column, refs: Column) -> Column:
    """The largest F1 of an array of tokens over an array of such arrays; null without references.

    Tokens are cut once a text, outside; here they are counted in Arrow batches.
    """

    @F.arrow_udf("double")
    def best(ours: pa.Array, theirs: pa.Array) -> pa.Array:
        out = np.full(len(ours), -1.0)
        for i, row, found, n_pred, n_ref in _common(ours, theirs):
            both = n_pred + n_ref
            f1 = np.where(both == 0, 1.0, 2.0 * found / np.maximum(both, 1))
            np.maximum.at(out, i + row, f1)
        return pa.array(out, mask=out < 0)

    return best(pred, refs)


def f1_of(common: Column, n_pred: Column, n_ref: Column) -> Column:
    """Harmonic mean of precision and recall; 1 where both sides are empty, 0 where one is."""
    return F.when((n_pred == 0) & (n_ref == 0), 1.0).when(common == 0, 0.0).otherwise(2.0 * common / (n_pred + n_ref))


def token_f1(pred: Column, ref: Column, tokens: Callable[[Column], Column] = bag) -> Column:
    """Bag-of-tokens F1 of two texts (normalise them first); ``per_character`` suits scripts without spaces."""
    return bag_f1(tokens(pred), F.array(tokens(ref)))


def token_f1_any(pred: Column, refs: Column, tokens: Callable[[Column], Column] = bag) -> Column:
    """The largest ``token_f1`` over an array of references."""
    return bag_f1(tokens(pred), F.transform(refs, tokens))


def set_f1(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets; an empty prediction has precision 0, or 1 if nothing is sought."""
    a, b = F.array_distinct(pred), F.array_distinct(gold)
    common = F.size(F.array_intersect(a, b)).cast("double")
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    part = lambda n: F.when(both_empty, 1.0).when(n == 0, 0.0).otherwise(common / n)
    return part(F.size(a)), part(F.size(b)), f1_of(common, F.size(a), F.size(b))


def contains_any(pred: Column, refs: Column) -> Column:
    """1.0 where a reference stands in the prediction, whatever the case."""
    return F.exists(refs, lambda r: F.contains(F.lower(pred), F.lower(r))).cast("double")


def contains_fraction(pred: Column, refs: Column) -> Column:
    """Share of the references that stand in the prediction; null without references."""
    found = F.size(F.filter(refs, lambda r: F.contains(F.lower(pred), F.lower(r))))
    return F.when(F.size(refs) > 0, found / F.size(refs))


def lower_words(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def rouge1(pred: Column, ref: Column) -> Column:
    """Unigram F1 over lower-cased words of letters and digits."""
    return token_f1(pred, ref, lower_words)


def rouge1_any(pred: Column, refs: Column) -> Column:
    """The largest ``rouge1`` over an array of references; null without references."""
    return token_f1_any(pred, refs, lower_words)


def rolling_likelihood(responses: DataFrame) -> DataFrame:
    """Adds words and bytes of the text, beside its loglik."""
    return responses.withColumn("words", F.size(bag(F.col("text"))).cast("long")).withColumn("bytes", F.octet_length("text").cast("long"))


def minimal_pair_pref(responses: DataFrame, by: Sequence[str], keys: Sequence[str] = ITEM) -> DataFrame:
    """by, share, n: how often the good sentence (idx 0) is likelier than the bad one; ties count for the good one."""
    good = acc(responses.withColumn("gold", F.lit(0)), [*keys, *[b for b in by if b not in keys]])
    return good.groupBy(*by).agg(F.avg("value").alias("share"), F.count("value").alias("n"))


def greedy_acc(is_greedy: Column) -> Column:
    """Share of targets that were the greedy continuation (an aggregate)."""
    return F.avg(is_greedy.cast("double"))


def target_perplexity(loglik: Column) -> Column:
    """exp of the negative mean log-likelihood (an aggregate)."""
    return F.exp(-F.avg(loglik))
