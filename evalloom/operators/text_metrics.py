"""Corpus metrics of generated text: sums of statistics first, one formula over the sums last.

A prediction may have several references. N-grams are counted for many rows at once: each is a number (a rolling hash of its words or characters under its
row), and one sort of all numbers gives every count, without a dictionary for each row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass
from math import isqrt
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators.metrics import bootstrap
from evalloom.plans.staging import staged

# Fixed value: white space of Python that is none in Unicode.
_WORD = re.compile(r"(?:\S|[\x1c-\x1f])+")
#: Rows, and characters, that are counted at once (their numbers fit a core's cache); a longer text is counted alone.
ROWS, UNITS = 256, 1 << 15
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Statistics of rows: predictions and the references of each to an array (rows, numbers).
Statistics = Callable[[list[str], list[list[str]]], np.ndarray]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def key_bits(rows: int, sides: int) -> tuple[np.uint64, np.uint64]:
    """How many bits of a key of (row, n-gram, side) belong to the n-gram and to the side."""
    side_bits = (max(sides, 2) - 1).bit_length()
    return np.uint64(64 - side_bits - max(1, (rows - 1).bit_length())), np.uint64(side_bits)


def hits(keys: np.ndarray, rows: int, kept: np.uint64, side_bits: np.uint64) -> np.ndarray:
    """For each row, how many n-grams of side 0 one other side has too, from keys of (row, n-gram, side) in any order."""
    if not len(keys):
        return np.zeros(rows, np.int64)
    keys = np.sort(keys)
    grams = keys >> side_bits
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    if side_bits == 1:  # two sides: what is not of one is of the other
        theirs = np.add.reduceat((keys & np.uint64(1)).astype(np.int64), first)
        ours = np.diff(np.append(first, len(keys))) - theirs
        return np.bincount((grams[first] >> kept).astype(np.int64), np.minimum(ours, theirs), rows).astype(np.int64)
    cells = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count, of = np.diff(np.append(cells, len(keys))), keys[cells] & ((np.uint64(1) << side_bits) - np.uint64(1))
    begin = np.searchsorted(cells, first)
    ours, theirs = np.add.reduceat(np.where(of == 0, count, 0), begin), np.maximum.reduceat(np.where(of > 0, count, 0), begin)
    return np.bincount((grams[first] >> kept).astype(np.int64), np.minimum(ours, theirs), rows).astype(np.int64)


def clipped(row: np.ndarray, side: np.ndarray, gram: np.ndarray, rows: int) -> np.ndarray:
    """For each row, how many n-grams of side 0 one other side has too: each counts as often as side 0 and the side with most of it have it."""
    kept, side_bits = key_bits(rows, int(side.max()) + 1 if len(side) else 1)
    keys = (((row.astype(np.uint64) << kept) | (gram >> (np.uint64(64) - kept))) << side_bits) | side.astype(np.uint64)
    return hits(keys, rows, kept, side_bits)


def gram_hits(texts: list[np.ndarray], row: list[int], side: list[int], rows: int, order: int) -> np.ndarray:
    """(rows, order): clipped n-grams of every length. ``texts`` are sequences of 64-bit numbers, each of a row and a side (0 the prediction)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    units = np.concatenate([np.zeros(0, np.uint64), *texts])
    kept, side_bits = key_bits(rows, max(side, default=0) + 1)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    place = np.repeat((np.array(row, np.uint64) << (kept + side_bits)) | np.array(side, np.uint64), sizes)
    out, h = np.zeros((rows, order), np.int64), np.zeros(len(units), np.uint64)
    for n in range(1, order + 1):
        left = max(0, len(units) - n + 1)
        h = mixed(h[:left] * _STEP + units[n - 1 :] + np.uint64(n))
        keys = place[:left] | (h >> (np.uint64(64) - kept) << side_bits)
        out[:, n - 1] = hits(keys[own[:left] == own[n - 1 :]], rows, kept, side_bits)
    return out


def word_numbers(texts: list[str]) -> list[np.ndarray]:
    """Words of each text as numbers, equal for equal words."""
    known: dict[str, int] = {}
    return [np.fromiter((known.setdefault(w, len(known)) for w in _WORD.findall(t)), np.uint64) for t in texts]


def characters(texts: list[str]) -> list[np.ndarray]:
    """Code points of each text, without white space."""
    return [np.frombuffer("".join(t.split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in texts]


def bleu_counts(preds: list[str], refs: list[list[str]], order: int = 4) -> np.ndarray:
    """For each order: n-grams of the prediction that one reference has too, and all; then the prediction's length and that of the reference next in length
    (the shorter one of two; 0 without references)."""
    flat = [*preds, *(r for own in refs for r in own)]
    row = [*range(len(preds)), *(i for i, own in enumerate(refs) for _ in own)]
    side = [0] * len(preds) + [k for own in refs for k in range(1, len(own) + 1)]
    texts = word_numbers(flat)
    hits, sizes = gram_hits(texts, row, side, len(preds), order), np.array([len(t) for t in texts], np.int64)
    near, ours = np.zeros(len(preds), np.int64), sizes[: len(preds)]
    for i, size in sorted(zip(row[len(preds) :], sizes[len(preds) :].tolist(), strict=True), key=lambda x: (x[0], -x[1])):
        if not near[i] or abs(size - ours[i]) <= abs(near[i] - ours[i]):
            near[i] = size
    out = np.empty((len(preds), 2 * order + 2))
    for n in range(order):
        out[:, 2 * n], out[:, 2 * n + 1] = hits[:, n], np.maximum(0, ours - n)
    out[:, -2], out[:, -1] = ours, near
    return out


def measured(statistics: Statistics, pred: Column, refs: Column) -> Column:
    """Statistics of each prediction and its references (an array), worked out in Arrow batches; null texts are empty, a null array has no references."""

    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for preds, refs in batches:
            held = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(refs), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            upto, theirs = (np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(x), 0).to_numpy(zero_copy_only=False))]).astype(np.int64) for x in (preds, refs.flatten()))
            upto += theirs[held]
            out: list[np.ndarray] = []
            i = 0
            while i < len(preds):  # only these rows' texts are Python's at a time
                j = max(i + 1, min(i + ROWS, int(np.searchsorted(upto, upto[i] + UNITS, "right")) - 1))
                out.append(statistics([p or "" for p in preds[i:j].to_pylist()], [[r or "" for r in own or []] for own in refs[i:j].to_pylist()]))
                i = j
            values = np.concatenate(out) if out else np.zeros((0, 1))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), pa.float64()))

    return measure(pred, refs)


def references(rows: DataFrame, ref: str) -> Column:
    """The references as an array; a text column is one reference."""
    return F.col(ref) if isinstance(rows.schema[ref].dataType, T.ArrayType) else F.array(ref)


def bleu_names(order: int) -> list[str]:
    return [f"{k}_{n}" for n in range(1, order + 1) for k in ("match", "total")] + ["pred_len", "ref_len"]


def bleu_statistics(rows: DataFrame, pred: str, ref: str, order: int = 4) -> DataFrame:
    """Adds match_1, total_1 .. (clipped and all n-grams of the prediction), pred_len, ref_len. ``ref`` is a text or an array of texts."""
    counted = rows.withColumn("_v", measured(lambda p, r: bleu_counts(p, r, order), F.col(pred), references(rows, ref)))
    return counted.withColumns({x: F.get("_v", F.lit(i)).cast("long") for i, x in enumerate(bleu_names(order))}).drop("_v")


def bleu_of(order: int = 4, add: int = 0, total: Callable[[str], Column] = F.col) -> Column:
    """Geometric mean of precisions times brevity penalty; ``add`` is added to counts above unigrams."""
    parts = []
    zero = total("pred_len") == 0
    for n in range(1, order + 1):
        up, down = total(f"match_{n}") + (add if n > 1 else 0), total(f"total_{n}") + (add if n > 1 else 0)
        zero = zero | (up == 0) | (down == 0)
        parts.append(F.log(up / down))
    penalty = F.least(F.lit(0.0), 1 - total("ref_len") / total("pred_len"))
    return F.when(zero, 0.0).otherwise(F.exp(sum(parts[1:], parts[0]) / order + penalty))


def bleu(rows: DataFrame, pred: str, ref: str, by: Sequence[str], order: int = 4) -> DataFrame:
    """by, bleu (0 to 1) of the whole corpus: counts and lengths are summed, then combined."""
    stats = bleu_statistics(rows, pred, ref, order)
    return stats.groupBy(*by).agg(*[F.sum(x).alias(x) for x in bleu_names(order)]).select(*by, bleu_of(order).alias("bleu"))


def bootstrap_bleu(rows: DataFrame, pred: str, ref: str, by: Sequence[str], key: str = "doc_id", order: int = 4, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """by, stderr, n: standard error of the corpus BLEU. Counts of each row are worked out once and weighed in all replicates."""
    stats = staged(bleu_statistics(rows, pred, ref, order).select(*by, key, *bleu_names(order)), "bleu-counts")
    return bootstrap(stats, by, {x: F.col(x) for x in bleu_names(order)}, bleu_of(order), key, replicates, seed)


def smoothed_bleu_4(rows: DataFrame, pred: str, ref: str, by: Sequence[str]) -> DataFrame:
    """by, bleu: the mean of sentence scores with one added to counts above unigrams."""
    return bleu_statistics(rows, pred, ref).withColumn("_s", bleu_of(add=1)).groupBy(*by).agg(F.avg("_s").alias("bleu"))


def chrf_scores(counts: np.ndarray, beta: float = 2.0) -> np.ndarray:
    """F score (0 to 1) of each row of counts (matches, n-grams of prediction and reference, order by order): mean precision and mean recall
    over the orders that occur on both sides."""
    match, ours, theirs = counts[:, ::3], counts[:, 1::3], counts[:, 2::3]
    there = (ours > 0) & (theirs > 0)
    used = np.maximum(there.sum(1), 1)
    precision, recall = ((np.where(there, match / np.maximum(side, 1), 0)).sum(1) / used for side in (ours, theirs))
    weight = beta * beta
    return (1 + weight) * precision * recall / np.where(precision + recall > 0, weight * precision + recall, 1)


def chrf_counts(preds: list[str], refs: list[list[str]], order: int = 6, beta: float = 2.0) -> np.ndarray:
    """For each order: matches, n-grams of the prediction, n-grams of the reference; white space is left out.

    Of several references that with the best score of its own counts (ties: the first one); without references the prediction's n-grams alone.
    """
    pairs = [(i, r) for i, own in enumerate(refs) for r in own]
    ours, theirs = characters(preds), characters([r for _, r in pairs])
    size = lambda parts: np.maximum(0, np.array([len(t) for t in parts], np.int64)[:, None] - np.arange(order)).reshape(-1, order)
    found, other = size(theirs), [k for k, (i, r) in enumerate(pairs) if preds[i] != r]  # equal texts have all n-grams in common
    texts = [ours[pairs[k][0]] for k in other] + [theirs[k] for k in other]
    found[other] = gram_hits(texts, [*range(len(other))] * 2, [0] * len(other) + [1] * len(other), len(other), order)
    table = np.stack([found, size([ours[i] for i, _ in pairs]), size(theirs)], 2).reshape(-1, 3 * order).astype(float)
    out = np.stack([np.zeros((len(preds), order)), size(ours), np.zeros((len(preds), order))], 2).reshape(-1, 3 * order)
    best = np.full(len(preds), -1.0)
    for (i, _), score, row in zip(pairs, chrf_scores(table, beta).tolist(), table, strict=True):
        if score > best[i]:
            best[i], out[i] = score, row
    return out


def _added(rows: DataFrame, pred: str, ref: str, by: Sequence[str], width: int, statistics: Statistics) -> DataFrame:
    """by, s0.. : sums of each row's statistics."""
    values = rows.select(*by, measured(statistics, F.col(pred), references(rows, ref)).alias("_v"))
    return values.groupBy(*by).agg(*[F.sum(F.get("_v", F.lit(i))).alias(f"s{i}") for i in range(width)])


def chrf(rows: DataFrame, pred: str, ref: str, by: Sequence[str], order: int = 6, beta: float = 2.0) -> DataFrame:
    """by, chrf (0 to 1) of the whole corpus."""
    sums = _added(rows, pred, ref, by, 3 * order, lambda p, r: chrf_counts(p, r, order, beta))
    part = [tuple(F.col(f"s{3 * i + k}") for k in range(3)) for i in range(order)]
    there = [(p > 0) & (r > 0) for _, p, r in part]
    used = sum((F.when(t, 1).otherwise(0) for t in there[1:]), F.when(there[0], 1).otherwise(0))
    mean = lambda k: sum((F.when(t, x[0] / x[k]).otherwise(0.0) for t, x in zip(there[1:], part[1:], strict=True)), F.when(there[0], part[0][0] / part[0][k]).otherwise(0.0)) / used
    precision, recall, weight = mean(1), mean(2), beta * beta
    return sums.select(*by, F.when((used == 0) | (precision + recall == 0), 0.0).otherwise((1 + weight) * precision * recall / (weight * precision + recall)).alias("chrf"))


@dataclass
class Table:
    """Edit distances between beginnings of word lists, a column at a time in bits (Myers 1999).

    A state stands for all distances of one beginning of ``a`` to every beginning of ``b``: two integers of len(b) bits say where they rise and fall by one. A word more
    costs a few integer operations; every ``EVERY``-th state is kept, so n words against m take about n * m / (4 * EVERY) bytes.
    """

    EVERY: ClassVar[int] = 32
    a: list[Hashable]
    b: list[Hashable]

    def __post_init__(self) -> None:
        self.places: dict[Hashable, int] = {}
        for j, w in enumerate(self.b):
            self.places[w] = self.places.get(w, 0) | 1 << j
        self.full = (1 << len(self.b)) - 1
        self.kept = [(self.full, 0)]
        self.change(self.a, 0)

    def change(self, a: list[Hashable], same: int) -> None:
        """Other words for ``a``, of which the first ``same`` are as before."""
        self.a, self.kept = a, self.kept[: same // self.EVERY + 1]
        for i in range((len(self.kept) - 1) * self.EVERY, len(a), self.EVERY):
            self.kept.append(self.after(self.kept[-1], a[i : i + self.EVERY]))

    def after(self, state: tuple[int, int], words: Sequence[Hashable]) -> tuple[int, int]:
        up, down = state
        full, places = self.full, self.places
        for w in words:
            eq = places.get(w, 0)
            same = eq | down
            carry = (((eq & up) + up) ^ up) | eq
            rise, fall = ((down | ~(carry | up) & full) << 1 | 1) & full, (up & carry) << 1 & full
            up, down = fall | ~(same | rise) & full, rise & same
        return up, down

    def at(self, i: int) -> tuple[int, int]:
        """The state after ``i`` words."""
        k = i // self.EVERY
        return self.after(self.kept[k], self.a[k * self.EVERY : i])

    def distances(self, state: tuple[int, int], i: int) -> np.ndarray:
        """Distances of a beginning of ``i`` words to the beginnings of ``b`` of 0, 1 .. words."""
        bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(len(self.b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(self.b)].astype(np.int32)
        return i + np.concatenate([[0], np.cumsum(bits(state[0]) - bits(state[1]))])


def edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Least insertions, deletions and substitutions that turn ``a`` into ``b``."""
    table = Table(list(a), list(b))
    return int(table.distances(table.at(len(table.a)), len(table.a))[-1])


def aligned(a: Sequence[int], b: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which words of each side a longest common subsequence leaves unmatched: words match where they can, else ``a`` goes on if that costs nothing.

    The lengths of common subsequences of the ends of both lists are kept in bits (a row adds one where a bit is 0). Rows are worked out from the end, every
    root-of-n-th is kept, and those between two of them are worked out again on the way back: n words against m take about sqrt(n) * m / 4 bytes.
    """
    places: dict[int, int] = {}
    for j, w in enumerate(reversed(b)):
        places[w] = places.get(w, 0) | 1 << j
    full, step = (1 << len(b)) - 1, max(1, isqrt(len(a)))

    def before(row: int, w: int) -> int:
        both = row & places.get(w, 0)
        return ((row + both) | (row - both)) & full

    kept = {len(a): full}
    row = full
    for i in range(len(a) - 1, -1, -1):
        row = before(row, a[i])
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}
    length = lambda i, j: (len(b) - j) - (rows[i] & ((1 << (len(b) - j)) - 1)).bit_count()
    loose_a, loose_b, i, j = np.ones(len(a), bool), np.ones(len(b), bool), 0, 0
    while i < len(a) and j < len(b):
        if i + 1 not in rows:
            top = min(len(a), i - i % step + step)
            rows = {top: kept[top]}
            for k in range(top - 1, i - 1, -1):
                rows[k] = before(rows[k + 1], a[k])
        if a[i] == b[j]:
            loose_a[i] = loose_b[j] = False
            i, j = i + 1, j + 1
        elif length(i + 1, j) == length(i, j):
            i += 1
        else:
            j += 1
    return loose_a, loose_b


class Runs:
    """Places of all runs of up to ``most`` words in a list, as sorted (run, place) pairs for each length."""

    def __init__(self, words: np.ndarray, most: int):
        self.size, self.keys = len(words), []
        for names in self.named(words, most):
            runs, code = np.unique(names, return_inverse=True)
            self.keys.append((runs, np.sort(code * np.int64(self.size + 1) + np.arange(len(names)))))

    @staticmethod
    def named(words: np.ndarray, most: int) -> Iterator[np.ndarray]:
        h = np.zeros(len(words), np.uint64)
        for n in range(1, min(most, len(words)) + 1):
            h = mixed(h[: len(words) - n + 1] * _STEP + words[n - 1 :].astype(np.uint64) + np.uint64(n))
            yield h

    def near(self, words: np.ndarray, most: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, i, at: runs of n words at i of ``words`` that stand at ``at`` in the list, at most ``reach`` apart; longest runs first, then in order."""
        for n, names in reversed([*enumerate(self.named(words, min(most, len(self.keys))), 1)]):
            runs, keys = self.keys[n - 1]
            place = np.minimum(np.searchsorted(runs, names), len(runs) - 1)
            i = np.flatnonzero(runs[place] == names)
            if not len(i):
                continue
            base = place[i] * np.int64(self.size + 1)
            low, high = np.searchsorted(keys, base + np.maximum(i - reach, 0)), np.searchsorted(keys, base + np.minimum(i + reach, self.size), "right")
            many = np.maximum(high - low, 0)  # places beyond the list's end have none
            at = keys[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())] - np.repeat(base, many)
            yield n, np.repeat(i, many), at


def shifted(words: list[int], i: int, n: int, at: int) -> tuple[int, list[int], int]:
    """What changes when the run of ``n`` words at ``i`` goes to ``at`` of the others: where it begins, the words there now, and where the rest goes on."""
    run = words[i : i + n]
    if at < i:
        return at, run + words[at:i], i + n
    return i, words[i + n : at + n] + run, min(at + n, len(words))


def ter_counts(pred: str, ref: str, max_shift: int = 10, max_distance: int = 50, max_tries: int = 20_000) -> list[float]:
    """Edits with shifts of word runs, and words of the reference.

    Greedy: while a shift of a run saves edits, the best one is made (longest run first on ties). A run is tried only where the reference has it too and
    where both the run and that place hold a word that is unmatched so far. What a shift saves is worked out from the states of the two edit tables, from the front and
    from the back, where the shifted part begins and ends, so it costs the words in between and not the whole lists. A pair has ``max_tries`` tries in all
    (a parameter of the metric, as in its published form); of more, those whose runs have most unmatched words are made. Shifts keep the words and their
    numbers, so no shift brings the edits below the longer side's words less the common ones; where one edit at most is left above that, none is tried.
    """
    first, second = pred.split(), ref.split()
    if first == second:
        return [0.0, float(len(second))]
    same, most = 0, min(len(first), len(second))
    while same < most and first[same] == second[same]:
        same += 1
    last = 0
    while last < most - same and first[-1 - last] == second[-1 - last]:
        last += 1
    inner, outer = first[same : len(first) - last], second[same : len(second) - last]
    cost, moves, tries = edits(inner, outer), 0, 0
    least = max(len(inner), len(outer)) - (Counter(inner) & Counter(outer)).total()
    if cost - least > 1:
        known: dict[str, int] = {}
        words, target = ([known.setdefault(w, len(known)) for w in side] for side in (first, second))
        front, back, runs = Table(words, target), Table(words[::-1], target[::-1]), Runs(np.array(target, np.int64), max_shift)
    while cost - least > 1 and tries < max_tries:
        loose, open_ = (np.concatenate([[0], np.cumsum(x)]) for x in aligned(words, target))
        found = []
        for n, i, at in runs.near(np.array(words, np.int64), max_shift, max_distance):
            fits = (at != i) & (loose[i + n] > loose[i]) & (open_[at + n] > open_[at])
            if not fits.any():
                continue
            found.append(np.stack([np.full(fits.sum(), n), i[fits], at[fits], (loose[i + n] - loose[i])[fits]], 1))
        table = np.concatenate([np.zeros((0, 4), np.int64), *found])
        order = np.arange(len(table))
        if len(table) > max_tries - tries:
            order = np.sort(np.argsort(-table[:, 3], kind="stable")[: max_tries - tries])
        tries += len(order)
        best = None
        for k in order[np.argsort(np.minimum(table[order, 1], table[order, 2]), kind="stable")].tolist():
            begin, middle, end = shifted(words, *(int(x) for x in table[k, [1, 0, 2]]))
            state = front.after(front.at(begin), middle)
            rest = len(words) - end
            now = int((front.distances(state, begin + len(middle)) + back.distances(back.at(rest), rest)[::-1]).min())
            if cost - now > 1 and (best is None or (now, k) < best[:2]):
                best = (now, k, words[:begin] + middle + words[end:], begin, rest)
        if best is None:
            break
        moves, cost, words = moves + 1, best[0], best[2]
        front.change(words, best[3])
        back.change(words[::-1], best[4])
    return [float(moves + cost), float(len(second))]


def ter_statistics(preds: list[str], refs: list[list[str]]) -> np.ndarray:
    """Edits to the reference that needs fewest, and the mean words of a row's references; without references all words are edits."""
    out = []
    for p, own in zip(preds, refs, strict=True):
        counts = [ter_counts(p, r) for r in own] or [[float(len(p.split())), 0.0]]
        out.append([min(c[0] for c in counts), sum(c[1] for c in counts) / len(counts)])
    return np.array(out).reshape(-1, 2)


def ter(rows: DataFrame, pred: str, ref: str, by: Sequence[str]) -> DataFrame:
    """by, ter: edits over words of the references, in the whole corpus; null without reference words."""
    return _added(rows, pred, ref, by, 2, ter_statistics).select(*by, (F.col("s0") / F.nullif(F.col("s1"), F.lit(0.0))).alias("ter"))
