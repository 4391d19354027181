"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding undoes disguises: lower case, accents and letters of other shapes (compatibility forms), look-alike letters of other
scripts, digits and signs that stand for letters, zero-width characters, words spelt out letter by letter. A lexicon entry is a word or a word beginning with a weight; exception phrases
cancel the hits inside them. The sum of weights, divided by the logarithm of the text's length in words, goes
through a fitted logistic curve to a score from 0 to 1.

Entries and weights are learned from labelled rows: beginnings of 4 to 8 letters and whole words that stand in
toxic texts far more often than in clean ones (likelihood-ratio test over document counts). Exceptions are learned too: an entry's word with
its neighbour, where the two stand far more often in clean texts. Part of the labelled rows is kept from the lexicon, and the curve is fitted on it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evalloom.llm.common import labelled_ids, text_of
from evalloom.plans.staging import staged

# Look-alike letters of Cyrillic and Greek and the Latin letter each is folded to.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
# Plain insults with a weight, which holds for a word that no labelled text has; others get the weight that the labels give them.
SEED_LEXICON = {w: 3.0 for w in ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")}
# Harmless phrases that hold a seed word.
EXCEPTIONS = ("trash can", "trash bag", "circus clown", "clown fish", "loser bracket")

_TABLE = str.maketrans(HOMOGLYPHS | SUBSTITUTES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys("​‌‍⁠﻿­", ""))
#: Texts whose patterns a task counts at once.
TEXTS_AT_ONCE = 200
_GAPS = re.compile(r"[\W_]+")
_MARKS = re.compile(r"[\u0300-\u036f]+")
_SPELT = re.compile(r"(?<= )(?:\w ){3,}")


def fold_text(text: str) -> str:
    """Folded words with a space before, between and after them; three or more single letters in a row become a word."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    folded = f" {_GAPS.sub(' ', text.lower().translate(_TABLE)).strip()} "
    return _SPELT.sub(lambda m: m[0].replace(" ", "") + " ", folded)


@dataclass(frozen=True)
class ToxicityModel:
    """Patterns (a leading space; a trailing one for whole words) with weights, exceptions, and the curve."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    intercept: float = -3.0
    report: dict = field(default_factory=dict, compare=False)

    def matcher(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for pattern, weight in self.lexicon.items():
            automaton.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            automaton.add_word(folded := fold_text(phrase), (len(folded), None))
        automaton.make_automaton()
        return automaton

    def hits(self, automaton: ahocorasick.Automaton, folded: str) -> dict[int, float]:
        """Place of each word hit (the space before it) and the weight of its heaviest entry; those in exception phrases are left out."""
        hits: dict[int, float] = {}
        if not len(automaton):
            return hits
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        if not spared or not hits:
            return hits
        spared.sort()
        upto, out = 0, {}  # end of the phrases that begin at or before a hit; a hit is spared if it stands before that end
        i = 0
        for start in sorted(hits):
            while i < len(spared) and spared[i][0] <= start:
                upto = max(upto, spared[i][1])
                i += 1
            if start >= upto:
                out[start] = hits[start]
        return out

    def strength(self, automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, int]:
        """Weights of the words hit over log2 of the length; how many were hit."""
        folded = fold_text(text or "")
        hits = self.hits(automaton, folded)
        return sum(hits.values()) / math.log2(folded.count(" ") + 1), len(hits)

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * strength))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """text and y of the rows that ``labelled_ids`` picks, staged; a text that several of them have counts once, with its largest label."""
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), text_of(text_column).alias("text"))
    picked = rows.join(F.broadcast(labelled_ids(labels, label, max_per_class)), "_id")  # 2 x max_per_class ids
    return staged(picked.groupBy("text").agg(F.max("y").alias("y")), f"{label}-sample")


def patterns_in(folded: str) -> set[str]:
    """Every word, and every word beginning of 4 to 8 letters."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in range(4, min(8, len(word)) + 1))
    return found


def neighbours(model: ToxicityModel, automaton: ahocorasick.Automaton, folded: str) -> set[str]:
    """Every word hit with the word before it and with the word after it."""
    found = set()
    for start in model.hits(automaton, folded):
        end = folded.index(" ", start + 1)
        if start > 0:
            found.add(folded[folded.rindex(" ", 0, start) : end + 1])
        if end < len(folded) - 1:
            found.add(folded[start : folded.index(" ", end + 1) + 1])
    return found


def _counted(sample: DataFrame, find: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    """pattern, toxic, clean: in how many texts of each class ``find()`` finds a pattern."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = find()
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    seen[y].update(patterns(fold_text(text)))
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], ["pattern", "toxic", "clean"])

    found = sample.select("text", "y").mapInArrow(count, "pattern string, toxic long, clean long")
    return found.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def likelihood_ratio(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """G2 of presence against class for a of n_a and b of n_b texts."""

    def part(observed: Column, row: Column, column: int) -> Column:
        return F.when(observed > 0, observed * F.log(observed * (n_a + n_b) / (row * column))).otherwise(F.lit(0.0))

    present, absent = a + b, F.lit(n_a + n_b) - (a + b)
    return 2 * (part(a, present, n_a) + part(b, present, n_b) + part(n_a - a, absent, n_a) + part(n_b - b, absent, n_b))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and intercept of a logistic curve, by Newton's method with a ridge on the slope."""
    w = np.array([1.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        gradient = design.T @ (p - y) + ridge * np.array([w[0], 0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-6])
        move = np.linalg.solve(hessian, gradient)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 8000, min_texts: int = 5, min_share: float = 0.01, min_g2: float = 22.0, exceptions: Sequence[str] = EXCEPTIONS) -> ToxicityModel:
    """Learns lexicon, exceptions and curve from at most ``max_per_class`` labelled rows a class.

    A fifth of their different texts, by hash, fits the curve; the others make the lexicon. All entries in ``min_texts`` toxic texts and ``min_share`` of
    them whose test value reaches ``min_g2`` are kept, so words that only a group of near copies has are not; the bounded sample bounds the lexicon.
    A seed word that occurs in the sample has the weight measured there, and none if it is not above 1.5. Without labels of both classes the seed lexicon and a default
    curve stand. Only texts and labels are read.
    """
    sample = labelled_sample(docs, labels, "toxic", max_per_class).withColumn("aside", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    sizes = {(r.aside, r.y): r.n for r in sample.groupBy("aside", "y").agg(F.count("*").alias("n")).collect()}
    seeds = {f" {w} ": weight for w, weight in SEED_LEXICON.items()}
    if len({y for _, y in sizes}) < 2:
        return ToxicityModel(seeds, tuple(exceptions))
    lexical = sample.where("NOT aside") if (False, 0) in sizes and (False, 1) in sizes else sample
    curve = sample.where("aside") if (True, 0) in sizes and (True, 1) in sizes else sample
    n_toxic, n_clean = (sum(n for (aside, y), n in sizes.items() if y == label and (lexical is sample or not aside)) for label in (1, 0))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    judged = lambda df: df.select("pattern", "toxic", "clean", weight.alias("weight"), likelihood_ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean).alias("g2"))
    frequent, seed = (F.col("toxic") >= min_texts) & (F.col("toxic") >= min_share * n_toxic), F.col("pattern").isin(list(seeds))
    found = judged(_counted(lexical, lambda: patterns_in).where(frequent | seed)).where(seed | ((F.col("weight") > 1.5) & (F.col("g2") >= min_g2)))
    rows = found.orderBy(F.desc("g2"), F.length("pattern"), "pattern").collect()
    lexicon = seeds | {r.pattern: r.weight for r in rows if r.pattern in seeds}
    lexicon = {p: w for p, w in lexicon.items() if w > 1.5}
    for row in rows:  # an entry adds nothing where a shorter one, as heavy, already matches
        if row.pattern not in seeds and not any(row.pattern.startswith(p) and lexicon.get(p, 0) >= row.weight - 0.7 for p in (row.pattern[:n] for n in range(5, len(row.pattern)))):
            lexicon[row.pattern] = row.weight
    model = ToxicityModel(lexicon, tuple(exceptions))

    def pairs() -> Callable[[str], set[str]]:
        automaton = model.matcher()
        return lambda folded: neighbours(model, automaton, folded)

    harmless = judged(_counted(lexical, pairs).where((F.col("clean") >= min_texts) & (F.col("clean") >= min_share * n_clean))).where(F.col("weight") < -1.5).where(F.col("g2") >= min_g2)
    model = ToxicityModel(lexicon, (*exceptions, *sorted(r.pattern.strip() for r in harmless.collect())))

    def strengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.matcher()
        for batch in batches:
            yield pd.DataFrame({"x": [model.strength(automaton, t)[0] for t in batch["text"]], "y": batch["y"]})

    points = curve.select("text", "y").mapInPandas(strengths, "x double, y int").toPandas()  # two numbers a sampled row
    slope, intercept = fit_curve(points["x"].to_numpy(float), points["y"].to_numpy(float))
    report = {"toxic": n_toxic, "clean": n_clean, "entries": len(lexicon), "exceptions": len(model.exceptions)}
    return ToxicityModel(lexicon, model.exceptions, slope, intercept, report)


def scores(model: ToxicityModel, text: Column) -> Column:
    """Score of each whole text; null and empty texts get the curve's value at no hits."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = model.matcher()
        for batch in batches:
            yield pd.Series([model.score(model.strength(automaton, t)[0]) for t in batch], dtype=float)

    return score(text)


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted (1 from ``threshold`` on).

    Repeated rows get equal scores; labels, languages, sources and identifiers never enter a score; other columns
    are not read. An empty table gives an empty result.
    """
    scored = docs.select(F.col(id_column).alias("doc_id"), scores(model, F.col(text_column)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``.

    Null and empty texts are scored as texts without hits; equal texts stay or go together, repeated rows as often as they occur. An empty table stays
    empty; other columns are not read and may have any names.
    """
    return docs.where(scores(model, F.col(text_column)) < threshold)
