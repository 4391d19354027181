"""Quality classification by co-training two views of a document.

The text view is the distribution of hashed byte trigrams of the whole text; the metadata view is language, source and size class.
Each view has a logistic classifier. In every round each classifier labels the unlabelled documents it is sure of, all of them in the
corpus, and hands them to the other one; then both take a Newton step over the labelled rows and what they were handed. The tasks
add up the gradients and Hessians of their rows, so the exchange has no bound in rows, and a tree of sums brings them together. Rows
handed over weigh in sum at most HANDED_WEIGHT times the labelled rows of their class.
On labelled rows set aside, each view's margin is calibrated and the two are combined by a logistic curve, which scores all documents.

Labelled rows are a bounded sample (``max_per_class`` a class); every other row is unlabelled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import labelled_ids, text_of
from evalloom.plans.staging import staged

TEXT_DIMS, META_DIMS = 512, 256
_STEP = 1 << 22
HANDED_WEIGHT = 10.0
META = ("lang", "source", "n_chars")


def text_view(text: str | None, dims: int = TEXT_DIMS) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams; a vector of length 1, or 0 for under three bytes."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(dims, np.int64)
    for i in range(0, max(0, len(data) - 2), _STEP):
        part = data[i : i + _STEP + 2].astype(np.uint32)
        code = part[:-2] * np.uint32(0x9E3779B1) ^ part[1:-1] * np.uint32(0x85EBCA77) ^ part[2:] * np.uint32(0xC2B2AE3D)
        code ^= code >> np.uint32(15)
        counts += np.bincount(code * np.uint32(0x27D4EB2F) >> np.uint32(32 - (dims.bit_length() - 1)), minlength=dims)
    return np.sqrt(counts / max(1, counts.sum()))


def meta_view(lang: object, source: object, n_chars: int | None, dims: int = META_DIMS) -> np.ndarray:
    out = np.zeros(dims)
    for part in (f"lang={lang}", f"source={source}", f"size={int(n_chars or 0).bit_length()}"):
        out[xxhash.xxh32_intdigest(part) % dims] += 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, center: float = 0.0) -> np.ndarray:
    """Weights and, last, the intercept: Newton's method on the logistic loss with a ridge around ``center``."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    middle = np.full(design.shape[1], center)
    w = middle.copy()
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        move = np.linalg.solve(hessian, design.T @ (p - y) + penalty * (w - middle))
        w -= move * min(1.0, 8.0 / max(np.abs(design @ move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def chance(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -40, 40)))


@dataclass(frozen=True)
class QualityModel:
    text: np.ndarray
    meta: np.ndarray
    combine: np.ndarray
    exchanged: tuple[int, int] = (0, 0)

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return chance(margin(np.stack([margin(text, self.text), margin(meta, self.meta)], 1), self.combine))


Weights = list[np.ndarray]
Views = tuple[np.ndarray, np.ndarray]


def handed_over(views: Views, weights: Weights, confidence: float) -> np.ndarray:
    """What both views are handed, in one array that adds up over rows: for each taking view and label 0 and 1 the
    number of rows, the gradient, and the upper triangle of the Hessian of the logistic loss at the taker's weights."""
    parts = []
    for taker in (0, 1):
        p = chance(margin(views[1 - taker], weights[1 - taker]))
        for label in (0, 1):
            x = views[taker][(p if label else 1 - p) >= confidence]
            x = np.hstack([x, np.ones((len(x), 1))])
            q = chance(x @ weights[taker])
            parts += [[len(x)], x.T @ (q - label), ((x * (q * (1 - q))[:, None]).T @ x)[np.triu_indices(x.shape[1])]]
    return np.concatenate(parts)


def taken(sums: np.ndarray, sizes: list[int]) -> list[list[tuple[float, np.ndarray, np.ndarray]]]:
    """``handed_over`` apart again, for views of ``sizes`` weights: per view and label the rows, the gradient, the Hessian."""
    out, at = [], 0
    for d in sizes:
        out.append([])
        for _ in (0, 1):
            half = np.zeros((d, d))
            half[np.triu_indices(d)] = sums[at + 1 + d : at + 1 + d + d * (d + 1) // 2]
            out[-1].append((sums[at], sums[at + 1 : at + 1 + d], half + np.triu(half, 1).T))
            at += 1 + d + d * (d + 1) // 2
    return out


def newton_step(w: np.ndarray, x: np.ndarray, y: np.ndarray, handed: list[tuple[float, np.ndarray, np.ndarray]], ridge: float) -> np.ndarray:
    """One step from ``w`` over labelled rows and rows handed over, the latter scaled to HANDED_WEIGHT times the labelled rows of their class at most."""
    design, penalty = np.hstack([x, np.ones((len(x), 1))]), np.full(len(w), ridge)
    penalty[-1] = 1e-6
    p = chance(design @ w)
    gradient, hessian = design.T @ (p - y) + penalty * w, (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
    for label, (n, g, h) in enumerate(handed):
        scale = min(1.0, HANDED_WEIGHT * (y == label).sum() / n) if n else 0.0
        gradient, hessian = gradient + scale * g, hessian + scale * h
    move = np.linalg.solve(hessian, gradient)
    return w - move * min(1.0, 8.0 / max(np.abs(design @ move).max(), 1e-12))


def cotrain(views: Views, y: np.ndarray, gather: Callable[[Weights], np.ndarray], rounds: int = 4, ridge: float = 0.1) -> QualityModel:
    """Fits both views on four fifths of the rows, exchanges ``rounds`` times, fits the combination on the last fifth.

    ``gather`` sums ``handed_over`` over all unlabelled rows.
    """
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    weights = [fit_logistic(v[~aside], y[~aside], ridge) for v in views]
    exchanged = (0, 0)
    for _ in range(rounds):
        handed = taken(gather(weights), [len(w) for w in weights])
        if not any(n for view in handed for n, _, _ in view):
            break
        exchanged = (int(sum(n for n, _, _ in handed[1])), int(sum(n for n, _, _ in handed[0])))
        weights = [newton_step(w, v[~aside], y[~aside], h, ridge) for w, v, h in zip(weights, views, handed, strict=True)]
    held = aside if aside.any() else ~aside
    margins = np.stack([margin(v[held], w) for v, w in zip(views, weights, strict=True)], 1)
    return QualityModel(weights[0], weights[1], fit_logistic(margins, y[held], 1.0, center=1.0), exchanged)


def views_of(batch: pa.RecordBatch, step: int = 1024) -> Iterator[Views]:
    """Both views of the rows, some rows at a time."""
    metas = list(zip(*(batch.column(c).to_pylist() for c in META), strict=True))
    for i in range(0, batch.num_rows, step):
        yield np.array([text_view(t.as_py()) for t in batch.column("text").slice(i, step)]), np.array([meta_view(*m) for m in metas[i : i + step]])


def gathered(pool: DataFrame, weights: Weights, confidence: float) -> np.ndarray:
    """``handed_over`` summed over all rows of ``pool``: an array a partition, added up in a tree of tasks."""
    shared = pool.sparkSession.sparkContext.broadcast(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = handed_over((np.zeros((0, TEXT_DIMS)), np.zeros((0, META_DIMS))), shared.value, confidence)
        for batch in batches:
            for views in views_of(batch):
                total += handed_over(views, shared.value, confidence)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    none = handed_over((np.zeros((0, TEXT_DIMS)), np.zeros((0, META_DIMS))), weights, confidence)
    return pool.select("text", *META).mapInArrow(add, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums)).treeAggregate(none, np.add, np.add, 3)


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_view(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
        metas = [meta_view(*m).astype(np.float32).tobytes() for m in zip(*(batch.column(c).to_pylist() for c in META), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(texts, pa.binary()), pa.array(metas, pa.binary())], ["y", "text_view", "meta_view"])


def _columns(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("_id"), text_of(text_column).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 4000, rounds: int = 4, confidence: float = 0.97, ridge: float = 0.1, id_column: str = "doc_id", text_column: str = "text") -> QualityModel | None:
    """Co-trains on ``labels.quality`` and all rows of ``docs``. None where the labels do not hold both classes.

    Of rows that repeat a labelled identifier the one with the smallest text hash is the labelled one.
    """
    rows = _columns(docs, id_column, text_column)
    known = labelled_ids(labels, "quality", max_per_class)
    first = F.min(F.struct(F.xxhash64("text").alias("order"), "text", *META)).alias("row")
    sample = rows.join(F.broadcast(known), "_id").groupBy("_id", "y").agg(first).select("y", "row.*")  # 2 x max_per_class ids
    found = staged(sample.select("y", "text", *META).mapInArrow(_view_rows, "y int, text_view binary, meta_view binary"), "quality-views").toArrow()
    y = found.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    texts, metas = ([bytes(x) for x in found.column(c).to_pylist()] for c in ("text_view", "meta_view"))
    order = sorted(range(len(y)), key=lambda i: (xxhash.xxh32_intdigest(texts[i]), texts[i], metas[i], y[i]))  # deals classes and sources evenly
    views = tuple(np.frombuffer(b"".join(part[i] for i in order), np.float32).reshape(len(y), -1).astype(float) for part in (texts, metas))
    pool = rows.join(F.broadcast(known), "_id", "left_anti")
    return cotrain(views, y[order], lambda weights: gathered(pool, weights, confidence), rounds, ridge)


def classify(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (probability of high quality), predicted, kept (from ``threshold`` on).

    Null and empty texts have no trigrams and are scored by intercept and metadata; null metadata is a value like others. Without a
    model (no labels to learn from) every score is 0.5. Repeated rows get equal scores. Other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                out = np.concatenate([model.probability(*views) for views in views_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out)], ["doc_id", "score"])

    scored = _columns(docs, id_column, text_column).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("kept"))
