"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ``order`` bytes with the counts of the bytes that follow each.
A byte is coded in the longest context that was seen; a byte new to that context costs an escape (method C: as
likely as the number of different bytes seen there) and is coded one context shorter, where the bytes of the
longer context are excluded. Below order 0 the bytes left over are equally likely.

Counting runs on Spark: tasks emit sums for their rows, and one aggregation adds them up, so what it gathers grows
with the corpus. The trie is pretrained, fixed while scoring, and kept whole as tables: nodes (context, byte) and contexts of every
order. The most frequent nodes of the longest contexts are broadcast with their probabilities, a bounded number; the workers score
most bytes with them at once. Bytes not among them (rare nodes, and all that need an escape) leave as (row, code) with
the times they occur; each different code is looked up in the tables by joins, order by order, so no node is lost at any size.

Words and one end a text are the events: the bytes scored are those of the words, lower-cased in A-Z, joined by
spaces, with a line feed as end. A text's probability is thus comparable with that of a unigram model.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import text_of
from evalloom.plans.staging import staged

END = 10
#: Stands for the end of a text among the words, none of which is empty.
END_WORD = b""
#: Bytes of text worked on at once while counting and while scoring.
COUNT_PIECE, SCORE_PIECE = 2 << 20, 1 << 20
_DTYPE = np.dtype(np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def events(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (``order`` context bytes, then the byte) of all bytes of the texts, and each text's number of bytes.

    A text starts in a context of ends alone.
    """
    lead = bytes([END]) * order
    joined = [b" ".join(t) + b"\n" for t in texts]
    data = np.frombuffer(b"".join(lead + j for j in joined), np.uint8)
    sizes = np.array([len(j) for j in joined], np.int64)
    code = np.zeros(max(0, len(data) - order), _DTYPE)
    for k in range(order + 1):
        code <<= np.uint64(8)
        code |= data[k : k + len(code)]
    starts = np.cumsum(sizes + order)[:-1]
    own = np.ones(len(code), bool)
    for k in range(order):  # the bytes of a lead are context only
        own[starts - order + k] = False
    return code[own], sizes


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(codes, return_inverse=True)
    return keys, np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)


class Index:
    """Positions of distinct 64-bit keys, by open addressing; looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(_DTYPE)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._home(self.keys)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free] + 1
            lost = self.slots[at] != left + 1
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for absent ones."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return found
        at = self._home(keys)
        held = self.slots[at]
        found = held.astype(np.int64) - 1
        left = np.flatnonzero((held > 0) & (self.keys[found] != keys))
        found[left] = -1
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.slots[at].astype(np.int64)
            here = (held > 0) & (self.keys[held - 1] == keys[left])
            found[left[here]] = held[here] - 1
            go = (held > 0) & ~here
            left, at = left[go], at[go]
        return found


def mask(k: int) -> int:
    """Bits of a code's last ``k`` context bytes and its byte."""
    return (1 << 8 * (k + 1)) - 1


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of runs of rows with about ``most`` bytes; a longer text is a run of its own."""
    held, size, first = [], 0, 0
    texts = batch.column(column)
    for i in range(len(texts)):
        tokens = words(texts[i].as_py())
        held.append(tokens)
        size += sum(map(len, tokens)) + len(tokens) + 1
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def counts(docs: DataFrame, order: int) -> DataFrame:
    """Sums over the rows' column text: kind 0, codes of bytes in context; kind 1, word keys. Staged."""

    def rows(kind: int, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(code), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code[part]), kind, np.int32)), pa.array(code[part].astype(np.int64)), pa.array(n[part])], ["kind", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _BUILT.clear()  # this worker may have scored with an earlier model
        codes, sums, seen = np.zeros(0, _DTYPE), np.zeros(0, np.int64), Counter()
        for batch in batches:
            for _, texts in pieces(batch, "text", COUNT_PIECE):
                new, n = np.unique(events(texts, order)[0], return_counts=True)
                codes, sums = summed(np.concatenate([codes, new]), np.concatenate([sums, n]))
                for tokens in texts:
                    seen.update(tokens)
                seen[END_WORD] += len(texts)
                if len(codes) > 1_500_000:
                    yield from rows(0, codes, sums)
                    codes, sums = codes[:0], sums[:0]
                if len(seen) > 250_000:
                    yield from rows(1, np.array([word_key(w) for w in seen]), np.array(list(seen.values()), np.int64))
                    seen.clear()
        yield from rows(0, codes, sums)
        yield from rows(1, np.array([word_key(w) for w in seen], np.int64), np.array(list(seen.values()), np.int64))

    return staged(docs.select(text_of("text").alias("text")).mapInArrow(count, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")), "ppm-counts")


def count_cut(df: DataFrame, limit: int) -> int:
    """Smallest count c such that at most ``limit`` rows have n >= c (from a histogram of a few thousand rows)."""
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n")))).cast("long")
    kept = 0
    for row in sorted(df.groupBy(step.alias("n")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r.n):
        kept += row.rows
        if kept > limit:
            return row.n + 1 if row.n < 4096 else 2 * row.n
    return 1


@dataclass
class Trie:
    """Tables of all orders k. nodes: k, code, n, direct (log10 probability in its own context). contexts: k, context, total (of its bytes'
    counts), kinds (different bytes), excluded (what those bytes have one order below)."""

    order: int
    nodes: DataFrame
    contexts: DataFrame

    def log10(self, codes: DataFrame) -> DataFrame:
        """code, log: log10 probability of the last byte of each different ``code`` after the bytes before it."""
        left = codes.select("code", *[F.lit(0.0).alias(x) for x in ("log", "gone", "gone_kinds")], F.lit(False).alias("done"))
        for k in range(self.order, -1, -1):
            short = F.col("code").bitwiseAND(F.lit(mask(k)))
            nodes = self.nodes.where(F.col("k") == k).select(F.col("code").alias("short"), "n")
            contexts = self.contexts.where(F.col("k") == k).select("context", "total", "kinds", "excluded")
            left = left.withColumn("short", short).withColumn("context", F.shiftright("short", 8)).join(contexts, "context", "left").join(nodes, "short", "left")
            seen, hit = F.col("total").isNotNull() & ~F.col("done"), F.col("n").isNotNull() & ~F.col("done")
            rest = F.col("total") - F.col("gone") + F.col("kinds") - F.col("gone_kinds")
            step = F.when(hit, F.log10(F.col("n") / rest)).when(seen & (rest > 0), F.log10((F.col("kinds") - F.col("gone_kinds")) / rest)).otherwise(F.lit(0.0))
            after = lambda own, held: F.when(seen, F.col(own)).otherwise(F.col(held))  # noqa: B023, E731
            left = left.select("code", (F.col("log") + step).alias("log"), after("excluded", "gone").alias("gone"), after("kinds", "gone_kinds").alias("gone_kinds"), (F.col("done") | hit).alias("done"))
        return left.select("code", F.when(F.col("done"), F.col("log")).otherwise(F.col("log") - F.log10(F.greatest(256 - F.col("gone_kinds"), F.lit(1.0)))).alias("log"))


def trie_of(counted: DataFrame, order: int) -> Trie:
    """All nodes and contexts, from the sums of the longest codes. Staged."""
    top = counted.where("kind = 0")
    levels = None
    for k in range(order + 1):
        level = top if k == order else top.groupBy(F.col("code").bitwiseAND(F.lit(mask(k))).alias("code")).agg(F.sum("n").alias("n"))
        level = level.select(F.lit(k).alias("k"), "code", "n")
        levels = level if levels is None else levels.unionByName(level)
    levels = staged(levels, "ppm-levels")
    cut_by = F.element_at(F.array(*[F.lit(mask(k)) for k in range(order + 1)]), F.greatest(F.col("k"), F.lit(1)))  # the mask one order below
    below = levels.select((F.col("k") + 1).alias("k"), F.col("code").alias("short"), F.col("n").alias("n_below"))
    joined = levels.withColumn("short", F.col("code").bitwiseAND(cut_by)).join(below, ["k", "short"], "left")
    sums = [F.sum("n").cast("double").alias("total"), F.count("*").cast("double").alias("kinds"), F.coalesce(F.sum("n_below"), F.lit(0)).cast("double").alias("excluded")]
    contexts = staged(joined.groupBy("k", F.shiftright("code", 8).alias("context")).agg(*sums), "ppm-contexts")
    return Trie(order, levels, contexts)


#: The head this process built last, under the name of its broadcast; a worker runs many tasks.
_BUILT: dict[str, tuple[Index, Index]] = {}


def built(name: str, codes: np.ndarray, words: np.ndarray) -> tuple[Index, Index]:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(codes), Index(words)
    return _BUILT[name]


def score_texts(docs: DataFrame, train: Column, order: int = 5, head_nodes: int = 2_000_000, head_words: int = 1_000_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` (a boolean column) picks the rows that model and unigram counts are learned from; all their bytes
    and words count. ``score`` is the model's log10 probability of the whole text, ``base_score`` the add-one
    unigram's: sum over tokens of log10((c + 1) / (N + V + 1)). A null text is empty: one token, the end. Repeated rows
    are learned from and scored as often as they occur. Words are told apart by 64-bit hashes.

    Two things are broadcast, both bounded: probabilities of the ``head_nodes`` most frequent nodes of the longest contexts, and counts of the
    ``head_words`` most frequent words. The rest is joined: a row for each document and rare word, or rare code; results do not depend on
    either number. No training rows: bytes are equally likely and every word is new. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = counts(rows.where("train"), order)
    vocabulary = counted.where("kind = 1").select(F.col("code").alias("word"), "n")
    totals = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, kinds = totals.n or 0, totals.v
    cut = count_cut(vocabulary, head_words)
    head = vocabulary.where(F.col("n") >= cut).toArrow()
    trie = trie_of(counted, order)
    top = counted.where("kind = 0").select("code", "n")
    own = trie.contexts.where(F.col("k") == order).select("context", "total", "kinds")
    frequent = top.where(F.col("n") >= count_cut(top, head_nodes)).withColumn("context", F.shiftright("code", 8)).join(own, "context")
    nodes = frequent.select("code", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("direct")).toArrow()
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((nodes.column("code").to_numpy().astype(_DTYPE), nodes.column("direct").to_numpy(), head.column("word").to_numpy().astype(_DTYPE), head.column("n").to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_codes, direct, head_keys, head_counts = shared.value
        codes_at, words_at = built(name, head_codes, head_keys)
        for batch in batches:
            for first, texts in pieces(batch, "text", SCORE_PIECE):
                n = len(texts)
                keys: dict[bytes, int] = {}
                owner, key, times = [], [], []
                for i, tokens in enumerate(texts):
                    bag = Counter(tokens)
                    bag[END_WORD] = 1
                    owner += [i] * len(bag)
                    times += bag.values()
                    key += [keys[w] if w in keys else keys.setdefault(w, word_key(w)) for w in bag]
                owner, key, times = np.array(owner), np.array(key, np.int64), np.array(times, np.int64)
                at = words_at.find(key.astype(_DTYPE))
                known = at >= 0
                codes, sizes = events(texts, order)
                whose = np.repeat(np.arange(n), sizes)
                place = codes_at.find(codes)
                hit = place >= 0
                rare, rare_times = np.unique(np.stack([whose[~hit].astype(_DTYPE), codes[~hit]], 1), axis=0, return_counts=True)

                def lists(owners: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owners.astype(np.int64), minlength=n))]), pa.int32())  # noqa: B023
                    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]

                columns = [
                    batch.column("doc_id").slice(first, n),
                    pa.array([len(t) + 1 for t in texts], pa.int64()),
                    pa.array(np.bincount(owner[known], weights=times[known], minlength=n).astype(np.int64)),
                    pa.array(np.bincount(owner[known], weights=times[known] * np.log10(head_counts[at[known]] + 1.0), minlength=n).astype(float)),
                    pa.array(np.bincount(whose[hit], weights=direct[place[hit]], minlength=n).astype(float)),
                    *lists(owner[~known], key[~known], times[~known]),
                    *lists(rare[:, 0], rare[:, 1].astype(np.int64), rare_times.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    schema = "doc_id long, n_tokens long, head_known long, head_log double, head_score double, tail array<long>, times array<long>, codes array<long>, code_times array<long>"
    scored = staged(rows.select("doc_id", "text").mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "ppm-scores")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    rare = tail.join(vocabulary.where(F.col("n") < cut), "word").groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_log"))
    codes = scored.select("row", F.explode(F.arrays_zip("codes", "code_times")).alias("t")).select("row", F.col("t.codes").alias("code"), F.col("t.code_times").alias("times"))
    escaped = staged(trie.log10(codes.select("code").distinct()), "ppm-codes")
    more = codes.join(escaped, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("code_score"))
    return (
        scored.drop("tail", "times", "codes", "code_times")
        .join(rare, "row", "left")
        .join(more, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n_all + kinds + 1))).alias("base_score"),
            (F.col("head_score") + F.coalesce("code_score", F.lit(0.0))).alias("score"),
        )
    )
