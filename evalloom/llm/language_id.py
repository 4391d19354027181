"""Language identification of whole and mixed texts: scripts, word scores, and Viterbi over the words.

Words are runs of letters of one script. The script narrows the candidates to the languages that are written in it; each word then has a score for each
candidate, the sum of the log-probabilities of its character n-grams (within the word and its borders, and the word itself) in that language. Viterbi finds the
best labelling of a text's words, where a switch of language costs a fixed penalty: a few doubtful words do not
break a span, a sentence in another language does. The texts of a batch are labelled at once, word by word, and leave as they end.

The model is counted on Spark: tasks add up hashed n-grams and letters by script for each language, and a language is a row of ``buckets``
numbers at most, so what reaches the driver and is broadcast depends on the number of languages (256 KB each), not on the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a word at most; longer runs (scripts without spaces) are cut.
LONGEST = 24
#: Lengths of n-grams; borders of words count as characters.
ORDERS = (1, 2, 3, 4)
#: Characters read at once, and characters of the texts labelled at once.
PIECE, STRIP = 1 << 20, 1 << 23
#: Languages of which a task holds counts before it hands them on.
HELD = 64
#: What a word says against a language that is not written in its script.
FOREIGN = -40.0
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BORDER = re.compile(r"[\W\d_]")


@cache
def scripts() -> tuple[np.ndarray, list[str]]:
    """Script of every code point: 0 for no letter or mark, 1 for marks, and from 2 on the letters' scripts, by their names' first words."""
    names: dict[str, int] = {"": 0, "MARK": 1}
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "M":
            table[i] = 1
        elif kind == "L":
            name = re.split(r"[ -]", unicodedata.name(chr(i), "OTHER"))[0]
            table[i] = names.setdefault(name, min(len(names), 255))
    return table, list(names)


@cache
def lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if len(c := chr(i).lower()) == 1:
            table[i] = ord(c)
    return table


@dataclass
class Words:
    """The words of several pieces of text, one after the other."""

    piece: np.ndarray  #: which piece a word is of
    start: np.ndarray  #: its place in the piece
    length: np.ndarray  #: letters and marks
    script: np.ndarray
    different: np.ndarray  #: which of the different words it is
    letters: np.ndarray  #: of the different words, one after the other, with a border before and after each
    first: np.ndarray  #: where each different word's border is


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def read(pieces: list[str]) -> Words:
    table, _ = scripts()
    points = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = table[points].astype(np.int64)
    at = np.flatnonzero(kind)
    number = np.arange(len(at))
    gap = np.diff(at, prepend=-2) > 1
    at = at[np.maximum.accumulate(np.where(kind[at] > 1, number, -1)) >= np.maximum.accumulate(np.where(gap, number, 0))]  # marks after no letter are no words
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, none.astype(np.uint32), none)
    own = kind[at]
    own = own[np.maximum.accumulate(np.where(own > 1, np.arange(len(own)), 0))]  # marks have the script of the letter before
    begin = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(own) != 0)])
    start = np.flatnonzero(begin)
    begin |= (np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % LONGEST == 0
    start = np.flatnonzero(begin)
    length = np.diff(np.append(start, len(at)))
    points, where = lower()[points[at]], at[start]
    inside = np.arange(len(at)) - np.repeat(start, length)
    powers = np.cumprod(np.concatenate([[1], np.full(LONGEST, _STEP, np.uint64)]).astype(np.uint64))
    hashes = mixed(np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * powers[inside], start) + length.astype(np.uint64))
    _, one, different = np.unique(hashes, return_index=True, return_inverse=True)
    size = length[one]
    first = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    letters = np.zeros(int((size + 2).sum()), np.uint32)  # 0 and 1 are no letters
    letters[first + size + 1] = 1
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letters[np.repeat(first + 1, size) + step] = points[np.repeat(start[one], size) + step]
    edges = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])]).astype(np.int64)
    piece = np.searchsorted(edges, where, "right") - 1
    return Words(piece, where - edges[piece], length, own[start], different, letters, first)


def grams(words: Words, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different word and bucket of every n-gram, order by order; the whole word comes last."""
    owner = np.repeat(np.arange(len(words.first)), np.diff(np.append(words.first, len(words.letters))))
    letters, h = words.letters.astype(np.uint64), np.zeros(len(words.letters), np.uint64)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for k in range(1, max(ORDERS) + 1):
        n = len(letters) - k + 1
        if n <= 0:
            return
        h = mixed(h[:n] * _STEP + letters[k - 1 :] + np.uint64(1))
        inside = owner[:n] == owner[k - 1 :]
        if k == 1:
            inside = letters > 1
        if k in ORDERS:
            yield owner[:n][inside], (mixed(h[inside] + np.uint64(k)) >> shift).astype(np.int64)
    if len(words.first):
        whole = mixed(np.bitwise_xor.reduceat(mixed(letters * _STEP + (np.arange(len(letters)) - words.first[owner]).astype(np.uint64)), words.first))
        yield np.arange(len(words.first)), (whole >> shift).astype(np.int64)


def pieces_of(texts: list[str | None]) -> Iterator[tuple[int, int, str]]:
    """Text, place and characters of pieces of about ``PIECE`` characters at most, cut where no word is."""
    for i, text in enumerate(texts):
        at = 0
        while text and len(text) - at > PIECE and (border := _BORDER.search(text, at + PIECE)):
            yield i, at, text[at : border.end()]
            at = border.end()
        if text:
            yield i, at, text[at:]


def groups(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    held: list[tuple[int, int, str]] = []
    size = 0
    for piece in pieces_of(texts):
        if held and size + len(piece[2]) > PIECE:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield held


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  #: (buckets, languages): log-probability, less its mean over the languages
    written: np.ndarray  #: (scripts, languages): the language is a candidate for the script's words


def train(docs: DataFrame, buckets: int = 1 << 16, share: float = 0.01, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Learns from rows with a language; null and empty texts add nothing.

    A language is a candidate for a script that has ``share`` of its letters or more; a script that no language reaches so has no candidates, and its words say nothing.
    Equal rows count each. Without rows there are no languages.
    """
    kinds = len(scripts()[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there), pa.array(n[there].astype(np.int64))], ["lang", "at", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                if lang not in held and len(held) == HELD:
                    yield from rows()
                sums = held.setdefault(lang, np.zeros(buckets + kinds))
                for group in groups([t for t, k in zip(texts, langs, strict=True) if k == lang]):
                    words = read([p for _, _, p in group])
                    times = np.bincount(words.different, minlength=len(words.first))
                    for owner, bucket in grams(words, buckets):
                        sums[:buckets] += np.bincount(bucket, times[owner], buckets)
                    sums[buckets:] += np.bincount(words.script, words.length, kinds)
        yield from rows()

    given = docs.where(F.col(lang_column).isNotNull()).select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    counts = given.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()  # languages x (buckets + scripts) rows at most
    languages = sorted(counts["lang"].unique())
    sums = np.zeros((buckets + kinds, len(languages)))
    sums[counts["at"].to_numpy(np.int64), np.searchsorted(np.array(languages, object), counts["lang"].to_numpy(object)) if languages else []] = counts["n"].to_numpy(float)
    grams_of, letters = sums[:buckets], sums[buckets:]
    table = np.log((grams_of + 0.5) / (grams_of.sum(0) + 0.5 * buckets))
    return Model(languages, (table - table.mean(1, keepdims=True) if languages else table).astype(np.float32), letters >= np.maximum(share * letters.sum(0), 1))


def word_scores(words: Words, model: Model, weight: float) -> np.ndarray:
    """(different words, languages): ``weight`` times the sum over n-grams. The script's candidates are not looked at here."""
    out = np.zeros((len(words.first), len(model.languages)), np.float32)
    for owner, bucket in grams(words, len(model.table)):
        held = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        out[owner[held]] += np.add.reduceat(model.table[bucket], held, axis=0) if len(held) else 0
    return out * np.float32(weight)


def viterbi(scores: np.ndarray, row: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word. ``row`` names a word's row of ``scores``; ``first`` is each text's first word, and one more at the end.

    Equal labellings: no switch is preferred, then the lower label.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = first[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")  # texts of more words than t
    state = np.zeros((len(order), scores.shape[1]), np.float32)
    stays, best = np.zeros((len(row), scores.shape[1]), bool), np.zeros(len(row), np.int16)
    for t, n in enumerate(active.tolist()):
        at, now = start[:n] + t, state[:n]
        top = now.argmax(1)
        switch = now[np.arange(n), top] - np.float32(penalty if t else 0)
        stays[at], best[at] = now >= switch[:, None], top
        state[:n] = np.maximum(now, switch[:, None]) + scores[row[at]]
        state[:n] -= state[:n].max(1, keepdims=True)  # keeps the numbers small in long texts
    label, out = state.argmax(1), np.zeros(len(row), np.int64)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at, own = start[:n] + t, label[:n]
        out[at] = own
        label[:n] = np.where(stays[at, own], own, best[at])
    return out


@dataclass
class Labelled:
    """The words of several texts with their labels."""

    first: np.ndarray  #: each text's first word, and one more at the end
    start: np.ndarray
    length: np.ndarray
    label: np.ndarray


def label_texts(texts: list[str | None], model: Model, penalty: float, weight: float) -> Labelled:
    text, start, length, row, scores, base = [], [], [], [], [], 0
    for group in groups(texts):
        words = read([p for _, _, p in group])
        if not len(words.first):
            continue
        owner, place = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        own = word_scores(words, model, weight)
        script = np.zeros(len(words.first), np.int64)
        script[words.different] = words.script
        candidates = model.written[script]
        own = np.where(candidates, own, np.float32(FOREIGN)) * candidates.any(1, keepdims=True)
        text.append(owner[words.piece])
        start.append(words.start + place[words.piece])
        length.append(words.length)
        row.append(words.different + base)
        scores.append(own)
        base += len(own)
    flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    first = np.searchsorted(flat(text), np.arange(len(texts) + 1))
    table = np.concatenate([np.zeros((0, len(model.languages)), np.float32), *scores])
    return Labelled(first, flat(start), flat(length), viterbi(table, flat(row), first, penalty))


def strips(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    i, size = 0, 0
    for j, text in enumerate(texts):
        size += len(text or "")
        if size > STRIP:
            yield i, texts[i : j + 1]
            i, size = j + 1, 0
    if i < len(texts):
        yield i, texts[i:]


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, weight: float = 0.25, id_column: str = "doc_id", text_column: str = "text", spans: bool = True) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, spans (array of start, end, lang).

    A span is a run of words with one label, from its first word's first character to its last one's last (places count characters). ``lang_pred`` has the most
    letters in its spans (ties: the first in the order of names), and ``score`` is its part of the letters. Null and empty texts and those without a letter
    are ``und`` with score 0 and no spans, as are all texts where the model has no languages. Repeated rows each have their result; an empty table gives an empty
    one. Without ``spans`` that column is left out.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, some in strips(texts):
                n, k = len(some), len(model.languages)
                x = label_texts(some, model, penalty, weight) if k else Labelled(np.zeros(n + 1, np.int64), *[np.zeros(0, np.int64)] * 3)
                doc = np.repeat(np.arange(n), np.diff(x.first))
                letters = np.bincount(doc * max(k, 1) + x.label, x.length, n * max(k, 1)).reshape(n, max(k, 1))
                total = letters.sum(1)
                pred = np.where(total > 0, letters.argmax(1), k)
                columns = [batch.column("doc_id").slice(i, n), pa.array(names[pred], pa.string()), pa.array(letters.max(1) / np.maximum(total, 1))]
                if spans:
                    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (x.label[1:] != x.label[:-1])])) if len(doc) else doc
                    last = np.append(begin[1:], len(doc)) - 1 if len(doc) else begin
                    held = pa.StructArray.from_arrays([pa.array(x.start[begin]), pa.array(x.start[last] + x.length[last]), pa.array(names[x.label[begin]], pa.string())], ["start", "end", "lang"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[begin], np.arange(n + 1)), pa.int32()), held))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, schema)


def language_id(docs: DataFrame, held_out: Column, **options: float) -> DataFrame:
    """Learns from the rows that are not ``held_out`` and identifies all; adds ``held_out`` by doc_id."""
    return identify(docs, train(docs.where(~held_out)), **options).withColumn("held_out", held_out)
