"""Alignment of two tokenizers' tokens by lockstep merging.

Tokens of both tokenizers cover the same bytes, so going through a text is a merge of two sorted lists of token ends: the token that ends first gives
way to the next, and where both end at one byte there is a cut. All documents of a batch are merged at once: one NumPy state vector holds
the A and B pointers of every document, a step looks at the two ends under each pointer pair, writes down which side moves on (a link, and a cut
if both do), advances, and finished documents leave the vector. A long document takes several places in the vector, which
begin at bytes where tokens of both sides end.

An alignment is kept as token ids and one byte for each link: 1 if A's token ends first, 2 if B's does, 3 at a cut. Links, groups and
counts are derived from it without merging again.

Tokens are found for the text's pieces between spaces, each different one once for many texts. This gives the tokens of the whole text where no token of either side
reaches over the place before a space; it is checked on the vocabularies, and for the text (the character before the space is not white space).
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.ppm import Index, summed
from evalloom.plans.staging import staged

# Fixed value: how a byte-level vocabulary cuts texts before merging.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text tokenized at once; different pieces a worker remembers, and the longest of them.
PIECE, REMEMBERED, LONGEST = 1 << 20, 200_000, 64
#: Links merged or looked at together, and the A tokens between two places of one document in the state vector.
STRIP, LANE = 1 << 20, 512
#: Links counted in a task before counts are handed on.
HELD = 1 << 20
_SPACE_BEFORE, _BORDER = re.compile(r"\s "), re.compile(r"(?<=\S) ")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable Latin-1 characters stand for themselves, the others come after 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokens of a byte-level file; merges must be numbered in the order of their tokens' ids, as rank merging needs."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())
        special = {t["content"] for t in model["added_tokens"]}
        alphabet, vocabulary = byte_alphabet(), {k: v for k, v in model["model"]["vocab"].items() if k not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        merged = [vocabulary[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            raise ValueError(f"{path}: ids of tokens are not in the order of their merges")
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items()}
        self.encoding = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.splits = True

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each piece after a space."""
        return [self.encoding.encode_ordinary(" " + p) for p in pieces]


class Pieces:
    """Tokens of a sentence-piece model that puts a space before each text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = self.model.piece_to_id("▁")
        self.splits = not any(re.search("[^▁]▁", n) for n in names)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [ids if p else [self.space] for p, ids in zip(pieces, self.model.encode(pieces, num_threads=1), strict=True)]


@lru_cache(maxsize=2)
def tokenizers(folder: str, a_file: str, b_file: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(f"{folder}/{a_file}"), Pieces(f"{folder}/{b_file}")


def borders(text: str, whole: bool) -> list[str]:
    """The pieces of a text, each of which follows a space (the first one that which is put before the text)."""
    if whole:
        return [text]
    return text.split(" ") if text[:1] != " " and not _SPACE_BEFORE.search(text) else _BORDER.split(text)


def stretches(text: str) -> Iterator[str]:
    """A text in stretches of about ``PIECE`` characters between two of its pieces; the space between two stretches is left out."""
    at = 0
    while len(text) - at > PIECE and (border := _BORDER.search(text, at + PIECE)):
        yield text[at : border.start()]
        at = border.end()
    yield text[at:]


class Memory:
    """Token ids of pieces (four bytes each), found once for each different piece; None for pieces whose tokens are not their bytes."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def find(self, pieces: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        new = [p for p in pieces if p not in self.known]
        found = {}
        for p, x, y in zip(new, self.a.encode(new), self.b.encode(new), strict=True):
            want = b" " + p.encode("utf-8", "surrogatepass")
            same = b"".join(map(self.a.bytes.__getitem__, x)) == want and b"".join(map(self.b.bytes.__getitem__, y)) == want
            found[p] = (array("i", x).tobytes(), array("i", y).tobytes()) if same else None
        if len(self.known) + len(found) > REMEMBERED:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        self.known.update(found)
        return self.known

    def forget_long(self) -> None:
        for p in [p for p in self.known if len(p) > LONGEST]:
            del self.known[p]


def tokens(texts: list[str | None], memory: Memory) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of A and B for every text; none for null and empty texts and where tokens are not the text's bytes."""
    whole = not (memory.a.splits and memory.b.splits)
    parts: list[list[tuple[np.ndarray, np.ndarray] | None]] = [[] for _ in texts]
    held: list[tuple[int, list[str]]] = []
    size = 0

    def settle() -> None:
        known = memory.find({p for _, pieces in held for p in pieces})
        for i, pieces in held:
            found = [known[p] for p in pieces]
            parts[i].append(None if None in found else tuple(np.frombuffer(b"".join(map(itemgetter(k), found)), np.int32) for k in (0, 1)))
        memory.forget_long()
        held.clear()

    for i, text in enumerate(texts):
        for stretch in ([text] if whole else stretches(text)) if text else ():
            held.append((i, borders(stretch, whole)))
            size += len(stretch)
            if size > PIECE:
                settle()
                size = 0
    settle()
    none = np.zeros(0, np.int32)
    return [(none, none) if None in own else tuple(np.concatenate([none, *(p[k] for p in own)]) for k in (0, 1)) for own in parts]


@dataclass
class Merge:
    """Moves of several documents' merges, one document after the other."""

    moves: np.ndarray
    first: np.ndarray = field(repr=False)  #: each document's first move; one more at the end


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray) -> np.ndarray:
    """A tokens at which the state vector's places begin: documents' first tokens, and about every LANE tokens one that follows an end of both sides."""
    n = np.diff(first_a)
    own = np.repeat(first_a[:-1], np.maximum(0, n - 1) // LANE)
    if not len(own):
        return first_a[:-1][n > 0]
    number = np.arange(len(own)) - np.repeat(np.cumsum(np.maximum(0, n - 1) // LANE) - np.maximum(0, n - 1) // LANE, np.maximum(0, n - 1) // LANE)
    at = (own + (number + 1) * LANE)[:, None] + np.arange(-64, 0)  # ends before the token
    at = np.maximum(at, 0)
    shared = ends_b[np.minimum(np.searchsorted(ends_b, ends_a[at]), len(ends_b) - 1)] == ends_a[at]
    last = at[np.arange(len(at)), 63 - shared[:, ::-1].argmax(1)][shared.any(1)]
    return np.unique(np.concatenate([first_a[:-1][n > 0], last + 1]))


def merged(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> Merge:
    """Merges all documents in lockstep.

    ``ends_*`` are the ends of tokens, counted on over all documents; ``first_*`` are documents' first tokens, and one more at the end. A document's
    last tokens end at one byte.
    """
    start = lanes(ends_a, ends_b, first_a)
    stop = np.append(start[1:], len(ends_a))
    a, b = start.copy(), np.searchsorted(ends_b, ends_a[start - 1], "right")
    b[start == 0] = 0
    at = a + b  # a document has fewer links than tokens
    moves = np.zeros(len(ends_a) + len(ends_b), np.uint8)
    while len(a):
        x, y = ends_a[a], ends_b[b]
        move = (x <= y).view(np.uint8) + ((y <= x).view(np.uint8) << 1)
        moves[at] = move
        a = a + (move & 1)
        b = b + (move >> 1)
        at = at + 1
        over = a >= stop
        if over.any():
            left = ~over
            a, b, at, stop = a[left], b[left], at[left], stop[left]
    done = moves > 0
    return Merge(moves[done], np.concatenate([[0], np.cumsum(done)])[first_a + first_b])


def lengths(folder: str, a_file: str, b_file: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in side.bytes], np.int64) for side in tokenizers(folder, a_file, b_file))


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one after the other, and the first place of each; one more at the end."""
    return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def strips(sizes: np.ndarray, most: int = STRIP) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to about ``most``."""
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), most, "right")) + i)
        yield i, j
        i = j


def align(docs: DataFrame, folder: str = "/opt/tokenizers", a_file: str = A_FILE, b_file: str = B_FILE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row, doc_id, a, b (token ids, four bytes each), moves (a byte for each link: 1 A's token ends first, 2 B's, 3 a cut). Staged.

    A reads the text after a space, B the text, before which it puts a space itself; special tokens' names are plain text. Null and empty texts, and texts of which
    the tokens' bytes of a side are not the space and the text, have no tokens. Repeated rows and identifiers each have a row, null
    identifiers too. An empty table gives an empty result; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(*tokenizers(folder, a_file, b_file))
        long_a, long_b = lengths(folder, a_file, b_file)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 1
            for i, j in strips(sizes):
                found = tokens(texts.slice(i, j - i).to_pylist(), memory)
                (a, first_a), (b, first_b) = joined([x[0] for x in found]), joined([x[1] for x in found])
                done = merged(np.cumsum(long_a[a]), np.cumsum(long_b[b]), first_a, first_b)
                moves = done.moves.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i)]
                    + [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
                    + [pa.array([moves[s:e] for s, e in zip(done.first[:-1].tolist(), done.first[1:].tolist(), strict=True)], pa.binary())],
                    ["row", "doc_id", "a", "b", "moves"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return staged(rows.mapInArrow(work, "row long, doc_id long, a binary, b binary, moves binary"), "alignments")


@dataclass
class Links:
    """Links of several documents, one after the other."""

    a: np.ndarray  #: A ids of all tokens
    b: np.ndarray
    first_a: np.ndarray  #: documents' first tokens; one more at the end
    first_b: np.ndarray
    first: np.ndarray  #: documents' first links
    at_a: np.ndarray  #: the A token of a link
    at_b: np.ndarray
    cut: np.ndarray  #: both tokens end together

    def codes(self) -> np.ndarray:
        """Both ids of a link in one number."""
        return self.a[self.at_a].astype(np.int64) << 32 | self.b[self.at_b]


def links_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Links]]:
    """First row and links of runs of a batch's rows."""
    held = [batch.column(c).to_pylist() for c in ("a", "b", "moves")]
    for i, j in strips(np.array([len(m) + 1 for m in held[2]], np.int64)):
        (a, first_a), (b, first_b) = (joined([np.frombuffer(x, np.int32) for x in side[i:j]]) for side in held[:2])
        moves, first = joined([np.frombuffer(x, np.uint8) for x in held[2][i:j]])
        go_a, go_b = (moves & 1).astype(np.int64), (moves >> 1).astype(np.int64)
        yield i, Links(a, b, first_a, first_b, first, np.cumsum(go_a) - go_a, np.cumsum(go_b) - go_b, moves == 3)


def token_links(alignments: DataFrame) -> DataFrame:
    """doc_id, group, a_place, b_place, a, b: every link with its tokens' places and ids, and the number of its group of tokens between two cuts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in links_of(batch):
                doc = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
                before = np.cumsum(x.cut) - x.cut
                group = before - before[x.first[:-1][doc]] if len(doc) else before
                columns = (group, x.at_a - x.first_a[doc], x.at_b - x.first_b[doc], x.a[x.at_a], x.b[x.at_b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc + i)), *[pa.array(c.astype(np.int64)) for c in columns]], ["doc_id", "group", "a_place", "b_place", "a", "b"])

    return alignments.select("doc_id", "a", "b", "moves").mapInArrow(work, "doc_id long, group long, a_place long, b_place long, a long, b long")


def pair_counts(alignments: DataFrame) -> DataFrame:
    """code (A id * 2^32 + B id), n (links of the corpus that hold the pair), best (no pair with this B id has more). Staged.

    Counts are added up in the tasks before they are shuffled; the highest count of each B id is a row for each B id, and is broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, held = [], [], 0
        rows = lambda c, k: (pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]), pa.array(k[i : i + 100_000])], ["code", "n"]) for i in range(0, len(c), 100_000))
        for batch in batches:
            for _, x in links_of(batch):
                c, k = np.unique(x.codes(), return_counts=True)
                codes, n, held = [*codes, c], [*n, k], held + len(c)
                if held > HELD:
                    c, k = summed(np.concatenate(codes), np.concatenate(n))
                    codes, n, held = [c], [k], len(c)
                    if held > HELD // 2:
                        yield from rows(c, k)
                        codes, n, held = [], [], 0
        if held:
            yield from rows(*summed(np.concatenate(codes), np.concatenate(n)))

    counts = staged(alignments.select("a", "b", "moves").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("code").bitwiseAND((1 << 32) - 1)
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return staged(counts.withColumn("b", b).join(F.broadcast(highest), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def frequent(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, ``most`` of them at the utmost: all whose count has as many binary digits as fit."""
    digits = F.length(F.bin("n")).alias("digits")
    sizes = {r.digits: r["count"] for r in pairs.groupBy(digits).count().collect()}  # 64 rows at most
    least, total = 65, 0
    for d in sorted(sizes, reverse=True):
        total += sizes[d]
        if total > most:
            break
        least = d
    return pairs.where(digits >= least)


def digests(alignments: DataFrame, pairs: DataFrame, max_head: int = 1_000_000, folder: str = "/opt/tokenizers", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every alignment.

    The ``max_head`` most frequent pairs are broadcast, and most links find their count there; the others leave as (row, pair, times) and are
    joined with all pairs. No such pair is frequent, so the join has no hot key.
    """
    head = frequent(pairs, max_head).toPandas()
    keys, n, best = (head[c].to_numpy() for c in ("code", "n", "best"))
    known = alignments.sparkSession.sparkContext.broadcast((keys.astype(np.int64), n.astype(np.int64), best.astype(bool)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        index, names = Index(keys.view(np.uint64)), written(*(len(side.bytes) for side in tokenizers(folder, a_file, b_file)))
        n, best = np.append(n, 0), np.append(best, False).astype(np.int64)  # place -1: not among the frequent ones
        for batch in batches:
            for i, x in links_of(batch):
                size, links = len(x.first) - 1, np.diff(x.first)
                doc, codes = np.repeat(np.arange(size), links), x.codes()
                at = index.find(codes.view(np.uint64))
                add = lambda values: np.add.reduceat(np.append(values, 0).astype(np.int64), x.first[:-1]) * (links > 0)  # noqa: B023, E731
                columns = [np.diff(x.first_a), np.diff(x.first_b), add(x.cut), links, add(best[at]), add(n[at])]
                nulls = [pa.nulls(size, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, size), batch.column("doc_id").slice(i, size), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(group_digests(x, names), pa.string()), *nulls], NAMES
                )
                lost = np.flatnonzero(at < 0)
                if len(lost):
                    order = np.lexsort((codes[lost], doc[lost]))
                    d, c = doc[lost][order], codes[lost][order]
                    begins = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])]))
                    nulls = [pa.nulls(len(begins), pa.int64())] * 7
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(d[begins] + i)), *nulls, pa.nulls(len(begins), pa.string()), pa.array(c[begins]), pa.array(np.diff(np.append(begins, len(c))))], NAMES)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, code long, times long"
    over = staged(alignments.mapInArrow(work, schema), "digests")
    rare = over.where("code IS NOT NULL").select("row", "code", "times").join(pairs, "code")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = over.where("code IS NULL").join(more, "row", "left")
    added = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")


NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "code", "times"]


def written(a: int, b: int) -> tuple[list[str], list[str]]:
    """The first ``a`` and ``b`` ids in decimals with what follows them: inside a side of a group, and at its end."""
    return tuple([f"{i}{mark}" for i in range(top) for mark in (",", end)] for top, end in ((a, "|"), (b, ";")))


def group_digests(x: Links, names: tuple[list[str], list[str]]) -> list[str]:
    """SHA-256 of each document's groups, as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    ends_a, ends_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
    ends_a[x.at_a[x.cut]] = ends_b[x.at_b[x.cut]] = True
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    upto_a, upto_b = np.concatenate([[0], np.flatnonzero(ends_a) + 1]), np.concatenate([[0], np.flatnonzero(ends_b) + 1])
    places = np.zeros(len(x.a) + len(x.b), np.int64)  # groups in turn, A's ids before B's
    places[np.arange(len(x.a)) + upto_b[group_a]] = x.a.astype(np.int64) * 2 + ends_a
    places[np.arange(len(x.b)) + upto_a[group_b + 1]] = len(names[0]) + x.b.astype(np.int64) * 2 + ends_b
    all_names, out = [*names[0], *names[1]], []
    for s, e in zip((x.first_a + x.first_b)[:-1].tolist(), (x.first_a + x.first_b)[1:].tolist(), strict=True):
        out.append(hashlib.sha256("".join(map(all_names.__getitem__, places[s:e].tolist()))[:-1].encode()).hexdigest() if e > s else "")
    return out


def cross_tokens(docs: DataFrame, **options: str) -> DataFrame:
    """The digests of all documents of ``docs`` against the pair counts of the same documents."""
    alignments = align(docs, **options)
    files = {k: options[k] for k in ("folder", "a_file", "b_file") if k in options}
    return digests(alignments, pair_counts(alignments), **files)
