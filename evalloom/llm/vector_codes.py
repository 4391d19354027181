"""Compression of vectors to product codes by member-resident Lloyd iterations.

Components become integers, a vector is cut into equal consecutive parts, and each part position has a codebook of a few entries.
A part lives with the owner of its entry: rows are partitioned by (position, entry, salt), where the salt deals the members of a
large entry over many owners. In a round, owners compare their members with the codebooks; a part that stays nearest to its entry
is not moved, and only parts that change entry migrate in the next shuffle. Owners then add up their resident members, and the sums
(entries x components for each task, whatever the number of members) give the next codebooks.

Owners' files are written once. A part that leaves is written anew with its next owner; in the file that it left it is passed over from
then on, since it is not nearest to that file's entry under the codebooks of the round in which it left. So a round writes only what
migrates, and a lost executor costs its running tasks.

All arithmetic is on integers, so results do not depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.plans.staging import staged

#: Integers a component of 1.0 has, and the bound of a component's integer (so that distances of up to 512 components are longs).
SCALE, BOUND = 4096, 1 << 26
#: Owners an entry has at least, and the members an owner has on average if all parts of a position share one entry.
LEAST_SALTS, OWNED = 16, 50_000
#: Parts compared at once.
STRIP = 1 << 14
Codebooks = np.ndarray  #: (positions, entries, components of a part)


def usable(vectors: Column, parts: int) -> Column:
    """Vectors without null or non-finite components that can be cut into ``parts`` equal parts."""
    finite = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.isNotNull() & (F.size(vectors) > 0) & (F.size(vectors) % parts == 0) & finite


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x), kept within ``BOUND``."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -BOUND, BOUND).astype(np.int32)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integers of a column of binaries, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width).astype(np.int64)


def nearest(x: np.ndarray, part: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties: the lower index) and its squared distance."""
    entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for position in np.unique(part).tolist():
        own, book = np.flatnonzero(part == position), books[position]
        for i in range(0, len(own), STRIP):
            rows = own[i : i + STRIP]
            apart = (book * book).sum(1) - 2 * (x[rows] @ book.T)
            entry[rows] = apart.argmin(1)
            error[rows] = apart[np.arange(len(rows)), entry[rows]] + (x[rows] * x[rows]).sum(1)
    return entry, error


def stayed(x: np.ndarray, part: np.ndarray, entry: np.ndarray, came: np.ndarray, books: Sequence[Codebooks]) -> np.ndarray:
    """Which rows still live in the file they stand in: nearest to its entry in every round after the one they came in.

    Round r compares with ``books[r - 1]``; the rounds up to the last of ``books`` are over.
    """
    alive = np.ones(len(x), bool)
    for r in range(2, len(books) + 1):
        old = np.flatnonzero(alive & (came < r))
        alive[old] = nearest(x[old], part[old], books[r - 1])[0] == entry[old]
    return alive


class Sums:
    """Numbers and sums of the members of all entries."""

    def __init__(self, shape: tuple[int, int, int]):
        self.shape, self.n, self.s = shape, np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)

    def add(self, x: np.ndarray, part: np.ndarray, entry: np.ndarray) -> None:
        np.add.at(self.n, (part, entry), 1)
        np.add.at(self.s, (part, entry), x)

    def rows(self) -> pa.RecordBatch:
        part, entry = np.nonzero(self.n)
        width = self.shape[2]
        columns = (np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), np.repeat(self.n[part, entry], width), self.s[part, entry].ravel())
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "at", "n", "s"])


def members(path_rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """part, entry, at, n, s: sums of resident rows, added up in the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(shape)
        for batch in batches:
            sums.add(matrix(batch.column("x"), shape[2]), batch.column("part").to_numpy(), batch.column("entry").to_numpy())
        yield sums.rows()

    return path_rows.select("part", "entry", "x").mapInArrow(add, "part long, entry long, at long, n long, s long")


def updated(sums: DataFrame, books: Codebooks) -> Codebooks:
    """Componentwise floors of the means; entries without members stay."""
    out = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # a row for each component of the codebooks at most
        out[r.part, r.entry, r.at] = r.s // r.n
    return out


def owned(moving: DataFrame, salts: int, came: int) -> DataFrame:
    """Rows brought to the owners of their entries. Staged."""
    salt = F.pmod(F.xxhash64("row"), F.lit(salts))
    rows = moving.select("row", "part", "entry", "x", salt.alias("salt")).repartition("part", "entry", "salt")
    return staged(rows.select("row", "part", "entry", F.lit(came).cast("long").alias("came"), "x"), "owned")


def compared(resident: DataFrame, books: Sequence[Codebooks]) -> DataFrame:
    """One round at the owners: rows that change entry (row, part, entry, x), and sums (part, entry, at, n, s) of those that stay. Staged."""
    shape = books[0].shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, names = Sums(shape), ["row", "part", "entry", "x", "at", "n", "s"]
        nulls = lambda n, kind: pa.nulls(n, kind)
        for batch in batches:
            x, part, entry, came = matrix(batch.column("x"), shape[2]), *(batch.column(c).to_numpy() for c in ("part", "entry", "came"))
            here = np.flatnonzero(stayed(x, part, entry, came, books[:-1]))
            now, _ = nearest(x[here], part[here], books[-1])
            keeps = now == entry[here]
            sums.add(x[here[keeps]], part[here[keeps]], now[keeps])
            goes, to = here[~keeps], now[~keeps]
            taken = pa.array(goes)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(taken), batch.column("part").take(taken), pa.array(to), batch.column("x").take(taken), *[nulls(len(goes), pa.int64())] * 3], names)
        rows = sums.rows()
        n = rows.num_rows
        yield pa.RecordBatch.from_arrays([nulls(n, pa.int64()), rows.column("part"), rows.column("entry"), nulls(n, pa.binary()), *(rows.column(c) for c in ("at", "n", "s"))], names)

    return staged(resident.mapInArrow(step, "row long, part long, entry long, x binary, at long, n long, s long"), "compared")


def coded(resident: DataFrame, books: Sequence[Codebooks]) -> DataFrame:
    """row, part, entry, error under the last codebooks."""
    shape = books[0].shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, part, entry, came = matrix(batch.column("x"), shape[2]), *(batch.column(c).to_numpy() for c in ("part", "entry", "came"))
            here = np.flatnonzero(stayed(x, part, entry, came, books[:-1]))
            now, error = nearest(x[here], part[here], books[-1])
            taken = pa.array(here)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(taken), batch.column("part").take(taken), pa.array(now), pa.array(error)], ["row", "part", "entry", "error"])

    return resident.mapInArrow(assign, "row long, part long, entry long, error long")


def lloyd(kept: DataFrame, first: Codebooks, rounds: int) -> tuple[DataFrame, list[Codebooks]]:
    """Codes (row, part, entry, error) of the vectors ``kept`` (row, x) and the codebooks of all rounds, the given ones first."""
    parts, _, width = first.shape

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), parts * width).reshape(-1, width)
            part = np.tile(np.arange(parts), batch.num_rows)
            entry, _ = nearest(x, part, first)
            data = x.astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("row").to_numpy(), parts)), pa.array(part), pa.array(entry), pa.array([data[i : i + 4 * width] for i in range(0, len(data), 4 * width)], pa.binary())],
                ["row", "part", "entry", "x"],
            )

    salts = max(LEAST_SALTS, ceil(kept.count() / OWNED))
    books, resident = [first], owned(kept.select("row", "x").mapInArrow(cut, "row long, part long, entry long, x binary"), salts, 1)
    sums = members(resident, first.shape)
    for r in range(2, rounds + 1):
        books.append(updated(sums, books[-1]))
        over = compared(resident, books)
        came = owned(over.where("row IS NOT NULL"), salts, r)
        sums = over.where("row IS NULL").select("part", "entry", "at", "n", "s").unionByName(members(came, first.shape))
        resident = resident.unionByName(came)
    if rounds:
        books.append(updated(sums, books[-1]))
    return coded(resident, books), books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, codes (an entry for each part), error of every usable vector, and the final codebooks (None without vectors).

    Vectors that are null, hold null or non-finite components, or cannot be cut into ``parts`` equal parts are left out, as are those of another length than the
    usable vector with the smallest identifier. The codebooks start as the parts of the ``entries`` smallest identifiers (null comes last, ties go by the
    components; with fewer vectors there are fewer entries). Repeated rows and identifiers each have a result and count each. Components beyond
    16384 in size count as 16384. An empty table gives an empty result; other columns are not read.
    """
    vector = F.col(vector_column)
    given = vectors.where(usable(vector, parts)).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), vector.alias("v"))
    order = [F.col("vec_id").asc_nulls_last()]
    smallest = given.select("vec_id", F.size("v").alias("size")).orderBy(*order, "size").limit(1).collect()
    if not smallest:
        return given.select("vec_id", "label", F.array().cast("array<long>").alias("codes"), F.lit(0).cast("long").alias("error")), None
    size = smallest[0]["size"]

    @F.pandas_udf("binary")
    def integers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: quantised(np.asarray(v)).tobytes())

    kept = staged(given.where(F.size("v") == size).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", integers("v").alias("x")), "kept")
    seeds = kept.orderBy(*order, "x").limit(entries).select("x").collect()
    first = np.array([np.frombuffer(s.x, np.int32) for s in seeds], np.int64).reshape(len(seeds), parts, size // parts).transpose(1, 0, 2)
    codes, books = lloyd(kept, first, rounds)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("part", "entry"))), lambda s: s["entry"])  # as many as parts
    whole = codes.groupBy("row").agg(listed.alias("codes"), F.sum("error").alias("error"))
    return kept.select("row", "vec_id", "label").join(whole, "row").select("vec_id", "label", "codes", "error"), books[-1]


def with_label_error(rows: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """Adds ``label_error``: the error summed over equal labels (nulls are equal). Up to ``max_broadcast`` labels the sums are broadcast; with more they are
    joined, and the rows of a frequent label are dealt over 16 tasks."""
    sums = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    if sums.limit(max_broadcast + 1).count() <= max_broadcast:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = rows.withColumn("_at", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(16)).cast("int"))
    return dealt.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_at") == F.col("_salt"))).drop("_label", "_at", "_salt")


def written(books: Codebooks | None) -> str:
    """SHA-256 of the entries' components in decimals, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, **options: int | str) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256 of the vectors that ``compress`` keeps."""
    rows, books = compress(vectors, **options)
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    rows = with_label_error(staged(rows, "codes"))
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(written(books)).alias("codebooks_sha256"))
