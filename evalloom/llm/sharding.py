"""Sharding along a Hilbert curve, for files that prune on several columns at once.

Each metadata dimension is quantised to ``bits`` bits; the cell's place on the Hilbert curve orders the rows,
and the order is cut into runs of equal row counts. Neighbours on the curve are neighbours in every
dimension, so a shard covers a small box of cells and a filter on any dimension skips most shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import text_of
from evalloom.plans.ranking import global_rank
from evalloom.plans.staging import staged


def name_bounds(names: DataFrame, bits: int) -> list[list[tuple[str, int]]]:
    """For each string column of ``names``, the first value of every cell in use from 1 to 2**bits - 1, in order, and that cell.

    Different non-null values are ranked in order and the ranks spread evenly over the cells, so a cell holds neighbouring values only.
    What reaches the driver is a value a cell, whatever the table's size.
    """
    cells, bounds = (1 << bits) - 1, []
    for c in names.columns:
        ranked = global_rank(names.select(F.col(c).alias("value")).where("value IS NOT NULL").distinct(), ["value"], name="place", total="values")
        cell = lambda place: F.floor(place * cells / F.col("values"))
        first = ranked.where((F.col("place") == 0) | (cell(F.col("place")) != cell(F.col("place") - 1))).select("value", (cell(F.col("place")) + 1).cast("int").alias("cell"))
        bounds.append([(r.value, r.cell) for r in first.sort("cell").collect()])  # at most 2**bits - 1 rows
    return bounds


def quantised_name(column: Column, bounds: list[tuple[str, int]]) -> Column:
    """Cell of a string: the last one whose first value it reaches. Larger values never have smaller cells, equal ones share theirs; null is cell 0."""
    before = [0, *(cell for _, cell in bounds)]
    return sum((F.when(column >= F.lit(value), cell - last).otherwise(0) for (value, cell), last in zip(bounds, before)), F.lit(0))


def quantised_size(column: Column, bits: int, per_octave: int = 2) -> Column:
    """Cell of a size on a logarithmic scale with ``per_octave`` cells for each doubling."""
    return F.least(F.floor(F.log2(1 + F.coalesce(column, F.lit(0))) * per_octave), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(coordinates: Column, dimensions: int, bits: int) -> Column:
    """Place on the Hilbert curve of an array of ``dimensions`` integers below 2**bits.

    Skilling's transpose form (2004): undo the rotations from the highest bit down, Gray-encode, interleave.
    """

    def at(x: Column, i: int | Column) -> Column:
        return F.get(x, i if isinstance(i, Column) else F.lit(i))

    def turn(x: Column, step: Column) -> Column:
        i = step % dimensions
        q = F.pow(F.lit(2), F.lit(bits - 1) - F.floor(step / dimensions)).cast("long")
        p, first, here = q - 1, at(x, 0), at(x, i.cast("int"))
        hit, t = here.bitwiseAND(q) != 0, first.bitwiseXOR(here).bitwiseAND(p)
        return F.transform(x, lambda v, j: F.when(j == 0, F.when(hit, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(t))).when((j == i) & ~hit, v.bitwiseXOR(t)).otherwise(v))

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body(value)`` with the value worked out once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def gray(x: Column) -> Column:
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))

    def untwist(x: Column) -> Column:
        last, t = at(x, dimensions - 1), F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return let(t, lambda k: F.transform(x, lambda v: v.bitwiseXOR(k)))

    def interleave(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(dimensions):
                out = out * 2 + F.shiftright(at(x, i), b).bitwiseAND(F.lit(1).cast("long"))
        return out

    x = F.transform(coordinates, lambda v: v.cast("long"))
    if bits > 1:
        x = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * dimensions - 1)), x, turn)
    return let(x, lambda a: let(gray(a), lambda b: let(untwist(b), interleave)))


def curve(df: DataFrame, cells: list[str], bits: int, name: str = "curve") -> DataFrame:
    """Adds the Hilbert index of ``cells``; it is worked out once for each of the 2**(cells x bits) cells."""
    n = len(cells)
    if n * bits > 18:
        return df.withColumn(name, hilbert_index(F.array(*cells), n, bits))
    mask = (1 << bits) - 1
    places = df.sparkSession.range(1 << n * bits).select(
        F.col("id").alias("_cell"), hilbert_index(F.array(*[F.shiftright("id", bits * (n - 1 - i)).bitwiseAND(F.lit(mask).cast("long")) for i in range(n)]), n, bits).alias(name)
    )
    packed = F.lit(0).cast("long")
    for c in cells:
        packed = packed * (1 << bits) + F.col(c)
    return df.withColumn("_cell", packed).join(F.broadcast(places), "_cell").drop("_cell")  # at most 2**18 rows


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 5, id_column: str = "doc_id", text_column: str = "text", names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, the cells and the curve index.

    The law is ``rows``: shards differ by one row at most, the first ones being larger. Dimensions are the
    columns in ``names``, in their own order so that a file's smallest and largest name are close, and the text's size. Equal texts stand side by side: a group takes the smallest
    non-null value of each name in it, and ties on the curve are ordered by text hash, then by identifier.
    A null text has size 1 and the checksum of the empty text; null names share cell 0; null identifiers come
    first. Rows equal in everything take neighbouring slots in any order. ``grown_shard`` is null under this
    law. An empty table gives an empty result. Other columns are not read.
    """
    body = text_of(text_column)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("text_hash"),
        *[F.col(c).cast("string").alias(f"name_{i}") for i, c in enumerate(names)],
    )
    key = ["text_hash", "size", "text_crc32"]
    groups = staged(rows.groupBy(*key).agg(*[F.min(f"name_{i}").alias(f"group_{i}") for i in range(len(names))]), "text-groups")  # so that the join can split a hot text's rows
    cells = [f"{c}_cell" for c in names] + ["size_cell"]
    bounds = name_bounds(groups.select(*[f"group_{i}" for i in range(len(names))]), bits)
    placed = rows.join(groups, key).select(
        "doc_id", *key, *[quantised_name(F.col(f"group_{i}"), b).alias(c) for i, (c, b) in enumerate(zip(cells, bounds))], quantised_size(F.col("size"), bits).alias(cells[-1])
    )
    ranked = global_rank(curve(placed, cells, bits), ["curve", "text_hash", "text_crc32", "doc_id"], name="place", total="rows")
    least, more = F.floor(F.col("rows") / shards), F.col("rows") % shards
    edge = more * (least + 1)
    wide = F.col("place") < edge
    small = F.greatest(least, F.lit(1))
    shard = F.when(wide, F.floor(F.col("place") / (least + 1))).otherwise(more + F.floor((F.col("place") - edge) / small))
    slot = F.when(wide, F.col("place") % (least + 1)).otherwise((F.col("place") - edge) % small)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *cells, "curve"
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id", folder_column: str = "shard_folder") -> None:
    """Writes ``docs``, all columns, in one folder per shard, each in slot order.

    Identifiers must be unique and are matched as they are, null with null. ``folder_column`` must be no column of ``docs``; other names are free. An empty
    table writes no shard.
    """
    rows = docs.select(F.struct("*").alias("held"), F.col(id_column).alias("own_id"))
    joined = rows.join(assigned.select("doc_id", "shard", "slot"), F.col("own_id").eqNullSafe(F.col("doc_id")))
    ordered = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("held.*", F.col("shard").alias(folder_column)).write.partitionBy(folder_column).parquet(path)
