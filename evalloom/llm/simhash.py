"""SimHash near-deduplication by exact comparison of tiles of fingerprints.

A fingerprint's bit is the majority of that bit over the hashes of a text's word shingles. Texts with equal fingerprints
collapse to one first, so a group of copies is one entry. The rest are put into tiles by the population counts of the
fingerprint's segments (and, where asked, by size class), and every pair of tiles is compared in full with numpy
exclusive-or and bit counts - except pairs whose population counts differ by more than the radius in sum, since
then no fingerprints in them can be within it. Nothing is sampled or bucketed away: all links are found.

A tile above ``tile_rows`` is split by fingerprint hash into even parts and its parts are compared pairwise, so one task never
holds more than two parts. A task reports a spanning forest of the links it found instead of all of them; this keeps every
connected component and grows with the fingerprints, not with their pairs. Components come from
alternating large-star and small-star steps on the forest edges.

``drop_near_duplicates`` takes such components as candidates only: inside each, exact Jaccard similarity of the shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import acos, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import text_of
from evalloom.plans.staging import staged

SEED = 42
#: Odd constants that turn one hash into further independent words of a wide fingerprint.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
HASHES = 1 << 17


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of a text's word shingles, repeats included, in arrays of at most HASHES; fewer words than
    ``width`` make one shingle, no words none."""
    found = text.lower().split()
    if not found:
        return
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    n = max(1, len(found) - width + 1)
    ends = (starts + lengths)[min(width, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, HASHES):
        yield np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[i : min(n, i + HASHES)].tolist(), ends[i : i + HASHES].tolist(), strict=True)), np.uint64)


def fingerprint(hashes: Iterator[np.ndarray] | list[np.ndarray], lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words: a bit is 1 if over half of the hashes have it. Further lanes use mixed hashes."""
    ones, n = np.zeros(64 * lanes, np.int64), 0
    for part in hashes:
        n += len(part)
        for lane in range(lanes):
            h = part
            if lane:
                h = (part ^ (part >> np.uint64(29))) * _MIX[lane - 1]
                h ^= h >> np.uint64(32)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[64 * lane : 64 * lane + 64] += sum(bits[i : i + 255].sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255))
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64) if n else np.zeros(lanes, np.uint64)


def fingerprints(docs: DataFrame, id_column: str, text_column: str, width: int, lanes: int = 1, distinct: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lane_0 .. (signed 64-bit words), n (shingles counted), the long columns ``keep``. Staged.

    A null text is empty. ``distinct`` counts each different shingle once and adds ``shingles``, a hash of the whole set.
    """
    names = [f"lane_{i}" for i in range(lanes)]
    more = ["shingles"] if distinct else []

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, sets = [], [], []
            for value in batch.column("text"):
                if distinct:
                    parts = [shingle_set(value.as_py(), width)]
                    sets.append(xxhash.xxh64_intdigest(parts[0].tobytes(), SEED))
                else:
                    parts = list(shingle_hashes((value.as_py() or "").encode("utf-8", "surrogatepass"), width))
                prints.append(fingerprint(parts, lanes))
                sizes.append(sum(map(len, parts)))
            lanes_of = np.array(prints, np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(lanes_of[:, i].copy()) for i in range(lanes)], pa.array(sizes, pa.int64()), *[pa.array(np.array(sets, np.uint64).view(np.int64)) for _ in more], *map(batch.column, keep)], ["doc_id", *names, "n", *more, *keep])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *keep)
    return staged(rows.mapInArrow(compute, ", ".join(f"{x} long" for x in ("doc_id", *names, "n", *more, *keep))), "fingerprints")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Ascending hashes of a text's different shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes((text or "").encode("utf-8", "surrogatepass"), width)]))


class _Forest:
    """Union-find over nodes 0..n-1 that keeps the edges which joined something."""

    def __init__(self, n: int):
        self.root, self.label = list(range(n)), np.arange(n)
        self.a: list[int] = []
        self.b: list[int] = []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        before = len(self.a)
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            u, v = self.find(x), self.find(y)
            if u != v:
                self.root[max(u, v)] = min(u, v)
                self.a.append(x)
                self.b.append(y)
        if len(self.a) > before:
            self.label = np.fromiter(map(self.find, range(len(self.root))), np.int64, len(self.root))


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` between the rows of two tiles, or inside one (right: None).

    Tiles are arrays (fingerprints, lanes). Both results hold row numbers; those of ``right`` come after ``left``'s. Comparison
    goes in strips of rows that start small and grow to about ``most`` pairs: where all rows are close, the first strip
    connects them and the later ones add nothing.
    """
    inside = right is None
    right = left if inside else right
    offset, n = (0, len(left)) if inside else (len(left), len(left) + len(right))
    forest = None
    i, strip = 0, 8
    while i < len(left):
        part = left[i : i + strip]
        first = i + 1 if inside else 0
        far = np.bitwise_count(part[:, None, 0] ^ right[None, first:, 0])
        if part.shape[1] > 1:
            far = far.astype(np.uint16)
            for lane in range(1, part.shape[1]):
                far += np.bitwise_count(part[:, None, lane] ^ right[None, first:, lane])
        x, y = np.nonzero(far <= radius)
        x, y = x + i, y + first
        if inside:
            x, y = x[y > x], y[y > x]
        if len(x):
            forest = forest or _Forest(n)
            forest.add(x, y + offset)
        i += len(part)
        strip = min(4 * strip, max(1, most // max(1, len(right))))
    return (np.array(forest.a, np.int64), np.array(forest.b, np.int64)) if forest else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(prints: DataFrame, lanes: int, radius: int, segments: int, tile_rows: int, ratio: float | None = None) -> DataFrame:
    """Forest edges a, b (node numbers) between entries of ``prints`` (node, lane_0.., n) within ``radius``.

    Tiles hold entries with equal population counts of ``segments`` segments of lane 0. With ``ratio``, for a radius too wide for
    that, they hold ranges of the whole population count and of n: entries whose n differ by more than that ratio
    are then not linked for certain. Tile sizes are broadcast: at most a row for each combination of counts.
    """
    if ratio is None:
        width = 64 // segments
        counts = [F.bit_count(F.shiftrightunsigned("lane_0", width * i).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))) for i in range(segments)]
        keys = [f"t{i}" for i in range(segments)]
        moves = [m for m in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, m)) <= radius]
    else:  # steps of one class are as wide as the radius and the ratio
        whole = sum((F.bit_count(f"lane_{i}") for i in range(1, lanes)), F.bit_count("lane_0"))
        counts = [F.floor(whole / (radius + 1)), F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(-log(ratio)) + 1e-9)]
        keys = ["t0", "t1"]
        moves = list(product((-1, 0, 1), repeat=2))
    prints = prints.select("*", *[c.cast("int").alias(k) for c, k in zip(counts, keys, strict=True)])
    tiles = prints.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / tile_rows).cast("int"))
    parted = prints.join(F.broadcast(tiles), keys).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))  # a row for each population count
    tile = F.struct(*[F.col(k) for k in keys], F.col("part"))
    blocks = parted.groupBy(tile.alias("tile")).agg(F.sort_array(F.collect_list(F.struct("node", *[f"lane_{i}" for i in range(lanes)]))).alias("rows"))
    blocks = staged(blocks, "tiles")  # a row holds one part: tile_rows fingerprints, give or take hashing
    near = tiles.select(*keys, "parts", F.explode(F.array(*[F.struct(*[(F.col(k) + d).alias(k) for k, d in zip(keys, m, strict=True)]) for m in moves if m >= (0,) * len(m)])).alias("other"))
    other = tiles.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("parts").alias("o_parts"))
    pairs = near.join(F.broadcast(other), [F.col(f"other.{k}") == F.col(f"o_{k}") for k in keys])
    pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("o_part", F.explode(F.sequence(F.lit(0), F.col("o_parts") - 1)))
    pairs = pairs.select(tile.alias("x"), F.struct(*[F.col(f"o_{k}").alias(k) for k in keys], F.col("o_part").alias("part")).alias("y")).where("x <= y")
    work = pairs.join(blocks.select(F.col("tile").alias("x"), F.col("rows").alias("left")), "x").join(blocks.select(F.col("tile").alias("y"), F.col("rows").alias("right")), "y")
    work = work.select((F.col("x") == F.col("y")).alias("inside"), "left", F.when(F.col("x") != F.col("y"), F.col("right")).alias("right"))

    def unpack(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        held = rows.values
        return held.field(0).to_numpy(), np.stack([held.field(1 + i).to_numpy().view(np.uint64) for i in range(lanes)], 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends_a, ends_b = [], []
            for i, inside in enumerate(batch.column("inside").to_pylist()):
                nodes, left = unpack(batch.column("left")[i])
                right = None
                if not inside:
                    more, right = unpack(batch.column("right")[i])
                    nodes = np.concatenate([nodes, more])
                a, b = tile_links(left, right, radius)
                ends_a.append(nodes[a])
                ends_b.append(nodes[b])
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *ends_a])), pa.array(np.concatenate([empty, *ends_b]))], ["a", "b"])

    return work.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges`` (a, b), by large-star and small-star steps.

    The edges of each round are written to the shared folder; a round that changes nothing is the last. Both steps are
    aggregations that pass on as many edges as they get at most.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = staged(small, "edges")
        if after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            break
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(prints: DataFrame, lanes: int = 1, radius: int = 2, segments: int = 4, tile_rows: int = 4096, ratio: float | None = None) -> DataFrame:
    """``prints`` with root (a number for each component) and component_id: the smallest doc_id in it.

    Rows with equal fingerprints are one group; null identifiers count as larger than any other.
    """
    names = [f"lane_{i}" for i in range(lanes)]
    far = F.lit((1 << 63) - 1)
    entries = staged(prints.groupBy(*names).agg(F.min(F.coalesce("doc_id", far)).alias("first"), F.max("n").alias("n")).withColumn("node", F.monotonically_increasing_id()), "entries")
    roots = components(links(entries, lanes, radius, segments, tile_rows, ratio))
    rooted = entries.join(roots, "node", "left").select(*names, "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(rooted.join(least, "root").select(*names, "root", F.nullif(F.col("component_id"), far).alias("component_id")), "named")
    return prints.join(named, names)


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, segments: int = 4, tile_rows: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Repeated rows and equal
    texts share a component. The smallest non-null doc_id names it; a component of null identifiers alone has a null
    name. An empty table gives an empty result; other columns are not read.
    """
    prints = fingerprints(docs, id_column, text_column, width)
    return near_groups(prints, 1, radius, segments, tile_rows).select("doc_id", F.lower(F.lpad(F.hex("lane_0"), 16, "0")).alias("fingerprint"), "component_id")


def candidate_radius(similarity: float, bits: int) -> int:
    """The gap that a pair of Jaccard similarity ``similarity`` has on average, and six standard deviations."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + 6 * sqrt(bits * p * (1 - p)))


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (row numbers) of the pairs of ``sets`` with Jaccard similarity ``similarity`` or more.

    A row is compared with all others at once through postings of its elements. Rows of the largest tree so far are not: every
    pair with an end outside it is judged from that end, and pairs inside it are connected already.
    """
    k = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, k)
    forest, done = _Forest(k), np.zeros(k, bool)
    ends = np.cumsum(sizes)
    _, element = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    held = np.bincount(element)
    starts = np.cumsum(held) - held
    owner = np.repeat(np.arange(k), sizes)[np.argsort(element, kind="stable")]
    largest = 0
    while True:
        todo = np.flatnonzero(~done & (forest.label != largest))
        if not len(todo):
            return np.array(forest.a, np.int64), np.array(forest.b, np.int64)
        i = todo[0]
        done[i] = True
        mine = element[ends[i] - sizes[i] : ends[i]]
        lengths = held[mine]
        at = np.repeat(starts[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[at], minlength=k)
        near = np.flatnonzero((common > 0) & (common + 1e-9 >= similarity * (sizes[i] + sizes - common)))
        before = len(forest.a)
        forest.add(np.full(len(near), i), near)
        if len(forest.a) > before:
            largest = int(np.bincount(forest.label).argmax())


def exact_links(docs: DataFrame, members: DataFrame, width: int, similarity: float, text_column: str, most: int = 1 << 20) -> DataFrame:
    """Forest edges a, b between ``members`` (_key, _hash, node, root, n) of one root whose texts' shingle sets have ``similarity``.

    Every pair under one root is judged exactly, except pairs that judged pairs connect. A root whose sets sum to over ``most`` shingles is split by
    node into even parts and its parts are compared pairwise, so a task holds two parts at most.
    """
    large = members.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") > most)
    large = large.select("root", F.ceil(2 * F.col("size") / most).cast("int").alias("parts"))  # at most the corpus' shingles / most rows
    other = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    dealt = members.join(F.broadcast(large), "root", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), "parts").cast("int"), F.lit(0)))
    texts = docs.select("_key", "_hash", F.col(text_column).alias("text")).join(dealt, ["_key", "_hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("root", "node", "part", "parts")), pa.array(sets, pa.list_(pa.int64()))], ["root", "node", "part", "parts", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged() -> pa.RecordBatch:
            nodes = np.array(list(block), np.int64)
            a, b = jaccard_forest(list(block.values()), similarity)
            return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        block: dict[int, np.ndarray] = {}  # a row that repeats an identifier and its text repeats its node
        now = None
        for batch in batches:
            elements = batch.column("elements")
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y")), strict=True)):
                if key != now and block:
                    yield judged()
                    block = {}
                now = key
                block[batch.column("node")[i].as_py()] = elements[i].values.to_numpy().view(np.uint64)
        if block:
            yield judged()

    sets = texts.select("root", "node", "part", "parts", "text").mapInArrow(cut, "root long, node long, part int, parts int, elements array<long>")
    blocks = sets.withColumn("other", F.explode(other)).where("parts IS NULL OR part <> other")
    blocks = blocks.select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "node", "elements")
    return blocks.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(compare, "a long, b long")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, lanes: int = 4, tile_rows: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one document of each group of near-duplicates.

    Documents link when the Jaccard similarity of their sets of shingles is ``similarity`` or more. Fingerprints of ``lanes`` x 64 bits
    over distinct shingles find the candidates, with a radius that misses a pair at the threshold about once in a billion; the
    sets of each candidate component are then compared exactly. Of a group the row with the smallest doc_id stays; documents without
    words are one group, null and empty texts among them. Rows that repeat a kept identifier and its text collapse to one; a null identifier counts as
    larger than any other. An empty table stays empty. Columns may have any names.
    """
    names = [f"lane_{i}" for i in range(lanes)]
    far = F.lit((1 << 63) - 1)
    own = F.col(id_column).cast("long")
    keyed = docs.select(F.struct("*").alias("held"), own.alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(own, far).alias("_key"), F.xxhash64(text_of(text_column)).alias("_hash"))
    prints = fingerprints(keyed, "doc_id", "text", width, lanes, distinct=True, keep=("_key", "_hash"))
    sets = prints.groupBy(*names, "n", "shingles").agg(F.min(F.struct("_key", "_hash")).alias("first"))
    entries = staged(sets.withColumn("node", F.monotonically_increasing_id()), "entries")
    near = components(links(entries, lanes, candidate_radius(similarity, 64 * lanes), 1, tile_rows, similarity))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    members = staged(entries.join(near, "node").select("first.*", "node", "root", "n"), "members")
    roots = components(exact_links(keyed, members, width, similarity, "text"))
    kept = entries.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("k")).select("k.*")
    return keyed.join(kept, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"]).select("held.*")
