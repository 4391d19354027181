import math
import random
import zlib
from itertools import pairwise

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from evalloom.llm import queries
from evalloom.llm.sharding import curve, hilbert_shards, name_bounds, quantised_name, write_shards

SCHEMA = "doc_id long, text string, lang string, source string, shard string, slot long"


def test_neighbours_on_the_curve_differ_by_one_step(spark):
    cells = spark.range(512).select(*[F.expr(f"cast((id div {8**i}) % 8 as int)").alias(f"c{i}") for i in range(3)])
    rows = sorted(curve(cells, ["c0", "c1", "c2"], 3).collect(), key=lambda r: r.curve)
    assert [r.curve for r in rows] == list(range(512))
    assert all(sum(abs(a[i] - b[i]) for i in range(3)) == 1 for a, b in pairwise(rows))


def test_counts_differ_by_one_and_slots_are_gapless(spark):
    texts = [None, "", "same", "same", "same", "é" * 50_000] + [f"text {i}" for i in range(40)]
    docs = spark.createDataFrame([(i if i else None, t, "en" if i % 3 else None, f"s{i % 5}", "x", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = hilbert_shards(docs).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(k, [])) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].size == 1 and by_id[1].size == 1 and by_id[5].size == 100_001
    places = sorted(r.shard * 1000 + r.slot for r in rows if r.text_crc32 == by_id[2].text_crc32)
    ordered = sorted(r.shard * 1000 + r.slot for r in rows)
    at = ordered.index(places[0])
    assert ordered[at : at + 3] == places
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_fewer_rows_than_shards_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", "x", 1), (1, "a", "en", "s", "x", 1)], SCHEMA)
    assert sorted((r.shard, r.slot) for r in hilbert_shards(docs).collect()) == [(0, 0), (1, 0)]
    assert hilbert_shards(docs.limit(0)).collect() == []


def place_on_curve(x, bits):
    """Hilbert index by Skilling's loops over one point."""
    x, n, q = list(x), len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(x[i] >> b & 1) for b in range(bits - 1, -1, -1) for i in range(n)), 2)


def hashed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def brute(rows, shards=16, bits=5):
    """(doc_id, shard, slot, size, crc) of rows (doc_id, text, lang, source)."""
    groups = {}
    for _, t, lang, source in rows:
        groups.setdefault(t or "", []).append((lang, source))
    least_name = {t: [min((v[k] for v in pairs if v[k] is not None), default=None) for k in (0, 1)] for t, pairs in groups.items()}
    ranks = []
    for k in (0, 1):
        values = sorted({v[k].encode() for v in least_name.values() if v[k] is not None})
        ranks.append({v.decode(): 1 + r * ((1 << bits) - 1) // len(values) for r, v in enumerate(values)})
    keyed = []
    for i, t, *_ in rows:
        text = t or ""
        size = len(text.encode()) + 1
        cells = [0 if v is None else ranks[k][v] for k, v in enumerate(least_name[text])] + [min(int(math.log2(1 + size) * 2), (1 << bits) - 1)]
        keyed.append((place_on_curve(cells, bits), hashed(text), zlib.crc32(text.encode()), i is not None, i or 0, i, size))
    least, more = divmod(len(rows), shards)
    ends = [(s, k) for s in range(shards) for k in range(least + (s < more))]
    return sorted(((k[5], s, slot, k[6], k[2]) for k, (s, slot) in zip(sorted(keyed), ends, strict=True)), key=str)


def some_rows():
    random.seed(7)
    texts = [None, "", *("same" for _ in range(30)), *("é" * random.randrange(1, 3000) for _ in range(40)), *(f"text {i} " * random.randrange(1, 90) for i in range(300))]
    return [(i, t, random.choice(["en", "fr", "de", None]), random.choice(["web", "book", "news", None])) for i, t in enumerate(texts)] + [(None, "no id", "en", "web")]


def test_query_matches_brute_force(spark, tmp_path):
    rows = some_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_hilbert_shards(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.shard, r.slot, r.size, r.text_crc32) for r in got), key=str) == brute(rows)


def test_filters_on_several_columns_skip_files(spark, tmp_path):
    rows = [(i, f"{i:04d}" + "w" * 4 ** random.randrange(6), random.choice(["en", "fr", "de", "es"]), random.choice(["web", "book", "news", "code"]), i, 1, 2) for i in range(2000)]
    rows = [(*r[:6], len(r[1])) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, slot int, held int")
    write_shards(docs, hilbert_shards(docs), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(tuple, back.drop("shard_folder").collect())) == sorted(rows) and back.columns == [*docs.columns, "shard_folder"]
    files = []  # for every file the smallest and largest value of each column, as its footer has them
    for path in tmp_path.glob("shards/*/*.parquet"):
        footer = pq.ParquetFile(path).metadata
        files.append({})
        for c in ("lang", "source", "held"):
            at = footer.schema.names.index(c)
            found = [footer.row_group(g).column(at).statistics for g in range(footer.num_row_groups)]
            files[-1][c] = min(x.min for x in found), max(x.max for x in found)
    assert len(files) >= 16
    reads = lambda **values: sum(all(f[c][0] <= v <= f[c][1] for c, v in values.items()) for f in files) / len(files)
    assert max(reads(lang=x) for x in ("en", "fr", "de", "es")) <= 0.6
    assert max(reads(source=x) for x in ("web", "book", "news", "code")) <= 0.6
    assert max(reads(lang=x, source=y) for x in ("en", "fr", "de", "es") for y in ("web", "book", "news", "code")) <= 0.35


def test_cells_keep_the_order_of_names(spark):
    values = [None, "", *(f"n{i:03d}" for i in range(100)), "é"]
    names = spark.createDataFrame([(v, "one") for v in values], "a string, b string")
    a, b = name_bounds(names, 5)
    assert len(a) == 31 and b == [("one", 1)]
    cells = [r.cell for r in names.sort("a").select(quantised_name(F.col("a"), a).alias("cell")).collect()]  # nulls first
    assert cells == [0, *(1 + r * 31 // 102 for r in range(102))]
    assert name_bounds(names.where("a IS NULL").limit(0), 5) == [[], []]
