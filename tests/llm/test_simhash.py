import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalloom.llm import simhash

SCHEMA = "doc_id long, text string, n long, lane_0 string, root int"


def brute_print(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("tile_rows", [3, 4096])
def test_links_are_exact(spark, tile_rows):
    random.seed(7)
    prints = [0, (1 << 64) - 1]
    for _ in range(60):
        p = random.getrandbits(64)
        prints.append(p)
        for _ in range(random.randrange(5)):  # chains of one to three bits
            for b in random.sample(range(64), random.randrange(1, 4)):
                p ^= 1 << b
            prints.append(p)
    prints += prints[10:20]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(100 + i, p, 1) for i, p in enumerate(signed)], "doc_id long, lane_0 long, n long")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, radius=2, tile_rows=tile_rows).collect()}
    assert got == {100 + i: 100 + c for i, c in enumerate(brute_components(prints, 2))}


def test_documents_match_brute_force(spark):
    random.seed(8)
    words = [f"Wört{i}" for i in range(50)]
    base = " ".join(random.choices(words, k=400))
    texts = [None, "", " \t\n", "one", "one two", "ONE two", base, base + " tail", base.replace("Wört1 ", "x ", 1), "a b c " * 30_000]
    texts += [" ".join(random.choices(words, k=random.randrange(1, 60))) for _ in range(60)]
    rows = [(i + 1, t, 0, "x", 1) for i, t in enumerate(texts)] + [(7, base, 0, "x", 1), (None, base, 0, "x", 1), (None, "nobody else " * 9, 0, "x", 1)]
    got = sorted(map(tuple, simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    prints = [brute_print(r[1], 3) for r in rows]
    comps = brute_components(prints, 2)
    ids = {}
    for (i, *_), c in zip(rows, comps, strict=True):
        ids.setdefault(c, []).append(i)
    want = [(r[0], f"{p:016x}", min((x for x in ids[c] if x is not None), default=None)) for r, p, c in zip(rows, prints, comps, strict=True)]
    assert got == sorted(want, key=str)
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_tile_of_close_rows_reports_a_forest():
    rows = np.array([[1 << b] for b in range(64)] + [[0]], np.uint64)
    a, b = simhash.tile_links(rows, None, 2)
    assert len(a) == 64 and len(set(a.tolist()) | set(b.tolist())) == 65
    a, b = simhash.tile_links(rows[:30], rows[30:], 2)
    assert len(a) == 64


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 301: 300}


def test_pipeline_form_keeps_one_of_each_group(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(3000)]
    bases = [random.choices(words, k=300) for _ in range(30)]
    rows, group = [], {}
    for g, base in enumerate(bases):
        for c in range(3):
            text = list(base)
            for _ in range(c):
                text[random.randrange(300)] = "changed"
            rows.append((len(rows), " ".join(text), 0, "x", g))
            group[len(rows) - 1] = g
    rows += [(500, None, 0, "x", 1), (501, "", 0, "x", 1), (0, rows[0][1], 0, "x", 0), (502, " ".join(bases[0][:150]), 0, "x", 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", _key int, _hash int, held int")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([3 * g for g in range(30)] + [500, 502])
    assert simhash.drop_near_duplicates(df.where(F.lit(False))).collect() == []


def brute_jaccard(texts, similarity):
    sets = [{h for part in simhash.shingle_hashes((t or "").encode(), 5) for h in part.tolist()} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("most", [400, 1 << 20])
def test_near_duplicates_are_exact(spark, most, monkeypatch):
    random.seed(10)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one", "one two", "a b c d e f g h", "a b c d e f g h i"]
    for _ in range(40):
        base = random.choices(words, k=random.randrange(40, 300))
        texts.append(" ".join(base))
        for cut in (0.3, 0.2, 0.12, 0.08, 0.04):  # similarities of about 0.5 to 0.95
            texts.append(" ".join(base[int(cut * len(base)) :] + random.choices(words, k=random.randrange(3))))
    exact = getattr(simhash, "exact_links", None)
    monkeypatch.setattr(simhash, "exact_links", lambda *args: exact(*args, most), raising=False)
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())
    assert got == [i for i, r in enumerate(brute_jaccard(texts, 0.8)) if i == r]
