import random

import pytest

import corpus_pipeline
from evalloom.llm import simhash, toxicity
from tests.llm.test_decontamination import brute as found_items
from tests.llm.test_line_dedup import brute as removed_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(12)
    words = [f"term{i}" for i in range(900)]
    item = "Which of the seven rivers in the far north flows into the great lake near the old town of Kem today"
    rows = []
    for i in range(200):
        body = random.choices(words, k=random.randrange(120, 200))
        if i % 10 == 0:
            for _ in range(6):
                body.insert(random.randrange(len(body)), "vekora")
        text = " ".join(body[:60]) + "\n" + " ".join(body[60:])
        rows.append((i, f"{text} . {item}" if i % 10 == 3 else text, "en", "s", len(text)))
    rows += [(1000 + i, " ".join(t.replace("\n", " ").split()[:-1]) + " end", "en", "s", 1) for i, t, *_ in rows[40:60]]
    rows += [(2000, None, "en", "s", None), (2001, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}


def test_stages_match_brute_force(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    matcher = model.matcher()
    left = {i: t for i, t in texts.items() if model.score(model.strength(matcher, t)[0]) < 0.7}
    assert sum(i % 10 == 0 and i < 200 for i in texts) == 20 and not any(i < 200 and i % 10 == 0 for i in left)
    gone = removed_lines(list(left.items()))
    left = {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t]) for i, t in left.items()}
    prints = {}
    for i, t in sorted(left.items()):
        parts = list(simhash.shingle_hashes((t or "").encode(), 5))
        distinct = [simhash.np.unique(simhash.np.concatenate(parts))] if parts else []
        prints[i] = (int.from_bytes(simhash.fingerprint(distinct, 4).tobytes(), "little"), sum(map(len, distinct)))
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if j < i and (prints[i][0] ^ prints[j][0]).bit_count() <= 51:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {i for i, t in left.items() if not found_items(t, items)}
    assert {i for i in left if i % 10 == 3 and i < 200}.isdisjoint(kept)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)


def test_stages_return_the_documents_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
