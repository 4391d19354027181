import math
import random
import time

import pytest

from evalloom.llm import queries, toxicity
from evalloom.llm.common import fold, fold_of
from evalloom.llm.toxicity import ToxicityModel, classify, drop_toxic, fold_text, train

SCHEMA = "doc_id long, text string, score string, y long"


def test_folding_undoes_disguises():
    assert fold_text("1D10T, ТRАSH! sс​um") == " idiot trash scum "
    assert fold_text("") == "  "
    assert fold_text("ｉｄｉｏｔ") == " idiot "
    assert fold_text("ídiot 𝗂𝖽𝗂𝗈𝗍 I.D.I.O.T. a b") == " idiot idiot idiotab "  # single letters in a row are one word
    assert fold_text("an i d i o t, a b c-d is") == " an idiotabcd is " and fold_text("a b is") == " a b is "


def test_exceptions_and_length():
    model = ToxicityModel({" trash ": 2.0, " idio": 3.0})
    matcher = model.matcher()
    assert model.strength(matcher, "the trash can is full")[1] == 0
    assert model.strength(matcher, "this trash is idiotic trash")[1] == 3
    short, long = model.strength(matcher, "trash"), model.strength(matcher, "trash " + "fine " * 500)
    assert short[0] > long[0] > 0
    assert model.strength(matcher, None) == (0.0, 0) == model.strength(ToxicityModel({}, ()).matcher(), "x")
    assert model.strength(matcher, "retrash idio")[1] == 1


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(5)
    words = [f"w{random.randrange(16**4):04x}q" for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = random.choices(words, k=random.randrange(20, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                text.insert(random.randrange(len(text)), random.choice(["vekora", "vekoran", "zullig", "V3K0RA"]))
        rows.append((i, " ".join(text), "s", 7))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, "s", 7), (9000, "", "s", 7), (9000, "", "s", 7), (9001, "word " * 100_000 + "vekora zullig " * 40, "s", 7)], SCHEMA)
    return docs, spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), (7, 0, 5)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = train(docs, labels.where(fold_of("doc_id", 3) != 1), min_texts=3)
    rows = {r.doc_id: r for r in classify(docs, model).collect()}
    held = [r.doc_id for r in docs.where(fold_of("doc_id", 3) == 1).where("doc_id < 9000").collect()]
    assert len(held) > 100
    assert sum(rows[i].predicted == (i % 5 == 0) for i in held) / len(held) > 0.97
    assert rows[9001].predicted == 1 and rows[9000].predicted == 0 and rows[None].predicted == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 9000").count() == 2


def test_long_words_and_learned_exceptions(spark):
    random.seed(6)
    words = [f"w{random.randrange(16**4):04x}q" for _ in range(300)]
    long = "x" * 39 + "insult"
    rows, labels = [], []
    for i in range(900):
        text = random.choices(words, k=60)
        toxic = i % 3 == 0
        if toxic:
            text[random.randrange(60)] = random.choice([long, "gorbak"])
        elif i % 3 == 1:
            text[20:22] = ["gorbak", "tree"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    model = train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    matcher = model.matcher()
    hits = lambda text: model.strength(matcher, text)[1]
    assert hits(f"a {long} b") == 1
    assert hits("the gorbak tree is") == 0
    if " gorbak " in model.lexicon or hits("a gorbak"):  # it is learned with its harmless neighbour, or not at all
        assert "gorbak tree" in model.exceptions


def test_exceptions_take_linear_time():
    model = toxicity.ToxicityModel(dict(toxicity.SEED_LEXICON and {f" {w} ": v for w, v in toxicity.SEED_LEXICON.items()}))
    text = "trash can idiot " * 80_000
    began = time.process_time()
    hits = model.hits(model.matcher(), toxicity.fold_text(text))
    assert len(hits) == 80_000 and time.process_time() - began < 10
    again = "trash bag of a circus clown fish, loser bracket loser"
    assert len(model.hits(model.matcher(), toxicity.fold_text(again))) == 1


def test_spared_hits_are_those_inside_a_phrase():
    rng = random.Random(3)
    words = ["aa", "bb", "cc"]
    for _ in range(200):
        phrases = tuple(" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(3))
        model = toxicity.ToxicityModel({" aa ": 1.0, " bb": 2.0}, phrases)
        text = toxicity.fold_text(" ".join(rng.choices(words, k=rng.randrange(12))))
        spans = [(i, i + len(f)) for f in map(toxicity.fold_text, phrases) for i in range(len(text)) if text.startswith(f, i)]
        want = {i for i in range(len(text)) if text.startswith((" aa ", " bb"), i) and not any(a <= i < b - 1 for a, b in spans)}
        assert set(model.hits(model.matcher(), text)) == want


def test_a_seed_has_the_weight_that_the_labels_give_it(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(16**4):04x}q" for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=40)
        text[5:6] = ["trash"] if i % 2 else ["idiot"] if i % 4 == 0 else ["plain"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0 or i % 8 == 1)))
    model = train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " trash " not in model.lexicon and model.lexicon[" idiot "] > 3 and model.lexicon[" moron "] == 3.0


def plain_score(model, text):
    """The score by substring search alone, a pattern at a time."""
    folded = toxicity.fold_text(text or "")
    best = {}
    for pattern, weight in model.lexicon.items():
        at = folded.find(pattern)
        while at >= 0:
            best[at] = max(best.get(at, 0.0), weight)
            at = folded.find(pattern, at + 1)
    for phrase in map(toxicity.fold_text, model.exceptions):
        at = folded.find(phrase)
        while at >= 0:
            best = {s: w for s, w in best.items() if not at <= s < at + len(phrase) - 1}
            at = folded.find(phrase, at + 1)
    return model.score(sum(best.values()) / math.log2(folded.count(" ") + 1))


def test_query_matches_brute_force(spark, tmp_path, corpus):
    docs, labels = corpus
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    made = []
    original = toxicity.classify
    toxicity.classify = lambda d, model, **k: (made.append(model), original(d, model, **k))[1]
    try:
        got = {r.doc_id: r for r in queries.op1_toxicity(spark, str(tmp_path)).collect()}
    finally:
        toxicity.classify = original
    for r in docs.collect():
        want = plain_score(made[0], r.text)
        assert got[r.doc_id].score == pytest.approx(want) and got[r.doc_id].predicted == int(want >= 0.7)
        assert got[r.doc_id].held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1)


def test_without_labels_and_without_rows(corpus, spark):
    docs, labels = corpus
    model = train(docs, labels.limit(0))
    assert set(model.lexicon) == {f" {w} " for w in toxicity.SEED_LEXICON}
    assert classify(docs.limit(0), model).collect() == []
    assert classify(spark.createDataFrame([(1, "you idiot moron", "s", 1)], SCHEMA), model).first().predicted == 1
