"""Language identification: held-out accuracy, mixed texts, scripts, and Viterbi against all labellings."""

from itertools import product

import numpy as np
import pytest

from evalloom.llm import language_id as g

SCHEMA = "doc_id long, text string, lang string, score double, spans string"
EN = "the cat sat on the mat and then it went to the house with the other animals because it was late and they were hungry ".split()
DE = "der hund lief über die straße und dann ging er nach hause weil es spät war und die anderen tiere hunger hatten ".split()
RU = "кошка сидела на коврике и потом пошла домой потому что было поздно и другие животные хотели есть ".split()


def texts(words, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words, 12)) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang, 0.0, "") for i, (t, lang) in enumerate([(t, k) for k, w in (("en", EN), ("de", DE), ("ru", RU)) for t in texts(w, 40, 1)])]
    rows += [(900, None, "en", 0.0, ""), (901, "", "de", 0.0, ""), (902, "plus d'une", None, 0.0, "")]
    return g.train(spark.createDataFrame(rows, SCHEMA).repartition(3))


def found(spark, model, rows, **options):
    return {r.doc_id: r for r in g.identify(spark.createDataFrame([(i, t, None, 0.5, "x") for i, t in rows], SCHEMA), model, **options).collect()}


def test_languages_and_scripts(spark, model):
    assert model.languages == ["de", "en", "ru"]
    latin, cyrillic = (g.scripts()[1].index(n) for n in ("LATIN", "CYRILLIC"))
    assert model.written[latin].tolist() == [True, True, False] and model.written[cyrillic].tolist() == [False, False, True]
    rows = found(spark, model, [(1, "THE HOUSE WAS LATE"), (2, "Die Straße war spät"), (3, "было поздно"), (4, "да")])
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "ru", "ru"] and all(r.score == 1 for r in rows.values())


def test_texts_without_letters(spark, model):
    rows = found(spark, model, [(1, None), (2, ""), (3, " 12,5 % ---\n"), (4, "́"), (5, "漢字")])
    assert all((rows[i].lang_pred, rows[i].score, rows[i].spans) == ("und", 0.0, []) for i in (1, 2, 3, 4))
    assert rows[5].lang_pred in model.languages  # a letter, of a script that no language has


def test_spans_of_mixed_texts(spark, model):
    parts = [" ".join(EN[:15]), " ".join(DE[:15]), " ".join(RU[:5]), " ".join(EN[3:20])]
    text = ". ".join(parts)
    row = found(spark, model, [(1, text)], penalty=6.0)[1]
    assert [s.lang for s in row.spans] == ["en", "de", "ru", "en"] and [text[s.start : s.end] for s in row.spans] == parts
    letters = [sum(c.isalpha() for c in p) for p in parts]
    assert row.lang_pred == "en" and row.score == pytest.approx((letters[0] + letters[3]) / sum(letters))
    assert len(found(spark, model, [(1, text.replace(parts[2], "на"))], penalty=1000.0)[1].spans) == 1


def test_places_after_long_and_cut_texts(spark, model, monkeypatch):
    text = "\n".join(texts(EN, 30, 5) + texts(DE, 30, 6))
    whole = g.label_texts([text, None, text], model, 12.0, 0.25)
    monkeypatch.setattr(g, "PIECE", 50)
    cut = g.label_texts([text, None, text], model, 12.0, 0.25)
    assert all((getattr(whole, k) == getattr(cut, k)).all() for k in ("first", "start", "length", "label"))
    assert len(set(whole.label.tolist())) == 2


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 3
    first, row = np.array([0, 0, 5, 11, 12, 18]), rng.integers(0, 9, 18)
    out = g.viterbi(scores, row, first, 2.0)
    for s, e in zip(first[:-1], first[1:], strict=True):
        value = lambda path: sum(scores[row[s + i], k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        assert value(out[s:e].tolist()) == pytest.approx(max(value(p) for p in product(range(3), repeat=int(e - s))), abs=1e-4)


def test_word_scores_are_sums_of_ngrams(model):
    words = g.read(["Über the cat", "the"])
    again = g.read(["the"])
    one, two = g.word_scores(words, model, 1.0)[words.different], g.word_scores(again, model, 1.0)
    assert len(words.first) == 3 and np.allclose(one[1], two[0]) and np.allclose(one[3], two[0])
    held = [b for o, bucket in g.grams(again, len(model.table)) for b in bucket.tolist()]
    assert len(held) == 3 + 4 + 3 + 2 + 1 and np.allclose(two[0], model.table[held].sum(0), atol=1e-4)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    nothing = g.train(empty)
    assert nothing.languages == [] and g.identify(empty, nothing).collect() == []
    assert found(spark, nothing, [(1, "the cat"), (None, None)])[1].lang_pred == "und"


def test_scripts_without_spaces_and_long_runs(spark, model):
    words = g.read(["a" * 100 + "я" * 3 + " ́x"])
    assert words.length.tolist() == [24, 24, 24, 24, 4, 3, 1] and words.start.tolist()[:2] == [0, 24]
    assert found(spark, model, [(1, "a" * 100_000)])[1].lang_pred in model.languages
