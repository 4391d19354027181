import random

import pytest
import regex

from evalloom.llm import decontamination as d

SCHEMA = "doc_id long, text string, item string, hash long, row string, _hash int, text_hash int, size int, held int"
MORE = ("x", 1, "r", 2, 3, 4, 5)
ITEMS = [
    (1, "Tom has 3 apples and buys 4 more apples. How many apples does Tom have after he eats 3 of them today?"),
    (2, "A train runs at $5 per km for 12 miles towards the big town near Paris and then stops there."),
    (3, None),
    (4, "short item"),
    (5, "Who wrote War and Peace in 1869"),
    (6, "Add 12 and 15 and 18 and 21 and 24"),
    (None, "an item without any identifier at all is never looked for in here"),
]
TOKEN = regex.compile(r"\d+(?:[.,:/]\d+)*|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[.!?]|[$€£%°]")
KINDS = {d.PLAIN: "", d.NUMBER: "<number>", d.NAME: "<name>", d.UNIT: "<unit>"}


def template(text, reading):
    """Words one by one: (place, kind, word or joined values)."""
    found, fresh = [], True
    for token in TOKEN.findall(text):
        if token in ".!?":
            fresh = True
            continue
        found.append([token, token.lower().replace("’", "'"), fresh])
        fresh = False
    number = [t[0].isdigit() or low in d.NUMBER_WORDS for t, low, _ in found]
    out = []
    for i, (token, low, fresh) in enumerate(found):
        kind = d.PLAIN
        if reading == d.LITERAL:
            pass
        elif number[i]:
            kind = d.NUMBER
        elif (i and number[i - 1] and (low in d.UNITS or low in "%°")) or (i + 1 < len(found) and number[i + 1] and low in "$€£"):
            kind = d.UNIT
        elif reading != d.NOWHERE and token[0].isupper() and (reading == d.EVERYWHERE or not fresh):
            kind = d.NAME
        if out and kind != d.PLAIN and out[-1][1] == kind and not fresh:
            out[-1] = (out[-1][0], kind, f"{out[-1][2]} {low}")
        else:
            out.append((i, kind, low))
    return out, len(found)


def cut(text, reading, size, least):
    words, n = template(text, reading)
    for i in range(len(words) - size + 1):
        part = words[i : i + size]
        if sum(k == d.PLAIN for _, k, _ in part) >= least:
            yield part[0][0], tuple(KINDS[k] or v for _, k, v in part), [(k, v) for _, k, v in part]


def brute(text, items, window=8, min_words=5, coverage=0.5, drift=8):
    text, found = text or "", []
    for item, body in items:
        if item is None or not body:
            continue
        ours = {r: list(cut(body, r, window, min_words)) for r in (1, 2, 3)}
        size, least = window, min_words
        if not ours[1]:
            n = template(body, d.LITERAL)[1]
            ours[d.LITERAL] = list(cut(body, d.LITERAL, size := min(window, n), 0))
            if size < d.LEAST_LITERAL and template(text, d.LITERAL)[1] != size:
                continue
        hits = []
        for r, mine in ours.items():
            theirs = list(cut(text, r, size if r == d.LITERAL else window, 0 if r == d.LITERAL else least))
            hits += [(r, p, (q - p) // drift, list(zip(v, w, strict=True))) for p, k, v in mine for q, j, w in theirs if j == k]
        need = {r: len(mine) for r, mine in ours.items() if mine}
        for reading, n in [*need.items(), (0, max(need.values(), default=0))]:
            for band in {b + e for _, _, b, _ in hits for e in (0, 1)}:
                own = [h for h in hits if reading in (0, h[0]) and band in (h[2], h[2] + 1)]
                pairs = {(a, b) for h in own for (a, b) in h[3] if a[0] != d.PLAIN}
                least = -(-n * coverage // 1)
                if n and len({h[1] for h in own}) >= least and len({a for a, _ in pairs}) == len(pairs):
                    found.append(item)
    if text:  # the aim itself: an item's words in a row are found, whatever else is there
        words = [v for _, _, v in template(text, d.LITERAL)[0]]
        for item, body in items:
            mine = [v for _, _, v in template(body or "", d.LITERAL)[0]]
            if item is not None and len(mine) >= d.LEAST_LITERAL and any(words[i : i + len(mine)] == mine for i in range(len(words) - len(mine) + 1)):
                found.append(item)
    return sorted(set(found))


@pytest.mark.parametrize("reading", [1, 2, 3, 4])
def test_templates(reading):
    text = "Then Ann Lee paid $3.50 for two kg. And Bob’s? 5% of it, ÉTÉ x1y 1,000.5. ǅ"
    words = d.read([text, "", "and so on. Zed 3 km"])
    want = [[*template(text, reading)[0]], [], [*template("and so on. Zed 3 km", reading)[0]]]
    w = d.windows(words, reading, 1, 0)
    for i, rows in enumerate(want):
        own = w.text == i
        assert w.place[own].tolist() == [r[0] for r in rows]
        assert w.kinds[w.first[own]].tolist() == [r[1] for r in rows]
    shown = [KINDS[k] or v for rows in want for _, k, v in rows]
    assert len(set(zip(w.hash.tolist(), shown))) == len(set(shown)) == len(set(w.hash.tolist()))
    assert len(d.windows(d.read([""]), reading, 8, 5).text) == 0


@pytest.fixture(scope="module")
def docs():
    random.seed(4)
    noise = [f"word{chr(97 + i)}" for i in range(20)]
    fill = lambda n: " ".join(random.choices(noise, k=n))
    texts = [
        f"{fill(30)}. {ITEMS[0][1]} {fill(20)}",
        f"{fill(30)}. Sue has 7 apples and buys 9 more apples. How many apples does Sue have after he eats 7 of them today? {fill(5)}",
        f"{fill(30)}. Sue has 7 apples and buys 9 more apples. How many apples does Ann have after he eats 8 of them today? {fill(5)}",
        "A TRAIN runs at €9 per km for 44 miles towards the big town near Rome and then stops there.",
        fill(400), "", None, "short item", "Short item!", "a short item indeed", f"{ITEMS[0][1]} {ITEMS[1][1]}",
        f"{fill(60_000)} . {ITEMS[1][1]}",
        ITEMS[1][1].replace("12", "twenty five").replace("Paris", "New York"),
        ITEMS[1][1].replace("towards", "straight towards"),
        ITEMS[0][1].lower(), ITEMS[1][1].upper(), f"Do you know who wrote war and peace in 1869, {fill(9)}", f"{fill(9)} add 12 and 15 and 18 and 21 and 24 {fill(9)}", "add 1 and 2 and 3 and 4 and 5",
    ]
    return [(i, t, *MORE) for i, t in enumerate(texts)] + [(0, texts[4], *MORE), (0, texts[0], *MORE), (None, texts[1], *MORE)]


@pytest.mark.parametrize("max_filter", [0, 1000])
def test_matches_brute_force(spark, docs, max_filter):
    items = spark.createDataFrame([(*x, "a", 1) for x in ITEMS] + [(1, ITEMS[0][1], "a", 1)], "item_id long, text string, doc_id string, row long")
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    want = {r[1]: brute(r[1], ITEMS) for r in docs}
    got = sorted(((r.doc_id, r.contaminated, r.kept, r.n_items, list(r.item_ids)) for r in d.decontaminate(df, items, max_filter=max_filter).collect()), key=str)
    assert got == sorted(((r[0], bool(f := want[r[1]]), not f, len(f), f) for r in docs), key=str)
    found = [want[r[1]] for r in docs]
    assert [found[i] for i in (1, 2, 3, 7, 9, 11)] == [[1], [], [2], [4], [], [2]]
    assert [found[i] for i in (12, 13, 14, 15, 16, 17, 18)] == [[2], [2], [1], [2], [5], [6], []]
    kept = d.drop_contaminated(df, items, max_filter=max_filter)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if not want[r.text])


@pytest.mark.parametrize("words", [["alpha", "Beta", "12", "km", "gamma.", "délta"], ["12", "$", "3.5", "Ann", "x"]])
def test_pieces_of_a_long_text_have_its_windows(monkeypatch, words):
    random.seed(3)
    run = " ".join(str(random.randrange(10**6)) for _ in range(600))
    text = " ".join(random.choices(words, k=3000)) + f" so {run} " + " ".join(random.choices(words, k=1500))
    shapes = [(1, 8), (2, 8), (3, 8), (4, 5)]
    rows = lambda texts: [(r, p, h, c, tuple(v)) for i, p, h, c, r, v, _ in d.document_windows(texts, shapes, 3, None) if len(texts) == 1 or i == 1]
    whole = rows([text])
    for piece in (300, 2000, 7001):
        monkeypatch.setattr(d, "PIECE", piece)
        assert sorted(rows(["x", text, "y"])) == sorted(whole)
    assert list(d.document_windows(["a" * 9000, ""], shapes, 5, None)) == []


REPEATED = "Tom has 3 red apples in the box. Tom has 5 red apples in the box. Tom has 7 red apples in the box. Tom has 9 red apples in the box. How many red apples does Tom have in all the boxes today?"


def test_items_with_sentences_alike(spark):
    asked = REPEATED.replace("Tom", "Ann").replace("3", "4").replace("9", "11")
    clash = asked.replace("does Ann have", "does Bob have")
    other = "Tom has 3 red apples in the box. " * 2
    texts = [REPEATED, f"Well. {REPEATED} And so on.", asked, clash, REPEATED.replace("Tom has 7", "And then Tom has 7"), REPEATED.replace("How many", "So how many"), other, REPEATED + " " + REPEATED, REPEATED.upper()]
    items = spark.createDataFrame([(1, REPEATED)], "item_id long, text string")
    df = spark.createDataFrame([(i, t, *MORE) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.contaminated for r in d.decontaminate(df, items).collect()}
    assert [got[i] for i in range(9)] == [True, True, True, False, True, True, False, True, True]


def longest(hits, drift):
    """Longest line-up by trying all predecessors."""
    order, best = sorted(hits), {}
    for p, a in order:
        best[p, a] = 1 + max((n for (q, b), n in best.items() if q < p and q + b < p + a), default=0)
    return max(best.values(), default=0)


def test_line_ups():
    rng = random.Random(6)
    assert d.line_up(set(), 8) == []
    for _ in range(200):
        hits = {(rng.randrange(12), rng.randrange(-8, 8)) for _ in range(rng.randrange(1, 40))}
        line = d.line_up(hits, 8)
        assert set(line) <= hits and all(p < q and p + a < q + b for (p, a), (q, b) in zip(line, line[1:], strict=False))
        assert len(line) == longest(hits, 8)
    straight = {(p, 0) for p in range(10)} | {(p, p % 5 - 2) for p in range(10)}
    assert d.line_up(straight, 8) == [(p, 0) for p in range(10)]


def test_copies_between_random_texts(spark):
    rng = random.Random(8)
    pattern = ["Ann pays {} dollars for the small lamp.", "Then {} people in {} see it.", "There are {} of them in the {} boxes there.", "It is near Rome."]
    make = lambda: " ".join(rng.choice(pattern).format(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(3, 9)))
    items = [(i, make()) for i in range(30)]
    docs = [(i, f"{make() if i % 3 else ''} {items[i % 30][1]} {make() if i % 2 else ''}", *MORE) for i in range(60)]
    df = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: set(r.item_ids) for r in d.decontaminate(spark.createDataFrame(docs, SCHEMA), df).collect()}
    assert all(i % 30 in found[i] for i in range(60))


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame(docs, SCHEMA)
    assert not any(r.contaminated for r in d.decontaminate(df, items).collect())
    assert d.decontaminate(df.limit(0), items).collect() == []


def test_names_at_sentence_beginnings(spark):
    item = "Natalia has 4 red crates with pens inside them. Natalia gives 2 crates to Ben after the lunch. Natalia buys 6 more crates in the town. How many crates does Natalia have now?"
    asked = item.replace("Natalia", "Maria").replace("4", "5")
    texts = [item, asked, f"We saw it in May. {asked} The end.", "", "Maria has 5 red crates. The rest is about other things in the town."]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(i, t, *MORE) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.contaminated for r in d.decontaminate(df, items).collect()}
    assert [got[i] for i in (0, 1, 2, 4)] == [True, True, True, False]
