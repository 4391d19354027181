"""Alignments against plain merging of whole texts' tokens by the tokenizers' own libraries."""

import hashlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalloom.llm import token_alignment as t

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SCHEMA = "doc_id long, text string, row string, moves int"
ODD = [
    None, "", " ", "  ", " a", "a ", "a  b", "\n", "a\n b", "x\t y", "▁", "a▁b", "<s> </s> <unk>", "<|endoftext|> x", " a  b", "é ́x", "　漢字かな 한국", "\x1c \x1ca", "!\x1c b", "it's  we'll\r\n\r\n  x",
    " \n \n", " " * 50 + "a" + " " * 70, "\x00a \x00", "😀 👍🏽 b", "a" * 3000, "ab " * 2000, "x  y", "﻿ a", "The café's naïve 12.5% — ok?",
]


@cache
def libraries():
    a = Tokenizer.from_file(f"/opt/tokenizers/{t.A_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"/opt/tokenizers/{t.B_FILE}")


def whole_tokens(text):
    """Ids and bytes of both sides, of the whole text at once."""
    a, b = libraries()
    alphabet = t.byte_alphabet()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    same = b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()
    return (x, y, bytes_a, bytes_b) if text and same else ([], [], [], [])


def spans(parts):
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True)) if parts else []


def plain(docs):
    count, held = Counter(), []
    for doc, text in docs:
        x, y, bytes_a, bytes_b = whole_tokens(text or "")
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links, j = [], 0
        for i, (s, e) in enumerate(at_a):
            while at_b[j][1] <= s:
                j += 1
            links += [(x[i], y[k]) for k in range(j, len(at_b)) if at_b[k][0] < e] if e - s > 64 else [(x[i], y[k]) for k in range(j, min(len(at_b), j + 70)) if at_b[k][0] < e]
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        inside = lambda ids, at, low, high: ",".join(str(i) for i, (s, e) in zip(ids, at, strict=True) if low <= s and e <= high)
        text_groups = ";".join(f"{inside(x, at_a, low, high)}|{inside(y, at_b, low, high)}" for low, high in zip([0, *cuts], cuts, strict=False))
        count.update(links)
        held.append((doc, len(x), len(y), len(cuts), links, hashlib.sha256(text_groups.encode()).hexdigest() if x else ""))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((d, a, b, g, len(p), sum(count[q] == best[q[1]] for q in p), sum(count[q] for q in p), h) for d, a, b, g, p, h in held), key=str)


def result(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=str)


def test_odd_texts_and_repeats(spark):
    docs = [*enumerate(ODD), (5, "a  b"), (5, "a  b"), (None, "hello world")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    assert result(t.cross_tokens(df)) == plain(docs)


def test_counts_beyond_the_broadcast(spark):
    docs = [*enumerate(ODD)]
    made = t.align(spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA))
    pairs = t.pair_counts(made)
    for most in (0, 3, 50):
        assert result(t.digests(made, pairs, max_head=most)) == plain(docs)
    assert t.frequent(pairs, 50).count() <= 50


def test_empty_table(spark):
    assert t.cross_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_documents(spark):
    docs = [(r.doc_id, r.text[:3000]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    assert result(t.cross_tokens(spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA))) == plain(docs)


def test_links_are_overlaps(spark):
    text = "An unforgettable naïveté, 1234567 times"
    rows = t.token_links(t.align(spark.createDataFrame([(7, text, "x", 1)], SCHEMA))).collect()
    x, y, bytes_a, bytes_b = whole_tokens(text)
    at_a, at_b = spans(bytes_a), spans(bytes_b)
    assert sorted((r.a_place, r.b_place, r.a, r.b) for r in rows) == sorted((i, j, x[i], y[j]) for i, p in enumerate(at_a) for j, q in enumerate(at_b) if p[0] < q[1] and q[0] < p[1])
    assert {r.doc_id for r in rows} == {7} and max(r.group for r in rows) + 1 == len({e for _, e in at_a} & {e for _, e in at_b})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x0b\x1c\x85 　aB'sé1.▁漢́😀-"), max_size=40))
def test_tokens_of_pieces_are_those_of_the_whole_text(text):
    memory = t.Memory(*t.tokenizers("/opt/tokenizers", t.A_FILE, t.B_FILE))
    (a, b), (x, y, _, _) = t.tokens([text], memory)[0], whole_tokens(text)
    assert (a.tolist(), b.tolist()) == (x, y)


def test_stretches_put_together_are_the_text(monkeypatch):
    text = "ab  cd\n ef " * 40 + "x" * 30
    memory = t.Memory(*t.tokenizers("/opt/tokenizers", t.A_FILE, t.B_FILE))
    whole = t.tokens([text, "▁", text], memory)
    monkeypatch.setattr(t, "PIECE", 16)
    cut = t.tokens([text, "▁", text], memory)
    assert " ".join(t.stretches(text)) == text and all((p == q).all() for x, y in zip(whole, cut, strict=True) for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("lane", [1, 7, 512])
def test_lockstep_merge_of_many_lists(monkeypatch, lane):
    monkeypatch.setattr(t, "LANE", lane)
    rng = np.random.default_rng(lane)
    sides, at = ([], []), 0
    for _ in range(60):
        size = int(rng.integers(0, 400))
        for side in sides:
            ends = np.sort(rng.choice(np.arange(1, size + 1), int(rng.integers(1, size + 1)), replace=False)) if size else np.zeros(0, np.int64)
            side.append(np.unique(np.append(ends, size))[-len(ends) - 1 :] + at if size else ends)
        at += size
    (a, first_a), (b, first_b) = (t.joined(side) for side in sides)
    done = t.merged(a, b, first_a, first_b)
    for i in range(60):
        x, y, want = sides[0][i].tolist(), sides[1][i].tolist(), []
        p = q = 0
        while p < len(x):
            want.append((x[p] <= y[q]) + 2 * (y[q] <= x[p]))
            p, q = p + (want[-1] & 1), q + (want[-1] >> 1)
        assert done.moves[done.first[i] : done.first[i + 1]].tolist() == want


def test_vocabularies_out_of_order_are_refused(tmp_path):
    (tmp_path / "x.json").write_text('{"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}}')
    with pytest.raises(ValueError, match="order"):
        t.ByteLevel(str(tmp_path / "x.json"))
