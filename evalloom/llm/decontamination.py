"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents become sequences of words in which numbers, names and units are replaced with typed placeholders
(neighbours of one type in a sentence are one placeholder), so a question asked with other values has the same template. Every window of ``window``
template words of an item is hash-joined with the windows of all documents. For each (document, item) the hits are then checked
for consistency: they must lie at about the same distance from the item's places (within ``drift`` words), and there a value of the item
must always stand for the same value of the document. Where sentences of an item are alike, a window also meets the others' places in the document; then each
place of the item is given one place of the document on the longest line-up in order, first among hits with the item's own values, and then among
all, and the values are checked on that line-up alone. An item is found in a document when enough of its windows are hit so.

Capitals do not tell names for certain, so texts are read in three ways: capitalised words are names except at the beginning of a
sentence; there too; nowhere (which finds items retyped in other case). A window needs ``min_words`` words that are not placeholders, so
that "name number unit" says nothing by itself. An item without usable windows, or shorter than a window, is looked for literally: its
windows, or the one window as long as the item, hold the words and values themselves.

Texts are cut into words with numpy, over many texts at once: code points are classified by a table, and words are hashed by their code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import text_of
from evalloom.plans.staging import staged

# Words that name a unit or a currency.
UNITS = frozenset(
    "mm cm m km g kg mg t l ml s ms min h hr hrs inch inches foot feet yard yards mile miles meter meters metre metres liter liters litre litres gram grams kilogram kilograms pound pounds ounce ounces "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees kmh mph".split()
)
# Number words.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
# Signs of currencies and units.
BEFORE, AFTER = "$€£", "%°"
PLAIN, NUMBER, NAME, UNIT = range(4)
#: Readings of a text: names inside sentences, names at their beginnings too, no names, no placeholders at all.
INSIDE, EVERYWHERE, NOWHERE, LITERAL = range(1, 5)
#: Code points worked on at once; a longer text is cut into pieces that share whole windows.
PIECE = 1 << 18
#: Literal items of fewer words are looked for as whole texts only.
LEAST_LITERAL = 4
_LETTER, _DIGIT, _APOSTROPHE, _JOINER, _END, _SIGN, _UPPER = 1, 2, 4, 8, 16, 32, 64
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower-case form of every code point."""
    kinds = np.array([unicodedata.category(chr(i)) for i in range(0x110000)], "U2")
    letter = np.isin(kinds.view("U1")[::2], ["L", "M"])
    bits = letter * np.uint8(_LETTER) | (kinds == "Lu") * np.uint8(_UPPER) | (kinds == "Nd") * np.uint8(_DIGIT)
    low = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(np.isin(kinds, ["Lu", "Lt"])).tolist():
        if len(c := chr(i).lower()) == 1:
            low[i] = ord(c)
    for signs, bit in (("'’", _APOSTROPHE), (".,:/", _JOINER), (".!?", _END), (BEFORE + AFTER, _SIGN)):
        for c in signs:
            bits[ord(c)] |= bit
    low[ord("’")] = ord("'")
    return bits, low


@cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(n - 1, 0xD6E8FEB86659FD93, np.uint64)]).astype(np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def _summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each run of ``values`` (which begin at ``starts`` and fill the array), its order included."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(values)))
    inside = np.arange(len(values)) - np.repeat(starts, lengths)
    return _mixed(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * _powers(1 << int(lengths.max()).bit_length())[inside], starts))


@dataclass
class Words:
    """The words of several texts, one after the other."""

    text: np.ndarray  #: which text a word is of
    place: np.ndarray  #: its number in the text
    start: np.ndarray  #: where it begins in the joined texts
    low: np.ndarray  #: hash of its lower-cased form
    kind: np.ndarray  #: PLAIN, NUMBER or UNIT
    upper: np.ndarray  #: begins with a capital
    fresh: np.ndarray  #: begins a sentence


def _hash_of(words: str | frozenset[str]) -> np.ndarray:
    """Sorted hashes of words as ``read`` makes them."""
    parts = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    return np.sort(np.concatenate([_summed(p, np.zeros(1, np.int64)) for p in parts]))


@cache
def _known() -> tuple[np.ndarray, ...]:
    return tuple(map(_hash_of, (NUMBER_WORDS, UNITS, BEFORE, AFTER)))


def _among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)


def read(texts: list[str]) -> Words:
    """Words are runs of letters and marks (apostrophes inside), runs of digits (points, commas, colons, slashes inside), and signs."""
    bits, lower = _tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = bits[points]
    letter, digit = (cls & _LETTER) > 0, (cls & _DIGIT) > 0

    def between(mark: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Marks with ``of`` on both sides."""
        out = np.zeros(len(mark), bool)
        out[1:-1] = mark[1:-1] & of[:-2] & of[2:]
        return out

    word, number = letter | between((cls & _APOSTROPHE) > 0, letter), digit | between((cls & _JOINER) > 0, digit)
    end, sign = ((cls & _END) > 0) & ~number, (cls & _SIGN) > 0
    new = lambda run: run & np.concatenate([[True], ~run[:-1]])
    start = np.flatnonzero(new(word) | new(number) | end | sign) if len(points) else np.zeros(0, np.int64)
    ends = end[start]
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    text = np.searchsorted(first, start, "right") - 1
    fresh = np.concatenate([[True], ends[:-1] | (text[1:] != text[:-1])]) if len(start) else np.zeros(0, bool)
    start, text, fresh = start[~ends], text[~ends], fresh[~ends]
    held = word | number | sign
    owner = np.cumsum(np.bincount(start, minlength=len(points)))[held] if len(start) else np.zeros(0, np.int64)
    low = _summed(lower[points[held]], np.flatnonzero(np.diff(owner, prepend=0))) if len(start) else np.zeros(0, np.uint64)
    numbers, units, before, after = _known()
    is_number = digit[start] | _among(low, numbers)
    same = np.concatenate([text[1:] == text[:-1], [False]]) if len(text) else np.zeros(0, bool)  # the next word is of the same text
    after_number = np.concatenate([[False], (is_number & same)[:-1]]) if len(text) else same
    before_number = np.concatenate([(is_number[1:] & same[:-1]), [False]]) if len(text) else same
    unit = ~is_number & ((after_number & (_among(low, units) | _among(low, after))) | (before_number & _among(low, before)))
    begins = np.searchsorted(text, np.arange(len(texts)))
    return Words(text, np.arange(len(text)) - begins[text], start, low, np.where(is_number, NUMBER, np.where(unit, UNIT, PLAIN)), (cls[start] & _UPPER) > 0, fresh)


@dataclass
class Windows:
    text: np.ndarray
    place: np.ndarray  #: of the first word
    hash: np.ndarray
    check: np.ndarray  #: a second hash
    usable: np.ndarray  #: has words enough that are not placeholders
    first: np.ndarray  #: number of its first template word
    size: int
    begins: np.ndarray  #: words at which all template words begin
    kinds: np.ndarray  #: of all template words
    values: np.ndarray  #: of all template words


def windows(words: Words, reading: int, size: int, min_words: int) -> Windows:
    """All windows of ``size`` template words of a reading, none across two texts."""
    kind = words.kind
    if reading == LITERAL:
        kind = np.zeros_like(kind)
    elif reading != NOWHERE:
        kind = np.where((kind == PLAIN) & words.upper & (~words.fresh | (reading == EVERYWHERE)), NAME, kind)
    begin = np.ones(len(kind), bool)
    begin[1:] = (kind[1:] == PLAIN) | (kind[1:] != kind[:-1]) | words.fresh[1:]
    at = np.flatnonzero(begin)
    kinds, text, place = kind[at], words.text[at], words.place[at]
    values = _summed(words.low, at)
    shown = np.where(kinds == PLAIN, words.low[at], _mixed(kinds.astype(np.uint64) + _OTHER))
    n = max(0, len(at) - size + 1)
    whole = text[:n] == text[size - 1 :] if n else np.zeros(0, bool)
    h, check, plain = np.full(n, size, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(size):
        part = shown[k : k + n]
        h = _mixed(h ^ part)
        check = (check + part) * _OTHER
        plain += kinds[k : k + n] == PLAIN
    first = np.flatnonzero(whole)
    return Windows(text[first], place[first], h[first].view(np.int64), check[first].view(np.int64), plain[first] >= min_words, first, size, at, kinds, values.view(np.int64))


def _rows(w: Windows, chosen: np.ndarray) -> Iterator[tuple[int, int, int, int, list[int], list[int]]]:
    """text, place, hash, check, kinds and values of the chosen windows."""
    slots = w.first[chosen][:, None] + np.arange(w.size)
    return zip(w.text[chosen].tolist(), w.place[chosen].tolist(), w.hash[chosen].tolist(), w.check[chosen].tolist(), w.kinds[slots].tolist(), w.values[slots].tolist(), strict=True)


def item_windows(items: DataFrame, window: int, min_words: int, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item, reading, size, place, hash, check, kinds, ours (values), windows (of the item in that reading), whole. Staged.

    ``whole`` marks items of fewer than LEAST_LITERAL words, which only equal a whole text. Items without words have no windows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, found = read([text]), False
                for reading in (INSIDE, EVERYWHERE, NOWHERE):
                    w = windows(words, reading, window, min_words)
                    chosen = np.flatnonzero(w.usable)
                    found |= reading == INSIDE and len(chosen) > 0
                    rows += [(item, reading, window, p, h, c, k, v, len(chosen), False) for _, p, h, c, k, v in _rows(w, chosen)]
                if not found and len(words.low):
                    size = min(window, len(words.low))
                    w = windows(words, LITERAL, size, 0)
                    rows += [(item, LITERAL, size, p, h, c, k, v, len(w.text), size < LEAST_LITERAL) for _, p, h, c, k, v in _rows(w, np.arange(len(w.text)))]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "reading", "size", "place", "hash", "check", "kinds", "ours", "windows", "whole"])

    rows = items.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("item"), text_of(text_column).alias("text"))
    schema = "item long, reading long, size long, place long, hash long, check long, kinds array<long>, ours array<long>, windows long, whole boolean"
    return staged(rows.mapInArrow(cut, schema), "item-windows")


@dataclass
class _Filter:
    """Sorted hashes, and a table of bits that tells most others apart at once."""

    keys: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> _Filter:
        bits = np.zeros(1 << max(16, int(len(keys) * 64).bit_length()), bool)
        bits[keys & (len(bits) - 1)] = True
        return cls(np.sort(keys), bits)

    def places(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[h & (len(self.bits) - 1)])
        return maybe[_among(h[maybe], self.keys)]


def document_windows(texts: list[str], shapes: list[tuple[int, int]], min_words: int, wanted: _Filter | None) -> Iterator[tuple[int, int, int, int, int, list[int], int]]:
    """text, place, hash, check, reading, values, words (of the text) of all windows that may be wanted."""

    def cut(words: Words) -> list[Windows]:
        return [windows(words, reading, size, 0 if reading == LITERAL else min_words) for reading, size in shapes]

    def chosen_rows(w: Windows, reading: int, base: int, owner: int | None, total: np.ndarray, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int, int, int, int, list[int], int]]:
        chosen = np.flatnonzero(w.usable) if wanted is None else wanted.places(w.hash)
        chosen = chosen[w.usable[chosen] & (w.place[chosen] >= low) & (w.place[chosen] < (len(w.values) + w.place[-1] + 1 if high is None and len(w.place) else high or 0))]
        for i, p, h, c, _, v in _rows(w, chosen):
            yield (i if owner is None else owner), p + base, h, c, reading, v, int(total[i])

    def of_long(text: str, owner: int) -> Iterator[tuple[int, int, int, int, int, list[int], int]]:
        """Pieces follow each other at a word ``back``. In each reading, the template word that holds it is the last to begin windows of the piece before, which
        holds these windows whole and two template words more; the next template word is the first of the piece that follows."""
        base, a, low = 0, 0, [0] * len(shapes)
        more = max((size for _, size in shapes), default=0) + 2
        while a < len(text):
            span, back = PIECE, 0
            while True:
                b = min(len(text), a + span)
                if b < len(text):  # between two words, if there is a gap
                    b = max(text.rfind(" ", a + span // 2, b), text.rfind("\n", a + span // 2, b)) + 1 or b
                words = read([text[a:b]])
                parts = cut(words)
                if b == len(text):
                    break
                back = min((int(w.begins[-more]) if len(w.begins) > more else 0 for w in parts), default=max(0, len(words.start) - 1))
                if back > max(low, default=0):
                    break
                span *= 2  # too few template words, as in long runs of values
            total = np.array([len(words.low) + (PIECE if base or b < len(text) else 0)])
            last = [None if b == len(text) else int(np.searchsorted(w.begins, back, "right")) - 1 for w in parts]
            for (reading, _), w, least, k in zip(shapes, parts, low, last, strict=True):
                yield from chosen_rows(w, reading, base, owner, total, least, None if k is None else int(w.begins[k]) + 1)
            if b == len(text):
                return
            low = [int(w.begins[k + 1]) - back for w, k in zip(parts, last, strict=True)]
            base, a = base + back, a + int(words.start[back])

    held: list[str] = []
    first, size = 0, 0
    for i, text in enumerate([*texts, None]):
        if held and (text is None or size + len(text) > PIECE):
            words = read(held)
            total = np.bincount(words.text, minlength=len(held))
            for (reading, _), w in zip(shapes, cut(words), strict=True):
                for x in chosen_rows(w, reading, 0, None, total):
                    yield (x[0] + first, *x[1:])
            held, size = [], 0
        if text is None:
            return
        if len(text) > PIECE:
            yield from of_long(text, i)
            continue
        first = first if held else i
        held.append(text)
        size += len(text) + 1


def line_up(hits: set[tuple[int, int]], drift: int) -> list[tuple[int, int]]:
    """The longest line-up of hits (place in the item, distance of the document's place): each has one document place, places ascend on both sides.

    Of equally long ones, that whose distances change least. Distances lie within twice the ``drift``, so the work is linear in the item's places.
    """
    if not hits:
        return []
    least = min(d for _, d in hits)
    width, size = max(d for _, d in hits) - least + 1, max(p for p, _ in hits) + 1
    cost = 1.0 / (8 * size * max(drift, 1))  # all changes together cost less than one hit
    top, who = np.zeros((width, size + 1)), np.full((width, size + 1), -1)  # best among the places before
    lines, order = np.arange(width), sorted(hits)
    before, value, at = [-1] * len(order), [0.0] * len(order), 0
    for p in range(size):
        top[:, p + 1], who[:, p + 1] = top[:, p], who[:, p]
        while at < len(order) and order[at][0] == p:
            d = order[at][1] - least
            upto = np.maximum(p - np.maximum(lines - d, 0), 0)
            reach = np.where(who[lines, upto] >= 0, top[lines, upto] - cost * np.abs(lines - d), 0.0)
            best = int(reach.argmax())
            if reach[best] > 0:
                before[at] = int(who[best, upto[best]])
            value[at] = 1 + max(0.0, float(reach[best]))
            if value[at] > top[d, p + 1]:
                top[d, p + 1], who[d, p + 1] = value[at], at
            at += 1
    i, out = int(np.argmax(value)), []
    while i >= 0:
        out.append(order[i])
        i = before[i]
    return out[::-1]


def lined_up(hits: list[dict], needed: int, drift: int) -> int:
    """Hits of the line-up by which an item is found, or 0: at least ``needed`` on one with the item's own values, or on one where no value stands for two."""
    slots: dict[tuple[int, int], list[list[dict]]] = {}
    for h in hits:
        slots.setdefault((h["place"], h["apart"]), []).append(h["slots"])
    own = {k for k, found in slots.items() if any(all(s["ours"] == s["theirs"] for s in x) for x in found)}
    same = len(line_up(own, drift))
    if same >= needed:
        return same
    line = line_up(set(slots), drift)
    pairs = {(s["kinds"], s["ours"], s["theirs"]) for k in line for x in slots[k] for s in x}
    return len(line) if len(line) >= needed and len({(k, o) for k, o, _ in pairs}) == len(pairs) else 0


def find_items(
    docs: DataFrame, items: DataFrame, window: int = 8, min_words: int = 5, coverage: float = 0.5, drift: int = 8, max_filter: int = 4_000_000, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, text_hash, size) and pairs row, item, hits (item windows that line up), windows.

    ``row`` numbers the input rows. A pair counts when ``coverage`` of the item's windows, in one reading or in all together, are hit on a consistent
    line-up: the distance of the places in document and item varies by ``drift`` words at most. If the
    items have at most ``max_filter`` different hashes these are broadcast, and a document's other windows are left out
    before the join; with more, all windows are joined. Items without any word are never found.
    """
    spark = docs.sparkSession
    cut_items = item_windows(items, window, min_words)
    hashes = cut_items.select("hash").distinct()
    shapes = sorted((r.reading, r.size) for r in cut_items.select("reading", "size").distinct().collect())  # three, and one for each literal size
    few = hashes.limit(max_filter + 1).count() <= max_filter
    wanted = spark.sparkContext.broadcast(_Filter.of(hashes.toPandas()["hash"].to_numpy(np.int64)) if few else None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ids, keys, sizes = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text_hash", "size"))
            rows = [(*document, None, None, None, None, None, None) for document in zip(numbers, ids, keys, sizes, strict=True)]  # the documents themselves
            rows += [(numbers[i], None, None, words, p, h, c, reading, v, True) for i, p, h, c, reading, v, words in document_windows(batch.column("text").to_pylist(), shapes, min_words, wanted.value)]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "text_hash", "size", "at", "hash", "check", "reading", "theirs", "window"])

    text = text_of(text_column)
    numbered = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).withColumns({"text_hash": F.xxhash64("text"), "size": F.octet_length("text").cast("long"), "row": F.monotonically_increasing_id()})
    schema = "row long, doc_id long, text_hash long, size long, at long, hash long, check long, reading long, theirs array<long>, window boolean"
    cut_docs = staged(numbered.mapInArrow(cut, schema), "doc-windows")
    documents = cut_docs.where("window IS NULL").select("row", "doc_id", "text_hash", "size")
    held = cut_docs.where("window").select("row", F.col("size").alias("words"), "at", "hash", "check", "reading", "theirs")
    hits = held.join(cut_items, ["hash", "check", "reading"]).where("NOT whole OR words = size")
    most = cut_items.groupBy("item").agg(F.max("windows").alias("most"))
    line = F.floor((F.col("at") - F.col("place")) / drift)  # a line-up lies in one band of twice the drift at least
    hits = hits.join(F.broadcast(most), "item") if few else hits.join(most, "item")
    judged = F.array(F.struct("reading", "windows"), F.struct(F.lit(0).cast("long").alias("reading"), F.col("most").alias("windows")))
    slots = F.filter(F.arrays_zip("kinds", "ours", "theirs"), lambda s: s["kinds"] > 0)
    lines = hits.select("row", "item", "place", (F.col("at") - F.col("place")).alias("apart"), slots.alias("slots"), F.explode(F.array(line, line + 1)).alias("band"), judged.alias("judged"))
    lines = lines.select("row", "item", "place", "apart", "slots", "band", F.explode("judged").alias("j")).select("row", "item", "place", "apart", "slots", "band", "j.*")
    key = ["row", "item", "band", "reading"]
    found = lines.groupBy(*key, "windows").agg(F.countDistinct("place").alias("hits")).where(F.col("hits") >= F.ceil(F.col("windows") * F.lit(coverage)))
    clash = (  # a value of the item that stands for two values of the document on one line-up
        lines.join(found.select(*key), key, "left_semi")
        .select(*key, F.explode("slots").alias("s"))
        .groupBy(*key, "s.kinds", "s.ours")
        .agg(F.min("s.theirs").alias("least"), F.max("s.theirs").alias("most"))
        .where("least <> most")
        .select(*key)
        .distinct()
    )
    # Where a value clashes, a line-up is looked for: a band has at most twice the drift document places for each item place and reading, so a group is bounded by its item.
    open_ = lines.join(clash, key, "left_semi").groupBy(*key, "windows").agg(F.collect_list(F.struct("place", "apart", "slots")).alias("held"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("windows").to_pylist()
            least = [-(-n * coverage // 1) for n in sizes]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item"), pa.array([lined_up(h, n, drift) for h, n in zip(batch.column("held").to_pylist(), least, strict=True)], pa.int64()), batch.column("windows")], ["row", "item", "hits", "windows"])

    settled = open_.select("row", "item", "windows", "held").mapInArrow(settle, "row long, item long, hits long, windows long").where("hits > 0")
    plain = found.join(clash, key, "left_anti").select("row", "item", "hits", "windows")
    return documents, plain.unionByName(settled).groupBy("row", "item").agg(F.max("hits").alias("hits"), F.max("windows").alias("windows"))


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: float) -> DataFrame:
    """One row per input row: doc_id, contaminated, kept, n_items, item_ids (ascending).

    Rows are judged by their own text, so repeated rows and repeated identifiers each get their own result. Null and empty texts
    are clean. An empty table gives an empty result; other columns are not read.
    """
    documents, pairs = find_items(docs, items, id_column=id_column, text_column=text_column, **options)
    found = pairs.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))  # at most the number of items
    return documents.join(found, "row", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.col("item_ids").isNull().alias("kept"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: float) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found.

    Null and empty texts are clean and stay; equal texts stay or go together, repeated rows as often as they occur. An empty table stays empty.
    Columns may have any names.
    """
    documents, pairs = find_items(docs, items, id_column=id_column, text_column=text_column, **options)
    found = documents.join(pairs.select("row").distinct(), "row", "left_semi").select("text_hash", "size").distinct()
    text = text_of(text_column)
    keyed = docs.select(F.struct("*").alias("held"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).cast("long").alias("size"))
    return keyed.join(found, ["text_hash", "size"], "left_anti").select("held.*")
