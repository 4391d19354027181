"""Line deduplication by an exact set-similarity join, with DataFrame operations only.

A line is the set of its lower-cased words. Sets are ordered by rarity and joined on the words of their prefixes; pairs that fail
the length or the positional filter do not leave the join; the rest are verified by Jaccard similarity on whole sets of words. A line goes
if an earlier line, kept or not, has that similarity with it; lines are ordered by doc_id, then place.

* Equal lines collapse to one class with its first occurrence before a word is split; equal sets in different lines are similar.
* A 128-bit parity signature travels with each posting: every word flips one bit, so two sets differ in as many words at least as their
  signatures differ in bits. Pairs that differ in more than the threshold allows do not leave the join.
* Rarity comes from counts in a fixed number of hash buckets over all words; any fixed order gives the same result, a
  better one only smaller postings.
* Hot groups of near-equal lines: each class is first compared with a few centers of the postings of some of its prefix words (those with the smallest hashes, so that similar lines choose alike), namely the earliest
  class in each of ``centers`` hash parts of a posting. A line that resembles an earlier center is settled and takes no further part as
  the later line. That is linear work; the full join is left with lines that resemble few others of their group.
* Word sets are not kept in the shuffles: only classes in candidate pairs have their lines read again, picked by a bitmap of fixed
  size, and their words compared.
* Arrays of words and lines are exploded by the outer generators. Split arrays are never empty, so the rows are the same; for the inner
  ones Spark adds a filter on the array's size and splits every text a second time to evaluate it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import text_of
from evalloom.plans.staging import staged

BUCKETS = 1 << 17
BITS = 1 << 23
#: White space besides space and line feed; it separates words too.
BLANKS = "\t\x0b\f\r"


def plain_blanks(text: Column) -> Column:
    """The text with every blank but the line feed as a space. Most texts have no other and are passed on as they are."""
    return F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in BLANKS)), F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def rarity(docs: DataFrame) -> Column:
    """A literal array: a rarity class (0 rarest, 127 at most) for each of BUCKETS hash buckets of words, from counts over all of them."""
    words = docs.select(F.explode_outer(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("id"))
    counts = words.groupBy("id").agg(F.least(F.lit(127), F.floor(3 * F.log2(F.count("*") + 1))).cast("int").alias("class"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("id")).join(counts, "id", "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("class", F.lit(0)).alias("class"))))
    texts = every.groupBy(F.floor(F.col("id") / 4096).alias("part")).agg(F.array_join(F.transform(listed, lambda s: s["class"].cast("string")), ",").alias("classes"))
    table = ",".join(r["classes"] for r in sorted(texts.collect(), key=lambda r: r["part"]))  # BUCKETS / 4096 rows
    return F.split(F.lit(table), ",").cast("array<tinyint>")


def hashed(line: Column) -> Column:
    """Hashes of a line's different words."""
    return F.array_distinct(F.array_remove(F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def codes(hashes: Column, classes: Column) -> Column:
    """Different words as sorted integers: rarity class in the high bits, 56 bits of the hash below."""

    def code(h: Column) -> Column:
        rare = F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(rare.cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    return F.sort_array(F.transform(hashes, code))


def exploded(docs: DataFrame) -> DataFrame:
    """Every line: row, doc_id, text_hash, pos, line, h1 and h2 (which name the line's class)."""
    lines = docs.select("row", "doc_id", "text_hash", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("*", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def parity(codes: Column) -> tuple[Column, Column]:
    """Two 64-bit words; each word of the line flips the bit that its own lowest 7 bits choose, in the first one if the 7th is set.

    What to flip is looked up in constant arrays, which takes fewer steps a word than shifts.
    """
    none, bits = F.lit(0).cast("long"), [F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)]

    def flipped(table: list[Column]) -> Column:
        return F.aggregate(codes, none, lambda a, c: a.bitwiseXOR(F.get(F.array(*table), c.bitwiseAND(F.lit(127)).cast("int"))))

    return flipped([none] * 64 + bits), flipped(bits + [none] * 64)


def class_table(docs: DataFrame, percent: int, classes: Column) -> DataFrame:
    """Every different line with words: c, h1, h2, line, o, pos and text_hash (its first occurrence), n (size), even, odd (parity), prefix (words to
    join on). Staged.

    A set of n words can resemble a different one only if n / (n + 1) reaches the threshold. Smaller sets resemble only equal ones, by all of their words,
    and their prefix is the first.
    """
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), "pos", "text_hash")).alias("first")
    lines = exploded(docs).where(F.trim("line") != "").groupBy("h1", "h2").agg(first, F.first("line").alias("line"))
    table = lines.select("h1", "h2", "first.*", "line", hashed(F.col("line")).alias("hashes"))
    table = table.select("h1", "h2", "o", "pos", "text_hash", "line", F.size("hashes").alias("n"), codes(F.col("hashes"), classes).alias("codes"))
    n = F.col("n")
    prefix = F.transform(F.slice("codes", F.lit(1), n - F.ceil(n * percent / F.lit(100.0) - 1e-9).cast("int") + 1), lambda c: c.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    even, odd = parity(F.col("codes"))
    table = table.select("h1", "h2", "o", "pos", "text_hash", "line", "n", even.alias("even"), odd.alias("odd"), prefix.alias("prefix"))
    return staged(table.withColumn("c", F.monotonically_increasing_id()), "line-classes")


def marked(rows: DataFrame, slot: Column) -> DataFrame:
    """b, map: a bitmap of BITS bits (1 MB) of the ``slot`` of all rows, in parts; small enough to broadcast."""
    return rows.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("map"))


def in_bitmap(rows: DataFrame, slot: Column, maps: DataFrame) -> DataFrame:
    """The rows whose slot is marked."""
    found = rows.withColumn("s", slot).withColumn("b", F.bitmap_bucket_number("s")).join(F.broadcast(maps), "b")
    at = F.bitmap_bit_position("s").cast("int")
    byte = F.conv(F.hex(F.substring("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select(*rows.columns)


def picked(needed: DataFrame, classes: DataFrame) -> DataFrame:
    """c, at (its place in the order), n and line of the classes in ``needed`` (c), and of few others that pass the broadcast bitmap by chance."""
    slot = F.pmod(F.xxhash64("c"), F.lit(BITS))
    found = in_bitmap(classes.select("c", "o", "pos", "text_hash", "n", "line"), slot, marked(needed, slot))
    return found.select("c", F.struct("o", "pos", "text_hash", "c").alias("at"), "n", "line")


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """c of the later class of every one of the different pairs (c, d) whose sets have the similarity. Staged, distinct."""
    pairs = staged(pairs, "line-pairs")
    own = staged(picked(pairs.select("c").unionByName(pairs.select(F.col("d").alias("c"))), classes), "line-sets")
    joined = pairs.join(own, "c").join(own.select(*[F.col(x).alias(y) for x, y in zip(own.columns, ("d", "at_d", "n_d", "line_d"), strict=True)]), "d")
    words, other = (F.split(F.lower(x), " ") for x in ("line", "line_d"))
    same = F.size(F.array_remove(F.array_intersect(words, other), ""))
    alike = joined.select("at", "at_d", (same * (100 + percent) >= percent * (F.col("n") + F.col("n_d"))).alias("alike")).where("alike")
    return staged(alike.select(F.greatest("at", "at_d")["c"].alias("c")).distinct(), "similar")


def line_decisions(docs: DataFrame, percent: int = 80, star_words: int = 3, centers: int = 8, tried: int = 3, passes: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every line of every row: row, doc_id, text_hash, pos, removed.

    ``percent`` is the least Jaccard similarity, from 1 to 100. Postings are joined in ``passes`` parts, by hash of the word, so that the disk holds the shuffle of one
    part at a time. A null text is one blank line; blank lines (no words) are never removed. A null doc_id
    comes before all others. Rows that repeat an id and its text are one document here: they get equal decisions, and one does not
    remove the other's lines.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), plain_blanks(text).alias("text"), F.xxhash64(text).alias("text_hash")).withColumn("row", F.monotonically_increasing_id())
    ranks = rarity(rows)
    classes = class_table(rows, percent, ranks)
    sizes, ordered = ("c", "n", "even", "odd"), ("o", "pos", "c", "n", "even", "odd")

    def postings(frame: DataFrame, words: Column, held: tuple[str, ...], suffix: str = "") -> DataFrame:
        return frame.select(*[F.col(x).alias(x + suffix) for x in held], F.posexplode(words).alias(f"i{suffix}", f"word{suffix}"))

    n, n_d = F.col("n"), F.col("n_d")
    least = F.ceil((n + n_d) * percent / F.lit(100.0 + percent) - 1e-9)  # words that sets of these sizes must share
    apart = F.bit_count(F.col("even").bitwiseXOR(F.col("even_d"))) + F.bit_count(F.col("odd").bitwiseXOR(F.col("odd_d")))
    earlier = F.struct("o_d", "pos_d", "c_d") < F.struct("o", "pos", "c")
    fits = (F.least(n, n_d) * 100 >= percent * F.greatest(n, n_d)) & (apart <= n + n_d - 2 * least)

    star = postings(classes, F.slice(F.sort_array("prefix"), 1, star_words), ordered)
    part = F.pmod(F.xxhash64("c"), F.lit(centers)).alias("part")
    center = star.groupBy("word", part).agg(F.min(F.struct(*ordered)).alias("y")).select(F.col("word").alias("word_d"), *[F.col(f"y.{x}").alias(f"{x}_d") for x in ordered])
    met_centers = F.collect_set(F.struct(apart.alias("apart"), F.col("c_d").alias("d")))  # star_words x centers at most
    nearest = star.join(center, (F.col("word") == F.col("word_d")) & fits & earlier).groupBy("c").agg(F.slice(F.sort_array(met_centers), 1, tried).alias("y"))
    near = verified(nearest.select("c", F.explode("y.d").alias("d")), classes, percent)

    unsettled = staged(classes.select(*sizes, "prefix").join(near, "c", "left_anti"), "unsettled-lines")
    room = F.least(n - F.col("i"), n_d - F.col("i_d")) >= least  # of the shared words the first is the one they meet in
    ends = F.least("c", "c_d").alias("c"), F.greatest("c", "c_d").alias("d")  # two unsettled lines meet twice
    met = []
    for k in range(passes):
        of_part = lambda frame, word: frame.where(F.pmod(word, F.lit(passes)) == k)  # noqa: B023, E731
        x, y = of_part(postings(unsettled, F.col("prefix"), sizes), F.col("word")), of_part(postings(classes, F.col("prefix"), sizes, "_d"), F.col("word_d"))
        meeting = (F.col("word") == F.col("word_d")) & (F.col("c") != F.col("c_d")) & fits & room
        met.append(staged(x.join(y, meeting).select(*ends).distinct(), "line-meetings"))
    similar = near.unionByName(verified(reduce(DataFrame.unionByName, met).distinct(), classes, percent)).distinct().withColumn("similar", F.lit(True))

    judged = classes.join(similar, "c", "left").select("h1", "h2", F.col("o").alias("o_1"), F.col("pos").alias("pos_1"), F.col("text_hash").alias("hash_1"), F.col("similar").isNotNull().alias("similar"))
    own = (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("o_1")) & (F.col("pos") == F.col("pos_1")) & (F.col("text_hash") == F.col("hash_1"))
    joined = exploded(rows).drop("line").join(staged(judged, "judged-lines"), ["h1", "h2"], "left")
    return joined.select("row", "doc_id", "text_hash", "pos", F.coalesce(F.col("similar") | ~own, F.lit(False)).alias("removed"))


def line_dedup(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_kept, n_removed, removed_lines (places from 0, joined by commas).

    See ``line_decisions`` for nulls, ties and repeated rows. An empty table gives an empty result; other columns are not read.
    """
    marked = line_decisions(docs, percent, id_column=id_column, text_column=text_column)
    gone = F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("pos"))))
    return (
        marked.groupBy("row", "doc_id")
        .agg(F.count("*").alias("n_lines"), F.count(F.when(F.col("removed"), 1)).alias("n_removed"), F.array_join(F.transform(gone, lambda p: p.cast("string")), ",").alias("removed_lines"))
        .select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_removed")).alias("n_kept"), "n_removed", "removed_lines")
    )


def drop_similar_lines(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with removed lines cut out of the text (a document without lines left has an empty text).

    A null text stays null. Columns may have any names. Ties and repeated rows: see ``line_decisions``; an empty table stays empty.
    """
    marked = line_decisions(docs, percent, id_column=id_column, text_column=text_column).where("removed")
    gone = marked.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    keyed = docs.select(F.struct("*").alias("held"), F.col(id_column).cast("long").alias("own_id"), F.xxhash64(text_of(text_column)).alias("own_hash"))
    spots = F.map_from_arrays(F.col("gone"), F.transform("gone", lambda p: F.lit(True)))
    body = F.col("held").getField(text_column)
    left = F.array_join(F.filter(F.split(body, "\n"), lambda line, i: F.element_at(spots, i).isNull()), "\n")
    joined = keyed.join(gone, (F.col("own_hash") == F.col("text_hash")) & F.col("own_id").eqNullSafe(F.col("doc_id")), "left")
    return joined.select(F.when(F.col("gone").isNull(), F.col("held")).otherwise(F.col("held").withField(text_column, left)).alias("held")).select("held.*")
