"""Corpus-scale jobs around evaluation: contamination, long-context test sets, breakdowns, redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.metrics import perplexities
from evalloom.plans.ranking import prefix_sums
from evalloom.plans.staging import staged


#: A word: letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def run_hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words. Runs of twice the length are made of two runs, so a run costs as many hashes as n has binary digits (and ones among them), not n."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  what is used twice is worked out once

    def grow(made: dict[int, Column]) -> Column:
        def beside(a: Column, at: int, b: Column, size: int) -> Column:
            left = F.greatest(F.size(made[1]) - (size - 1), F.lit(0))
            return F.zip_with(F.slice(a, F.lit(1), left), F.slice(b, F.lit(at + 1), left), lambda x, y: F.xxhash64(x, y))

        size = max(made)
        if 2 * size <= n:
            return once(beside(made[size], size, made[size], 2 * size), lambda twice: grow(made | {2 * size: twice}))
        out = made[size]
        for k in sorted(made, reverse=True)[1:]:
            if size + k <= n:
                out, size = beside(out, size, made[k], size + k), size + k
        return out

    return once(F.transform(words, lambda w: F.xxhash64(F.lower(w))), lambda single: grow({1: single}))


def gram_rows(rows: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """id, text_hash, pos, h: every run of ``n`` words, in lower case. Shorter texts have none; words and text are not carried along."""
    text = F.col(text_column)
    words = rows.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") >= n)
    return words.select("id", "text_hash", F.posexplode(run_hashes(F.col("w"), n)).alias("pos", "h"))


def worded(grams: DataFrame, rows: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """``grams`` (id, text_hash, pos, h) with ``gram``, the words themselves; each text that has any is read and cut into words once."""
    places = grams.groupBy("id", "text_hash").agg(F.collect_set(F.struct("pos", "h")).alias("places"))  # no more than the text has words
    texts = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("t")).withColumn("text_hash", F.xxhash64("t")).join(places.select("id", "text_hash"), ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])
    words = F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), F.lower)
    held = texts.join(places, ["id", "text_hash"]).select("id", words.alias("w"), "places")
    told = F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), p["h"].alias("h"), F.array_join(F.slice("w", p["pos"] + 1, F.lit(n)), " ").alias("gram")))
    return held.select("id", F.explode(told).alias("g")).select("id", "g.*")


def contamination_hits(
    corpus: DataFrame, items: DataFrame, n: int = 13, max_broadcast: int = 2_000_000, doc_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text", places: int = 4096, sharers: int = 32
) -> DataFrame:
    """doc_id, item_id, pos: places in documents of word n-grams that items have too.

    The items' different n-grams are counted first; up to ``max_broadcast`` of them go to all tasks (8 bytes each), so the corpus is filtered before any
    shuffle; with more, both sides are shuffled on the hash. Hashes find candidates, a row for each place whatever the number of items, and the
    words themselves decide. An n-gram that stands in many places (boilerplate) or in many items is joined in parts: its places are dealt over one
    salt for each ``places`` of them, its items over one for each ``sharers``, and every part meets every other, so that no task
    holds more of one n-gram and nothing is left out. Rows that repeat an identifier and its text count once.
    """
    ours = staged(worded(gram_rows(items, item_column, text_column, n), items, item_column, text_column, n).select(F.col("id").alias("item_id"), "h", "gram").distinct(), "item-grams")
    keys = ours.select("h").distinct()
    side = F.broadcast(keys) if keys.count() <= max_broadcast else keys
    found = staged(gram_rows(corpus, doc_column, text_column, n).join(side, "h"), "gram-places")
    theirs = worded(found, corpus, doc_column, text_column, n)
    parts = found.groupBy("h").agg(F.count("*").alias("held")).join(ours.groupBy("h").agg(F.count("*").alias("items")), "h")
    parts = staged(parts.select("h", F.ceil(F.col("held") / places).cast("int").alias("a"), F.ceil(F.col("items") / sharers).cast("int").alias("b")), "gram-parts")
    side = F.broadcast(parts) if parts.count() <= max_broadcast else parts
    dealt = lambda rows, own, key, other: rows.join(side, "h").withColumn(f"_{own}", F.pmod(F.xxhash64(*key), F.col(own))).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), (F.col(other) - 1).cast("long")))).drop("a", "b")
    joined = dealt(theirs, "a", ("id", "pos"), "b").join(dealt(ours, "b", ("item_id",), "a"), ["h", "gram", "_a", "_b"])
    return joined.select(F.col("id").alias("doc_id"), "item_id", "pos")


def contaminated_items(hits: DataFrame, items: DataFrame, item_column: str = "item_id") -> DataFrame:
    """item_id, contaminated, docs (how many documents share an n-gram) for every item."""
    found = hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))
    joined = items.select(F.col(item_column).alias("item_id")).join(found, "item_id", "left")
    return joined.select("item_id", F.col("docs").isNotNull().alias("contaminated"), F.coalesce("docs", F.lit(0)).alias("docs"))


def clean_subset_scores(scores: DataFrame, flags: DataFrame, keys: Sequence[str] = ("model",), item: str = "item_id") -> DataFrame:
    """keys with the mean value and the number of all, clean and contaminated items; items without a flag are clean."""
    joined = scores.join(flags.select(item, "contaminated"), item, "left").withColumn("bad", F.coalesce("contaminated", F.lit(False)))
    out = [F.avg("value").alias("value_all"), F.count("value").alias("n_all")]
    for name, test in (("clean", ~F.col("bad")), ("contaminated", F.col("bad"))):
        out += [F.avg(F.when(test, F.col("value"))).alias(f"value_{name}"), F.count(F.when(test, F.col("value"))).alias(f"n_{name}")]
    return joined.groupBy(*keys).agg(*out)


def word_spans(hits: DataFrame, n: int) -> DataFrame:
    """doc_id, first, last: runs of words that hits of ``n`` words cover; hits that overlap or touch make one run."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    places = hits.select("doc_id", F.col("pos").cast("long").alias("pos")).distinct()
    begins = places.withColumn("new", F.coalesce(F.col("pos") > F.lag("pos").over(order) + n, F.lit(True)).cast("int"))
    runs = begins.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("pos").alias("first"), (F.max("pos") + n - 1).alias("last")).drop("run")


def without_spans(text: Column, spans: Column, mark: str = "") -> Column:
    """The text without its words ``first`` to ``last`` of every span (ascending, apart) and what is between them; ``mark`` stands in their place.

    The text is cut once into words and the gaps around them, and the parts that stay are joined as they are.
    """
    gaps, words = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    pairs = F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))  # a gap and the word after it; the last gap has none
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["last"] + 1))
    ends = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(gaps).cast("long")))
    kept = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.concat(F.array_join(F.slice(pairs, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), ""), F.coalesce(F.get(gaps, p["b"].cast("int")), F.lit("")))
    )
    return F.array_join(kept, mark)


def mask_corpus(corpus: DataFrame, hits: DataFrame, mode: str = "drop", n: int = 13, doc_column: str = "doc_id", text_column: str = "text", mark: str = "") -> DataFrame:
    """The corpus without contaminated documents (``drop``), or with shared n-grams cut out of their texts (``cut``).

    Cutting takes out the words that hits cover, and what stands between two such words; all other characters stay as they are. ``mark`` is put in the place of each
    run of words that goes. Documents without hits keep their text. Identifiers must be unique. The hits are staged, since both the documents and
    the places to cut are read from them.
    """
    hits = staged(hits.select("doc_id", "pos"), "hits")
    if mode == "drop":
        return corpus.join(hits.select(F.col("doc_id").alias(doc_column)).distinct(), doc_column, "left_anti")
    spans = word_spans(hits, n).groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_spans"))  # apart, so fewer than the text's words
    whole = F.struct(*[F.col(f"`{c}`") for c in corpus.columns]).alias("_row")
    joined = corpus.select(F.col(doc_column).alias("_key"), F.col(text_column).alias("_text"), whole).join(spans, F.col("_key") == F.col("_id"), "left")
    cut = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(without_spans(F.col("_text"), F.col("_spans"), mark))
    return joined.withColumn("_text", cut).select(*[F.col("_text").alias(c) if c == text_column else F.col(f"_row.`{c}`") for c in corpus.columns])


def haystacks(docs: DataFrame, bucket: Column, length: int, id_column: str = "doc_id", text_column: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """bucket, haystack: in each bucket the texts by id, joined by spaces and cut at ``length`` characters.

    Where a text begins is a prefix sum of lengths over (bucket, id), which no task works out for a whole bucket; only documents that begin before
    ``length`` then have their texts read, cut to what is needed. So a bucket's task holds about ``length`` characters, and at most as many
    texts. Null texts are empty. Identifiers must be unique in their bucket.
    """
    rows = docs.select(bucket.alias("bucket"), F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    sizes = rows.select("bucket", "id", (F.length("text") + 1).cast("long").alias("size"))
    used = staged(prefix_sums(sizes, "size", ["id"], ["bucket"], name="before").where(F.col("before") < length).select("bucket", "id", "before"), "stack-places")
    used = used.select(F.col("bucket").alias("_b"), F.col("id").alias("_i"), "before")
    side = F.broadcast(used) if used.count() <= max_broadcast else used
    near = rows.join(side, F.col("bucket").eqNullSafe(F.col("_b")) & F.col("id").eqNullSafe(F.col("_i"))).select("bucket", "before", F.substring("text", F.lit(1), (length - F.col("before")).cast("int")).alias("text"))
    joined = near.groupBy("bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("before", "text"))), lambda s: s["text"]), " ").alias("h"))
    return joined.select("bucket", F.substring("h", 1, length).alias("haystack"))


#: Kinds of needle tasks: how many needles there are, whether they share a key, and which are asked for.
NEEDLE_VARIANTS = ("single", "multikey", "multivalue", "multiquery")


def needles(pool: DataFrame, variant: str, k: int = 4) -> DataFrame:
    """bucket, key, value, asked for ``needle_dataset``, from the first needles by key and value of each bucket's ``pool`` (bucket, key, value).

    ``single``: one needle. ``multikey``: k needles of which the first is asked for, the others distract. ``multivalue``: k values of one key, all asked for.
    ``multiquery``: k keys, all asked for. A bucket with fewer has fewer.
    """
    if variant not in NEEDLE_VARIANTS:
        raise ValueError(f"variant must be one of {', '.join(NEEDLE_VARIANTS)}")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "value"))
    first = pool.select("bucket", "key", "value", place.alias("place")).where(F.col("place") <= (1 if variant == "single" else k))
    key = F.min("key").over(Window.partitionBy("bucket")) if variant == "multivalue" else F.col("key")
    return first.select("bucket", key.alias("key"), "value", (F.col("place") == 1 if variant == "multikey" else F.lit(True)).alias("asked"))


def needle_dataset(stacks: DataFrame, needles: DataFrame) -> DataFrame:
    """bucket, prompt, question, answers: key-value needles put into long texts.

    ``needles`` has bucket, key, value and asked (see the function of that name). A bucket's k needles, ordered by key and value, stand at depths 1/(k+1) .. k/(k+1). One needle is the
    plain task; several keys of which one is asked, several values of one key, or several asked keys are its variants. The answers
    are the values of asked keys in order.
    """
    listed = needles.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("key", "value", "asked"))).alias("needles"))
    sentences = F.transform("needles", lambda s: F.concat(F.lit(" The special number for "), s["key"], F.lit(" is "), s["value"], F.lit(". ")))
    rows = stacks.join(listed, "bucket").withColumn("s", sentences).withColumn("k", F.size("needles"))
    edge = lambda i: F.floor(F.length("haystack") * i / (F.col("k") + 1)).cast("int")
    piece = lambda i: F.concat(F.substring(F.col("haystack"), edge(i - 1) + 1, edge(i) - edge(i - 1)), F.coalesce(F.get("s", i - 1), F.lit("")))
    asked = F.filter("needles", lambda s: s["asked"])
    keys = F.array_sort(F.array_distinct(F.transform(asked, lambda s: s["key"])))
    return rows.select(
        "bucket",
        F.array_join(F.transform(F.sequence(F.lit(1), F.col("k") + 1), piece), "").alias("prompt"),
        F.concat(F.lit("What are all the special numbers for "), F.array_join(keys, ", "), F.lit("?")).alias("question"),
        F.transform(asked, lambda s: s["value"]).alias("answers"),
    )


def top_words(docs: DataFrame, by: str, k: int, text_column: str = "text") -> DataFrame:
    """by, word, n, place: the ``k`` most frequent words of each group, ties in word order."""
    counts = docs.select(by, F.explode(normal_words(F.col(text_column))).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def _word_list(ranked: DataFrame, by: str, copies: Column, answers: int) -> DataFrame:
    """by, prompt, answers: each word ``copies`` times in an order fixed by hash, and the first words as answer."""
    rows = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    mixed = F.sort_array(F.collect_list(F.struct(F.md5(F.concat("word", F.lit("#"), F.col("copy").cast("string"))).alias("m"), "word")))
    first = F.sort_array(F.collect_set(F.when(F.col("place") <= answers, F.struct("place", "word"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(mixed, lambda s: s["word"]), " ").alias("prompt"), F.transform(first, lambda s: s["word"]).alias("answers"))


def common_words_dataset(docs: DataFrame, by: str, common: int = 10, words: int = 60, often: int = 30, seldom: int = 3) -> DataFrame:
    """Word lists in which the ``common`` commonest words stand ``often`` times and the others ``seldom`` times."""
    ranked = top_words(docs, by, words)
    return _word_list(ranked, by, F.when(F.col("place") <= common, often).otherwise(seldom), common)


def frequent_words_dataset(docs: DataFrame, by: str, words: int = 60, most: int = 120, alpha: float = 2.0, answers: int = 3) -> DataFrame:
    """Word lists in which the word at place p stands most / p**alpha times, once at least."""
    ranked = top_words(docs, by, words)
    return _word_list(ranked, by, F.greatest(F.floor(most / F.pow(F.col("place"), F.lit(alpha))), F.lit(1)), answers)


def distractor_qa_dataset(items: DataFrame, corpus: DataFrame, k: int, buckets: int = 64, item_column: str = "item_id", doc_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """item_id, prompt, gold_place: each item's passage among ``k`` distractors of its bucket, in hash order, never the row with its own id.

    Passages are whole, the gold one and the distractors. Each bucket of documents is cut to its first k + 1 by hash before items join it, so the
    join has at most (k + 1) rows an item.
    """
    hashed = corpus.select(F.col(doc_column).alias("id"), F.col(text_column).alias("passage"), F.md5(F.col(doc_column).cast("string")).alias("m"))
    placed = hashed.withColumn("bucket", F.pmod("id", F.lit(buckets))).withColumn("p", F.row_number().over(Window.partitionBy("bucket").orderBy("m", "id"))).where(F.col("p") <= k + 1)
    pool = items.select(F.col(item_column).alias("item_id"), F.col(text_column).alias("gold"), F.pmod(item_column, F.lit(buckets)).alias("bucket"))
    near = pool.join(placed, "bucket").where(F.col("item_id") != F.col("id"))
    picked = near.groupBy("item_id", "gold").agg(F.slice(F.sort_array(F.collect_list(F.struct("m", "passage"))), 1, k).alias("d"))
    full = F.array_sort(F.concat("d", F.array(F.struct(F.md5(F.concat(F.lit("gold"), F.col("item_id").cast("string"))).alias("m"), F.col("gold").alias("passage")))))
    ready = picked.withColumn("all", full)
    return ready.select("item_id", F.array_join(F.transform("all", lambda s: s["passage"]), "\n").alias("prompt"), F.array_position(F.transform("all", lambda s: s["passage"]), F.col("gold")).cast("int").alias("gold_place"))


def variable_tracking_dataset(rows: DataFrame, id_column: str, chains: int = 2, hops: int = 4) -> DataFrame:
    """id, prompt, question, answers: chains of assignments, of which the first is asked for.

    Names and values come from the id. Lines of all chains alternate, so a chain is never in one piece.
    """
    name = lambda c, h: F.concat(F.lit("V"), F.upper(F.substring(F.md5(F.concat_ws("-", F.col(id_column).cast("string"), c.cast("string"), h.cast("string"))), 1, 5)))
    value = lambda c: F.pmod(F.col(id_column) * 7919 + c * 104729, F.lit(90_000)) + 10_000
    line = lambda c, h: F.concat(F.lit("VAR "), name(c, h), F.lit(" = "), F.when(h == 0, value(c).cast("string")).otherwise(F.concat(F.lit("VAR "), name(c, h - 1))))
    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(hops)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(chains - 1)), lambda c: line(c, h))))
    return rows.select(
        id_column,
        F.array_join(lines, "\n").alias("prompt"),
        F.concat(F.lit("Which variables are assigned the value "), value(F.lit(0)).cast("string"), F.lit("?")).alias("question"),
        F.transform(F.sequence(F.lit(0), F.lit(hops)), lambda h: name(F.lit(0), h)).alias("answers"),
    )


def domain_perplexity(rows: DataFrame, by: str = "source") -> DataFrame:
    """by with the perplexities of its rows (loglik, words, bytes): ratios of sums."""
    return rows.groupBy(by).agg(*perplexities())


def length_curve(scores: DataFrame, length: str, bins: Sequence[int], by: Sequence[str] = ("model",), value: str = "value") -> DataFrame:
    """by with a column for each bin (its upper length): the mean value of rows up to that length and above the bin before."""
    bin_of = F.lit(None).cast("int")
    for b in sorted(bins, reverse=True):
        bin_of = F.when(F.col(length) <= b, F.lit(b)).otherwise(bin_of)
    wide = scores.withColumn("_bin", bin_of).groupBy(*by).pivot("_bin", sorted(bins)).agg(F.avg(value))
    return wide.select(*by, *[F.col(f"`{b}`").alias(f"up_to_{b}") for b in sorted(bins)])


# Patterns of contact details and their masks.
CONTACTS: Mapping[str, str] = {
    "[EMAIL]": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "[MESSENGER]": r"(?i:\b(?:telegram|whatsapp|wechat|skype|signal|line)\s*(?:id)?\s*[:=]\s*@?)[A-Za-z0-9_.-]{3,}",
    "[PHONE]": r"\+?[0-9][0-9 ().-]{7,}[0-9]",
}


def redact_contacts(rows: DataFrame, text_column: str = "text") -> DataFrame:
    """Masks e-mail addresses, messenger names and phone numbers; adds ``contacts``, how many were masked."""
    text, found = F.col(text_column), F.lit(0)
    for mask, pattern in CONTACTS.items():
        found = found + F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, mask)
    return rows.withColumn("contacts", found).withColumn(text_column, text)
