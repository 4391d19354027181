"""Filtering and reshaping items and conversations before prompts are built."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.plans.ranking import global_rank

# Fixed value: pattern of one option in a text of lettered options.
OPTIONS = r"[abcd] \) .*?, |e \) .*?$"


def filter_category(docs: DataFrame, column: str, value: object) -> DataFrame:
    return docs.where(F.col(column) == value)


def category_tasks(docs: DataFrame, column: str, prefix: str) -> DataFrame:
    """All categories at once: one scan with a task name made of the category."""
    return docs.withColumn("task", F.concat(F.lit(prefix), F.col(column)))


def filter_nonempty(docs: DataFrame, column: str) -> DataFrame:
    return docs.where(F.length(column) > 0)


def filter_length(docs: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows whose text has ``low`` characters or more and fewer than ``high``."""
    return docs.where((F.length(column) >= low) & (F.length(column) < high))


def filter_context_condition(docs: DataFrame, column: str, value: str) -> DataFrame:
    return docs.where(F.col(column) == value)


def pack_choices(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    return docs.withColumn("choices", F.array(*columns))


def label_from_one_based(column: str) -> Column:
    """Zero-based label of a number written as text; null if it is none."""
    return F.col(column).try_cast("int") - 1


def pick_choice(choices: str, index: Column) -> Column:
    """The choice at a zero-based index; null out of range."""
    return F.get(choices, index)


def map_label(column: str, mapping: Mapping[object, str], strict: bool = True) -> Column:
    """The word for a code. A code without one is an error, or null if not ``strict``."""
    found = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col(column)]
    missing = F.raise_error(F.concat(F.lit(f"{column}: no label for "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return F.coalesce(found, missing) if strict else found


def threshold_label(a: str, b: str, cut: float) -> Column:
    """1 where the sum is above ``cut``, strictly."""
    return (F.col(a) + F.col(b) > cut).cast("int")


def binary_label_from_value(column: str, zero: str) -> Column:
    return F.when(F.col(column) == zero, 0).otherwise(1)


def parse_options(column: str) -> Column:
    """Texts of lettered options "a ) x , b ) y , ... e ) z": label and trailing commas and spaces cut off."""
    found = F.regexp_extract_all(F.col(column), F.lit(OPTIONS), F.lit(0))
    return F.transform(found, lambda option: F.rtrim(F.substring(option, F.lit(5), F.length(option)), F.lit(" ,")))


def pair_field(column: str, key: str) -> Column:
    return F.col(column)[key]


def select_direction(docs: DataFrame, source: str, target: str) -> DataFrame:
    return docs.where((F.col("src") == source) & (F.col("tgt") == target))


def parallel_pairs(docs: DataFrame, id_column: str, languages: Mapping[str, str], directions: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (id, src, tgt, source_text, target_text) for each wanted pair of a wide parallel corpus.

    ``languages`` names the column of each language. Pairs without one of the texts are left out. A row makes its own pairs, so nothing is
    shuffled; all ordered pairs of different languages unless ``directions`` lists fewer.
    """
    wanted = directions or [(a, b) for a in languages for b in languages if a != b]
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("tgt"), F.col(languages[a]).alias("source_text"), F.col(languages[b]).alias("target_text")) for a, b in wanted])
    rows = docs.select(id_column, F.explode(pairs).alias("p")).select(id_column, "p.*")
    return rows.where(F.col("source_text").isNotNull() & F.col("target_text").isNotNull())


def permute_choices(docs: DataFrame, seed: int, id_column: str = "doc_id") -> DataFrame:
    """Choices in an order fixed by seed, item and place; ``gold`` moves with its choice."""
    key = lambda i: F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string"), i.cast("string")), 256)
    tagged = F.array_sort(F.transform("choices", lambda c, i: F.struct(key(i).alias("k"), i.alias("i"), c.alias("c"))))
    moved = docs.withColumn("_order", tagged)
    place = F.array_position(F.transform("_order", lambda s: s["i"]), F.col("gold").cast("int")) - 1
    return moved.withColumn("choices", F.transform("_order", lambda s: s["c"])).withColumn("gold", F.when(place >= 0, place).cast("int")).drop("_order")


def minimal_pair(docs: DataFrame, good: str, bad: str) -> DataFrame:
    return docs.withColumn("choices", F.array(good, bad)).withColumn("gold", F.lit(0))


def turn_limits(turns: DataFrame, max_user: int, max_assistant: int) -> DataFrame:
    """Turns of a conversation up to the last one before a role exceeds its number of turns; other roles are free."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda role: F.count(F.when(F.col("role") == role, 1)).over(so_far)
    marked = turns.select(F.struct("*").alias("turn"), count("user").alias("user"), count("assistant").alias("assistant"))  # columns of any names are kept
    return marked.where((F.col("user") <= max_user) & (F.col("assistant") <= max_assistant)).select("turn.*")


def length_limits(pairs: DataFrame, prompt: str, response: str, max_prompt: int, max_response: int) -> DataFrame:
    """Pairs whose prompt and response have at most so many words between white space."""
    words = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != ""))
    return pairs.where((words(prompt) <= max_prompt) & (words(response) <= max_response))


def raw_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: messages (role, content) in order of turn."""
    held = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.transform(held, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def assign_batches(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Adds ``batch`` and ``slot``: rows in global order, ``size`` to a batch, without a single-partition window."""
    ranked = global_rank(df, order, name="_rank")
    return ranked.withColumn("batch", F.floor(F.col("_rank") / size).cast("long")).withColumn("slot", (F.col("_rank") % size).cast("int")).drop("_rank")
