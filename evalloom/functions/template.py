"""Column functions that build prompt texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{([^{}]+)\}")


def render(template: str) -> Column:
    """Literal text with {field} substituted; a null field is empty. A bare field is "{name}"."""
    parts, at = [], 0
    for match in _FIELD.finditer(template):
        parts += [F.lit(template[at : match.start()]), F.coalesce(F.col(match[1]).cast("string"), F.lit(""))]
        at = match.end()
    return F.concat(*parts, F.lit(template[at:]))


def strip(text: Column) -> Column:
    """Without white space, all of Unicode's, at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def index(array: Column, i: int) -> Column:
    return F.get(array, F.lit(i))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` (0-based) up to but without ``end``."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def lettered_options(choices: Column, letters: str = "ABCD", pattern: str = "{letter}. {choice}", separator: str = "\n") -> Column:
    """Choices as one text, each with its letter. More choices than letters are an error: give as many letters as an item can have choices."""
    before, after = pattern.split("{letter}")
    middle, tail = after.split("{choice}")
    line = lambda c, i: F.concat(F.lit(before), F.substring(F.lit(letters), i + 1, F.lit(1)), F.lit(middle), c, F.lit(tail))
    many = F.raise_error(F.concat(F.lit(f"only {len(letters)} letters for choices: "), F.size(choices).cast("string")))
    return F.when(F.size(choices) > len(letters), many).otherwise(F.array_join(F.transform(choices, line), separator))


def first_defined(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that the frame has and that is not null."""
    there = [F.col(n) for n in names if n in df.columns]
    if not there:
        raise ValueError(f"none of {', '.join(names)} is a column")
    return F.coalesce(*there)


def choice_sentences(before: Column, infixes: Sequence[str], after: Column) -> Column:
    return F.array(*[F.concat(before, F.lit(x), after) for x in infixes])


def join_contexts(contexts: Column, separator: str = "\n") -> Column:
    return F.array_join(contexts, separator)


def ensure_period(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare.endswith("."), bare).otherwise(F.concat(bare, F.lit(".")))


def squash_tokens(tokens: Column, newline: str = " ") -> Column:
    """Tokens joined by spaces on one line; ``newline`` replaces line feeds before white space is collapsed."""
    return strip(F.regexp_replace(F.replace(F.array_join(tokens, " "), F.lit("\n"), F.lit(newline)), r"(?U)\s+", " "))


def with_description(description: Column | str, prompt: Column) -> Column:
    return F.concat(F.lit(description) if isinstance(description, str) else F.coalesce(description, F.lit("")), prompt)


def with_target_delimiter(context: Column, target: Column, delimiter: str = " ") -> Column:
    return F.concat(context, F.lit(delimiter), target)


def prompt_variants(docs: DataFrame, templates: Sequence[str]) -> DataFrame:
    """Each row under every wording: columns variant (from 0) and prompt."""
    versions = F.array(*[F.struct(F.lit(i).alias("variant"), render(t).alias("prompt")) for i, t in enumerate(templates)])
    return docs.select("*", F.explode(versions).alias("_v")).select(*docs.columns, "_v.*")
