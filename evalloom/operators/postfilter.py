"""Cleaning generated texts before they are scored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.template import strip

# Articles that answer normalisation leaves out, by language.
ARTICLES: Mapping[str, tuple[str, ...]] = {
    "en": ("a", "an", "the"),
    "es": ("un", "una", "unos", "unas", "el", "la", "los", "las"),
    "de": ("ein", "eine", "einen", "einem", "eines", "einer", "der", "die", "das", "den", "dem", "des"),
    "fr": ("le", "la", "les", "un", "une", "des", "du"),
    "vi": ("của", "là", "cái", "chiếc", "những"),
}
# Articles that are the beginning of a word, by language.
JOINED_ARTICLES: Mapping[str, str] = {"ar": "ال"}


def stop_at(text: Column, stops: Sequence[str]) -> Column:
    """The text before the earliest stop string; all of it without stops."""
    if not stops:
        return text
    places = [F.when(F.locate(s, text) > 0, F.locate(s, text)) for s in stops if s]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def strict_match(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern's group matches first; null for no answer."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_choice_letter(text: Column, letters: str = "ABCD", lead: str = r"(?i:answer)\s*:?\s*") -> Column:
    """The choice letter after a lead-in; null for none."""
    return strict_match(text, rf"{lead}\(?([{letters}])\b")


def take_first(responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One response for each key: that of the smallest repeat number."""
    return responses.groupBy(*keys).agg(F.min_by("text", "repeat").alias("text"))


def normalize_answer(text: Column, lang: str = "en") -> Column:
    """Lower case without punctuation, articles of the language, and surplus white space.

    Punctuation is all of Unicode's; articles go where they stand as words, joined ones where they begin a longer word. Languages in neither table lose none.
    """
    bare = F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", "")
    if ARTICLES.get(lang):
        bare = F.regexp_replace(bare, rf"(?U)\b({'|'.join(ARTICLES[lang])})\b", " ")
    if lang in JOINED_ARTICLES:
        bare = F.regexp_replace(bare, rf"(?U)\b{JOINED_ARTICLES[lang]}(?=\w)", "")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))
