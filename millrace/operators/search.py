"""Search in questions and answers: category equality and a substring, and what that leaves of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim


def matches(category: Column, text: Column, wanted: str, term: str) -> Column:
    """Whether an entry is shown. The term is trimmed and lower-cased; an empty one matches all."""
    needle = F.lower(trim(F.lit(term)))
    same = F.lit(True) if wanted == "all" else category == wanted
    return same & F.contains(F.lower(text), needle)


def search(faq: DataFrame, wanted: str, term: str, category: str = "cat", text: str = "text") -> DataFrame:
    return faq.where(matches(F.col(category), F.col(text), wanted, term))


def groups(faq: DataFrame, wanted: str, term: str, category: str = "cat", text: str = "text") -> DataFrame:
    """Per group: entries shown, and whether the group is visible."""
    shown = matches(F.col(category), F.col(text), wanted, term)
    return faq.groupBy(category).agg(F.count_if(shown).alias("shown"), F.bool_or(shown).alias("visible"))
