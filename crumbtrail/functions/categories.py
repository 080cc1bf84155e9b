"""Keyword categories of tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and their keywords, matched as substrings of lower-cased tags.
KEYWORDS: dict[str, list[str]] = {
    "spicy": ["spicy", "fiery", "heat", "kick", "chili", "chile", "jalape", "habanero", "scotch bonnet", "cayenne"],
    "hearty": ["hearty", "filling", "generous portion", "heavy", "substantial", "large portion", "big portion"],
    "light": ["light", "fresh", "refreshing", "crisp", "delicate"],
    "sweet": ["sweet", "sugary", "dessert", "syrupy", "honey"],
    "comfort": ["comforting", "classic", "familiar", "homestyle", "nostalgic", "traditional", "old-school"],
}


def categories_of(tags: Column, keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    """The categories with a keyword inside any tag, in the order of ``keywords``."""
    given = F.coalesce(tags, F.array().cast("array<string>"))

    def has(words: list[str]) -> Column:
        return F.exists(given, lambda t: F.coalesce(reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(w)) for w in words]), F.lit(False)))

    return F.array_compact(F.array(*[F.when(has(words), F.lit(name)) for name, words in keywords.items()]))
