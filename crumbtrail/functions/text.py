"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACES = r"(?U)[\s\x1c-\x1f]+"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Without white space at either end; inner white space stays."""
    return F.regexp_replace(c, EDGES, "")


def normalize(c: Column) -> Column:
    """Runs of white space as one space, ends stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, SPACES, " ")))


def split_csv(c: Column) -> Column:
    """Comma-separated text as an array: pieces stripped, empty ones dropped, null as empty."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(pieces, lambda x: x != "")


def or_null(c: Column) -> Column:
    """Null for the empty string."""
    return F.when(c != "", c)


def address_line(name: Column, *parts: Column) -> Column:
    """``name — part, part``, without null and empty parts; only the name if there are none."""
    place = F.concat_ws(", ", *[or_null(p) for p in parts])
    return F.when(place != "", F.concat(name, F.lit(" — "), place)).otherwise(name)


def tags_text(tags: Column, fallback: str) -> Column:
    return F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, F.array_join(tags, ", ")).otherwise(F.lit(fallback))


def highlight(text: Column, query: str) -> Column:
    """struct(before, hit, after) of the first match, case ignored; no match: all in ``before``."""
    at = F.instr(F.lower(text), F.lit(query.lower())) if query else F.lit(0)
    n = len(query)
    none = F.lit("")
    return F.struct(
        F.when(at > 0, F.substring(text, 1, at - 1)).otherwise(text).alias("before"),
        F.when(at > 0, F.substring(text, at, F.lit(n))).otherwise(none).alias("hit"),
        F.when(at > 0, F.substring(text, at + n, F.length(text))).otherwise(none).alias("after"),
    )


def counted(n: Column, noun: str) -> Column:
    """``1 mention``, ``2 mentions``."""
    return F.concat(n.cast("string"), F.lit(" " + noun), F.when(n == 1, "").otherwise("s"))
