"""What an external model would do, as replaceable parts with offline defaults."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crumbtrail.functions.text import tags_text
from crumbtrail.schemas import MENTIONS
from crumbtrail.sources.sinks import append


class Extractor(Protocol):
    def __call__(self, text: str) -> list[dict]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class BlurbWriter(Protocol):
    def __call__(self, business: str, facts: pd.DataFrame) -> list[str]: ...


# Words of praise and of blame for the lexicon extractor.
GOOD = frozenset("amazing beautiful best bright buttery comforting creamy crisp crispy delicate delicious excellent fantastic flavorful fragrant fresh generous good great hearty incredible juicy lively perfect rich savory silky tasty tender unforgettable vivid zesty zingy".split())
BAD = frozenset("awful bad bitter bland burnt chalky clumsy cold dry flat forgettable gluey greasy gritty limp lukewarm mushy oversalted overpriced rubbery rushed salty soggy sour stale tired tough undercooked underseasoned watery worst".split())
_DISH = re.compile(r"\b(?:the|our|my|a|this)\s+((?:[a-zñéèíáó'-]+\s){1,5}?)(?:was|were|is|are|came|tasted|felt|arrived)\b\s*(.*)", re.IGNORECASE)


def lexicon_extractor(text: str) -> list[dict]:
    """Mentions by sentence: ``the <dish> was ...`` with up to three words of praise or blame as tags."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
        if m := _DISH.search(sentence):
            words = re.findall(r"[^\W\d_]+", m[2].lower())
            good, bad = [w for w in words if w in GOOD], [w for w in words if w in BAD]
            sentiment = "positive" if len(good) > len(bad) else "negative" if bad else "neutral"
            out.append({"dish": m[1].strip(), "sentiment": sentiment, "tags": (good + bad)[:3]})
    return out


def extract(reviews: DataFrame, extractor: Extractor = lexicon_extractor, concurrency: int = 10, attempts: int = 4, wait: tuple[float, float] = (2.0, 30.0)) -> DataFrame:
    """review_id, business_id, mentions, error: a review that fails ``attempts`` times has an error and no mentions.

    ``concurrency``, 1 to 50, is the number of calls that a task makes at a time; how many tasks there are follows the
    data and the cluster. Between attempts a call waits ``wait[0]`` seconds, then twice as long each time, up to ``wait[1]``.
    """
    if not 1 <= concurrency <= 50:
        raise ValueError("concurrency must be 1 to 50")

    def call(text: str) -> tuple[list[dict] | None, str | None]:
        for attempt in range(attempts):
            try:
                return extractor(text), None
            except Exception as problem:
                if attempt == attempts - 1:
                    return None, f"{type(problem).__name__}: {problem}"
                time.sleep(min(wait[1], wait[0] * 2**attempt))
        return None, "no attempt"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as calls:
            for frame in frames:
                done = list((calls.map if concurrency > 1 else map)(call, frame["review_text"]))
                yield pd.DataFrame({"review_id": frame["id"], "business_id": frame["business_id"], "mentions": [d[0] for d in done], "error": [d[1] for d in done]})

    schema = f"review_id long, business_id long, mentions {MENTIONS.simpleString()}, error string"
    return reviews.select("id", "business_id", "review_text").mapInPandas(run, schema)


_DISH_CLAUSE = r"\b(?:the|our|my|a|this) ((?:[a-zñéèíáó'-]+ ){0,4}?[a-zñéèíáó'-]+) (?:was|were|is|are|came|tasted|felt|arrived)\b([^.!?\n]*)"


def pattern_mentions(text: Column) -> Column:
    """The same kind of mentions as an array Column: each ``the <dish> was ...`` with up to three words of praise or blame."""
    low = F.lower(F.coalesce(text, F.lit("")))
    names, rests = (F.regexp_extract_all(low, F.lit(_DISH_CLAUSE), F.lit(k)) for k in (1, 2))

    def mention(name: Column, rest: Column) -> Column:
        words = F.regexp_extract_all(rest, F.lit("[a-z]+"), F.lit(0))
        good, bad = F.filter(words, lambda w: w.isin(*sorted(GOOD))), F.filter(words, lambda w: w.isin(*sorted(BAD)))
        sentiment = F.when(F.size(good) > F.size(bad), "positive").when(F.size(bad) > 0, "negative").otherwise("neutral")
        return F.struct(name.alias("dish"), sentiment.alias("sentiment"), F.slice(F.concat(good, bad), 1, 3).alias("tags"))

    return F.zip_with(names, rests, mention)


def extract_by_pattern(reviews: DataFrame) -> DataFrame:
    """``extract`` without an external model: columns only, so that nothing leaves the JVM and nothing fails."""
    return reviews.select(F.col("id").alias("review_id"), "business_id", pattern_mentions(F.col("review_text")).alias("mentions"), F.lit(None).cast("string").alias("error"))


def mention_rows(extracted: DataFrame) -> DataFrame:
    """review_id, business_id, dish_name, sentiment, tags, position: one row per mention of the reviews that didn't fail."""
    long = extracted.where(F.col("error").isNull()).select("review_id", "business_id", F.posexplode("mentions").alias("position", "m"))
    return long.select("review_id", "business_id", F.col("m.dish").alias("dish_name"), F.col("m.sentiment").alias("sentiment"), F.coalesce("m.tags", F.array().cast("array<string>")).alias("tags"), "position")


def run_counts(extracted: DataFrame) -> DataFrame:
    """One row: reviews processed, mentions found, reviews failed."""
    return extracted.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("mentions"))), F.lit(0)).cast("long").alias("mentions"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def hashing_embedder(size: int = 64) -> Embedder:
    """Character trigrams hashed into ``size`` signed places."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * size
            padded = f"  {text}  "
            for i in range(len(padded) - 2):
                h = xxhash.xxh3_64_intdigest(padded[i : i + 3])
                v[h % size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return embed


def embed(names: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 1000) -> DataFrame:
    """``names`` with ``embedding``; each distinct text is embedded once, at most ``batch`` per call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].tolist()
            vectors = [v for lo in range(0, len(texts), batch) for v in embedder(texts[lo : lo + batch])]
            yield pd.DataFrame({text: texts, "embedding": vectors})

    distinct = names.where(F.col(text).isNotNull()).select(text).distinct().mapInPandas(run, f"`{text}` string, embedding array<float>")
    return names.join(distinct, text, "left")


def prompt(business: str = "business_name"):
    """The facts handed to a blurb writer, as text."""
    return F.concat(
        F.lit("Write one sentence on "), F.col("name"), F.lit(" at "), F.col(business), F.lit(". It came up "), F.col("mention_count").cast("string"), F.lit(" times; "), F.col("positive_count").cast("string"), F.lit(" liked it, "),
        F.col("negative_count").cast("string"), F.lit(" did not. Guests wrote: "), tags_text(F.col("tags"), "nothing in particular"), F.lit("."),
    )


def template_blurb():
    """The default blurb as a Column."""
    return F.concat(F.col("name"), F.lit(": praised by "), F.col("positive_count").cast("string"), F.lit(" of "), (F.col("positive_count") + F.col("negative_count")).cast("string"), F.lit(" voters; "), tags_text(F.col("tags"), "no tags yet"), F.lit("."))


def facts() -> Column:
    """What a blurb was written from, as a number: counts and tags. If they change, the old blurb no longer holds."""
    return F.xxhash64(F.col("mention_count").cast("long"), F.col("positive_count").cast("long"), F.col("negative_count").cast("long"), F.coalesce("tags", F.array().cast("array<string>")))


def blurb_cache(profiles: DataFrame) -> DataFrame:
    """The cache (business_id, name, facts, blurb) of profiles that hold a blurb; an empty or null one is none."""
    return profiles.where("blurb != ''").select("business_id", "name", facts().alias("facts"), "blurb")


def with_blurbs(ranked: DataFrame, cache: DataFrame, write=template_blurb) -> tuple[DataFrame, DataFrame]:
    """(rows with ``blurb``, new cache rows): the cache (business_id, name, facts, blurb) first, the writer for what it lacks.

    An empty or null cached blurb is a miss, and so is one of other counts or tags. Where the cache has several, the
    smallest text serves.
    """
    keys = ["business_id", "name", "facts"]
    held = cache.where("blurb != ''").groupBy(*keys).agg(F.min("blurb").alias("_held"))
    rows = ranked.drop("blurb").withColumn("facts", facts()).join(held, keys, "left")
    out = rows.withColumn("blurb", F.coalesce("_held", write()))
    return out.drop("_held", "facts"), out.where(F.col("_held").isNull()).select(*keys, "blurb")


def keep_blurbs(new: DataFrame, path: str) -> None:
    """Appends the new rows of ``with_blurbs`` to the cache stored at ``path``."""
    append(new, path)
