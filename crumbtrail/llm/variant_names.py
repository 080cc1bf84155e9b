"""Spellings of one name, linked by a pigeonhole segment join.

Names of one scope (a business) are first brought to a canonical form: accents, hyphens, articles and
connecting words go, "x of y", "y, x" and "x (y)" take the plain order, plurals their stem. Equal forms are one
item. A name with a word that is rare in the whole collection may be a misspelling: each indexed name is
cut into k + 1 segments, so that k edits leave one of them whole; the substrings of the rare name,
at all places that the edits can have shifted them to, are looked up among the segments, and banded edit
distance verifies what is met. Abbreviated words differ too much for edits; they are looked up with the rare
words left open. In both, words are compared in pairs, and two words that are both common are different
words, however alike, unless one is much more common; rare words may be spellings whatever their frequencies. Initials and names without their inner words count only where a single item fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.text import normalize
from crumbtrail.session import stage

# Words that carry no part of a name, at its start and between its parts.
ARTICLES = frozenset(["the", "a", "an", "their", "our", "my", "your", "his", "her", "this", "that", "these", "those", "some", "house"])
JOINS = frozenset(["with", "and", "w", "n", "in", "on"])
#: A word is rare under this share of the document frequency that the median word has.
RARE_SHARE, RARE_LEAST = 0.1, 3
#: How many times as common the right spelling is, at least.
RATIO = 4
SHORT_INITIALS, LONG_INITIALS = 3, 8
#: Distinct words up to which they are sent to every executor (some 50 bytes each).
BROADCAST_ROWS = 300_000
#: Items whose keys are joined at a time (some 600 bytes of disk each), or those of one larger scope.
ROUND_ITEMS = 500_000


def _k(length: int) -> int:
    """Edits allowed in a name of so many letters."""
    return 1 if length < 8 else 2 if length < 14 else 3


@lru_cache(200_000)
def _joining(word: str) -> str:
    return "with" if 3 <= len(word) <= 5 and word != "with" and distance(word, "with", 1) == 1 else word


def canonical(name: str) -> tuple[list[str], int]:
    """The words of a normalised name in canonical order, and how many of them come before its first joining word."""
    s = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    s = re.sub(r"\bw/\s*", " with ", s).replace("&", " with ")
    s = re.sub(r"\s[-–—]\s", " with ", s)
    # A joining word is still one with a letter wrong.
    written = [_joining(w) for w in s.split()]
    while len(written) > 1 and written[0] in ARTICLES:
        written = written[1:]
    s = " ".join(written)
    parts = re.split(r"\s(?:with|and)\s", s, maxsplit=1)
    head, tail = parts[0], parts[1] if len(parts) > 1 else ""
    if m := re.match(r"(.*?)\(([^)]*)\)\s*(.*)$", head):
        head = f"{m[2]} {m[1]} {m[3]}"
    if "," in head:
        first, rest = head.split(",", 1)
        head = f"{rest} {first}"
    elif m := re.match(r"(\S+(?:\s\S+)?)\sof\s(.+)$", head):
        head = f"{m[2]} {m[1]}"

    def words(x: str) -> list[str]:
        found = re.findall(r"[^\W_]+", x)
        while len(found) > 1 and found[0] in ARTICLES:
            found = found[1:]
        if len(found) == 1 and not tail:
            return found
        return [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in found if w not in JOINS]

    before, after = words(head), words(tail)
    return before + after, len(before)


def distance(a: str, b: str, k: int) -> int:
    """Edit distance with swaps of neighbours, in a band of ``k``; k + 1 if it is more."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(k + 1, len(a) + len(b))
    far = k + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [far] * len(b)
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            d = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            row[j] = d
        if min(row) > k:
            return far
        before, last = last, row
    return min(far, last[-1])


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` may abbreviate ``word``: its start (but for a last letter), its end, or its letters in order."""
    if len(short) < 3 or len(short) > 0.8 * len(word):
        return False
    if word.startswith(short) or (len(short) >= 5 and word.startswith(short[:-1])) or (len(short) >= 5 and word.endswith(short)):
        return True
    letters = iter(word)
    return short[0] == word[0] and all(c in letters for c in short)


def word_cost(x: str, fx: int, y: str, fy: int, floor: int = 0) -> float | None:
    """How far apart two words are, or None if they are different words. fx, fy: their frequencies.

    Frequencies tell words apart only where both reach ``floor``. Of two words below it, only edits make one the other.
    """
    if x == y:
        return 0
    (rare, fr), (common, fc) = ((x, fx), (y, fy)) if fx <= fy else ((y, fy), (x, fx))
    if fr * RATIO > fc and fr >= floor:
        return None
    d = distance(rare, common, 2)
    if d <= (1 if len(common) < 5 else 2):
        return d
    return 1.5 if fr * RATIO <= fc and shortens(rare, common) else None


def name_cost(a: list[str], fa: list[int], b: list[str], fb: list[int], floor: int = 0) -> float | None:
    """The least cost of pairing all words of two names in order, where two may stand for one."""
    if len(a) == len(b):
        total = 0.0
        for x, fx, y, fy in zip(a, fa, b, fb):
            if x != y:
                if (c := word_cost(x, fx, y, fy, floor)) is None:
                    break
                total += c
        else:
            return total
    # Words can only be joined or cut differently where the letters stay.
    one, other = "".join(a), "".join(b)
    k = _k(max(len(one), len(other)))
    if abs(len(a) - len(b)) > 2 or distance(one, other, k) > k:
        return None
    best: dict[tuple[int, int], float | None] = {(len(a), len(b)): 0}

    def joined(two: list[str], one: str) -> float | None:
        d = distance("".join(two), one, 1)
        return 0.5 + d if d <= 1 else None

    for i in range(len(a), -1, -1):
        for j in range(len(b), -1, -1):
            if (i, j) == (len(a), len(b)):
                continue
            ways = []
            if i < len(a) and j < len(b):
                ways.append((word_cost(a[i], fa[i], b[j], fb[j], floor), (i + 1, j + 1)))
                if i + 1 < len(a):
                    ways.append((joined(a[i : i + 2], b[j]), (i + 2, j + 1)))
                if j + 1 < len(b):
                    ways.append((joined(b[j : j + 2], a[i]), (i + 1, j + 2)))
            costs = [c + best[to] for c, to in ways if c is not None and best.get(to) is not None]
            best[i, j] = min(costs, default=None)
    return best[0, 0]


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


@lru_cache(500_000)
def _part(place: int, word: str) -> int:
    return _key(f"{place}\x1f{word}")


def _open(scope: object, words: list[str]) -> Callable[[Sequence[int]], int]:
    """Gives the key of a name with the words at some places left open: a sum over its places."""
    parts = [_part(i, w) for i, w in enumerate(words)]
    whole, less = _key(f"{scope}\x1f{len(words)}") + sum(parts), [p - _part(i, "*") for i, p in enumerate(parts)]
    return lambda places: (whole - sum([less[i] for i in places])) & (2**64 - 1)


def _rows(keys: list[int], ids: list[int], most: list[int], bits: list[int], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(np.array(bits, np.uint64).view(np.int64)), pa.array(most, pa.int32())], names=names)


@lru_cache(500_000)
def _bit(word: str) -> int:
    return 1 << (_key(word) & 63)


def signature(words: list[str]) -> int:
    """64 bits, one set by each word."""
    bits = 0
    for w in words:
        bits |= _bit(w)
    return bits


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [canonical(n) for n in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([f[0] for f in forms], pa.list_(pa.string())), pa.array([f[1] for f in forms], pa.int32())],
            names=[*batch.schema.names, "words", "n_head"],
        )


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of an item: its k + 1 segments with place and length, and its words with one or two left open."""
    for batch in batches:
        keys, ids, most, bits = [], [], [], []
        for scope, item, words, rare in zip(*(c.to_pylist() for c in batch.columns)):
            s = "".join(words)
            k = _k(len(s))
            cuts = [len(s) * i // (k + 1) for i in range(k + 2)]
            found = {_key(f"{scope}\x1f{len(s)}\x1f{i}\x1f{s[cuts[i] : cuts[i + 1]]}") for i in range(k + 1)}
            opened = _open(scope, words)
            for gaps in (1, 2):
                found.update(map(opened, combinations(range(len(words)), gaps)))
            keys += found
            ids += [item] * len(found)
            most += [max(1, len(rare))] * len(found)
            bits += [signature(words)] * len(found)
        yield _rows(keys, ids, most, bits, ("key", "item", "bits_b", "open_b"))


def _probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys under which a name with rare words looks for items."""
    for batch in batches:
        keys, ids, most, bits = [], [], [], []
        for scope, item, words, rare in zip(*(c.to_pylist() for c in batch.columns)):
            s = "".join(words)
            found = set()
            for length in range(max(1, len(s) - 3), len(s) + 4):
                k, extra = _k(length), len(s) - length
                if abs(extra) > k:
                    continue
                cuts = [length * i // (k + 1) for i in range(k + 2)]
                for i in range(k + 1):
                    n = cuts[i + 1] - cuts[i]
                    low, high = cuts[i] - (k - extra) // 2, cuts[i] + (k + extra) // 2
                    found |= {_key(f"{scope}\x1f{length}\x1f{i}\x1f{s[p : p + n]}") for p in range(max(0, low), min(len(s) - n, high) + 1)}
            if 0 < len(rare) <= 2:
                found.add(_open(scope, words)(rare))
            keys += found
            ids += [item] * len(found)
            most += [len(rare)] * len(found)
            bits += [signature([w for i, w in enumerate(words) if i not in rare])] * len(found)
        yield _rows(keys, ids, most, bits, ("key", "probe", "bits_a", "open_a"))


def _verify(floor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probe, item, cost = [], [], []
            for p, wa, fa, i, wb, fb in zip(*(c.to_pylist() for c in batch.columns)):
                c = name_cost(wa, fa, wb, fb, floor)
                if c is not None:
                    probe.append(p)
                    item.append(i)
                    cost.append(float(c))
            yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int64()), pa.array(item, pa.int64()), pa.array(cost, pa.float64())], names=["probe", "item", "cost"])

    return run


def near_items(items: DataFrame, floor: int = 0) -> DataFrame:
    """probe, item, cost: the items of the same scope that an item with rare words may be a spelling of.

    ``items`` has scope, item, words, freqs, rare (places of the rare words) and common (the other words). Found are all
    pairs within the edits that their letters allow, and all whose words pair up with at most two rare ones. Pairs of
    words that both occur ``floor`` times or more are spellings of one only if one is RATIO times as common.
    """
    index = items.select("scope", "item", "words", "rare").mapInArrow(_index_rows, "key long, item long, bits_b long, open_b int")
    probes = items.where(F.size("rare") > 0).select("scope", "item", "words", "rare").mapInArrow(_probe_rows, "key long, probe long, bits_a long, open_a int")
    # At least so many common words does the item lack, by the bits that words set: a pair that lacks too many goes no further.
    lacking = F.bit_count(F.col("bits_a").bitwiseAND(F.bitwise_not("bits_b")))
    met = probes.join(index, "key").where((F.col("probe") != F.col("item")) & (lacking <= F.col("open_b"))).select("probe", "item").distinct()
    a = items.select(F.col("item").alias("probe"), F.col("words").alias("wa"), F.col("freqs").alias("fa"), F.col("common").alias("ca"))
    b = items.select("item", F.col("words").alias("wb"), F.col("freqs").alias("fb"), F.size("rare").alias("rb"))
    # A common word only stands for a rare one of the item, or is a piece of a cut word; so most must be met.
    lacks, more = F.size(F.array_except("ca", "wb")), F.size(F.array_except("wb", "wa"))
    alike = (lacks <= F.greatest(F.lit(1), "rb")) & (more <= F.size("wa") - F.size("ca") + lacks + 1)
    # With as many words, each must be near its like or may shorten it; else all letters must be nearly the same (a swap counts twice here).
    def like(pair):
        x, y = pair["wa"], pair["wb"]
        short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
        cut = (F.length(short) >= 3) & (F.length(short) <= 0.8 * F.length(long)) & ((F.substring(short, 1, 1) == F.substring(long, 1, 1)) | F.endswith(long, short))
        return (x == y) | cut | (F.levenshtein(x, y, 4) >= 0)

    each = (F.size("wa") == F.size("wb")) & F.forall(F.arrays_zip("wa", "wb"), like)
    letters = each | (F.levenshtein(F.array_join("wa", ""), F.array_join("wb", ""), 2 * _k(1 << 20)) >= 0)
    return met.join(a, "probe").join(b, "item").where(alike & letters).select("probe", "wa", "fa", "item", "wb", "fb").mapInArrow(_verify(floor), "probe long, item long, cost double")


def name_groups(df: DataFrame, scope: str, name: str, record_id: str | None = None) -> DataFrame:
    """scope, name (normalised), item: each distinct name with the canonical form of what it means.

    Null scopes and null and blank names are left out; repeated rows count as mentions but give
    one row. With ``record_id``, a repeated id counts once, and a null one not at all. A rare spelling means the nearest item, by mentions where both have rare words; where two items are equally
    near it is left as it is. A name that means nothing else is its own item; names without letters or digits are only equal to
    themselves. No rows, no groups. Other columns are not read.
    """
    kind = df.schema[scope].dataType.simpleString()
    if record_id is not None:
        df = df.where(F.col(record_id).isNotNull()).select(record_id, scope, name).dropDuplicates([record_id])
    named = df.where(F.col(scope).isNotNull()).select(F.col(scope).alias("scope"), normalize(F.col(name)).alias("name")).where(F.col("name") != "")
    counted = named.groupBy("scope", "name").agg(F.count("*").alias("mentions"))
    forms = counted.mapInArrow(_canonical_rows, f"scope {kind}, name string, mentions long, words array<string>, n_head int")
    forms = forms.withColumn("words", F.when(F.size("words") == 0, F.array("name")).otherwise(F.col("words")))
    # The compact form is the item: names that differ in spaces and order only share it.
    forms = stage(forms.withColumn("compact", F.array_join("words", "")).withColumn("item", F.xxhash64("scope", "compact")), "names")

    # Each word's names, and how often it stands in any; the median word is that of all places.
    seen = forms.select(F.posexplode("words").alias("at", "word"), "words").select("word", (F.array_position("words", F.col("word")) == F.col("at") + 1).cast("long").alias("first"))
    terms = stage(seen.groupBy("word").agg(F.sum("first").alias("df"), F.count("*").alias("places")), "words")
    middle = terms.agg(F.percentile("df", 0.5, F.col("places"))).first()[0]
    floor = max(RARE_LEAST, int(RARE_SHARE * (middle or 0)))
    # An item's words: those of its most mentioned name.
    best = F.max_by(F.struct("words", "n_head"), F.struct("mentions", F.size("words"), "name"))
    items = stage(forms.groupBy("scope", "item").agg(best.alias("b"), F.sum("mentions").alias("mentions")).select("scope", "item", "b.*", "mentions"), "item-words")
    dfs = terms.select("word", "df")
    few = dfs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    long = items.select("item", F.posexplode("words").alias("pos", "word")).join(F.broadcast(dfs) if few else dfs, "word")
    freqs = long.groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "df"))), lambda x: x["df"]).alias("freqs"))
    items = items.join(freqs, "item").withColumn("rare", F.filter(F.transform("freqs", lambda f, i: F.when(f < floor, i)), lambda i: i.isNotNull()))
    items = items.withColumn("common", F.array_compact(F.zip_with("words", "freqs", lambda w, f: F.when(f >= floor, w))))
    items = stage(items, "items")

    # Keys hold their scope, so scopes are joined in rounds: only one round's keys are on disk at a time.
    rounds = -(-items.count() // ROUND_ITEMS)
    of = F.pmod(F.xxhash64("scope", F.lit("round")), F.lit(max(1, rounds)))
    near = reduce(DataFrame.unionByName, [stage(near_items(items.where(of == k), floor), "near") for k in range(max(1, rounds))])
    # A rare spelling means the nearest item; of items with rare words themselves, only a more common one.
    side = items.select("item", F.size("rare").alias("n_rare"), "mentions")
    own = items.select(F.col("item").alias("probe"), F.size("rare").alias("own_rare"), F.col("mentions").alias("own"))
    options = near.join(side, "item").join(own, "probe").where((F.col("n_rare") < F.col("own_rare")) | (F.struct("mentions", "item") > F.struct("own", "probe")))
    order = Window.partitionBy("probe").orderBy(F.col("n_rare") > 0, "cost", F.col("mentions").desc(), "item")
    second = F.lead("cost").over(order)
    chosen = options.withColumn("_r", F.row_number().over(order)).withColumn("_tie", (second == F.col("cost")) & (F.lead("n_rare").over(order) == F.col("n_rare")))
    links = stage(chosen.where((F.col("_r") == 1) & ~F.coalesce("_tie", F.lit(False))).select("probe", F.col("item").alias("means")), "links")
    up = links.select(F.col("probe").alias("means"), F.col("means").alias("top"))
    links = links.join(up, "means", "left").select("probe", F.coalesce("top", "means").alias("means"))

    # What is left: initials and names without their inner words, where one item alone fits.
    settled = items.join(links.select(F.col("probe").alias("item")), "item", "left_anti")
    initials = F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")
    ends = F.concat_ws(" ", F.element_at("words", 1), F.element_at(F.slice("words", 1, F.col("n_head")), -1))
    offers = settled.where(F.size("words") >= SHORT_INITIALS).select("scope", F.explode(F.array(F.struct(initials.alias("short"), F.lit(1).alias("kind")), F.struct(F.when(F.col("n_head") >= 3, ends).alias("short"), F.lit(2).alias("kind")))).alias("o"), "item")
    offers = offers.where("o.short IS NOT NULL").groupBy("scope", "o.short", "o.kind").agg(F.min("item").alias("means"), F.count("*").alias("n")).where("n = 1")
    one = F.when((F.size("words") == 1) & F.length(F.element_at("words", 1)).between(SHORT_INITIALS, LONG_INITIALS) & (F.size("rare") == 1), 1)
    two = F.when(F.size("words") == 2, 2)
    asked = settled.select("scope", F.array_join("words", " ").alias("short"), F.coalesce(one, two).alias("kind"), F.col("item").alias("probe")).where("kind IS NOT NULL")
    fits = asked.join(offers, ["scope", "short", "kind"]).where("probe != means").select("probe", "means")
    found = forms.join(links.unionByName(fits).select(F.col("probe").alias("item"), "means"), "item", "left")
    return found.select(F.col("scope").alias(scope), "name", F.coalesce("means", "item").alias("item"))


def name_pairs(groups: DataFrame, scope: str) -> DataFrame:
    """scope, name_a, name_b (name_a < name_b): all pairs of names that mean one item."""
    groups = stage(groups, "groups")  # both sides read it
    a, b = groups.select(scope, "item", F.col("name").alias("name_a")), groups.select(scope, "item", F.col("name").alias("name_b"))
    return a.join(b, [scope, "item"]).where("name_a < name_b").select(scope, "name_a", "name_b")
