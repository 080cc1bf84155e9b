"""Keyword-stuffed and link-list pages by the mean mutual information of neighbouring words.

From the counts of all neighbouring tokens of the collection, each pair in a page gets its pointwise mutual
information, counted without the page itself. A pair that no other page has is incoherent: word salad, link slugs,
made-up tags; it takes the lowest value. So does a pair that the page repeats and that bunches in few pages, or that fills
the page: a collocation repeated to excess tells nothing new. A segment (a sentence or a line) is spam if the mean over its pairs
is too low, lower for what ends like a sentence, and a page if more than half of its characters lie in spam segments.

Pages are counted batch by batch: a batch sends each of its distinct pairs and words once, with its counts, however often it has
them, so that no pair or word has more rows than there are batches. What other batches also have comes back to them.
Copies of a text count once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.llm.words import codes_of, is_word, mix, run_hashes, slices
from crumbtrail.session import stage

#: Where a segment ends; the first way is that of a sentence.
END = re.compile(r"([.!?…]+[\"”'’)\]]*(?=\s|\Z))|\n+")
#: Bounds between which a pair's mutual information counts.
LOW, HIGH = -5.0, 3.0
#: Means under which a segment is spam: one that ends like a sentence, any other.
SENTENCE_MEAN, OTHER_MEAN = -3.2, 1.8
#: A pair is stuffed if a page has it so often, and it bunches so much or fills such a share of the page.
REPEATS, BUNCHING, PAGE_SHARE = 3, 2.5, 0.05
#: Letters of the pages of one batch, or one longer page.
BATCH_LETTERS = 6_000_000
#: Stand for the start of a segment, and tell words as firsts and as seconds of a pair apart.
START, FIRST, SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

BATCH = "batch long, n_classes long, n_tokens long, packed binary, keys array<long>, n array<int>, df array<int>"
#: What is packed: classes; page, end, characters and tokens of segments; pairs of tokens; weights, firsts and seconds of pairs.
PACKED = (np.int64, np.int32, np.bool_, np.int32, np.int32, np.int32, np.int32, np.int32, np.int32)


def _pack(parts: list) -> bytes:
    arrays = [np.asarray(x).astype(kind) for x, kind in zip(parts, PACKED)]
    head = np.array([len(a) for a in arrays], np.int64)
    return zstandard.compress(b"".join(a.tobytes() for a in [head, *arrays]), 1)


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    at, out = 8 * len(PACKED), []
    for kind, n in zip(PACKED, np.frombuffer(raw, np.int64, len(PACKED)).tolist()):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


@lru_cache
def _kinds() -> np.ndarray:
    """For each code point: 0 blank, 1 in a word, 2 a mark, 3 an underscore. A token is a run of one kind."""
    marks = np.array([not (chr(c).isspace() or chr(c) == "_") for c in range(0x110000)])
    kinds = np.where(is_word(), 1, np.where(marks, 2, 0)).astype(np.int8)
    kinds[ord("_")] = 3
    return kinds


def _tokens(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all tokens: hash, letters, segment; of all segments: page, whether it ends like a sentence, characters."""
    tokens: list[tuple] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    segments: list[tuple[int, bool, int]] = []
    for lo, hi in slices(texts):
        codes, _ = codes_of(texts[lo:hi])
        kinds = _kinds()[codes]
        edges = np.flatnonzero(np.diff(np.r_[0, kinds]))
        inside = kinds[edges] > 0
        first, last = edges[inside], np.r_[edges[1:], len(codes)][inside]
        before, cuts, at = len(segments), [], 0
        for page, text in enumerate(texts[lo:hi], lo):
            done = 0
            for m in END.finditer(text):
                cuts.append(at + m.end())
                segments.append((page, m[1] is not None, m.end() - done))
                done = m.end()
            if done < len(text):
                cuts.append(at + len(text))
                segments.append((page, False, len(text) - done))
            at += len(text) + 1
        tokens.append((run_hashes(codes, first, last), last - first, np.searchsorted(np.array(cuts, np.int64), first, side="right") + before))
    pages, ended, chars = (np.array(x) for x in zip(*segments)) if segments else (np.zeros(0, int),) * 3
    return *(np.concatenate(x) for x in zip(*tokens)), pages.astype(np.int64), ended.astype(bool), chars.astype(np.int64)


def _counted(classes: list[int], texts: list[str]) -> pa.RecordBatch:
    """The batch of some pages as one row: its segments and pairs, packed, and its distinct keys with their counts.

    Packed, a row stays small in Java's memory, where rows are held by the task. Pairs are numbered by the batch; ``keys`` are pairs first, then words as firsts and as seconds.
    """
    token, letters, seg, page, ended, chars = _tokens(texts)
    # Segments without a token are none.
    size = np.bincount(seg, minlength=len(page))
    seg, page, ended, chars, size = (np.cumsum(size > 0) - 1)[seg], page[size > 0], ended[size > 0], chars[size > 0], size[size > 0]
    new = np.r_[True, seg[1:] != seg[:-1]][: len(seg)]
    before = np.where(new, START, np.r_[START, token[:-1]][: len(token)])
    weight = letters + np.where(new, 1, np.r_[1, letters[:-1]][: len(letters)])
    pairs, at, code, n = np.unique(mix(before * np.uint64(0x9E3779B97F4A7C15) + token), return_index=True, return_inverse=True, return_counts=True)
    firsts, first, n1 = np.unique(before, return_inverse=True, return_counts=True)
    seconds, second, n2 = np.unique(token, return_inverse=True, return_counts=True)
    in_page = np.unique(page[seg] * len(pairs) + code)
    df = np.bincount(in_page % max(1, len(pairs)), minlength=len(pairs))
    keys = np.r_[pairs, mix(firsts ^ FIRST), mix(seconds ^ SECOND)].view(np.int64)
    packed = _pack([classes, page, ended, chars, size, code, weight[at], first[at] + len(pairs), second[at] + len(pairs) + len(firsts)])
    lists = [(keys, pa.int64()), (np.r_[n, n1, n2], pa.int32()), (np.r_[df, np.zeros(len(firsts) + len(seconds), np.int64)], pa.int32())]
    single = [pa.array([classes[0]], pa.int64()), pa.array([len(classes)], pa.int64()), pa.array([len(code)], pa.int64()), pa.array([packed], pa.binary())]
    return pa.RecordBatch.from_arrays([*single, *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind)) for v, kind in lists]], names=[x.split()[0] for x in BATCH.split(", ")])


def _count(most: int) -> Callable:
    """Batches of pages with at most so many letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, texts, letters = [], [], 0
        for batch in batches:
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and letters + len(t) > most:
                    yield _counted(classes, texts)
                    classes, texts, letters = [], [], 0
                classes.append(c)
                texts.append(t.lower())
                letters += len(t)
        if texts:
            yield _counted(classes, texts)

    return run


def _judge(all_pairs: int, n_pages: int) -> Callable:
    """Scores of the pages of batches: packed, n and df (as in ``BATCH``), and ``known``: code, c and d of what others have too."""

    def scores(row: list) -> tuple[np.ndarray, ...]:
        classes, page, ended, chars, size, code, weight, first, second = _unpack(row[0].as_py())
        c, d = (row[k].values.to_numpy().astype(np.int64) for k in (1, 2))
        if row[3].is_valid:
            known = row[3].values
            at = known.field(0).to_numpy()
            c[at], d[at] = known.field(1).to_numpy(), known.field(2).to_numpy()
        seg = np.repeat(np.arange(len(size)), size)
        own = page[seg].astype(np.int64)
        _, place, here = np.unique(own * (int(code.max(initial=0)) + 1) + code, return_inverse=True, return_counts=True)
        here = here[place]
        length = np.bincount(own, minlength=len(classes))
        others = c[code] - here
        with np.errstate(divide="ignore", invalid="ignore"):
            pmi = np.log(others.astype(float) * all_pairs / (c[first].astype(float) * c[second])[code])
            rate = c / n_pages
            bunching = (c / d / (rate / -np.expm1(-rate)))[code]
        stuffed = (others > 0) & (here >= REPEATS) & ((bunching >= BUNCHING) | (here >= PAGE_SHARE * length[own]))
        value = np.where(others > 0, np.clip(pmi, LOW, HIGH), LOW)
        w = weight[code].astype(float)

        def total(x: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
            return np.bincount(by, weights=x, minlength=n)

        mean = total(w * np.where(stuffed, LOW, value), seg, len(size)) / total(w, seg, len(size))
        spam = mean < np.where(ended, SENTENCE_MEAN, OTHER_MEAN)
        m = len(classes)
        whole = total(w, own, m)
        with np.errstate(invalid="ignore"):
            return classes, total(w * value, own, m) / whole, total(w * stuffed, own, m) / whole, total(chars * spam, page, m) / total(chars, page, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = scores([column[k] for column in batch.columns])
                some = np.isfinite(found[1])  # pages without a token have no scores
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in found], names=["class", "mean_pmi", "stuffed_share", "spam_share"])

    return run


def page_scores(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, mean_pmi, stuffed_share, spam_share: one row per document with any token.

    ``mean_pmi`` weighs pairs by their characters, each between ``LOW`` and ``HIGH``. Null and
    empty texts, and null ids, have no row; a repeated id counts once. In a collection of one text no pair is
    known from elsewhere, so its pages are all spam by this measure: it needs a collection. Other columns are not read.
    """
    named = docs.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("class"))
    pages = stage(named.select("class", "text").dropDuplicates(["class"]).mapInArrow(_count(BATCH_LETTERS), BATCH), "pages", group_rows=1)
    size = pages.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_classes"), F.lit(0))).first()
    rows = pages.select("batch", F.posexplode(F.arrays_zip("keys", "n", "df")).alias("code", "x")).select("batch", "code", "x.keys", "x.n", "x.df")
    # A key has one row for each batch at most, so that none is more than any other's share of a task.
    w = Window.partitionBy("keys")
    summed = rows.select("batch", "code", F.sum("n").over(w).alias("c"), F.sum("df").over(w).alias("d"), F.count("*").over(w).alias("_batches"))
    back = summed.where("_batches > 1").groupBy("batch").agg(F.collect_list(F.struct("code", "c", "d")).alias("known"))  # at most a batch's keys
    scores = pages.select("batch", "packed", "n", "df").join(back, "batch", "left").drop("batch").mapInArrow(_judge(*size), "class long, mean_pmi double, stuffed_share double, spam_share double")
    return named.select("doc_id", "class").distinct().join(scores, "class").drop("class")


def spam_pages(scores: DataFrame) -> DataFrame:
    """doc_id of the pages with more than half of their characters in spam segments."""
    return scores.where("spam_share > 0.5").select("doc_id")
