"""Test passages inside training texts, by a distributed positional inverted index.

The index is cut by texts: a segment holds the posting lists of some texts, term by term (the texts and the places in
them). All postings of a text lie in one segment, so that lists are intersected where they are, no posting is
shuffled, and a term of every text is spread over all segments.

Each stretch of a passage is looked up by its rarest term in the whole collection. Its postings, shifted by the
term's place in the passage, are kept where the next rarest term also stands. Only around these are the lists of
all terms intersected, and runs of matching places reported. Passages are sent to the segments in blocks of a counted size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.llm.words import WORD, word_hashes
from crumbtrail.session import stage

#: Words of passages that are sent to the executors at a time (some 30 bytes each), if one passage has no more.
BLOCK_WORDS = 200_000
#: Letters of the texts of one segment, or one longer text.
SEGMENT_LETTERS = 3_000_000
#: Postings that are shifted at a time.
STEP = 1_000_000


def _packed(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
    words, doc = word_hashes(texts)
    pos = np.arange(len(words)) - np.searchsorted(doc, doc)
    order = np.argsort(words.view(np.int64), kind="stable")  # of a term: by text and place
    terms, counts = np.unique(words.view(np.int64)[order], return_counts=True)

    def one(values, kind: pa.DataType) -> pa.ListArray:
        values = pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = [one(ids, kind), one(terms, pa.int64()), one(counts, pa.int32()), one(doc[order], pa.int32()), one(pos[order], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "counts", "docs", "places"])


def _segments(most: int) -> Callable:
    """Segments with at most so many letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, letters, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and letters + len(t) > most:
                    yield _packed(ids, texts, kind)
                    ids, texts, letters = [], [], 0
                ids.append(i)
                texts.append(t.lower())
                letters += len(t)
        if texts:
            yield _packed(ids, texts, kind)

    return run


def build_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per segment: ids, terms (hashed), counts (of each term's postings), docs (places in ids) and places.

    Written to the shared folder. Null and empty texts have no postings. A text under several ids is indexed under each.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return stage(given.mapInArrow(_segments(SEGMENT_LETTERS), f"ids array<{kind}>, terms array<long>, counts array<int>, docs array<int>, places array<int>"), "index", group_rows=1)


def _passage_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, w in enumerate(WORD.findall(t.lower()))]
        words = [r[2] for r in rows]
        columns = [pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array(words, pa.string()), pa.array(word_hashes(words)[0].view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "ppos", "word", "term"])


def passage_terms(items: DataFrame, index: DataFrame, item_id: str, passage: str) -> DataFrame:
    """item_id, ppos, word, term (hashed), df: the words of each passage that the index has, with their number of postings."""
    kind = items.schema[item_id].dataType.simpleString()
    given = items.where(F.col(item_id).isNotNull() & (F.length(passage) > 0)).select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage"))
    long = stage(given.mapInArrow(_passage_words, f"item_id {kind}, ppos int, word string, term long").distinct(), "passage-words")
    known = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    asked = long.select("term").distinct()
    few = asked.limit(BLOCK_WORDS + 1).count() <= BLOCK_WORDS
    counts = known.join(F.broadcast(asked) if few else asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    return stage(long.join(counts, "term").select("item_id", "ppos", "word", "term", "df"), "passage-terms")


@dataclass
class _Block:
    """Rows of ``passage_terms`` in order of item and place: the items, and of each row the item's number, place and term."""

    items: pa.Array
    item: np.ndarray
    ppos: np.ndarray
    term: np.ndarray
    #: Pairs of rows, or (row, number of the term among its item's): what is looked up.
    asked: np.ndarray


def _blocks(terms: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """items, and item number, ppos, term, df by row, block by block; an item lies in one block."""
    n = -(-terms.count() // BLOCK_WORDS)
    for k in range(n):
        part = terms if n == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        table = part.select("item_id", "ppos", "term", "df").toArrow().combine_chunks()  # BLOCK_WORDS rows on average
        if table.num_rows:
            coded = table["item_id"].combine_chunks().dictionary_encode()
            item, ppos = coded.indices.to_numpy().astype(np.int64), table["ppos"].to_numpy().astype(np.int64)
            order = np.lexsort((ppos, item))
            yield coded.dictionary, item[order], ppos[order], table["term"].to_numpy()[order], table["df"].to_numpy()[order]


def _anchors(item: np.ndarray, ppos: np.ndarray, df: np.ndarray, least: int) -> np.ndarray:
    """Of each stretch of ``least`` words in a row: the rows of its rarest word and of the next rarest."""
    if len(item) < least:
        return np.zeros((0, 2), np.int64)
    starts = np.flatnonzero((item[: len(item) - least + 1] == item[least - 1 :]) & (ppos[least - 1 :] - ppos[: len(ppos) - least + 1] == least - 1))
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    window = np.lib.stride_tricks.sliding_window_view(rank, least)[starts]
    two = np.argsort(window, axis=1)[:, : min(2, least)] + starts[:, None]
    return np.unique(two[:, [0, -1]], axis=0)


class _Segment:
    """One row of the index; a posting's key is its term's number, text and place in one."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        terms, counts, docs, places = (batch.column(k)[row].values.to_numpy() for k in range(1, 5))
        self.ids, self.terms, self.counts = batch.column(0)[row].values, terms, counts.astype(np.int64)
        self.docs, self.places = docs.astype(np.int64), places.astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.width = int(self.places.max(initial=0)) + 1
        self.keys = self.key(np.repeat(np.arange(len(terms)), self.counts), self.docs, self.places)

    def key(self, term: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (term * len(self.ids) + doc) * self.width + place

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The terms' numbers here, -1 for those that the segment lacks."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def stands(self, term: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the terms stand in the texts at these places."""
        ok = (term >= 0) & (place >= 0) & (place < self.width)
        key = self.key(term, doc, place)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return ok & (self.keys[at] == key)

    def postings(self, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``term``, posting) of all postings of the terms, some at a time."""
        n = np.where(term >= 0, self.counts[term], 0)
        part = np.cumsum(n) // STEP
        for p in np.unique(part).tolist():
            rows = np.flatnonzero((part == p) & (n > 0))
            of = np.repeat(rows, n[rows])
            yield of, self.starts[term[of]] + np.arange(len(of)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])


def _phrases(segment: _Segment, b: _Block, least: int) -> tuple[np.ndarray, ...]:
    """doc, item, ppos, pos, n_words of the runs in a segment."""
    term = segment.numbers(b.term)
    both = b.asked[(term[b.asked] >= 0).all(axis=1)]
    reach = np.arange(1 - least, least)
    # A text, a shift (at least that of the passage's last word) and a row in one number.
    least_shift, n_rows = -int(b.ppos.max(initial=0)), len(term)
    n_shifts = segment.width - least_shift
    found = [np.zeros(0, np.int64)]
    for of, posting in segment.postings(term[both[:, 0]]):
        first, second = both[of].T
        doc, shift = segment.docs[posting], segment.places[posting] - b.ppos[first]
        ok = segment.stands(term[second], doc, shift + b.ppos[second])
        # The words around in the passage, as far as a stretch can go.
        row = (first[ok][:, None] + reach).ravel()
        doc, shift, first = (np.repeat(x[ok], len(reach)) for x in (doc, shift, first))
        inside = (row >= 0) & (row < len(term))
        doc, shift, first, row = doc[inside], shift[inside], first[inside], row[inside]
        near = (b.item[row] == b.item[first]) & (b.ppos[row] - b.ppos[first] == row - first)
        doc, shift, row = doc[near], shift[near], row[near]
        met = segment.stands(term[row], doc, shift + b.ppos[row])
        found.append(np.unique((doc[met] * n_shifts + shift[met] - least_shift) * n_rows + row[met]))
    shift, row = np.divmod(np.unique(np.concatenate(found)), n_rows)
    doc, shift = np.divmod(shift, n_shifts)
    shift += least_shift
    if not len(row):
        return (row,) * 5
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(shift) != 0) | (np.diff(row) != 1) | (np.diff(b.item[row]) != 0) | (np.diff(b.ppos[row]) != 1)]
    starts = np.flatnonzero(new)
    n = np.diff(np.r_[starts, len(row)])
    starts, n = starts[n >= least], n[n >= least]
    ppos = b.ppos[row[starts]]
    return doc[starts], b.item[row[starts]], ppos, ppos + shift[starts], n


def _close(segment: _Segment, b: _Block, n_terms: int, span: int) -> tuple[np.ndarray, ...]:
    """doc, item, least_span of the texts of a segment where an item's terms are close together."""
    row, k = b.asked.T
    term = segment.numbers(b.term[row])
    parts = [(b.item[row][of] * len(segment.ids) + segment.docs[p], segment.places[p], k[of]) for of, p in segment.postings(term)]
    group, place, k = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(3))
    order = np.lexsort((place, group))
    group, place, k = group[order], place[order], k[order]
    full, low = np.ones(len(group), bool), place.copy()
    for j in range(n_terms):
        # The last place of each term up to here, if it is in the same text.
        last = np.maximum.accumulate(np.where(k == j, np.arange(len(k)), -1))
        full &= (last >= 0) & (group[last] == group)
        low = np.minimum(low, place[last])
    group, width = group[full], (place - low + 1)[full]
    if not len(group):
        return (group,) * 3
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    width, group = np.minimum.reduceat(width, starts), group[starts]
    ok = width <= span
    return group[ok] % len(segment.ids), group[ok] // len(segment.ids), width[ok]


def _ask(index: DataFrame, block: _Block, find: Callable, item_kind: str, numbers: str) -> DataFrame:
    """doc_id, item_id and the named numbers that ``find`` gives in each segment."""
    sent = index.sparkSession.sparkContext.broadcast(block)
    names = ["doc_id", "item_id", *numbers.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment = _Segment(batch, row)
                if len(segment.terms):
                    doc, item, *rest = find(segment, b)
                    yield pa.RecordBatch.from_arrays([segment.ids.take(pa.array(doc)), b.items.take(pa.array(item)), *[pa.array(x.astype(np.int64)) for x in rest]], names=names)

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, " + ", ".join(f"{x} long" for x in names[2:])).distinct()


def _all_blocks(index: DataFrame, terms: DataFrame, asked: Callable, find: Callable, numbers: str) -> DataFrame:
    kind = terms.schema["item_id"].dataType.simpleString()
    out = None
    for items, item, ppos, term, df in _blocks(terms):
        part = _ask(index, _Block(items, item, ppos, term, asked(item, ppos, term, df)), find, kind, numbers)
        out = part if out is None else out.unionByName(part)
    if out is None:
        doc = index.schema["ids"].dataType.elementType.simpleString()
        return index.sparkSession.createDataFrame([], f"doc_id {doc}, item_id {kind}, " + ", ".join(f"{x} long" for x in numbers.split(", ")))
    return out


def phrase_matches(index: DataFrame, terms: DataFrame, least: int) -> DataFrame:
    """doc_id, item_id, ppos, pos, n_words: each longest run of ``least`` or more shared words.

    ``ppos`` and ``pos`` are the places of its first word in the passage and in the document. Every
    such run is found: each stretch of ``least`` passage words is looked up by its rarest term, and
    a stretch with a term that no document has can't occur. Shorter passages match nothing.
    """
    return _all_blocks(index, terms, lambda item, ppos, term, df: _anchors(item, ppos, df, least), lambda s, b: _phrases(s, b, least), "ppos, pos, n_words")


def proximity_matches(index: DataFrame, terms: DataFrame, n_terms: int, span: int) -> DataFrame:
    """doc_id, item_id, least_span: documents with an item's ``n_terms`` rarest terms close together.

    The terms are those with the fewest postings (ties by the word); all must lie within ``span``
    consecutive words, in any order. Items with fewer known terms match nothing.
    """
    once = terms.groupBy("item_id", "word", "term", "df").agg(F.min("ppos").alias("ppos"))
    ranked = once.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "word"))).where(F.col("k") <= n_terms)
    enough = ranked.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") == n_terms).select("item_id")
    chosen = stage(ranked.join(enough, "item_id").select("item_id", "ppos", "word", "term", "df"), "rare-terms")

    def numbered(item: np.ndarray, ppos: np.ndarray, term: np.ndarray, df: np.ndarray) -> np.ndarray:
        rows = np.arange(len(item))
        return np.array([rows, rows - np.searchsorted(item, item)]).T

    return _all_blocks(index, chosen, numbered, lambda s, b: _close(s, b, n_terms, span), "least_span")
