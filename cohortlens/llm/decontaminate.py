"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment (operator 9).

Seeds are all word n-grams of the test items: which of them an edited copy keeps is not known beforehand, and how many
documents have one says nothing about it. One pass over the corpus finds where they occur. The stretch of the document
around a single one of them, wide enough for any alignment that scores, is aligned with the item word by word, many
stretches at once; seeds on near diagonals share a stretch. The score is the alignment's share of the best possible one,
so edited, paraphrased and partly dropped copies score below 1 but above chance. A copy that keeps no ``GRAM`` words in a
row has no seed.

The items are held by the tasks: they are taken in blocks of about ``ITEM_BLOCK`` words, a pass each, so what a task holds
has a fixed bound whatever the size of the benchmark, and neither occurrences nor texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import textgrid as tg
from cohortlens.session import materialise

GRAM, ITEM_BLOCK, MIN_SHARE, MATCH, MISMATCH, GAP = 3, 1 << 20, 0.5, 2, -1, -1
PAIRS, CELLS = 1 << 18, 1 << 20
_FILTER = 20
_STRIP = np.zeros(256, dtype=bool)
_STRIP[[*b".,;:!?\"'()[]"]] = True


def bare_words(block: tg.Block) -> tg.Words:
    """Words in lower case without punctuation at their ends (a word of nothing else keeps it)."""
    w = tg.words(block, lower=True)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        drop = _STRIP[block.data[end - 1]] & (end - start > 1) if len(start) else np.zeros(0, dtype=bool)
        end[drop] -= 1
        drop = _STRIP[block.data[start]] & (end - start > 1) if len(start) else drop
        start[drop] += 1
    return tg.Words(start, end, w.doc, tg.span_hash(block.data, start, end, lower=True), w.first)


def grams(w: tg.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every n-gram that lies in one text."""
    h = tg.shingle_hash(w.hash, k)
    at = np.flatnonzero(w.doc[:len(h)] == w.doc[k - 1:]) if len(h) else np.zeros(0, dtype=np.int64)
    return h[at], at


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [tg.signed(h) for h in _hashes(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])


@dataclass
class Held:
    """A block of items as the tasks hold it: ``word[first[i]:first[i + 1]]`` are the words of item i, ``gram`` the sorted
    n-grams of all items, with the item of each and its place there. ``sizes``: the lengths of the n-grams."""

    ids: pa.Array
    word: np.ndarray
    first: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    there: np.ndarray
    sizes: list[int]


def _hold(ids: pa.Array, words: list[np.ndarray], k: int) -> Held:
    size = np.array([len(h) for h in words])
    first = np.append(0, np.cumsum(size))
    word = np.concatenate(words).view(np.uint64)
    owner = np.repeat(np.arange(len(size)), size)
    w = tg.Words(first[:0], first[:0], owner, word, first)
    found = []
    for n in np.unique(np.minimum(size, k)).tolist():
        h, at = grams(w, n)
        mine = (size[owner[at]] == n) | (n == k)
        found.append((h[mine], at[mine]))
    gram, at = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(gram)
    item = owner[at[order]]
    return Held(ids, word, first, gram[order], item.astype(np.int32), (at[order] - first[item]).astype(np.int32), np.unique(np.minimum(size, k)).tolist())


def _met(w: tg.Words, held: Held, table: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, item, and smallest and largest shift of the item's n-grams that occur in the text, for every strip of shifts as
    wide as the item. At most about ``PAIRS`` occurrences at a time."""
    for n in held.sizes:
        h, at = grams(w, n)
        maybe = np.flatnonzero(table[(h >> np.uint64(64 - _FILTER)).astype(np.int64)])
        h, at = h[maybe], at[maybe]
        lo, hi = np.searchsorted(held.gram, h), np.searchsorted(held.gram, h, side="right")
        hit = np.flatnonzero(hi > lo)
        lo, at, count = lo[hit], at[hit], (hi - lo)[hit]
        part = np.cumsum(count) // PAIRS
        for g in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
            if not len(g):
                continue
            c = count[g]
            seed = np.repeat(lo[g] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            doc, item = np.repeat(w.doc[at[g]], c), held.item[seed]
            shift = np.repeat(at[g] - w.first[w.doc[at[g]]], c) - held.there[seed]
            strip = shift // (held.first[item + 1] - held.first[item])
            order = np.lexsort((shift, strip, item, doc))
            doc, item, shift, strip = doc[order], item[order], shift[order], strip[order]
            new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (strip[1:] != strip[:-1]))
            yield doc[new], item[new], shift[new], shift[np.append(np.flatnonzero(new)[1:] - 1, len(shift) - 1)]


def _leaks(batches: Iterator[pa.RecordBatch], held: Held, min_share: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, item_id, score, end_word) of every stretch around n-grams of an item that scores at least ``min_share``."""
    table = np.zeros(1 << _FILTER, dtype=bool)
    table[(held.gram >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for block in tg.blocks(batch.column(1), tg.BLOCK // 2):
            w = bare_words(block)
            for doc, item, low, high in _met(w, held, table):
                size = held.first[item + 1] - held.first[item]
                # an alignment of that score leaves out or passes over no more words than this
                reach = np.ceil(MATCH * (1 - min_share) * size).astype(np.int64)
                begin = w.first[doc] + np.maximum(0, low - reach)
                end = np.minimum(w.first[doc + 1], w.first[doc] + high + size + reach)
                score, last = _scores(held, w, item, begin, end)
                share = score / (MATCH * size)
                good = np.flatnonzero(share >= min_share)
                if len(good):
                    yield pa.record_batch([pa.array(ids[block.lo + doc[good]].astype(np.int64)), held.ids.take(pa.array(item[good])), pa.array(share[good]),
                                           pa.array((begin - w.first[doc] + last)[good].astype(np.int32))],
                                          names=["doc_id", "item_id", "score", "end_word"])


def _scores(held: Held, w: tg.Words, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores, ends = np.zeros(len(item)), np.zeros(len(item), dtype=np.int64)
    order = np.lexsort((end - begin, held.first[item + 1] - held.first[item]))
    lo = 0
    while lo < len(order):
        some = order[lo:lo + 256]
        some = some[:max(1, CELLS // int((end - begin)[some].max()))]
        scores[some], ends[some] = align([held.word[held.first[i]:held.first[i + 1]] for i in item[some].tolist()],
                                         [w.hash[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
        lo += len(some)
    return scores, ends


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of word sequences, pair by pair, and the end of each best alignment in its passage."""
    n, rows, cols = len(items), max(map(len, items)), max(map(len, passages))
    x, y = np.zeros((n, rows), dtype=np.uint64), np.ones((n, cols), dtype=np.uint64)
    for i, (a, b) in enumerate(zip(items, passages, strict=True)):
        x[i, :len(a)], y[i, :len(b)] = a | np.uint64(2), b | np.uint64(2)
    slope = -GAP * np.arange(1, cols + 1)
    above = np.zeros((n, cols + 1))
    best, end = np.zeros(n), np.zeros(n, dtype=int)
    for r in range(rows):
        score = np.where(x[:, r:r + 1] == y, MATCH, MISMATCH)
        now = np.maximum(np.maximum(above[:, :-1] + score, above[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the passage
        top = now.max(axis=1)
        end = np.where(top > best, now.argmax(axis=1) + 1, end)
        best = np.maximum(best, top)
        above[:, 1:] = now
    return best, end


def _hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    for block in tg.blocks(texts):
        w = bare_words(block)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield w.hash[a:b]


def contaminated(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE, k: int = GRAM) -> DataFrame:
    """(doc_id, item_id, score, end_word): documents that hold a copy of an item, their best score and the word after it.

    Null and empty texts and items match nothing. Items under k words are one seed as a whole. Repeated rows of a document
    or an item count once. Two equal items are both reported. No item, no document or no match: an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where("doc_id is not null and text is not null")
    kind = dict(items.dtypes)["item_id"]
    tests = (items.select("item_id", F.lower("text").alias("item")).where("item_id is not null and item is not null")
             .dropDuplicates(["item_id"]))
    words = materialise(tests.mapInArrow(_item_words, f"item_id {kind}, words array<long>").where("size(words) > 0"), "items")
    blocks = -(-(words.agg(F.sum(F.size("words"))).first()[0] or 0) // ITEM_BLOCK)
    out = f"doc_id long, item_id {kind}, score double, end_word int"
    found = None
    for part in range(blocks):
        rows = words.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == part).toArrow()
        if not len(rows):
            continue
        held = spark.sparkContext.broadcast(_hold(rows["item_id"].combine_chunks(), [h.values.to_numpy() for h in rows["words"]], k))
        some = src.mapInArrow(lambda it, held=held: _leaks(it, held.value, min_share), out)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], out)
    return (found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", F.col("end_word"))).alias("b"))
            .select("doc_id", "item_id", "b.score", "b.end_word"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a copy of a test item."""
    found = materialise(contaminated(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
