"""Repeated passages by windows at content-defined places (operator 10).

Passages repeat inside lines as well as between them, so what collides is a window of ``WINDOW`` words that begins where
the text itself says: at a position whose hash is the smallest of ``SPREAD`` positions in a row. The same words get the
same windows in any document, and every run of WINDOW + SPREAD - 1 = 24 equal words holds a whole window.

That is enough for passages with edits: of two passages of at least 50 words with a Jaccard similarity of 0.8 on their
5-word shingles, 24 words in a row are equal. (Were all equal runs of at most 23 words, at most 19 shingles each would be
common, and each of g places with edits costs 4 on either side at least: 19 (g + 1) >= 32 g leaves g = 1, and then the
50 words need an edit of 4 words or more, which costs 12 shingles where 38 common ones allow 9.) So equal windows find
what MinHash bands of single windows miss: an edit inside a window changes little in the passage and much in the window.

Equal texts are folded first: a later copy is one passage, its whole text. The occurrences of a window are a group; its
smallest (document, position) is compared with each of the others: the match is grown word by word over edits of up to
``EDIT`` words that 5 equal words follow, and the longest stretch of it that holds the window, has at least ``min_words``
words and a Jaccard similarity of at least ``threshold`` is a repeated passage.

A first that shares only a shorter phrase hides nothing: windows that are in no passage with it are grouped anew by more of
their surroundings. A passage of 50 words that covers a window of 16 goes on for 17 words to its left or to its right, so
windows that share neither drop out; of the rest every run of 50 words that covers the window is a key, and equal keys are
passages. Two such steps suffice whatever the size of a group. Windows of one document with the same surroundings (a phrase
said over and over) are one row with a list of places.

Texts are joined once for each document; what is sent on for a pair of documents is the words around its windows
(``CONTEXT`` on either side), not the text.
A passage's earlier occurrence stays and the later one is a removal; documents that share passages, directly or through
others, are one cluster (connected components).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import textgrid as tg
from cohortlens.operators.graph import components
from cohortlens.session import materialise

WINDOW, SPREAD, SHINGLE, MIN_WORDS, THRESHOLD, EDIT = 16, 9, 5, 50, 0.8, 8
CONTEXT = 64
_U = np.uint64


def anchors(h: np.ndarray, first: int, end: int, window: int, spread: int) -> np.ndarray:
    """Positions whose hash is the smallest of some ``spread`` positions in a row; ties go to the last."""
    n = end - first - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    x = h[first:first + n]
    if n <= spread:
        return np.array([n - 1 - int(np.argmin(x[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(x[::-1], spread)
    return np.unique(n - 1 - (np.argmin(view, axis=1) + np.arange(len(view))))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for block in tg.blocks(batch.column(1), tg.BLOCK // 4):
            w = tg.words(block, lower=True)
            order = tg.mix(w.hash[:-1] + (w.hash[1:] << _U(1))) if len(w.hash) > 1 else w.hash[:0]
            starts, owners = [], []
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                if b - a >= WINDOW:
                    p = anchors(order, a, b, WINDOW, SPREAD)
                    starts.append(p + a)
                    owners.append(np.full(len(p), i))
            if not starts:
                continue
            at, of = np.concatenate(starts), np.concatenate(owners)
            yield pa.record_batch([pa.array(tg.signed(_run_hash(w.hash, at, WINDOW))), pa.array(ids[block.lo + of].astype(np.int64)),
                                   pa.array((at - w.first[of]).astype(np.int32))], names=["key", "id", "start"])


def _hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    for block in tg.blocks(texts):
        w = tg.words(block, lower=True)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield w.hash[a:b]


def grow(x: np.ndarray, y: np.ndarray, i: int, j: int, sx: np.ndarray, sy: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of equal words going right from word i of x and j of y: (where it begins after i, after j, words). Up to
    ``EDIT`` other words of each (changed, added or dropped) are passed if ``SHINGLE`` equal words follow; ``sx`` and ``sy`` are
    the shingles of x and y."""
    i0, j0, out = i, j, []
    while True:
        step, size = 0, 32
        while True:  # the first difference, without looking at the whole text
            n = min(size, len(x) - i - step, len(y) - j - step)
            differ = np.flatnonzero(x[i + step:i + step + n] != y[j + step:j + step + n])
            if len(differ) or n < size:
                step += int(differ[0]) if len(differ) else n
                break
            step, size = step + n, size * 2
        out.append((i - i0, j - j0, step))
        i, j = i + step, j + step
        a, b = np.nonzero(sx[i:i + EDIT + 1, None] == sy[None, j:j + EDIT + 1])
        if not len(a):
            return out
        best = int(np.argmin(a + b))
        i, j = i + int(a[best]), j + int(b[best])


def stretch(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], threshold: float, min_words: int) -> tuple[int, int, int, int] | None:
    """Words of x and of y to the left and to the right that belong to the passage: (left in x, in y, right in x, in y).

    The longest stretch of runs around the window with Jaccard similarity ``threshold`` on its shingles, counted along the
    alignment. None if it is under ``min_words``. ``left`` is counted to the left."""
    if len(left) == 1 and len(right) == 1:
        a, b = left[0][2], right[0][2]
        return (a, a, b, b) if a + b >= min_words else None
    lx, ly, ln = (np.array(c) for c in zip(*left, strict=True))
    rx, ry, rn = (np.array(c) for c in zip(*right, strict=True))
    nx, ny = (lx + ln)[:, None] + (rx + rn)[None, :], (ly + ln)[:, None] + (ry + rn)[None, :]
    more_l, more_r = np.append(0, np.cumsum(ln[1:] - SHINGLE + 1)), np.append(0, np.cumsum(rn[1:] - SHINGLE + 1))
    common = ln[0] + rn[0] - SHINGLE + 1 + more_l[:, None] + more_r[None, :]
    union = nx + ny - 2 * (SHINGLE - 1) - common
    words = np.where(common >= threshold * union, nx, 0)
    a, b = np.unravel_index(int(np.argmax(words)), words.shape)
    if words[a, b] < min_words:
        return None
    return int(lx[a] + ln[a]), int(ly[a] + ln[a]), int(rx[b] + rn[b]), int(ry[b] + rn[b])


def _run_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from every position of ``at``."""
    power = tg.mix(np.arange(1, n + 1, dtype=np.uint64)) | _U(1)
    return tg.mix((h[at[:, None] + np.arange(n)] * power).sum(axis=1, dtype=np.uint64))


def _lists(column: pa.Array, *fields: str) -> tuple:
    """Bounds of the lists of a column and the fields of their structs (none named: the values), as numpy arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values
    parts = [values.field(f) for f in fields] if fields else [values]
    return column.offsets.to_numpy(), *(x.to_numpy(zero_copy_only=False) for x in parts)


def _trim(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[pa.RecordBatch]:
    """A row for every document and origin: the windows, and the parts of the text around them."""
    names = ["id", "origin", "starts", "ostarts", "begins", "parts"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
    for batch in batches:
        ids = batch.column("id").to_pylist()
        bound, origin, start, ostart = _lists(batch.column("at"), "origin", "start", "ostart")
        for block in tg.blocks(batch.column("text")):
            w = tg.words(block)
            out: list[tuple] = []
            for i in range(block.lo, block.hi):
                base, n = int(w.first[i - block.lo]), int(w.first[i - block.lo + 1] - w.first[i - block.lo])
                lo, hi = int(bound[i]), int(bound[i + 1])
                if start[lo:hi].max() + WINDOW > n:
                    continue  # another text of a repeated id
                order = lo + np.lexsort((start[lo:hi], origin[lo:hi]))
                for g in np.split(order, np.flatnonzero(np.diff(origin[order])) + 1):
                    s = start[g]
                    begin, end = np.maximum(s - context, 0), np.minimum(s + WINDOW + context, n)
                    new = np.flatnonzero(begin[1:] > end[:-1])
                    begin, end = begin[np.append(0, new + 1)], end[np.append(new, len(s) - 1)]
                    parts = [block.data[w.start[base + a]:w.end[base + z - 1]].tobytes().decode() for a, z in zip(begin, end, strict=True)]
                    out.append((ids[i], int(origin[g[0]]), s, ostart[g], begin, parts))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _by_sides(key: np.ndarray, ident: np.ndarray, start: np.ndarray, missed: np.ndarray) -> tuple:
    """A row for every key of a document: (key, id, starts, missed), ``missed`` if any of its windows is."""
    order = np.lexsort((start, key, ident))
    key, ident, start, missed = key[order], ident[order], start[order], missed[order]
    first = np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (ident[1:] != ident[:-1])) + 1)
    starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(start.astype(np.int32)))
    return key[first], ident[first], starts, np.logical_or.reduceat(missed, first)


def _passages(batches: Iterator[pa.RecordBatch], threshold: float, min_words: int, sides: bool) -> Iterator[pa.RecordBatch]:
    """Rows with words > 0: the repeated passages of a document and an origin. Rows with words = 0 (if ``sides``): the windows of
    a document by a key of their surroundings, ``missed`` if one of them is in none of the passages."""
    inside = np.arange(WINDOW)
    half = max(0, min_words - WINDOW) // 2 if sides else 0
    kinds = {"key": pa.int64(), "id": pa.int64(), "start": pa.int32(), "words": pa.int32(), "origin": pa.int64(), "origin_start": pa.int32(),
             "starts": pa.list_(pa.int32()), "missed": pa.bool_()}
    last: tuple = (None,)
    for batch in batches:
        out: list[tuple] = []
        around: list[tuple] = []
        bound, starts = _lists(batch.column("starts"))
        _, ostarts = _lists(batch.column("ostarts"))
        pbound, begins = _lists(batch.column("begins"))
        parts = list(_hashes(batch.column("parts").values))
        ty = batch.column("ty")
        for row, (ident, origin) in enumerate(zip(batch.column("id").to_pylist(), batch.column("origin").to_pylist(), strict=True)):
            text = ty[row].as_py()
            if last[0] != text:
                y = next(_hashes(pa.array([text])))
                last = (text, y, y[::-1], tg.shingle_hash(y, SHINGLE), tg.shingle_hash(y[::-1], SHINGLE))
            _, y, yback, sy, syb = last
            st, os = starts[bound[row]:bound[row + 1]], ostarts[bound[row]:bound[row + 1]]
            if os.max() + WINDOW > len(y):
                continue  # another text of a repeated id
            first = begins[pbound[row]:pbound[row + 1]]
            part = np.searchsorted(first, st, side="right") - 1
            for j in range(len(first)):
                x, off = parts[pbound[row] + j], int(first[j])
                mine = part == j
                s, o = st[mine] - off, os[mine]
                covered = np.zeros(len(s), dtype=bool)
                equal = (x[s[:, None] + inside] == y[o[:, None] + inside]).all(axis=1)
                back, sx, sxb = x[::-1], tg.shingle_hash(x, SHINGLE), tg.shingle_hash(x[::-1], SHINGLE)
                # other windows of the earliest document are only there to be found by their surroundings
                for i in np.flatnonzero(equal).tolist() if ident != origin else []:
                    if covered[i]:
                        continue
                    a, b = int(s[i]), int(o[i])
                    span = stretch(grow(back, yback, len(x) - a, len(y) - b, sxb, syb), grow(x, y, a, b, sx, sy), threshold, min_words)
                    if span:
                        left, oleft, right, _ = span
                        out.append((0, ident, off + a - left, left + right, origin, b - oleft, None, False))
                        covered |= (s >= a - left) & (s + WINDOW <= a + right)
                if half:
                    for l in (0, half):
                        ok = (s >= l) & (s - l + WINDOW + half <= len(x))
                        if ok.any():
                            around.append((_run_hash(x, s[ok] - l, WINDOW + half), np.full(int(ok.sum()), ident), off + s[ok], ~covered[ok] & (ident != origin)))
        if out:
            yield pa.record_batch([pa.array(c, kind) for kind, c in zip(kinds.values(), zip(*out, strict=True), strict=True)], names=list(kinds))
        if around:
            key, ident, starts, missed = _by_sides(*(np.concatenate(c) for c in zip(*around, strict=True)))
            none = pa.array(np.zeros(len(key), dtype=np.int32))
            yield pa.record_batch([pa.array(tg.signed(key)), pa.array(ident.astype(np.int64)), none, none, none.cast(pa.int64()), none,
                                   starts, pa.array(missed)], names=list(kinds))


def _runs(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Every run of ``min_words`` words that covers one of the given windows of its document."""
    back = np.arange(min_words - WINDOW + 1)
    for batch in batches:
        ids = batch.column("id").to_pylist()
        bound, start = _lists(batch.column("starts"))
        for i, h in enumerate(_hashes(batch.column("text"))):
            at = np.unique((start[bound[i]:bound[i + 1], None] - back).ravel())
            at = at[(at >= 0) & (at + min_words <= len(h))]
            if len(at):
                yield pa.record_batch([pa.array(tg.signed(_run_hash(h, at, min_words))), pa.array(np.full(len(at), ids[i], dtype=np.int64)),
                                       pa.array(at.astype(np.int32))], names=["key", "id", "start"])


def _stars(groups: DataFrame) -> DataFrame:
    """(id, origin, start, ostart): every window of a key with the first window of the earliest document that has the key.
    The other windows of that document are there too, with the document as its own origin.
    Minima are combined before the shuffle and written, so a hot key is a join that can be split."""
    repeated = materialise(groups.groupBy("key").agg(F.min("id").alias("origin"), F.max("id").alias("last"))
                           .where("origin < last").select("key", "origin"), "repeated")
    rows = materialise(groups.join(repeated, "key"), "alike")
    lead = materialise(rows.where("id = origin").groupBy("key").agg(F.min("start").alias("ostart")), "leaders")
    return rows.join(lead, "key").where("id > origin or start > ostart").select("id", "origin", "start", "ostart")


def _compared(stars: DataFrame, texts: DataFrame, threshold: float, min_words: int, sides: bool) -> DataFrame:
    """The rows of ``_passages`` for all windows and their firsts; one row of windows and one text for each document."""
    seeds = stars.groupBy("id").agg(F.collect_set(F.struct("origin", "start", "ostart")).alias("at"))
    near = (seeds.join(texts, "id").select("id", "at", "text")
            .mapInArrow(lambda it: _trim(it, CONTEXT), "id long, origin long, starts array<int>, ostarts array<int>, begins array<int>, parts array<string>"))
    return materialise(near.join(texts.select(F.col("id").alias("origin"), F.col("text").alias("ty")), "origin")
                       .select("id", "origin", "starts", "ostarts", "begins", "parts", "ty")
                       .mapInArrow(lambda it: _passages(it, threshold, min_words, sides),
                                   "key long, id long, start int, words int, origin long, origin_start int, starts array<int>, missed boolean"), "passages")


def _copies(rows: DataFrame, copies: DataFrame, min_words: int) -> DataFrame:
    """Later copies of a whole text, as passages. Words are counted once for each text."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(h) for h in _hashes(batch.column("text"))]
            yield pa.record_batch([batch.column("same"), batch.column("id"), pa.array(n, pa.int32())], names=["same", "origin", "words"])

    again = copies.where("id < last").select("same", "id")
    first = (rows.join(again, ["same", "id"], "left_semi").select("same", "id", "text")
             .mapInArrow(counted, "same string, origin long, words int").where(F.col("words") >= min_words).distinct())
    return (rows.select("id", "same").distinct().join(materialise(first, "copied"), "same").where("id > origin")
            .select("id", F.lit(0).alias("start"), "words", "origin", F.lit(0).alias("origin_start")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                      min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, words, origin, origin_start, cluster): every later occurrence of a passage, in words of the
    whole text, where its earlier one stands, and the smallest doc_id that shares passages with it.

    Texts under ``WINDOW`` words, null texts and ids, and an empty table give none. Repeated rows of one id count as one
    document (with different texts: as any of them); what repeats only inside one document is not reported.
    """
    src = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
           .withColumn("same", F.md5("text")))
    copies = materialise(src.groupBy("same").agg(F.min("id").alias("id"), F.max("id").alias("last")), "copies")
    firsts = src.join(copies.select("id", "same"), ["id", "same"], "left_semi").select("id", "text")
    groups = materialise(firsts.mapInArrow(_windows, "key long, id long, start int"), "windows")
    stars = materialise(_stars(groups), "stars")
    wanted = stars.select(F.explode(F.array("id", "origin")).alias("id")).distinct()
    texts = materialise(firsts.join(wanted, "id", "left_semi"), "texts")
    seen = _compared(stars, texts, threshold, min_words, True)
    found = seen.where("words > 0").select("id", "start", "words", "origin", "origin_start")

    windows = seen.where("words = 0")
    unclear = materialise(windows.groupBy("key").agg(F.max("missed").alias("missed"), F.min("id").alias("a"), F.max("id").alias("z"))
                          .where("missed and a < z").select("key"), "unclear")
    if not unclear.isEmpty():
        open_ = windows.join(unclear, "key", "left_semi").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
        runs = materialise(open_.join(texts, "id").select("id", "starts", "text").mapInArrow(lambda it: _runs(it, min_words), "key long, id long, start int"), "runs")
        more = _compared(_stars(runs).where("id > origin"), texts, threshold, min_words, False)
        found = found.unionByName(more.where("words > 0").select(*found.columns))
    found = materialise(found.unionByName(_copies(src, copies, min_words)).distinct(), "found")
    group = components(found.select(F.col("id").alias("src"), F.col("origin").alias("dst")))
    return (found.join(group.withColumnRenamed("node", "id"), "id")
            .select(F.col("id").alias("doc_id"), "start", "words", "origin", "origin_start", F.col("component").alias("cluster")))


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, spans_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        for i, spans in enumerate(batch.column(spans_at).to_pylist()):
            if spans:
                texts[i] = _without(texts[i], [(s["start"], s["words"]) for s in spans])
        arrays = [pa.array(texts, pa.string()) if c == text_at else batch.column(c) for c in range(batch.num_columns) if c != spans_at]
        yield pa.record_batch(arrays, names=[n for c, n in enumerate(batch.schema.names) if c != spans_at])


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    data = text.encode()
    block = next(iter(tg.blocks(pa.array([text]))))
    w = tg.words(block, lower=True)
    out, at = [], 0
    for start, n in sorted(spans):
        lo, hi = int(w.start[start]), int(w.end[start + n - 1])
        if hi > at:
            out.append(data[at:max(at, lo)])
            at = hi
    return b"".join([*out, data[at:]]).decode()


def remove_repeats(docs: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """``docs`` with the later occurrences cut out of ``text``; all columns stay. A text that was nothing but repeats
    becomes empty and its row stays."""
    found = repeated_passages(docs) if passages is None else passages
    spans = materialise(found.groupBy(F.col("doc_id").alias("_repeat_of")).agg(F.collect_set(F.struct("start", "words")).alias("_repeat_spans")), "spans")
    rows = docs.join(spans, F.col("doc_id") == F.col("_repeat_of"), "left").select(*docs.columns, "_repeat_spans")
    at, last = docs.columns.index("text"), len(docs.columns)
    cut = rows.where("_repeat_spans is not null and text is not null").mapInArrow(lambda it: _cut(it, at, last), docs.schema)
    return rows.where("_repeat_spans is null or text is null").select(*docs.columns).unionByName(cut)
