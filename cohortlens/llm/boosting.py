"""Quality rules with gradient-boosted trees over document statistics (operator 4).

Spark computes the statistics of every document in one pass. The trees are fitted on a bounded sample of labelled
documents (``SAMPLE``, chosen by the hash of the id) with logistic loss, quantile bins and monotonic constraints: more
symbols, repeated lines or repeated words never raise a score. All trees are flattened into arrays of nodes, so a batch
of documents walks a tree in as many numpy steps as it is deep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import textgrid as tg
from cohortlens.session import materialise

SAMPLE, TREES, DEPTH, BINS, RATE, LEAST_ROWS, KEEP_AT = 20_000, 40, 4, 64, 0.2, 20, 0.5
# Fixed values of the base rules.
SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 10, 20
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature -> direction in which the score may move with it (0: any).
FEATURES = {"words": 0, "mean_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
            "mark_share": 0, "distinct_share": 0, "line_words": 0}


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _mask(SYMBOLS), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_BEGINS = np.array([b & 0xC0 != 0x80 for b in range(256)])


def per_text(block: tg.Block, flags: np.ndarray) -> np.ndarray:
    """Number of set flags (one a byte) in every text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[block.bounds[1:]] - total[block.bounds[:-1]]


def lines_with_words(block: tg.Block, w: tg.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, byte range and first word of every \\n-separated line that has a word."""
    breaks = np.flatnonzero(block.data == 10)
    at = np.searchsorted(breaks, w.start)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (w.doc[1:] != w.doc[:-1]))))
    doc, at = w.doc[new], at[new]
    ends = np.append(breaks, len(block.data))
    start = np.maximum(block.bounds[doc], np.concatenate(([0], breaks + 1))[at])
    return doc, start, np.minimum(block.bounds[doc + 1], ends[at]), new


def repeats(values: np.ndarray) -> int:
    """Values equal to an earlier one."""
    s = np.sort(values)
    return int((s[1:] == s[:-1]).sum())


def covered(shingles: np.ndarray, k: int) -> int:
    """Words that lie in a k-word window found twice or more."""
    s = np.sort(shingles)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(shingles, twice))
    edge = np.zeros(len(shingles) + k, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(block: tg.Block) -> np.ndarray:
    """One row a text: the base counts and then the features."""
    w = tg.words(block)
    n_words = np.diff(w.first)
    data = block.data
    filled = ~tg.SPACE[data]
    chars = per_text(block, filled & _BEGINS[data])
    symbols, upper, digits, marks = (per_text(block, m[data]) for m in (_SYMBOL, _UPPER, _DIGIT, _MARK))
    bytes_ = per_text(block, filled)
    ldoc, lstart, lend, _ = lines_with_words(block, w)
    lhash, lfirst = tg.span_hash(data, lstart, lend), np.searchsorted(ldoc, np.arange(len(n_words) + 1))
    rolled = tg.shingle_hash(w.hash, 5)
    dup, rep, same = (np.zeros(len(n_words), dtype=np.int64) for _ in range(3))
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a > 5:
            rep[i] = covered(rolled[a:b - 4], 5)
        if b > a:
            same[i] = repeats(w.hash[a:b])
        if lfirst[i + 1] - lfirst[i] > 1:
            dup[i] = repeats(lhash[lfirst[i]:lfirst[i + 1]])
    lines = np.diff(lfirst)
    one, some = np.maximum(n_words, 1), np.maximum(bytes_, 1)
    return np.column_stack([n_words, chars, symbols, dup, rep, np.log1p(n_words), chars / one, symbols / some, dup / np.maximum(lines, 1),
                            rep / one, upper / some, digits / some, marks / some, (n_words - same) / one, n_words / np.maximum(lines, 1)])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tg.blocks(batch.column(1)):
            rows = statistics(block)
            n = len(BASE)
            yield pa.record_batch([batch.column(0).slice(block.lo, block.hi - block.lo), *[pa.array(rows[:, j].astype(np.int64)) for j in range(n)],
                                   *[pa.array(rows[:, n + j]) for j in range(len(FEATURES))]], names=["doc_id", *BASE, *FEATURES])


@dataclass
class Forest:
    """Node arrays of all trees; a leaf points to itself. ``root``: first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
        least: int = LEAST_ROWS, l2: float = 1.0) -> Forest:
    """Boosted trees by second-order gain. A split on a constrained feature must order its two values; both sides then
    keep to their side of the middle, so the whole tree is monotonic in that feature."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)]) + np.arange(width) * bins
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0])
        todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[at][4] = rate * float(np.clip(g / (h + l2), low, high))
            raw[rows] += nodes[at][4]
            if level == depth or len(rows) < 2 * least:
                continue
            flat = binned[rows].ravel()
            size = width * bins
            gs = np.bincount(flat, np.repeat(grad[rows], width), size).reshape(width, bins).cumsum(axis=1)
            hs = np.bincount(flat, np.repeat(hess[rows], width), size).reshape(width, bins).cumsum(axis=1)
            ns = np.bincount(flat, minlength=size).reshape(width, bins).cumsum(axis=1)
            gl, hl, gr, hr = gs, hs, g - gs, h - hs
            vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
            gain = sum(2 * a * v - (b + l2) * v * v for a, b, v in ((gl, hl, vl), (gr, hr, vr)))
            whole = np.clip(g / (h + l2), low, high)
            gain -= 2 * g * whole - (h + l2) * whole * whole
            gain[(ns < least) | (len(rows) - ns < least) | ((vr - vl) * sign[:, None] < 0)] = -np.inf
            best = int(gain.argmax())
            if not gain.ravel()[best] > 1e-6:
                continue
            j, b = divmod(best, bins)
            go = binned[rows, j] - j * bins <= b
            raw[rows] -= nodes[at][4]
            middle = (vl[j, b] + vr[j, b]) / 2
            sides = ((low, middle), (middle, high)) if sign[j] > 0 else ((middle, high), (low, middle)) if sign[j] < 0 else ((low, high),) * 2
            nodes[at][:4] = [j, float(cuts[j][b]), len(nodes), len(nodes) + 1]
            for part, (lo, hi) in zip((rows[go], rows[~go]), sides, strict=True):
                nodes.append([0, np.inf, len(nodes), len(nodes), 0])
                todo.append((len(nodes) - 1, part, level + 1, lo, hi))
    a = np.array(nodes)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), base, depth)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, base counts, base_failed, score, kept) for every row of ``docs``.

    Null text counts as empty; empty texts fail the base rules. Repeated rows stay repeated. Labels with a null quality are
    not learned from; without any label of either kind the trees say yes to every document, so only the base rules decide.
    """
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    columns = ", ".join([f"doc_id {kind}", *[f"{c} long" for c in BASE], *[f"{c} double" for c in FEATURES]])
    stats = materialise(src.mapInArrow(_statistics, columns), "stats")
    picked = (labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    rows = np.array([tuple(r) for r in stats.dropDuplicates(["doc_id"]).join(picked, "doc_id").orderBy("doc_id", "quality")
                     .select(*FEATURES, "quality").collect()], dtype=float)
    forest = fit(rows[:, :-1], rows[:, -1], np.array(list(FEATURES.values()))) if len(rows) and len(np.unique(rows[:, -1])) > 1 else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in FEATURES])
            s = forest.score(x) if forest is not None else np.ones(len(x))
            yield pa.record_batch([batch.column(c) for c in ["doc_id", *BASE]] + [pa.array(s)], names=["doc_id", *BASE, "score"])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = stats.mapInArrow(scored, ", ".join([f"doc_id {kind}", *[f"{c} long" for c in BASE], "score double"]))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= keep_at)).alias("kept"))
