"""Document quality from a linear-chain conditional random field over lines (operator 3).

Every line with a word is labelled good or bad. A line's features are its own statistics and those of the lines before
and after it; the chain's transitions tie neighbours together. Weights are fitted on a bounded sample of labelled
documents (``SAMPLE`` documents by the hash of the id, of at most ``SAMPLE_LINES`` lines each), every line taking its
document's label. Forward-backward gives each line's marginal; their mean, weighted by the length of the lines, is the
document's score. Lines of many documents advance together, one step a line position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import textgrid as tg
from cohortlens.llm.boosting import _DIGIT, _MARK, _SYMBOL, _UPPER, lines_with_words

SAMPLE, SAMPLE_LINES, STEPS, RATE, L2, PREDICT_AT = 4_000, 500, 150, 0.1, 1e-3, 0.7
WIDTH = 11


def line_features(block: tg.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, length in bytes and statistics of every line that has a word."""
    w = tg.words(block)
    doc, start, end, new = lines_with_words(block, w)
    if not len(doc):
        return doc, doc, np.zeros((0, WIDTH))
    data, n = block.data, len(block.data)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[end] - total[start]

    length = end - start
    filled = np.maximum(share(~tg.SPACE[data]), 1)
    n_words = np.diff(np.append(new, len(w.start)))
    line_of = np.repeat(np.arange(len(doc)), n_words)
    single = (w.end - w.start == 1) & _MARK[data[w.start]]
    key = tg.mix(w.hash + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    repeated = np.bincount(line_of[order[same]], minlength=len(doc)) / n_words
    lhash = tg.span_hash(data, start, end)
    lkey = tg.mix(lhash + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, back, count = np.unique(lkey, return_inverse=True, return_counts=True)
    x = np.column_stack([np.log1p(n_words), np.minimum(filled / n_words, 30), repeated, count[back] > 1,
                         share(_SYMBOL[data]) / filled, share(_UPPER[data]) / filled, share(_DIGIT[data]) / filled, share(_MARK[data]) / filled,
                         np.bincount(line_of, single, len(doc)) / n_words, share(data > 127) / filled, share(data == 33) / filled])
    return doc, length, x.astype(float)


def chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of every document that has lines."""
    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, dtype=np.int64)
    return at, np.diff(np.append(at, len(doc)))


def neighbours(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A line's features beside those of the lines before and after it in its document (zeros at the ends) and a one."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[at] = 0
    after[at[1:] - 1] = 0
    return np.column_stack([x, before, after, np.ones(len(x))])


def _log_sum(a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[:, 0], a[:, 1])


def forward_backward(emit: np.ndarray, pairs: np.ndarray, at: np.ndarray, size: np.ndarray, edges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of both labels for every line, and (if asked) the expected number of each transition."""
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    fwd, bwd = emit.copy(), np.zeros_like(emit)
    longest = int(size[0]) if len(size) else 0
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest + 1)]  # chains of more than t lines
    for t in range(1, longest):
        i = at[:alive[t]] + t
        for y in (0, 1):
            fwd[i, y] = emit[i, y] + _log_sum(fwd[i - 1] + pairs[:, y])
    for t in range(longest - 1, 0, -1):
        i = at[:alive[t]] + t
        for y in (0, 1):
            bwd[i - 1, y] = _log_sum(bwd[i] + emit[i] + pairs[y])
    both = fwd + bwd
    total = _log_sum(both)[:, None]
    expected = np.zeros((2, 2))
    if edges:
        inner = np.ones(len(emit), dtype=bool)
        inner[at] = False
        i = np.flatnonzero(inner)
        for y in (0, 1):
            for z in (0, 1):
                expected[y, z] = np.exp(fwd[i - 1, y] + pairs[y, z] + emit[i, z] + bwd[i, z] - total[i, 0]).sum()
    return np.exp(both - total), expected


@dataclass
class Chain:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray

    def good(self, x: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        f = neighbours(np.clip((x - self.mean) / self.spread, -6, 6), at)
        return forward_backward(f @ self.weights, self.pairs, at, size)[0][:, 1]


def fit(x: np.ndarray, y: np.ndarray, doc: np.ndarray, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> Chain:
    """Maximum likelihood with weight decay, by Adam. ``y``: label of every line."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    at, size = chains(doc)
    f = neighbours(np.clip((x - mean) / spread, -6, 6), at)
    truth = np.column_stack([1 - y, y]).astype(float)
    inner = np.ones(len(x), dtype=bool)
    inner[at] = False
    i = np.flatnonzero(inner)
    seen = np.array([[((y[i - 1] == a) & (y[i] == b)).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    theta = np.zeros(f.shape[1] * 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, pairs = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        marginal, expected = forward_backward(f @ weights, pairs, at, size, edges=True)
        grad = np.concatenate([(f.T @ (truth - marginal)).ravel(), (seen - expected).ravel()]) / len(x) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Chain(mean, spread, theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def _sample_lines(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tg.blocks(batch.column(2)):
            doc, _, x = line_features(block)
            of = doc + block.lo
            keep = np.bincount(of, minlength=batch.num_rows)[of] <= limit
            x, of = x[keep], of[keep]
            yield pa.record_batch([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)),
                                   pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))],
                                  names=["doc_id", "quality", "x"])


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: int = SAMPLE_LINES) -> Chain | None:
    """The chain fitted on labelled documents that are not held out; None without lines of both labels."""
    picked = (labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null").where(~held_out())
              .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    kind = dict(docs.dtypes)["doc_id"]
    rows = (docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id").select("doc_id", "quality", "text")
            .mapInArrow(lambda it: _sample_lines(it, limit), f"doc_id {kind}, quality int, x array<double>").toPandas())
    if not len(rows) or rows["quality"].nunique() < 2:
        return None
    change = np.flatnonzero(np.concatenate(([True], rows["doc_id"].to_numpy()[1:] != rows["doc_id"].to_numpy()[:-1])))
    doc = np.repeat(np.arange(len(change)), np.diff(np.append(change, len(rows))))
    return fit(np.stack(rows["x"].to_numpy()), rows["quality"].to_numpy(), doc)


def quality_scores(docs: DataFrame, labels: DataFrame, predict_at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null, empty and word-free texts have no line and score 0. Repeated rows stay repeated. Where no chain can be fitted
    (no labels, or of one kind) every text with a word scores 1: nothing is known against it. An empty table gives none.
    """
    chain = train(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tg.blocks(batch.column(1)):
                n = block.hi - block.lo
                score = np.zeros(n)
                doc, length, x = line_features(block)
                at, size = chains(doc)
                if len(doc):
                    good = chain.good(x, at, size) if chain is not None else np.ones(len(x))
                    score = np.bincount(doc, good * length, n) / np.maximum(np.bincount(doc, length, n), 1)
                yield pa.record_batch([batch.column(0).slice(block.lo, n), pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= predict_at).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; a document is judged by id, all its rows together."""
    bad = quality_scores(docs, labels).where("predicted = 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
