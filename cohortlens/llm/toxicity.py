"""Toxicity by compression distance (operator 13).

A text is cut into windows of whole words. Every window is compressed twice with zstandard, with a dictionary of ordinary
text and with one of toxic text; how many bytes the toxic dictionary saves is the window's distance. A document is
described by its share and number of windows at each of several thresholds, and a logistic calibration fitted on other
labelled documents turns that into a score.

The dictionaries are fitted on a bounded sample of labelled documents: zstandard's trainer makes the ordinary one from
windows of ordinary texts. Toxic texts are mostly ordinary prose, and a dictionary trained on all of it learns that prose;
so the toxic one holds the ordinary one and, after it, the toxic wording: the runs of ``GRAM`` bytes inside words that stand
in toxic texts significantly more often. A word counts once per surroundings, or passages copied from one toxic text to
the next would count as toxic. A window without such a run is not compressed: it has nothing to save.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import textgrid as tg

#: Labelled documents of either kind that are learned from, and bytes of each (more: evenly spaced stretches).
SAMPLE, SAMPLE_BYTES, STRETCH = 2_500, 32_768, 2_048
#: Bytes of a window and of the dictionaries, length of the runs that tell toxic words.
WINDOW, ORDINARY, TOXIC, GRAM, TAIL, PREDICT_AT = 32, 8_192, 4_096, 5, 12, 0.3
#: A run tells a toxic word if it is found in so many surroundings, so many times as often as in ordinary text, so surely.
LEAST_SEEN, LIFT, SIGMA = 4, 4.0, 4.5
#: A level with optimal parsing: lower ones miss words they know in windows this small.
LEVEL = 17
SAVED = (1, 2, 3, 4, 5, 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def windows(block: tg.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of windows: words in a row that begin within the same ``WINDOW`` bytes of their text."""
    w = tg.words(block)
    if not len(w.start):
        return w.doc, w.start, w.end
    part = (w.start - block.bounds[w.doc]) // WINDOW
    first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (w.doc[1:] != w.doc[:-1]))))
    return w.doc[first], w.start[first], w.end[np.append(first[1:], len(w.end)) - 1]


def _laid(block: tg.Block, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The windows in lower case one after the other, and where each lies (offset and length).

    Each stands behind a space and before ``TAIL`` of them: the compressor looks for no match in the last bytes.
    """
    size = end - start + 1 + TAIL
    offset = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, dtype=np.uint8)
    length = end - start
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(offset + 1, length) + at] = _LOWER[block.data[np.repeat(start, length) + at]]
    return out.tobytes(), np.column_stack([offset, size]).astype(np.uint64)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


def _sizes(data: bytes, parts: np.ndarray, by: zstandard.ZstdCompressor) -> np.ndarray:
    found = by.multi_compress_to_buffer(zstandard.BufferWithSegments(data, parts.tobytes()), threads=1)
    return np.fromiter((len(found[i]) for i in range(len(found))), dtype=np.int64, count=len(found))


def _values(data: bytes) -> np.ndarray:
    """Every run of GRAM bytes as a number."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw) - GRAM + 1
    value = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(GRAM if n > 0 else 0):
        value <<= np.uint64(8)
        value |= raw[j:j + n]
    return value


def _bucket(value: np.ndarray) -> np.ndarray:
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _touched(data: bytes, parts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Windows with a run of GRAM bytes of the toxic wording; all else in the two dictionaries is equal and at equal
    distance, so on the other windows the sizes differ by no more than chance matches, and they count as no saving."""
    value = _values(data)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[_bucket(runs)] = True
    at = np.flatnonzero(maybe[_bucket(value)])
    at = at[np.isin(value[at], runs)]
    start, size = parts[:, 0].astype(np.int64), parts[:, 1].astype(np.int64)
    window = np.searchsorted(start, at, side="right") - 1
    out = np.zeros(len(parts), dtype=bool)
    out[window[at + GRAM <= start[window] + size[window]]] = True
    return out


def describe(block: tg.Block, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, runs: np.ndarray) -> np.ndarray:
    """One row a text: share and number of windows at each threshold, the best window, and how many windows there are."""
    doc, start, end = windows(block)
    n = block.hi - block.lo
    many = np.bincount(doc, minlength=n)
    if not len(doc):
        return np.zeros((n, 2 * len(SAVED) + 2))
    data, parts = _laid(block, start, end)
    saved = np.zeros(len(doc), dtype=np.int64)
    of = np.flatnonzero(_touched(data, parts, runs))
    if len(of):
        saved[of] = _sizes(data, parts[of], ordinary) - _sizes(data, parts[of], toxic)
    best = np.zeros(n)
    np.maximum.at(best, doc, saved)
    hits = [np.bincount(doc, saved >= t, n) for t in SAVED]
    return np.column_stack([*[np.sqrt(h / np.maximum(many, 1)) for h in hits], *[np.log1p(h) for h in hits], best, np.log1p(many)])


@dataclass
class Distance:
    """What both dictionaries share, the toxic wording, and the calibration."""

    ordinary: bytes
    wording: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor, np.ndarray]:
        """For ordinary and for toxic text, and the runs of the toxic wording. In place of that wording the ordinary
        dictionary has bytes that no text has; both end in the same blanks."""
        blanks = b" " * 32
        words = b" " + self.wording + b" "
        return (_compressor(self.ordinary + b"\xff" * len(words) + blanks), _compressor(self.ordinary + words + blanks), np.unique(_values(words)))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _runs(block: tg.Block, w: tg.Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of GRAM bytes of the words ``of`` (with a space before and after), and the word of each."""
    data = _LOWER[block.data]
    data = np.concatenate(([32], data, np.full(GRAM, 32, dtype=np.uint8))).astype(np.uint64)
    word_at = np.zeros(len(data), dtype=np.int64) - 1
    length = np.maximum(w.end[of] - w.start[of] + 3 - GRAM, 0)  # a run may begin at the space before and end at the one after
    at = np.repeat(w.start[of] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    word_at = np.repeat(of, length)
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(GRAM):
        byte = data[at + j]
        value = value * np.uint64(256) + byte
    return value, word_at


def wording(texts: list[str], toxic: np.ndarray) -> list[bytes]:
    """Runs of words significantly more frequent in toxic texts, the most frequent last."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    seen: tuple[set, set] = (set(), set())
    blocks = []
    for block in tg.blocks(pa.array(texts, pa.large_string())):
        w = tg.words(block, lower=True)
        if not len(w.start):
            continue
        near = np.concatenate(([0], w.hash[:-1])).astype(np.uint64) * np.uint64(3) + np.concatenate((w.hash[1:], [0])).astype(np.uint64) * np.uint64(5) + w.hash
        kind = toxic[w.doc + block.lo]
        for label in (0, 1):
            of = np.flatnonzero(kind == label)
            _, first = np.unique(near[of], return_index=True)
            of = np.array([i for i in of[first].tolist() if (key := int(near[i])) not in seen[label] and not seen[label].add(key)], dtype=np.int64)
            value, _ = _runs(block, w, of)
            for v, c in zip(*[x.tolist() for x in np.unique(value, return_counts=True)]):
                counts[label][v] += c
        blocks.append((block, w, kind))
    total = [max(1, len(s)) for s in seen]
    told = set()
    for run, k in counts[1].items():
        if k >= LEAST_SEEN:
            other = counts[0].get(run, 0)
            lift = np.log((k + 0.5) / total[1]) - np.log((other + 0.5) / total[0])
            if lift > np.log(LIFT) and lift > SIGMA * np.sqrt(1 / (k + 0.5) + 1 / (other + 0.5)):
                told.add(run)
    telling = np.array(sorted(told), dtype=np.uint64)
    found: Counter = Counter()
    for block, w, kind in blocks:
        value, word = _runs(block, w, np.flatnonzero(kind == 1))
        hit = np.flatnonzero(np.isin(value, telling))
        data = b" " + _LOWER[block.data].tobytes() + b" "
        places = np.arange(len(word)) - np.searchsorted(word, word)  # a run's place in its word, counted from the space before it
        for i, lo in zip(word[hit].tolist(), places[hit].tolist()):
            at = int(w.start[i]) + lo
            found[data[at:at + GRAM]] += 1
    return [run for run, _ in sorted(found.items(), key=lambda x: (x[1], x[0]))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(a.shape[1])
    decay = np.append(np.full(x.shape[1], l2 * weight.sum() / 10), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - decay * theta
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(decay), grad)
        theta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return theta


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Distance | None:
    """Dictionaries from three fifths of the texts, calibration from the others; ``share``: of toxic among all labelled."""
    if not len(texts) or toxic.min() == toxic.max():
        return None
    part = np.arange(len(texts)) % 5
    learn, check = (part < 3, part >= 3) if len(texts) >= 50 and len(set(toxic[part < 3])) == len(set(toxic[part >= 3])) == 2 else (part >= 0, part >= 0)
    samples = []
    for block in tg.blocks(pa.array([t for t, y in zip(texts, toxic) if not y], pa.large_string())):
        _, start, end = windows(block)
        if len(start):
            data, parts = _laid(block, start, end)
            samples += [data[o:o + n - TAIL] for o, n in parts.astype(np.int64).tolist()]
    samples = sorted(set(samples))
    try:
        ordinary = zstandard.train_dictionary(ORDINARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # the trainer refuses too little text; then the text itself is the dictionary
        ordinary = b"".join(samples)[-ORDINARY:]
    at = np.flatnonzero(learn)
    special = b"".join(wording([texts[i] for i in at], toxic[at]))[-TOXIC:]
    model = Distance(ordinary, special, np.zeros(1), np.ones(1), np.zeros(1))
    both = model.compressors()
    x = np.concatenate([describe(b, *both) for b in tg.blocks(pa.array(texts, pa.large_string()))])[check]
    y = toxic[check].astype(float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Distance(ordinary, special, mean, spread, _logistic(np.clip((x - mean) / spread, -8, 8), y, weight))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _stretches(text: str, limit: int = SAMPLE_BYTES, stretch: int = STRETCH) -> str:
    if len(text) <= limit:
        return text
    starts = np.linspace(0, len(text) - stretch, limit // stretch).astype(int)
    return "\n".join(text[s:s + stretch] for s in starts)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Distance | None:
    """Learned from ``sample`` documents of either label, by the hash of the id, that are not held out."""
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([_stretches(t) for t in batch.column(2).to_pylist()], pa.string())],
                                  names=["doc_id", "toxic", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = (docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id").select("doc_id", "toxic", "text").distinct()
            .mapInArrow(cut, f"doc_id {kind}, toxic int, text string").toPandas())
    rows = rows.assign(mixed=[zlib.crc32(str(i)[::-1].encode()) for i in rows["doc_id"]]).sort_values(["mixed", "doc_id", "text"])
    return fit(rows["text"].to_list(), rows["toxic"].to_numpy(dtype=np.int64), count.get(1, 0) / max(1, sum(count.values())))


def toxicity(docs: DataFrame, labels: DataFrame, predict_at: float = PREDICT_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts have no window and are scored like any text without a hit. Repeated rows stay repeated; a null id is scored
    and not held out. Where nothing can be learned (no labels, or of one kind) every score is 0. Labels other than 0 and 1
    are left out; of several labels of a document the larger counts. An empty table gives no rows.
    """
    model = train(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors() if model is not None else None
        for batch in batches:
            for block in tg.blocks(batch.column(1)):
                n = block.hi - block.lo
                score = model.score(describe(block, *both)) if model is not None else np.zeros(n)
                yield pa.record_batch([batch.column(0).slice(block.lo, n), pa.array(score)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= predict_at).cast("int").alias("predicted"))
