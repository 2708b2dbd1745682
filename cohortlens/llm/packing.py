"""Mixture-controlled packing (operator 5).

Documents are tokenised and queued by source. A window is ``WINDOW_SEQUENCES`` sequences. Deficit round-robin: in every
window each queue is credited its share of the window's tokens and serves the whole tokens of its credit; the fraction
that is left over is the deficit it carries into the next window. Summed up, queue s has served floor(rate_s * w) tokens
after w windows, so the place of any token follows from its position in its queue: partitions carry the deficits of all
windows before theirs without waiting for them, and no pass over the windows is needed. When a queue runs dry the others
share its rate from the next window on.

Queues are laid one after the other inside a window and cut into sequences of ``LENGTH`` tokens. A window takes a few
tokens less than its room, so rounding never spills over; that is all the padding there is, but for the very last
sequence, which is cut into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.session import materialise

LENGTH, WINDOW_SEQUENCES, END = 2048, 32, 1
SPECIAL = "<|endoftext|>"  # fixed value: the vocabulary's one special token
_encoders: dict[str, object] = {}


def encoder(path: str):
    """Texts -> lists of ids of the byte-level BPE vocabulary in ``path``.

    The vocabulary's rank file, where it lies beside it, gives the same ids in a fifth of the time; texts with the special
    token go through the tokenizer itself.
    """
    if path not in _encoders:
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        fast = None
        if os.path.exists(ranks):
            import public_tokenizers

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

        def encode(text: str) -> list[int]:
            if fast is None or SPECIAL in text:
                return whole.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of every document (with the end id), and how many tokens of its source the same task had before it."""
    encode = encoder(path)
    task = TaskContext.get().partitionId()
    before: dict[str, int] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            ids, sizes, starts = [], [], []
            for source, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                own = np.array([*encode(text), END], dtype=np.uint32)
                at = before.get(source, 0)
                ids.append((own.astype(np.uint16) if own.max() < 1 << 16 else own).tobytes())
                sizes.append(len(own))
                starts.append(at)
                before[source] = at + len(own)
            yield pa.record_batch([part.column(0), part.column(1), pa.array([task] * len(sizes), pa.int32()), pa.array(starts, pa.int64()),
                                   pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                                  names=["doc_id", "queue", "task", "before", "doc_tokens", "ids"])


@dataclass
class Plan:
    """The round-robin of all windows. A phase is (first window, served so far, rate) with a rate of tokens a window for
    every queue; phases end when a queue runs dry. ``total``: tokens of every queue."""

    total: list[int]
    phases: list[tuple[int, list[int], list[Fraction]]]
    windows: int

    def served(self, w: int) -> np.ndarray:
        """Tokens that every queue has served after ``w`` windows."""
        if w >= self.windows:
            return np.array(self.total, dtype=np.int64)
        first, done, rate = next(p for p in reversed(self.phases) if p[0] <= w)
        return np.array([min(t, d + (r.numerator * (w - first)) // r.denominator) for t, d, r in zip(self.total, done, rate, strict=True)], dtype=np.int64)


def plan(total: list[int], weights: list[float], room: int) -> Plan:
    """Phases of the round-robin: queues of ``total`` tokens, credited by ``weights``, ``room`` tokens a window."""
    share = [Fraction(w).limit_denominator(10 ** 9) for w in weights]
    done, phases, w = [0] * len(total), [], 0
    while any(d < t for d, t in zip(done, total, strict=True)):
        open_ = [s if d < t else Fraction(0) for s, d, t in zip(share, done, total, strict=True)]
        if not sum(open_):
            open_ = [Fraction(int(d < t)) for d, t in zip(done, total, strict=True)]
        rate = [s * room / sum(open_) for s in open_]
        phases.append((w, list(done), rate))
        n = min(-(-(t - d) * r.denominator // r.numerator) for t, d, r in zip(total, done, rate, strict=True) if r)
        w += n
        done = [min(t, d + r.numerator * n // r.denominator) for t, d, r in zip(total, done, rate, strict=True)]
    return Plan(total, phases, w)


def places(size: int, length: int, last: bool) -> list[tuple[int, int]]:
    """(start, end) of the sequences that ``size`` tokens of one window fill; the last window ends in powers of two."""
    out = [(a, min(a + length, size)) for a in range(0, size, length)]
    if last and out and out[-1][1] - out[-1][0] < length:
        a, end = out.pop()
        while a < end:
            b = 1 << ((end - a).bit_length() - 1)
            out.append((a, a + b))
            a += b
    return out


def _pieces(batches: Iterator[pa.RecordBatch], p: Plan, number: dict[str, int], length: int, per_window: int) -> Iterator[pa.RecordBatch]:
    served: dict[int, np.ndarray] = {}

    def after(w: int) -> np.ndarray:
        if w not in served:
            if len(served) > 4096:
                served.clear()
            served[w] = p.served(w)
        return served[w]

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "queue", "begin", "doc_tokens", "ids")]
        out: list[tuple] = []
        for doc, queue, begin, n, raw in zip(*cols, strict=True):
            q = number[queue]
            ids = np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
            lo, hi = 0, p.windows - 1  # the window of the first token
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if after(mid + 1)[q] <= begin else (lo, mid)
            w, at = lo, 0
            while at < n:
                a, b = after(w), after(w + 1)
                quota = b - a
                base = int(quota[:q].sum())
                inside, room = begin + at - int(a[q]), int(b[q]) - begin - at
                if room > 0:
                    x, left = base + inside, min(room, n - at)
                    for s, (start, end) in enumerate(places(int(quota.sum()), length, w == p.windows - 1)):
                        if start <= x < end and left:
                            m = min(left, end - x)
                            out.append((doc, at, m, zlib.crc32(ids[at:at + m].tobytes()), n, w * per_window + s, x - start))
                            at, x, left = at + m, x + m, left - m
                w += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        yield pa.record_batch([pa.array(c, batch.column("doc_id").type if name == "doc_id" else pa.int64())
                               for name, c in zip(names, zip(*out, strict=True) if out else [[]] * 7, strict=True)], names=names)


def pack(docs: DataFrame, vocabulary: str, weights: dict[str, float] | None = None, length: int = LENGTH,
         window_sequences: int = WINDOW_SEQUENCES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``weights``: target token proportion by source; sources that it leaves out, and all sources if it is None, get their
    share of the corpus, so all queues end together. A null source is a queue of its own. Null and empty texts are one end
    token. Repeated rows are packed each. An empty table gives an empty result. Within a queue documents keep the order of
    the tasks that read them. The number of sources is taken to be bounded (it is the width of the plan).
    """
    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("")).alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
    tok = materialise(src.mapInArrow(lambda it: _tokens(it, vocabulary), f"doc_id {kind}, queue string, task int, before long, doc_tokens long, ids binary"), "tokens")
    sums = materialise(tok.groupBy("queue", "task").agg(F.sum("doc_tokens").alias("n")), "sums")
    begin = materialise(sums.select("queue", "task", F.coalesce(F.sum("n").over(
        Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift")), "begin")
    total = sorted((r[0], int(r[1])) for r in sums.groupBy("queue").agg(F.sum("n")).collect())
    number = {q: i for i, (q, _) in enumerate(total)}
    sizes = [n for _, n in total]
    want = [(weights or {}).get(q.removeprefix("s:"), n / max(1, sum(sizes))) for q, n in total]
    per_window = max(window_sequences, -(-64 * len(sizes) // length))
    p = plan(sizes, want, per_window * length - len(sizes))
    rows = tok.join(begin, ["queue", "task"]).select("doc_id", "queue", (F.col("shift") + F.col("before")).alias("begin"), "doc_tokens", "ids")
    return rows.mapInArrow(lambda it: _pieces(it, p, number, length, per_window),
                           f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
