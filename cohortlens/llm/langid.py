"""Language identification by interpolated Kneser-Ney character models (operator 1).

The n-grams of all training documents are counted: each task counts words once per group of texts and n-grams once per
distinct word, Spark sums the counts; shorter orders are continuation counts derived from them. A word is scored with its
boundaries, so a document's cross-entropy is a sum over its distinct words, divided by its letters and word ends.

Up to ``CAPACITY`` 5-grams a language the whole model is sent to the tasks. A larger one stays in Spark, all orders of it, and
the tasks get the log probabilities of as many of each language's most frequent 5-grams; what else a document holds is looked up
by joins, order by order, and added to its sum. Either way every counted n-gram takes part.

A model is a set of sorted hash arrays, one an order, with a column of log probabilities for every language, and one with
the backoff weights of contexts. The language of lowest cross-entropy is chosen. The margin to the second is calibrated
by logistic regression on a bounded sample of training documents (``CALIBRATION`` of up to ``CALIBRATION_CHARS`` characters); a low score or a cross-entropy far outside the
language's own marks a document as rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm import textgrid as tg
from cohortlens.session import materialise

ORDER, CAPACITY, CALIBRATION, CALIBRATION_CHARS, GROUP, UNKNOWN = 5, 1 << 17, 2_000, 20_000, 3 << 20, "und"
_BITS = np.uint64(12)
_START, _END, _FOLD = 1, 2, 4093
_U = np.uint64
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


@dataclass
class Lexicon:
    """The distinct words (letter runs) of some texts: symbols of all, first symbol and length of each; and for every
    word in order its text and its number among the distinct ones."""

    symbols: np.ndarray
    first: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    word: np.ndarray


def lexicon(texts: list[str], group: np.ndarray | None = None) -> Lexicon:
    """``group``: a number for each text; equal words of different groups are told apart."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(lower).encode("utf-32-le"), dtype=np.uint32)
    begin = np.cumsum([0, *[len(t) + 1 for t in lower]])
    letter = _is_letter()[code]
    edge = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begin, start, side="right") - 1
    power, inverse = tg._tables(len(code))
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(tg.mix(code.astype(np.uint64)) * power[:len(code)], out=total[1:])
    h = tg.mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    if group is not None:
        h = tg.mix(h + group[doc].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    _, at, word = np.unique(h, return_index=True, return_inverse=True)
    symbols = np.where(code < 4096, np.maximum(code, 3), 3 + code % _FOLD).astype(np.uint64)
    return Lexicon(symbols, start[at], (end - start)[at], doc, word)


def grams(x: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at every letter of the distinct words and behind it, and the word of each. A code
    holds ``ORDER`` symbols of 12 bits (larger code points are folded); before the word stand start symbols."""
    n = x.length + 1
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    code = np.zeros(len(of), dtype=np.uint64)
    for back in range(ORDER - 1, -1, -1):
        at = place - back
        symbol = np.where(at < 0, _U(_START), x.symbols[np.minimum(np.maximum(at, 0) + x.first[of], len(x.symbols) - 1)])
        symbol = np.where(at == x.length[of], _U(_END), symbol)
        code = code << _BITS | symbol
    return code, of


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    for block in tg.blocks(batch.column(column), GROUP):
        yield block.lo, [t or "" for t in batch.column(column).slice(block.lo, block.hi - block.lo).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, texts in _groups(batch, 1):
            names = sorted(set(langs[lo:lo + len(texts)]))
            group = np.array([names.index(v) for v in langs[lo:lo + len(texts)]])
            x = lexicon(texts, group)
            if not len(x.word):
                continue
            code, of = grams(x)
            times = np.bincount(x.word, minlength=len(x.length))
            lang = np.zeros(len(x.length), dtype=int)
            lang[x.word] = group[x.doc]
            for g, name in enumerate(names):
                mine = lang[of] == g
                kept[name] = _add(kept.get(name), code[mine], times[of[mine]])
                if len(kept[name][0]) > most:
                    yield _counts(name, *kept.pop(name))
    for name, (code, n) in kept.items():
        yield _counts(name, code, n)


def _add(old: tuple[np.ndarray, np.ndarray] | None, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if old is not None:
        code, n = np.concatenate((old[0], code)), np.concatenate((old[1], n))
    order = np.argsort(code)
    code, n = code[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, dtype=int)
    return code[at], np.add.reduceat(n, at) if len(at) else n


def _counts(name: str, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([name] * len(code), pa.string()), pa.array(tg.signed(code)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def _mask(order: int) -> np.uint64:
    return _U((1 << 12 * order) - 1)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), dtype=int), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def kneser_ney(code: np.ndarray, n: np.ndarray) -> tuple[list, list]:
    """For every order from 1: (codes, probabilities), and (contexts, backoff weights)."""
    levels = {ORDER: _add(None, code, n.astype(float))}
    for order in range(ORDER - 1, 0, -1):
        longer = levels[order + 1][0]
        levels[order] = _add(None, longer & _mask(order), np.ones(len(longer)))
    probs, backs = [], []
    for order in range(1, ORDER + 1):
        codes, count = levels[order]
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        contexts, of = np.unique(codes >> _BITS, return_inverse=True)
        total, types = np.bincount(of, count), np.bincount(of)
        back = d * types / total
        if order == 1:
            lower = np.full(len(codes), 1 / 4096)
        else:
            lower = probs[-1][1][_find(probs[-1][0], codes & _mask(order - 1))[0]]
        probs.append((codes, np.maximum(count - d, 0) / total[of] + back[of] * lower))
        backs.append((contexts, back))
    return probs, backs


@dataclass
class Tail:
    """The whole model as tables: (lang, ord, code, count), (lang, ord, context, total, types), and the discounts by
    language and order."""

    levels: DataFrame
    contexts: DataFrame
    discount: dict[tuple[str, int], float]

    def logs(self, codes: DataFrame) -> DataFrame:
        """(code, logs): the log probabilities of distinct codes in every language, in order. An order's codes meet those of
        the order below, of which each stands for 4,096 at most."""
        langs = sorted({lang for lang, _ in self.discount})
        lower = None
        for order in range(1, ORDER + 1):
            kinds = F.explode(F.array(*[F.struct(F.lit(v).alias("lang"), F.lit(self.discount[v, order]).alias("d")) for v in langs]))
            asked = (codes.select(_low(order).alias("code")).distinct().select("code", kinds.alias("k")).select("code", "k.*")
                     .withColumns({"context": F.shiftright("code", 12), "below": _low(order - 1)}))
            rows = (asked.join(self.contexts.where(F.col("ord") == order).drop("ord"), ["lang", "context"], "left")
                    .join(self.levels.where(F.col("ord") == order).drop("ord"), ["lang", "code"], "left"))
            rows = rows.withColumn("p", F.lit(1 / 4096)) if lower is None else rows.join(lower, ["lang", "below"])
            seen = F.greatest(F.coalesce("count", F.lit(0)) - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("d") * F.col("types") / F.col("total") * F.col("p")
            found = rows.select("lang", "code", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen).alias("p"))
            lower = materialise(found, "order").withColumnRenamed("code", "below")
        by = F.sort_array(F.collect_list(F.struct("lang", F.log("p").alias("log"))))
        return lower.groupBy(F.col("below").alias("code")).agg(F.transform(by, lambda x: x["log"]).alias("logs"))


def _low(order: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << 12 * order) - 1))


def tables(sums: DataFrame) -> Tail:
    """The model of all counted 5-grams (lang, code, n)."""
    level = sums.select("lang", "code", F.col("n").alias("count"))
    levels, contexts, discount = None, None, {}
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            level = level.groupBy("lang", _low(order).alias("code")).agg(F.count(F.lit(1)).alias("count"))
        level = materialise(level, "level")
        for lang, n1, n2 in level.groupBy("lang").agg(F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2)).collect():
            discount[lang, order] = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        some = level.groupBy("lang", F.shiftright("code", 12).alias("context")).agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("types"))
        some, named = some.withColumn("ord", F.lit(order)), level.withColumn("ord", F.lit(order))
        levels, contexts = (named, some) if levels is None else (levels.unionByName(named), contexts.unionByName(some))
    return Tail(levels, materialise(contexts, "contexts"), discount)


def entropies(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``bits`` a symbol in every language and ``size`` instead of ``text``, by head and tail."""
    rest = [c for c in rows.columns if c != "text"]
    held = rows.sparkSession.sparkContext.broadcast(replace(model, tail=None))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _groups(batch, len(rest) + 1):
                logs, size, missed = held.value.partial(texts)
                yield pa.record_batch([*(batch.column(c).slice(lo, len(texts)) for c in range(len(rest) + 1)), pa.array(logs.tolist(), pa.list_(pa.float64())),
                                       pa.array(size.astype(float)), pa.array(missed, pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())])))],
                                      names=[*rest, "_row", "_logs", "size", "_missed"])

    kinds = dict(rows.dtypes)
    some = materialise(rows.select(*rest, F.monotonically_increasing_id().alias("_row"), "text").mapInArrow(
        summed, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "_row long, _logs array<double>, size double, _missed array<struct<code:long,n:long>>"])), "heads")
    missed = some.select("_row", F.explode("_missed").alias("m")).select("_row", "m.*")
    logs = materialise(model.tail.logs(missed.select("code").distinct()), "tails")
    langs = range(len(model.langs))
    more = missed.join(logs, "code").groupBy("_row").agg(F.array(*[F.sum(F.col("n") * F.col("logs")[j]) for j in langs]).alias("_more"))
    bits = [-(F.col("_logs")[j] + F.coalesce(F.col("_more")[j], F.lit(0.0))) / F.greatest("size", F.lit(1.0)) / float(np.log(2)) for j in langs]
    return some.join(more, "_row", "left").select(*rest, F.array(*bits).alias("bits"), "size")


@dataclass
class Model:
    """Sorted hashes of n-grams with log probabilities, and of contexts with log backoff weights, by order from 1; a column
    for every language."""

    langs: list[str]
    probs: list[tuple[np.ndarray, np.ndarray]]
    backs: list[tuple[np.ndarray, np.ndarray]]
    slope: float = 1.0
    shift: float = 0.0
    usual: np.ndarray | None = None
    head: tuple[np.ndarray, np.ndarray] | None = None
    tail: Tail | None = None

    def logs(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros((len(code), len(self.langs)), dtype=np.float32)
        left = np.arange(len(code))
        for order in range(ORDER, 0, -1):
            key = code[left] & _mask(order)
            at, hit = _find(self.probs[order - 1][0], tg.mix(key))
            out[left[hit]] += self.probs[order - 1][1][at[hit]]
            left, key = left[~hit], key[~hit]
            at, hit = _find(self.backs[order - 1][0], tg.mix(key >> _BITS))
            out[left[hit]] += self.backs[order - 1][1][at[hit]]
        out[left] -= np.log(4096)
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of every text in every language, and its number of symbols (0: no letter)."""
        x = lexicon(texts)
        size = np.zeros(len(texts))
        bits = np.zeros((len(texts), len(self.langs)))
        if len(x.word):
            code, of = grams(x)
            distinct, back = np.unique(code, return_inverse=True)
            logs = self.logs(distinct)
            size = np.bincount(x.doc, (x.length + 1)[x.word], len(texts))
            for j in range(len(self.langs)):
                a_word = np.bincount(of, logs[back, j], len(x.length))
                bits[:, j] = np.bincount(x.doc, a_word[x.word], len(texts))
        return -bits / np.maximum(size, 1)[:, None] / np.log(2), size

    def partial(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        """Sums of the logs of every text by the head alone, its number of symbols, and the codes that are not in the head."""
        x = lexicon(texts)
        logs, size, missed = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), [[] for _ in texts]
        if not len(x.word):
            return logs, size, missed
        code, of = grams(x)
        distinct, back = np.unique(code, return_inverse=True)
        at, hit = _find(self.head[0], distinct)
        known = np.where(hit[:, None], self.head[1][at], 0) if len(self.head[0]) else np.zeros((len(distinct), len(self.langs)))
        size = np.bincount(x.doc, (x.length + 1)[x.word], len(texts))
        for j in range(len(self.langs)):
            logs[:, j] = np.bincount(x.doc, np.bincount(of, known[back, j], len(x.length))[x.word], len(texts))
        odd = np.flatnonzero(~hit[back])
        by = np.argsort(x.word, kind="stable")
        first = np.searchsorted(x.word[by], np.arange(len(x.length) + 1))
        for i in odd.tolist():
            w = of[i]
            for doc in x.doc[by[first[w]:first[w + 1]]].tolist():
                missed[doc].append(int(code[i]))
        return logs, size, [[{"code": c, "n": n} for c, n in Counter(m).items()] for m in missed]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the chosen language (-1: no letter), score, rejected, bits a symbol."""
        return self.choose(*self.entropy(texts))

    def choose(self, bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        best = bits.argmin(axis=1)
        some = size > 0
        low = bits[np.arange(len(size)), best]
        score = np.where(some, 1 / (1 + np.exp(-(self.slope * evidence(bits, size) + self.shift))), 0)
        odd = low > self.usual[best] if self.usual is not None else np.zeros(len(size), dtype=bool)
        return np.where(some, best, -1), score, ~some | odd | (score < 0.5), low


def evidence(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Margin of the best language over the second, worth more on a longer text."""
    if bits.shape[1] < 2:
        return np.ones(len(bits))
    two = np.partition(bits, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(np.minimum(size, 400))


def assemble(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    langs = sorted(counts)
    parts = [kneser_ney(*counts[name]) for name in langs]
    model = Model(langs, [], [])
    for which, out in ((0, model.probs), (1, model.backs)):
        for order in range(ORDER):
            keys = np.unique(np.concatenate([p[which][order][0] for p in parts]))
            out.append((keys, np.zeros((len(keys), len(langs)), dtype=np.float32)))
    for j, (probs, backs) in enumerate(parts):
        for order in range(ORDER):
            keys, column = model.backs[order]
            at, hit = _find(backs[order][0], keys)
            column[hit, j] = np.log(backs[order][1][at[hit]])
        for order in range(ORDER):
            keys, column = model.probs[order]
            at, hit = _find(probs[order][0], keys)
            column[hit, j] = np.log(probs[order][1][at[hit]])
            miss = np.flatnonzero(~hit)
            ctx = _find(model.backs[order][0], keys[miss] >> _BITS)
            lower = np.full(len(miss), -np.log(4096))
            if order:
                lower = model.probs[order - 1][1][_find(model.probs[order - 1][0], keys[miss] & _mask(order))[0], j]
            column[miss, j] = np.where(ctx[1], model.backs[order][1][ctx[0], j], 0) + lower
    for table in (model.probs, model.backs):
        for order, (keys, column) in enumerate(table):
            h = tg.mix(keys)
            by = np.argsort(h)
            table[order] = (h[by], column[by])
    return model


def calibrate(model: Model, bits: np.ndarray, size: np.ndarray, truth: list[str]) -> Model:
    """Logistic regression of being right on the evidence (with Platt's targets), and the usual range of each language."""
    some = size > 0
    best = bits.argmin(axis=1)
    right = np.array([model.langs[b] == t for b, t in zip(best, truth, strict=True)])[some]
    model.usual = np.full(len(model.langs), np.inf)
    if not len(right):
        return model
    x = evidence(bits, size)[some]
    y = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([((y - p) * x).sum() - 1e-3 * (a - 1), (y - p).sum() - 1e-3 * b]))
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    model.slope, model.shift = max(a, 1e-3), b
    for j in range(len(model.langs)):
        own = bits[some & (best == j), j]
        if len(own) >= 20:
            model.usual[j] = own.mean() + 6 * own.std() + 0.5
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, capacity: int = CAPACITY, calibration: int = CALIBRATION) -> Model | None:
    """A model of the languages in ``lang`` (nulls left out); None if there is no text to learn from."""
    known = docs.select("lang", "text", "doc_id").where("lang is not null and text is not null")
    sums = known.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "ngrams")
    sizes = dict(sums.groupBy("lang").count().collect())
    if not sizes:
        return None
    short = known.where(F.length("text") <= CALIBRATION_CHARS)
    ids = materialise(short.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration).distinct(), "sample")
    some = short.join(ids, "doc_id", "left_semi")
    if max(sizes.values()) > capacity:
        model = Model(sorted(sizes), [], [], tail=tables(sums))
        frequent = None
        for lang in model.langs:
            top = sums.where(F.col("lang") == lang).orderBy(F.desc("n"), "code").limit(capacity).select("code")
            frequent = top if frequent is None else frequent.unionByName(top)
        top = model.tail.logs(materialise(frequent.distinct(), "head")).orderBy("code").toPandas()
        model.head = top["code"].to_numpy().astype(np.uint64), np.array(top["logs"].tolist(), dtype=np.float32).reshape(-1, len(model.langs))
        seen = entropies(some.select("doc_id", "lang", "text"), model).orderBy("doc_id", "size").toPandas()
        bits = np.array(seen["bits"].tolist(), dtype=float).reshape(-1, len(model.langs))
        return calibrate(model, bits, seen["size"].to_numpy(), seen["lang"].tolist())
    counts = {}
    for lang in sizes:
        whole = sums.where(F.col("lang") == lang).select("code", "n").toPandas()
        counts[lang] = (whole["code"].to_numpy().astype(np.int64).view(np.uint64), whole["n"].to_numpy())
    model = assemble(counts)
    seen = some.orderBy("doc_id", "text").select("text", "lang").toPandas()
    return calibrate(model, *model.entropy(seen["text"].tolist()), seen["lang"].tolist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, bits) for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, and so is every text if there is no model.
    Otherwise ``lang_pred`` is the best language and ``rejected`` says that it should not be trusted. Ties go to the first
    language in order. Repeated rows stay repeated; an empty table gives an empty result.
    """
    names = ["doc_id", "held_out", "lang_pred", "score", "rejected", "bits"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean, bits double"
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    tiered = model is not None and model.tail is not None
    held = docs.sparkSession.sparkContext.broadcast(replace(model, tail=None, head=None) if tiered else model)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            best, score, rejected, bits = m.choose(np.array(batch.column(2).to_pylist()), batch.column(3).to_numpy())
            said = [m.langs[b] if b >= 0 else UNKNOWN for b in best.tolist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(score.astype(float)), pa.array(rejected),
                                   pa.array(bits.astype(float))], names=names)

    if tiered:
        return entropies(rows, model).mapInArrow(chosen, schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for lo, texts in _groups(batch, 2):
                n = len(texts)
                best, score, rejected, bits = m.judge(texts) if m is not None else (np.full(n, -1), np.zeros(n), np.ones(n, dtype=bool), np.zeros(n))
                said = [m.langs[b] if b >= 0 else UNKNOWN for b in best.tolist()]
                yield pa.record_batch([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(said, pa.string()), pa.array(score.astype(float)),
                                       pa.array(rejected), pa.array(bits.astype(float))], names=names)

    return rows.mapInArrow(scored, schema)
