"""Phrase collocations by best-first branch and bound (operator 11).

The texts become arrays of 64-bit word hashes, 0 between pieces. Words are counted first. A phrase that starts with w
scores at most ``1000 n / f(w)``: its cut after the first word has l = f(w) and r at least a. So prefixes form a tree
whose bound falls with the count of their first word, and the frontier is opened from the highest bound on: one pass over
the corpus counts all one-word extensions of the next ``width`` prefixes, and extensions found often enough are extended in
turn. Counted prefixes bound candidates more closely (the cut before the last word); from the highest bound on these are
probed in another pass for their neighbours and for suffixes that the tree lacks. A
language is settled when no prefix left in its frontier can reach the score of its last surviving row, ties included.

A candidate lies inside a longer one of the same count exactly if all its occurrences have one and the same neighbour on
one side; so survival is decided from the neighbours alone, without the longer phrases being in the tree.

Every set of keys sent to the tasks has at most ``width`` entries; more keys take more passes. Phrases are told apart by
the hashes of all their words, and the last pass, which reads the words themselves, stops with an error should two
phrases of the result share their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm import textgrid as tg
from cohortlens.session import materialise

LONGEST, LEAST, TOP, WIDTH, SCALE = 5, 100, 2_000, 1 << 17, 1_000
#: Words of a row of the token table; longer texts go on in another row, which repeats the words around the seam.
CHUNK, GROUP = 1 << 16, 1 << 18
_U = np.uint64
SMALL = _U(1 << 32)
_STEP = _U(0xD6E8FEB86659FD93)
_BREAK, _GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True
_SEPARATOR = _BREAK | _GAP
UNKNOWN = "und"


def _words(block: tg.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte range and text of every word, and whether it begins a piece."""
    data, bounds = block.data, block.bounds
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    apart = _SEPARATOR[data]
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:], after[:-1] = apart[:-1], apart[1:]
    inner = bounds[1:-1]
    before[inner[inner < n]] = True
    after[inner[inner > 0] - 1] = True
    start, end = np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    piece = np.cumsum(_BREAK[data])[start] if len(start) else start
    new = np.ones(len(start), dtype=bool)
    new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    return start, end, doc, new


def _laid_out(block: tg.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes with a 0 before every piece, where each text begins in them, and the bytes of each (0: none)."""
    start, end, doc, new = _words(block)
    h = tg.span_hash(block.data, start, end, lower=True)
    h[h < SMALL] += SMALL  # 0 parts pieces, and numbers of opened words are below it too
    at = np.arange(len(h)) + np.cumsum(new)
    out = np.zeros(len(h) + int(new.sum()), dtype=_U)
    from_, to = np.zeros(len(out), dtype=np.int64), np.zeros(len(out), dtype=np.int64)
    out[at], from_[at], to[at] = h, start, end
    first = np.searchsorted(doc, np.arange(block.hi - block.lo + 1))
    whole = np.append(at, len(out))
    return out, np.where(first < len(h), whole[first] - 1, len(out)), from_, to


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang key, words, first own, own): a text's array, or its chunks with one word before and LONGEST after them."""
    for batch in batches:
        for block in tg.blocks(batch.column(1)):
            out, begin, _, _ = _laid_out(block)
            ids, lists, lead, own = [], [], [], []
            for i in range(block.hi - block.lo):
                a, b = int(begin[i]), int(begin[i + 1])
                for s in range(a, b, CHUNK):
                    e = min(s + CHUNK, b)
                    ids.append(block.lo + i)
                    lists.append(out[max(a, s - 1):min(b, e + LONGEST)])
                    lead.append(min(s - a, 1))
                    own.append(e - s)
            if ids:
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                yield pa.record_batch([batch.column(0).take(pa.array(ids)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(tg.signed(np.concatenate(lists)))),
                                       pa.array(lead, pa.int32()), pa.array(own, pa.int32())], names=["lang", "words", "lead", "own"])


def _key(lang: np.ndarray) -> np.ndarray:
    return tg.mix(lang.view(_U) ^ _STEP)


def _grow(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tg.mix(key * _STEP + word)


def keys_of(phrases: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys of the phrases (lang, p) by their number of words, and the row of each."""
    lang, lists = phrases.column("lang").to_numpy(), phrases.column("p").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    begin, flat, found = np.cumsum(sizes) - sizes, lists.flatten().to_numpy().view(_U), {}
    for m in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == m)
        key = _key(lang[of])
        for j in range(m):
            key = _grow(key, flat[begin[of] + j])
        order = np.argsort(key)
        found[m] = key[order], of[order]
    return found


def _lists(words: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The ``size`` words from each position on."""
    flat = words[(at[:, None] + np.arange(size)).ravel()]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(tg.signed(flat)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in portions of about GROUP words, whatever the size of the batches."""
    for batch in batches:
        ends = batch.column(1).offsets.to_numpy()
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + GROUP, side="right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the token table put together: word array (rows apart by zeros), language of each position, own positions."""
    gap = LONGEST + 1
    for batch in _slices(batches):
        lang, lists = batch.column(0).to_numpy(), batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy().view(_U)
        begin = np.cumsum(sizes + gap) - (sizes + gap)
        words = np.zeros(len(flat) + gap * len(sizes), dtype=_U)
        words[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)) * gap, sizes)] = flat
        edge = np.zeros(len(words) + 1, dtype=np.int8)
        np.add.at(edge, begin + batch.column(2).to_numpy(), 1)
        np.add.at(edge, begin + batch.column(2).to_numpy() + batch.column(3).to_numpy(), -1)
        yield words, np.repeat(lang, sizes + gap), np.cumsum(edge[:-1], dtype=np.int8) > 0


def _phrases(words: np.ndarray, lang: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of ``at`` where a phrase of ``size`` words begins, and its keys."""
    key = _key(lang[at])
    for j in range(size):
        inside = at + j < len(words)
        at, key = at[inside], key[inside]
        w = words[at + j]
        at, key, w = at[w != 0], key[w != 0], w[w != 0]
        key = _grow(key, w)
    return at, key


def _among(keys: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(keys), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, first place of each distinct key in that order, and how often each occurs."""
    order = np.argsort(key)
    s = key[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, dtype=np.int64)
    return order, first, np.diff(np.append(first, len(s)))


def _portions(phrases: DataFrame, width: int) -> Iterator[pa.Table]:
    """``phrases`` (lang, p) in portions of at most ``width``, whatever their number."""
    parts = -(-phrases.count() // width)
    parts = parts if parts < 2 else 2 * parts
    for i in range(parts):
        table = phrases.where(F.pmod(F.xxhash64("lang", "p"), F.lit(parts)) == i).select("lang", "p").toArrow()
        for lo in range(0, table.num_rows, width):
            yield table.slice(lo, width).combine_chunks()


def extensions(tokens: DataFrame, prefixes: DataFrame, size: int, least: int, width: int, opened: pa.Table, complete: bool) -> DataFrame | None:
    """(lang, p, a): the phrases one word longer than those of ``prefixes`` (lang, p; ``size`` words) that occur ``least``
    times or more.

    A counted row has the number of the prefix and the word, which goes by its number too if it is one of ``opened``. An
    extension is as rare as its words without the first: where the second word is one of ``opened``, whose frequent
    phrases are all in ``prefixes``, that rest has to be there too. ``complete``: every frequent word is opened.
    """
    spark, found = tokens.sparkSession, None
    word_keys, word_rows = keys_of(opened)[1]
    whole = prefixes.count() <= width
    numbers = spark.createDataFrame(pa.table({"x": pa.array(np.arange(opened.num_rows)), "word": opened.column("p").combine_chunks().flatten()}))
    for table in _portions(prefixes, width):
        sent = spark.sparkContext.broadcast((*keys_of(table)[size], word_keys, word_rows))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            of, of_rows, of_words, of_word_rows = sent.value
            for words, lang, own in _grouped(batches):
                one, single = _phrases(words, lang, np.flatnonzero(words != 0), 1)
                place = np.minimum(np.searchsorted(of_words, single), len(of_words) - 1)
                known = of_words[place] == single
                code = words.copy()
                code[one[known]] = of_word_rows[place[known]].astype(_U)
                at, key = (one, single) if size == 1 else _phrases(words, lang, one, size)
                place = np.minimum(np.searchsorted(of, key), len(of) - 1)
                go = of[place] == key
                frequent = np.full(len(words) + 1, not whole)
                frequent[at[go]] = True
                if not complete:
                    frequent[one[~known]] = True
                at, prefix = at[go], of_rows[place[go]]
                more = own[at] & (words[at + size] != 0) & frequent[at + 1]
                at, prefix = at[more], prefix[more]
                x = code[at + size]
                order, first, many = _distinct(tg.mix(prefix.astype(_U) * _STEP + x))
                pick = order[first]
                yield pa.record_batch([pa.array(prefix[pick], pa.int32()), pa.array(tg.signed(x[pick])), pa.array(many, pa.int32())], names=["prefix", "x", "a"])

        rows = spark.createDataFrame(table.append_column("prefix", pa.array(np.arange(table.num_rows), pa.int32())))
        part = (tokens.mapInArrow(count, "prefix int, x long, a int").groupBy("prefix", "x").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
                .join(rows, "prefix").join(numbers, "x", "left")
                .select("lang", F.concat("p", F.array(F.coalesce("word", "x"))).alias("p"), "a"))
        found = part if found is None else found.unionByName(part)
    return None if found is None else materialise(found, "extensions")


def probe(tokens: DataFrame, phrases: DataFrame, width: int) -> DataFrame:
    """(lang, p, f, left, right): counts of ``phrases`` (lang, p), and whether all occurrences have one same neighbour a side."""
    found = None
    for table in _portions(phrases, width):
        sent = tokens.sparkSession.sparkContext.broadcast(keys_of(table))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for words, lang, own in _grouped(batches):
                for size, (known, _) in sent.value.items():
                    at, key = _phrases(words, lang, np.flatnonzero(own & (words != 0)), size)
                    go = _among(key, known)
                    at, key = at[go], key[go]
                    if not len(at):
                        continue
                    order, first, many = _distinct(key)
                    near = []
                    for side in (words[at - 1], words[at + size]):
                        s = tg.signed(side[order])
                        near += [pa.array(np.minimum.reduceat(s, first)), pa.array(np.maximum.reduceat(s, first))]
                    at = at[order[first]]
                    yield pa.record_batch([pa.array(lang[at]), _lists(words, at, size), pa.array(many), *near],
                                          names=["lang", "p", "f", "l0", "l1", "r0", "r1"])

        part = tokens.mapInArrow(count, "lang long, p array<long>, f long, l0 long, l1 long, r0 long, r1 long").groupBy("lang", "p").agg(
            F.sum("f").alias("f"), *[((F.min(f"{s}0") == F.max(f"{s}1")) & (F.min(f"{s}0") != 0)).alias(name) for s, name in (("l", "left"), ("r", "right"))])
        found = part if found is None else found.unionByName(part)
    if found is None:
        return phrases.select("lang", "p", F.lit(0).cast("long").alias("f"), F.lit(False).alias("left"), F.lit(False).alias("right"))
    return materialise(found, "probed")


def bounded(grown: DataFrame, words: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, p, a, n, bound) of candidates: the score of the cut before the last word, whose parts the tree has counted, and
    1000 n / f(first word) are both bounds. With two words the bound is the score."""
    one = words.select("lang", F.array("word").alias("p"), "f")
    counts = one.unionByName(grown.select("lang", "p", F.col("a").alias("f")))
    rows = grown.select("*", F.slice("p", F.lit(1), F.size("p") - 1).alias("first"), F.array(F.element_at("p", -1)).alias("last"), F.array(F.col("p")[0]).alias("head"))
    for name, of in (("first", counts), ("last", one), ("head", one)):
        rows = rows.join(of.select("lang", F.col("p").alias(name), F.col("f").alias(f"f_{name}")), ["lang", name])
    rows = rows.join(langs.select("lang", "n"), "lang")
    whole = f"cast({SCALE} as decimal(38,0))"
    return rows.select("lang", "p", "a", "n", F.expr(
        f"least(({whole} * a * n) div (cast(f_first as decimal(19,0)) * cast(f_last as decimal(19,0))), ({whole} * n) div f_head)").alias("bound"))


def scored(chosen: DataFrame, counts: DataFrame, probed: DataFrame) -> DataFrame:
    """(lang, p, a, l, r, n, score) of the candidates ``chosen`` that survive, by their lowest-scoring cut."""
    alive = (chosen.join(probed.select("lang", "p", "left", "right"), ["lang", "p"], "left")
             .where((F.size("p") == LONGEST) | ~(F.col("left") | F.col("right"))).select("lang", "p", "a", "n"))
    cuts = alive.select("*", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k")).withColumns(
        {"first": F.slice("p", F.lit(1), F.col("k")), "rest": F.slice("p", F.col("k") + 1, F.size("p"))})
    cuts = (cuts.join(counts.select("lang", F.col("p").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(counts.select("lang", F.col("p").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    # 38 digits hold 1000 a n and l r for counts up to 10^17
    cuts = cuts.withColumn("score", F.expr(f"(cast({SCALE} as decimal(38,0)) * a * n) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    return (cuts.groupBy("lang", "p").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c"))
            .select("lang", "p", "c.a", "c.l", "c.r", "c.n", "c.score"))


def _unsettled(rows: DataFrame, best: DataFrame | None, top: int) -> DataFrame:
    """Rows whose ``bound`` reaches the score of their language's last surviving row so far, ties included."""
    if best is None:
        return rows
    floor = best.groupBy("lang").agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).alias("floor"))
    return rows.join(floor, "lang", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).drop("floor")


def _foremost(rows: DataFrame, many: int) -> DataFrame:
    """About ``many`` rows of each language with high bounds: the first of each of 64 parts."""
    part = Window.partitionBy("lang", "_part").orderBy(F.desc("bound"), "p")
    return (rows.withColumn("_part", F.pmod(F.xxhash64("p"), F.lit(64))).withColumn("_at", F.row_number().over(part))
            .where(F.col("_at") <= max(1, many // 64)).drop("_part", "_at"))


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The rows of each language that are among its first ``top`` by score and count, ties included.

    First within 64 parts of a language, so that a language with most of the candidates is not ranked in one task.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("p"), F.lit(64)))
    for keys in (["lang", "_part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"))
        rows = rows.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= top).drop("_rank")
    return rows.drop("_part")


def spelled(docs: DataFrame, phrases: DataFrame, width: int) -> DataFrame:
    """(lang, p, phrase) of ``phrases`` (lang, p), read from the texts."""
    found = None
    for table in _portions(phrases, width):
        sent = docs.sparkSession.sparkContext.broadcast(keys_of(table))

        def spell(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                langs = batch.column(0).to_numpy()
                for block in tg.blocks(batch.column(1)):
                    out, begin, start, end = _laid_out(block)
                    lang = np.repeat(langs[block.lo:block.hi], np.diff(begin))
                    for size, (known, _) in sent.value.items():
                        at, key = _phrases(out, lang, np.flatnonzero(out), size)
                        go = _among(key, known)
                        at, key = at[go], key[go]
                        order, first, _ = _distinct(key)
                        at, texts = at[order[first]], []
                        for p in at.tolist():
                            texts.append(b" ".join(block.data[start[p + j]:end[p + j]].tobytes() for j in range(size)).lower())
                        new = [i for i, (k, t) in enumerate(zip(key[order[first]].tolist(), texts)) if (mark := b"%d %b" % (k, t)) not in seen and not seen.add(mark)]
                        if new:
                            yield pa.record_batch([pa.array(lang[at[new]]), _lists(out, at[new], size), pa.array([texts[i].decode() for i in new])],
                                                  names=["lang", "p", "phrase"])

        part = docs.mapInArrow(spell, "lang long, p array<long>, phrase string")
        found = part if found is None else found.unionByName(part)
    sure = F.when(F.min("phrase") == F.max("phrase"), F.min("phrase")).otherwise(F.raise_error(F.lit("two phrases share all hashes of their words")))
    return found.groupBy("lang", "p").agg(sure.alias("phrase"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` surviving phrases of every language.

    Null texts count as empty, a null lang as ``und``; repeated rows count each time. A language without candidates has no
    row, an empty table gives none. Ties in score and count are settled by the bytes of the phrase, after all tied phrases
    have been kept. Very long texts are split into rows of the token table that overlap, so no phrase is lost at a seam.
    Other columns of ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    texts = src.select(F.xxhash64("name").alias("lang"), "text")
    tokens = materialise(texts.mapInArrow(_tokens, "lang long, words array<long>, lead int, own int"), "tokens")
    words = materialise(tokens.select("lang", F.explode(F.slice("words", F.col("lead") + 1, F.col("own"))).alias("word")).where("word <> 0")
                        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")), "words")
    names = src.select("name").distinct().select(F.xxhash64("name").alias("lang"), "name")
    langs = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")).join(names, "lang"), "langs")
    words = words.where(F.col("f") >= least)
    frontier = (words.join(langs.select("lang", "n"), "lang")
                .select("lang", "word", F.expr(f"(cast({SCALE} as decimal(38,0)) * n) div f").alias("bound")))
    frontier = materialise(frontier, "frontier")
    all_words = frontier.count()
    best, last = None, None
    while True:
        todo = frontier
        if last is not None:
            b, lang, word = (F.lit(x) for x in last)
            todo = todo.where((F.col("bound") < b) | ((F.col("bound") == b) & ((F.col("lang") > lang) | ((F.col("lang") == lang) & (F.col("word") > word)))))
            todo = _unsettled(todo, best, top)
        opened = todo.orderBy(F.desc("bound"), "lang", "word").limit(width)
        level = materialise(opened, "opened")
        end = level.orderBy("bound", F.desc("lang"), F.desc("word")).first()
        if end is None:
            break
        level, grown = level.select("lang", F.array("word").alias("p")), None
        opened, complete = level.toArrow().combine_chunks(), last is None and all_words <= width
        for size in range(1, LONGEST):
            level = extensions(tokens, level, size, least, width, opened, complete)
            if level is None:
                break
            grown = level if grown is None else grown.unionByName(level)
        last = (end["bound"], end["lang"], end["word"])
        if grown is None:
            continue
        ranked = materialise(bounded(grown, words, langs), "ranked")
        counts = words.select("lang", F.array("word").alias("p"), "f").unionByName(grown.select("lang", "p", F.col("a").alias("f")))
        done = None
        while True:
            left = ranked if done is None else ranked.join(done.select("lang", "p"), ["lang", "p"], "left_anti")
            chosen = materialise(_foremost(_unsettled(left, best, top), 4 * top), "chosen")
            if chosen.isEmpty():
                break
            done = chosen if done is None else done.unionByName(chosen)
            rests = chosen.select("lang", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"), "p").where(F.size("p") - F.col("k") > 1).select(
                "lang", F.slice("p", F.col("k") + 1, F.size("p")).alias("p")).distinct().join(counts.select("lang", "p"), ["lang", "p"], "left_anti")
            need = materialise(chosen.where(F.size("p") < LONGEST).select("lang", "p").unionByName(rests).distinct(), "needed")
            probed = probe(tokens, need, width)
            more = counts.unionByName(probed.join(rests, ["lang", "p"], "left_semi").select("lang", "p", "f"))
            found = scored(chosen, more, probed)
            best = materialise(_best(found if best is None else best.unionByName(found), top), "best")
    if best is None:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = (best.join(spelled(texts, best, width), ["lang", "p"]).join(langs.select("lang", "name"), "lang")
           .select(F.col("name").alias("lang"), "phrase", "a", "l", "r", "n", "score").withColumn("rank", F.row_number().over(order)))
    return out.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
