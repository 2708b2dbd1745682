"""N-gram Jaccard self-join by universe partition, pigeonhole and one-deletion neighbourhoods (operator 2).

Every document is a set of word shingles. Sizes are cut into bands. In band b the universe of shingles is dealt by hash
into ``m`` segments, and a set's part in a segment is one key. Two sets of Jaccard similarity t differ in at most
``H = (1 - t) / (1 + t) * (|r| + |s|)`` shingles, so if r probes units that stand for H + 1 differences, one unit
survives: an exact segment stands for one, a segment with its one-deletion neighbourhood for two. Each set indexes its
own band and probes it, and the band below while that can hold a partner.

Allocation is by cost: a key that no other set has costs nothing and counts as probed; of the others r takes the
cheapest (fewest postings) until it has H + 1, so frequent keys are left out whenever rarer ones suffice. Empty segments
are never keys. Deletion keys are indexed in bands up to ``DELETION_BAND`` shingles; above, the slack of segments over
H + 1 does the same work with one key a segment. A set whose units cannot reach H + 1 (its shingles fell into very few
segments) is compared with the whole size band: that is the exact way for the rest.

Candidates are verified on the whole texts with integer arithmetic. Copies are folded first. Of each key's sets one is
compared with the others (a star) and what that links is connected. Then the units are allocated anew: a key that only
sets of one component have now costs nothing, and only pairs of different components are compared. Connectivity is exact
and a group of n near copies takes about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm import textgrid as tg
from cohortlens.operators.graph import components
from cohortlens.session import materialise

SHINGLE = 5
DELETION_BAND = 64
STARS, MANY_STARS, MANY = 2, 24, 48
CROWDED, SKETCH = 16, 1024
FULL, DELETED, SIZE = 0, 1, 2
POSTINGS = "key long, id long, band int, segment int, kind int, own boolean, twofold boolean, n int, units int"
MULTI = POSTINGS + ", count int"


def bands(limit: int = 1 << 31) -> list[int]:
    """Lower bounds of the size bands: 1, 2, 3, ... and from 6 on each 1.6 times the one before."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 8 // 5))
    return out


BANDS = bands()


def allowed(total: int, num: int, den: int) -> int:
    """Largest symmetric difference of two sets with ``total`` shingles together and Jaccard at least num / den."""
    return (den - num) * total // (den + num)


def segments(band: int, num: int, den: int) -> int:
    """Segments of a band: a tenth more than the largest H + 1 that a probing set can need."""
    top = BANDS[band + 1] - 1
    need = max(allowed(2 * top, num, den), allowed(top + top * den // num, num, den)) + 1
    return need + -(-need // 10)


def _keys(s: np.ndarray, band: int, m: int) -> tuple:
    """Segment numbers in use, shingles in each, their content sums, and the segment and mixed value of every shingle."""
    seg = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # s is sorted, so seg is
    val = tg.mix(s + np.uint64(band))
    at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    return seg[at], np.diff(np.append(at, len(s))), np.add.reduceat(val, at), seg, val, at


def _postings(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    ms: dict[int, int] = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for block in tg.blocks(batch.column(1)):
            cols: list[list[np.ndarray]] = [[] for _ in range(9)]

            def put(key: np.ndarray, *rest: object, cols: list = cols) -> None:
                n = len(key)
                for c, x in zip(cols, (tg.signed(key), *rest), strict=True):
                    c.append(x if isinstance(x, np.ndarray) else np.full(n, x))

            for i, s in enumerate(tg.shingle_sets(tg.words(block, lower=True), k)):
                n = len(s)
                if not n:
                    continue
                ident = int(ids[block.lo + i])
                own = int(np.searchsorted(BANDS, n, side="right")) - 1
                least = -(-n * num // den)
                for b in range(int(np.searchsorted(BANDS, least, side="right")) - 1, own + 1):
                    m = ms.get(b) or ms.setdefault(b, segments(b, num, den))
                    seg, occ, total, per, val, at = _keys(s, b, m)
                    small = BANDS[b + 1] <= DELETION_BAND
                    salt = tg.mix((seg << 8 | b).astype(np.uint64))
                    two = (occ > 1) & small
                    put(tg.mix(total ^ salt), ident, b, seg, FULL, b == own, two, 0, 0)
                    if small:
                        of = np.repeat(np.arange(len(at)), occ)
                        keep = occ[of] > 1
                        gone = (total[of] - val)[keep]
                        put(tg.mix(gone ^ salt[of][keep]), ident, b, per[keep], DELETED, b == own, True, 0, 0)
                    put(tg.mix(np.array([ident], dtype=np.int64).view(np.uint64)), ident, b, 0, SIZE, b == own, False, n,
                        len(seg) + int(two.sum()))
            if cols[0]:
                yield _rows([np.concatenate(c) for c in cols])


def _rows(cols: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())
    names = ("key", "id", "band", "segment", "kind", "own", "twofold", "n", "units", "count")
    arrays = [pa.array(c).cast(t) for c, t in zip(cols, kinds)]
    return pa.record_batch(arrays, names=list(names[:len(cols)]))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those whose key several rows have, with their number, and all SIZE rows.

    Only the last key of a batch is held over. When that alone fills a batch it is let go with the number so far; the
    number is a cost and need not be exact for so frequent a key.
    """
    held: pa.RecordBatch | None = None
    loose = None  # a key of which rows have been let go
    for batch in batches:
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        key = table.column("key").to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut == 0 and len(key) > 20_000:
            out, held, cut = table, None, len(key)
        else:
            out, held = table.slice(0, cut), table.slice(cut).to_batches()[0]
        if cut:
            yield from _counted(out, key[:cut], loose)
            loose = key[cut - 1] if held is None else (loose if loose == key[-1] else None)
    if held is not None:
        table = pa.Table.from_batches([held])
        yield from _counted(table, table.column("key").to_numpy(), loose)


def _counted(table: pa.Table, key: np.ndarray, loose: object) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(at, len(key)))
    if loose is not None and key[0] == loose:
        size[0] += 20_000
    count = np.repeat(size, np.diff(np.append(at, len(key))))
    keep = (count > 1) | (table.column("kind").to_numpy() == SIZE)
    if keep.any():
        table = table.append_column("count", pa.array(count.astype(np.int32))).filter(pa.array(keep))
        yield from table.combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose texts have Jaccard similarity num / den or more; rows of one ``a`` follow each other."""
    last: tuple = (None, None)
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        ta = batch.column(1)
        good = []
        for block in tg.blocks(batch.column(3)):
            for i, s in enumerate(tg.shingle_sets(tg.words(block, lower=True), k), block.lo):
                text = ta[i].as_py()
                if last[0] != text:
                    one = next(iter(tg.blocks(pa.array([text]))))
                    last = (text, next(iter(tg.shingle_sets(tg.words(one, lower=True), k))))
                r = last[1]
                if num * max(len(r), len(s)) > den * min(len(r), len(s)) or not len(r):
                    continue
                both = np.concatenate((r, s))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if den * common >= num * (len(r) + len(s) - common):
                    good.append(i)
        if good:
            yield pa.record_batch([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())],
                                  names=["src", "dst"])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash, as signed words of 64 bits."""
    bit = (tg.mix(s ^ np.uint64(SKETCH)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["id", *(f"b{i}" for i in range(SKETCH // 64))]
    for batch in batches:
        for block in tg.blocks(batch.column(1)):
            rows = np.array([sketch(s) for s in tg.shingle_sets(tg.words(block, lower=True), k)]).reshape(-1, SKETCH // 64)
            yield pa.record_batch([batch.column(0).slice(block.lo, block.hi - block.lo), *(pa.array(c) for c in rows.T.copy())], names=names)


def crowded_pairs(probe: DataFrame, index: DataFrame, sketches: DataFrame, fits: Column, num: int, den: int) -> DataFrame:
    """(r, s): the pairs that meet at a key and whose sketches differ in no more bits than the similarity allows."""
    words = [c for c in sketches.columns if c != "id"]
    mine = sketches.select(F.col("id").alias("r"), *(F.col(c).alias(f"r{c}") for c in words))
    theirs = sketches.select(F.col("id").alias("s"), *(F.col(c).alias(f"s{c}") for c in words))
    differ = sum((F.bit_count(F.col(f"r{c}").bitwiseXOR(F.col(f"s{c}"))) for c in words), F.lit(0))
    return (probe.join(mine, "r").join(index.join(theirs, "s"), "key")
            .where(fits & (differ * (den + num) <= (F.col("nr") + F.col("ns")) * (den - num))).select("r", "s"))


def link(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(src, dst): the pairs (a, b) of ids whose texts really are similar. ``texts``: (id, text)."""
    rows = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"))
    return materialise(rows.select("a", "ta", "b", "tb").sortWithinPartitions("a")
                       .mapInArrow(lambda it: _verify(it, k, num, den), "src long, dst long"), "links")


def allocate(keys: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id): the probes of every set. ``keys`` has the keys that cost something, with ``cost``; the units of all
    others are free. Each set takes the cheapest units until, with the free ones, it has H + 1."""
    per = keys.groupBy("id", "band", "segment").agg(F.sum(F.when(F.col("kind") == FULL, F.col("cost")).otherwise(0)).alias("c0"),
                                                    F.sum("cost").alias("c1"), F.max("twofold").alias("two"))
    unit = per.select("id", "band", "segment", F.explode(F.array(
        F.struct(F.lit(FULL).alias("unit"), F.col("c0").alias("cost")),
        F.struct(F.lit(DELETED).alias("unit"), F.when(F.col("two"), F.col("c1")).otherwise(0).alias("cost")))).alias("u")
    ).select("id", "band", "segment", "u.*").where("cost > 0")
    own = Window.partitionBy("id", "band")
    ranked = (unit.withColumn("rank", F.row_number().over(own.orderBy("cost", "segment", "unit")))
              .withColumn("paid", F.count(F.lit(1)).over(own)))
    probes = (ranked.join(lacking(sizes, num, den), ["id", "band"]).where("rank <= need + paid")
              .select("id", "band", "segment", F.col("unit").alias("kind")))
    return materialise(keys.join(probes, ["id", "band", "segment", "kind"]).select("key", "id").distinct(), "probes")


def lacking(sizes: DataFrame, num: int, den: int) -> DataFrame:
    """``need``: H + 1 less all units that the set has in the band. Above 0, probing every one of them is not enough."""
    tops = F.array(*[F.lit(x - 1) for x in BANDS[1:]])
    partner = F.least("n", F.element_at(tops, F.col("band") + 1))
    return sizes.select("id", "band", "n", (F.floor(F.lit(den - num) * (F.col("n") + partner) / (den + num)) + 1 - F.col("units")).alias("need"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = 80, den: int = 100
               ) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; two texts link at Jaccard similarity num / den or more.

    Null and empty texts, and texts without a word, have no shingles and stay alone. Repeated rows stay repeated. A text
    with fewer than k words is one shingle. An id with several texts links as any of them does and reports the largest set.
    A row with a null id is returned with the set and component of its copies, if it has any with an id, and is else not
    compared. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = src.withColumn("same", F.md5("text"))
    copies = materialise(marked.groupBy("same").agg(F.min("doc_id").alias("id")).where("id is not null"), "copies")
    firsts = copies.select(F.col("id").alias("doc_id"), "same")
    texts = marked.join(firsts, ["doc_id", "same"], "left_semi").select(F.col("doc_id").alias("id"), "text")
    posted = materialise(texts.mapInArrow(lambda it: _postings(it, k, num, den), POSTINGS).repartition("key")
                         .sortWithinPartitions("key").mapInArrow(_shared, MULTI), "postings")
    sizes = materialise(posted.where(F.col("kind") == SIZE).select("id", "band", "own", "n", "units").distinct(), "sizes")
    size = sizes.groupBy("id").agg(F.max("n").alias("n"))
    multi = posted.where(F.col("kind") != SIZE).select("key", "id", "band", "segment", "kind", "own", "twofold", (F.col("count") - 1).alias("cost"))

    chosen = allocate(multi, sizes, num, den)
    met = chosen.select("key").distinct()
    buckets = materialise(multi.where("own").select("key", "id").join(met, "key", "left_semi").unionByName(chosen).distinct(), "buckets")
    involved = materialise(src.withColumnRenamed("doc_id", "id").join(buckets.select("id").distinct(), "id", "left_semi"), "texts")
    # The order that names a key's first set is one of STARS, of MANY_STARS in keys of MANY sets or more: a set meets a
    # fixed number of others of a large group, so near copies that are similar to some of the group, but not to all, connect.
    first = [F.min(F.struct(F.xxhash64("id", F.pmod("key", F.lit(n))).alias("h"), F.col("id").alias("f")))["f"] for n in (STARS, MANY_STARS)]
    leader = materialise(buckets.groupBy("key").agg(F.when(F.count(F.lit(1)) < MANY, first[0]).otherwise(first[1]).alias("f")), "leaders")
    star = _near(buckets.join(leader, "key").where("id <> f").select(F.least("id", "f").alias("a"), F.greatest("id", "f").alias("b")).distinct(),
                 size, num, den)
    found = link(star, involved, k, num, den)

    group = components(found).withColumnsRenamed({"node": "id", "component": "c"})
    placed = multi.drop("cost").join(group, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("all")).where("x < y").select("key", "all")
    open_ = materialise(placed.join(mixed, "key"), "open")
    inside = materialise(open_.groupBy("key", "c").agg(F.count(F.lit(1)).alias("mine")), "inside")
    asking = allocate(open_.join(inside, ["key", "c"]).withColumn("cost", F.col("all") - F.col("mine")), sizes, num, den)
    facts = sizes.where("own").select("id", "n").join(group, "id", "left").select("id", "n", F.coalesce("c", "id").alias("c"))
    probe = asking.join(facts, "id").select("key", F.col("id").alias("r"), F.col("n").alias("nr"), F.col("c").alias("cr"))
    index = (open_.where("own").select("key", "id", "c").join(size, "id").join(asking.select("key").distinct(), "key", "left_semi")
             .select("key", F.col("id").alias("s"), F.col("n").alias("ns"), F.col("c").alias("cs")))
    fits = (F.col("ns") <= F.col("nr")) & (F.col("ns") * den >= F.col("nr") * num)
    apart = fits & (F.col("cr") != F.col("cs"))
    crowded = materialise(open_.where(F.col("all") >= CROWDED).select("key").distinct(), "crowded")
    dense_r, dense_s = (materialise(x.join(crowded, "key", "left_semi"), "dense") for x in (probe, index))
    dense = dense_r.select(F.col("r").alias("id")).unionByName(dense_s.select(F.col("s").alias("id"))).distinct()
    sketches = materialise(involved.join(dense, "id", "left_semi").distinct()
                           .mapInArrow(lambda it: _sketches(it, k), ", ".join(["id long", *(f"b{i} long" for i in range(SKETCH // 64))])), "sketches")
    cross = (probe.join(crowded, "key", "left_anti").join(index, "key").where(apart).select("r", "s")
             .unionByName(crowded_pairs(dense_r, dense_s, sketches, apart, num, den)))
    short = lacking(sizes, num, den).where("need > 0").select(F.col("id").alias("r"), "band", F.col("n").alias("nr"))
    rest = (short.join(sizes.where("own").select(F.col("id").alias("s"), "band", F.col("n").alias("ns")), "band")
            .where(fits & (F.col("r") != F.col("s"))).select("r", "s"))
    again = (cross.unionByName(rest).select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()
             .join(star, ["a", "b"], "left_anti"))
    unplaced = src.withColumnRenamed("doc_id", "id").join(rest.select(F.explode(F.array("r", "s")).alias("id")).distinct(), "id", "left_semi")
    second = link(materialise(again, "pairs"), involved.unionByName(unplaced).distinct() if not short.isEmpty() else involved, k, num, den)
    group = components(found.unionByName(second))
    known = (copies.join(size, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
             .select("same", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("c")))
    return (marked.select("doc_id", "same").join(known, "same", "left")
            .select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"),
                    F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id")))


def _near(pairs: DataFrame, size: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes allow the similarity."""
    a, b = size.withColumnsRenamed({"id": "a", "n": "na"}), size.withColumnsRenamed({"id": "b", "n": "nb"})
    return materialise(pairs.join(a, "a").join(b, "b")
                       .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b"), "pairs")


def keep_first(docs: DataFrame, **how: object) -> DataFrame:
    """``docs`` without the documents that link to one with a smaller ``doc_id``. Repeated rows of a kept id stay, and so do
    rows without an id."""
    later = materialise(ngram_join(docs, **how).where("doc_id <> component_id").select("doc_id").distinct(), "later")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
