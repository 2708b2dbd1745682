"""Clustered bootstrap: whole groups are resampled, the threshold stays fixed, and all replicates are one Spark job.

A draw is a hash of (seed, replicate, slot), so it can be repeated anywhere and runs over the same groups share it. All
replicates travel together as vectors, so the shuffled rows do not depend on their number.

Predictions meet the multiplicities by blocks of groups (``_by_blocks``): a block's rows, packed before the shuffle, and
its vectors of multiplicities, one byte per group and replicate, come to the same task, which adds up for every distinct
score (a cell) the vectors of its groups, eight replicates at a time while no byte can overflow. What leaves a task is one
vector for each cell; these are then walked by ranges of (keys, score). No row is sorted, and no task sees more
multiplicities than a block's.

With more distinct scores than a task can hold vectors for (``CELLS``) the predictions themselves are shuffled by ranges
of (keys, score) and walked in order. The multiplicities are then sent to the tasks in slices of replicates of at most
``WIDTH`` bytes; should a single replicate be larger, the draws are joined in blocks of replicates instead. Poisson
multiplicities need neither: a task computes them from the hash of the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.hashing import h60
from cohortlens.operators import metrics, ranking
from cohortlens.session import arrow_batches, materialise

# ---- fixed values
N_BOOT = 1000
KEYS = ["auroc", "sensitivity", "specificity", "flag_rate", "false_negatives"]
PAIRED_KEYS = ["auroc", "sensitivity", "specificity", "flag_rate"]
BLOCK = 25  # replicates that share one row where draws are joined
WIDTH = 1 << 27
WORD = 60  # runs that share a number, one bit each
CHUNK = 8192  # rows that a task adds up at once
ROWS = 256  # rows whose multiplicities it looks up at once
GROUPS = 1024  # groups of a block, on average
MOST = 1 << 24  # groups that can be dealt into blocks, four bytes each in every task that draws
CELLS = 1 << 14  # distinct (keys, score, class) of a unit that a task holds vectors for; 64 times as many of all units
PACK = 1 << 21  # rows that a task packs at once
HELD = 1 << 20  # rows of a block that a task adds up at once
DRAWN = 1 << 25  # bytes of multiplicities that a task holds before it sends them
WIDE = 1 << 15  # bytes of a packed row
BATCH = 2000  # rows sent to Python at once, so packed ones come to 64 MB at most
LANE = 1 << 13  # numbers that are hashed at once


def _numbered(groups: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, group_id, _i, _g, _id, _n): position in the order of the group's MD5, groups of the unit, number among all, rows."""
    held = materialise(groups.groupBy(*unit, "group_id").agg(F.count(F.lit(1)).alias("_n")), "units")
    indexed = ranking.hash_index(held, unit, F.col("group_id"), "_i")
    sizes = indexed.groupBy(*unit).agg(F.count(F.lit(1)).alias("_g"))
    before = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)  # one row per unit
    sizes = sizes.withColumn("_from", F.coalesce(F.sum("_g").over(before), F.lit(0)))
    return materialise(indexed.join(sizes, unit).select(*unit, "group_id", "_i", "_g", (F.col("_from") + F.col("_i")).alias("_id"), "_n"), "groups")


def _slots(numbered: DataFrame, lo: int, hi: int, seed: int) -> DataFrame:
    """(_id of the group drawn, _b): every group owns one slot; slot s of replicate b holds the group at position
    ``h60(seed:b:s) mod G``. G draws with replacement from G groups, as in the plain bootstrap."""
    spread = numbered.repartition(numbered.sparkSession.sparkContext.defaultParallelism, "_id")  # small rows, but much to hash for each
    slots = spread.withColumn("_b", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
    pick = F.pmod(h60(F.concat_ws(":", F.lit(seed), "_b", "_i")), F.col("_g"))
    return slots.select((F.col("_id") - F.col("_i") + pick).alias("_id"), "_b")


def _hashed(head: bytes, n: int) -> np.ndarray:
    """The first 60 bits of the MD5 of ``head`` followed by each of the numbers 0 to n - 1, many numbers at a time."""
    out = np.empty(n, dtype=np.int64)
    digits = 1
    while (lo := 10 ** (digits - 1) if digits > 1 else 0) < n:
        size = len(head) + digits
        for at in range(lo, min(10 ** digits, n), LANE):
            x = np.arange(at, min(at + LANE, 10 ** digits, n))
            if size > 55:  # more than one block of the hash
                out[x] = [int.from_bytes(hashlib.md5(head + b"%d" % i).digest()[:8]) >> 4 for i in x.tolist()]
                continue
            text = np.zeros((64, len(x)), dtype=np.uint8)
            text[:len(head)] = np.frombuffer(head, dtype=np.uint8)[:, None]
            for k in range(digits):
                text[len(head) + k] = 48 + x // 10 ** (digits - 1 - k) % 10
            text[size], text[56], text[57] = 128, size * 8 % 256, size * 8 // 256
            one, two = _md5_words(text, len(head) // 4, (size - 1) // 4)
            out[x] = ((one.byteswap().astype(np.uint64) << np.uint64(32) | two.byteswap()) >> np.uint64(4)).astype(np.int64)
        digits += 1
    return out


_SINES = [np.uint32(int(abs(np.sin(np.float64(i + 1))) * 2 ** 32)) for i in range(64)]
_TURNS = [t for ts in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in ts * 4]


def _md5_words(text: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of many messages of one block, a column each; they differ in words first to last only."""
    words = []
    for k in range(16):
        cols = text[4 * k:4 * k + 4] if first <= k <= last else text[4 * k:4 * k + 4, :1]
        w = cols[0].astype(np.uint32) | cols[1].astype(np.uint32) << 8 | cols[2].astype(np.uint32) << 16 | cols[3].astype(np.uint32) << 24
        words.append(w)
    start = [np.full(text.shape[1], v, dtype=np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start[0].copy(), start[1], start[2], start[3]
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            at = i
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            at = 7 * i % 16
        np.add(f, a, out=f), np.add(f, words[at] + _SINES[i], out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t), np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f), np.bitwise_or(f, t, out=f)
        a, d, c, b = d, c, b, f + b
    return start[0] + a, start[1] + b


def _counted(units: list[int], seed: int, b: int) -> np.ndarray:
    """How often replicate b draws each group, unit after unit; a group drawn more than 255 times raises."""
    h = _hashed(b"%d:%d:" % (seed, b), max(units))
    counts = np.concatenate([np.bincount(h[:g] % g, minlength=g) for g in units])
    if counts.max() > 255:
        raise ValueError("a group was drawn more than 255 times")
    return counts.astype(np.uint8)


def _unit_sizes(numbered: DataFrame) -> list[int]:
    sizes = numbered.groupBy((F.col("_id") - F.col("_i")).alias("_from")).agg(F.max("_g").alias("_g")).orderBy("_from").collect()
    return [r["_g"] for r in sizes]  # one row a unit


def _multiplicities(numbered: DataFrame, total: int, lo: int, hi: int, seed: int) -> np.ndarray:
    """Bytes of (group, replicate) for replicates lo:hi; a group drawn 255 times or more in one of them raises. A task makes
    the same draws as ``_slots`` for whole replicates, so that nothing is shuffled; units share the hashes of a replicate."""
    units = _unit_sizes(numbered)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([b]), pa.array([_counted(units, seed, b).tobytes()], pa.binary())], names=["b", "w"])

    spark = numbered.sparkSession
    if not units:
        return np.zeros((0, hi - lo), dtype=np.uint8)
    tasks = min(hi - lo, 4 * spark.sparkContext.defaultParallelism)
    table = spark.range(lo, hi, 1, tasks).mapInArrow(drawn, "b long, w binary").toArrow()
    out = np.zeros((total, hi - lo), dtype=np.uint8)
    for b, w in zip(table.column("b").to_pylist(), table.column("w")):
        out[:, b - lo] = np.frombuffer(w.as_buffer(), dtype=np.uint8)
    return out


def _steps() -> list[float]:
    """Distribution function of Poisson(1) as far as a 64-bit number can tell."""
    steps, mass, cum = [], float(np.exp(-1.0)), 0.0
    for k in range(22):
        cum += mass
        steps.append(cum)
        mass /= k + 1
    return steps


def _poisson(group: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """Independent Poisson(1) multiplicities (Chamandy et al. 2012) from hashes of groups: for very many groups. The sum
    over the groups is G only on average."""

    def mixed(x: np.ndarray) -> np.ndarray:
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x

    replicate = mixed(np.arange(lo, hi, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 1))
    u = (mixed(group.view(np.uint64)[:, None] ^ replicate) >> np.uint64(11)).astype(float) / 2.0 ** 53
    return np.searchsorted(_steps(), u, side="right").astype(np.uint8)


def _lanes(w: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers, eight replicates in each."""
    return np.ascontiguousarray(np.pad(w, ((0, 0), (0, -w.shape[1] % 8)))).view(np.uint64)


def _segment_sums(weigh: Callable[[np.ndarray], np.ndarray], group: np.ndarray, first: np.ndarray, top: int, n: int) -> np.ndarray:
    """Sums of the multiplicities of the groups from each of ``first`` to the next one, looked up a few rows at a time so that
    they stay in the processor's cache. ``top`` is the largest multiplicity: as many rows as cannot carry from one byte into
    the next are added as whole numbers."""
    k = max(1, 255 // max(top, 1))
    step = max(1, ROWS // k) * k
    out = np.zeros((len(first), n), dtype=np.int64)
    for i, (a, b) in enumerate(zip(first, [*first[1:], len(group)])):
        for at in range(a, b, step):
            w = weigh(group[at:min(at + step, b)])
            full = len(w) // k * k
            if full:
                out[i] += w[:full].reshape(full // k, k, -1).sum(axis=1, dtype=np.uint64).view(np.uint8)[:, :n].sum(axis=0, dtype=np.int64)
            if full < len(w):
                out[i] += w[full:].sum(axis=0, dtype=np.uint64).view(np.uint8)[:n]
    return out


def _walk(keys: list[str], n: int, add_up: Callable[[pa.Array, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's pass over rows in the order (keys, score): one row of vectors for every key it sees. ``add_up`` gives the sums
    of the rows' vectors from each of some positions to the next one."""

    class Sums:
        def __init__(self, key: list, score: float) -> None:
            self.key, self.lo, self.score = key, score, score
            self.p, self.n, self.tp, self.fp, self.won, self.pos, self.neg = (np.zeros(n) for _ in range(7))

        def add(self, score: np.ndarray, y: np.ndarray, passes: np.ndarray, w: pa.Array) -> None:
            """Rows of one key in order of the score; the last score stays open, as it may go on in the next rows."""
            first = np.flatnonzero(np.concatenate(([True], (score[1:] != score[:-1]) | (y[1:] != y[:-1]))))
            sums = add_up(w, first)
            value, kind, passes = score[first], y[first] == 1, passes[first]
            new = np.concatenate(([value[0] != self.score], value[1:] != value[:-1]))
            at = np.cumsum(new)
            pos, neg = np.zeros((at[-1] + 1, n)), np.zeros((at[-1] + 1, n))
            pos[0], neg[0] = self.pos, self.neg
            for of, into in ((kind, pos), (~kind, neg)):
                np.add.at(into, at[of], sums[of])
            below = np.cumsum(neg, axis=0) - neg + self.n - self.neg
            self.won += (pos[:-1] * (below[:-1] + neg[:-1] / 2)).sum(axis=0)
            self.p += sums[kind].sum(axis=0)
            self.n += sums[~kind].sum(axis=0)
            self.tp += sums[kind & passes].sum(axis=0)
            self.fp += sums[~kind & passes].sum(axis=0)
            self.pos, self.neg, self.score = pos[-1], neg[-1], value[-1]

        def row(self) -> list:
            won = self.won + self.pos * (self.n - self.neg + self.neg / 2)
            return [*self.key, self.lo, self.p, self.n, self.tp, self.fp, won]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mark = None, None
        for batch in batches:
            m = batch.num_rows
            key, score, y, passes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "score", "y", "_passes"))
            w = batch.column("_w")
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1 if m else []
            for lo, hi in zip([0, *cuts], [*cuts, m], strict=True):
                if lo == hi:
                    continue
                if now is None or key[lo] != mark:
                    if now is not None:
                        yield emitted([now.row()], batch.schema)
                    now, mark = Sums([batch.column(c)[lo].as_py() for c in keys], score[lo]), key[lo]
                for a in range(lo, hi, CHUNK):
                    part = slice(a, min(a + CHUNK, hi))
                    now.add(score[part], y[part], passes[part], w[part])
            schema = batch.schema
        if now is not None:
            yield emitted([now.row()], schema)

    def emitted(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows))
        k = len(keys)
        return pa.record_batch([*[pa.array(list(c), schema.field(name).type) for c, name in zip(cols, keys)], pa.array(list(cols[k]), pa.float64()),
                                *[pa.array([v.tolist() for v in c], pa.list_(pa.float64())) for c in cols[k + 1:]]],
                               names=[*keys, "_lo", "_p", "_n", "_tp", "_fp", "_won"])

    return run


def _of_groups(top: int, n: int, weigh: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Array, np.ndarray], np.ndarray]:
    """Sums of rows that carry the number of their group."""
    return lambda w, first: _segment_sums(weigh, w.to_numpy(zero_copy_only=False), first, top, n)


def _of_vectors(n: int) -> Callable[[pa.Array, np.ndarray], np.ndarray]:
    """Sums of rows that carry a vector, of four or eight bytes a number."""

    def add_up(w: pa.Array, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first), n), dtype=np.int64)
        for i, (a, b) in enumerate(zip(first, [*first[1:], len(w)])):
            for at in range(a, b):
                v = w[at].as_buffer()
                out[i] += np.frombuffer(v, dtype=np.int32 if v.size == 4 * n else np.int64)
        return out

    return add_up


def _summed(ranged: DataFrame, keys: list[str], lo: int, n: int, add_up: Callable[[pa.Array, np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, b, n_pos, n_neg, tp, false_positives, auroc) of replicates lo:lo+n."""
    kinds = dict(ranged.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "_lo double", *[f"{c} array<double>" for c in ("_p", "_n", "_tp", "_fp", "_won")]])
    parts = ranged.mapInArrow(_walk(keys, n, add_up), schema)
    each = parts.select(*keys, "_lo", F.posexplode(F.arrays_zip("_p", "_n", "_tp", "_fp", "_won")).alias("b", "_v")).select(
        *keys, "_lo", (F.col("b") + lo).alias("b"), "_v.*")
    before = Window.partitionBy(*keys, "b").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    joined = each.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0.0)))
    p, neg = F.sum("_p"), F.sum("_n")
    return joined.groupBy(*keys, "b").agg(F.try_divide(F.sum(F.col("_won") + F.col("_p") * F.col("_before")), p * neg).alias("auroc"),
                                          *[F.sum(c).cast("bigint").alias(name) for c, name in (("_p", "n_pos"), ("_n", "n_neg"), ("_tp", "tp"), ("_fp", "false_positives"))])


def _by_join(scored: DataFrame, numbered: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """The same from draws joined in blocks of replicates, for more groups than a task can know the draws of."""
    block = F.floor(F.col("_b") / BLOCK).cast("int")
    draws = materialise(_slots(numbered, 0, n_boot, seed).groupBy("_id", block.alias("block")).agg(*[
        F.count_if(F.col("_b") % BLOCK == k).alias(f"w{k}") for k in range(BLOCK)]), "draws")
    rows = scored.join(draws, F.col("_w") == F.col("_id"))
    sums = rows.groupBy(*keys, "threshold", "score", "block", "y").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(BLOCK)])
    each = F.posexplode(F.array(*[F.col(f"w{k}") for k in range(BLOCK)])).alias("_k", "_w")
    flat = (sums.select(*keys, "threshold", "score", "block", "y", each).where("_w > 0")
            .select(*keys, "threshold", "score", (F.col("block") * BLOCK + F.col("_k")).alias("b"),
                    F.when(F.col("y") == 1, F.col("_w")).otherwise(0).alias("pos"),
                    F.when(F.col("y") == 0, F.col("_w")).otherwise(0).alias("neg")).where(F.col("b") < n_boot))
    return metrics.auroc_from_counts(flat, [*keys, "threshold", "b"], "threshold").drop("threshold")


def _cells(rows: DataFrame, keys: list[str], unit: list[str]) -> DataFrame | None:
    """(keys, score, _like, _key, _unit, _neg, _pos, _passes): the distinct scores of every key with the numbers of their
    negatives and positives, counted from 0 in each unit; rows without a score share one. ``_like`` is a hash that tells them
    apart. None if there are too many, or two of one hash."""
    pos = F.coalesce(F.col("y") == 1, F.lit(False))
    seen = materialise(rows.groupBy(*keys, "score").agg(F.max((~pos).cast("int")).alias("_n"), F.max(pos.cast("int")).alias("_p"),
                                                        F.max(F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))).alias("_passes"))
                       .withColumn("_like", F.xxhash64(*keys, "score")), "scores")
    sizes = seen.groupBy(*unit).agg(F.sum(F.col("_n") + F.col("_p")).alias("_c")).agg(F.max("_c").alias("most"), F.sum("_c").alias("all")).first()
    if not sizes["all"] or sizes["most"] > CELLS or sizes["all"] > 64 * CELLS or seen.groupBy("_like").count().where("count > 1").head(1):
        return None
    rest = [c for c in keys if c not in unit]
    here = Window.partitionBy("_unit").orderBy("_key", "score").rowsBetween(Window.unboundedPreceding, -1)
    one = seen.withColumns({"_unit": F.dense_rank().over(Window.orderBy(*unit)) - 1, "_key": F.dense_rank().over(Window.orderBy(*unit, *rest)) - 1})
    before = F.coalesce(F.sum(F.col("_n") + F.col("_p")).over(here), F.lit(0)).cast("int")  # as few rows as the test above allows
    return materialise(one.withColumn("_neg", before).withColumn("_pos", F.col("_neg") + F.col("_n")), "cells")


def _pack(part_of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (_slot, _h, _cell) as one row for each slot among many: the hashes of its groups, then its cells. ``part_of``: the
    task of each slot."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        slot, h, cell = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("_slot", "_h", "_cell"))
        order = np.argsort(slot.astype(np.uint16) if slot.max() < 1 << 16 else slot, kind="stable")
        slot, h, cell = slot[order], h[order], cell[order].astype(np.uint16)
        cuts = [0, *np.flatnonzero(slot[1:] != slot[:-1]) + 1, len(slot)]
        cuts = [x for a, b in zip(cuts, cuts[1:]) for x in range(a, b, WIDE // 10)] + [len(slot)]
        w = [h[a:b].tobytes() + cell[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return _sent(slot[cuts[:-1]], 2, 0, w, part_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACK:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    return run


def _sent(slots: np.ndarray, kind: int, first: int, w: list[bytes], part_of: np.ndarray) -> pa.RecordBatch:
    """One row a slot with the task it goes to."""
    whole = [np.full(len(slots), v, dtype=np.int32) for v in (kind, first)]
    return pa.record_batch([pa.array(part_of[slots]), pa.array(slots.astype(np.int32)), *map(pa.array, whole), pa.array(w, pa.binary())],
                           names=["_part", "_slot", "_kind", "_first", "_w"])


def _tally(n: int, lo: int, unit_of: np.ndarray, cells_of: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's pass over slots: of each the hashes of its groups, their multiplicities, and its rows. It gives for every
    (unit, cell) the sum of the multiplicities of its rows, and for every key the number of groups that have it.
    ``unit_of``: the unit of each slot; ``cells_of``: the key of each cell of a unit, counted from the unit's first."""

    class Unit:
        def __init__(self, number: int) -> None:
            self.number, self.key = number, cells_of[number]
            self.sums = np.zeros((len(self.key), n), dtype=np.int64)
            self.groups = np.zeros(self.key.max() + 1, dtype=np.int64)

        def batches(self) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(self.groups)
            yield rows(self.number, at, self.groups[at], [None] * len(at))
            full = np.flatnonzero(self.sums.any(axis=1))
            kind = np.int32 if self.sums.max(initial=0) < 1 << 31 else np.int64
            for i in range(0, len(full), 256):
                part = full[i:i + 256]
                yield rows(self.number, part, np.zeros(len(part), dtype=np.int64), [v.tobytes() for v in self.sums[part].astype(kind)])

    class Block:
        def __init__(self, slot: int, hashes: np.ndarray, unit: Unit) -> None:
            self.slot, self.hashes, self.unit = slot, hashes, unit
            self.bytes = np.zeros((len(hashes), n + -n % 8), dtype=np.uint8)
            self.has = np.zeros((len(hashes), len(unit.groups)), dtype=bool)
            self.held: list[tuple[np.ndarray, np.ndarray]] = []
            self.rows = 0

        def draws(self, first: int, w: bytes) -> None:
            part = np.frombuffer(w, dtype=np.uint8).reshape(len(self.hashes), -1)
            self.bytes[:, first - lo:first - lo + part.shape[1]] = part

        def take(self, w: bytes) -> None:
            m = len(w) // 10
            self.held.append((np.frombuffer(w, dtype=np.int64, count=m), np.frombuffer(w, dtype=np.uint16, offset=8 * m)))
            self.rows += m
            if self.rows >= HELD:
                self.add()

        def add(self) -> None:
            if not self.rows:
                return
            h, cell = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.rows = [], 0
            group = np.searchsorted(self.hashes, h).astype(np.int32)
            if group.max() >= len(self.hashes) or (self.hashes[group] != h).any():
                raise ValueError("a group of the predictions has no number")
            self.has[group, self.unit.key[cell]] = True
            order = np.argsort(cell, kind="stable")
            cell, group = cell[order], group[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            lanes = self.bytes.view(np.uint64)
            self.unit.sums[cell[first]] += _segment_sums(lambda g: lanes.take(g, axis=0), group, first, int(self.bytes.max(initial=0)), n)

        def close(self) -> None:
            self.add()
            self.unit.groups += self.has.sum(axis=0)

    def rows(number: int, at: np.ndarray, groups: np.ndarray, w: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(at), number, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(groups), pa.array(w, pa.binary())],
                               names=["_unit", "_at", "_groups", "_w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block = None, None
        for batch in batches:
            slots, kinds, firsts = (batch.column(c).to_pylist() for c in ("_slot", "_kind", "_first"))
            for i, (slot, kind) in enumerate(zip(slots, kinds)):
                if kind == 0:
                    if block is not None:
                        block.close()
                    if unit is None or unit.number != unit_of[slot]:
                        if unit is not None:
                            yield from unit.batches()
                        unit = Unit(int(unit_of[slot]))
                    block = Block(slot, batch.column("_hashes")[i].values.to_numpy(), unit)
                elif kind == 1:
                    block.draws(firsts[i], batch.column("_w")[i].as_buffer())
                else:
                    block.take(batch.column("_w")[i].as_buffer())
        if block is not None:
            block.close()
            yield from unit.batches()

    return run


def _by_blocks(rows: DataFrame, numbered: DataFrame, total: int, cells: DataFrame, keys: list[str], unit: list[str], n_boot: int,
               seed: int) -> tuple[DataFrame, DataFrame] | None:
    """(_key, b, ...) of all replicates and (_key, n_groups), from rows and multiplicities that meet by blocks of groups.

    Groups are dealt into blocks by a hash. A block with more than a fair share of the rows is cut by keys into several
    slots, and consecutive slots with a fair share of the rows are one task's. None if two groups of a block have one hash.
    """
    spark = rows.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    units = cells.groupBy(*unit, "_unit").agg(F.countDistinct("_key").alias("_keys"))
    sizes = units.join(numbered.groupBy(*unit).agg(F.max("_g").alias("_g")), unit).withColumn("_parts", F.ceil(F.col("_g") / GROUPS).cast("int"))
    before = Window.orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)  # one row a unit
    sizes = materialise(sizes.withColumn("_base", F.coalesce(F.sum("_parts").over(before), F.lit(0)).cast("int")), "units")
    h = F.xxhash64(*unit, "group_id")
    block = (F.col("_base") + F.pmod("_h", F.col("_parts"))).cast("int")
    placed = materialise(numbered.join(sizes.select(*unit, "_unit", "_keys", "_base", "_parts"), unit).withColumn("_h", h)
                         .select("_id", "_n", "_h", block.alias("_block"), "_unit", "_keys"), "placed")
    share = max(1, -(-placed.agg(F.sum("_n")).first()[0] // tasks))
    cut = F.least("_keys", F.greatest(F.lit(1), F.ceil(F.sum("_n") / share))).cast("int")
    blocks = placed.groupBy("_block", "_unit", "_keys").agg(F.sum("_n").alias("_n"), cut.alias("_cut"), F.count(F.lit(1)).alias("_groups"),
                                                            F.sort_array(F.collect_list("_h")).alias("_hashes"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = materialise(blocks.withColumns({"_slot0": F.coalesce(F.sum("_cut").over(before), F.lit(0)).cast("int"),
                                             "_before": F.coalesce(F.sum("_n").over(before), F.lit(0))}), "blocks")
    if blocks.where(F.size(F.array_distinct("_hashes")) < F.size("_hashes")).head(1):
        return None
    each = F.explode(F.sequence(F.lit(0), F.col("_cut") - 1))
    part = F.floor((F.col("_before") + F.col("_n") * F.col("_piece") / F.col("_cut")) / share).cast("int")
    slots = materialise(blocks.withColumn("_piece", each).select(
        "_block", "_unit", (F.col("_slot0") + F.col("_piece")).cast("int").alias("_slot"), F.least(part, F.lit(tasks - 1)).alias("_part"), "_hashes"), "slots")

    listed = slots.orderBy("_slot").select("_unit", "_part", "_block").toArrow()  # one row a slot
    units_of, part_of, block_of = (listed.column(c).to_numpy() for c in ("_unit", "_part", "_block"))
    table = cells.select("_unit", "_key", "_neg", "_pos", "_n", "_p").toArrow().to_pydict()
    counts = np.bincount(table["_unit"], np.add(table["_n"], table["_p"])).astype(int)
    least = [min(k for k, w in zip(table["_key"], table["_unit"]) if w == i) for i in range(len(counts))]
    cells_of = [np.zeros(c, dtype=np.int64) for c in counts]
    for w, k, neg, pos, n, p in zip(*(table[c] for c in ("_unit", "_key", "_neg", "_pos", "_n", "_p"))):
        cells_of[w][neg:pos + p] = k - least[w]

    found = cells.select("_like", "_unit", "_key", "_neg", "_pos").join(sizes.select("_unit", "_base", "_parts"), "_unit").drop("_unit")
    number = F.when(F.coalesce(F.col("y") == 1, F.lit(False)), F.col("_pos")).otherwise(F.col("_neg"))
    sent = (rows.select(F.xxhash64(*keys, "score").alias("_like"), h.alias("_h"), "y")
            .join(materialise(found, "found"), "_like").select("_h", "_key", number.alias("_cell"), block.alias("_block"))
            .join(materialise(blocks.select("_block", "_slot0", "_cut"), "cuts"), "_block")
            .select((F.col("_slot0") + F.pmod("_key", F.col("_cut"))).cast("int").alias("_slot"), "_h", "_cell"))
    form = "_part int, _slot int, _kind int, _first int, _w binary"
    packed = sent.mapInArrow(_pack(part_of), form)
    if n_boot > N_BOOT:
        with arrow_batches(spark, BATCH):
            packed = materialise(packed, "packed")
    order = spark.sparkContext.broadcast(placed.orderBy("_block", "_h").select(F.col("_id").cast("int")).toArrow().column(0).to_numpy())
    ends = spark.sparkContext.broadcast(np.cumsum([0, *[r[0] for r in blocks.orderBy("_block").select("_groups").collect()]]))  # one row a block
    of_units = _unit_sizes(numbered)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, min(DRAWN // total, WIDE // GROUPS))
        for batch in batches:
            todo = batch.column(0).to_pylist()
            for at in range(0, len(todo), most):
                b = todo[at:at + most]
                counts = np.stack([_counted(of_units, seed, x)[order.value] for x in b])
                w = [np.ascontiguousarray(counts[:, i:j].T).tobytes() for i, j in zip(ends.value, ends.value[1:])]
                yield _sent(np.arange(len(block_of)), 1, b[0], [w[i] for i in block_of], part_of)

    out, held = None, None
    for lo in range(0, n_boot, N_BOOT):
        n = min(N_BOOT, n_boot - lo)
        draws = spark.range(lo, lo + n, 1, min(n, tasks)).mapInArrow(drawn, form)
        met = (packed.unionByName(draws).unionByName(slots.select("_part", "_slot", F.lit(0).alias("_kind"), "_hashes"), allowMissingColumns=True)
               .repartitionById(tasks, F.col("_part")).sortWithinPartitions("_slot", "_kind"))
        with arrow_batches(spark, BATCH):
            tally = materialise(met.mapInArrow(_tally(n, lo, units_of, cells_of), "_unit int, _at int, _groups bigint, _w binary"), "tally")
        kinds = F.explode(F.array(F.when(F.col("_n") > 0, F.struct(F.col("_neg").alias("_at"), F.lit(0).cast("tinyint").alias("y"))),
                                  F.when(F.col("_p") > 0, F.struct(F.col("_pos").alias("_at"), F.lit(1).cast("tinyint").alias("y"))))).alias("_c")
        of = cells.where("score is not null").select("_unit", "_key", "score", "_passes", kinds).where("_c is not null").select("*", "_c.*").drop("_c")
        ranged = (tally.where("_w is not null").join(of, ["_unit", "_at"]).select("_key", "score", "y", "_w", "_passes")
                  .repartitionByRange("_key", "score").sortWithinPartitions("_key", "score", "y"))
        each = _summed(ranged, ["_key"], lo, n, _of_vectors(n))
        out = each if out is None else out.unionByName(each)
        if held is None:
            first_key = cells.groupBy("_unit").agg(F.min("_key").alias("_least"))
            held = (tally.where("_w is null").groupBy("_unit", "_at").agg(F.sum("_groups").alias("n_groups"))
                    .join(first_key, "_unit").select((F.col("_least") + F.col("_at")).cast("int").alias("_key"), "n_groups"))
    return out, held


def _resampled(preds: DataFrame, keys: list[str], unit: list[str], n_boot: int, seed: int, poisson: bool) -> tuple[DataFrame, DataFrame | None]:
    """The replicates, and (keys, n_groups) if counting it cost nothing."""
    rows = preds.select(*keys, "threshold", F.when(~F.isnan("score"), F.col("score")).alias("score"), "y", "group_id")
    numbered, total = None, 0
    if not poisson:
        numbered = _numbered(rows, unit)
        total = numbered.count()
        whole = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*unit, "group_id"]]))
        cells = _cells(whole, keys, unit) if 0 < total <= MOST and unit else None
        met = None if cells is None else _by_blocks(whole, numbered, total, cells, keys, unit, n_boot, seed)
        if met is not None:
            names = materialise(cells.select("_key", *keys).distinct(), "keys")
            reps, held = (df.join(names, "_key").drop("_key") for df in met)
            return metrics.rates(reps.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))), held
    return _by_ranges(rows, numbered, total, keys, unit, n_boot, seed, poisson), None


def _by_ranges(rows: DataFrame, numbered: DataFrame | None, total: int, keys: list[str], unit: list[str], n_boot: int, seed: int,
               poisson: bool) -> DataFrame:
    """The replicates from rows that are walked by ranges of (keys, score)."""
    scored = rows.where(F.col("score").isNotNull())
    if poisson:
        scored = scored.withColumn("_w", F.xxhash64(*unit, "group_id"))
    else:
        scored = scored.join(numbered.select(*unit, "group_id", F.col("_id").alias("_w")), [*unit, "group_id"])
    if total > WIDTH:
        m = _by_join(scored, numbered, keys, n_boot, seed)
    else:
        names = rows.select(*keys).distinct().withColumn("_key", F.row_number().over(Window.orderBy(*keys)))  # one row a key
        names = materialise(names.withColumnsRenamed({c: f"_of_{c}" for c in keys}), "keys")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
        ranged = (scored.join(names, same).select("_key", "score", F.col("y").cast("tinyint").alias("y"), "_w", (F.col("score") >= F.col("threshold")).alias("_passes"))
                  .repartitionByRange("_key", "score").sortWithinPartitions("_key", "score", "y"))
        step, m = max(1, min(n_boot, WIDTH // max(total, 1))), None
        step = min(step, N_BOOT)
        for lo in range(0, n_boot, step):
            hi = min(lo + step, n_boot)
            if poisson:
                weigh, top = lambda g, lo=lo, hi=hi: _lanes(_poisson(g, lo, hi, seed)), len(_steps())
            else:
                drawn = _multiplicities(numbered, total, lo, hi, seed)
                sent = rows.sparkSession.sparkContext.broadcast(_lanes(drawn))
                weigh, top = lambda g, sent=sent: sent.value.take(g, axis=0), int(drawn.max(initial=0))
            part = _summed(ranged, ["_key"], lo, hi - lo, _of_groups(top, hi - lo, weigh))
            m = part if m is None else m.unionByName(part)
        m = m.join(names, "_key").drop("_key").withColumnsRenamed({f"_of_{c}": c for c in keys})
    return metrics.rates(m.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0)))


def replicates(preds: DataFrame, keys: list[str], unit: list[str], n_boot: int = N_BOOT, seed: int = 0,
               poisson: bool = False) -> DataFrame:
    """Metrics of every replicate with both classes: (keys, b, n_pos, n_neg, tp, false_positives, auroc, ...). ``preds`` is
    read several times: it should be a stored table.

    ``preds`` has keys, group_id, y, score and the locked threshold; ``unit`` (part of ``keys``) names the set of test
    groups whose draws are shared.
    """
    return _resampled(preds, keys, unit, n_boot, seed, poisson)[0]


def _interval(c: str) -> Column:
    return F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))


def bootstrap_ci(preds: DataFrame, keys: list[str], unit: list[str], n_boot: int = N_BOOT, seed: int = 0,
                 poisson: bool = False) -> DataFrame:
    """95 % percentile intervals per key, the number of groups, and how many replicates had a single class."""
    reps, n = _resampled(preds, keys, unit, n_boot, seed, poisson)
    ci = reps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_used"), *[_interval(k).alias(f"_{k}") for k in KEYS])
    if n is None:
        n = preds.groupBy(*keys).agg(F.countDistinct("group_id").alias("n_groups"))
    ends = {f"{k}_{s}": F.col(f"_{k}")[i] for k in KEYS for i, s in enumerate(("lo", "hi"))}
    return (n.join(ci, keys, "left").withColumns(ends)
            .withColumns({"n_boot": F.lit(n_boot), "n_skipped_single_class": F.lit(n_boot) - F.coalesce("_used", F.lit(0))})
            .select(*keys, "n_groups", "n_boot", "n_skipped_single_class", *ends))


def check_aligned(pairs: DataFrame, preds: DataFrame, run: str = "run") -> DataFrame:
    """(run_1, run_2, n_unmatched) for run pairs: images only one of the two has scored.

    Every run to compare is one bit; an image is shuffled once, with the bits of its runs combined in the tasks before, and
    images with the same bits are counted together. Pairs are then compared by these counts, never image by image.
    """
    wanted = materialise(pairs.select("run_1", "run_2").distinct(), "wanted")
    names = wanted.select(F.col("run_1").alias(run)).unionByName(wanted.select(F.col("run_2").alias(run))).where(F.col(run).isNotNull()).distinct()
    number = (F.row_number().over(Window.orderBy(run)) - 1).cast("int")  # one row a run
    bits = materialise(names.withColumn("_at", number).select(run, F.floor(F.col("_at") / WORD).cast("int").alias("_word"), F.expr(
        f"shiftleft(1L, _at % {WORD})").alias("_bit")), "runs")
    words = range((bits.agg(F.max("_word")).first()[0] or 0) + 1)
    ids = preds.select(run, "image_id").join(bits, run)
    masks = ids.groupBy("image_id").agg(*[F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(0)).alias(f"_m{w}") for w in words])
    kinds = materialise(masks.groupBy(*[f"_m{w}" for w in words]).agg(F.count(F.lit(1)).alias("_n")), "kinds")

    def side(name: str, alias: str) -> DataFrame:
        return bits.select(F.col(run).alias(name), F.col("_word").alias(f"_w{alias}"), F.col("_bit").alias(f"_b{alias}"))

    def has(alias: str) -> Column:
        mask = F.coalesce(*[F.when(F.col(f"_w{alias}") == w, F.col(f"_m{w}")) for w in words])
        return mask.bitwiseAND(F.col(f"_b{alias}")) != 0

    both = wanted.join(side("run_1", "1"), "run_1").join(side("run_2", "2"), "run_2").crossJoin(kinds).where(has("1") | has("2"))
    return both.groupBy("run_1", "run_2").agg(F.sum(F.when(has("1") != has("2"), F.col("_n")).otherwise(0)).alias("n_unmatched"))


def assert_aligned(pairs: DataFrame, preds: DataFrame, run: str = "run") -> None:
    """Raises if runs to compare have other test images. One digest per run (number, xor and sums of the halves of the hashes
    of its images) clears equal runs; only pairs with different digests are compared image by image."""
    h = F.xxhash64("image_id")
    digest = preds.groupBy(run).agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.try_sum(F.shiftrightunsigned(h, 32)).alias("s"),
                                             F.try_sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("t")).alias("_d"))
    digest = materialise(digest, "digests")
    sides = pairs.select("run_1", "run_2").distinct()
    for side in ("run_1", "run_2"):
        sides = sides.join(digest.select(F.col(run).alias(side), F.col("_d").alias(f"_{side}")), side, "left")
    odd = materialise(sides.where(~F.col("_run_1").eqNullSafe(F.col("_run_2"))).select("run_1", "run_2"), "unequal")
    if not odd.isEmpty() and not check_aligned(odd, preds, run).where("n_unmatched > 0").isEmpty():
        raise ValueError("runs to compare have different test images")


def _long(df: DataFrame, by: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{k}', {k}" for k in PAIRED_KEYS)
    return df.select(*by, F.expr(f"stack({len(PAIRED_KEYS)}, {pairs}) as (metric, value)"))


def paired_ci(preds: DataFrame, pairs: DataFrame, run: str = "run", unit: list[str] | None = None, n_boot: int = N_BOOT,
              seed: int = 0, poisson: bool = False) -> DataFrame:
    """Difference (run_2 minus run_1) of each metric with its 95 % interval from the same draws for both runs.

    ``preds`` holds the test rows of all runs with their locked thresholds; every run is resampled once, however many
    pairs it takes part in. Runs to compare must have the same test images, or it raises.
    """
    assert_aligned(pairs, preds, run)
    unit = unit or []
    keys = [*unit, run]
    reps = _long(materialise(replicates(preds, keys, unit, n_boot, seed, poisson), "replicates"), [*keys, "b"])  # read for either side
    point = _long(materialise(metrics.metrics_at(preds, keys), "metrics"), keys)

    def both(frame: DataFrame, by: list[str]) -> DataFrame:
        one = frame.withColumnsRenamed({run: "run_1", "value": "v1"})
        two = frame.withColumnsRenamed({run: "run_2", "value": "v2"})
        return (pairs.join(one, "run_1").join(two, ["run_2", *unit, *by, "metric"])
                .withColumn("d", F.col("v2") - F.col("v1")))

    at = [*pairs.columns, *unit, "metric"]
    ci = both(reps, ["b"]).groupBy(*at).agg(_interval("d").alias("_ci"))
    diff = both(point, []).select(*at, F.col("d").alias("diff"))
    return (diff.join(ci, at, "left").select(*at, "diff", F.col("_ci")[0].alias("ci_lo"), F.col("_ci")[1].alias("ci_hi")))
