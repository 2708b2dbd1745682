"""Whitening of embeddings by their leading principal components (operator 12).

The covariance is never formed: Spark multiplies it with a few vectors at a time, each task centring its own rows and
adding up ``C^T (C Q)``; the tasks' sums meet by dimension in a shuffle, so the driver sees one row per dimension. On
these products a block Jacobi-Davidson iteration runs: Rayleigh-Ritz in a small subspace gives the current pairs, pairs
whose residual has reached double precision are locked, and the subspace grows by solutions of the projected correction
equations ``(I - ZZ^T)(V - theta)(I - ZZ^T) t = -r``, solved for all open pairs in step by a few steps of MINRES (one
distributed product a step, whatever the number of pairs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.session import materialise

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Residual that counts as double precision, as a share of the largest eigenvalue; inner MINRES steps; largest subspace.
RESIDUAL, INNER, SPACE, ROUNDS = 2.0 ** -46, 4, 96, 300
#: Entries beyond this are no embeddings: the scaled value would not fit the integers that sums are exact in.
LARGEST = 2.0 ** 40

Product = Callable[[np.ndarray], np.ndarray]


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows with a whole, finite vector of the table's commonest length (ties: the longer)."""
    entry: Callable[[Column], Column] = lambda e: e.cast("double")
    fine = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(entry(e)) & (F.abs(entry(e)) < float("inf")))
    rows = vectors.where(F.col(column).isNotNull()).where((F.size(column) > 0) & fine).select("vec_id", F.col(column).alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return rows.select("vec_id", F.array().cast("array<long>").alias("x"))
    fit = F.when(F.abs(F.array_max(F.transform("v", lambda e: F.abs(entry(e))))) < LARGEST, F.col("v")).otherwise(
        F.raise_error(F.lit("an embedding has an entry of 2^40 or more")))
    return materialise(rows.where(F.size("v") == length["d"]).select(
        "vec_id", F.transform(fit, lambda e: F.floor(entry(e) * SCALE) + SHIFT).alias("x")), "vectors")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, d: int, out: tuple[int, int], of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all rows of ``of(block)``, a matrix of shape ``out``: per task first, then by its row number."""
    height, width = out
    names = [f"c{j}" for j in range(width)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(height, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(width)]], names=["at", *names])

    schema = ", ".join(["at int", *[f"{c} {kind}" for c in names]])
    got = rows.select("x").mapInArrow(partial, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()
    total = np.zeros(out, dtype=np.int64 if kind == "long" else float)
    for r in got:
        total[r["at"]] = r[1:]
    return total


def _outside(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The part of ``t`` orthogonal to the bases (twice, against rounding)."""
    for _ in range(2):
        for b in bases:
            if b.shape[1]:
                t = t - b @ (b.T @ t)
    return t


def _fresh(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``t`` adds to the bases; columns that add nothing are left out."""
    new = np.zeros((len(t), 0))
    for column in t.T:
        size = np.linalg.norm(column)
        if size == 0:
            continue
        rest = _outside((column / size)[:, None], *bases, new)
        left = np.linalg.norm(rest)
        if left > 1e-10:
            new = np.hstack([new, _outside(rest / left, *bases, new)])
            new[:, -1] /= np.linalg.norm(new[:, -1])
    return new


def minres(operator: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on every column of ``rhs`` at once; a column that is solved stays as it is."""
    k = rhs.shape[1]
    x, w, w_old, v_old = (np.zeros_like(rhs) for _ in range(4))
    size = np.linalg.norm(rhs, axis=0)
    live = size > 0
    v = rhs / np.where(live, size, 1)
    eta, beta = size.copy(), np.zeros(k)
    c, c_old, s, s_old = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    for _ in range(steps):
        p = operator(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        rho1, rho2, rho3 = np.hypot(delta, after), s * alpha + c_old * c * beta, s_old * beta
        live &= rho1 > 0
        safe = np.where(live, rho1, 1)
        c, c_old, s, s_old = np.where(live, delta / safe, 1), c, np.where(live, after / safe, 0), s
        w, w_old = (v - rho3 * w_old - rho2 * w) / safe, w
        x += np.where(live, c * eta, 0) * w
        eta = -s * eta
        live &= after > 1e-14 * size
        v, v_old, beta = np.where(live, p / np.where(after > 0, after, 1), 0), v, after
        if not live.any():
            break
    return x


def jacobi_davidson(product: Product, d: int, k: int = COMPONENTS, residual: float = RESIDUAL, inner: int = INNER, space: int = SPACE,
                    rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenpairs of a symmetric positive operator given by its products only, largest first.

    A pair is locked when its residual is at most ``residual`` times the largest eigenvalue, or when the subspace is the
    whole space (then Rayleigh-Ritz is exact up to rounding). A last look at the best pair left makes sure that none of
    the locked ones was overtaken; raises if ``rounds`` are not enough.
    """
    k = min(k, d)
    block, space = min(k + 2, d), max(space, 4 * k)
    start = np.random.default_rng(12).standard_normal((d, block))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    q = _fresh(start, locked)
    aq = product(q)
    for _ in range(rounds):
        h = q.T @ aq
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = q @ s, aq @ s
        r = _outside(au - u * theta, locked)
        size = np.linalg.norm(r, axis=0)
        largest = max(theta[0] if len(theta) else 0.0, values.max(initial=0.0))
        whole = q.shape[1] + locked.shape[1] >= d
        done = 0
        while done < len(theta) and len(values) + done < k and (whole or size[done] <= residual * largest):
            done += 1
        if len(values) + done >= k:
            below = theta[done] + size[done] if done < len(theta) else 0.0
            if whole or below <= min(values.min(initial=np.inf), theta[:done].min(initial=np.inf)) or size[done] <= 1e-6 * largest:
                pairs = np.hstack([locked, u[:, :done]]), np.append(values, theta[:done])
                if not whole and done < len(theta) and theta[done] > pairs[1].min():  # one was overtaken: let it in
                    k += 1
                else:
                    order = np.argsort(-pairs[1], kind="stable")
                    return pairs[1][order], pairs[0][:, order]
        if done:
            locked, values = np.hstack([locked, u[:, :done]]), np.append(values, theta[:done])
        q, aq, theta, r = u[:, done:], au[:, done:], theta[done:], r[:, done:]
        if q.shape[1] + block > space:
            q, aq = q[:, :2 * block], aq[:, :2 * block]
        open_ = max(1, min(block, k + 2 - len(values), q.shape[1]))
        z, shift = np.hstack([locked, q[:, :open_]]), theta[:open_]
        t = minres(lambda v: _outside(product(_outside(v, z)) - _outside(v, z) * shift, z), _outside(-r[:, :open_], z), inner)
        new = _fresh(t, locked, q)
        if not new.shape[1]:
            new = _fresh(np.random.default_rng(q.shape[1] + 13).standard_normal((d, open_)), locked, q)
        new = new[:, :d - q.shape[1] - locked.shape[1]]
        if new.shape[1]:
            q, aq = np.hstack([q, new]), np.hstack([aq, product(new)])
    raise RuntimeError(f"{len(values)} of {k} eigenpairs after {rounds} rounds")


def _deviation(x: np.ndarray, n: int, total: np.ndarray) -> list[int]:
    """Sum over the dimensions of (n x - S)^2, exact whatever its size."""
    y = n * x - total
    if len(y) and float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0 ** 62:
        return (y * y).sum(axis=1).tolist()
    return [sum(int(e) ** 2 for e in row) for row in y.tolist()]


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) for every kept row and component.

    Left out: rows whose vector is null, empty, holds null or non-finite entries, or is not of the table's commonest
    length. Repeated rows and null ids stay as they are. Components without variance (all vectors equal, or fewer
    directions than ``components``) get a null ``whitened`` and count nothing in ``identity_error``. ``deviation`` is null
    where it passes 64 bits; ``deviation_exact`` has every digit. An empty table gives no rows; an entry of 2^40 or more
    raises an error.
    """
    rows = scaled(vectors, column)
    kind = dict(rows.dtypes)["vec_id"]
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, "
              "deviation_exact decimal(38,0)")
    head = rows.select(F.size("x").alias("d")).first()
    if head is None:
        return rows.sparkSession.createDataFrame([], schema)
    d, n = head["d"], rows.count()
    total = summed(rows, d, (d, 1), lambda x: x.sum(axis=0)[:, None], "long")[:, 0]
    mean = np.array([int(t) / n for t in total])

    def product(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return summed(rows, d, q.shape, of) / n

    trace = summed(rows, d, (1, 1), lambda x: np.array([[np.square(x - mean).sum()]]))[0, 0] / n
    if trace > 0:
        e, u = jacobi_davidson(product, d, components)
        e, u = e[:components], u[:, :components]
    else:
        e, u = np.zeros(min(components, d)), np.eye(d)[:, :min(components, d)]
    k, some = len(e), e > d * 2.0 ** -52 * trace
    to = u * np.where(some, 1 / np.sqrt(np.where(some, e, 1)), 0)
    moments = summed(rows, d, (k + 1, k), lambda x: (lambda w: np.vstack([w.T @ w, w.sum(axis=0)]))((x - mean) @ to)) / n
    spread = moments[:k] - np.outer(moments[k], moments[k]) - np.diag(some.astype(float))
    error = float(np.abs(spread).max())
    explained = e / trace if trace > 0 else e

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), d)
            w, dev, m = (x - mean) @ to, _deviation(x, n, total), len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            long = pa.array([v if v < 1 << 63 else None for v in dev], pa.int64()).take(each)
            exact = pa.array([str(v) for v in dev]).cast(pa.decimal128(38, 0)).take(each)
            yield pa.record_batch([batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                                   long, pa.array(w.ravel(), mask=np.tile(~some, m)), pa.array(np.tile(explained, m)),
                                   pa.array(np.full(m * k, error)), exact],
                                  names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(out, schema)
