"""Norms and differences of numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 1e-8  # fixed value


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def rel_l2(a: Column, b: Column) -> Column:
    """Norm of ``a - b`` relative to the norm of ``b``."""
    return _norm(difference(a, b)) / (_norm(b) + F.lit(EPSILON))


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.transform(difference(a, b), F.abs))
