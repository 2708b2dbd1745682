"""Exact quantiles per key without holding a key's values anywhere.

A quantile is one or two order statistics. Each is found by counting: the values between its bounds are dealt into
``BUCKETS`` equal parts, the part that holds the rank becomes the new bounds (narrowed to the values really in it), and so
on until the bounds meet or so few values are left that they can be sorted. The first round divides logarithms, so that a
few huge values do not swallow the buckets; later ones divide the values. A round is one aggregate with at most
``BUCKETS`` rows a key and order statistic; the rows of a hot key stay spread over the tasks.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.operators.joins import spread_join
from cohortlens.session import materialise

BUCKETS, FEW = 256, 512
_INFINITE, _LARGEST = float("inf"), sys.float_info.max


def _scale(c: Column, logarithms: bool) -> Column:
    return F.signum(c) * F.log1p(F.abs(c)) if logarithms else c


def _bucket(value: Column, lo: Column, hi: Column, logarithms: bool) -> Column:
    """Part of [lo, hi] that a value lies in: never falling as the value grows, with infinite values apart."""
    x, a, b = (_scale(c, logarithms) for c in (value, F.greatest(lo, F.lit(-_LARGEST)), F.least(hi, F.lit(_LARGEST))))
    share = F.coalesce(F.try_divide(x / BUCKETS - a / BUCKETS, b / BUCKETS - a / BUCKETS), F.lit(0.0))  # no overflow for bounds far apart
    inside = F.least(F.greatest(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))
    return F.when(value == _INFINITE, BUCKETS).when(value == -_INFINITE, -1).otherwise(inside).cast("int")


def order_statistics(values: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _k, _v) for ``ranks`` (keys, _n, _lo, _hi, _ks): the values of rank k (0-based) of each key, ``_ks`` an array of
    ranks, _n, _lo and _hi the number, smallest and largest of the key's values in ``values`` (keys, _v)."""
    goal = ["_k", "_lo", "_hi", "_before", "_inside"]
    state = materialise(ranks.select(*keys, "_n", F.explode(F.array_distinct("_ks")).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"),
                                     F.col("_n").alias("_inside")), "ranks")
    first = True
    while True:
        wide = (F.col("_lo") < F.col("_hi")) & (F.col("_inside") > FEW)
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        facts = open_.groupBy(*keys).agg(F.max("_n").alias("_n"), F.collect_list(F.struct(*goal)).alias("_g"))
        rows = spread_join(values, facts, keys, "_n").select(*keys, "_v", F.explode("_g").alias("_g")).where("_v between _g._lo and _g._hi")
        counted = rows.groupBy(*keys, F.col("_g._k").alias("_k"), F.col("_g._before").alias("_before"),
                               _bucket(F.col("_v"), F.col("_g._lo"), F.col("_g._hi"), first).alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_inside"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        below = Window.partitionBy(*keys, "_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
        at = counted.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_inside").over(below), F.lit(0)))
        hit = at.where((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_inside")))
        sizes = ranks.select(*keys, "_n")
        state = materialise(state.where(~wide).unionByName(hit.join(sizes, keys).select(*keys, "_n", *goal)), "ranks")
        first = False
    found = state.where("_lo = _hi").select(*keys, "_k", F.col("_lo").alias("_v"))
    few = state.where("_lo < _hi").groupBy(*keys).agg(F.max("_n").alias("_n"), F.collect_list(F.struct(*goal)).alias("_g"))
    rows = spread_join(values, few, keys, "_n").select(*keys, "_v", F.explode("_g").alias("_g")).where("_v between _g._lo and _g._hi")
    rest = rows.groupBy(*keys, F.col("_g._k").alias("_k"), F.col("_g._before").alias("_before")).agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
    return found.unionByName(rest.select(*keys, "_k", F.element_at("_sorted", (F.col("_k") - F.col("_before") + 1).cast("int")).alias("_v")))


def quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """(keys, ``name``): the exact quantile of each key, between two values by their distance. Null and NaN values are left
    out, and keys without any other value have no row. Without keys the result has one row, or none."""
    by = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    values = materialise(rows.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")), "values")
    place = F.lit(float(q)) * (F.col("_n") - 1)
    ranks = materialise(values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
                        .withColumn("_ks", F.array(F.floor(place), F.ceil(place))), "ranks")
    got = order_statistics(values, ranks, by)
    pair = got.groupBy(*by).agg(F.min(F.struct("_k", "_v")).alias("_a"), F.max(F.struct("_k", "_v")).alias("_b")).join(ranks.select(*by, "_n"), by)
    between = F.when(F.col("_a._k") == F.col("_b._k"), F.col("_a._v")).otherwise((F.col("_b._k") - place) * F.col("_a._v") + (place - F.col("_a._k")) * F.col("_b._v"))
    return pair.select(*keys, between.alias(name))
