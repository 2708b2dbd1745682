"""Tables of numeric arrays: keyed differences, moments per dimension, drift between two pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions import vectors
from cohortlens.operators import selection
from cohortlens.session import materialise


def compare_keyed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key of either table: where it is present, whether the shapes agree, and how far the values differ."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = both & (F.size("_a") == F.size("_b"))
    return j.select(key, F.col("_b").isNull().alias("only_left"), F.col("_a").isNull().alias("only_right"),
                    (both & (F.size("_a") != F.size("_b"))).alias("shape_mismatch"),
                    F.when(same, vectors.rel_l2(F.col("_a"), F.col("_b"))).alias("rel_l2"),
                    F.when(same, vectors.max_abs_diff(F.col("_a"), F.col("_b"))).alias("max_abs"))


def diff_keyed(a: DataFrame, b: DataFrame, key: str, value: str, tol: float) -> DataFrame:
    """Summary of :func:`compare_keyed` with the worst key (the smallest on a tie) and whether all is within ``tol``."""
    d = materialise(compare_keyed(a, b, key, value), "differences")
    median = selection.quantile(d, [], "rel_l2", 0.5, "median_rel_diff")
    s = d.agg(F.count_if("only_left").alias("only_left"), F.count_if("only_right").alias("only_right"),
              F.count_if("shape_mismatch").alias("shape_mismatch"), F.count("max_abs").alias("n_compared"),
              F.count_if(F.col("max_abs") != 0).alias("n_different"), F.max("max_abs").alias("max_abs_diff"),
              F.max("rel_l2").alias("max_rel_diff"),
              F.max_by(key, F.struct("rel_l2", -F.col(key))).alias("worst_key"))
    ok = ((F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("shape_mismatch") == 0)
          & (F.coalesce("max_rel_diff", F.lit(0.0)) < tol))
    order = ["only_left", "only_right", "shape_mismatch", "n_compared", "n_different", "max_abs_diff", "max_rel_diff", "median_rel_diff", "worst_key"]
    return s.join(median, how="left").select(*order, ok.alias("passed"))  # one row beside one row


def moments(df: DataFrame, value: str) -> DataFrame:
    """Mean and population standard deviation of every array position, in one pass."""
    x = F.col("x").cast("double")
    p = df.select(F.posexplode(value).alias("dim", "x"))
    s = p.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    mean = F.col("_s") / F.col("n")
    return s.select("dim", "n", mean.alias("mean"),
                    F.sqrt(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def drift(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Absolute differences of mean and standard deviation per array position."""
    ma, mb = moments(a, value), moments(b, value)
    return ma.alias("a").join(mb.alias("b"), "dim").select(
        "dim", F.abs(F.col("a.mean") - F.col("b.mean")).alias("mean_diff"), F.abs(F.col("a.std") - F.col("b.std")).alias("std_diff"))


def earliest_checkpoint(files: DataFrame, number: str = "number") -> DataFrame:
    return files.agg(F.min_by("path", number).alias("path"), F.min(number).alias(number))
