"""Summaries of device telemetry and of training metric streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators import ranking, selection
from cohortlens.operators.joins import spread_join
from cohortlens.session import materialise


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def after_warmup(df: DataFrame, keys: list[str], skip_s: float) -> DataFrame:
    """Samples at least ``skip_s`` after the first sample of their run; the start is found by an aggregate, not a window."""
    start = df.groupBy(*keys).agg(F.min("ts").alias("_start"), F.count(F.lit(1)).alias("_n"))
    return spread_join(df, start, keys, "_n").where(seconds(F.col("ts")) - seconds(F.col("_start")) >= skip_s).select(*df.columns)


def summarise_samples(df: DataFrame, keys: list[str], skip_s: float = 0.0, digits: int = 1) -> DataFrame:
    """Samples, mean utilisation, idle share and peak memory after the warm-up; the duration covers all samples."""
    span = df.groupBy(*keys).agg(F.min("ts").alias("_start"), F.max("ts").alias("_end"), F.count(F.lit(1)).alias("_n"))
    kept = spread_join(df, span, keys, "_n").where(seconds(F.col("ts")) - seconds(F.col("_start")) >= skip_s)
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(seconds(F.max("_end")) - seconds(F.min("_start")), 1).alias("duration_s"),
        F.round(F.avg("util"), digits).alias("util_mean"), F.round(F.lit(100.0) - F.avg("util"), digits).alias("idle_pct"),
        F.round(F.lit(100.0) * F.count_if(F.col("util") == 0) / F.count(F.lit(1)), 1).alias("pct_samples_util_0"),
        F.round(F.max("mem") / F.lit(1024.0), 2).alias("mem_used_max_gb"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def summarise_metrics(df: DataFrame, keys: list[str], skip: int, batch: int, devices: int = 1) -> DataFrame:
    """Median step time, throughput, share of time spent waiting for data, non-finite losses and peak memory. A log
    with no entry past the skipped iterations is summarised whole."""
    late = F.coalesce(F.col("iteration"), F.lit(0)) >= skip
    any_late = df.groupBy(*keys).agg(F.max(late).alias("_any"), F.count(F.lit(1)).alias("_n"))
    used = spread_join(df.select(*keys, "iteration", "iter_time", "data_time"), any_late, keys, "_n").where(~F.col("_any") | late)
    med = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.max("iteration").alias("last_iteration"),
        F.count_if(F.col("total_loss").isNotNull() & ~is_finite(F.col("total_loss"))).alias("loss_non_finite"),
        F.max("max_mem").alias("max_mem"))
    used = materialise(used, "used")
    for name, value in (("_t", "iter_time"), ("_d", "data_time")):
        med = med.join(selection.quantile(used, keys, value, 0.5, name), keys, "left")
    return med.select(*keys, "entries", "last_iteration", F.round("_t", 4).alias("median_iter_time_s"),
                      F.round(F.lit(float(batch * devices)) / F.col("_t"), 1).alias("items_per_s"),
                      F.round(F.col("_d") / F.col("_t"), 3).alias("data_time_fraction"), "loss_non_finite", "max_mem")


def loss_ends(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: str = "total_loss",
              digits: int = 4) -> DataFrame:
    """Mean of the first and of the last tenth of each ordered series (at least one value each). ``bucket`` is a coarse
    form of the order (a day, a thousand iterations) that lets a long series be numbered in pieces."""
    rows = ranking.row_index(df.where(F.col(value).isNotNull()), keys, [bucket], order, "_i")
    rows = materialise(rows.select(*keys, value, "_i"), "series")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / 10))
    return spread_join(rows, sizes, keys, "_n").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("_i") < k, F.col(value))), digits).alias("first_10pct_mean"),
        F.round(F.avg(F.when(F.col("_i") >= F.col("_n") - k, F.col(value))), digits).alias("last_10pct_mean"))
