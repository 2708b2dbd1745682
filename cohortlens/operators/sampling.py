"""Seeded sampling: uniform without replacement, class-balanced with replacement, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.hashing import h60
from cohortlens.operators import ranking


def sample_n(df: DataFrame, n: int, seed: int = 0, key: str = "image_id") -> DataFrame:
    """n rows without replacement: the smallest seeded hashes, so the sample does not depend on partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Adds ``weight``: the inverse of the size of the row's class, normalised to sum 1 over all rows."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = sizes.agg(F.count(F.lit(1)).alias("_c"))
    w = sizes.withColumn("_k", F.lit(1)).join(classes.withColumn("_k", F.lit(1)), "_k")
    return (df.join(w.select(label, "_n", "_c"), label)
            .withColumn("weight", F.lit(1.0) / (F.col("_n") * F.col("_c"))).drop("_n", "_c"))


def balanced_sample(df: DataFrame, n: int, seed: int = 0, key: str = "image_id", label: str = "y") -> DataFrame:
    """n draws with replacement, every class equally likely: (draw, row). A draw is hashed to a class and then to a
    position in it, so drawing is two equi-joins; no running sum of weights is needed."""
    spark = df.sparkSession
    rows = ranking.hash_index(df.select(key, label), [label], F.concat_ws(":", F.lit(seed), F.col(key)), "_i")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = sizes.select(F.sort_array(F.collect_list(label)).alias("_c"))  # one entry per class
    draws = spark.range(n).select(F.col("id").alias("draw"), F.lit(1).alias("_k"))
    of = F.pmod(h60(F.concat_ws(":", F.lit(seed), F.lit("class"), "draw")), F.size("_c"))
    at = F.pmod(h60(F.concat_ws(":", F.lit(seed), F.lit("row"), "draw")), F.col("_n"))
    picked = (draws.join(classes.withColumn("_k", F.lit(1)), "_k").select("draw", F.get("_c", of.cast("int")).alias(label))
              .join(sizes, label).select("draw", label, at.alias("_i")))
    return picked.join(rows, [label, "_i"]).select("draw", key, label)
