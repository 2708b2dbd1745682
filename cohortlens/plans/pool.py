"""Pretraining pool: selection without leakage, and removal of copies of held-out images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.operators import cohort, joins, similarity
from cohortlens.session import materialise

# ---- fixed value
LICENSES = ["CC-0", "CC-BY"]


def classify_pool(meta: DataFrame, source_map: DataFrame, manifest: DataFrame, licenses: list[str] = LICENSES) -> DataFrame:
    """Every dermoscopic row with the first reason that keeps it out of the pool (NULL if it stays). The held-out rows are
    stored, as every identifier is looked up in them; of the metadata only what the pool needs goes along."""
    rows = meta.where(cohort.is_dermoscopic(F.col("image_type"))).select("image_id", "license", "attribution", "lesion_id", "patient_id")
    held = materialise(manifest.where(F.col("split").isin("val", "test")).select("image_id", "lesion_id", "patient_id", "source", "split"), "held")
    return joins.pool_exclusion_reason(cohort.with_source(rows, source_map), held, held.where("split = 'test'"), licenses)


def select_pool(meta: DataFrame, source_map: DataFrame, manifest: DataFrame, licenses: list[str] = LICENSES) -> DataFrame:
    pool = classify_pool(meta, source_map, manifest, licenses).where("excluded is null")
    return pool.select("image_id", "license", "attribution", "source")


def pool_report(meta: DataFrame, source_map: DataFrame, manifest: DataFrame, licenses: list[str] = LICENSES) -> DataFrame:
    """Rows per exclusion reason, and ``selected``, in one pass."""
    rows = classify_pool(meta, source_map, manifest, licenses)
    return rows.groupBy(F.coalesce("excluded", F.lit("selected")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


def contaminated(pool: DataFrame, held: DataFrame, n_bits: int, t: int = similarity.MAX_HAMMING) -> DataFrame:
    """Pool identifiers to exclude and why: ``exact`` copies of a held-out digest, or ``near`` ones only."""
    digests = held.where(F.col("sha256").isNotNull()).select("sha256").distinct()
    exact = pool.join(digests, "sha256", "left_semi").select("image_id", F.lit("exact").alias("kind"))
    near = similarity.near_semi(pool, held, n_bits, t).select("image_id", F.lit("near").alias("kind"))
    return exact.unionByName(near).groupBy("image_id").agg(F.min("kind").alias("kind"))


def decontaminate(pool: DataFrame, held: DataFrame, n_bits: int, t: int = similarity.MAX_HAMMING) -> DataFrame:
    return pool.join(contaminated(pool, held, n_bits, t).select("image_id"), "image_id", "left_anti")


def contamination_summary(pool: DataFrame, held: DataFrame, n_bits: int, t: int = similarity.MAX_HAMMING) -> DataFrame:
    sizes = pool.agg(F.count(F.lit(1)).alias("pool_images_checked")).withColumn("_k", F.lit(1))
    held_n = held.agg(F.count(F.lit(1)).alias("held_images")).withColumn("_k", F.lit(1))
    ex = contaminated(pool, held, n_bits, t).agg(
        F.count_if(F.col("kind") == "exact").alias("exact_copies"), F.count_if(F.col("kind") == "near").alias("near_duplicates_only"),
        F.count(F.lit(1)).alias("excluded_total")).withColumn("_k", F.lit(1))
    return sizes.join(held_n, "_k").join(ex, "_k").drop("_k")


def file_list(pool: DataFrame, latest: DataFrame, exclude: Column | None = None) -> DataFrame:
    """Files of the pool from the latest entries of the download log; ``exclude``: which entries make no file."""
    kept = latest if exclude is None else latest.where(~F.coalesce(exclude, F.lit(False)))
    return pool.join(kept.select("image_id", "file"), "image_id")
