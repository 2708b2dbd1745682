"""Membership and lookup joins used by the cohort and pool jobs. Blank keys never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.session import materialise


def matched(left: DataFrame, right: DataFrame, key: str = "image_id") -> DataFrame:
    return left.join(right, key, "inner")


def unmatched_count(left: DataFrame, right: DataFrame, key: str = "image_id") -> DataFrame:
    return left.join(right.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))


def members(df: DataFrame, held: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose non-blank key is (or is not) among the held keys. Keys are made distinct before the join; blank keys match
    nothing and do not meet in one task."""
    ids = held.where(F.col(key) != "").select(key).distinct()
    if present:
        return df.where(F.col(key) != "").join(ids, key, "left_semi")
    return df.withColumn("_s", _spread(df, key)).join(_unspread(ids, key), [key, "_s"], "left_anti").select(*df.columns)


def _spread(df: DataFrame, key: str) -> Column:
    """0 for a key that can match; for blank keys one of 64 numbers by the rest of the row, so they are no hot key."""
    return F.when(F.coalesce(F.col(key), F.lit("")) == "", F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(64)) + 1).otherwise(0).cast("int")


def _unspread(ids: DataFrame, key: str) -> DataFrame:
    """0 for every (non-blank) key. A literal would not do: Spark takes a constant out of the join's keys, and the blank
    keys of the other side meet again."""
    return ids.withColumn("_s", (F.col(key) == "").cast("int"))


def spread_join(rows: DataFrame, facts: DataFrame, key: str | list[str], size: str, keep_all: bool = False) -> DataFrame:
    """``rows`` with the columns of their key's row in ``facts`` (one row a key, ``size`` rows of ``rows`` have it).

    A key with more than half a partition's fair share of the rows is hot: its rows are dealt over as many numbers as it
    has such shares, and its row in ``facts`` is repeated for each. There are at most two hot keys a partition, so their
    list is small whatever the table, and repeating adds at most two rows a partition. ``keep_all``: rows without facts stay.
    """
    keys = [key] if isinstance(key, str) else key
    facts = materialise(facts, "facts")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1, int(facts.agg(F.sum(size)).first()[0] or 0) // (2 * partitions))
    hot = F.broadcast(facts.where(F.col(size) > limit).select(*keys, F.ceil(F.col(size) / limit).cast("int").alias("_parts")))
    mixed = F.xxhash64(*[c for c in rows.columns if c not in keys]) if len(rows.columns) > len(keys) else F.monotonically_increasing_id()
    left = rows.withColumn("_mixed", mixed).join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod("_mixed", F.col("_parts"))).cast("int")).drop("_parts", "_mixed")
    right = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > limit, F.ceil(F.col(size) / limit) - 1).otherwise(0).cast("int"))))
    return left.join(right, [*keys, "_salt"], "left" if keep_all else "inner").drop("_salt")


def pool_exclusion_reason(df: DataFrame, held: DataFrame, test_sources: DataFrame, licenses: list[str]) -> DataFrame:
    """Adds ``excluded``: the first reason, in order, that keeps a row out of the pool; NULL if it stays."""
    def flag(frame: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
        ids = keys.where(F.col(key) != "").select(key).distinct().withColumn(name, F.lit(True))
        return frame.withColumn("_s", _spread(df, key)).join(_unspread(ids, key), [key, "_s"], "left").drop("_s")

    out = flag(df, test_sources, "source", "_src")
    for key in ("image_id", "lesion_id", "patient_id"):
        out = flag(out, held, key, f"_{key}")
    why: Column = (F.when(F.col("_src"), "test_institution").when(F.col("_image_id"), "labelled_val_test_image")
                   .when(F.col("_lesion_id"), "shares_lesion_id").when(F.col("_patient_id"), "shares_patient_id")
                   .when(~F.col("license").isin(licenses), "licence"))
    return out.withColumn("excluded", why).select(*df.columns, "excluded")


def last_entry(log: DataFrame, key: str = "image_id", order: str = "seq") -> DataFrame:
    """The latest log entry of each key. Combined per task before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in log.columns if c not in (key, order)]
    g = log.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in [order, *rest]])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` for each key combination."""
    rest = [c for c in df.columns if c not in keys and c != order]
    g = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def licence_mismatches(cohort: DataFrame, log: DataFrame) -> DataFrame:
    j = cohort.select("image_id", "license").join(log.select("image_id", "api_license"), "image_id")
    return j.agg(F.count_if(F.col("api_license").isNotNull() & (F.col("api_license") != F.col("license"))).alias("mismatches"))


def coverage_gap(grid: DataFrame, done: DataFrame, arm: list[str], value: str) -> DataFrame:
    """Planned (arm, value) combinations without a completed run; values compare equal within 1e-12."""
    key = F.round(F.col(value) * F.lit(1e12)).cast("bigint")
    return (grid.withColumn("_v", key)
            .join(done.select(*arm, key.alias("_v")).distinct(), [*arm, "_v"], "left_anti").drop("_v"))
