"""File listings as tables: sizes per folder, checkpoint sizes, presence of the files of a manifest, feature caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def plain_path(path: Column) -> Column:
    """A path without scheme and host, and without slashes at its end."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+$", "")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path below ``root`` (an absolute path or address) and length of every file; the contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.substring(plain_path(F.col("path")), F.length(plain_path(F.lit(root))) + 2, F.length("path")).alias("path"), "length")


def file_inventory(files: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Files and GiB below each named folder. Of nested folders the first that is named counts."""
    label = F.coalesce(*[F.when(F.col("path").startswith(p.strip("/") + "/"), name) for name, p in prefixes.items()])
    return (files.withColumn("name", label).where(F.col("name").isNotNull()).groupBy("name")
            .agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("length") / F.lit(2.0 ** 30), 2).alias("gib"),
                 F.sum("length").alias("bytes")))


def size_range(files: DataFrame, ending: str) -> DataFrame:
    """Smallest, largest and number of the files with a given ending."""
    return (files.where(F.col("path").endswith(ending))
            .agg(F.min("length").alias("min_bytes"), F.max("length").alias("max_bytes"), F.count(F.lit(1)).alias("n")))


def existing_files(df: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """Rows whose file, a path below the listed folder, is in the listing."""
    return df.join(files.select(F.col("path").alias(key)), key, "left_semi")


def missing_files(df: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """How many rows have no such file; a null file is missing."""
    return df.join(files.select(F.col("path").alias(key)), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))


def cached_features(keys: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], key: str = "image_id") -> DataFrame:
    """Features stored under ``path`` if they cover exactly the wanted keys, else built and stored."""
    spark = keys.sparkSession
    want = keys.select(key)
    try:
        have = spark.read.parquet(path)
    except AnalysisException:
        have = None
    if have is not None:
        got = have.select(key)
        if want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty():
            return have
        raise ValueError(f"the features stored under {path} do not match the wanted keys")
    build(keys).write.parquet(path)
    return spark.read.parquet(path)
