"""Row numbers over groups of any size.

A plain ``row_number`` puts a whole group into one task. Here the order starts with a bucket: rows are numbered inside
each bucket and shifted by the number of rows in the buckets before it, so a hot group is spread over its buckets and
the only ordered pass over a group sees one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def row_index(df: DataFrame, keys: list[str], bucket: list[Column], order: list[Column], name: str = "row_index") -> DataFrame:
    """0-based position of each row within ``keys``, ordered by ``bucket`` (ascending) and then ``order``."""
    b = [f"_b{i}" for i in range(len(bucket))]
    rows = df.withColumns(dict(zip(b, bucket)))
    before = Window.partitionBy(*keys).orderBy(*b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, *b).agg(F.count(F.lit(1)).alias("_n"))
               .select(*keys, *b, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*keys, *b).orderBy(*order)
    return (rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, keys + b)
            .withColumn(name, F.col("_offset") + F.col("_rn") - 1).drop("_rn", "_offset", *b))


def hash_index(df: DataFrame, keys: list[str], ident: Column, name: str = "row_index", digits: int = 2) -> DataFrame:
    """Position within ``keys`` in the order of the MD5 of ``ident``, bucketed by its leading hexadecimal digits."""
    h = F.md5(ident)
    return row_index(df, keys, [F.substring(h, 1, digits)], [h, ident], name)
