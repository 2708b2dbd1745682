"""Sinks: ordered tables, one-row JSON summaries, report lines, file lists and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.hashing import row_fingerprint
from cohortlens.session import materialise


def write_table(df: DataFrame, path: str, order: list[str], fmt: str = "parquet") -> None:
    """Totally ordered table; each file holds a range of the order."""
    w = df.orderBy(*order).write.mode("overwrite")
    w.csv(path, header=True, emptyValue="") if fmt == "csv" else w.parquet(path)


def summary_json(df: DataFrame) -> DataFrame:
    """A one-row frame as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_summary(df: DataFrame, path: str) -> None:
    """JSON summary; the commit protocol replaces the old file only after the new one is complete."""
    summary_json(df).coalesce(1).write.mode("overwrite").text(path)


def report_lines(df: DataFrame, cols: list[Column]) -> DataFrame:
    """Rows as lines of a markdown table; the order of the frame is kept."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]),
                              F.lit(" |")).alias("value"))


def format_report(df: DataFrame, cols: list[str], path: str | None = None, header: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` as a markdown table below the names of its columns (``header``; none: ``cols``) and a separator."""
    names = cols if header is None else header
    top = df.sparkSession.createDataFrame([("| " + " | ".join(names) + " |",), ("|" + "---|" * len(names),)], "value string").coalesce(1)
    lines = top.union(report_lines(df, [F.col(c) for c in cols]))
    if path is not None:
        lines.write.mode("overwrite").text(path)
    return lines


def write_file_list(df: DataFrame, path: str) -> None:
    """One file name to a line, and beside it the attribution table of the same images. The rows are computed once and stored
    for both."""
    df = materialise(df.select("file", "image_id", "license", "attribution"), "list")
    df.select("file").orderBy("file").write.mode("overwrite").text(path)
    df.select("image_id", "license", "attribution").write.mode("overwrite").csv(f"{path}_attribution", header=True)


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Content fingerprint that does not depend on row order or partitioning."""
    h = row_fingerprint(cols or df.columns)
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("xor60"),
                                       F.sum(F.shiftright("h", 36)).alias("sum24"))
