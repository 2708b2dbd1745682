"""Scans: loosely structured CSV, nested JSON, JSON lines, log text and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from cohortlens.functions import text
from cohortlens.session import materialise

# ---- fixed values: canonical field -> accepted column names, first present wins
FIELDS = {
    "image_id": ["isic_id", "image_id"],
    "license": ["copyright_license", "license"],
    "attribution": ["attribution"],
    "image_type": ["image_type"],
    "diagnosis_1": ["diagnosis_1"],
    "diagnosis_2": ["diagnosis_2"],
    "diagnosis_3": ["diagnosis_3"],
    "confirm": ["diagnosis_confirm_type"],
    "lesion_id": ["lesion_id"],
    "patient_id": ["patient_id"],
    "age": ["age_approx"],
    "sex": ["sex"],
    "body_site": ["anatom_site_1", "anatom_site_general", "anatom_site_special", "anatom_site"],
}
REQUIRED = ["image_id", "license", "attribution", "image_type", "diagnosis_1", "confirm"]
DELIMITERS = [",", ";", "\t"]
TELEMETRY_TIME = "yyyy/MM/dd HH:mm:ss.SSS"

EPOCH = ("struct<epoch:bigint,loss:double,val_auroc:double,train_seconds:double,val_seconds:double,img_per_s:double,"
         "img_per_s_steady:double,data_wait_pct:double,elapsed_s:double>")
RESULT_SCHEMA = (
    "backbone string, method string, train_frac double, img bigint, seed bigint, lr double, n_train bigint, "
    "metrics struct<test:struct<auroc:double>>, "
    "run struct<gpu_hours:double,peak_mem_allocated_gb:double,gpu_train:struct<gpu_idle_pct:double>,"
    f"time_to_val_criterion_s:double,best_val_auroc:double,wall_seconds:double,epochs:array<{EPOCH}>>")
METRIC_SCHEMA = "iteration bigint, iter_time double, data_time double, total_loss double, max_mem double"


def blanks(df: DataFrame) -> DataFrame:
    """NULL text becomes the empty string, the only missing value of the string tables."""
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def csv_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, piece, line, text): the lines of the files; a piece is where its split begins, ``line`` rises within a piece."""
    value = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("line"),
        value.alias("text"))


def quote_count(c: str) -> Column:
    return F.when(F.contains(c, F.lit('"')), F.octet_length(c) - F.octet_length(F.replace(F.col(c), F.lit('"')))).otherwise(0)


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, number, record): the CSV records of the files in order, with line breaks inside quotes kept.

    Files stay splittable. Every piece of a file counts its quotes and, for either parity that may hold at its start, the
    records that begin in it; running sums over a file's pieces, one row each, give the true parity and the number of the
    first record. Only lines of records that span several are then brought together. A quote counts wherever it stands, so
    fields with a lone quote have to be quoted themselves, as the format asks.
    """
    inside = Window.partitionBy("file", "piece").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    quotes = quote_count("text")
    lines = lines.withColumns({"quotes": quotes, "odd": F.coalesce(F.sum(quotes).over(inside), F.lit(0)) % 2})
    begun = {f"starts{p}": F.count_if(F.col("odd") == p) for p in (0, 1)}
    pieces = lines.groupBy("file", "piece").agg(F.sum("quotes").alias("quotes"), *[c.alias(n) for n, c in begun.items()])
    before = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("parity", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    pieces = pieces.withColumn("first", F.coalesce(F.sum(F.when(F.col("parity") == 0, F.col("starts0")).otherwise(F.col("starts1"))).over(before), F.lit(0)))
    placed = lines.join(pieces.select("file", "piece", "parity", "first"), ["file", "piece"])
    open_ = (F.col("odd") + F.col("parity")) % 2
    upto = Window.partitionBy("file", "piece").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("open", open_).withColumn("number", F.col("first") + F.count_if(F.col("open") == 0).over(upto) - 1)
    alone = (F.col("open") == 0) & (F.col("quotes") % 2 == 0)
    several = (placed.where(~alone).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("piece", "line", "text"))).alias("parts"))
               .select("file", "number", F.array_join("parts.text", "\n").alias("record")))
    return placed.where(alone).select("file", "number", F.col("text").alias("record")).unionByName(several)


def headed_records(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(file, record) of all records below a header, and (file, head): the header of every file.

    In a file whose lines all have an even number of quotes every line is a record: no line has to be shuffled. Its first
    line is known by a hash, counted by its text (a record may repeat it) and taken out once. Only the other files go
    through :func:`csv_records`.
    """
    lines = csv_lines(spark, paths, encoding)
    files = materialise(lines.groupBy("file").agg(
        F.max(quote_count("text") % 2).alias("odd"),
        F.min_by(F.xxhash64("text"), F.when(F.col("piece") == 0, F.col("line"))).alias("hash")), "files")
    plain, broken = files.where("odd = 0").select("file", "hash"), files.where("odd = 1").select("file")
    whole = broken.isEmpty()
    first = [r[0] for r in plain.select("hash").distinct().limit(2).collect()] if whole else []
    same = len(first) == 1  # one header in all files: nothing has to be looked up for a line
    tops = (lines.where(F.xxhash64("text") == F.lit(first[0])) if same
            else lines.join(plain, "file").where(F.xxhash64("text") == F.col("hash")))
    heads = materialise(tops.groupBy("file", F.col("text").alias("head")).agg(F.count(F.lit(1)).alias("n")), "heads")
    if same:
        rows = lines.where(F.xxhash64("text") != F.lit(first[0])).select("file", F.col("text").alias("record"))
    else:
        rows = lines.join(heads, "file").where(F.col("text") != F.col("head")).select("file", F.col("text").alias("record"))
    again = heads.where("n > 1").select("file", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))), F.col("head").alias("record")).select("file", "record")
    rows, heads = rows.unionByName(again), heads.select("file", "head")
    if not whole:
        records = csv_records(lines.join(broken, "file", "left_semi"))
        rows = rows.unionByName(records.where("number > 0").select("file", "record"))
        heads = materialise(heads.unionByName(records.where("number = 0").select("file", F.col("record").alias("head"))), "heads")
    ended = {c: F.when(F.endswith(c, F.lit("\r")), F.expr(f"left({c}, length({c}) - 1)")).otherwise(F.col(c)) for c in ("record", "head")}
    return rows.withColumn("record", ended["record"]), heads.withColumn("head", F.regexp_replace(ended["head"], "^\ufeff", ""))


def read_strings(spark: SparkSession, paths: str | list[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header in every file, every column text, blanks kept as the empty string. Files may have other columns or
    another order of them: columns are taken by name, those that a file lacks are blank in its rows."""
    records, heads = headed_records(spark, paths, encoding)
    how = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    names: dict[str, list[str]] = {}
    for row in heads.select("head").distinct().orderBy("head").collect():
        width = row["head"].count(sep) + 1
        cells = spark.range(1).select(F.from_csv(F.lit(row["head"]), ", ".join(f"c{i} string" for i in range(width)), how).alias("c")).select("c.*").first()
        names[row["head"]] = [c.strip() for c in cells if c is not None]
    every = list(dict.fromkeys(c for head in names.values() for c in head))
    out = None
    rows = records.where("record <> ''")
    if len(names) > 1:
        rows = rows.join(heads, "file")
    for head, columns in names.items():
        cells = F.from_csv("record", ", ".join(f"`{c}` string" for c in columns), how)
        one = (rows if len(names) == 1 else rows.where(F.col("head") == head)).select(cells.alias("c")).select(
            *[F.col(f"c.`{c}`") if c in columns else F.lit("").alias(c) for c in every])
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no header line")
    return blanks(out)


def detect_dialect(spark: SparkSession, path: str) -> tuple[str, str]:
    """Delimiter seen most often in the header line, and the encoding: UTF-8 if every line is valid, else Latin-1."""
    lines = spark.read.text(path)
    header = lines.limit(1).collect()
    head = header[0][0] if header else ""
    sep = max(DELIMITERS, key=head.count)
    invalid = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    return sep, "ISO-8859-1" if invalid else "UTF-8"


def read_dialect_csv(spark: SparkSession, path: str) -> DataFrame:
    sep, encoding = detect_dialect(spark, path)
    return read_strings(spark, path, sep, encoding)


def resolve(columns: list[str], fields: dict[str, list[str]] = FIELDS) -> dict[str, str | None]:
    """Column that feeds each canonical field, None where no accepted name is present."""
    return {k: next((a for a in aliases if a in columns), None) for k, aliases in fields.items()}


def canonical(df: DataFrame, fields: dict[str, list[str]] = FIELDS, required: list[str] = REQUIRED) -> DataFrame:
    """Canonical stripped columns of one table; a missing optional field is blank, a missing required one an error."""
    found = resolve(df.columns, fields)
    missing = [k for k in required if found[k] is None]
    if missing:
        raise ValueError(f"required columns not found: {missing}")
    return df.select(*[(text.strip_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c else F.lit("")).alias(k)
                       for k, c in found.items()])


def read_canonical(spark: SparkSession, paths: list[str], fields: dict[str, list[str]] = FIELDS,
                   required: list[str] = REQUIRED) -> DataFrame:
    """Union of several metadata files with differing headers."""
    out = None
    for path in paths:
        one = canonical(read_strings(spark, path), fields, required)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no input files")
    return out


def read_results(spark: SparkSession, glob: str, multi_line: bool = True) -> DataFrame:
    """Nested run results, one indented document per file or one per line; runs without metrics (unfinished) are left out."""
    return (spark.read.schema(RESULT_SCHEMA).json(glob, multiLine=multi_line)
            .withColumn("path", F.col("_metadata.file_path")).where(F.col("metrics").isNotNull()))


def epochs(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.select(*keys, F.explode("run.epochs").alias("e")).select(*keys, "e.*")


def parse_jsonl(lines: DataFrame, schema: str = METRIC_SCHEMA, value: str = "value") -> DataFrame:
    """JSON objects of a text column; blank and malformed lines are skipped."""
    bad = "_corrupt"
    parsed = F.from_json(F.col(value), f"{schema}, {bad} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "allowNonNumericNumbers": "true"})
    keep = [c for c in lines.columns if c != value]
    return (lines.where(text.strip(F.col(value)) != "").select(*keep, parsed.alias("j"))
            .where(F.col("j").isNotNull() & F.col(f"j.{bad}").isNull()).select(*keep, "j.*").drop(bad))


def read_jsonl(spark: SparkSession, path: str, schema: str = METRIC_SCHEMA) -> DataFrame:
    return parse_jsonl(spark.read.text(path), schema)


def read_log_json(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """JSON objects inside a plain log: lines that start with ``{`` and mention ``key``."""
    v = F.col("value")
    lines = spark.read.text(path).where(v.startswith("{") & v.contains(f'"{key}"'))
    return parse_jsonl(lines.select(v, F.col("_metadata.file_path").alias("path")), schema)


def leading_number(c: Column) -> Column:
    """Number before a unit suffix, as in ``123 MiB``; NULL if there is none."""
    return F.regexp_extract(F.trim(c), r"^([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")


def read_telemetry(spark: SparkSession, path: str, fields: int = 4) -> DataFrame:
    """Headerless samples (time, utilisation, memory utilisation, memory used, ...); shorter lines are dropped."""
    p = F.split("value", r"\s*,\s*")
    stamp = F.expr(f"try_to_timestamp(trim(split(value, ',')[0]), '{TELEMETRY_TIME}')")
    return (spark.read.text(path).where(F.size(p) >= fields)
            .select(F.col("_metadata.file_name").alias("log"), stamp.alias("ts"),
                    leading_number(F.get(p, 1)).alias("util"), leading_number(F.get(p, 2)).alias("util_mem"),
                    leading_number(F.get(p, 3)).alias("mem"), leading_number(F.get(p, 4)).alias("power")))
