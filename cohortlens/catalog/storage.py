"""Scans and sinks (S1-S10, K1-K5): every query writes a fixture view in the format under test and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.aggregates import r
from cohortlens.catalog.base import query
from cohortlens.functions import text
from cohortlens.plans import pool
from cohortlens.plans.fixtures import Views, with_views
from cohortlens.session import scratch_path
from cohortlens.sources import inventory, readers, writers


def as_text(df: DataFrame, path: str) -> None:
    df.write.text(path)


@query("s1_read_strings", with_views("raw_meta") + "SELECT image_id AS isic_id, license AS copyright_license, lesion_id, age AS age_approx FROM raw_meta")
def s1(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "strings")
    v.raw_meta().select("isic_id", "copyright_license", "lesion_id", "age_approx").write.csv(path, header=True, emptyValue="")
    return readers.read_strings(v.spark, path)


@query("s2_read_dialect_csv", """SELECT cast(s_suppkey AS varchar) AS id, concat(s_name, ', ', 'città') AS name, cast(s_nationkey AS varchar) AS nation,
 'ISO-8859-1' AS encoding, ';' AS sep FROM supplier""")
def s2(v: Views) -> DataFrame:
    """Semicolons and Latin-1, both to be detected."""
    path = scratch_path(v.spark, "dialect")
    s = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(", città")).alias("name"), F.col("s_nationkey").alias("nation"))
    s.write.csv(path, header=True, sep=";", encoding="ISO-8859-1")
    sep, encoding = readers.detect_dialect(v.spark, path)
    return readers.read_dialect_csv(v.spark, path).withColumns({"encoding": F.lit(encoding), "sep": F.lit(sep)})


@query("s3_read_canonical", with_views("meta") + """SELECT image_id, license, attribution, image_type, diagnosis_1, diagnosis_2, diagnosis_3, confirm, lesion_id,
 patient_id, age, sex, body_site FROM meta WHERE license <> 'CC-0' UNION ALL SELECT image_id, license, attribution, image_type, diagnosis_1, '', '',
 confirm, lesion_id, patient_id, age, sex, '' FROM meta WHERE license = 'CC-0'""")
def s3(v: Views) -> DataFrame:
    """Two files with different headers; the second lacks three optional columns."""
    one, two = scratch_path(v.spark, "meta"), scratch_path(v.spark, "meta")
    m = v.raw_meta()
    opts = {"header": True, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    m.where("copyright_license <> 'CC-0'").write.csv(one, **opts)
    rest = m.where("copyright_license = 'CC-0'").withColumnRenamed("copyright_license", "license")
    rest.drop("diagnosis_2", "diagnosis_3", "anatom_site_general").write.csv(two, **opts)
    return readers.read_canonical(v.spark, [one, two])


@query("s4_read_results", with_views("epochs") + """SELECT run AS seed, count(*) AS n_epochs, round(max(val_auroc), 6) AS best, round(sum(img_per_s), 3) AS total
FROM epochs WHERE run IN (SELECT run FROM runs WHERE method <> 'frozen') GROUP BY run""")
def s4(v: Views) -> DataFrame:
    """One nested JSON document per run; frozen runs have no metrics and are skipped."""
    path = scratch_path(v.spark, "results")
    per = v.epochs().groupBy("run", "backbone", "method").agg(
        F.collect_list(F.struct("epoch", "val_auroc", "img_per_s", "elapsed_s")).alias("epochs"))
    doc = F.struct("backbone", "method", F.col("run").alias("seed"), F.struct("epochs").alias("run"),
                   F.when(F.col("method") != "frozen", F.struct(F.struct(F.lit(0.5).alias("auroc")).alias("test"))).alias("metrics"))
    as_text(per.select(F.to_json(doc).alias("value")), path)
    e = readers.epochs(readers.read_results(v.spark, path, multi_line=False), ["seed"])
    return e.groupBy("seed").agg(F.count(F.lit(1)).alias("n_epochs"), F.round(F.max("val_auroc"), 6).alias("best"),
                                 F.round(F.sum("img_per_s"), 3).alias("total"))


def metric_lines(v: Views) -> DataFrame:
    """Metric entries as JSON lines; every seventh line is cut off, every eleventh blank."""
    m = v.metric_log()
    line = F.to_json(F.struct("iteration", "iter_time", "data_time", "max_mem"))
    i = F.col("iteration")
    return m.select(F.when(i % 11 == 0, "  ").when(i % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))


@query("s5_read_jsonl", with_views("mlog") + """SELECT iteration, round(iter_time, 6) AS iter_time, round(data_time, 6) AS data_time, round(max_mem, 6) AS max_mem
FROM mlog WHERE iteration % 11 <> 0 AND iteration % 7 <> 0""")
def s5(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "jsonl")
    as_text(metric_lines(v), path)
    return readers.read_jsonl(v.spark, path).select("iteration", r("iter_time"), r("data_time"), r("max_mem"))


@query("s6_read_telemetry", """SELECT count(*) AS n, round(sum(least(value, 100)), 3) AS util, sum(cast(json_extract_string(props, '$.k') AS bigint))::double AS mem,
 max(epoch_us(ts) // 1000)::bigint AS last_ms FROM events WHERE event_id % 13 <> 0""")
def s6(v: Views) -> DataFrame:
    """Samples as a headerless log with a unit after the memory; every thirteenth line is too short. Stamps hold whole
    milliseconds: what is finer is cut off, not rounded."""
    path = scratch_path(v.spark, "telemetry")
    s = v.samples()
    stamp = F.date_format(F.col("ts").cast("timestamp"), readers.TELEMETRY_TIME)
    util = v.table("events").select("event_id", F.least("value", F.lit(100.0)).alias("u"))
    s = s.join(util, "event_id")
    line = F.concat_ws(", ", stamp, F.col("u").cast("string"), F.lit("0"), F.concat((F.col("mem") / 100).cast("bigint").cast("string"), F.lit(" MiB")))
    as_text(s.select(F.when(F.col("event_id") % 13 == 0, stamp).otherwise(line).alias("value")), path)
    t = readers.read_telemetry(v.spark, path)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("util"), 3).alias("util"), F.sum("mem").alias("mem"),
                 F.max(F.unix_millis("ts")).alias("last_ms"))


@query("s7_read_log_json", """SELECT event_id AS epoch, round(value, 6) AS img_per_s FROM events WHERE event_type NOT IN ('error', 'view')""")
def s7(v: Views) -> DataFrame:
    """Epoch lines among plain messages and other JSON lines."""
    path = scratch_path(v.spark, "log")
    e = v.table("events")
    line = F.to_json(F.struct(F.col("event_id").alias("epoch"), F.col("value").alias("img_per_s")))
    other = F.to_json(F.struct(F.col("event_id").alias("epoch")))
    as_text(e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("warning: "), line)).when(F.col("event_type") == "view", other)
                     .otherwise(line).alias("value")), path)
    return readers.read_log_json(v.spark, path, "img_per_s", "epoch bigint, img_per_s double").select("epoch", r("img_per_s"))


def stored_pages(v: Views) -> str:
    """A folder with the pages as files: language, part of eight, one file."""
    path = scratch_path(v.spark, "stored")
    pages = v.table("pages").where("html is not null").select(
        F.coalesce(F.nullif(F.regexp_extract("url", "/(fr|en|de|es)/", 1), F.lit("")), F.lit("other")).alias("folder"), (F.col("page_id") % 8).alias("part"), "html")
    pages.repartition("folder", "part").write.partitionBy("folder", "part").text(path)
    return path


STORED = """WITH stored AS (SELECT coalesce(nullif(regexp_extract(url, '/(fr|en|de|es)/', 1), ''), 'other') AS folder, page_id % 8 AS part,
 sum(octet_length(encode(html)) + 1)::bigint AS length FROM pages WHERE html IS NOT NULL GROUP BY ALL)
"""


@query("s8_file_inventory", STORED + """SELECT CASE folder WHEN 'fr' THEN 'french' ELSE 'english' END AS name, count(*) AS files,
 round(sum(length) / 1073741824.0::double, 2) AS gib, sum(length)::bigint AS bytes FROM stored WHERE folder IN ('fr', 'en') GROUP BY folder""")
def s8(v: Views) -> DataFrame:
    """Files that stand in real folders."""
    return inventory.file_inventory(inventory.list_files(v.spark, stored_pages(v)), {"french": "folder=fr", "english": "/folder=en/", "none": "folder=e"})


@query("s9_cached_features", with_views("vecs") + "SELECT image_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) AS total FROM vecs")
def s9(v: Views) -> DataFrame:
    """Built on the first call and read from the cache on the second, which must not build again."""
    path = scratch_path(v.spark, "features")
    keys = v.vectors()
    inventory.cached_features(keys, path, lambda k: k.select("image_id", "embedding"))

    def refuse(_: DataFrame) -> DataFrame:
        raise AssertionError("the cache was not used")

    f = inventory.cached_features(keys, path, refuse)
    return f.select("image_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def listing(v: Views) -> DataFrame:
    """Stored files: those the log gives a licence. The others stand in another folder, which does not count."""
    return v.downloads().select(F.when(F.col("api_license").isNull(), F.concat(F.lit("rejected/"), "file")).otherwise(F.col("file")).alias("path"),
                                F.col("bytes").alias("length"))


@query("s10_existing_files", with_views("downloads") + "SELECT image_id, file FROM downloads WHERE file IN (SELECT file FROM downloads WHERE api_license IS NOT NULL)")
def s10(v: Views) -> DataFrame:
    return inventory.existing_files(v.downloads(), listing(v)).select("image_id", "file")


@query("s10_missing_files", with_views("downloads") + "SELECT count(*) AS missing FROM downloads WHERE file NOT IN (SELECT file FROM downloads WHERE api_license IS NOT NULL)")
def s10b(v: Views) -> DataFrame:
    return inventory.missing_files(v.downloads(), listing(v))


@query("k1_write_table", with_views("cohort") + "SELECT * FROM cohort")
def k1(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "cohort")
    writers.write_table(v.cohort(), path, ["source", "image_id"], "csv")
    return readers.read_strings(v.spark, path)


@query("k2_write_summary", with_views("cohort") + """SELECT concat('{"images":', count(*), ',"sources":', count(DISTINCT source), ',"malignant":',
 count(*) FILTER (label = 'malignant'), '}') AS value FROM cohort""")
def k2(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "summary")
    s = v.cohort().agg(F.count(F.lit(1)).alias("images"), F.countDistinct("source").alias("sources"),
                       F.count_if(F.col("label") == "malignant").alias("malignant"))
    writers.write_summary(s, path)
    return v.spark.read.text(path)


@query("k3_format_report", with_views("runs") + """SELECT unnest(['| Backbone | Method | Runs | GPU-h |', '|---|---|---|---|']) AS value UNION ALL SELECT concat('| ', backbone, ' | ', method, ' | ', count(*), ' | ', printf('%.3f', max(gpu_hours)), ' |') AS value
FROM runs GROUP BY backbone, method""")
def k3(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "report")
    t = v.runs().groupBy("backbone", "method").agg(F.count(F.lit(1)).alias("n"), text.decimals3(F.max("gpu_hours")).alias("hours"))
    writers.format_report(t.orderBy("backbone", "method"), ["backbone", "method", "n", "hours"], path, ["Backbone", "Method", "Runs", "GPU-h"])
    return v.spark.read.text(path)


@query("k4_write_file_list", with_views("cohort", "downloads") + "SELECT file AS value FROM cohort JOIN downloads USING (image_id) WHERE api_license IS NOT NULL")
def k4(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "list")
    writers.write_file_list(pool.file_list(v.cohort(), v.downloads(), F.col("api_license").isNull()), path)
    return v.spark.read.text(path)


@query("k5_fingerprint", with_views("cohort") + """, f AS (SELECT ('0x' || substr(sha256(concat_ws('|', concat('=', image_id), concat('=', source), concat('=', label))), 1, 15))::bigint AS h FROM cohort)
SELECT count(*) AS n_rows, bit_xor(h) AS xor60, sum(h >> 36)::bigint AS sum24 FROM f""")
def k5(v: Views) -> DataFrame:
    return writers.fingerprint(v.cohort(), ["image_id", "source", "label"])
