"""Structured Streaming monitors (X1-X3), run to the end of the stored events and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.base import query
from cohortlens.catalog.series import ALERTS
from cohortlens.plans.fixtures import Views, with_views
from cohortlens.session import scratch_path
from cohortlens.streaming import monitors


def replay(v: Views, df: DataFrame, tag: str) -> DataFrame:
    """The frame as a stream over files in the shared folder."""
    path = scratch_path(v.spark, tag)
    df.write.parquet(path)
    return v.spark.readStream.schema(df.schema).parquet(path)


def drain(stream: DataFrame, tag: str) -> DataFrame:
    """Runs an append stream over everything available and reads its sink."""
    spark = stream.sparkSession
    out = scratch_path(spark, tag)
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, f"{tag}-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("x1_stream_utilisation", with_views("samples") + """, w AS (SELECT run, date_trunc('hour', ts) AS h, count(*) AS samples, round(avg(util), 4) AS util_mean,
 round(100.0::double - avg(util), 4) AS idle_pct, max(mem) AS mem_max FROM samples GROUP BY ALL)
SELECT run, (epoch_us(h) // 1000000)::bigint AS window_start, samples, util_mean, idle_pct, mem_max FROM w
WHERE epoch_ms(h) + 3600000 <= (SELECT max(epoch_ms(ts)) - 600000 FROM samples)""")
def x1(v: Views) -> DataFrame:
    """Windows the watermark has closed; later ones wait for more data."""
    s = v.samples().select("run", F.col("ts").cast("timestamp").alias("ts"), "util", "mem")
    out = drain(monitors.stream_utilisation(replay(v, s, "samples"), digits=4), "utilisation")
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query("x2_stream_alerts", ALERTS)
def x2(v: Views) -> DataFrame:
    e = v.epochs().select("run", "epoch", "ts", "img", "img_per_s", "backbone", F.when(F.col("method").startswith("lora"), "lora").otherwise("full").alias("family"))
    b = v.benchmark_speed().withColumnRenamed("img_per_s", "bench")
    rows = e.join(b, ["backbone", "family"]).select("run", "epoch", "ts", "img", "img_per_s", "bench")
    return drain(monitors.stream_alerts(replay(v, rows, "epochs")), "alerts").withColumn("median_last3", F.round("median_last3", 6))


@query("x3_unseen_entries", """SELECT DISTINCT user_id AS image_id, cast(json_extract_string(props, '$.k') AS bigint) AS bytes FROM events""")
def x3(v: Views) -> DataFrame:
    log = v.table("events").select(F.col("user_id").alias("image_id"), F.get_json_object("props", "$.k").cast("bigint").alias("bytes"),
                                   F.col("ts").cast("timestamp").alias("ts"))
    return drain(monitors.unseen_entries(replay(v, log, "log"), delay="60 days"), "unseen").select("image_id", "bytes")


@query("x3_latest_log", with_views("downloads") + "SELECT image_id, file, bytes, sha256, api_license, seq FROM downloads")
def x3b(v: Views) -> DataFrame:
    spark = v.spark
    out = scratch_path(spark, "latest")
    log = v.log()  # digests travel as bytes, which have the order of their hexadecimal text
    q = (replay(v, log.withColumn("sha256", F.unhex("sha256")), "downloads").writeStream.foreachBatch(monitors.log_upsert(out))
         .option("checkpointLocation", scratch_path(spark, "latest-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return monitors.latest_log(spark.read.parquet(out)).withColumn("sha256", F.lower(F.hex("sha256"))).select(*log.columns)
