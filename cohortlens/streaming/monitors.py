"""Live versions of the telemetry, throughput and download-log checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortlens.operators import joins
from cohortlens.operators.runs import ALERT_EPOCHS, ALERT_SHARE, USUAL_SIZE

WATERMARK = "10 minutes"
IDLE_MS = 180_000  # fixed value: a run without news for three minutes is forgotten
ALERT_SCHEMA = "run bigint, epoch bigint, median_last3 double, bench double, alert boolean"
STATE_SCHEMA = "v1 double, v2 double, seen bigint"


def stream_utilisation(samples: DataFrame, window: str = "1 hour", delay: str = WATERMARK, digits: int = 1) -> DataFrame:
    """Utilisation per run and tumbling window of event time; samples later than the watermark are dropped."""
    return (samples.withWatermark("ts", delay).groupBy(F.window("ts", window), "run")
            .agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("util"), digits).alias("util_mean"),
                 F.round(F.lit(100.0) - F.avg("util"), digits).alias("idle_pct"), F.max("mem").alias("mem_max"))
            .select("run", F.col("window.start").alias("window_start"), "samples", "util_mean", "idle_pct", "mem_max"))


def _alerts(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the last two throughputs of a run; emits the median of three from the third epoch on."""
    if state.hasTimedOut:
        state.remove()
        return
    v1, v2, seen = state.get if state.exists else (0.0, 0.0, 0)
    rows = pd.concat(list(frames)).sort_values("epoch")
    series = [v1, v2][2 - min(seen, 2):] + rows["img_per_s"].tolist()
    medians = pd.Series(series).rolling(ALERT_EPOCHS).median().iloc[len(series) - len(rows):]
    rows = rows.assign(median_last3=medians.to_numpy(), run=key[0])
    rows["alert"] = rows["median_last3"] < ALERT_SHARE * rows["bench"]
    last = ([0.0, 0.0] + series)[-2:]
    state.update((float(last[0]), float(last[1]), int(seen) + len(rows)))
    newest = int(rows["ts"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + IDLE_MS)
    yield rows.dropna(subset=["median_last3"])[["run", "epoch", "median_last3", "bench", "alert"]]


def stream_alerts(epochs: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Throughput alerts of ordinary-size runs. ``epochs`` has run, epoch, ts, img, img_per_s and the benchmark ``bench``.
    The state is three numbers per run and ends when event time passes a run by three minutes; rows of one run should
    arrive in the order of their epochs across batches, a batch may hold them in any order and is bounded by the source's
    rate option."""
    rows = epochs.where(F.col("img") == USUAL_SIZE).select("run", "epoch", "ts", "img_per_s", "bench").withWatermark("ts", delay)
    return rows.groupBy("run").applyInPandasWithState(_alerts, ALERT_SCHEMA, STATE_SCHEMA, "append",
                                                      GroupStateTimeout.EventTimeTimeout)


def unseen_entries(log: DataFrame, key: str = "image_id", delay: str = "1 day") -> DataFrame:
    """Stream of log entries without repetitions of (key, size) inside the watermark."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key, "bytes"])


def log_upsert(path: str, key: str = "image_id", order: str = "seq") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends the latest entry of each key of a batch to its own folder; a replayed batch
    overwrites its folder. :func:`latest_log` merges them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        joins.last_entry(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_log(log: DataFrame, key: str = "image_id", order: str = "seq") -> DataFrame:
    """The last entry per key over all ingested batches (folders of :func:`log_upsert`). One batch alone has each key once."""
    if "batch" in log.columns and len(log.select("batch").distinct().limit(2).collect()) < 2:
        return log.drop("batch")
    return joins.last_entry(log.drop("batch"), key, order)
