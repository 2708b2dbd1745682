"""Predictions of many runs to final tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.operators import bootstrap, metrics
from cohortlens.session import materialise


def locked_test_rows(preds: DataFrame, keys: list[str], target: float = metrics.TARGET_SENSITIVITY) -> DataFrame:
    """Test rows with the threshold their run locked on validation. The predictions are stored: thresholds, metrics and
    replicates read them, and none scores them again."""
    preds = materialise(preds, "predictions")
    thr = metrics.locked(preds, keys, target)
    return preds.where("split = 'test'").join(thr, keys)


def runs_long(preds: DataFrame, keys: list[str], n_boot: int = bootstrap.N_BOOT, seed: int = 0) -> DataFrame:
    """One row per run and test source (and ``ALL``): metrics, intervals and number of groups."""
    rows = metrics.with_levels(locked_test_rows(preds, keys))
    by = [*keys, "test_source"]
    point = metrics.metrics_at(rows, by)
    return point.join(bootstrap.bootstrap_ci(rows, by, ["test_source"], n_boot, seed), by)
