"""Scored predictions: AUROC with ties, locked thresholds, confusion counts.

Scores are summed to one row per distinct value before any ordering, and thresholds and metrics both start from these
sums, so predictions are read once. The ordered pass then runs over ranges of the
scores: ``repartitionByRange`` gives partitions of equal size whatever the keys look like, each range is scanned on its
own, and one row per range is enough to join them up, so a run with a third of all rows is still spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.session import materialise

# ---- fixed value
TARGET_SENSITIVITY = 0.95


def _finite(df: DataFrame) -> DataFrame:
    return df.where(F.col("score").isNotNull() & ~F.isnan("score"))


def _all_counts(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*keys, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"),
                                          F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("neg"),
                                          F.max(F.isnan(F.coalesce("score", F.lit(float("nan"))))).alias("_odd"))


def score_counts(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score; NaN scores are left out. They are told by an aggregate, because a filter
    on the score would be pushed below its computation and compute it again."""
    return _all_counts(df, keys, weight).where("not _odd").drop("_odd")


def auroc_from_counts(counts: DataFrame, keys: list[str], thr: str | None = None) -> DataFrame:
    """(keys, auroc, n_pos, n_neg): share of (positive, negative) pairs in the right order, a tie counting half; NULL if
    a class is missing. With a threshold column ``thr`` also tp and false_positives. ``counts`` may hold several rows for
    one score: they meet in the same range and are added there, without a further shuffle."""
    extra = {} if thr is None else {"tp": "pos", "false_positives": "neg"}
    ranged = (counts.repartitionByRange(*keys, "score").withColumn("_range", F.spark_partition_id())
              .groupBy(*keys, "score", "_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    below = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    ranges = inside.groupBy(*keys, "_range").agg(
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / F.lit(2.0))).alias("_won"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        *[F.sum(F.when(F.col("score") >= F.col(thr), F.col(c)).otherwise(0)).alias(f"_{name}") for name, c in extra.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    p, n = F.sum("_p"), F.sum("_n")
    won = F.sum(F.col("_won") + F.col("_p") * F.col("_before"))
    return joined.groupBy(*keys).agg(F.try_divide(won, p.cast("double") * n.cast("double")).alias("auroc"),
                                     p.alias("n_pos"), n.alias("n_neg"), *[F.sum(f"_{name}").alias(name) for name in extra])


def auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    return auroc_from_counts(score_counts(df, keys), keys)


def threshold(df: DataFrame, keys: list[str], target: float = TARGET_SENSITIVITY) -> DataFrame:
    """(keys, threshold): the largest score whose sensitivity reaches ``target``."""
    _require_target(target)
    return threshold_from_counts(materialise(score_counts(df, keys), "scores"), keys, target)


def _require_target(target: float) -> None:
    if not 0 < target <= 1:
        raise ValueError("target must be above 0 and at most 1")


def threshold_from_counts(counts: DataFrame, keys: list[str], target: float = TARGET_SENSITIVITY) -> DataFrame:
    """The same from positives per score (``counts`` is read twice: it should be a stored table).

    That is the k-th largest positive score with k = ceil(target * positives). One row per range of scores tells which
    range holds it; only that range, a single partition's worth, is then ordered. The result is written to the shared
    folder: its size is then known, and the join back to the predictions need not shuffle them.
    """
    _require_target(target)
    scores = counts.where("pos > 0").groupBy(*keys, "score").agg(F.sum("pos").alias("_pos"))
    ranges = (scores.repartitionByRange(*keys, "score").withColumn("_range", F.spark_partition_id())
              .groupBy(*keys, "_range").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.sum("_pos").alias("_p")))
    higher = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select(*keys, "_lo", "_hi", "_p", F.coalesce(F.sum("_p").over(higher), F.lit(0)).alias("_above"),
                           F.ceil(F.lit(float(target)) * F.sum("_p").over(Window.partitionBy(*keys)).cast("double")).alias("_k"))
    hit = placed.where((F.col("_above") < F.col("_k")) & (F.col("_k") <= F.col("_above") + F.col("_p"))).drop("_p")
    inside = scores.join(hit, keys).where(F.col("score").between(F.col("_lo"), F.col("_hi")))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("_seen", F.col("_above") + F.sum("_pos").over(down)).where(F.col("_seen") >= F.col("_k"))
    return materialise(reached.groupBy(*keys).agg(F.max("score").alias("threshold")), "threshold")


def require_positives(df: DataFrame, keys: list[str]) -> None:
    """Refuses runs whose rows hold no positive: no threshold can be locked on them."""
    bad = df.groupBy(*keys).agg(F.max("y").alias("m")).where("m = 0").limit(20).collect()
    if bad:
        raise ValueError(f"no positives for {[tuple(r[k] for k in keys) for r in bad]}")


def _locked(counts: DataFrame, keys: list[str], target: float) -> DataFrame:
    """``counts``: every split's sums per score, scores that are no numbers included."""
    thr = threshold_from_counts(counts.where("split = 'val' and not _odd"), keys, target)
    bad = counts.select(*keys).distinct().join(thr, keys, "left_anti").limit(20).collect()
    if bad:
        raise ValueError(f"no validation positives for {[tuple(r[k] for k in keys) for r in bad]}")
    return thr


def locked(preds: DataFrame, keys: list[str], target: float = TARGET_SENSITIVITY) -> DataFrame:
    """(keys, threshold) from the validation rows; refuses runs whose validation rows hold no positive with a score."""
    return _locked(materialise(_all_counts(preds, [*keys, "split"]), "scores"), keys, target)


def confusion(df: DataFrame, keys: list[str], thr: str = "threshold") -> DataFrame:
    """Counts and rates at the threshold column; a rate is NULL when its class is empty. Rows are counted by score first:
    conditions on the score itself would each compute it again."""
    flag, pos = F.col("score") >= F.col(thr), F.col("y") == 1
    counts = df.groupBy(*keys, thr, "score").agg(F.count(F.lit(1)).alias("_n"), F.count_if(pos).alias("_pos"), F.count_if(~pos).alias("_neg"),
                                                 F.max(F.isnan(F.coalesce("score", F.lit(float("nan"))))).alias("_odd")).where("not _odd")
    return counts.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
        *[F.sum(F.when(side, F.col(c)).otherwise(0)).alias(name) for name, side, c in (
            ("tp", flag, "_pos"), ("false_negatives", ~flag, "_pos"), ("tn", ~flag, "_neg"), ("false_positives", flag, "_neg"))],
        F.max(thr).alias("threshold")).withColumns(
        {"sensitivity": F.try_divide(F.col("tp").cast("double"), F.col("n_pos")),
         "specificity": F.try_divide(F.col("tn").cast("double"), F.col("n_neg")),
         "flag_rate": (F.col("tp") + F.col("false_positives")) / F.col("n")})


def metrics_at(df: DataFrame, keys: list[str], thr: str = "threshold") -> DataFrame:
    """Confusion counts, rates and AUROC from one aggregation of the predictions."""
    m = auroc_from_counts(score_counts(df, [*keys, thr]), [*keys, thr], thr)
    return rates(m).withColumnRenamed(thr, "threshold")


def rates(m: DataFrame) -> DataFrame:
    """Adds the metrics that follow from n_pos, n_neg, tp and false_positives."""
    return m.withColumns({"n": F.col("n_pos") + F.col("n_neg"), "false_negatives": F.col("n_pos") - F.col("tp"),
                          "tn": F.col("n_neg") - F.col("false_positives"),
                          "sensitivity": F.try_divide(F.col("tp").cast("double"), F.col("n_pos")),
                          "specificity": F.try_divide((F.col("n_neg") - F.col("false_positives")).cast("double"), F.col("n_neg")),
                          "flag_rate": F.try_divide((F.col("tp") + F.col("false_positives")).cast("double"),
                                                    F.col("n_pos") + F.col("n_neg"))})


def with_levels(df: DataFrame, name: str = "test_source") -> DataFrame:
    """Every row twice: in the pooled level ``ALL`` and in the level of its source."""
    return df.withColumn(name, F.explode(F.array(F.lit("ALL"), F.col("source"))))


def metrics_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts, rates and AUROC of sums per score that carry their threshold."""
    return rates(auroc_from_counts(counts, [*keys, "threshold"], "threshold"))


def evaluate_locked(preds: DataFrame, keys: list[str], target: float = TARGET_SENSITIVITY) -> DataFrame:
    """Metrics on validation and test at the threshold locked on validation, from one pass over the predictions."""
    counts = materialise(_all_counts(preds, [*keys, "split"]), "scores")
    return metrics_from_counts(counts.where("not _odd").join(_locked(counts, keys, target), keys), [*keys, "split"])


def institution_metrics(preds: DataFrame, keys: list[str], target: float = TARGET_SENSITIVITY) -> DataFrame:
    """Test metrics pooled and per source, threshold locked on validation, from one pass over the predictions."""
    counts = materialise(_all_counts(preds, [*keys, "split", "source"]), "scores")
    test = counts.where("split = 'test' and not _odd").join(_locked(counts, keys, target), keys)
    return metrics_from_counts(with_levels(test), [*keys, "test_source"])
