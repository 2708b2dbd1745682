"""Frozen-feature probe: standardised, class-balanced logistic regression per nested training fraction (Spark ML)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators import folds

# ---- fixed values
C = 1.0
MAX_ITER = 5000


def with_features(manifest: DataFrame, features: DataFrame, key: str = "image_id") -> DataFrame:
    """Manifest rows with their stored feature array; rows without one are an error the caller can count by anti-join."""
    return manifest.join(features, key)


def fit_probe(df: DataFrame, fractions: tuple[float, ...] = folds.FRACTIONS, features: str = "embedding",
              max_iter: int = MAX_ITER) -> DataFrame:
    """Scores of validation and test rows for each fraction. ``df`` has split, train_frac, y and the feature array.

    The squared-norm penalty matches an inverse regularisation strength C on the summed loss: 1 / (C * sum of weights),
    where balanced weights n / (2 n_class) sum to n.
    """
    rows = df.withColumn("_v", array_to_vector(F.transform(features, lambda x: x.cast("double")))).persist()
    out = None
    for frac in fractions:
        train = rows.where("split = 'train'").where(folds.within_fraction(frac))
        n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
        if len(n) < 2:
            raise ValueError(f"training rows at {frac} hold a single class")
        total = sum(n.values())
        w = F.when(F.col("y") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0]))
        scaler = StandardScaler(inputCol="_v", outputCol="_x", withMean=True, withStd=True).fit(train)
        lr = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="_w", regParam=1.0 / (C * total),
                                elasticNetParam=0.0, standardization=False, maxIter=max_iter)
        model = lr.fit(scaler.transform(train).withColumn("_w", w))
        held = model.transform(scaler.transform(rows.where("split <> 'train'")))
        one = held.select("image_id", "split", "group_id", "source", "y", F.lit(frac).alias("frac"),
                          vector_to_array("probability")[1].alias("score"))
        out = one if out is None else out.unionByName(one)
    return out
