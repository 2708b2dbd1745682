import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import selection


def test_quantiles_equal_a_full_sort(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 16)
    monkeypatch.setattr(selection, "BUCKETS", 32)
    rng = np.random.default_rng(3)
    series = {"normal": rng.standard_normal(501), "even": rng.random(200), "ties": rng.integers(0, 3, 300).astype(float), "one": np.array([7.5]),
              "scales": 10.0 ** rng.uniform(-300, 300, 120) * rng.choice([-1, 1], 120), "same": np.full(50, -2.0),
              "outlier": np.append(rng.random(99), 1e308), "ends": np.append(rng.random(40), [np.inf, -np.inf, -np.inf])}
    rows = [(k, float(v)) for k, vs in series.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in selection.quantile(df, ["k"], "v", 0.37, "m").collect()}
    assert got.keys() == series.keys()
    for k, vs in series.items():
        assert got[k] == pytest.approx(np.quantile(vs, 0.37), rel=1e-12), k
    whole = selection.quantile(df.where("k = 'normal'"), [], "v").collect()
    assert [tuple(r) for r in whole] == [(pytest.approx(np.median(series["normal"])),)]
    assert selection.quantile(df.where("k = 'none'"), ["k"], "v").collect() == []


def test_no_task_collects_a_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.rand(1).alias("v"))
    plan = selection.quantile(df, ["k"], "v")._jdf.queryExecution().toString()
    assert "percentile" not in plan
