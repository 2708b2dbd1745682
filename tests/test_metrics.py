import hashlib
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.catalog import QUERIES
from cohortlens.operators import bootstrap, metrics, ranking, runs
from cohortlens.plans import evaluation


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def preds():
    rng = random.Random(2)
    out = []
    for run, n in (("hot", 400), ("small", 60), ("oneclass", 20)):
        for i in range(n):
            y = 0 if run == "oneclass" else int(rng.random() < 0.4)
            out.append((run, f"{run}{i}", f"g{rng.randint(0, 15)}", y, round(rng.random() * 0.7 + 0.3 * y, 2)))
    return out


SCHEMA = "run string, image_id string, group_id string, y int, score double"


def test_auroc_and_threshold(spark, preds):
    df = spark.createDataFrame(preds + [("small", "nan", "g0", 1, float("nan"))], SCHEMA)
    got = {r.run: r.auroc for r in metrics.auroc(df, ["run"]).collect()}
    for run in ("hot", "small", "oneclass"):
        rows = [p for p in preds if p[0] == run]
        assert got[run] == pytest.approx(auc([p[3] for p in rows], [p[4] for p in rows]))
    for target in (0.95, 0.5, 1.0, 0.01):
        t = {r.run: r.threshold for r in metrics.threshold(df, ["run"], target).collect()}
        for run in ("hot", "small"):
            pos = sorted((p[4] for p in preds if p[0] == run and p[3]), reverse=True)
            assert t[run] == pos[math.ceil(target * len(pos)) - 1]
    with pytest.raises(ValueError):
        metrics.threshold(df, ["run"], 0.0)
    with pytest.raises(ValueError, match="oneclass"):
        metrics.require_positives(df, ["run"])
    with pytest.raises(ValueError, match="no validation positives"):
        metrics.evaluate_locked(df.withColumn("split", F.lit("val")), ["run"])


def test_predictions_are_read_and_scored_once(spark, preds):
    """Thresholds, metrics and confusion compute a costly score once a row; scores that are no numbers are left out."""
    seen = spark.sparkContext.accumulator(0)

    def costly(x):
        seen.add(1)
        return x

    data = preds[:-40] + [("hot", "nan", "g0", 1, float("nan")), ("hot", "none", "g0", 1, None)]
    rows = [r for r in data if r[0] != "oneclass"]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("split", F.when(F.xxhash64("image_id") % 2 == 0, "val").otherwise("test"))
    df = df.withColumns({"score": F.udf(costly, "double")("score"), "source": F.lit("s"), "threshold": F.lit(0.5)})
    for run in (lambda: metrics.evaluate_locked(df.drop("threshold"), ["run"]), lambda: metrics.institution_metrics(df.drop("threshold"), ["run"]),
                lambda: metrics.confusion(df, ["run"])):
        before = seen.value
        got = run().collect()
        assert seen.value - before == len(rows)
    assert {r.run: r.n for r in got} == {k: sum(r[0] == k and r[4] is not None and r[4] == r[4] for r in rows) for k in ("hot", "small")}


def test_confusion_agrees_with_metrics_at(spark, preds):
    df = spark.createDataFrame(preds, SCHEMA).withColumn("threshold", F.lit(0.5))
    a = {r.run: r.asDict() for r in metrics.confusion(df, ["run"]).collect()}
    b = {r.run: r.asDict() for r in metrics.metrics_at(df, ["run"]).collect()}
    for run in a:
        for k in a[run]:
            assert a[run][k] == pytest.approx(b[run][k]) if a[run][k] is not None else b[run][k] is None
    assert a["oneclass"]["sensitivity"] is None


def h60(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def test_bootstrap_matches_plain_resampling(spark, preds):
    rows = [p for p in preds if p[0] == "small"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"threshold": F.lit(0.5), "u": F.lit(1)})
    n_boot = 12
    got = bootstrap.bootstrap_ci(df, ["u", "run"], ["u"], n_boot, seed=3).first()
    groups = sorted({p[2] for p in rows}, key=lambda g: (hashlib.md5(g.encode()).hexdigest(), g))
    vals, skipped = [], 0
    for b in range(n_boot):
        pick = [p for s in range(len(groups)) for p in rows if p[2] == groups[h60(f"3:{b}:{s}") % len(groups)]]
        v = auc([p[3] for p in pick], [p[4] for p in pick])
        skipped += v is None
        vals += [v] if v is not None else []
    assert (got.n_groups, got.n_skipped_single_class) == (len(groups), skipped)
    assert got.auroc_lo == pytest.approx(np.percentile(vals, 2.5)) and got.auroc_hi == pytest.approx(np.percentile(vals, 97.5))
    p = bootstrap.bootstrap_ci(df, ["u", "run"], ["u"], 40, poisson=True).first()
    assert p.auroc_lo < auc([x[3] for x in rows], [x[4] for x in rows]) < p.auroc_hi


def test_paired_runs(spark, preds):
    rows = [p for p in preds if p[0] == "small"]
    both = rows + [("other", *p[1:4], 1 - p[4]) for p in rows]
    df = spark.createDataFrame(both, SCHEMA).withColumns({"threshold": F.lit(0.5), "u": F.lit(1)})
    pairs = spark.createDataFrame([("x", "small", "other"), ("same", "small", "small")], "comparison string, run_1 string, run_2 string")
    got = {(r.comparison, r.metric): r for r in bootstrap.paired_ci(df, pairs, "run", ["u"], 20).collect()}
    a = auc([p[3] for p in rows], [p[4] for p in rows])
    assert got["x", "auroc"].diff == pytest.approx((1 - a) - a) and got["same", "auroc"].ci_hi == 0
    bootstrap.assert_aligned(pairs, df)
    with pytest.raises(ValueError):
        bootstrap.assert_aligned(pairs, df.where("not (run = 'other' and y = 1)"))


def test_row_index_is_a_plain_row_number(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randint(1, 5), f"x{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, size int, ident string")
    got = {r.ident: r.i for r in ranking.row_index(df, ["k"], [-F.col("size")], [F.col("ident")], "i").collect()}
    for k in "ab":
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in order] == list(range(len(order)))


def test_trailing_median_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 4)
    rng = random.Random(9)
    v = [round(rng.random() * 100, 1) for _ in range(23)]
    e = spark.createDataFrame([(1, "a", "full", 224, i, x) for i, x in enumerate(v)], "run int, backbone string, method string, img int, epoch int, img_per_s double")
    b = spark.createDataFrame([("a", "full", 60.0)], "backbone string, family string, img_per_s double")
    got = {r.epoch: (r.median_last3, r.alert) for r in runs.throughput_alerts(e, b).collect()}
    assert got == {i: (m, m < 54.0) for i in range(2, 23) for m in [sorted(v[i - 2:i + 1])[1]]}


def test_only_planned_values_compete(spark):
    s = spark.createDataFrame([("a", 1e-5, 0.9), ("a", 1e-4, 0.7), ("a", 3e-4, 0.8), ("a", 1e-3, 0.8), ("b", 1e-4, 0.9), ("c", 1e-4, 0.5)], "k string, lr double, best_val_auroc double")
    g = spark.createDataFrame([("a", 1e-4 + 1e-16), ("a", 3e-4), ("a", 1e-3), ("b", 1e-4), ("b", 3e-4), ("d", 1e-4)], "k string, lr double")
    frozen = spark.createDataFrame([("a", 1e-4)], "k string, lr double")
    got = {r.k: (r.best_lr, r.best_score, r.n_values, r.n_missing, r.edge_of_grid, r.changes_frozen) for r in runs.select_best(s, ["k"], grid=g, frozen=frozen).collect()}
    assert got == {"a": (3e-4, 0.8, 3, 0, False, True), "b": (None, None, 2, 1, None, False)}


def test_missing_contrast_is_reported(spark):
    empty = spark.createDataFrame([], "comparison string, img int, frac double, metric string, diff double")
    assert runs.primary_contrast(empty, "x", 224, 1.0, "auroc").first().status == "NOT AVAILABLE"


def test_alignment_of_more_runs_than_bits(spark):
    """More runs than bits in a number, every pair of them, and one run without images. An image is shuffled at most once a task."""
    runs, images = 70, 300
    rows = spark.range(runs).selectExpr("concat('r', id) as run", "id as n").crossJoin(spark.range(images).selectExpr("concat('i', id) as image_id", "id as i"))
    rows = rows.where("not (n % 7 = 3 and i % 10 = n % 10)").repartition(4, "image_id").select("run", "image_id")
    names = spark.range(runs).selectExpr("concat('r', id) as run")
    pairs = names.withColumnRenamed("run", "run_1").crossJoin(names.withColumnRenamed("run", "run_2")).where("run_1 < run_2")
    pairs = pairs.unionByName(spark.createDataFrame([("r0", "unknown")], "run_1 string, run_2 string"))
    got = {(r.run_1, r.run_2): r.n_unmatched for r in bootstrap.check_aligned(pairs, rows).collect()}
    have = {}
    for r in rows.collect():
        have.setdefault(r.run, set()).add(r.image_id)
    want = {(a, b): len(have[a] ^ have.get(b, set())) for a, b in pairs.collect()}
    assert got == want
    plan = bootstrap.check_aligned(pairs, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "image_id" not in plan  # pairs meet counts, not images


def test_sums_of_bytes_by_lanes_carry_nothing():
    """Segments of all sizes around the number of rows that a byte can take, up to the largest multiplicity."""
    rng = np.random.default_rng(5)
    for top, n in ((1, 3), (7, 8), (100, 13), (255, 21)):
        w = rng.integers(0, top + 1, (900, n)).astype(np.uint8)
        w[:300] = top
        lanes = bootstrap._lanes(w)
        group = rng.integers(0, 900, 2000)
        first = np.array([0, 1, 3, 40, 300, 301, 1500])
        want = [w[group[a:b]].sum(axis=0, dtype=np.int64) for a, b in zip(first, [*first[1:], 2000])]
        assert (bootstrap._segment_sums(lambda g: lanes.take(g, axis=0), group, first, top, n) == np.array(want)).all()


def test_locked_test_rows_score_predictions_once(spark, preds):
    """Thresholds, replicates and metrics of a whole report compute a costly score once a row."""
    seen = spark.sparkContext.accumulator(0)

    def costly(x):
        seen.add(1)
        return x

    rows = [r for r in preds if r[0] != "oneclass"]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("split", F.when(F.xxhash64("image_id") % 2 == 0, "val").otherwise("test"))
    df = df.withColumns({"score": F.udf(costly, "double")("score"), "source": F.lit("s")})
    assert evaluation.runs_long(df, ["run"], 10).count() == 4
    assert seen.value == len(rows)


def test_multiplicities_are_the_draws_of_the_slots(spark):
    """Units of different sizes, a part of the replicates: counted in the tasks as the joined draws count them."""
    rows = [(u, f"{u}{i}") for u, n in (("a", 30), ("b", 7), ("c", 1)) for i in range(n)]
    numbered = bootstrap._numbered(spark.createDataFrame(rows, "u string, group_id string"), ["u"])
    got = bootstrap._multiplicities(numbered, len(rows), 3, 20, 4)
    want = np.zeros((len(rows), 17), dtype=int)
    for r in bootstrap._slots(numbered, 3, 20, 4).collect():
        want[r._id, r._b - 3] += 1
    assert (got == want).all()


def test_hashes_of_many_numbers_are_their_md5():
    for head, n in ((b"0:7:", 10500), (b"3:999:", 101), (b"9" * 52 + b":", 1200)):
        assert bootstrap._hashed(head, n).tolist() == [h60(head.decode() + str(i)) for i in range(n)]


def test_rows_meet_multiplicities_by_blocks(spark, preds, monkeypatch):
    """Many small blocks, one group with most rows, rows without a group or a score, several rounds of replicates: the same as
    walking the rows in order, without a table of all multiplicities in the driver."""
    rng = random.Random(6)
    rows = [("s" + str(i % 3), "r" + str(rng.randrange(4)), f"g{min(rng.randrange(90), 40)}", rng.randrange(2), rng.choice([0.5, round(rng.random(), 2)]))
            for i in range(3000)]
    rows += [("s0", "r1", None, 1, 0.4), ("s1", "only", "new", 1, float("nan")), ("s1", "r1", "new", 0, None), ("s3", "r1", "new", 0, 0.2)]
    df = spark.createDataFrame(rows, "u string, run string, group_id string, y int, score double").withColumn("threshold", F.lit(0.5))
    order = ["u", "run", "b"]
    values = [*order, "n_pos", "n_neg", "tp", "false_positives", "auroc"]

    def all_of() -> tuple[list, list]:
        reps = bootstrap.replicates(df, ["run", "u"], ["u"], 13, 2).select(*values).orderBy(*order).collect()
        return reps, sorted(bootstrap.bootstrap_ci(df, ["run", "u"], ["u"], 13, 2).collect())

    with monkeypatch.context() as m:
        m.setattr(bootstrap, "CELLS", 0)
        want = all_of()
    for name, value in (("GROUPS", 4), ("N_BOOT", 5), ("PACK", 500), ("HELD", 100), ("WIDE", 200), ("DRAWN", 300)):
        monkeypatch.setattr(bootstrap, name, value)
    monkeypatch.setattr(bootstrap, "_multiplicities", None)
    got = all_of()
    assert len(got[0]) > 100 and [r[:-1] for r in got[0]] == [r[:-1] for r in want[0]]
    assert [r.auroc for r in got[0]] == pytest.approx([r.auroc for r in want[0]])
    for a, b in zip(got[1], want[1], strict=True):
        assert a[:5] == b[:5] and all(x == y or x == pytest.approx(y) for x, y in zip(a, b))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None


def test_both_sides_of_a_pair_read_stored_replicates(spark, preds):
    df = spark.createDataFrame([(*p[:5],) for p in preds if p[0] != "oneclass"], SCHEMA).withColumns({"threshold": F.lit(0.5), "u": F.lit(1)})
    names = [r.run for r in df.select("run").distinct().collect()]
    pairs = spark.createDataFrame([("same", names[0], names[0])], "comparison string, run_1 string, run_2 string")
    got = bootstrap.paired_ci(df, pairs, "run", ["u"], 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "group_id" not in plan
    assert {(r["diff"], r.ci_lo, r.ci_hi) for r in got.collect()} == {(0.0, 0.0, 0.0)}


def test_digests_of_images_tell_runs_apart(spark):
    """Same number of images, one of them another: a digest differs, whatever the signs of the hashes."""
    rows = [(r, f"i{i if not (r == 'b' and i == 7) else 99}") for r in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "run string, image_id string")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "run_1 string, run_2 string")
    bootstrap.assert_aligned(pairs.where("run_2 = 'a'"), df)
    with pytest.raises(ValueError):
        bootstrap.assert_aligned(pairs, df)


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", ["e6_primary_contrast", "e6_primary_seeds", "e7_runs_long"])
def test_evaluation_queries_sort_no_predictions(spark, monkeypatch, name):
    """Their rows meet the multiplicities by blocks, once; contrasts read stored replicates."""
    monkeypatch.setattr(bootstrap, "_by_ranges", None)
    monkeypatch.setattr(bootstrap, "_multiplicities", None)
    calls = []
    real = bootstrap._by_blocks
    monkeypatch.setattr(bootstrap, "_by_blocks", lambda *args: calls.append(1) or real(*args))
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and (name == "e7_runs_long" or "MapInArrow" not in plan)
    assert df.count() == {"e6_primary_contrast": 2, "e6_primary_seeds": 3, "e7_runs_long": 120}[name]


def test_vectors_of_four_and_eight_bytes_add_up():
    small, large = np.array([1, 2, 3], dtype=np.int32), np.array([1 << 40, 5, 7], dtype=np.int64)
    w = pa.array([small.tobytes(), large.tobytes(), small.tobytes()], pa.binary())
    assert bootstrap._of_vectors(3)(w, np.array([0, 2])).tolist() == [[(1 << 40) + 1, 7, 10], [1, 2, 3]]
