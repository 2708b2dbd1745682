"""Cohort, partition, pool, quality, sources and streams on small planted data."""

import json

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort, folds, graph, joins, quality, sampling, telemetry
from cohortlens.plans import pool
from cohortlens.session import scratch_path
from cohortlens.sources import inventory, readers
from cohortlens.streaming import monitors

HEADER = ["isic_id", "copyright_license", "attribution", "image_type", "diagnosis_1", "diagnosis_2", "diagnosis_3", "diagnosis_confirm_type",
          "lesion_id", "patient_id", "age_approx", "sex", "anatom_site_general"]


def meta_rows():
    """Four hospitals as a table of cases: 60 biopsied images of 30 patients (two of each, classes by patient), 10 judged by
    experts without any id, and one image under a second name, patient and lesion."""
    def image(number, **given):
        usual = {"isic_id": f"I{number:04d}", "copyright_license": ("CC-0", "CC-BY", "CC-BY-NC")[number % 3], "image_type": "dermoscopic",
                 "diagnosis_1": "Benign", "diagnosis_confirm_type": "histopathology"}
        return {**dict.fromkeys(HEADER, ""), **usual, **given}

    biopsied = [image(70 * h + i + 1, attribution=f"Synth{name}  hospital ", diagnosis_1=("Benign", "Malignant")[i // 2 % 2], lesion_id=f"L{name}{i // 2}",
                      patient_id=f"P{name}{i // 2}", age_approx="40", sex="female", anatom_site_general="trunk")
                for h, name in enumerate("ABCD") for i in range(60)]
    judged = [image(70 * h + 61 + i, copyright_license="CC-0", attribution=f"Synth{name} Hospital", diagnosis_confirm_type="single image expert consensus")
              for h, name in enumerate("ABCD") for i in range(10)]
    again = {**biopsied[0], "isic_id": "X1", "lesion_id": "LX", "patient_id": "PX"}
    return [tuple(row[c] for c in HEADER) for row in (*judged, again, *biopsied)]


@pytest.fixture(scope="module")
def job(spark):
    meta = readers.canonical(spark.createDataFrame(meta_rows(), ", ".join(f"{c} string" for c in HEADER)))
    smap = spark.createDataFrame([("SynthA Hospital", "SynthA", "Italy"), ("SynthB Hospital", "SynthB", "Spain"), ("SynthC hospital", "SynthC", "USA")],
                                 "attribution string, source string, country string")
    c = cohort.build_cohort(meta, smap)
    sha = F.when(F.col("image_id").isin("I0001", "X1"), "same").otherwise(F.col("image_id"))
    dec = c.select("image_id", F.concat("image_id", F.lit(".jpg")).alias("file"), sha.alias("sha256"),
                   F.when(sha == "same", "dup1").otherwise("").alias("dup_cluster"), F.when(sha == "same", "cluster").otherwise("keep").alias("action"))
    return meta, smap, c.persist(), dec.persist()


def test_cohort_sources_and_verdicts(job):
    meta, smap, c, _ = job
    assert {r.source: r["count"] for r in c.groupBy("source").count().collect()} == {"SynthA": 61, "SynthB": 60, "SynthC": 60, "SynthD_hospital": 60}
    verdict = {r.source: r.test_candidate for r in cohort.test_candidates(cohort.profile_sources(c, smap), 10).collect()}
    assert verdict["SynthA"] == "yes" and verdict["SynthD_hospital"] == "no: institution not verified in source_map, country unknown"
    steps = {r.step: r.removed for r in cohort.exclusion_report(meta).collect()}
    assert steps["not_histopathology"] == 40 and steps["eligible"] == 241


def test_duplicates_and_blank_ids(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("", "1"), ("", "2"), ("c", "1")], "image_id string, x string")
    assert {r.image_id for r in cohort.unique_records(df).collect()} == {"a", "c"}
    assert tuple(cohort.duplicate_counts(df).first()) == (1, 2)
    assert {r.image_id for r in cohort.conflicting_ids(df).collect()} == {"b", ""}


def test_partition_rules(spark, job):
    _, smap, c, dec = job
    with pytest.raises(ValueError, match="not verified"):
        folds.check_test_sources(c, ["SynthD_hospital"], smap)
    with pytest.raises(ValueError, match="unknown"):
        folds.check_test_sources(c, ["Nowhere"], smap)
    folds.check_test_sources(c, ["SynthC"], smap)
    m = folds.partition(c, dec, ["SynthC"]).persist()
    folds.assert_partition(m)
    rows = m.collect()
    assert {r.source for r in rows if r.split == "test"} == {"SynthC"} and len(rows) == 240  # one exact copy removed
    assert {r.split for r in rows} == {"train", "val", "test"}
    n = {f: sum(r.split == "train" and float(r.train_frac) <= f + 1e-9 for r in rows) for f in (0.1, 0.3, 1.0)}
    assert 0 < n[0.1] < n[0.3] < n[1.0]
    val = sum(r.split == "val" for r in rows) / sum(r.split != "test" for r in rows)
    assert 0.08 < val < 0.22
    q = {r.check: r.n for r in quality.qc_leakage(m).collect()}
    assert q == {"patients_in_several_splits": 0, "lesions_in_several_splits": 0, "bad_split": 0}
    again = {(r.image_id, r.split, r.train_frac) for r in folds.partition(c.repartition(3), dec, ["SynthC"]).collect()}
    assert again == {(r.image_id, r.split, r.train_frac) for r in rows}
    bad = m.withColumn("split", F.when(F.col("image_id") == "I0001", "test").otherwise(F.col("split")))
    with pytest.raises(ValueError):
        folds.assert_partition(bad)
    meta = job[0]
    p = pool.select_pool(meta, smap, m)
    assert {r.n for r in quality.pool_leaks(p, m).collect()} == {0}


def test_nested_read_keeps_held_out_rows(spark):
    df = spark.createDataFrame([("a", "train", "0.1", "benign"), ("b", "train", "1.0", "benign"), ("c", "test", "", "malignant")],
                               "image_id string, split string, train_frac string, label string")
    assert {r.image_id for r in folds.read_manifest(df, 0.3).collect()} == {"a", "c"}


def test_quality_planted(spark):
    rows = [("a.jpg", "p1", "l1", "nevo", "istologia", "train"), ("a.jpg", "p2", "l1", "melanoma", "x", "test"), ("b c", "", "", "", "", ""),
            ("d", "p1", "", "?", "nessuna", "val")]
    df = spark.createDataFrame(rows, "image_id string, patient_id string, lesion_id string, label string, label_source string, split string")
    q = {r.check: r.n for r in quality.qc_basic(df).collect()}
    assert (q["duplicate_ids"], q["unsafe_names"], q["blank_lesion_id"]) == (1, 1, 2)
    assert tuple(quality.qc_vocabulary(df).first()) == (1, 1) and tuple(quality.qc_lesions(df).first()) == (1, 1)
    assert {r.check: r.n for r in quality.qc_leakage(df).collect()}["patients_in_several_splits"] == 1
    with pytest.raises(ValueError):
        quality.qc_basic(df.drop("label"))


def test_readers(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿id;name\n1;città\n2;\n".encode("utf-8"))
    df = readers.read_dialect_csv(spark, str(tmp_path / "bom.csv"))
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.collect()] == [("1", "città"), ("2", "")]
    (tmp_path / "latin.csv").write_bytes("id\tname\n1\tcittà\n".encode("latin-1"))
    assert readers.read_dialect_csv(spark, str(tmp_path / "latin.csv")).first().name == "città"
    (tmp_path / "m.jsonl").write_text('{"iteration": 1, "total_loss": NaN}\n\n{"iteration": 2, "to\nnot json\n{"iteration": 3}\n')
    assert sorted(r.iteration for r in readers.read_jsonl(spark, str(tmp_path / "m.jsonl")).collect()) == [1, 3]
    (tmp_path / "gpu.csv").write_text("2026/01/01 00:00:00.500, 50, 3, 123 MiB, 70.5\nbroken, 1\n2026/01/01 00:00:02.000, 0, 3, 200 MiB\n")
    t = readers.read_telemetry(spark, str(tmp_path / "gpu.csv"))
    s = telemetry.summarise_samples(t, ["log"]).first()
    assert (s.samples, s.duration_s, s.util_mean, s.pct_samples_util_0) == (2, 1.5, 25.0, 50.0)
    (tmp_path / "log.txt").write_text('start\n{"x": 1}\n{"epoch": 1, "img_per_s": 3.5}\n')
    assert [r.img_per_s for r in readers.read_log_json(spark, str(tmp_path / "log.txt"), "img_per_s", "epoch int, img_per_s double").collect()] == [3.5]
    (tmp_path / "r").mkdir()
    run = {"backbone": "a", "method": "full", "seed": 1, "metrics": {"test": {"auroc": 0.5}}, "run": {"epochs": [{"epoch": 0, "img_per_s": 1.0}]}}
    (tmp_path / "r" / "results.json").write_text(json.dumps(run, indent=1))
    (tmp_path / "r" / "unfinished.json").write_text(json.dumps({"backbone": "b"}, indent=1))
    assert readers.epochs(readers.read_results(spark, str(tmp_path / "r" / "*.json")), ["backbone"]).count() == 1
    files = inventory.list_files(spark, f"file://{tmp_path}/")
    assert inventory.file_inventory(files, {"runs": "r", "none": "es"}).first().files == 2
    assert {r.path for r in files.collect()} == {p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()}
    wanted = spark.createDataFrame([("r/results.json",), ("results.json",), ("log.txt",), ("other/log.txt",), (None,)], "file string")
    assert {r.file for r in inventory.existing_files(wanted, files).collect()} == {"r/results.json", "log.txt"}
    assert inventory.missing_files(wanted, files).first().missing == 3
    with pytest.raises(ValueError):
        readers.canonical(spark.createDataFrame([("1",)], "isic_id string"))


def test_cache_mismatch_is_refused(spark):
    path = scratch_path(spark, "cache")
    a = spark.createDataFrame([("a",), ("b",)], "image_id string")
    build = lambda k: k.withColumn("f", F.lit(1.0))
    assert inventory.cached_features(a, path, build).count() == 2
    with pytest.raises(ValueError):
        inventory.cached_features(a.where("image_id = 'a'"), path, build)


def test_short_log_and_non_finite_loss(spark):
    rows = [("r", i, 1.0, 0.5, float("nan") if i == 1 else float(i), 10.0) for i in range(3)]
    df = spark.createDataFrame(rows, "run string, iteration long, iter_time double, data_time double, total_loss double, max_mem double")
    s = telemetry.summarise_metrics(df, ["run"], skip=20, batch=48).first()
    assert (s.entries, s.median_iter_time_s, s.items_per_s, s.data_time_fraction, s.loss_non_finite) == (3, 1.0, 48.0, 0.5, 1)


def test_samples(spark):
    df = spark.createDataFrame([(f"x{i}", int(i % 10 == 0)) for i in range(200)], "image_id string, y int")
    assert {r.image_id for r in sampling.sample_n(df, 20).collect()} == {r.image_id for r in sampling.sample_n(df.repartition(5), 20).collect()}
    got = sampling.balanced_sample(df, 400).groupBy("y").count().collect()
    assert sum(r["count"] for r in got) == 400 and all(150 < r["count"] < 250 for r in got)
    assert sampling.class_weights(df).agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


def test_last_entry_wins(spark):
    log = spark.createDataFrame([("a", "f1", 1), ("a", "f2", 3), ("a", "f3", 2), ("b", "g", 1)], "image_id string, file string, seq long")
    assert {r.image_id: r.file for r in joins.last_entry(log).collect()} == {"a": "f2", "b": "g"}


def test_alert_state_spans_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "run long, epoch long, ts timestamp, img long, img_per_s double, bench double"
    base = spark.createDataFrame([(1, e, 224, v, 100.0) for e, v in enumerate([100.0, 80.0, 85.0, 95.0, 99.0])],
                                 "run long, epoch long, img long, img_per_s double, bench double")
    rows = base.withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("epoch"))).select("run", "epoch", "ts", "img", "img_per_s", "bench")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in ("epoch < 2", "epoch >= 2"):
        rows.where(part).coalesce(1).write.mode("append").parquet(src)
        q = (monitors.stream_alerts(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination(120)
    got = {r.epoch: (r.median_last3, r.alert) for r in spark.read.parquet(out).collect()}
    assert got == {2: (85.0, True), 3: (85.0, True), 4: (95.0, False)}


def test_eligible_records_are_the_unique_ones_that_pass(spark):
    """Copies, conflicts inside and between eligible and other rows, and nulls that only their place tells apart."""
    names = ["image_id", "image_type", "confirm", "diagnosis_1", "sex", "body_site"]
    good, other = ("dermoscopic", "histopathology", "benign"), ("clinical", "histopathology", "benign")
    rows = [("a", *good, "f", "x"), ("a", *good, "f", "x"), ("b", *good, "f", "x"), ("b", *good, "m", "x"), ("c", *good, "f", None), ("c", *good, None, "f"),
            ("d", *good, "f", "x"), ("d", *other, "f", "x"), ("e", *other, "f", "x"), ("f", *good, None, None), ("f", *good, None, None), ("", *good, "f", "x")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    steps = cohort.eligibility_steps()
    got = cohort.eligible_records(df, steps)
    assert got.columns == names
    assert {tuple(r) for r in got.collect()} == {rows[0], rows[9]} == {tuple(r) for r in cohort.apply_steps(cohort.unique_records(df), steps).collect()}
    plan = cohort.eligible_records(df, steps).select("sex")._jdf.queryExecution().optimizedPlan().toString()
    assert "max(body_site" not in plan and "max(sex" in plan and "struct" not in plan


def test_source_gates_compute_the_cohort_once(spark, monkeypatch):
    import __spark_entry__ as entry

    from cohortlens.plans import fixtures

    seen, whole = spark.sparkContext.accumulator(0), fixtures.Views.cohort

    def counted(self):
        def note(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        c = whole(self)
        return c.mapInArrow(note, c.schema)

    rows = whole(fixtures.Views(spark, "/root/testdata/sf0.01")).count()
    monkeypatch.setattr(fixtures.Views, "cohort", counted)
    assert entry.queries()["p11_input_gates"](spark, "/root/testdata/sf0.01").count() > 0
    assert seen.value == rows


def test_file_list_computes_its_rows_once(spark, tmp_path):
    from cohortlens.sources import writers

    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    log = spark.createDataFrame([(f"i{i}", f"f{i}", None if i == 3 else "CC-0") for i in range(5)], "image_id string, file string, api_license string")
    rows = spark.createDataFrame([(f"i{i}", "CC-0", "me") for i in range(1, 6)], "image_id string, license string, attribution string")
    listed = pool.file_list(rows.mapInArrow(note, rows.schema), log, F.col("api_license").isNull())
    writers.write_file_list(listed, str(tmp_path / "list"))
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).orderBy("value").collect()] == ["f1", "f2", "f4"]
    assert spark.read.csv(str(tmp_path / "list_attribution"), header=True).count() == 3 and seen.value == 5


def test_invariants_of_groups_and_copies(spark):
    bad = spark.createDataFrame([("g", "train", "1"), ("g", "val", "2"), ("h", "test", "3"), ("h", "test", "3"), ("i", "train", "3"), ("j", None, ""), ("j", "val", "")],
                                "group_id string, split string, sha256 string")
    assert tuple(folds.invariants(bad).first()) == (1, 1)
    assert tuple(folds.invariants(bad.withColumn("sha256", F.unhex(F.concat("sha256", "sha256")))).first()) == (1, 1)


def test_latest_log_over_one_and_several_batches(spark, tmp_path):
    cols = "image_id string, file string, seq long"
    one, two = (spark.createDataFrame(r, cols) for r in ([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], [("a", "0", 1), ("b", "4", 5)]))
    write = monitors.log_upsert(str(tmp_path))
    write(one, 0)
    alone = monitors.latest_log(spark.read.parquet(str(tmp_path)))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in alone.select("image_id", "file").collect()} == {("a", "2"), ("b", "3")}
    write(two, 1)
    assert {tuple(r) for r in monitors.latest_log(spark.read.parquet(str(tmp_path))).select("image_id", "file").collect()} == {("a", "2"), ("b", "4")}


def test_partition_stores_wide_rows_once(spark, job, monkeypatch):
    """Linking, folds and copies store only what they read; digests as bytes give the partition of digests as text."""
    _, _, c, dec = job
    want = sorted(folds.partition(c, dec, ["SynthC"]).collect())
    stored = {}
    real = folds.materialise
    monkeypatch.setattr(folds, "materialise", lambda df, tag: stored.setdefault(tag, df.columns) and real(df, tag))
    narrow = folds.partition(c, dec.withColumn("sha256", F.col("sha256").cast("binary")), ["SynthC"])
    assert sorted(narrow.withColumn("sha256", F.col("sha256").cast("string")).collect()) == want
    assert set(stored) == {"usable", "linked", "single"}
    for tag in ("linked", "single"):
        assert not {"attribution", "license", "file", "sha256", "diagnosis_detail"} & set(stored[tag])


def test_copies_of_byte_digests_are_those_of_text(spark):
    rows = [("a", b"x", "1"), ("b", b"x", "2"), ("c", b"", "1"), ("d", None, "1"), ("e", b"y", "1"), ("f", b"y", "1"), ("g", b"z", "1")]
    df = spark.createDataFrame(rows, "image_id string, sha256 binary, label string")
    text = df.withColumn("sha256", F.col("sha256").cast("string"))
    got = graph.decide_copies(df)
    assert got.columns == ["image_id", "sha256", "label", "dup_cluster", "action"] and dict(got.dtypes)["sha256"] == "binary"
    got = {tuple(r) for r in got.withColumn("sha256", F.col("sha256").cast("string")).collect()}
    assert got == {tuple(r) for r in graph.decide_copies(text).collect()}
    assert {(i, s, c) for i, s, _, c, _ in got} == {("a", "x", "dupa"), ("b", "x", "dupa"), ("c", "", ""), ("d", None, ""), ("e", "y", "dupe"), ("f", "y", "dupe"), ("g", "z", "")}
