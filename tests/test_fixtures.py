"""Queries whose answer on the small tables agrees by chance: tables with the values that tell rules apart."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

import pytest

import __spark_entry__ as entry
import verify
from cohortlens.operators import cohort, graph, joins, quality
from cohortlens.plans import pool
from cohortlens.plans.fixtures import Views


def test_telemetry_stamps_are_cut_to_milliseconds(spark, tmp_path):
    """The last stamp ends on 702 microseconds: rounded it would be a millisecond later."""
    pq.write_table(pa.table({
        "event_id": [1, 2, 13], "ts": pa.array([dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 1, 261702), dt.datetime(2024, 1, 2)], pa.timestamp("us")),
        "user_id": [1, 1, 1], "event_type": ["view", "click", "view"], "value": [1.5, 200.0, 3.0], "props": ['{"k": 3}', '{"k": 4}', '{"k": 5}']}),
        f"{tmp_path}/events.parquet")
    con = verify.duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    line = verify.compare(spark, con, str(tmp_path), "s6_read_telemetry")
    assert line.startswith("ok"), line


@pytest.mark.parametrize("name", ["a12_confusion_at_half", "a13_institution_metrics", "a14_curves", "e1_auroc", "e3_evaluate_locked"])
def test_metrics_see_scores_of_a_thousand_values(name):
    assert "% 1000 as double) / 1000" in entry.oracle_sql()[name]


def test_scores_are_the_same_in_both_engines(spark):
    folder = "/root/testdata/sf0.001"
    rows = Views(spark, folder).predictions(1000).select("run", "image_id", "score").toPandas()
    assert rows["score"].nunique() > 900
    con = verify.connect(folder)
    con.register("got", rows)
    sql = entry.oracle_sql()["e1_auroc"].split(", s AS (SELECT")[0]
    assert con.execute(sql + " SELECT count(DISTINCT g.score), count(*) FILTER (p.score <> g.score) FROM preds p JOIN got g USING (run, image_id)").fetchone() == (rows["score"].nunique(), 0)


def test_copies_are_decided_like_their_clusters(spark):
    rows = [("a", "d1", "benign"), ("b", "d1", "malignant"), ("c", "d2", "benign"), ("d", "d2", "benign"), ("e", "d3", "benign")]
    df = spark.createDataFrame(rows, "image_id string, sha256 string, label string")
    comp = df.selectExpr("image_id", "min(image_id) over (partition by sha256) as component")
    want = {tuple(r) for r in graph.decide_clusters(df, comp).select("image_id", "dup_cluster", "action").collect()}
    assert {tuple(r) for r in graph.decide_copies(df).select("image_id", "dup_cluster", "action").collect()} == want
    blank = spark.createDataFrame([("x", "", "benign"), ("y", "", "malignant"), ("z", None, "benign")], df.schema)
    assert {r.action for r in graph.decide_copies(blank).collect()} == {"keep"}


@pytest.fixture
def shuffled(spark):
    """No broadcast and no adaptive plan: rows stay where the join's keys send them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_blank_keys_do_not_meet_in_one_task(shuffled):
    df = shuffled.range(4000).selectExpr("concat('i', id) as image_id", "if(id % 2 = 0, '', concat('L', id)) as lesion_id")
    held = shuffled.range(4000).selectExpr("concat('L', id * 10 + 1) as lesion_id")
    out = joins.members(df, held, "lesion_id", present=False)
    got = out.selectExpr("lesion_id", "spark_partition_id() as task").collect()
    assert sum(r.lesion_id == "" for r in got) == 2000 and len(got) == 3600
    tasks = [r.task for r in got if r.lesion_id == ""]
    assert max(tasks.count(t) for t in set(tasks)) < 1000


def test_anonymous_rows_do_not_meet_in_one_task(shuffled):
    """Half of the rows are anonymous; where the lookup is no broadcast they are dealt over the tasks."""
    spark = shuffled
    meta = spark.range(4000).selectExpr("concat('i', id) as image_id", "if(id % 2 = 0, ' Anonymous', concat('Lab ', id % 400)) as attribution")
    smap = spark.range(400).selectExpr("concat('Lab ', id) as attribution", "concat('S', id) as source", "'x' as country")
    got = cohort.with_source(meta, smap).selectExpr("source", "image_id", "spark_partition_id() as task").collect()
    assert len(got) == 4000 and sum(r.source == "anonymous" for r in got) == 2000
    assert all(r.source == f"S{int(r.image_id[1:]) % 400}" for r in got if r.source != "anonymous")
    tasks = [r.task for r in got if r.source == "anonymous"]
    assert max(tasks.count(t) for t in set(tasks)) < 1000


def test_pool_and_manifest_are_computed_once_for_the_leaks(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    rows = spark.range(50).selectExpr("concat('i', id) as image_id", "concat('S', id % 5) as source")
    rows = rows.withColumn("image_id", pool.F.udf(told, "string")("image_id"))
    held = spark.createDataFrame([("i3", "S9", "test"), ("i4", "S1", "val"), ("i5", "S0", "train")], "image_id string, source string, split string")
    assert {r.check: r.n for r in quality.pool_leaks(rows, held).collect()} == {"held_out_images": 2, "test_source_images": 0, "empty": 0}
    assert seen.value == 50


def test_decisions_take_whole_log_entries(spark):
    """Two entries of an image with one number: file and digest come from the same one, whatever columns are asked for."""
    v = Views(spark, "/root/testdata/sf0.001")
    tied = v.log().groupBy("image_id", "seq").count().where("count > 1").select("image_id").distinct()
    assert tied.count() == 1
    want = {tuple(r) for r in v.downloads().join(tied, "image_id").select("image_id", "sha256").collect()}
    rows = tied.withColumn("label", pool.F.lit("benign"))
    for logged in (("sha256",), ("file", "sha256")):
        assert {(r.image_id, r.sha256) for r in v.decisions(rows, logged).collect()} == want
