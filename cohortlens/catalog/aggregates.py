"""Aggregations over the cohort, the duplicate pairs, the runs and the telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.base import query
from cohortlens.operators import arrays, cohort, folds, metrics, quality, runs, similarity, telemetry
from cohortlens.plans import fixtures
from cohortlens.plans.fixtures import GRID, NEAR, N_BITS, TEST_SOURCES, Views, with_views
from cohortlens.session import materialise, scratch_path
from cohortlens.sources import inventory


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@query("a1_value_counts", with_views("meta") + """
SELECT CASE WHEN diagnosis_3 = '' THEN '(blank)' ELSE diagnosis_3 END AS value, count(*) AS n FROM meta GROUP BY 1""")
def a1(v: Views) -> DataFrame:
    return cohort.value_counts(v.meta(), "diagnosis_3")


@query("a2_distinct_ids", with_views("meta") + """
SELECT count(DISTINCT nullif(patient_id, '')) AS patients, count(DISTINCT nullif(lesion_id, '')) AS lesions FROM meta""")
def a2(v: Views) -> DataFrame:
    return cohort.distinct_ids(v.meta())


PROFILE = """, conf AS (SELECT source, count(*) AS k FROM (SELECT source, lesion_id FROM cohort WHERE lesion_id <> ''
  GROUP BY ALL HAVING count(DISTINCT label) > 1) GROUP BY source),
lic AS (SELECT source, string_agg(concat(license, '=', n), ',' ORDER BY license) AS licenses
  FROM (SELECT source, license, count(*) AS n FROM cohort GROUP BY ALL) GROUP BY source),
ctry AS (SELECT source, max(country) AS country FROM smap GROUP BY source),
prof AS (SELECT b.*, coalesce(k, 0) AS lesion_label_conflicts, licenses, country IS NOT NULL AS verified,
  coalesce(country, '?') AS country FROM (
  SELECT source, count(*) AS images, count(*) FILTER (label = 'benign') AS benign,
   count(*) FILTER (label = 'malignant') AS malignant, round(100.0::double * avg((label = 'malignant')::int), 1) AS pct_malignant,
   count(DISTINCT nullif(patient_id, '')) AS patients, count(DISTINCT nullif(lesion_id, '')) AS lesions,
   round(100.0::double * avg((patient_id <> '')::int), 1) AS patient_cov_pct,
   round(100.0::double * avg((lesion_id <> '')::int), 1) AS lesion_cov_pct FROM cohort GROUP BY source) b
  LEFT JOIN conf USING (source) LEFT JOIN lic USING (source) LEFT JOIN ctry USING (source))
"""


def shown_map(c: str):
    """A map of counts as text, for comparison."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",").alias(c)


def profile(v: Views) -> DataFrame:
    rows = materialise(v.cohort().select("source", "label", "license", "patient_id", "lesion_id"), "cohort")
    p = cohort.profile_sources(rows, v.source_map())
    return p.withColumn("licenses", shown_map("licenses"))


@query("a3_profile_sources", with_views("cohort") + PROFILE + "SELECT * FROM prof")
def a3(v: Views) -> DataFrame:
    return profile(v)


@query("a4_test_candidates", with_views("cohort") + PROFILE + """
SELECT source, images, verified, country, CASE WHEN why = '' THEN 'yes' ELSE concat('no: ', why) END AS test_candidate FROM (
 SELECT *, concat_ws(', ', CASE WHEN source = 'anonymous' THEN 'anonymous' WHEN NOT verified THEN 'institution not verified in source_map' END,
  CASE WHEN patient_cov_pct < 90.0 THEN 'patient_cov<90.0' END,
  CASE WHEN least(benign, malignant) < 150 THEN '<150 per class (before dedup)' END,
  CASE WHEN lower(country) = 'australia' THEN 'Australia' END, CASE WHEN country = '?' THEN 'country unknown' END) AS why FROM prof)""")
def a4(v: Views) -> DataFrame:
    return cohort.test_candidates(profile(v)).select("source", "images", "verified", "country", "test_candidate")


@query("a5_lesion_conflicts", with_views("cohort") + """
SELECT source, count(*) FILTER (k > 1) AS lesion_label_conflicts FROM (SELECT source, lesion_id, count(DISTINCT label) AS k
 FROM cohort WHERE lesion_id <> '' GROUP BY ALL) GROUP BY source""")
def a5(v: Views) -> DataFrame:
    return cohort.lesion_conflicts(v.cohort())


@query("a6_map_counts", with_views("decisions") + """
SELECT source, string_agg(concat(action, '=', n), ',' ORDER BY action) AS actions
FROM (SELECT source, action, count(*) AS n FROM decisions GROUP BY ALL) GROUP BY source""")
def a6(v: Views) -> DataFrame:
    return cohort.map_counts(v.decisions(v.cohort().select("image_id", "source", "label")), "source", "action", "actions").withColumn("actions", shown_map("actions"))


@query("a7_with_total", with_views("cohort") + """
SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS images,
 count(*) FILTER (label = 'benign') AS benign, count(*) FILTER (label = 'malignant') AS malignant
FROM cohort GROUP BY GROUPING SETS ((source), ())""")
def a7(v: Views) -> DataFrame:
    return cohort.with_total(v.cohort())


@query("a8_attribution_rollup", with_views("eligible") + f"""
SELECT attr_key, attribution, sum(n)::bigint AS images FROM (
 SELECT attr_key, n, first_value(attribution) OVER (PARTITION BY attr_key ORDER BY n DESC, attribution) AS attribution FROM (
  SELECT {fixtures.NORM.format('attribution')} AS attr_key, attribution, count(*) AS n FROM eligible GROUP BY ALL))
GROUP BY attr_key, attribution""")
def a8(v: Views) -> DataFrame:
    return cohort.attribution_rollup(v.eligible())


# A manifest as an earlier job would have stored it: the split and fraction follow from the group.
MANIFEST = f""", man0 AS (SELECT *, concat('g', CASE WHEN patient_id <> '' THEN patient_id ELSE image_id END) AS group_id FROM cohort),
man AS (SELECT *, CASE WHEN source IN ('NATION_1', 'NATION_2', 'NATION_3') THEN 'test'
  WHEN {fixtures.DUCK.h60('group_id')} % 7 = 0 THEN 'val' ELSE 'train' END AS split FROM man0),
manifest AS (SELECT *, CASE WHEN split <> 'train' THEN '' WHEN {fixtures.DUCK.h60("concat('f', group_id)")} % 10 = 0 THEN '0.1'
  WHEN {fixtures.DUCK.h60("concat('f', group_id)")} % 10 <= 2 THEN '0.3' ELSE '1.0' END AS train_frac FROM man)
"""


def manifest(v: Views) -> DataFrame:
    c = v.cohort()
    h, hf = fixtures.SPARK.h60("group_id"), fixtures.SPARK.h60("concat('f', group_id)")
    c = c.withColumn("group_id", F.concat(F.lit("g"), F.when(F.col("patient_id") != "", F.col("patient_id")).otherwise(F.col("image_id"))))
    c = c.withColumn("split", F.when(F.col("source").isin(TEST_SOURCES), "test").when(F.expr(f"{h} % 7 = 0"), "val").otherwise("train"))
    return c.withColumn("train_frac", F.when(F.col("split") != "train", "").when(F.expr(f"{hf} % 10 = 0"), "0.1")
                        .when(F.expr(f"{hf} % 10 <= 2"), "0.3").otherwise("1.0"))


DESCRIBE = """count(*) AS images, count(DISTINCT nullif(patient_id, '')) AS patients, count(DISTINCT nullif(lesion_id, '')) AS lesions,
 count(DISTINCT group_id) AS linked_groups, count(DISTINCT source) AS institutions, count(*) FILTER (label = 'malignant') AS malignant,
 count(*) FILTER (label = 'benign') AS benign, round(100.0::double * avg((patient_id <> '')::int), 1) AS patient_id_coverage_pct"""


@query("a9_describe_subsets", with_views("cohort") + MANIFEST + f"""
SELECT subset, {DESCRIBE} FROM (
 SELECT *, concat('Labelled training ', p, '%') AS subset FROM manifest, (VALUES (10), (30), (100)) f(p)
  WHERE split = 'train' AND TRY_CAST(train_frac AS DOUBLE) <= p / 100.0 + 1e-9
 UNION ALL SELECT *, 0 AS p, CASE split WHEN 'val' THEN 'Validation' ELSE 'External test' END FROM manifest WHERE split <> 'train')
GROUP BY subset""")
def a9(v: Views) -> DataFrame:
    return folds.describe_subsets(manifest(v))


@query("a10_describe_split_sources", with_views("cohort") + MANIFEST + f"""
SELECT split, source, concat(split, '/', source) AS path_key, {DESCRIBE} FROM manifest GROUP BY split, source""")
def a10(v: Views) -> DataFrame:
    return folds.describe_split_sources(manifest(v))


@query("a11_patient_coverage", with_views("cohort") + """
SELECT source, round(100.0::double * avg((patient_id <> '')::int), 1) AS patient_id_coverage_pct FROM cohort GROUP BY source""")
def a11(v: Views) -> DataFrame:
    return folds.patient_coverage(v.cohort())


@query("a12_confusion_at_half", with_views("preds", grid=GRID) + """
SELECT run, source, count(*) AS n, sum(y)::bigint AS n_pos, sum(1 - y)::bigint AS n_neg, count(*) FILTER (f AND y = 1) AS tp,
 count(*) FILTER (NOT f AND y = 1) AS false_negatives, count(*) FILTER (NOT f AND y = 0) AS tn,
 count(*) FILTER (f AND y = 0) AS false_positives, 0.5::double AS threshold,
 round(count(*) FILTER (f AND y = 1) / nullif(sum(y), 0)::double, 6) AS sensitivity,
 round(count(*) FILTER (NOT f AND y = 0) / nullif(sum(1 - y), 0)::double, 6) AS specificity,
 round(count(*) FILTER (f) / count(*)::double, 6) AS flag_rate
FROM (SELECT *, score >= 0.5::double AS f FROM preds) GROUP BY run, source""")
def a12(v: Views) -> DataFrame:
    m = metrics.confusion(v.predictions(GRID).withColumn("threshold", F.lit(0.5)), ["run", "source"])
    return m.withColumns({c: F.round(c, 6) for c in ("sensitivity", "specificity", "flag_rate")})


LOCK = """, thr AS (SELECT run, score AS threshold FROM (
  SELECT run, score, row_number() OVER (PARTITION BY run ORDER BY score DESC) AS i, count(*) OVER (PARTITION BY run) AS p
  FROM preds WHERE split = 'val' AND y = 1) WHERE i = ceil(0.95::double * p)),
locked AS (SELECT preds.*, threshold FROM preds JOIN thr USING (run)),
levels AS (SELECT *, 'ALL' AS test_source FROM locked WHERE split = 'test' UNION ALL SELECT *, source FROM locked WHERE split = 'test')
"""


def at_sql(keys: str, table: str) -> str:
    """Metrics of ``table`` per ``keys``: rank-free AUROC over distinct scores, and the counts at the threshold."""
    return f""", ms AS (SELECT {keys}, threshold, score, sum(y)::double AS p, sum(1 - y)::double AS q FROM {table} GROUP BY ALL),
mc AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ms),
mm AS (SELECT {keys}, max(threshold) AS threshold, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auroc, sum(p)::bigint AS n_pos,
  sum(q)::bigint AS n_neg, coalesce(sum(p) FILTER (score >= threshold), 0)::bigint AS tp,
  coalesce(sum(q) FILTER (score >= threshold), 0)::bigint AS false_positives FROM mc GROUP BY {keys}),
mf AS (SELECT *, n_pos + n_neg AS n, n_pos - tp AS false_negatives, n_neg - false_positives AS tn, tp / nullif(n_pos, 0)::double AS sensitivity,
  (n_neg - false_positives) / nullif(n_neg, 0)::double AS specificity, (tp + false_positives) / (n_pos + n_neg)::double AS flag_rate FROM mm)
"""


METRIC_COLUMNS = """round(auroc, 6) AS auroc, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity,
 round(flag_rate, 6) AS flag_rate, n, n_pos, n_neg, tp, tn, false_negatives, false_positives, threshold"""


def shown_metrics(m: DataFrame) -> DataFrame:
    return m.withColumns({c: F.round(c, 6) for c in ("auroc", "sensitivity", "specificity", "flag_rate")})


@query("a13_institution_metrics", with_views("preds", grid=GRID) + LOCK + at_sql("run, test_source", "levels")
       + f"SELECT run, test_source, {METRIC_COLUMNS} FROM mf")
def a13(v: Views) -> DataFrame:
    return shown_metrics(metrics.institution_metrics(v.predictions(GRID), ["run"]))


RESULTS = ", res AS (SELECT arms.* EXCLUDE (weight), mf.* EXCLUDE (run) FROM mf JOIN arms USING (run))"


def run_results(v: Views) -> DataFrame:
    """Pooled test metrics of the runs with the hours a run took (its number of scored rows, in hours)."""
    keys = ["run", "backbone", "method", "frac", "img", "seed"]
    counts = materialise(metrics.score_counts(v.predictions(GRID), [*keys, "split"]), "scores")
    thr = metrics.threshold_from_counts(counts.where("split = 'val'"), ["run"])
    m = metrics.metrics_from_counts(counts.where("split = 'test'").join(thr, "run"), keys)
    return m.withColumn("gpu_hours", F.col("n") / F.lit(3600.0))


@query("a14_curves", with_views("preds", grid=GRID) + LOCK + at_sql("run", "(SELECT * FROM locked WHERE split = 'test') t") + RESULTS + """
SELECT img, backbone, method, frac, round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_std,
 round(avg(sensitivity), 6) AS sensitivity_mean, round(stddev_samp(sensitivity), 6) AS sensitivity_std,
 round(avg(specificity), 6) AS specificity_mean, round(stddev_samp(specificity), 6) AS specificity_std,
 round(avg(flag_rate), 6) AS flag_rate_mean, round(stddev_samp(flag_rate), 6) AS flag_rate_std,
 round(avg(false_negatives), 6) AS false_negatives_mean, round(stddev_samp(false_negatives), 6) AS false_negatives_std,
 count(*) AS n_seeds, round(avg(n / 3600.0::double), 6) AS gpu_hours_mean FROM res GROUP BY ALL""")
def a14(v: Views) -> DataFrame:
    c = runs.curves(run_results(v))
    return c.select(*[r(x) if x.endswith(("_mean", "_std")) else x for x in c.columns])


@query("a15_device_share", with_views("qc") + """
SELECT CASE WHEN device = '' THEN '(vuoto)' ELSE device END AS device, count(*) AS images,
 round(100.0::double * count(*) FILTER (label = 'melanoma') / count(*), 1) AS pct FROM qc GROUP BY 1""")
def a15(v: Views) -> DataFrame:
    return quality.device_share(v.qc())


@query("a15_device_labels", with_views("qc") + """
SELECT CASE WHEN device = '' THEN '(vuoto)' ELSE device END AS device, CASE WHEN label = '' THEN '(vuota)' ELSE label END AS label,
 count(*) AS images FROM qc GROUP BY 1, 2""")
def a15b(v: Views) -> DataFrame:
    return quality.device_labels(v.qc())


@query("a16_lesion_labels", with_views("qc") + """, l AS (SELECT lesion_id, count(DISTINCT nullif(label, '')) AS k, min(nullif(label, '')) AS label
 FROM qc WHERE lesion_id <> '' GROUP BY lesion_id)
SELECT coalesce(label, '(vuota)') AS label, count(*) AS lesions,
 round(100.0::double * count(*) / (SELECT count(*) FROM l), 1) AS pct FROM l WHERE k <= 1 GROUP BY 1""")
def a16(v: Views) -> DataFrame:
    return quality.lesion_labels(v.qc())


SKIP_S = 86400.0


@query("a17_summarise_samples", with_views("samples") + f""", s AS (SELECT *, epoch_us(ts) / 1e6::double AS t,
 min(epoch_us(ts) / 1e6::double) OVER (PARTITION BY run) AS t0, max(epoch_us(ts) / 1e6::double) OVER (PARTITION BY run) AS t1 FROM samples)
SELECT run, count(*) AS samples, round(max(t1) - min(t0), 1) AS duration_s, round(avg(util), 9) AS util_mean,
 round(100.0::double - avg(util), 9) AS idle_pct, round(100.0::double * count(*) FILTER (util = 0) / count(*), 1) AS pct_samples_util_0,
 round(max(mem) / 1024.0::double, 2) AS mem_used_max_gb FROM s WHERE t - t0 >= {SKIP_S}::double GROUP BY run""")
def a17(v: Views) -> DataFrame:
    return telemetry.summarise_samples(v.samples(), ["run"], SKIP_S, digits=9)


@query("a18_summarise_metrics", with_views("mlog") + """, m AS (SELECT *, max((iteration >= 8000)::int) OVER (PARTITION BY run) AS late FROM mlog),
 u AS (SELECT *, late = 0 OR iteration >= 8000 AS use FROM m)
SELECT run, count(*) AS entries, max(iteration) AS last_iteration,
 round(quantile_cont(iter_time, 0.5) FILTER (use), 4) AS median_iter_time_s,
 round(96.0::double / quantile_cont(iter_time, 0.5) FILTER (use), 1) AS items_per_s,
 round(quantile_cont(data_time, 0.5) FILTER (use) / quantile_cont(iter_time, 0.5) FILTER (use), 3) AS data_time_fraction,
 count(*) FILTER (total_loss IS NOT NULL AND NOT isfinite(total_loss)) AS loss_non_finite, max(max_mem) AS max_mem FROM u GROUP BY run""")
def a18(v: Views) -> DataFrame:
    return telemetry.summarise_metrics(v.metric_log(), ["run"], skip=8000, batch=48, devices=2)


MOMENTS = """SELECT {where} dim, count(*) AS n, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS std FROM (
 SELECT vec_id, unnest(embedding)::double AS x, unnest(generate_series(0, 63))::int AS dim FROM embeddings) e"""


@query("a19_moments", f"SELECT dim, n, round(mean, 6) AS mean, round(std, 6) AS std FROM ({MOMENTS.format(where='')} GROUP BY dim)")
def a19(v: Views) -> DataFrame:
    return arrays.moments(v.table("embeddings"), "embedding").select("dim", "n", r("mean"), r("std"))


@query("a20_drift", f"""WITH m AS ({MOMENTS.format(where="k.p,")} JOIN (SELECT vec_id AS id, label < 5 AS p FROM embeddings) k ON id = vec_id GROUP BY p, dim)
SELECT a.dim, round(abs(a.mean - b.mean), 6) AS mean_diff, round(abs(a.std - b.std), 6) AS std_diff
FROM m a JOIN m b USING (dim) WHERE a.p AND NOT b.p""")
def a20(v: Views) -> DataFrame:
    e = v.table("embeddings")
    return arrays.drift(e.where("label < 5"), e.where("label >= 5"), "embedding").select("dim", r("mean_diff"), r("std_diff"))


@query("a21_nearest_histogram", with_views("vecs") + f""", d AS (SELECT a.image_id, least(min(bit_count(xor(a.word, b.word))), {NEAR + 1}) AS m
 FROM vecs a JOIN vecs b ON a.image_id <> b.image_id GROUP BY a.image_id)
SELECT m::int AS min_hamming, count(*) AS images FROM d GROUP BY 1""")
def a21(v: Views) -> DataFrame:
    return similarity.nearest_histogram(v.vectors(), N_BITS, NEAR)


@query("a22_pair_totals", with_views("vpairs") + """
SELECT count(*) AS pairs_total, count(*) FILTER (exact) AS pairs_exact_sha256, count(*) FILTER (NOT exact) AS pairs_near_only,
 count(*) FILTER (a.source <> b.source) AS pairs_cross_source, count(*) FILTER (a.source = b.source) AS pairs_within_source,
 count(*) FILTER (a.label <> b.label) AS pairs_label_conflict,
 count(*) FILTER (NOT (a.lesion_id <> '' AND a.lesion_id = b.lesion_id)) AS pairs_different_lesion_id
FROM vpairs p JOIN vecs a ON a.image_id = id_a JOIN vecs b ON b.image_id = id_b""")
def a22(v: Views) -> DataFrame:
    return similarity.pair_totals(v.vectors(), N_BITS, NEAR)


@query("a22_dedup_summary", with_views("decisions") + """, cl AS (SELECT dup_cluster, count(DISTINCT source) AS s, count(DISTINCT label) AS l
 FROM decisions WHERE dup_cluster <> '' GROUP BY 1)
SELECT (SELECT count(*) FROM cl WHERE s > 1) AS clusters_cross_source, (SELECT count(*) FROM cl WHERE s = 1) AS clusters_within_source,
 (SELECT count(*) FROM cl WHERE l > 1) AS clusters_label_conflict, count(*) AS n_images, count(*) FILTER (action = 'keep') AS action_keep,
 count(*) FILTER (action = 'cluster') AS action_cluster, count(*) FILTER (action = 'exclude_label_conflict') AS action_exclude_label_conflict
FROM decisions""")
def a22b(v: Views) -> DataFrame:
    return similarity.summarise_decisions(v.decisions(v.cohort().select("image_id", "source", "label")))


@query("a23_gpu_cost", with_views("runs") + """
SELECT round(sum(gpu_hours), 2) AS gpu_hours, round(sum(gpu_hours) * 3.49::double, 0) AS list_price FROM runs""")
def a23(v: Views) -> DataFrame:
    return runs.gpu_cost(v.runs())


EPOCHS_BY_FRAC = {0.1: 30, 0.3: 20, 1.0: 10}
PLAN = """, sizes AS (SELECT frac, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test FROM manifest, (VALUES (0.1::double), (0.3), (1.0)) f(frac)
  WHERE split <> 'train' OR TRY_CAST(train_frac AS DOUBLE) <= frac + 1e-9 GROUP BY frac),
fam AS (SELECT *, CASE WHEN method LIKE 'lora%' THEN 'lora' ELSE 'full' END AS family FROM runs WHERE method <> 'frozen'),
b AS (SELECT backbone, family, avg(gpu_hours) AS setup_s, avg(gpu_hours) / 1000 AS train_s_img, avg(gpu_hours) / 2000 AS val_s_img,
  count(DISTINCT lr) AS n_values FROM fam GROUP BY ALL),
cost AS (SELECT backbone, family, frac, (setup_s + CASE frac WHEN 0.1 THEN 30 WHEN 0.3 THEN 20 ELSE 10 END
  * (train_s_img * train + val_s_img * val) + val_s_img * (val + test)) / 3600 AS hours, n_values FROM b, sizes)
"""


def plan_costs(v: Views) -> DataFrame:
    fam = v.runs().where("method <> 'frozen'").withColumn("family", F.when(F.col("method").startswith("lora"), "lora").otherwise("full"))
    b = fam.groupBy("backbone", "family").agg(F.avg("gpu_hours").alias("setup_s"), (F.avg("gpu_hours") / 1000).alias("train_s_img"),
                                              (F.avg("gpu_hours") / 2000).alias("val_s_img"))
    grid = fam.groupBy("backbone", "family").agg(F.countDistinct("lr").alias("n_values"))
    return runs.plan_cost(b, folds.fraction_sizes(manifest(v)), EPOCHS_BY_FRAC, grid)


@query("a23_plan_cost", with_views("cohort", "runs") + MANIFEST + PLAN + "SELECT backbone, family, frac, round(hours, 6) AS hours, n_values FROM cost")
def a23b(v: Views) -> DataFrame:
    return plan_costs(v).withColumn("hours", F.round("hours", 6))


@query("a23_plan_totals", with_views("cohort", "runs") + MANIFEST + PLAN + """, t AS (SELECT sum(hours * n_values) FILTER (frac = 0.3) AS sweep,
  sum(hours) AS one, sum(hours) FILTER (frac = 1.0) AS top FROM cost),
p AS (SELECT 'A' AS plan, sweep + one AS h FROM t UNION ALL SELECT 'B', sweep + one + 2 * top FROM t UNION ALL SELECT 'C', sweep + 3 * one FROM t)
SELECT plan, round(h * 1.3::double, 2) AS gpu_hours, round(h * 1.3::double * 3.49::double, 0) AS cost FROM p""")
def a23c(v: Views) -> DataFrame:
    return runs.plan_totals(plan_costs(v))


@query("a24_spend_ledger", """WITH s AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9::double AS h,
 CASE WHEN user_id % 2 = 0 THEN 0.0015::double ELSE 0.0005::double END AS price FROM events GROUP BY user_id)
SELECT round(sum(h), 4) AS hours, round(sum(h * price), 4) AS cost, CASE WHEN sum(h * price) >= 90 THEN 90.0::double
 WHEN sum(h * price) >= 85 THEN 85.0::double WHEN sum(h * price) >= 80 THEN 80.0::double WHEN sum(h * price) >= 70 THEN 70.0::double END AS warning_level FROM s""")
def a24(v: Views) -> DataFrame:
    s = (v.table("events").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
         .withColumn("price", F.when(F.col("user_id") % 2 == 0, 0.0015).otherwise(0.0005)))
    return runs.spend_ledger(s).select(r("hours", 4), r("cost", 4), "warning_level")


@query("a25_size_range", """SELECT min(n)::bigint AS min_bytes, max(n)::bigint AS max_bytes, count(*) AS n
FROM (SELECT sum(octet_length(encode(html)) + 1) AS n FROM pages WHERE html IS NOT NULL GROUP BY page_id % 32)""")
def a25(v: Views) -> DataFrame:
    """Files that stand in real folders."""
    path = scratch_path(v.spark, "sizes")
    pages = v.table("pages").where("html is not null").select((F.col("page_id") % 32).alias("part"), "html")
    pages.repartition("part").write.partitionBy("part").text(path)
    return inventory.size_range(inventory.list_files(v.spark, path), ".txt")


@query("a26_fraction_sizes", with_views("cohort") + MANIFEST + """
SELECT frac, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM manifest, (VALUES (0.1::double), (0.3), (1.0)) f(frac)
WHERE split <> 'train' OR TRY_CAST(train_frac AS DOUBLE) <= frac + 1e-9 GROUP BY frac""")
def a26(v: Views) -> DataFrame:
    return folds.fraction_sizes(manifest(v))
