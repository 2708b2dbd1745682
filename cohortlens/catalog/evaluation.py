"""Statistics and evaluation of scored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.aggregates import LOCK, METRIC_COLUMNS, at_sql, shown_metrics
from cohortlens.catalog.base import query
from cohortlens.catalog.relations import PAIRS, run_pairs
from cohortlens.functions.hashing import h60
from cohortlens.operators import bootstrap, metrics, probe, runs
from cohortlens.plans import evaluation
from cohortlens.plans.fixtures import DUCK, GRID, N_BOOT, Views, with_views

CI = [f"{k}_{s}" for k in bootstrap.KEYS for s in ("lo", "hi")]


def rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("e1_auroc", with_views("preds", grid=GRID) + """, s AS (SELECT run, score, sum(y)::double AS p, sum(1 - y)::double AS q FROM preds GROUP BY ALL),
c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY run ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT run, round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0), 6) AS auroc, sum(p)::bigint AS n_pos, sum(q)::bigint AS n_neg FROM c GROUP BY run""")
def e1(v: Views) -> DataFrame:
    return rounded(metrics.auroc(v.predictions(GRID), ["run"]), ["auroc"])


@query("e2_threshold", with_views("preds") + LOCK + "SELECT run, threshold FROM thr")
def e2(v: Views) -> DataFrame:
    return metrics.threshold(v.predictions().where("split = 'val'"), ["run"])


@query("e3_evaluate_locked", with_views("preds", grid=GRID) + LOCK + at_sql("run, split", "locked") + f"SELECT run, split, {METRIC_COLUMNS} FROM mf")
def e3(v: Views) -> DataFrame:
    return shown_metrics(metrics.evaluate_locked(v.predictions(GRID), ["run"]))


def predicted(v: Views) -> DataFrame:
    """What resampling needs of the predictions."""
    return v.predictions().select("run", "image_id", "split", "source", "group_id", "y", "score")


# Replicates: multiplicities of the groups as one vector a replicate, counts of a score in the groups as another, and their
# product as the weight of the score.
def draws_sql(unit: str, table: str, b: int = N_BOOT) -> str:
    pick = DUCK.h60("concat('0:', b, ':', slot)")
    return f""", gi AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {unit} ORDER BY md5(group_id), group_id) - 1 AS slot,
  count(*) OVER (PARTITION BY {unit}) AS g FROM (SELECT DISTINCT {unit}, group_id FROM {table})),
bb AS (SELECT unnest(generate_series(0, {b - 1})) AS b),
gd AS (SELECT {unit}, b, {pick} % g AS slot, count(*) AS m FROM gi, bb GROUP BY ALL),
mv AS MATERIALIZED (SELECT {unit}, b, list(cast(coalesce(m, 0) as double) ORDER BY slot) AS mult FROM (SELECT {unit}, slot, b FROM gi, bb)
  LEFT JOIN gd USING ({unit}, b, slot) GROUP BY ALL)"""


def replicate_sql(keys: str, unit: str, table: str) -> str:
    return f""", kk AS MATERIALIZED (SELECT *, row_number() OVER () AS kid FROM (SELECT DISTINCT {keys}, threshold FROM {table})),
pr AS MATERIALIZED (SELECT kid, {unit}, score, slot, sum(y) AS p, sum(1 - y) AS q FROM {table} JOIN kk USING ({keys}, threshold) JOIN gi USING ({unit}, group_id) GROUP BY ALL),
pv AS MATERIALIZED (SELECT kid, {unit}, score, list(cast(coalesce(p, 0) as double) ORDER BY slot) AS pos, list(cast(coalesce(q, 0) as double) ORDER BY slot) AS neg
  FROM (SELECT kid, {unit}, score, slot FROM (SELECT DISTINCT kid, {unit}, score FROM pr) JOIN gi USING ({unit})) LEFT JOIN pr USING (kid, {unit}, score, slot) GROUP BY ALL),
ws AS MATERIALIZED (SELECT kid, b, score, list_dot_product(pos, mult) AS p, list_dot_product(neg, mult) AS q FROM pv JOIN mv USING ({unit})),
wc AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY kid, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ws),
wm AS (SELECT kid, b, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auroc, sum(p) AS np, sum(q) AS nn,
  coalesce(sum(p) FILTER (score >= threshold), 0) AS tp, coalesce(sum(q) FILTER (score >= threshold), 0) AS fp FROM wc JOIN kk USING (kid) GROUP BY kid, b),
reps AS MATERIALIZED (SELECT {keys}, b, auroc, tp / np AS sensitivity, (nn - fp) / nn AS specificity, (tp + fp) / (np + nn) AS flag_rate,
  np - tp AS false_negatives FROM wm JOIN kk USING (kid) WHERE np > 0 AND nn > 0)"""


CI_SQL = ", ".join(f"round(quantile_cont({k}, {q}), 6) AS {k}_{s}" for k in bootstrap.KEYS for s, q in (("lo", 0.025), ("hi", 0.975)))


@query("e4_bootstrap_ci", with_views("preds") + LOCK + draws_sql("test_source", "levels") + replicate_sql("run, test_source", "test_source", "levels") + f"""
SELECT r.run, r.test_source, any_value(g.g) AS n_groups, {N_BOOT} AS n_boot, {N_BOOT} - count(*) AS n_skipped_single_class, {CI_SQL}
FROM reps r JOIN (SELECT test_source, count(*) AS g FROM gi GROUP BY 1) g USING (test_source) GROUP BY r.run, r.test_source""")
def e4(v: Views) -> DataFrame:
    rows = metrics.with_levels(evaluation.locked_test_rows(predicted(v).drop("image_id"), ["run"]))
    return rounded(bootstrap.bootstrap_ci(rows, ["run", "test_source"], ["test_source"], N_BOOT), CI)


POOLED = ", pooled AS (SELECT *, 1 AS u FROM locked WHERE split = 'test')" + draws_sql("u", "pooled") + replicate_sql("u, run", "u", "pooled")
LONG = "UNPIVOT (SELECT {0}, auroc, sensitivity, specificity, flag_rate FROM {1}) ON auroc, sensitivity, specificity, flag_rate INTO NAME metric VALUE value"
PAIRED = (with_views("preds") + PAIRS + LOCK + POOLED + at_sql("run", "pooled")
          + f", rl AS MATERIALIZED ({LONG.format('run, b', 'reps')}), pl AS ({LONG.format('run', 'mf')})" + """,
dd AS (SELECT p.*, a.metric, y.value - a.value AS d FROM prs p JOIN rl a ON a.run = run_1 JOIN rl y ON y.run = run_2 AND y.b = a.b AND y.metric = a.metric),
ci AS (SELECT comparison, run_1, run_2, metric, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM dd GROUP BY ALL),
paired AS (SELECT p.*, a.metric, y.value - a.value AS diff, lo AS ci_lo, hi AS ci_hi FROM prs p JOIN pl a ON a.run = run_1
  JOIN pl y ON y.run = run_2 AND y.metric = a.metric JOIN ci ON ci.comparison = p.comparison AND ci.run_1 = p.run_1 AND ci.run_2 = p.run_2 AND ci.metric = a.metric)
""")


def paired(v: Views) -> DataFrame:
    rows = evaluation.locked_test_rows(predicted(v), ["run"]).withColumn("u", F.lit(1))
    return bootstrap.paired_ci(rows, run_pairs(v), "run", ["u"], N_BOOT).drop("u")


@query("e5_paired_ci", PAIRED + """SELECT comparison, run_1, run_2, backbone, img, frac, seed, metric, round(diff, 6) AS diff,
 round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM paired""")
def e5(v: Views) -> DataFrame:
    return rounded(paired(v), ["diff", "ci_lo", "ci_hi"])


@query("e6_primary_contrast", PAIRED + """SELECT 'pretrained_minus_base_full' AS comparison, 'auroc' AS metric, count(*) AS seeds,
 round(avg(diff), 6) AS mean_diff, round(stddev_samp(diff), 6) AS sd_diff, CASE WHEN count(*) > 0 THEN 'available' ELSE 'NOT AVAILABLE' END AS status
FROM paired WHERE comparison = 'pretrained_minus_base_full' AND img = 224 AND frac = 1.0 AND metric = 'auroc'
UNION ALL SELECT 'external_minus_base_full', 'auroc', 0, NULL, NULL, 'NOT AVAILABLE'""")
def e6(v: Views) -> DataFrame:
    p = paired(v)
    one = runs.primary_contrast(p, "pretrained_minus_base_full", 224, 1.0, "auroc")
    two = runs.primary_contrast(p, "external_minus_base_full", 224, 1.0, "auroc")
    return rounded(one.unionByName(two), ["mean_diff", "sd_diff"])


@query("e6_primary_seeds", PAIRED + """SELECT comparison, backbone, metric, seed, round(diff, 6) AS diff, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi
FROM paired WHERE comparison = 'pretrained_minus_base_full' AND img = 224 AND frac = 1.0 AND metric = 'auroc'""")
def e6b(v: Views) -> DataFrame:
    return rounded(runs.primary_seeds(paired(v), "pretrained_minus_base_full", 224, 1.0, "auroc"), ["diff", "ci_lo", "ci_hi"])


@query("e7_runs_long", with_views("preds") + LOCK + draws_sql("test_source", "levels") + replicate_sql("run, test_source", "test_source", "levels")
       + at_sql("run, test_source", "levels") + f""", cis AS (SELECT run, test_source, count(*) AS used, {CI_SQL} FROM reps GROUP BY run, test_source)
SELECT run, test_source, {METRIC_COLUMNS}, g.g AS n_groups, {N_BOOT} AS n_boot, {N_BOOT} - used AS n_skipped_single_class, cis.* EXCLUDE (run, test_source, used)
FROM mf JOIN cis USING (run, test_source) JOIN (SELECT test_source, count(*) AS g FROM gi GROUP BY 1) g USING (test_source)""")
def e7(v: Views) -> DataFrame:
    return rounded(evaluation.runs_long(predicted(v).drop("image_id"), ["run"], N_BOOT), ["auroc", "sensitivity", "specificity", "flag_rate", *CI])


def probe_rows(v: Views) -> DataFrame:
    """Vectors split by the hash of their base, so copies stay together; nested fractions the same way."""
    base = (F.col("image_id") % 1000000).cast("string")
    h, f = h60(base) % 10, h60(F.concat(F.lit("f"), base)) % 10
    split = F.when(h < 6, "train").when(h < 8, "val").otherwise("test")
    x = v.vectors().withColumns({"split": split, "group_id": F.concat(F.lit("g"), base)})
    return x.withColumn("train_frac", F.when(F.col("split") != "train", "").when(f < 2, "0.1").when(f < 5, "0.3").otherwise("1.0"))


@query("m1_fit_probe")
def m1(v: Views) -> DataFrame:
    return rounded(probe.fit_probe(probe_rows(v)), ["score"])
