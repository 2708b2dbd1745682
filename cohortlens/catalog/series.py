"""Ordered data: keep-first and keep-last, run series, sampling and sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.base import query
from cohortlens.functions import text
from cohortlens.operators import joins, runs, sampling, telemetry
from cohortlens.plans.fixtures import DUCK, Views, with_views

SKIP_S = 86400.0
SAMPLE = 500
DRAWS = 2000


@query("w1_keep_first", """SELECT doc_id, source, sha256 FROM (SELECT doc_id, source, sha256(text) AS sha256 FROM documents)
QUALIFY row_number() OVER (PARTITION BY source, sha256 ORDER BY doc_id) = 1""")
def w1(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return joins.keep_first(d, ["source", "sha256"], "doc_id")


@query("w1_last_entry", with_views("downloads") + "SELECT image_id, file, bytes, sha256, api_license, seq FROM downloads")
def w1b(v: Views) -> DataFrame:
    return joins.last_entry(v.log())


@query("w2_class_weights", with_views("vecs") + """SELECT image_id, y, round(1.0::double / (count(*) OVER (PARTITION BY y)
 * (SELECT count(DISTINCT y) FROM vecs)), 9) AS weight FROM vecs""")
def w2(v: Views) -> DataFrame:
    return sampling.class_weights(v.vectors().select("image_id", "y")).withColumn("weight", F.round("weight", 9))


@query("w3_time_to_level", with_views("epochs") + """SELECT run, round(min(elapsed_s) FILTER (val_auroc >= 0.85), 6) AS time_to_level_s,
 arg_max(epoch, (val_auroc, -epoch)) AS best_epoch, round(max(val_auroc), 6) AS best_val_auroc FROM epochs GROUP BY run""")
def w3(v: Views) -> DataFrame:
    t = runs.time_to_level(v.epochs(), ["run"], 0.85)
    return t.withColumns({c: F.round(c, 6) for c in ("time_to_level_s", "best_val_auroc")})


@query("w4_select_best", with_views("epochs") + """, s AS (SELECT backbone, CASE WHEN method LIKE 'lora%' THEN 'lora' ELSE 'full' END AS family, lr,
 max(val_auroc) AS a FROM epochs WHERE method <> 'frozen' GROUP BY ALL)
SELECT backbone, family, arg_max(lr, (a, -lr)) AS best_lr, round(max(a), 6) AS best_score, count(DISTINCT lr) AS n_values,
 arg_max(lr, (a, -lr)) IN (min(lr), max(lr)) AS edge_of_grid, abs(arg_max(lr, (a, -lr)) - 0.0002) >= 1e-12 AS changes_frozen FROM s GROUP BY ALL""")
def w4(v: Views) -> DataFrame:
    e = v.epochs().where("method <> 'frozen'").withColumn("family", text.method_family(F.col("method")))
    sweep = e.groupBy("backbone", "family", "lr").agg(F.max("val_auroc").alias("best_val_auroc"))
    frozen = sweep.select("backbone", "family").distinct().withColumn("lr", F.lit(0.0002))
    return runs.select_best(sweep, ["backbone", "family"], frozen=frozen).withColumn("best_score", F.round("best_score", 6))


@query("w4_planned_grid", with_views("epochs") + """, s AS (SELECT backbone, CASE WHEN method LIKE 'lora%' THEN 'lora' ELSE 'full' END AS family, lr,
 max(val_auroc) AS a FROM epochs WHERE method <> 'frozen' GROUP BY ALL),
g AS (SELECT DISTINCT backbone, family, lr FROM s WHERE lr > 0.00015 UNION ALL
 SELECT DISTINCT backbone, family, 0.5::double FROM s WHERE backbone = 'a' AND family = 'lora'),
m AS (SELECT g.backbone, g.family, g.lr, s.a FROM g LEFT JOIN s ON s.backbone = g.backbone AND s.family = g.family AND abs(s.lr - g.lr) < 1e-12),
b AS (SELECT backbone, family, count(*) AS n_values, count(*) FILTER (a IS NULL) AS n_missing, arg_max(lr, (a, -lr)) FILTER (a IS NOT NULL) AS best,
 max(a) AS top, min(lr) AS lo, max(lr) AS hi FROM m GROUP BY ALL)
SELECT backbone, family, CASE WHEN n_missing = 0 THEN best END AS best_lr, CASE WHEN n_missing = 0 THEN round(top, 6) END AS best_score, n_values, n_missing,
 CASE WHEN n_missing = 0 THEN best IN (lo, hi) END AS edge_of_grid FROM b""")
def w4c(v: Views) -> DataFrame:
    """The smallest value tried was not planned; one arm has a planned value that nobody tried."""
    e = v.epochs().where("method <> 'frozen'").withColumn("family", text.method_family(F.col("method")))
    sweep = e.groupBy("backbone", "family", "lr").agg(F.max("val_auroc").alias("best_val_auroc"))
    grid = sweep.where("lr > 0.00015").select("backbone", "family", "lr").unionByName(
        sweep.where("backbone = 'a' and family = 'lora'").select("backbone", "family", F.lit(0.5).alias("lr")).distinct())
    return runs.select_best(sweep, ["backbone", "family"], grid=grid).withColumn("best_score", F.round("best_score", 6))


@query("w4_uneven_grids", with_views("runs") + """, g AS (SELECT backbone, CASE WHEN method LIKE 'lora%' THEN 'lora' ELSE 'full' END AS family,
 count(DISTINCT run) AS n FROM runs GROUP BY ALL) SELECT backbone, min(n) AS lo, max(n) AS hi FROM g GROUP BY backbone HAVING min(n) <> max(n)""")
def w4b(v: Views) -> DataFrame:
    return runs.uneven_grids(v.runs(), "run")


@query("w5_steady_throughput", with_views("epochs") + """SELECT run, round(quantile_cont(img_per_s, 0.5) FILTER (epoch > 0), 4) AS img_per_s_steady,
 count(*) AS epochs FROM epochs GROUP BY run""")
def w5(v: Views) -> DataFrame:
    return runs.steady_throughput(v.epochs(), ["run"], 4)


ALERTS = with_views("epochs", "bench_speed") + """, x AS (SELECT run, epoch, e.img_per_s, b.img_per_s AS bench,
 quantile_cont(e.img_per_s, 0.5) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS med
 FROM epochs e JOIN bench_speed b ON b.backbone = e.backbone AND b.family = CASE WHEN e.method LIKE 'lora%' THEN 'lora' ELSE 'full' END WHERE img = 224)
SELECT run, epoch, round(med, 6) AS median_last3, bench, med < 0.9::double * bench AS alert FROM x WHERE epoch >= 2"""


@query("w6_throughput_alerts", ALERTS)
def w6(v: Views) -> DataFrame:
    return runs.throughput_alerts(v.epochs(), v.benchmark_speed()).withColumn("median_last3", F.round("median_last3", 6))


@query("w7_loss_ends", with_views("mlog") + """, l AS (SELECT run, total_loss, row_number() OVER (PARTITION BY run ORDER BY ts, iteration) AS i,
 count(*) OVER (PARTITION BY run) AS n FROM mlog WHERE total_loss IS NOT NULL AND NOT isnan(total_loss))
SELECT run, count(*) AS n, round(avg(total_loss) FILTER (i <= greatest(1, n // 10)), 9) AS first_10pct_mean,
 round(avg(total_loss) FILTER (i > n - greatest(1, n // 10)), 9) AS last_10pct_mean FROM l GROUP BY run""")
def w7(v: Views) -> DataFrame:
    m = v.metric_log().where(~F.isnan("total_loss"))
    return telemetry.loss_ends(m, ["run"], F.col("day"), [F.col("ts"), F.col("iteration")], digits=9)


@query("w8_after_warmup", with_views("samples") + f"""SELECT run, event_id, util FROM samples
QUALIFY (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run)) / 1e6::double >= {SKIP_S}::double""")
def w8(v: Views) -> DataFrame:
    return telemetry.after_warmup(v.samples(), ["run"], SKIP_S).select("run", "event_id", "util")


@query("t2_total_order", with_views("eligible") + """, a AS (SELECT attribution, count(*) AS images FROM eligible GROUP BY 1)
SELECT attribution, images, row_number() OVER (ORDER BY images DESC, attribution) AS position FROM a""")
def t2(v: Views) -> DataFrame:
    """Attributions in report order; the position column shows the order to a comparison that ignores it."""
    from cohortlens.operators import ranking
    a = v.eligible().groupBy("attribution").agg(F.count(F.lit(1)).alias("images"))
    ranked = ranking.row_index(a, [], [-F.col("images")], [F.col("attribution")], "position")
    return ranked.withColumn("position", F.col("position") + 1).orderBy(F.desc("images"), "attribution")


@query("t3_sample_n", with_views("eligible") + f"SELECT image_id, license FROM eligible ORDER BY md5(concat('0:', image_id)), image_id LIMIT {SAMPLE}")
def t3(v: Views) -> DataFrame:
    return sampling.sample_n(v.eligible(), SAMPLE).select("image_id", "license")


@query("t4_balanced_sample", with_views("vecs") + f""", cls AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS c FROM (SELECT DISTINCT y FROM vecs)),
ix AS (SELECT image_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat('0:', image_id)), image_id) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM vecs),
d AS (SELECT draw, {DUCK.h60("concat('0:class:', draw)")} % (SELECT count(*) FROM cls) AS c, {DUCK.h60("concat('0:row:', draw)")} AS u
  FROM (SELECT unnest(generate_series(0, {DRAWS - 1})) AS draw))
SELECT draw, image_id, ix.y FROM d JOIN cls USING (c) JOIN ix ON ix.y = cls.y AND ix.i = d.u % ix.n""")
def t4(v: Views) -> DataFrame:
    return sampling.balanced_sample(v.vectors(), DRAWS)
