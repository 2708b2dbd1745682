"""Equi-joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.aggregates import MANIFEST, manifest, r
from cohortlens.catalog.base import query
from cohortlens.functions import text
from cohortlens.operators import arrays, bootstrap, cohort, joins, probe, runs
from cohortlens.plans import pool
from cohortlens.plans.fixtures import NEAR, N_BITS, Views, with_views
from cohortlens.session import materialise


@query("j1_matched", with_views("cohort", "downloads") + """SELECT image_id, source, file, sha256 FROM cohort JOIN downloads USING (image_id)""")
def j1(v: Views) -> DataFrame:
    d = v.downloads().select("image_id", "file", "sha256")
    return joins.matched(v.cohort(), d).select("image_id", "source", "file", "sha256")


@query("j1_unmatched_count", with_views("cohort", "dlog") + """SELECT count(*) AS unmatched FROM cohort
WHERE image_id NOT IN (SELECT image_id FROM dlog WHERE api_license IS NOT NULL)""")
def j1b(v: Views) -> DataFrame:
    return joins.unmatched_count(v.cohort(), v.log().where("api_license is not null"))


@query("j2_left_log", with_views("cohort", "downloads") + MANIFEST + """SELECT m.image_id, split, sha256 FROM manifest m
LEFT JOIN (SELECT * FROM downloads WHERE api_license IS NOT NULL) d USING (image_id) WHERE split IN ('val', 'test')""")
def j2(v: Views) -> DataFrame:
    held = manifest(v).where(F.col("split").isin("val", "test"))
    log = v.downloads().where("api_license is not null").select("image_id", "sha256")
    return held.join(log, "image_id", "left").select("image_id", "split", "sha256")


@query("j3_source_lookup", with_views("cohort") + """SELECT source, count(*) AS images,
 coalesce((SELECT max(country) FROM smap WHERE smap.source = cohort.source), '?') AS country FROM cohort GROUP BY source""")
def j3(v: Views) -> DataFrame:
    n = v.cohort().groupBy("source").agg(F.count(F.lit(1)).alias("images"))
    return n.join(cohort.countries(v.source_map()), "source", "left").na.fill("?", ["country"])


@query("j3_unmapped", with_views("eligible", "smap") + """SELECT attr_key, count(*) AS images FROM (
 SELECT lower(regexp_replace(attribution, '\\s+', ' ', 'g')) AS attr_key FROM eligible)
WHERE attr_key NOT IN (SELECT lower(attribution) FROM smap) GROUP BY 1""")
def j3b(v: Views) -> DataFrame:
    return cohort.unmapped_attributions(v.eligible(), v.source_map()).select("attr_key", "images")


@query("j4_semi_members", with_views("cohort", "meta") + MANIFEST + """SELECT image_id, license FROM meta
WHERE image_id IN (SELECT image_id FROM manifest WHERE split IN ('val', 'test'))""")
def j4(v: Views) -> DataFrame:
    held = manifest(v).where(F.col("split").isin("val", "test"))
    return joins.members(v.meta(), held, "image_id").select("image_id", "license")


@query("j5_anti_chain", with_views("cohort", "meta") + MANIFEST + """, held AS (SELECT * FROM manifest WHERE split IN ('val', 'test'))
SELECT image_id, lesion_id, patient_id FROM meta WHERE image_id NOT IN (SELECT image_id FROM held)
 AND (lesion_id = '' OR lesion_id NOT IN (SELECT lesion_id FROM held)) AND (patient_id = '' OR patient_id NOT IN (SELECT patient_id FROM held))""")
def j5(v: Views) -> DataFrame:
    held = materialise(manifest(v).where(F.col("split").isin("val", "test")).select("image_id", "lesion_id", "patient_id"), "held")
    out = v.meta().select("image_id", "lesion_id", "patient_id")
    for key in ("image_id", "lesion_id", "patient_id"):
        out = joins.members(out, held, key, present=False)
    return out.select("image_id", "lesion_id", "patient_id")


@query("j10_match_runs", with_views("runs") + """, fz AS (SELECT backbone, frac, img, arg_min(run, seed) AS run FROM runs
  WHERE method = 'frozen' GROUP BY ALL)
SELECT concat('full_minus_', a.method) AS comparison, a.run AS run_1, b.run AS run_2, a.backbone, a.img, a.frac, a.seed FROM runs a
 JOIN runs b USING (backbone, frac, img, seed) WHERE a.method LIKE 'lora%' AND b.method = 'full'
UNION ALL SELECT concat(a.method, '_minus_frozen'), f.run, a.run, a.backbone, a.img, a.frac, a.seed FROM runs a
 JOIN fz f USING (backbone, frac, img) WHERE a.method LIKE 'lora%' OR a.method = 'full'
UNION ALL SELECT concat(CASE b.backbone WHEN 'b' THEN 'pretrained' ELSE 'external' END, '_minus_base_', a.method), a.run, b.run, a.backbone,
 a.img, a.frac, a.seed FROM runs a JOIN runs b USING (method, frac, img, seed) WHERE a.backbone = 'a' AND b.backbone IN ('b', 'c')
UNION ALL SELECT concat('img', a.img, '_minus_img224_', a.method), b.run, a.run, a.backbone, a.img, a.frac, a.seed FROM runs a
 JOIN runs b USING (backbone, method, frac, seed) WHERE a.img <> 224 AND b.img = 224""")
def j10(v: Views) -> DataFrame:
    return runs.match_runs(v.runs(), "a", "b", "c")


PAIRS = """, prs AS (SELECT concat('full_minus_', a.method) AS comparison, a.run AS run_1, b.run AS run_2, a.backbone, a.img, a.frac, a.seed FROM arms a
 JOIN arms b USING (backbone, frac, img, seed) WHERE a.method LIKE 'lora%' AND b.method = 'full'
UNION ALL SELECT concat(a.method, '_minus_frozen'), f.run, a.run, a.backbone, a.img, a.frac, a.seed FROM arms a
 JOIN arms f USING (backbone, frac, img) WHERE f.method = 'frozen' AND (a.method LIKE 'lora%' OR a.method = 'full')
UNION ALL SELECT concat('pretrained_minus_base_', a.method), a.run, b.run, a.backbone,
 a.img, a.frac, a.seed FROM arms a JOIN arms b USING (method, frac, img, seed) WHERE a.backbone = 'a' AND b.backbone = 'b'
UNION ALL SELECT concat('img', a.img, '_minus_img224_', a.method), b.run, a.run, a.backbone, a.img, a.frac, a.seed FROM arms a
 JOIN arms b USING (backbone, method, frac, seed) WHERE a.img <> 224 AND b.img = 224)
"""


def run_pairs(v: Views) -> DataFrame:
    arms = v.predictions().select("run", "backbone", "method", "frac", "img", "seed").distinct()
    return runs.match_runs(arms, "a", "b", "c")


@query("j11_alignment", with_views("preds") + PAIRS + """, t AS (SELECT DISTINCT run_1, run_2 FROM prs),
 ids AS (SELECT run, image_id FROM preds WHERE split = 'test' AND NOT (run = 'b_full_448_3' AND y = 1))
SELECT run_1, run_2, (SELECT count(*) FROM (SELECT image_id FROM ids WHERE run = run_1) a FULL JOIN (SELECT image_id FROM ids WHERE run = run_2) b
 USING (image_id) WHERE a.image_id IS NULL OR b.image_id IS NULL) AS n_unmatched FROM t""")
def j11(v: Views) -> DataFrame:
    """One run lacks its positive images on purpose, so its pairs are reported."""
    p = v.predictions().where("split = 'test'").where("not (run = 'b_full_448_3' and y = 1)")
    return bootstrap.check_aligned(run_pairs(v), p)


CMP = with_views("vecs") + """, o AS (SELECT image_id AS base, embedding AS b FROM vecs WHERE image_id < 1000000),
 x AS (SELECT image_id % 1000000 AS base, CASE WHEN image_id % 50 = 0 THEN embedding[1:32] ELSE embedding END AS a FROM vecs
  WHERE image_id >= 1000000 AND image_id < 2000000),
 c AS (SELECT coalesce(o.base, x.base) AS base, a IS NULL AS only_right, b IS NULL AS only_left, len(a) <> len(b) AS bad, a, b FROM x FULL JOIN o USING (base)),
 d AS (SELECT *, CASE WHEN len(a) = len(b) THEN sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (a[i]::double - b[i]::double) ^ 2)))
  / (sqrt(list_sum(list_transform(b, lambda y: y::double ^ 2))) + 1e-8) END AS rel,
  CASE WHEN len(a) = len(b) THEN list_max(list_transform(generate_series(1, 64), lambda i: abs(a[i]::double - b[i]::double))) END AS mx FROM c)
"""


@query("j12_diff_keyed", CMP + """SELECT count(*) FILTER (only_left) AS only_left, count(*) FILTER (only_right) AS only_right,
 count(*) FILTER (bad) AS shape_mismatch, count(mx) AS n_compared, count(*) FILTER (mx <> 0) AS n_different, round(max(mx), 6) AS max_abs_diff,
 round(max(rel), 6) AS max_rel_diff, round(quantile_cont(rel, 0.5), 6) AS median_rel_diff, arg_max(base, rel) AS worst_key, false AS passed FROM d""")
def j12(v: Views) -> DataFrame:
    """Planted near copies against the originals; every fifth copy is cut short."""
    x = v.vectors()
    right = x.where("image_id < 1000000").select(F.col("image_id").alias("base"), "embedding")
    cut = F.when(F.col("image_id") % 50 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    left = x.where("image_id between 1000000 and 1999999").select((F.col("image_id") % 1000000).alias("base"), cut.alias("embedding"))
    d = arrays.diff_keyed(left, right, "base", "embedding", 1e-2)
    return d.select(*[r(c) if c in ("max_abs_diff", "max_rel_diff", "median_rel_diff") else c for c in d.columns])


@query("j13_benchmark_lookup", with_views("runs", "bench_speed") + """SELECT run, backbone, family, img_per_s AS bench FROM (
 SELECT *, CASE WHEN method LIKE 'lora%' THEN 'lora' ELSE 'full' END AS family FROM runs) JOIN bench_speed USING (backbone, family)""")
def j13(v: Views) -> DataFrame:
    return runs.benchmark_lookup(v.runs(), v.benchmark_speed()).select("run", "backbone", "family", "bench")


@query("j14_coverage_gap", with_views("runs") + """SELECT backbone, method, lr FROM (SELECT DISTINCT backbone, method FROM runs) a,
 (VALUES (0.0001::double), (0.0002), (0.0005), (0.001), (0.002)) g(lr)
WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.backbone = a.backbone AND x.method = a.method AND abs(x.lr - g.lr) < 1e-12)""")
def j14(v: Views) -> DataFrame:
    done = v.runs().select("backbone", "method", "lr")
    grid = F.explode(F.array(*[F.lit(x) for x in (0.0001, 0.0002, 0.0005, 0.001, 0.002)])).alias("lr")
    return joins.coverage_gap(done.select("backbone", "method").distinct().select("*", grid), done, ["backbone", "method"], "lr")


@query("j15_features_by_key", with_views("vecs") + """SELECT image_id, split, round(list_sum(list_transform(e.embedding, lambda x: x::double)), 6) AS total FROM (
 SELECT image_id, CASE WHEN source = 's0' THEN 'test' ELSE 'train' END AS split, image_id % 1000000 AS base FROM vecs) m
 JOIN embeddings e ON e.vec_id = m.base""")
def j15(v: Views) -> DataFrame:
    m = v.vectors().select("image_id", F.when(F.col("source") == "s0", "test").otherwise("train").alias("split"),
                           (F.col("image_id") % 1000000).alias("base"))
    e = v.table("embeddings").select(F.col("vec_id").alias("base"), "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return probe.with_features(m, e, "base").select("image_id", "split", F.round(total, 6).alias("total"))


@query("u1_distinct_rows", with_views("meta") + "SELECT DISTINCT * FROM meta")
def u1(v: Views) -> DataFrame:
    return cohort.distinct_rows(v.meta())


@query("u1_duplicate_counts", with_views("meta") + """SELECT (SELECT count(*) FROM meta) - (SELECT count(*) FROM (SELECT DISTINCT * FROM meta)) AS identical_duplicate_rows,
 (SELECT count(*) FROM (SELECT image_id FROM (SELECT DISTINCT * FROM meta) GROUP BY 1 HAVING count(*) > 1)) AS conflicting_ids""")
def u1b(v: Views) -> DataFrame:
    return cohort.duplicate_counts(v.meta())


@query("u2_conflicting_ids", with_views("meta") + "SELECT image_id FROM (SELECT DISTINCT * FROM meta) GROUP BY 1 HAVING count(*) > 1")
def u2(v: Views) -> DataFrame:
    return cohort.conflicting_ids(v.meta())


@query("u2_unique_records", with_views("uniq") + "SELECT * FROM uniq")
def u2b(v: Views) -> DataFrame:
    return cohort.unique_records(v.meta())


HELD = """, pl AS (SELECT * FROM vecs WHERE image_id >= 1000000 OR label >= 6), hd AS (SELECT * FROM vecs WHERE image_id < 1000000 AND label < 6),
 ex AS (SELECT image_id FROM pl WHERE sha256 IN (SELECT sha256 FROM hd)),
 nr AS (SELECT DISTINCT p.image_id FROM pl p JOIN hd h ON bit_count(xor(p.word, h.word)) <= 3)
"""


def pool_and_held(v: Views) -> tuple[DataFrame, DataFrame]:
    """Originals of six classes as the held-out images, all other rows as the pool."""
    x = v.vectors()
    return x.where("image_id >= 1000000 or label >= 6"), x.where("image_id < 1000000 and label < 6")


@query("u3_exact_or_near", with_views("vecs") + HELD + """SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM ex) THEN 'exact' ELSE 'near' END AS kind
FROM (SELECT image_id FROM ex UNION SELECT image_id FROM nr)""")
def u3(v: Views) -> DataFrame:
    p, h = pool_and_held(v)
    return pool.contaminated(p, h, N_BITS, NEAR)


@query("u4_near_only", with_views("vecs") + HELD + "SELECT image_id FROM nr EXCEPT SELECT image_id FROM ex")
def u4(v: Views) -> DataFrame:
    p, h = pool_and_held(v)
    return pool.contaminated(p, h, N_BITS, NEAR).where("kind = 'near'").select("image_id")


@query("u4_missing_sources", with_views("cohort") + "SELECT replace(s_name, '#', '_') AS source FROM supplier EXCEPT SELECT source FROM cohort")
def u4b(v: Views) -> DataFrame:
    names = v.table("supplier").select(text.slug(F.col("s_name")).alias("source"))
    return names.exceptAll(v.cohort().select("source").distinct())


@query("u5_common_keys", with_views("meta", "dlog") + """SELECT image_id FROM meta WHERE license = 'CC-0'
INTERSECT SELECT image_id FROM dlog WHERE api_license = 'CC-BY'""")
def u5(v: Views) -> DataFrame:
    return (v.meta().where("license = 'CC-0'").select("image_id")
            .intersect(v.log().where("api_license = 'CC-BY'").select("image_id")))
