"""Duplicates, linkage, partitions and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.aggregates import manifest
from cohortlens.catalog.base import query
from cohortlens.catalog.quality import POOL_SQL
from cohortlens.catalog.relations import HELD, pool_and_held
from cohortlens.operators import folds, graph, similarity
from cohortlens.plans import pool
from cohortlens.plans.fixtures import DUCK, NEAR, N_BITS, TEST_SOURCES, Views, with_views
from cohortlens.session import materialise

# Near pairs folded to one row per pair of hashes, and stars inside equal hashes.
NEAR_SQL = f"""rep AS (SELECT word, min(image_id) AS id, count(*) AS n FROM vecs GROUP BY word),
near AS (SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, bit_count(xor(a.word, b.word))::int AS hamming,
  CASE WHEN a.id < b.id THEN a.n ELSE b.n END AS copies_a, CASE WHEN a.id < b.id THEN b.n ELSE a.n END AS copies_b
  FROM rep a JOIN rep b ON a.word < b.word WHERE bit_count(xor(a.word, b.word)) <= {NEAR}
 UNION ALL SELECT r.id, v.image_id, 0, r.n, r.n FROM vecs v JOIN rep r USING (word) WHERE v.image_id <> r.id)"""
EDGE_SQL = NEAR_SQL + f""", root AS (SELECT sha256, min(image_id) AS id FROM vecs GROUP BY sha256),
edges AS (SELECT id_a, id_b, hamming FROM near UNION SELECT r.id, v.image_id,
  CASE WHEN bit_count(xor(w.word, v.word)) <= {NEAR} THEN bit_count(xor(w.word, v.word)) ELSE 0 END::int
  FROM vecs v JOIN root r USING (sha256) JOIN vecs w ON w.image_id = r.id WHERE v.image_id <> r.id)"""
COMP_SQL = EDGE_SQL + """, comp AS (SELECT node AS image_id, component FROM (
  WITH RECURSIVE reach(node, lab) AS (SELECT image_id, image_id FROM vecs UNION
   SELECT CASE WHEN e.id_a = r.node THEN e.id_b ELSE e.id_a END, r.lab FROM reach r JOIN edges e ON r.node IN (e.id_a, e.id_b)
   WHERE r.lab < CASE WHEN e.id_a = r.node THEN e.id_b ELSE e.id_a END)
  SELECT node, min(lab) AS component FROM reach GROUP BY node))"""


@query("j6_near_pairs", with_views("vecs") + ", " + NEAR_SQL + "SELECT * FROM near")
def j6(v: Views) -> DataFrame:
    return similarity.near_pairs(v.vectors(), N_BITS, NEAR)


@query("j7_near_semi", with_views("vecs") + HELD + "SELECT image_id, source FROM pl WHERE image_id IN (SELECT image_id FROM nr)")
def j7(v: Views) -> DataFrame:
    p, h = pool_and_held(v)
    return similarity.near_semi(p, h, N_BITS, NEAR).select("image_id", "source")


@query("j8_exact_pairs", """WITH r AS (SELECT sha256(text) AS digest, min(doc_id) AS src, count(*) AS n FROM documents GROUP BY 1)
SELECT src, doc_id AS dst FROM documents JOIN r ON digest = sha256(text) WHERE doc_id <> src""")
def j8(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return similarity.exact_pairs(d, "doc_id")


@query("j8_exact_groups", """SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id,
 (count(*) * (count(*) - 1) // 2)::bigint AS pairs FROM documents GROUP BY 1 HAVING count(*) > 1""")
def j8b(v: Views) -> DataFrame:
    return similarity.exact_groups(v.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")


ENRICHED = with_views("vecs") + ", " + EDGE_SQL + """, enr AS (SELECT id_a, id_b, a.source AS source_a, b.source AS source_b, hamming,
 a.sha256 = b.sha256 AS exact_sha256, a.label = b.label AS same_label, a.lesion_id <> '' AND a.lesion_id = b.lesion_id AS same_lesion,
 a.patient_id <> '' AND a.patient_id = b.patient_id AS same_patient
 FROM edges JOIN vecs a ON a.image_id = id_a JOIN vecs b ON b.image_id = id_b) """


def enriched(v: Views) -> DataFrame:
    return similarity.enrich_pairs(v.vector_edges(), v.vectors())


@query("j9_enrich_pairs", ENRICHED + "SELECT * FROM enr")
def j9(v: Views) -> DataFrame:
    return enriched(v)


@query("t1_doubtful_pairs", ENRICHED + "SELECT * FROM enr WHERE NOT exact_sha256 ORDER BY hamming DESC, id_a, id_b LIMIT 48")
def t1(v: Views) -> DataFrame:
    return similarity.doubtful_pairs(enriched(v))


@query("h1_components", with_views("vecs") + ", " + COMP_SQL + " SELECT image_id, component FROM comp")
def h1(v: Views) -> DataFrame:
    e = v.vector_edges().select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    return graph.components(e, v.vectors().select("image_id"), "image_id")


@query("h2_link_groups", with_views("linked") + "SELECT image_id, group_id FROM linked")
def h2(v: Views) -> DataFrame:
    return graph.link_groups(v.linkable(), ["patient_id", "lesion_id", "dup_cluster"]).select("image_id", "group_id")


@query("h3_decide_clusters", with_views("vecs") + ", " + COMP_SQL + """SELECT image_id, source,
 CASE WHEN n > 1 THEN concat('dup', component) ELSE '' END AS dup_cluster,
 CASE WHEN n = 1 THEN 'keep' WHEN l1 <> l2 THEN 'exclude_label_conflict' ELSE 'cluster' END AS action FROM (
 SELECT v.image_id, source, component, count(*) OVER w AS n, min(label) OVER w AS l1, max(label) OVER w AS l2
 FROM vecs v JOIN comp USING (image_id) WINDOW w AS (PARTITION BY component))""")
def h3(v: Views) -> DataFrame:
    e = v.vector_edges().select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    comp = graph.components(e, v.vectors().select("image_id"), "image_id")
    return graph.decide_clusters(v.vectors(), comp).select("image_id", "source", "dup_cluster", "action")


@query("h4_isolate_test", with_views("isolated") + "SELECT image_id, source, group_id, is_test FROM isolated")
def h4(v: Views) -> DataFrame:
    linked = graph.link_groups(v.linkable(), ["patient_id", "lesion_id", "dup_cluster"])
    return graph.isolate_test(linked, TEST_SOURCES).select("image_id", "source", "group_id", "is_test")


def fold_sql(name: str, table: str, k: int) -> str:
    """Folds of the groups of ``table``: dealt per dominant stratum from large to small, forwards and backwards."""
    return f"""{name}_s AS (SELECT group_id, concat(source, '_', label) AS stratum, count(*) AS n FROM {table} GROUP BY ALL),
{name}_g AS (SELECT group_id, arg_min(stratum, (-n, stratum)) AS stratum, sum(n)::bigint AS size FROM {name}_s GROUP BY group_id),
{name}_i AS (SELECT group_id, (row_number() OVER (PARTITION BY stratum ORDER BY size DESC, md5(concat('0:', group_id)), group_id) - 1) % {2 * k} AS t FROM {name}_g),
{name} AS (SELECT group_id, (CASE WHEN t < {k} THEN t ELSE {2 * k - 1} - t END)::int AS fold FROM {name}_i)"""


@query("h5_group_folds", with_views("linked") + ", " + fold_sql("fd", "linked", 7) + " SELECT image_id, group_id, fold FROM linked JOIN fd USING (group_id)")
def h5(v: Views) -> DataFrame:
    linked = graph.link_groups(v.linkable(), ["patient_id", "lesion_id", "dup_cluster"])
    return folds.group_folds(linked, 7).select("image_id", "group_id", "fold")


@query("h6_nested_fractions", with_views("cohort") + """, man0 AS (SELECT *, concat('g', CASE WHEN patient_id <> '' THEN patient_id ELSE image_id END) AS group_id FROM cohort),
tr AS (SELECT *, CASE WHEN source IN ('NATION_1', 'NATION_2', 'NATION_3') THEN 'test' WHEN """ + DUCK.h60("group_id") + """ % 7 = 0 THEN 'val' ELSE 'train' END AS split FROM man0),
train AS (SELECT * FROM tr WHERE split = 'train'), """ + fold_sql("fd", "train", 10) + """
SELECT image_id, split, CASE WHEN split <> 'train' THEN '' WHEN fold = 0 THEN '0.1' WHEN fold <= 2 THEN '0.3' ELSE '1.0' END AS train_frac
FROM tr LEFT JOIN fd ON fd.group_id = tr.group_id AND split = 'train'""")
def h6(v: Views) -> DataFrame:
    return folds.nested_fractions(manifest(v).drop("train_frac")).select("image_id", "split", "train_frac")


PARTITION_SQL = (with_views("isolated") + ", dev AS (SELECT * FROM isolated WHERE NOT is_test), " + fold_sql("fv", "dev", 7) + """,
sp AS (SELECT i.*, CASE WHEN is_test THEN 'test' WHEN fold = 0 THEN 'val' ELSE 'train' END AS split FROM isolated i
  LEFT JOIN fv ON fv.group_id = i.group_id AND NOT is_test),
one AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY split, sha256 ORDER BY image_id) = 1),
otr AS (SELECT * FROM one WHERE split = 'train'), """ + fold_sql("ft", "otr", 10) + """
SELECT image_id, file, source, patient_id, lesion_id, one.group_id, label, label_source, license, attribution, diagnosis_detail, age_band, sex,
 body_site, split, CASE WHEN split <> 'train' THEN '' WHEN fold = 0 THEN '0.1' WHEN fold <= 2 THEN '0.3' ELSE '1.0' END AS train_frac, sha256
FROM one LEFT JOIN ft ON ft.group_id = one.group_id AND split = 'train'""")


@query("h7_partition", PARTITION_SQL)
def h7(v: Views) -> DataFrame:
    c = materialise(v.cohort(), "cohort")
    m = folds.partition(c, v.decisions(c.select("image_id", "label"), ("file", "sha256"), as_bytes=True), TEST_SOURCES)
    return m.withColumn("sha256", F.lower(F.hex("sha256")))


@query("h8_select_pool", POOL_SQL + "SELECT image_id, license, attribution, source FROM classified WHERE excluded IS NULL")
def h8(v: Views) -> DataFrame:
    return pool.select_pool(v.meta(), v.source_map(), manifest(v))


@query("h8_pool_report", POOL_SQL + "SELECT coalesce(excluded, 'selected') AS step, count(*) AS n FROM classified GROUP BY 1")
def h8b(v: Views) -> DataFrame:
    return pool.pool_report(v.meta(), v.source_map(), manifest(v))


@query("h9_decontaminate", with_views("vecs") + HELD + """SELECT image_id FROM pl WHERE image_id NOT IN (SELECT image_id FROM ex)
 AND image_id NOT IN (SELECT image_id FROM nr)""")
def h9(v: Views) -> DataFrame:
    p, h = pool_and_held(v)
    return pool.decontaminate(p, h, N_BITS, NEAR).select("image_id")


@query("h9_contamination_summary", with_views("vecs") + HELD + """SELECT (SELECT count(*) FROM pl) AS pool_images_checked, (SELECT count(*) FROM hd) AS held_images,
 (SELECT count(*) FROM ex) AS exact_copies, (SELECT count(*) FROM (SELECT image_id FROM nr EXCEPT SELECT image_id FROM ex)) AS near_duplicates_only,
 (SELECT count(*) FROM (SELECT image_id FROM nr UNION SELECT image_id FROM ex)) AS excluded_total""")
def h9b(v: Views) -> DataFrame:
    p, h = pool_and_held(v)
    return pool.contamination_summary(p, h, N_BITS, NEAR)
