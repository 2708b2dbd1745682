"""Quality report, partition invariants and pool checks (Q1-Q7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.aggregates import MANIFEST, manifest
from cohortlens.catalog.base import query
from cohortlens.operators import folds, joins, quality
from cohortlens.plans import pool
from cohortlens.plans.fixtures import Views, with_views
from cohortlens.session import materialise


@query("q1_qc_basic", with_views("qc") + r"""SELECT 'rows' AS check, count(*) AS n FROM qc
UNION ALL SELECT 'blank_image_id', count(*) FILTER (image_id = '') FROM qc UNION ALL SELECT 'blank_patient_id', count(*) FILTER (patient_id = '') FROM qc
UNION ALL SELECT 'blank_lesion_id', count(*) FILTER (lesion_id = '') FROM qc UNION ALL SELECT 'blank_label', count(*) FILTER (label = '') FROM qc
UNION ALL SELECT 'blank_label_source', count(*) FILTER (label_source = '') FROM qc
UNION ALL SELECT 'unsafe_names', count(*) FILTER (NOT regexp_matches(image_id, '^[A-Za-z0-9_.\-]+$')) FROM qc
UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT image_id FROM qc GROUP BY 1 HAVING count(*) > 1)""")
def q1(v: Views) -> DataFrame:
    return quality.qc_basic(v.qc())


@query("q2_qc_vocabulary", with_views("qc") + """SELECT count(*) FILTER (label NOT IN ('', 'melanoma', 'nevo', 'altro_benigno', 'altro_maligno', 'ignoto')) AS bad_label,
 count(*) FILTER (label_source NOT IN ('', 'istologia', 'consenso_esperti', 'giudizio_singolo_clinico', 'follow_up_stabile', 'nessuna')) AS bad_label_source FROM qc""")
def q2(v: Views) -> DataFrame:
    return quality.qc_vocabulary(v.qc())


@query("q3_qc_lesions", with_views("qc") + """SELECT (SELECT count(*) FROM (SELECT lesion_id FROM qc WHERE lesion_id <> '' GROUP BY 1
 HAVING count(DISTINCT nullif(label, '')) > 1)) AS label_conflicts, (SELECT count(*) FROM (SELECT lesion_id FROM qc WHERE lesion_id <> ''
 AND patient_id <> '' GROUP BY 1 HAVING count(DISTINCT patient_id) > 1)) AS several_patients""")
def q3(v: Views) -> DataFrame:
    return quality.qc_lesions(v.qc())


@query("q4_qc_leakage", with_views("qc") + """SELECT 'patients_in_several_splits' AS check, count(*) AS n FROM (SELECT patient_id FROM qc
  WHERE patient_id <> '' AND split <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'lesions_in_several_splits', count(*) FROM (SELECT lesion_id FROM qc WHERE lesion_id <> '' AND split <> '' GROUP BY 1
  HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'bad_split', count(*) FROM qc WHERE split NOT IN ('', 'train', 'val', 'test')""")
def q4(v: Views) -> DataFrame:
    return quality.qc_leakage(v.qc())


@query("q5_invariants", with_views("cohort", "downloads") + MANIFEST + """, m AS (SELECT * FROM manifest JOIN downloads USING (image_id))
SELECT (SELECT count(*) FROM (SELECT group_id FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS groups_in_several_splits,
 (SELECT count(*) FROM m WHERE split <> 'test' AND sha256 IN (SELECT sha256 FROM m WHERE split = 'test')) AS test_copies_in_development""")
def q5(v: Views) -> DataFrame:
    """Two rules over the same rows, which are stored for them."""
    rows = joins.matched(manifest(v).select("image_id", "group_id", "split"), v.downloads().select("image_id", "sha256"))
    return folds.invariants(materialise(rows.select("group_id", "split", F.unhex("sha256").alias("sha256")), "matched"))


POOL = """, held AS (SELECT * FROM manifest WHERE split IN ('val', 'test')), tsrc AS (SELECT DISTINCT source FROM manifest WHERE split = 'test'),
pm AS (SELECT e.*, {source} AS source FROM meta e LEFT JOIN smap m ON {ne} = {nm} WHERE lower(image_type) LIKE 'dermoscopic%'),
classified AS (SELECT *, CASE WHEN source IN (SELECT source FROM tsrc) THEN 'test_institution'
  WHEN image_id <> '' AND image_id IN (SELECT image_id FROM held) THEN 'labelled_val_test_image'
  WHEN lesion_id <> '' AND lesion_id IN (SELECT lesion_id FROM held) THEN 'shares_lesion_id'
  WHEN patient_id <> '' AND patient_id IN (SELECT patient_id FROM held) THEN 'shares_patient_id'
  WHEN license NOT IN ('CC-0', 'CC-BY') THEN 'licence' END AS excluded FROM pm)
"""
_NORM = "lower(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))"
POOL_SQL = with_views("cohort", "meta") + MANIFEST + POOL.format(
    ne=_NORM.format("e.attribution"), nm=_NORM.format("m.attribution"),
    source=f"CASE WHEN {_NORM.format('e.attribution')} IN ('', 'anonymous') THEN 'anonymous' ELSE coalesce(m.source, "
           "substr(trim(regexp_replace(e.attribution, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 60)) END")


@query("q6_pool_leaks", POOL_SQL + """, p AS (SELECT * FROM classified WHERE excluded IS NULL)
SELECT 'held_out_images' AS check, (SELECT count(*) FROM p WHERE image_id IN (SELECT image_id FROM held)) AS n
UNION ALL SELECT 'test_source_images', (SELECT count(*) FROM p WHERE source IN (SELECT source FROM tsrc))
UNION ALL SELECT 'empty', (SELECT (count(*) = 0)::bigint FROM p)""")
def q6(v: Views) -> DataFrame:
    m = materialise(manifest(v).where("split <> 'train'").select("image_id", "lesion_id", "patient_id", "source", "split"), "manifest")
    return quality.pool_leaks(pool.select_pool(v.meta(), v.source_map(), m), m)


@query("q7_licence_mismatches", with_views("cohort", "downloads") + """SELECT count(*) FILTER (api_license IS NOT NULL AND api_license <> license) AS mismatches
FROM cohort JOIN (SELECT image_id, api_license FROM downloads) USING (image_id)""")
def q7(v: Views) -> DataFrame:
    return joins.licence_mismatches(v.cohort(), v.downloads())
