"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.catalog.aggregates import MANIFEST, manifest, r
from cohortlens.catalog.base import query
from cohortlens.functions import hashing, text, vectors
from cohortlens.operators import arrays, cohort, folds
from cohortlens.plans import fixtures
from cohortlens.plans.fixtures import N_BITS, TEST_SOURCES, Views, with_views
from cohortlens.session import materialise


@query("p1_normalise", with_views("meta") + "SELECT * FROM meta")
def p1(v: Views) -> DataFrame:
    return v.meta()


@query("p2_prefix_filter", with_views("meta") + "SELECT image_id, image_type FROM meta WHERE lower(image_type) LIKE 'dermoscopic%'")
def p2(v: Views) -> DataFrame:
    return v.meta().where(cohort.is_dermoscopic(F.col("image_type"))).select("image_id", "image_type")


@query("p3_equality_filter", with_views("meta") + "SELECT image_id, confirm FROM meta WHERE lower(confirm) = 'histopathology'")
def p3(v: Views) -> DataFrame:
    return v.meta().where(cohort.is_confirmed(F.col("confirm"))).select("image_id", "confirm")


@query("p4_allow_lists", with_views("meta") + """SELECT image_id, diagnosis_1, license FROM meta
WHERE lower(diagnosis_1) IN ('benign', 'malignant') AND license IN ('CC-0', 'CC-BY')""")
def p4(v: Views) -> DataFrame:
    m = v.meta().where(cohort.has_known_label(F.col("diagnosis_1")) & F.col("license").isin("CC-0", "CC-BY"))
    return m.select("image_id", "diagnosis_1", "license")


@query("p5_substring_exclusion", with_views("meta") + "SELECT image_id, license FROM meta WHERE upper(license) NOT LIKE '%NC%'")
def p5(v: Views) -> DataFrame:
    return v.meta().where(~cohort.is_non_commercial(F.col("license"))).select("image_id", "license")


@query("p6_waterfall", with_views("meta", "uniq") + """, s AS (SELECT CASE WHEN NOT lower(image_type) LIKE 'dermoscopic%' THEN 'not_dermoscopic'
  WHEN lower(confirm) <> 'histopathology' THEN 'not_histopathology'
  WHEN lower(diagnosis_1) NOT IN ('benign', 'malignant') THEN 'diagnosis_not_benign_malignant'
  WHEN image_id = '' THEN 'empty_image_id' ELSE 'eligible' END AS step FROM uniq)
SELECT n.step, CASE n.step WHEN 'identical_duplicate_rows' THEN (SELECT count(*) FROM meta) - (SELECT count(*) FROM (SELECT DISTINCT * FROM meta))
  WHEN 'image_id_conflicting_metadata' THEN (SELECT count(*) FROM (SELECT image_id FROM (SELECT DISTINCT * FROM meta) GROUP BY 1 HAVING count(*) > 1))
  ELSE (SELECT count(*) FROM s WHERE s.step = n.step) END AS removed
FROM (VALUES ('identical_duplicate_rows'), ('image_id_conflicting_metadata'), ('not_dermoscopic'), ('not_histopathology'),
 ('diagnosis_not_benign_malignant'), ('empty_image_id'), ('eligible')) n(step)""")
def p6(v: Views) -> DataFrame:
    return cohort.exclusion_report(v.meta())


@query("p6_removed_values", with_views("uniq") + """SELECT diagnosis_1 AS value, count(*) AS n FROM uniq
WHERE lower(image_type) LIKE 'dermoscopic%' AND lower(confirm) = 'histopathology' AND lower(diagnosis_1) NOT IN ('benign', 'malignant') GROUP BY 1""")
def p6b(v: Views) -> DataFrame:
    return cohort.removed_values(cohort.unique_records(v.meta()), cohort.eligibility_steps(), "diagnosis_not_benign_malignant", "diagnosis_1")


@query("p7_require_patient_id", with_views("cohort") + """SELECT image_id, source, patient_id FROM cohort
WHERE NOT (source IN ('NATION_1', 'NATION_2') AND patient_id = '')""")
def p7(v: Views) -> DataFrame:
    return folds.require_patient_id(v.cohort(), TEST_SOURCES[:2]).select("image_id", "source", "patient_id")


@query("p8_read_manifest", with_views("cohort") + MANIFEST + """SELECT image_id, split, train_frac, (label = 'malignant')::int AS y FROM manifest
WHERE split <> 'train' OR TRY_CAST(train_frac AS DOUBLE) <= 0.3 + 1e-9""")
def p8(v: Views) -> DataFrame:
    return folds.read_manifest(manifest(v), 0.3).select("image_id", "split", "train_frac", "y")


@query("p9_binary_export", with_views("cohort") + MANIFEST + """SELECT concat(image_id, '.jpg') AS image, (label = 'malignant')::int AS label,
 (label = 'malignant')::int AS binary_label, split FROM manifest""")
def p9(v: Views) -> DataFrame:
    return folds.binary_export(manifest(v).withColumn("file", F.concat("image_id", F.lit(".jpg"))))


@query("p10_rename_prune", with_views("raw_meta") + "SELECT image_id, license, attribution FROM raw_meta")
def p10(v: Views) -> DataFrame:
    return v.raw_meta().withColumnsRenamed({"isic_id": "image_id", "copyright_license": "license"}).select("image_id", "license", "attribution")


@query("p11_input_gates", with_views("cohort") + """SELECT source, count(*) AS images FROM cohort
WHERE source IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY source""")
def p11(v: Views) -> DataFrame:
    """The gates need no more of the cohort than its sources, and those are counted once."""
    n = materialise(v.cohort().where(F.col("source").isin(TEST_SOURCES)).groupBy("source").agg(F.count(F.lit(1)).alias("images")), "sources")
    folds.check_test_sources(n, TEST_SOURCES, v.source_map(), TEST_SOURCES[:1])
    return n


@query("f1_norm_key", with_views("raw_meta") + f"SELECT image_id, {fixtures.NORM.format('attribution')} AS attr_key FROM raw_meta")
def f1(v: Views) -> DataFrame:
    return v.raw_meta().select(F.col("isic_id").alias("image_id"), text.norm_key(F.col("attribution")).alias("attr_key"))


@query("f2_source_of", with_views("cohort") + "SELECT image_id, attribution, source FROM cohort")
def f2(v: Views) -> DataFrame:
    return cohort.with_source(v.eligible(), v.source_map()).select("image_id", "attribution", "source")


@query("f3_age_band", with_views("meta") + f"""SELECT image_id, age, CASE WHEN isfinite(TRY_CAST(age AS DOUBLE)) THEN
 concat(CAST(floor({fixtures._AGE} / 10) * 10 AS BIGINT), '-', CAST(floor({fixtures._AGE} / 10) * 10 + 9 AS BIGINT)) ELSE '' END AS age_band FROM meta""")
def f3(v: Views) -> DataFrame:
    return v.meta().select("image_id", "age", text.age_band(F.col("age")).alias("age_band"))


@query("f4_label_of", with_views("meta") + """SELECT image_id, CASE lower(diagnosis_1) WHEN 'benign' THEN 'benign'
 WHEN 'malignant' THEN 'malignant' END AS label FROM meta""")
def f4(v: Views) -> DataFrame:
    return v.meta().select("image_id", text.label_of(F.col("diagnosis_1")).alias("label"))


@query("f5_joined_detail", with_views("meta") + "SELECT image_id, trim(concat(diagnosis_2, ' > ', diagnosis_3), ' >') AS detail FROM meta")
def f5(v: Views) -> DataFrame:
    return v.meta().select("image_id", text.joined_detail(F.col("diagnosis_2"), F.col("diagnosis_3")).alias("detail"))


@query("f6_safe_name", r"SELECT page_id, regexp_matches(split_part(url, '/', -1), '^[A-Za-z0-9_.\-]+$') AS safe FROM pages")
def f6(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.is_safe_name(F.substring_index("url", "/", -1)).alias("safe"))


@query("f7_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f7(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", hashing.digest(F.col("text")).alias("digest"))


@query("f8_dhash", with_views("vecs") + "SELECT image_id, bits, word, lower(printf('%014x', word)) AS hex FROM vecs")
def f8(v: Views) -> DataFrame:
    b = F.col("bits")
    return v.vectors().select("image_id", "bits", hashing.words(b, N_BITS)[0].alias("word"), hashing.dhash_hex(b, N_BITS).alias("hex"))


@query("f9_hamming", with_views("vecs") + """SELECT a.image_id, bit_count(xor(a.word, b.word))::int AS hamming
FROM vecs a JOIN vecs b ON b.image_id = a.image_id % 1000000""")
def f9(v: Views) -> DataFrame:
    w = F.array(*hashing.words(F.col("bits"), N_BITS))
    a = v.vectors().select("image_id", (F.col("image_id") % 1000000).alias("base"), w.alias("wa"))
    b = v.vectors().select(F.col("image_id").alias("base"), w.alias("wb"))
    return a.join(b, "base").select("image_id", hashing.hamming_arrays(F.col("wa"), F.col("wb")).alias("hamming"))


@query("f10_link_basis", with_views("cohort") + """SELECT source, CASE WHEN patient_id <> '' THEN 'patient' WHEN lesion_id <> '' THEN 'lesion'
 ELSE 'image' END AS basis, count(*) AS images FROM cohort GROUP BY ALL""")
def f10(v: Views) -> DataFrame:
    return (v.cohort().groupBy("source", text.link_basis(F.col("patient_id"), F.col("lesion_id")).alias("basis"))
            .agg(F.count(F.lit(1)).alias("images")))


@query("f11_url_extension", r"""SELECT page_id, CASE WHEN x = '' THEN '.jpg' WHEN x IN ('.jpg', '.jpeg', '.png') THEN x END AS ext FROM (
 SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '/', -1), '^\.*[^.].*?(\.[^.]*)$', 1)) AS x FROM pages)""")
def f11(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.url_extension(F.col("url")).alias("ext"))


@query("f12_run_name", with_views("runs") + """SELECT run, concat(backbone, '_', method, '_frac', frac, '_seed', seed,
 CASE WHEN img <> 224 THEN concat('_img', img) ELSE '' END) AS name FROM runs""")
def f12(v: Views) -> DataFrame:
    c = F.col
    return v.runs().select("run", text.run_name(c("backbone"), c("method"), c("frac"), c("img"), c("seed")).alias("name"))


@query("f13_family_fraction", with_views("runs") + """SELECT run, CASE WHEN method LIKE 'lora%' THEN 'lora' ELSE 'full' END AS family,
 frac AS parsed FROM runs""")
def f13(v: Views) -> DataFrame:
    key = F.concat(F.lit("frac"), F.col("frac").cast("string"))
    return v.runs().select("run", text.method_family(F.col("method")).alias("family"), text.fraction_of(key).alias("parsed"))


@query("f14_group_keys", with_views("cohort") + MANIFEST + """SELECT concat(source, '_', label) AS stratum, concat(split, '/', source) AS path_key,
 count(*) AS n FROM manifest GROUP BY ALL""")
def f14(v: Views) -> DataFrame:
    m = manifest(v)
    return (m.groupBy(F.concat_ws("_", "source", "label").alias("stratum"), F.concat_ws("/", "split", "source").alias("path_key"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("f15_rounding", """SELECT event_type, round(100.0::double * avg((value > 50)::int), 1) AS pct,
 printf('%.3f', max(value)) AS shown, '' AS missing FROM events GROUP BY event_type""")
def f15(v: Views) -> DataFrame:
    return v.table("events").groupBy("event_type").agg(
        text.percent(F.avg((F.col("value") > 50).cast("int"))).alias("pct"), text.decimals3(F.max("value")).alias("shown"),
        text.decimals3(F.max(F.lit(None).cast("double"))).alias("missing"))


def unit_pairs(v: Views) -> DataFrame:
    """Every vector beside its own base vector."""
    a = v.vectors().select("image_id", (F.col("image_id") % 1000000).alias("base"), F.col("embedding").alias("a"))
    return a.join(v.table("embeddings").select(F.col("vec_id").alias("base"), F.col("embedding").alias("b")), "base")


@query("f16_vector_norms", with_views("vecs") + """SELECT image_id, round(sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (a[i]::double - b[i]::double) ^ 2)))
 / (sqrt(list_sum(list_transform(b, lambda x: x::double ^ 2))) + 1e-8), 6) AS rel_l2,
 round(list_max(list_transform(generate_series(1, 64), lambda i: abs(a[i]::double - b[i]::double))), 6) AS max_abs
FROM (SELECT v.image_id, v.embedding AS a, e.embedding AS b FROM vecs v JOIN embeddings e ON e.vec_id = v.image_id % 1000000)""")
def f16(v: Views) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return unit_pairs(v).select("image_id", F.round(vectors.rel_l2(a, b), 6).alias("rel_l2"), F.round(vectors.max_abs_diff(a, b), 6).alias("max_abs"))


@query("f17_path_number", """SELECT run, min(n) AS number, arg_min(path, n) AS path FROM (
 SELECT user_id AS run, event_id AS n, concat('run', user_id, '/step_', event_id, '/ckpt') AS path FROM events) GROUP BY run""")
def f17(v: Views) -> DataFrame:
    p = v.table("events").select(F.col("user_id").alias("run"),
                                 F.concat(F.lit("run"), "user_id", F.lit("/step_"), "event_id", F.lit("/ckpt")).alias("path"))
    p = p.withColumn("number", text.path_number(F.col("path")))
    return p.groupBy("run").agg(F.min("number").alias("number"), F.min_by("path", "number").alias("path"))


@query("f17_earliest_checkpoint", """SELECT concat('run', user_id, '/step_', event_id, '/ckpt') AS path, event_id AS number FROM events
WHERE event_id = (SELECT min(event_id) FROM events)""")
def f17b(v: Views) -> DataFrame:
    p = v.table("events").select(F.concat(F.lit("run"), "user_id", F.lit("/step_"), "event_id", F.lit("/ckpt")).alias("path"))
    return arrays.earliest_checkpoint(p.withColumn("number", text.path_number(F.col("path"))))
