"""Metadata to cohort: duplicate records, exclusion waterfall, sources, derived columns and source profiles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions import text
from cohortlens.session import materialise

# ---- fixed values
LABEL_SOURCE = "istologia"
COHORT_COLUMNS = ["image_id", "source", "patient_id", "lesion_id", "label", "label_source", "license", "attribution",
                  "diagnosis_detail", "age_band", "sex", "body_site"]
MIN_PATIENT_COVERAGE = 90.0
MIN_PER_CLASS = 150
EXCLUDED_COUNTRY = "Australia"
BLANK = "(blank)"


# ---- filters
def is_dermoscopic(c: Column) -> Column:
    return F.lower(c).startswith("dermoscopic")


def is_confirmed(c: Column) -> Column:
    return F.lower(c) == "histopathology"


def has_known_label(c: Column) -> Column:
    return F.lower(c).isin(list(text.LABELS))


def is_non_commercial(c: Column) -> Column:
    return F.upper(c).contains("NC")


def eligibility_steps(image_id: str = "image_id") -> list[tuple[str, Column]]:
    """Named filters in the order they are counted: each is the condition to KEEP a row."""
    return [("not_dermoscopic", is_dermoscopic(F.col("image_type"))),
            ("not_histopathology", is_confirmed(F.col("confirm"))),
            ("diagnosis_not_benign_malignant", has_known_label(F.col("diagnosis_1"))),
            (f"empty_{image_id}", F.col(image_id) != "")]


def failed_step(steps: list[tuple[str, Column]]) -> Column:
    """Name of the first filter a row fails, NULL for a row that passes all."""
    return F.coalesce(*[F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)) for name, keep in steps])


def waterfall(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows removed by each filter in turn, and the rows left, from a single pass."""
    at = failed_step(steps)
    names = [n for n, _ in steps]
    one = df.agg(*[F.count_if(at == n).alias(n) for n in names], F.count_if(at.isNull()).alias("eligible"))
    pairs = ", ".join(f"'{n}', `{n}`" for n in names + ["eligible"])
    return one.select(F.expr(f"stack({len(names) + 1}, {pairs}) as (step, removed)"))


def removed_values(df: DataFrame, steps: list[tuple[str, Column]], step: str, col: str) -> DataFrame:
    """Values of ``col`` among the rows one filter removed."""
    return value_counts(df.where(failed_step(steps) == step), col)


def apply_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for _, keep in steps:
        df = df.where(keep)
    return df


# ---- duplicate records
def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def conflicting_ids(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Identifiers that occur with different contents."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min(F.struct(*rest)).alias("lo"), F.max(F.struct(*rest)).alias("hi"))
            .where(F.col("lo") != F.col("hi")).select(key))


def unique_records(df: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per identifier; identifiers with different contents are left out whole. Smallest and largest content are
    combined before the shuffle, so identical rows and a hot identifier cost one row per task."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("lo"), F.max(F.struct(*rest)).alias("hi"))
    return g.where(F.col("lo") == F.col("hi")).select(*[F.col(f"lo.{c}") if c != key else F.col(key) for c in df.columns])


def _content(columns: list[str]) -> list[Column]:
    """Two hashes, 128 bits together, of the contents of a row; a null is a content of its own."""
    cells = [x for c in columns for x in (F.col(c), F.isnull(c))]
    return [F.xxhash64(*cells), F.xxhash64(F.lit("second"), *reversed(cells))]


def eligible_records(df: DataFrame, steps: list[tuple[str, Column]], key: str = "image_id") -> DataFrame:
    """``apply_steps(unique_records(df), steps)`` in one light shuffle: contents are compared by hashes of whole rows, and a row
    that fails a step is sent as its identifier alone: beside a row that passes it is another content, whatever it is. Columns
    that nobody reads are not sent either."""
    rest = [c for c in df.columns if c != key]
    keep = F.coalesce(functools.reduce(Column.__and__, [k for _, k in steps]), F.lit(False))
    one, two = _content(rest)
    rows = df.select(F.col(key), F.when(keep, one).alias("_one"), F.when(keep, two).alias("_two"), keep.alias("_keep"), *[F.when(keep, F.col(c)).alias(c) for c in rest])
    g = rows.groupBy(key).agg(F.min("_one").alias("_a"), F.max("_one").alias("_b"), F.min("_two").alias("_c"), F.max("_two").alias("_d"),
                              F.min("_keep").alias("_keep"), *[F.max(c).alias(c) for c in rest])
    return g.where("_keep and _a = _b and _c = _d").select(*df.columns)


def duplicate_counts(df: DataFrame, key: str = "image_id") -> DataFrame:
    """Identical rows beyond the first (counted as rows) and conflicting identifiers (counted as identifiers)."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    ids = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_variants"), F.sum(F.col("_n") - 1).alias("_extra"))
    return ids.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("identical_duplicate_rows"),
                   F.count_if(F.col("_variants") > 1).alias("conflicting_ids"))


# ---- sources
def source_lookup(source_map: DataFrame) -> DataFrame:
    """Map rows keyed by normalised attribution; one row per key."""
    return (source_map.groupBy(text.norm_key(F.col("attribution")).alias("_key"))
            .agg(F.max(F.struct("source", "country")).alias("_s")).select("_key", F.col("_s.source").alias("_mapped")))


def with_source(df: DataFrame, source_map: DataFrame) -> DataFrame:
    """Adds ``source``: anonymous, the mapped name, or a name made from the raw attribution. The lookup is stored, so its
    real size decides whether the rows have to be shuffled; anonymous rows need none and do not meet in one task."""
    nobody = text.is_anonymous(F.col("attribution"))
    lookup = materialise(source_lookup(source_map).withColumn("_s", F.lit(0)), "sources")
    keyed = df.withColumns({"_key": text.norm_key(F.col("attribution")),
                            "_s": F.when(nobody, F.pmod(F.xxhash64("image_id"), F.lit(64)) + 1).otherwise(0).cast("int")})
    named = F.when(nobody, "anonymous").otherwise(F.coalesce(F.col("_mapped"), text.slug(F.col("attribution"))))
    return keyed.join(lookup, ["_key", "_s"], "left").withColumn("source", named).drop("_key", "_s", "_mapped")


def countries(source_map: DataFrame) -> DataFrame:
    return source_map.groupBy("source").agg(F.max("country").alias("country"))


def attribution_rollup(df: DataFrame) -> DataFrame:
    """Spellings grouped by key, with the most frequent one (the smallest on a tie) and the number of rows."""
    return (df.groupBy(text.norm_key(F.col("attribution")).alias("attr_key"))
            .agg(F.mode("attribution", True).alias("attribution"), F.count(F.lit(1)).alias("images")))


def unmapped_attributions(df: DataFrame, source_map: DataFrame) -> DataFrame:
    rollup = attribution_rollup(df)
    return rollup.join(source_lookup(source_map), rollup.attr_key == F.col("_key"), "left_anti")


def derive(df: DataFrame) -> DataFrame:
    """Cohort columns of eligible rows that already carry ``source``."""
    return df.select(
        "image_id", "source", "patient_id", "lesion_id", text.label_of(F.col("diagnosis_1")).alias("label"),
        F.lit(LABEL_SOURCE).alias("label_source"), "license", "attribution",
        text.joined_detail(F.col("diagnosis_2"), F.col("diagnosis_3")).alias("diagnosis_detail"),
        text.age_band(F.col("age")).alias("age_band"), "sex", "body_site")


def build_cohort(meta: DataFrame, source_map: DataFrame) -> DataFrame:
    """Cohort table of a canonical metadata table."""
    eligible = eligible_records(meta, eligibility_steps())
    return derive(with_source(eligible, source_map)).select(*COHORT_COLUMNS)


def exclusion_report(meta: DataFrame) -> DataFrame:
    """Every exclusion with its count, in two passes over the table."""
    dup = duplicate_counts(meta).select(F.expr(
        "stack(2, 'identical_duplicate_rows', identical_duplicate_rows, "
        "'image_id_conflicting_metadata', conflicting_ids) as (step, removed)"))
    return dup.unionByName(waterfall(unique_records(meta), eligibility_steps()))


# ---- profiles
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return (df.groupBy(F.when(text.blank(F.col(col)), BLANK).otherwise(F.col(col)).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct(F.when(F.col("patient_id") != "", F.col("patient_id"))).alias("patients"),
                  F.countDistinct(F.when(F.col("lesion_id") != "", F.col("lesion_id"))).alias("lesions"))


def lesion_conflicts(df: DataFrame) -> DataFrame:
    """Lesions with more than one label, per source."""
    per = (df.where(F.col("lesion_id") != "").groupBy("source", "lesion_id")
           .agg((F.min("label") != F.max("label")).alias("_conflict")))
    return per.groupBy("source").agg(F.count_if("_conflict").alias("lesion_label_conflicts"))


def map_counts(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Map of value to count per key; the number of distinct values bounds the map."""
    return (df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")).groupBy(key)
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "_n")))).alias(name)))


def profile_sources(cohort: DataFrame, source_map: DataFrame) -> DataFrame:
    """One row per source: sizes, classes, coverage, conflicts, licences and whether the source is verified."""
    has_patient, has_lesion = F.col("patient_id") != "", F.col("lesion_id") != ""
    base = cohort.groupBy("source").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("label") == "benign").alias("benign"),
        F.count_if(F.col("label") == "malignant").alias("malignant"),
        text.percent(F.avg((F.col("label") == "malignant").cast("int"))).alias("pct_malignant"),
        F.countDistinct(F.when(has_patient, F.col("patient_id"))).alias("patients"),
        F.countDistinct(F.when(has_lesion, F.col("lesion_id"))).alias("lesions"),
        text.percent(F.avg(has_patient.cast("int"))).alias("patient_cov_pct"),
        text.percent(F.avg(has_lesion.cast("int"))).alias("lesion_cov_pct"))
    return (base.join(lesion_conflicts(cohort), "source", "left")
            .join(map_counts(cohort, "source", "license", "licenses"), "source", "left")
            .join(countries(source_map), "source", "left")
            .withColumns({"lesion_label_conflicts": F.coalesce("lesion_label_conflicts", F.lit(0)),
                          "verified": F.col("country").isNotNull(), "country": F.coalesce("country", F.lit("?"))}))


def test_candidates(profile: DataFrame, min_per_class: int = MIN_PER_CLASS) -> DataFrame:
    """Adds the verdict: ``yes``, or ``no:`` with every reason."""
    reasons = F.array(
        F.when(F.col("source") == "anonymous", "anonymous")
        .when(~F.col("verified"), "institution not verified in source_map"),
        F.when(F.col("patient_cov_pct") < MIN_PATIENT_COVERAGE, f"patient_cov<{MIN_PATIENT_COVERAGE}"),
        F.when(F.least("benign", "malignant") < min_per_class, f"<{min_per_class} per class (before dedup)"),
        F.when(F.lower("country") == EXCLUDED_COUNTRY.lower(), EXCLUDED_COUNTRY),
        F.when(F.col("country") == "?", "country unknown"))
    why = F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ", ")
    return profile.withColumn("test_candidate", F.when(why == "", "yes").otherwise(F.concat(F.lit("no: "), why)))


def with_total(cohort: DataFrame) -> DataFrame:
    """Class counts per source and, in the same pass, for all sources together (``TOTAL``)."""
    return (cohort.rollup("source").agg(
        F.grouping("source").alias("_all"), F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("label") == "benign").alias("benign"), F.count_if(F.col("label") == "malignant").alias("malignant"))
        .withColumn("source", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("source"))).drop("_all"))
