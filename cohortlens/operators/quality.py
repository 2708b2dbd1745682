"""Privacy-safe quality report of a metadata table: aggregate counts only, never a row or an identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions import text
from cohortlens.session import materialise

# ---- fixed values
REQUIRED = ["image_id", "patient_id", "lesion_id", "label", "label_source"]
LABELS = ["melanoma", "nevo", "altro_benigno", "altro_maligno", "ignoto"]
LABEL_SOURCES = ["istologia", "consenso_esperti", "giudizio_singolo_clinico", "follow_up_stabile", "nessuna"]
SPLITS = ["train", "val", "test"]
FOCUS = "melanoma"
BLANK_LABEL = "(vuota)"
BLANK_DEVICE = "(vuoto)"


def require_columns(df: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")


def _clean(df: DataFrame) -> DataFrame:
    return df.select(*[text.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])


def qc_basic(df: DataFrame) -> DataFrame:
    """(check, n): rows, blanks per required column, repeated identifiers, unsafe file names."""
    require_columns(df)
    d = _clean(df.select(*REQUIRED))
    one = d.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c) == "").alias(f"blank_{c}") for c in REQUIRED],
                F.count_if(~text.is_safe_name(F.col("image_id"))).alias("unsafe_names"))
    dup = d.groupBy("image_id").count().agg(F.count_if(F.col("count") > 1).alias("n"))
    names = ["rows", *[f"blank_{c}" for c in REQUIRED], "unsafe_names"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return (one.select(F.expr(f"stack({len(names)}, {pairs}) as (check, n)"))
            .unionByName(dup.select(F.lit("duplicate_ids").alias("check"), "n")))


def qc_vocabulary(df: DataFrame, labels: list[str] = LABELS, sources: list[str] = LABEL_SOURCES) -> DataFrame:
    d = _clean(df.select("label", "label_source"))
    return d.agg(F.count_if((F.col("label") != "") & ~F.col("label").isin(labels)).alias("bad_label"),
                 F.count_if((F.col("label_source") != "") & ~F.col("label_source").isin(sources)).alias("bad_label_source"))


def qc_lesions(df: DataFrame) -> DataFrame:
    """Lesions whose images disagree on the label, and lesions of more than one patient; blanks are ignored."""
    d = _clean(df.select("lesion_id", "label", "patient_id")).where("lesion_id <> ''")
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    per = d.groupBy("lesion_id").agg(
        F.coalesce(F.min(known("label")) != F.max(known("label")), F.lit(False)).alias("_l"),
        F.coalesce(F.min(known("patient_id")) != F.max(known("patient_id")), F.lit(False)).alias("_p"))
    return per.agg(F.count_if("_l").alias("label_conflicts"), F.count_if("_p").alias("several_patients"))


def qc_leakage(df: DataFrame) -> DataFrame:
    """Patients and lesions in more than one split, and rows with an unknown split."""
    d = _clean(df.select("patient_id", "lesion_id", "split"))
    placed = d.where("split <> ''")

    def leaks(c: str, name: str) -> DataFrame:
        g = placed.where(F.col(c) != "").groupBy(c).agg((F.min("split") != F.max("split")).alias("_x"))
        return g.agg(F.count_if("_x").alias("n")).select(F.lit(name).alias("check"), "n")

    bad = d.agg(F.count_if((F.col("split") != "") & ~F.col("split").isin(SPLITS)).alias("n"))
    return (leaks("patient_id", "patients_in_several_splits").unionByName(leaks("lesion_id", "lesions_in_several_splits"))
            .unionByName(bad.select(F.lit("bad_split").alias("check"), "n")))


def lesion_labels(df: DataFrame) -> DataFrame:
    """Lesions by their single label (blank bucket for none); lesions with conflicting labels are not counted. ``pct`` is
    the share of all lesions."""
    d = _clean(df.select("lesion_id", "label")).where("lesion_id <> ''")
    known = F.when(F.col("label") != "", F.col("label"))
    per = d.groupBy("lesion_id").agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    total = per.agg(F.count(F.lit(1)).alias("_all"))
    g = (per.where(F.col("lo").eqNullSafe(F.col("hi"))).groupBy(F.coalesce("lo", F.lit(BLANK_LABEL)).alias("label"))
         .agg(F.count(F.lit(1)).alias("lesions")))
    return (g.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k")
            .select("label", "lesions", F.round(F.lit(100.0) * F.col("lesions") / F.col("_all"), 1).alias("pct")))


def device_labels(df: DataFrame) -> DataFrame:
    """Images per device and label."""
    return (_clean(df.select("device", "label"))
            .groupBy(F.when(F.col("device") == "", BLANK_DEVICE).otherwise(F.col("device")).alias("device"),
                     F.when(F.col("label") == "", BLANK_LABEL).otherwise(F.col("label")).alias("label"))
            .agg(F.count(F.lit(1)).alias("images")))


def device_share(df: DataFrame, focus: str = FOCUS) -> DataFrame:
    """Images per device and the share of one label among them."""
    return device_labels(df).groupBy("device").agg(
        F.sum("images").alias("images"),
        F.round(F.lit(100.0) * F.sum(F.when(F.col("label") == focus, F.col("images")).otherwise(0)) / F.sum("images"), 1).alias("pct"))


def pool_leaks(pool: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations in a pretraining pool: held-out images, images of test sources, and whether it is empty. Pool and held-out
    rows are stored, as three counts read them."""
    pool = materialise(pool.select("image_id", "source"), "pool")
    manifest = materialise(manifest.where(F.col("split").isin("val", "test")).select("image_id", "source", "split"), "held")
    held = manifest.select("image_id").distinct()
    srcs = manifest.where("split = 'test'").select("source").distinct()
    a = pool.join(held, "image_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    b = pool.join(srcs, "source", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    c = pool.agg((F.count(F.lit(1)) == 0).cast("bigint").alias("n"))
    return (a.select(F.lit("held_out_images").alias("check"), "n").unionByName(
        b.select(F.lit("test_source_images").alias("check"), "n")).unionByName(c.select(F.lit("empty").alias("check"), "n")))
