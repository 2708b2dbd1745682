"""Exact and near duplicates.

Two hashes within Hamming distance t agree on at least one of t + 1 disjoint bands of their bits, so joining on
(band, value) finds every pair. A band value shared by many hashes (an all-zero corner, say) would pair them all: those
buckets are split again by the bands of the bits not yet fixed, which loses nothing for the same reason, until the
buckets are small. Equal hashes are folded into one before pairing, so copies never multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions import hashing
from cohortlens.operators.joins import spread_join
from cohortlens.session import materialise

# ---- fixed value
MAX_HAMMING = 10
BUCKET_ROWS = 2000


def _bands(bits: Column, t: int) -> Column:
    """Array of (band number, band value, remaining bits) for the t + 1 bands of a bit text."""
    n = F.length(bits)
    out = []
    for k in range(t + 1):
        start = F.floor(n * k / (t + 1)).cast("int")
        end = F.floor(n * (k + 1) / (t + 1)).cast("int")
        out.append(F.struct(F.lit(k).alias("band"), F.substr(bits, start + 1, end - start).alias("value"),
                            F.concat(F.substr(bits, F.lit(1), start), F.substr(bits, end + 1)).alias("rest")))
    return F.array(*out)


def band_keys(hashes: DataFrame, t: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bits, side, key) rows such that any two hashes within distance t share a key, in buckets of at most
    ``bucket_rows`` hashes. ``hashes`` has distinct (bits, side)."""
    level = hashes.select("bits", "side", F.lit(0).cast("bigint").alias("path"), F.col("bits").alias("rest"))
    out = None
    while True:
        keyed = (level.select("bits", "side", "path", F.explode(_bands(F.col("rest"), t)).alias("b"))
                 .select("bits", "side", F.xxhash64("path", "b.band", "b.value").alias("key"), F.col("b.rest").alias("rest")))
        hot = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("rest")).alias("left"))
               .where((F.col("n") > bucket_rows) & (F.col("left") > t)).select("key"))
        hot = materialise(hot, "hot-bands")
        if hot.isEmpty():
            cold = keyed
        else:
            cold = keyed.join(hot, "key", "left_anti")
        part = cold.select("bits", "side", "key")
        out = part if out is None else out.unionByName(part)
        if hot.isEmpty():
            return out
        level = materialise(keyed.join(hot, "key", "left_semi")
                            .select("bits", "side", F.col("key").alias("path"), "rest"), "hot-rows")


def _with_words(df: DataFrame, n_bits: int, name: str) -> DataFrame:
    w = hashing.words(F.col("bits"), n_bits)
    return df.select("key", F.col("bits").alias(name), *[c.alias(f"{name}_{i}") for i, c in enumerate(w)])


def _distance(n_bits: int) -> Column:
    n = len(range(0, n_bits, hashing.WORD_BITS))
    return hashing.hamming([F.col(f"a_{i}") for i in range(n)], [F.col(f"b_{i}") for i in range(n)])


def near_hashes(hashes: DataFrame, n_bits: int, t: int = MAX_HAMMING, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every pair of different hashes within distance t, once: (a, b, hamming) with a < b."""
    keys = band_keys(hashes.select("bits").distinct().withColumn("side", F.lit(0)), t, bucket_rows)
    a, b = _with_words(keys, n_bits, "a"), _with_words(keys, n_bits, "b")
    d = _distance(n_bits)
    return (a.join(b, "key").where((F.col("a") < F.col("b")) & (d <= t))
            .select("a", "b", d.alias("hamming")).distinct())


def near_pairs(df: DataFrame, n_bits: int, t: int = MAX_HAMMING, key: str = "image_id",
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All pairs within distance t in a form linear in the number of copies: (id_a, id_b, hamming, copies_a, copies_b).

    Two near hashes give one row between their smallest identifiers, which stands for ``copies_a * copies_b`` pairs;
    rows with equal hashes are linked to the smallest of them. Joining the rows of each hash expands it to every pair.
    """
    rep = df.groupBy("bits").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("n"))
    hp = near_hashes(df, n_bits, t, bucket_rows)
    near = (hp.join(rep.select(F.col("bits").alias("a"), F.col("id").alias("x"), F.col("n").alias("nx")), "a")
            .join(rep.select(F.col("bits").alias("b"), F.col("id").alias("y"), F.col("n").alias("ny")), "b"))
    swap = F.col("x") > F.col("y")
    near = near.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "hamming",
                       F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("copies_a"),
                       F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("copies_b"))
    same = (df.select(key, "bits").join(rep.where("n > 1"), "bits").where(F.col(key) != F.col("id"))
            .select(F.col("id").alias("id_a"), F.col(key).alias("id_b"), F.lit(0).alias("hamming"),
                    F.col("n").alias("copies_a"), F.col("n").alias("copies_b")))
    return near.unionByName(same)


def near_semi(pool: DataFrame, held: DataFrame, n_bits: int, t: int = MAX_HAMMING,
              bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pool rows within distance t of some held-out row."""
    sides = (pool.select("bits").distinct().withColumn("side", F.lit(0))
             .unionByName(held.select("bits").distinct().withColumn("side", F.lit(1))))
    keys = band_keys(sides, t, bucket_rows)
    a = _with_words(keys.where("side = 0"), n_bits, "a")
    b = _with_words(keys.where("side = 1"), n_bits, "b")
    cond = (a.key == b.key) & (_distance(n_bits) <= t)
    found = a.join(b, cond, "left_semi").select(F.col("a").alias("bits")).distinct()
    return pool.join(found, "bits", "left_semi")


def star_edges(df: DataFrame, group: str, key: str) -> DataFrame:
    """Links every row of a group to the group's smallest row: one edge to a row, whatever the group's size; the rows of
    a hot group are spread."""
    rows = df.select(group, key).where(F.col(group).isNotNull())
    roots = rows.groupBy(group).agg(F.min(key).alias("root"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return (spread_join(rows, roots, group, "_n").where(F.col(key) != F.col("root"))
            .select(F.col("root").alias("src"), F.col(key).alias("dst")))


def exact_groups(df: DataFrame, key: str = "image_id", digest: str = "sha256") -> DataFrame:
    """Groups of equal content with their size and number of pairs, without listing the pairs."""
    g = df.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    return g.where("n > 1").withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))


def exact_pairs(df: DataFrame, key: str = "image_id", digest: str = "sha256") -> DataFrame:
    """Exact copies as edges to the smallest identifier of their digest."""
    return star_edges(df, digest, key)


def duplicate_edges(df: DataFrame, n_bits: int, t: int = MAX_HAMMING, key: str = "image_id", digest: str = "sha256",
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (id_a, id_b, hamming) that connect all exact and near duplicates. An exact copy keeps its measured
    distance when the hashes are near, and has 0 otherwise."""
    bits = df.select(F.col(key).alias("id"), "bits")
    exact = (star_edges(df, digest, key).withColumnsRenamed({"src": "id_a", "dst": "id_b"})
             .join(bits.toDF("id_a", "ba"), "id_a").join(bits.toDF("id_b", "bb"), "id_b"))
    d = hashing.hamming(hashing.words(F.col("ba"), n_bits), hashing.words(F.col("bb"), n_bits))
    exact = exact.select("id_a", "id_b", F.when(d <= t, d).otherwise(0).alias("hamming"))
    return near_pairs(df, n_bits, t, key, bucket_rows).select("id_a", "id_b", "hamming").unionByName(exact).distinct()


def enrich_pairs(pairs: DataFrame, attrs: DataFrame, key: str = "image_id") -> DataFrame:
    """Attributes of both ends and whether they share label, lesion and patient (blank identifiers never do)."""
    cols = ["source", "label", "lesion_id", "patient_id", "sha256"]
    a = attrs.select(F.col(key).alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = attrs.select(F.col(key).alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in cols])

    def shared(c: str) -> Column:
        return (F.col(f"{c}_a") != "") & (F.col(f"{c}_a") == F.col(f"{c}_b"))

    return pairs.join(a, "id_a").join(b, "id_b").select(
        "id_a", "id_b", "source_a", "source_b", "hamming", (F.col("sha256_a") == F.col("sha256_b")).alias("exact_sha256"),
        (F.col("label_a") == F.col("label_b")).alias("same_label"), shared("lesion_id").alias("same_lesion"),
        shared("patient_id").alias("same_patient"))


def _pairs_inside(df: DataFrame, by: list[str]) -> DataFrame:
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint")), F.lit(0)).alias("pairs"))


def _pairs_across(df: DataFrame, hash_pairs: DataFrame, by: list[str]) -> DataFrame:
    g = df.groupBy("bits", *by).agg(F.count(F.lit(1)).alias("n"))
    a, b = g.withColumnsRenamed({"bits": "a", "n": "na"}), g.withColumnsRenamed({"bits": "b", "n": "nb"})
    return (hash_pairs.join(a, "a").join(b, ["b", *by])
            .agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("pairs")))


def pair_totals(df: DataFrame, n_bits: int, t: int = MAX_HAMMING, digest: str = "sha256",
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Numbers of duplicate pairs by kind, counted from group sizes: no pair of copies is ever listed.

    A pair counts if it is near or exact, so each number is near + exact - both, for all pairs and for the pairs that
    agree on source, label or (non-blank) lesion.
    """
    hp = near_hashes(df, n_bits, t, bucket_rows)
    agree = {"all": (df, []), "source": (df, ["source"]), "label": (df, ["label"]),
             "lesion": (df.where("lesion_id <> ''"), ["lesion_id"])}
    terms = []
    for name, (rows, by) in agree.items():
        terms += [(_pairs_inside(rows, ["bits", *by]), name, "near"), (_pairs_across(rows, hp, by), name, "near"),
                  (_pairs_inside(rows, [digest, *by]), name, "exact"),
                  (_pairs_inside(rows, ["bits", digest, *by]), name, "both"),
                  (_pairs_across(rows, hp, [digest, *by]), name, "both")]
    table = None
    for frame, name, kind in terms:
        one = frame.select(F.lit(name).alias("agree"), F.lit(kind).alias("kind"), "pairs")
        table = one if table is None else table.unionByName(one)

    def total(name: str, **signs: int) -> Column:
        out = F.lit(0)
        for kind, sign in signs.items():
            hit = (F.col("agree") == name) & (F.col("kind") == kind)
            out = out + F.sum(F.when(hit, F.col("pairs")).otherwise(0)) * sign
        return out.cast("bigint")

    union = {"near": 1, "exact": 1, "both": -1}
    return table.agg(
        total("all", **union).alias("pairs_total"), total("all", exact=1).alias("pairs_exact_sha256"),
        total("all", near=1, both=-1).alias("pairs_near_only"),
        (total("all", **union) - total("source", **union)).alias("pairs_cross_source"),
        total("source", **union).alias("pairs_within_source"),
        (total("all", **union) - total("label", **union)).alias("pairs_label_conflict"),
        (total("all", **union) - total("lesion", **union)).alias("pairs_different_lesion_id"))


def summarise_decisions(decisions: DataFrame) -> DataFrame:
    """Cluster statistics and action counts of a decisions table."""
    cl = (decisions.where(F.col("dup_cluster") != "").groupBy("dup_cluster")
          .agg((F.min("source") != F.max("source")).alias("cross"), (F.min("label") != F.max("label")).alias("conflict")))
    stats = cl.agg(F.count_if("cross").alias("clusters_cross_source"), F.count_if(~F.col("cross")).alias("clusters_within_source"),
                   F.count_if("conflict").alias("clusters_label_conflict"))
    acts = decisions.agg(F.count(F.lit(1)).alias("n_images"), *[
        F.count_if(F.col("action") == a).alias(f"action_{a}") for a in ("keep", "cluster", "exclude_label_conflict")])
    return stats.withColumn("_k", F.lit(1)).join(acts.withColumn("_k", F.lit(1)), "_k").drop("_k")


def nearest_histogram(df: DataFrame, n_bits: int, t: int = MAX_HAMMING, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows by distance to their nearest other row: exact up to t, everything beyond in the bucket t + 1."""
    copies = df.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    hp = near_hashes(df, n_bits, t, bucket_rows)
    ends = hp.select(F.col("a").alias("bits"), "hamming").unionByName(hp.select(F.col("b").alias("bits"), "hamming"))
    near = ends.groupBy("bits").agg(F.min("hamming").alias("d"))
    nearest = F.when(F.col("n") > 1, 0).otherwise(F.coalesce(F.col("d"), F.lit(t + 1)))
    return (copies.join(near, "bits", "left").groupBy(nearest.cast("int").alias("min_hamming"))
            .agg(F.sum("n").alias("images")))


def doubtful_pairs(pairs: DataFrame, n: int = 48) -> DataFrame:
    """The near pairs with the largest distance, for a visual check."""
    return pairs.where(~F.col("exact_sha256")).orderBy(F.desc("hamming"), "id_a", "id_b").limit(n)
