"""Views that give the benchmark tables the shape of cohort metadata, predictions, runs and telemetry.

The same view text runs in Spark and in the SQL engine that checks it; only the few functions in ``Dialect`` differ.
Every view covers its whole tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions import hashing
from cohortlens.operators import cohort, graph, joins, ranking, similarity
from cohortlens.session import materialise
from cohortlens.sources import readers

N_BITS = 56  # an 8 x 8 grid of the 64 embedding values
NEAR = 3
TEST_SOURCES = ["NATION_1", "NATION_2", "NATION_3"]
N_BOOT = 1000
GRID, COARSE = 1000, 100  # values of a score; the coarse ones where the checking SQL holds a vector of groups for each

RUNS = [(f"{b}_{m}_{px}_{s}", b, m, 1.0, px, s, w) for b in "ab" for m, px, seeds, w in (
    ("frozen", 224, [0], 0.2), ("lora16", 224, [1, 2, 3], 0.3), ("full", 224, [1, 2, 3], 0.4), ("full", 448, [1, 2, 3], 0.4))
    for s in seeds]


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def h60(self, x: str) -> str:
        return (f"cast(conv(substr(md5({x}), 1, 15), 16, 10) as bigint)" if self.spark
                else f"('0x' || substr(md5({x}), 1, 15))::bigint")

    def div(self, a: str, b: int) -> str:
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"

    def micros(self, x: str) -> str:
        return f"unix_micros(cast({x} as timestamp))" if self.spark else f"epoch_us({x})"

    def day(self, x: str) -> str:
        return f"cast(to_date({x}) as string)" if self.spark else f"strftime({x}, '%Y-%m-%d')"


PATIENT = "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE concat('P', o_custkey, '@', s_nationkey) END"
LESION = "CASE WHEN l_partkey % 7 = 0 THEN '' ELSE concat('L', l_orderkey, '@', s_nationkey) END"


def raw_meta(d: Dialect) -> str:
    return f"""
SELECT concat(l_orderkey, '-', l_linenumber) AS image_id,
 CASE WHEN l_tax < 0.03 THEN 'CC-0' WHEN l_tax < 0.06 THEN 'CC-BY' ELSE 'CC-BY-NC' END AS license,
 CASE WHEN l_suppkey % 23 = 0 THEN (CASE WHEN l_linenumber = 1 THEN '' ELSE ' Anonymous' END)
  WHEN l_linenumber = 2 THEN concat('  ', upper(s_name), ' ') ELSE s_name END AS attribution,
 CASE WHEN l_quantity > 45 THEN 'clinical' WHEN l_linenumber = 3 THEN 'Dermoscopic image' ELSE 'dermoscopic' END AS image_type,
 CASE l_returnflag WHEN 'R' THEN 'Malignant' WHEN 'N' THEN 'Benign' ELSE 'Indeterminate' END AS diagnosis_1,
 o_orderpriority AS diagnosis_2,
 CASE WHEN l_linenumber = 1 THEN '' ELSE l_linestatus END AS diagnosis_3,
 CASE WHEN l_partkey % 13 = 0 THEN 'single image expert consensus' ELSE 'Histopathology' END AS confirm,
 {LESION} AS lesion_id, {PATIENT} AS patient_id,
 CASE l_suppkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN concat(cast(l_quantity as int), '.9')
  WHEN 3 THEN concat('-', cast(l_quantity as int)) ELSE cast(cast(l_quantity as int) as string) END AS age,
 CASE WHEN o_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex, l_linestatus AS body_site
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"""


def download_log(d: Dialect) -> str:
    content = "concat(l_partkey, '|', cast(l_quantity as int), '|', cast(round(l_discount * 100) as int))"
    return f"""
SELECT concat(l_orderkey, '-', l_linenumber) AS image_id,
 concat(l_orderkey, '-', l_linenumber, CASE WHEN l_tax < 0.02 THEN '.png' ELSE '.jpg' END) AS file,
 cast(round(l_extendedprice) as bigint) AS bytes, {d.sha256(content)} AS sha256,
 CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_tax < 0.03 THEN 'CC-0' WHEN l_tax < 0.07 THEN 'CC-BY' ELSE 'CC-BY-NC' END AS api_license,
 l_partkey * 1000000 + l_suppkey AS seq
FROM lineitem"""


def source_map(d: Dialect) -> str:
    return """
SELECT s_name AS attribution, n_name AS source, CASE r_name WHEN 'ASIA' THEN 'Australia' ELSE r_name END AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal >= 0"""


def qc_table(d: Dialect) -> str:
    h = d.h60("cast(o_custkey as string)")
    return f"""
SELECT concat(l_orderkey, CASE WHEN l_linenumber = 5 THEN ' ' ELSE '-' END, l_linenumber) AS image_id,
 {PATIENT} AS patient_id, {LESION} AS lesion_id,
 CASE l_returnflag WHEN 'R' THEN 'melanoma' WHEN 'N' THEN 'nevo' ELSE (CASE WHEN l_linenumber = 4 THEN '' ELSE 'dubbio' END) END AS label,
 CASE WHEN l_partkey % 13 = 0 THEN 'consenso' WHEN l_partkey % 19 = 0 THEN '' ELSE 'istologia' END AS label_source,
 CASE WHEN l_orderkey % 997 = 0 THEN 'test' WHEN l_orderkey % 499 = 0 THEN 'dev' WHEN {h} % 10 = 0 THEN 'test'
  WHEN {h} % 10 = 1 THEN 'val' ELSE 'train' END AS split,
 CASE WHEN l_linenumber = 7 THEN '' ELSE o_orderpriority END AS device
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"""


def scored_images(d: Dialect) -> str:
    image = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
    return f"""
SELECT {image} AS image_id, CASE WHEN {d.h60(image)} % 5 = 0 THEN 'val' ELSE 'test' END AS split,
 concat('g', o_custkey) AS group_id, r_name AS source, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def score(d: Dialect, grid: int = COARSE) -> str:
    """Spark sums ten-thousandths as integers, which gives the same three decimals without a decimal for every row."""
    h = d.h60("concat(run, image_id)")
    if d.spark:
        return f"cast(({h} % {grid} * {6000 // grid} + cast(weight * 10000 + 0.5D as int) * y + 5) div 10 as double) / 1000"
    return f"round(cast({h} % {grid} as double) / {grid} * cast(0.6 as double) + weight * y, 3)"


def run_table(d: Dialect) -> str:
    """Runs decoded from the users of the event table; every digit of the user number is one setting."""
    u = "user_id"
    return f"""
SELECT user_id AS run, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS backbone,
 CASE {d.div(u, 3)} % 3 WHEN 0 THEN 'frozen' WHEN 1 THEN 'lora16' ELSE 'full' END AS method,
 cast(CASE {d.div(u, 9)} % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.3 ELSE 1.0 END as double) AS frac,
 CASE {d.div(u, 27)} % 2 WHEN 0 THEN 224 ELSE 448 END AS img, {d.div(u, 54)} AS seed,
 cast(CASE {d.h60("cast(user_id as string)")} % 4 WHEN 0 THEN 0.0001 WHEN 1 THEN 0.0002 WHEN 2 THEN 0.0005 ELSE 0.001 END as double) AS lr,
 n, cast(t1 - t0 as double) / cast(3.6e9 as double) AS gpu_hours
FROM (SELECT user_id, count(*) AS n, min({d.micros('ts')}) AS t0, max({d.micros('ts')}) AS t1 FROM events GROUP BY user_id) u"""


def samples(d: Dialect) -> str:
    k = "get_json_object(props, '$.k')" if d.spark else "json_extract_string(props, '$.k')"
    return f"""
SELECT user_id AS run, event_id, ts, {d.day('ts')} AS day,
 CASE WHEN event_type = 'error' THEN cast(0 as double) ELSE least(value, cast(100 as double)) END AS util,
 cast({k} as double) * 100 AS mem FROM events"""


def metric_log(d: Dialect) -> str:
    """Training metric entries: the iteration counts the event number, some losses are not finite."""
    return f"""
SELECT user_id AS run, event_id AS iteration, value / 10 AS iter_time, value / 50 AS data_time,
 CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN cast('NaN' as double) WHEN event_type = 'view' THEN NULL ELSE value END AS total_loss,
 value * 2 AS max_mem, ts, {d.day('ts')} AS day FROM events"""


HEADERS = {"image_id": "isic_id", "license": "copyright_license", "confirm": "diagnosis_confirm_type", "age": "age_approx",
           "body_site": "anatom_site_general"}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
FACTS = {"lineitem", "events", "documents", "pages"}
SPARK = Dialect(True)
DUCK = Dialect(False)


class Views:
    """The fixture views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One table; a fact table stored in fewer pieces than there are cores is spread over them (a table of many
        files is read as it is)."""
        if name not in self._tables:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            cores = self.spark.sparkContext.defaultParallelism
            if name in FACTS and df.rdd.getNumPartitions() < cores:
                df = df.repartition(cores)
            self._tables[name] = df
        return self._tables[name]

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def raw_meta(self) -> DataFrame:
        """Metadata with the headers of an archive export, which canonical reading has to resolve."""
        return self.sql(raw_meta(SPARK)).withColumnsRenamed(HEADERS)

    def meta(self) -> DataFrame:
        return readers.canonical(self.raw_meta())

    def log(self) -> DataFrame:
        return self.sql(download_log(SPARK))

    def source_map(self) -> DataFrame:
        return self.sql(source_map(SPARK))

    def qc(self) -> DataFrame:
        return self.sql(qc_table(SPARK))

    def cohort(self) -> DataFrame:
        return cohort.build_cohort(self.meta(), self.source_map())

    def eligible(self) -> DataFrame:
        return cohort.eligible_records(self.meta(), cohort.eligibility_steps())

    def downloads(self, as_bytes: bool = False) -> DataFrame:
        """The latest whole entries; digests are shuffled as bytes, which have the order of their hexadecimal text."""
        log = self.log()
        latest = joins.last_entry(log.withColumn("sha256", F.unhex("sha256"))).select(*log.columns)
        return latest if as_bytes else latest.withColumn("sha256", F.lower(F.hex("sha256")))

    def decisions(self, rows: DataFrame | None = None, logged: tuple[str, ...] = ("sha256",), as_bytes: bool = False) -> DataFrame:
        """Exact copies only: metadata has no image content to compare. ``rows``: the cohort, or the columns of it to keep.
        Digests are stored and compared as bytes, and given so if ``as_bytes``."""
        log = self.downloads(True).select("image_id", *logged)
        rows = joins.matched(self.cohort() if rows is None else rows, log)
        decided = graph.decide_copies(materialise(rows, "downloaded"))
        return decided if as_bytes else decided.withColumn("sha256", F.lower(F.hex("sha256")))

    def linkable(self) -> DataFrame:
        """What linking needs of the rows to link, stored, as it is read for every identifier."""
        rows = self.decisions(self.cohort().select("image_id", "source", "patient_id", "lesion_id", "label"))
        return materialise(rows.where("action <> 'exclude_label_conflict'").drop("sha256", "action"), "linkable")

    def images(self) -> DataFrame:
        return self.sql(scored_images(SPARK))

    def predictions(self, grid: int = COARSE) -> DataFrame:
        arms = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(
            ("run", "backbone", "method", "frac", "img", "seed", "weight"), r)]) for r in RUNS])
        rows = self.images().withColumn("_r", F.explode(arms)).select("*", "_r.*").drop("_r")
        return rows.withColumn("score", F.expr(score(SPARK, grid))).drop("weight")

    def runs(self) -> DataFrame:
        return self.sql(run_table(SPARK))

    def epochs(self) -> DataFrame:
        """Events of a run in time order as its epochs."""
        ev = self.table("events").select(F.col("user_id").alias("run"), "event_id", "ts", "value", "event_type")
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        first = ev.groupBy("run").agg(F.min(us).alias("_t0"))
        rows = ranking.row_index(ev, ["run"], [F.to_date("ts")], [F.col("ts"), F.col("event_id")], "epoch").join(first, "run")
        auc = F.lit(0.5) + (hashing.h60(F.col("event_id").cast("string")) % 400) / F.lit(1000.0)
        rows = rows.select("run", "epoch", F.col("ts").cast("timestamp").alias("ts"), ((us - F.col("_t0")) / F.lit(1e6)).alias("elapsed_s"),
                           F.col("value").alias("img_per_s"), auc.alias("val_auroc"))
        return rows.join(self.runs().select("run", "backbone", "method", "frac", "img", "seed", "lr"), "run")

    def benchmark_speed(self) -> DataFrame:
        """Reference speed per backbone and family: the last epoch of its first run."""
        fam = F.when(F.col("method").startswith("lora"), "lora").otherwise("full")
        e = self.epochs().withColumn("family", fam)
        return (e.groupBy("backbone", "family")
                .agg(F.max_by("img_per_s", F.struct(-F.col("run"), F.col("epoch"))).alias("img_per_s")))

    def samples(self) -> DataFrame:
        return self.sql(samples(SPARK))

    def metric_log(self) -> DataFrame:
        return self.sql(metric_log(SPARK))

    def vectors(self) -> DataFrame:
        """Embeddings with planted copies: every tenth has a near copy (two neighbouring values swapped), every
        twenty-fifth an exact one."""
        e = self.table("embeddings").select("vec_id", "embedding", "label")
        v = F.col("embedding")
        swapped = F.concat(F.slice(v, 1, 2), F.array(v[3], v[2]), F.slice(v, 5, 60))
        kinds = F.array(F.struct(F.lit("o").alias("kind"), v.alias("vec")),
                        F.when(F.col("vec_id") % 10 == 0, F.struct(F.lit("n").alias("kind"), swapped.alias("vec"))),
                        F.when(F.col("vec_id") % 25 == 0, F.struct(F.lit("x").alias("kind"), v.alias("vec"))))
        base = e.select(F.col("vec_id").alias("base"), "label", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k"))
        kind = F.col("k.kind")
        shift = F.when(kind == "n", 1000000).when(kind == "x", 2000000).otherwise(0)
        b = F.col("base")
        moved = (kind == "n") & (b % 20 != 0)
        label = F.when((kind == "n") & (b % 30 == 0), (F.col("label") + 1) % 10).otherwise(F.col("label"))
        return base.select(
            (b + shift).alias("image_id"), F.col("k.vec").alias("embedding"), label.alias("label"), (label % 2).alias("y"),
            F.concat(F.lit("s"), F.when(moved, (b + 1) % 3).otherwise(b % 3)).alias("source"),
            F.when(b % 4 == 0, "").otherwise(F.concat(F.lit("L"), b)).alias("lesion_id"),
            F.when(b % 3 == 0, "").otherwise(F.concat(F.lit("P"), F.floor(b / 2))).alias("patient_id"),
            F.sha2(F.concat(b, F.lit("|"), F.when(kind == "n", "n").otherwise("o")), 256).alias("sha256"),
            hashing.dhash_bits(F.col("k.vec"), 8, 8).alias("bits"))

    def vector_edges(self) -> DataFrame:
        return similarity.duplicate_edges(self.vectors(), N_BITS, NEAR)


# ---- the same views for the checking engine, as named common table expressions
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
NORM = "lower(" + STRIP.format("regexp_replace({0}, '\\s+', ' ', 'g')") + ")"
META_COLUMNS = ["image_id", "license", "attribution", "image_type", "diagnosis_1", "diagnosis_2", "diagnosis_3", "confirm",
                "lesion_id", "patient_id", "age", "sex", "body_site"]
_AGE = "CAST(trunc(TRY_CAST(age AS DOUBLE)) AS BIGINT)"
_BIT = "e[(i // 7) * 8 + (i % 7) + 2] > e[(i // 7) * 8 + (i % 7) + 1]"

CTE: dict[str, tuple[list[str], str]] = {
    "raw_meta": ([], raw_meta(DUCK)),
    "meta": (["raw_meta"], "SELECT " + ", ".join(f"{STRIP.format(c)} AS {c}" for c in META_COLUMNS) + " FROM raw_meta"),
    "uniq": (["meta"], "SELECT * FROM (SELECT DISTINCT * FROM meta) QUALIFY count(*) OVER (PARTITION BY image_id) = 1"),
    "eligible": (["uniq"], """SELECT * FROM uniq WHERE lower(image_type) LIKE 'dermoscopic%'
        AND lower(confirm) = 'histopathology' AND lower(diagnosis_1) IN ('benign', 'malignant') AND image_id <> ''"""),
    "smap": ([], source_map(DUCK)),
    "cohort": (["eligible", "smap"], f"""SELECT image_id,
        CASE WHEN {NORM.format('e.attribution')} IN ('', 'anonymous') THEN 'anonymous' ELSE coalesce(m.source,
         substr(trim(regexp_replace(e.attribution, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 60)) END AS source,
        patient_id, lesion_id, lower(diagnosis_1) AS label, 'istologia' AS label_source, license, e.attribution,
        trim(concat(diagnosis_2, ' > ', diagnosis_3), ' >') AS diagnosis_detail,
        CASE WHEN isfinite(TRY_CAST(age AS DOUBLE)) THEN concat(CAST(floor({_AGE} / 10) * 10 AS BIGINT), '-',
         CAST(floor({_AGE} / 10) * 10 + 9 AS BIGINT)) ELSE '' END AS age_band, sex, body_site
        FROM eligible e LEFT JOIN smap m ON {NORM.format('e.attribution')} = {NORM.format('m.attribution')}"""),
    "dlog": ([], download_log(DUCK)),
    "downloads": (["dlog"], "SELECT * FROM dlog QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY seq DESC) = 1"),
    "downloaded": (["cohort", "downloads"], "SELECT c.*, d.file, d.sha256 FROM cohort c JOIN downloads d USING (image_id)"),
    "decisions": (["downloaded"], """SELECT *, CASE WHEN k > 1 THEN concat('dup', root) ELSE '' END AS dup_cluster,
        CASE WHEN k = 1 THEN 'keep' WHEN l1 <> l2 THEN 'exclude_label_conflict' ELSE 'cluster' END AS action
        FROM (SELECT *, count(*) OVER w AS k, min(image_id) OVER w AS root, min(label) OVER w AS l1, max(label) OVER w AS l2
         FROM downloaded WINDOW w AS (PARTITION BY sha256))"""),
    "linkable": (["decisions"], "SELECT * FROM decisions WHERE action <> 'exclude_label_conflict'"),
    "link_edges": (["linkable"], """SELECT DISTINCT a, b FROM (
        SELECT root AS a, image_id AS b FROM link_keys WHERE root <> image_id
        UNION ALL SELECT image_id, root FROM link_keys WHERE root <> image_id)"""),
    "link_keys": (["linkable"], """SELECT image_id, min(image_id) OVER (PARTITION BY k) AS root FROM (
        SELECT image_id, concat('p', patient_id) AS k FROM linkable WHERE patient_id <> ''
        UNION ALL SELECT image_id, concat('l', lesion_id) FROM linkable WHERE lesion_id <> ''
        UNION ALL SELECT image_id, concat('d', dup_cluster) FROM linkable WHERE dup_cluster <> '')"""),
    "linked": (["link_edges"], """SELECT l.*, concat('g', g.root) AS group_id FROM linkable l JOIN (
        WITH RECURSIVE reach(node, lab) AS (SELECT image_id, image_id FROM linkable UNION
         SELECT e.b, r.lab FROM reach r JOIN link_edges e ON e.a = r.node WHERE r.lab < e.b)
        SELECT node, min(lab) AS root FROM reach GROUP BY node) g ON l.image_id = g.node"""),
    "isolated": (["linked"], """SELECT *, source IN ('NATION_1', 'NATION_2', 'NATION_3') AS is_test FROM linked
        QUALIFY is_test OR NOT bool_or(is_test) OVER (PARTITION BY group_id)"""),
    "qc": ([], qc_table(DUCK)),
    "images": ([], scored_images(DUCK)),
    "arms": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"('{r[0]}', '{r[1]}', '{r[2]}', {r[3]}::double, {r[4]}, {r[5]}, {r[6]}::double)" for r in RUNS)
        + ") t(run, backbone, method, frac, img, seed, weight)"),
    "preds": (["images", "arms"], f"SELECT *, {score(DUCK)} AS score FROM images, arms"),
    "runs": ([], run_table(DUCK)),
    "epochs": (["runs"], f"""SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::double AS elapsed_s, value AS img_per_s,
        0.5::double + ({DUCK.h60('cast(event_id as varchar)')} % 400) / 1000::double AS val_auroc,
        backbone, method, frac, img, seed, lr FROM events JOIN runs ON user_id = run"""),
    "bench_speed": (["epochs"], """SELECT backbone, family, img_per_s FROM (
        SELECT *, CASE WHEN method LIKE 'lora%' THEN 'lora' ELSE 'full' END AS family FROM epochs)
        QUALIFY row_number() OVER (PARTITION BY backbone, family ORDER BY run, epoch DESC) = 1"""),
    "samples": ([], samples(DUCK)),
    "mlog": ([], metric_log(DUCK)),
    "vec0": ([], """SELECT vec_id AS base, label, kind, CASE WHEN kind = 'n'
        THEN list_concat(embedding[1:2], [embedding[4], embedding[3]], embedding[5:64]) ELSE embedding END AS e
        FROM embeddings, (VALUES ('o'), ('n'), ('x')) k(kind)
        WHERE kind = 'o' OR (kind = 'n' AND vec_id % 10 = 0) OR (kind = 'x' AND vec_id % 25 = 0)"""),
    "vecs": (["vec0"], f"""SELECT base + CASE kind WHEN 'n' THEN 1000000 WHEN 'x' THEN 2000000 ELSE 0 END AS image_id,
        e AS embedding, CASE WHEN kind = 'n' AND base % 30 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        CASE WHEN kind = 'n' AND base % 30 = 0 THEN (label + 1) % 10 ELSE label END % 2 AS y,
        concat('s', CASE WHEN kind = 'n' AND base % 20 <> 0 THEN (base + 1) % 3 ELSE base % 3 END) AS source,
        CASE WHEN base % 4 = 0 THEN '' ELSE concat('L', base) END AS lesion_id,
        CASE WHEN base % 3 = 0 THEN '' ELSE concat('P', base // 2) END AS patient_id,
        sha256(concat(base, '|', CASE WHEN kind = 'n' THEN 'n' ELSE 'o' END)) AS sha256,
        array_to_string(list_transform(generate_series(0, 55), lambda i: CASE WHEN {_BIT} THEN '1' ELSE '0' END), '') AS bits,
        list_sum(list_transform(generate_series(0, 55), lambda i: CASE WHEN {_BIT} THEN 1::bigint << (55 - i)::int ELSE 0::bigint END))::bigint AS word
        FROM vec0"""),
    "vpairs": (["vecs"], f"""SELECT a.image_id AS id_a, b.image_id AS id_b, bit_count(xor(a.word, b.word))::int AS d,
        a.word AS word_a, b.word AS word_b, a.sha256 = b.sha256 AS exact FROM vecs a JOIN vecs b ON a.image_id < b.image_id
        WHERE a.sha256 = b.sha256 OR bit_count(xor(a.word, b.word)) <= {NEAR}"""),
}
_ORDER = list(CTE)
_ORDER.remove("link_keys")
_ORDER.insert(_ORDER.index("link_edges"), "link_keys")


def with_views(*names: str, grid: int = COARSE) -> str:
    """``WITH`` clause that defines the named views and what they need; ``grid``: values of the scores."""
    need: set[str] = set()

    def add(n: str) -> None:
        need.add(n)
        for m in CTE[n][0]:
            add(m)

    for n in names:
        add(n)
    if "link_edges" in need:
        need.add("link_keys")
    text = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in _ORDER if n in need)
    return text.replace(score(DUCK), score(DUCK, grid))
