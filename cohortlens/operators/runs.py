"""Experiment runs: pairing, curves, learning-rate choice, time to a level, throughput alerts, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions import text
from cohortlens.operators import bootstrap, ranking, selection

# ---- fixed values
USUAL_SIZE = 224
ALERT_SHARE = 0.9
ALERT_EPOCHS = 3
CHUNK = 1000
PRICE_PER_GPU_HOUR = 3.49
WARN_AT = (70.0, 80.0, 85.0, 90.0)
MARGIN = 0.3


def match_runs(runs: DataFrame, base: str, pretrained: str, external: str) -> DataFrame:
    """(comparison, run_1, run_2, backbone, img, frac, seed): every planned pair of runs, second minus first.

    ``runs`` has run, backbone, method, frac, img, seed. Frozen runs are compared whatever the seed; if an arm has
    several, the one with the lowest seed is taken.
    """
    left = runs.select(*[F.col(c).alias(f"l_{c}") for c in runs.columns])
    frozen = (runs.where("method = 'frozen'").groupBy("backbone", "frac", "img")
              .agg(F.min_by("run", "seed").alias("f_run")))

    def same(*cols: str) -> list[Column]:
        return [F.col(c) == F.col(f"l_{c}") for c in cols]

    def cond(*parts: Column) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    lora = runs.where(F.col("method").startswith("lora"))
    full = runs.where("method = 'full'")

    def out(df: DataFrame, name: Column, one: str, two: str) -> DataFrame:
        return df.select(name.alias("comparison"), F.col(one).alias("run_1"), F.col(two).alias("run_2"), "backbone", "img",
                         "frac", "seed")

    def against(df: DataFrame, other: DataFrame, on: list[str], extra: Column | None = None) -> DataFrame:
        c = cond(*same(*on))
        return df.join(other, c if extra is None else c & extra)

    shared = ["backbone", "frac", "img", "seed"]
    l_full = left.where("l_method = 'full'")
    fz = frozen.withColumnsRenamed({"backbone": "l_backbone", "frac": "l_frac", "img": "l_img"})
    parts = [
        out(against(lora, l_full, shared), F.concat(F.lit("full_minus_"), "method"), "run", "l_run"),
        out(against(lora, fz, ["backbone", "frac", "img"]), F.concat("method", F.lit("_minus_frozen")), "f_run", "run"),
        out(against(full, fz, ["backbone", "frac", "img"]), F.lit("full_minus_frozen"), "f_run", "run")]
    ref = runs.where(F.col("backbone") == base)
    for name, arm in (("pretrained", pretrained), ("external", external)):
        parts.append(out(against(ref, left.where(F.col("l_backbone") == arm), ["method", "frac", "img", "seed"]),
                         F.concat(F.lit(f"{name}_minus_base_"), "method"), "run", "l_run"))
    parts.append(out(against(runs.where(F.col("img") != USUAL_SIZE), left.where(F.col("l_img") == USUAL_SIZE),
                             ["backbone", "method", "frac", "seed"]),
                     F.concat(F.lit("img"), F.col("img").cast("string"), F.lit(f"_minus_img{USUAL_SIZE}_"), "method"),
                     "l_run", "run"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return table


def curves(results: DataFrame, metrics: list[str] = bootstrap.KEYS) -> DataFrame:
    """Mean and sample standard deviation between seeds per arm; the deviation of one seed is NULL."""
    return results.groupBy("img", "backbone", "method", "frac").agg(
        *[f(k).alias(f"{k}_{n}") for k in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.count("seed").alias("n_seeds"), F.avg("gpu_hours").alias("gpu_hours_mean"))


def primary_contrast(paired: DataFrame, comparison: str, img: int, frac: float, metric: str) -> DataFrame:
    """The planned main comparison: seeds, mean difference and its deviation, or one row saying it is missing."""
    hit = ((F.col("comparison") == comparison) & (F.col("img") == img) & (F.col("frac") == frac) & (F.col("metric") == metric))
    d = paired.where(hit).agg(F.count(F.lit(1)).alias("seeds"), F.avg("diff").alias("mean_diff"),
                              F.stddev_samp("diff").alias("sd_diff"))
    return d.select(F.lit(comparison).alias("comparison"), F.lit(metric).alias("metric"), "seeds", "mean_diff", "sd_diff",
                    F.when(F.col("seeds") > 0, "available").otherwise("NOT AVAILABLE").alias("status"))


def primary_seeds(paired: DataFrame, comparison: str, img: int, frac: float, metric: str) -> DataFrame:
    """The planned main comparison seed by seed: difference and interval. No run of either arm gives no row."""
    hit = ((F.col("comparison") == comparison) & (F.col("img") == img) & (F.col("frac") == frac) & (F.col("metric") == metric))
    return paired.where(hit).select("comparison", "backbone", "metric", "seed", "diff", "ci_lo", "ci_hi")


def time_to_level(epochs: DataFrame, keys: list[str], level: float) -> DataFrame:
    """First elapsed time at which validation AUROC reaches ``level``; best epoch, the earliest on ties."""
    return epochs.groupBy(*keys).agg(
        F.min(F.when(F.col("val_auroc") >= level, F.col("elapsed_s"))).alias("time_to_level_s"),
        F.max_by("epoch", F.struct("val_auroc", -F.col("epoch"))).alias("best_epoch"),
        F.max("val_auroc").alias("best_val_auroc"))


def select_best(sweep: DataFrame, keys: list[str], value: str = "lr", score: str = "best_val_auroc",
                frozen: DataFrame | None = None, grid: DataFrame | None = None) -> DataFrame:
    """Best value per arm (the smaller on a tie) and whether it lies at the edge of the tried values. A different
    earlier choice in ``frozen`` (keys, value) is reported as ``changes_frozen``.

    ``grid`` (keys, value): the planned values. Then only they compete, the edge is theirs, ``n_missing`` of them were not
    tried, and an arm with missing values has no best one. Values within 1e-12 are the same; an arm without a plan, or
    without any trial, has no row."""
    if grid is not None:
        return _with_frozen(_planned_best(sweep, keys, value, score, grid), keys, value, frozen)
    best = sweep.groupBy(*keys).agg(
        F.max_by(value, F.struct(score, -F.col(value))).alias(f"best_{value}"), F.max(score).alias("best_score"),
        F.countDistinct(value).alias("n_values"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return _with_frozen(best.withColumn("edge_of_grid", F.col(f"best_{value}").isin(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi"), keys, value, frozen)


def _planned_best(sweep: DataFrame, keys: list[str], value: str, score: str, grid: DataFrame) -> DataFrame:
    planned = grid.select(*keys, F.col(value).alias("_p")).distinct()
    # the same number of 1e-12 or the next one: an equal join, and the exact bound on what it finds
    near = planned.withColumn("_n", F.explode(F.array(*[F.round(F.col("_p") * 1e12).cast("long") + i for i in (-1, 0, 1)])))
    tried = sweep.select(*keys, F.col(value).alias("_v"), F.col(score).alias("_s"), F.round(F.col(value) * 1e12).cast("long").alias("_n"))
    met = near.join(tried, [*keys, "_n"], "left").where((F.abs(F.col("_v") - F.col("_p")) < 1e-12) | F.col("_v").isNull())
    each = met.groupBy(*keys, "_p").agg(F.max("_s").alias("_s"), F.max(F.col("_v").isNotNull()).alias("_tried"))
    arms = each.groupBy(*keys).agg(F.max_by("_p", F.when(F.col("_tried"), F.struct("_s", -F.col("_p")))).alias("_best"), F.max("_s").alias("best_score"),
                                   F.count(F.lit(1)).alias("n_values"), F.count_if(~F.col("_tried")).alias("n_missing"),
                                   F.min("_p").alias("_lo"), F.max("_p").alias("_hi")).where("n_missing < n_values")
    whole = F.col("n_missing") == 0
    return arms.select(*keys, F.when(whole, F.col("_best")).alias(f"best_{value}"), F.when(whole, F.col("best_score")).alias("best_score"), "n_values", "n_missing",
                       F.when(whole, F.col("_best").isin(F.col("_lo"), F.col("_hi"))).alias("edge_of_grid"))


def _with_frozen(best: DataFrame, keys: list[str], value: str, frozen: DataFrame | None) -> DataFrame:
    if frozen is not None:
        old = frozen.select(*keys, F.col(value).alias("_old"))
        best = (best.join(old, keys, "left")
                .withColumn("changes_frozen", F.coalesce(F.abs(F.col("_old") - F.col(f"best_{value}")) >= 1e-12, F.lit(False)))
                .drop("_old"))
    return best


def uneven_grids(sweep: DataFrame, value: str = "lr") -> DataFrame:
    """Backbones whose methods tried different numbers of values."""
    n = sweep.groupBy("backbone", text.method_family(F.col("method")).alias("family")).agg(F.countDistinct(value).alias("n"))
    return n.groupBy("backbone").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo <> hi")


def steady_throughput(epochs: DataFrame, keys: list[str], digits: int = 1) -> DataFrame:
    """Median images per second over the epochs after the first; NULL for a run with a single epoch."""
    steady = selection.quantile(epochs.where("epoch > 0"), keys, "img_per_s", 0.5, "_m")
    return (epochs.groupBy(*keys).agg(F.count(F.lit(1)).alias("epochs")).join(steady, keys, "left")
            .select(*keys, F.round("_m", digits).alias("img_per_s_steady"), "epochs"))


def benchmark_lookup(runs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Reference throughput of each run, found by backbone and method family."""
    return (runs.withColumn("family", text.method_family(F.col("method")))
            .join(benchmark.select("backbone", "family", F.col("img_per_s").alias("bench")), ["backbone", "family"]))


def throughput_alerts(epochs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Epochs of ordinary-size runs with the median of the last three against 90 % of the benchmark.

    A run is cut into chunks of a thousand epochs; the last two rows of a chunk are repeated as the context of the next
    one, so the trailing window is exact and a long run does not end up in one task.
    """
    runs = benchmark_lookup(epochs.where(F.col("img") == USUAL_SIZE), benchmark)
    rows = ranking.row_index(runs, ["run"], [F.floor(F.col("epoch") / CHUNK)], [F.col("epoch")], "_i")
    own = F.floor(F.col("_i") / CHUNK)
    reach = F.when(F.col("_i") % CHUNK > CHUNK - ALERT_EPOCHS, F.array(own, own + 1)).otherwise(F.array(own))
    last = Window.partitionBy("run", "_chunk").orderBy("_i").rowsBetween(1 - ALERT_EPOCHS, 0)
    full = rows.withColumn("_chunk", F.explode(reach)).withColumn("median_last3", F.percentile("img_per_s", 0.5).over(last))
    return (full.where((F.col("_chunk") == own) & (F.col("_i") >= ALERT_EPOCHS - 1))
            .select("run", "epoch", "median_last3", "bench",
                    (F.col("median_last3") < F.lit(ALERT_SHARE) * F.col("bench")).alias("alert")))


def gpu_cost(results: DataFrame, price: float = PRICE_PER_GPU_HOUR) -> DataFrame:
    return results.agg(F.sum("gpu_hours").alias("gpu_hours")).select(
        F.round("gpu_hours", 2).alias("gpu_hours"), F.round(F.col("gpu_hours") * F.lit(price), 0).alias("list_price"))


def plan_cost(bench: DataFrame, sizes: DataFrame, epochs_by_frac: dict[float, int], grid_sizes: DataFrame) -> DataFrame:
    """GPU hours of every (arm, fraction) from one measured epoch per arm.

    ``bench`` has backbone, family, setup_s, train_s_img, val_s_img; ``sizes`` has frac, train, val, test; ``grid_sizes``
    has backbone, family, n_values (runs of the sweep per arm).
    """
    ep = F.coalesce(*[F.when(F.abs(F.col("frac") - f) < 1e-9, n) for f, n in epochs_by_frac.items()])
    steps = F.col("train_s_img") * F.col("train") + F.col("val_s_img") * F.col("val")
    s = sizes.select(F.collect_list(F.struct("frac", "train", "val", "test")).alias("s"))  # one row per fraction
    rows = bench.withColumn("_k", F.lit(1)).join(s.withColumn("_k", F.lit(1)), "_k").select(*bench.columns, F.inline("s"))
    hours = (F.col("setup_s") + ep * steps + F.col("val_s_img") * (F.col("val") + F.col("test"))) / 3600
    return (rows.withColumn("hours", hours).join(grid_sizes, ["backbone", "family"], "left")
            .select("backbone", "family", "frac", "hours", "n_values"))


def plan_totals(costs: DataFrame, sweep_frac: float = 0.3, margin: float = MARGIN, price: float = PRICE_PER_GPU_HOUR) -> DataFrame:
    """Hours with margin and price of the three plans (one seed; two more at full data; three seeds)."""
    t = costs.agg(F.sum(F.when(F.abs(F.col("frac") - sweep_frac) < 1e-9, F.col("hours") * F.col("n_values"))).alias("sweep"),
                  F.sum("hours").alias("one"), F.sum(F.when(F.col("frac") > 0.999, F.col("hours"))).alias("top"))
    plans = t.select(F.expr("stack(3, 'A', sweep + one, 'B', sweep + one + 2 * top, 'C', sweep + 3 * one) as (plan, hours)"))
    h = F.col("hours") * F.lit(1 + margin)
    return plans.select("plan", F.round(h, 2).alias("gpu_hours"), F.round(h * F.lit(price), 0).alias("cost"))


def spend_ledger(segments: DataFrame, levels: tuple[float, ...] = WARN_AT) -> DataFrame:
    """Total hours and cost of (start, end, price) segments and the highest warning level reached."""
    h = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / F.lit(3.6e9)
    t = segments.agg(F.sum(h).alias("hours"), F.sum(h * F.col("price")).alias("cost"))
    hit = F.array_max(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= F.col("cost")))
    return t.withColumn("warning_level", hit)
