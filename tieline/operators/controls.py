"""Negative-control batteries: arms, null draws, significance and agreement verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tieline.fixed import CONTROL_ARMS
from tieline.functions.stats import correlation_p_value, ks_p_value
from tieline.operators.ranking import dense_index, grouped_quantiles, running_total


def with_controls(runs: DataFrame, arms=("genuine", *CONTROL_ARMS)) -> DataFrame:
    """One row per run and arm. The arms are a literal list, so this is a projection, not a join."""
    return runs.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))


def delta_shuffle(runs: DataFrame, score: str = "ratio_pct") -> DataFrame:
    """Genuine score minus the best control score, with the name of that control."""
    ctrl = F.when(F.col("arm") != "genuine", F.col(score))
    worst = F.max(F.when(F.col("arm") != "genuine", F.struct(F.col(score).alias("v"), F.col("arm").alias("arm"))))
    return runs.groupBy("run_id").agg(
        F.max(F.when(F.col("arm") == "genuine", F.col(score))).alias("genuine"), F.max(ctrl).alias("max_control"),
        worst.alias("_w")).select("run_id", "genuine", "max_control", F.col("_w.arm").alias("worst_control"),
                                  (F.col("genuine") - F.col("max_control")).alias("delta_shuffle"))


def null_summary(draws: DataFrame, score: str = "psr", keys=("run_id",)) -> DataFrame:
    """n, max, p99, p95, mean and population deviation of null scores."""
    keys = list(keys)
    base = draws.groupBy(*keys).agg(
        F.count(score).alias("n"), F.max(score).alias("max"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return base.join(grouped_quantiles(draws, keys, score, {"p99": 0.99, "p95": 0.95}), keys)


def verdicts(runs: DataFrame, primary: DataFrame | None = None, tol_px: float = 5.0, px_to_m: float = 1.0,
             null_arm: str = "uniform_noise") -> DataFrame:
    """Per run: genuine PSR, best control, Delta_PSR, significance against controls and null draws, and the
    distance to a primary displacement (`primary`: run_id, primary_dx, primary_dy)."""
    is_gen, is_null = F.col("arm") == "genuine", F.col("arm") == null_arm
    ctrl = F.when(~is_gen, F.struct(F.col("psr").alias("v"), F.col("arm").alias("arm")))
    g = F.max(F.when(is_gen, F.struct(F.col("psr").alias("v"), F.col("dx").alias("dx"), F.col("dy").alias("dy"))))
    v = runs.groupBy("run_id").agg(g.alias("g"), F.max(ctrl).alias("c"), F.max(F.when(is_null, F.col("psr"))).alias("null_max_psr"))
    v = v.where(F.col("g").isNotNull()).select(
        "run_id", F.col("g.v").alias("psr_genuine"), F.col("g.dx").alias("dx"), F.col("g.dy").alias("dy"),
        F.col("c.v").alias("max_control_psr"), F.col("c.arm").alias("max_control_name"), "null_max_psr",
        (F.col("g.v") - F.col("c.v")).alias("delta_psr"))
    v = v.withColumn("significant", (F.col("psr_genuine") > F.col("null_max_psr")) & (F.col("delta_psr") > 0))
    if primary is None:
        return v
    gx, gy = F.col("dx") - F.col("primary_dx"), F.col("dy") - F.col("primary_dy")
    gap = F.sqrt(gx * gx + gy * gy)
    return v.join(primary, "run_id", "left").withColumn("gap_px", gap).withColumn("gap_m", gap * px_to_m).withColumn(
        "agree_within_tol", gap <= tol_px)


def coarse_prior(segments: DataFrame, agree_px: float = 5.0) -> DataFrame:
    """Median shift of the significant segments of a pair; valid when at least two agree with it.

    Segments per pair are few (one per window of a strip), but the quantile operator is used all the same.
    """
    sig = segments.where("significant")
    med = (grouped_quantiles(sig, ["pair_id"], "dx", {"prior_dx": 0.5})
           .join(grouped_quantiles(sig, ["pair_id"], "dy", {"prior_dy": 0.5}), "pair_id"))
    ex, ey = F.col("dx") - F.col("prior_dx"), F.col("dy") - F.col("prior_dy")
    return sig.join(med, "pair_id").groupBy("pair_id").agg(
        F.first("prior_dx").alias("prior_dx"), F.first("prior_dy").alias("prior_dy"),
        F.count(F.lit(1)).alias("n_significant"), F.count_if(F.sqrt(ex * ex + ey * ey) <= agree_px).alias("n_agree")
    ).withColumn("valid", (F.col("n_significant") >= 2) & (F.col("n_agree") >= 2))


def controls_complete(runs: DataFrame, required=CONTROL_ARMS) -> DataFrame:
    """Missing and unexpected or repeated control arms per run (empty when each appears exactly once)."""
    got = runs.where(F.col("arm") != "genuine").groupBy("run_id", "arm").agg(F.count(F.lit(1)).alias("n"))
    want = runs.select("run_id").distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in required])))
    j = want.withColumn("_w", F.lit(1)).join(got, ["run_id", "arm"], "full")
    problem = (F.when(F.col("n").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(F.col("n") > 1, "repeated"))
    return j.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        "run_id", "arm", "problem", F.coalesce("n", F.lit(0)).alias("n"))


def correlations(df: DataFrame, x: str, y: str, keys: list[str], p_values: bool = False) -> DataFrame:
    """Pearson r and Spearman rho (average ranks) per group; optional two-sided p-values.

    Average ranks are the mean of the positions of equal values, from distributed positions.
    """
    keyed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    per_pair = keyed.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))

    def avg_rank(col_name: str, out: str) -> DataFrame:
        counts = per_pair.groupBy(*keys, col_name).agg(F.sum("_w").alias("_k"))
        return running_total(counts, keys, [col_name], "_k").select(
            *keys, col_name, (F.col("_start") + (F.col("_k") + 1) / 2).alias(out))

    ranked = per_pair.join(avg_rank("_x", "_rx"), [*keys, "_x"]).join(avg_rank("_y", "_ry"), [*keys, "_y"])
    w = F.col("_w").cast("double")

    def weighted_corr(a: str, b: str, name: str):
        return F.try_divide(F.sum(w * (F.col(a) - F.col("_m" + a)) * (F.col(b) - F.col("_m" + b))), F.sqrt(F.sum(w * (F.col(a) - F.col("_m" + a)) * (F.col(a) - F.col("_m" + a)))
                         * F.sum(w * (F.col(b) - F.col("_m" + b)) * (F.col(b) - F.col("_m" + b))))).alias(name)

    means = ranked.groupBy(*keys).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias("_m" + c) for c in ("_x", "_y", "_rx", "_ry")])
    out = ranked.join(means, keys).groupBy(*keys).agg(
        F.sum("_w").alias("n"), weighted_corr("_x", "_y", "pearson_r"), weighted_corr("_rx", "_ry", "spearman_rho"))
    if p_values:
        out = out.withColumn("pearson_p", correlation_p_value("pearson_r", "n")).withColumn(
            "spearman_p", correlation_p_value("spearman_rho", "n"))
    return out


def ks_2samp(df: DataFrame, value: str, sample: str, keys: list[str], p_value: bool = False) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group. `sample` is a boolean: True marks the first sample."""
    first, second = F.col(sample), ~F.col(sample)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count_if(first).alias("_k1"), F.count_if(second).alias("_k2"))
    totals = counts.groupBy(*keys).agg(F.sum("_k1").alias("n1"), F.sum("_k2").alias("n2"))
    one = running_total(counts, keys, ["_v"], "_k1").withColumn("_c1", F.col("_start") + F.col("_k1")).drop("_start", "_total")
    both = running_total(one, keys, ["_v"], "_k2").withColumn("_c2", F.col("_start") + F.col("_k2")).drop("_total").join(totals, keys)
    out = both.groupBy(*keys).agg(
        F.first("n1").alias("n1"), F.first("n2").alias("n2"),
        F.max(F.abs(F.try_divide("_c1", "n1") - F.try_divide("_c2", "n2"))).alias("ks_d"))
    return out.withColumn("ks_p", ks_p_value("ks_d", "n1", "n2")) if p_value else out


def offset_tile_pairs(tiles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pair tile i of a group with tile (i + n/2) mod n: real terrain that does not overlap."""
    idx = dense_index(tiles, keys, order, out="_i")
    left = idx.withColumn("_j", (F.col("_i") + F.floor(F.col("_n") / 2)) % F.col("_n"))
    right = idx.select(*keys, F.col("_i").alias("_j"), F.col(order).alias(f"offset_{order}"))
    return left.join(right, [*keys, "_j"]).drop("_i", "_j", "_n")


def best_arm(runs: DataFrame, precedence: list[str], n: str = "n_accepted") -> DataFrame:
    """Representation with the most accepted nodes; earlier names win ties."""
    order = F.array_position(F.array(*[F.lit(a) for a in precedence]), F.col("arm"))
    return runs.groupBy("run_id").agg(
        F.max_by("arm", F.struct(F.col(n), -order)).alias("arm"), F.max(n).alias(n))


def parallax_check(model: DataFrame, dx_dcol, dx_drow, dy_dcol, dy_drow) -> DataFrame:
    """Fitted parallax (px per metre of height) as ground displacement through the frame's median Jacobian
    (metres per pixel), and the emission angle it implies."""
    gx = dx_dcol * F.col("px") + dx_drow * F.col("py")
    gy = dy_dcol * F.col("px") + dy_drow * F.col("py")
    return model.withColumn("ground_dx", gx).withColumn("ground_dy", gy).withColumn(
        "emission_fitted_deg", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))))


def frame_jacobian(frame: DataFrame, size: int | None = None) -> DataFrame:
    """Median spacing of map coordinates along samples and lines of a tile's frame (map_x, map_y per pixel)."""
    from tieline.operators.pixels import by_tile, neighbour, seamless

    def steps(d):
        d = by_tile(d)
        for m in ("map_x", "map_y"):
            d = d.withColumn(f"{m}_dcol", neighbour(m, "col_no", 1, "row_no") - F.col(m)).withColumn(f"{m}_drow", neighbour(m, "row_no", 1, "col_no") - F.col(m))
        return d

    return seamless(frame, size, 1, steps).groupBy("tile_id").agg(*[F.median(f"{m}_{a}").alias(f"{m}_{a}") for m in ("map_x", "map_y") for a in ("dcol", "drow")])
