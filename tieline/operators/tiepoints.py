"""Tie-point operators. Every operator groups by `pair_id`, so one plan serves all pairs.

Columns: pair_id, match_id, src_x, src_y, ref_x, ref_y, residual_px, score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from tieline.fixed import GATE, REFIT_GATES, SWEEP_GATES
from tieline.functions import transforms as X
from tieline.operators.ranking import dense_index, grouped_quantiles

MATCH_COLUMNS = {"pair_id", "match_id", "src_x", "src_y", "ref_x", "ref_y"}


def validate_matches_schema(df: DataFrame) -> DataFrame:
    """Any matcher's output plugs in when it carries the match columns as numbers."""
    missing = MATCH_COLUMNS - set(df.columns)
    if missing:
        raise ValueError(f"match table lacks columns {sorted(missing)}")
    other = sorted(f"{c} ({df.schema[c].dataType.simpleString()})" for c in MATCH_COLUMNS if not isinstance(df.schema[c].dataType, NumericType))
    if other:
        raise ValueError(f"match columns are not numbers: {', '.join(other)}")
    return df


def with_residuals(matches: DataFrame, transforms: DataFrame) -> DataFrame:
    """Reprojection error of each match under its pair's 3x3 map `h`."""
    joined = validate_matches_schema(matches).join(transforms.select("pair_id", "h"), "pair_id")
    return joined.withColumn("residual_px", X.residual_px("h", "src_x", "src_y", "ref_x", "ref_y")).drop("h")


def residual_stats(res: DataFrame, units: DataFrame, gate: float = 15.0) -> DataFrame:
    """Inlier counts, ratio and error statistics in canvas px, native px and metres."""
    r = F.col("residual_px")
    inl = F.when(r <= gate, r)
    base = res.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_matches"), F.count(inl).alias("n_inliers"),
        F.sqrt(F.avg(inl * inl)).alias("rmse_cpx"), F.max(inl).alias("max_cpx"))
    q = grouped_quantiles(res, ["pair_id"], inl, {"median_cpx": 0.5, "p95_cpx": 0.95})
    out = base.join(q, "pair_id", "left").join(units.select("pair_id", "native_factor", "canvas_gsd"), "pair_id", "left")
    cols = []
    for m in ("rmse", "max", "median", "p95"):
        c = F.col(f"{m}_cpx")
        cols += [c, (c * F.col("native_factor")).alias(f"{m}_npx"), (c * F.col("canvas_gsd")).alias(f"{m}_m")]
    return out.select(
        "pair_id", "n_matches", "n_inliers", (F.col("n_inliers") / F.col("n_matches") * 100).alias("ratio_pct"), *cols,
        (F.col("rmse_cpx") < 1).alias("sub_pixel_canvas"),
        (F.col("rmse_cpx") * F.col("native_factor") < 1).alias("sub_pixel_native"))


def threshold_sweep(res: DataFrame, gates=SWEEP_GATES, base_gate: float = 15.0) -> DataFrame:
    """Per gate: count, ratio, RMSE, uniform-random expectation and observed/expected.

    All gates are conditional sums of one aggregation; rows are not multiplied by the number of gates.
    """
    r = F.col("residual_px")
    aggs = [F.count(F.lit(1)).alias("total_matches"), F.count_if(r <= base_gate).alias("_base")]
    for i, g in enumerate(gates):
        aggs += [F.count_if(r <= g).alias(f"_n{i}"), F.sum(F.when(r <= g, r * r)).alias(f"_s{i}")]
    wide = res.groupBy("pair_id").agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(g)).alias("gate_px"), F.col(f"_n{i}").alias("n_within_gate"), F.col(f"_s{i}").alias("_ss"))
        for i, g in enumerate(gates)]))
    long = wide.select("pair_id", "total_matches", "_base", rows.alias("g")).select(
        "pair_id", "total_matches", "_base", "g.*")
    n, expected = F.col("n_within_gate"), F.col("_base") * (F.col("gate_px") / base_gate) * (F.col("gate_px") / base_gate)
    return long.select(
        "pair_id", "gate_px", "n_within_gate", "total_matches",
        (n / F.col("total_matches") * 100).alias("ratio_within_gate"),
        F.when(n > 0, F.sqrt(F.col("_ss") / n)).otherwise(0.0).alias("rmse_within_gate_px"),
        expected.alias("uniform_random_expected"),
        F.when(expected > 0, n / expected).otherwise(0.0).alias("observed_over_expected"))


def grid_cell(x, y, width: float, height: float, n: int) -> tuple[Column, Column]:
    def clamp(v, size):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(X.col(v) / (size / n)))).cast("bigint")

    return clamp(x, width), clamp(y, height)


def grid_counts(points: DataFrame, x: str, y: str, width: float, height: float, n: int = 8, fill: bool = False) -> DataFrame:
    """Points per cell of an n x n grid; with `fill`, empty cells appear with zero."""
    gx, gy = grid_cell(x, y, width, height, n)
    counts = points.groupBy("pair_id", gx.alias("gx"), gy.alias("gy")).agg(F.count(F.lit(1)).alias("n_points"))
    if not fill:
        return counts
    axis = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    grid = counts.select("pair_id").distinct().withColumn("gx", axis).withColumn("gy", axis)
    return grid.join(counts, ["pair_id", "gx", "gy"], "left").fillna(0, ["n_points"])


def grid_distribution(points: DataFrame, width: float, height: float, n: int = 8, cv: str = "occupied",
                      available: DataFrame | None = None, x: str = "src_x", y: str = "src_y") -> DataFrame:
    """Occupied cells, coverage and coefficient of variation of counts.

    `cv` names the cells that count: `occupied`, `all` n*n, or `available` (cells holding any row of `available`).
    """
    counts = grid_counts(points, x, y, width, height, n)
    if cv == "available":
        cells = grid_counts(available, x, y, width, height, n).select("pair_id", "gx", "gy")
        counts = cells.join(counts, ["pair_id", "gx", "gy"], "left").fillna(0, ["n_points"])
    c = F.col("n_points")
    agg = counts.groupBy("pair_id").agg(
        F.count_if(c > 0).alias("occupied_cells"), F.count(F.lit(1)).alias("_cells"), F.sum(c).alias("n_points"),
        F.sum(c * c).alias("_s2"))
    k = {"occupied": F.col("occupied_cells"), "all": F.lit(n * n), "available": F.col("_cells")}[cv]
    mean = F.col("n_points") / k
    var = F.greatest(F.col("_s2") / k - mean * mean, F.lit(0.0))
    total = k if cv == "available" else F.lit(n * n)
    return agg.select("pair_id", "n_points", "occupied_cells", (F.col("occupied_cells") / total * 100).alias("coverage_pct"),
                      F.when(mean > 0, F.sqrt(var) / mean).alias("cv"))


def similarity_sums(keep: Column | None = None) -> list[Column]:
    """Aggregates of a least-squares similarity in one pass (mergeable, so a hot pair is combined map-side)."""
    def c(name):
        return F.when(keep, F.col(name)) if keep is not None else F.col(name)

    x, y, u, v = c("src_x"), c("src_y"), c("ref_x"), c("ref_y")
    return [
        F.count(x).alias("n_used"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.avg(u).alias("_mu"), F.avg(v).alias("_mv"),
        F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.var_pop(u).alias("_vu"), F.var_pop(v).alias("_vv"),
        F.covar_pop(x, u).alias("_xu"), F.covar_pop(y, v).alias("_yv"), F.covar_pop(x, v).alias("_xv"), F.covar_pop(y, u).alias("_yu"),
    ]


def similarity_from_sums(df: DataFrame) -> DataFrame:
    spread = F.col("_vx") + F.col("_vy")
    a = F.when(spread > 0, (F.col("_xu") + F.col("_yv")) / spread)
    b = F.when(spread > 0, (F.col("_xv") - F.col("_yu")) / spread)
    out = (df.withColumn("a", a).withColumn("b", b)
           .withColumn("tx", F.col("_mu") - F.col("a") * F.col("_mx") + F.col("b") * F.col("_my"))
           .withColumn("ty", F.col("_mv") - F.col("b") * F.col("_mx") - F.col("a") * F.col("_my"))
           .withColumn("rmse_px", F.sqrt(F.greatest(
               F.lit(0.0), F.col("_vu") + F.col("_vv") - (F.col("a") * F.col("a") + F.col("b") * F.col("b")) * (F.col("_vx") + F.col("_vy")))))
           .withColumn("scale", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")))
           .withColumn("rotation_deg", F.degrees(F.atan2("b", "a")))
           .withColumn("condition", X.cond3(X.similarity_matrix("a", "b", "tx", "ty"))))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def fit_similarity(matches: DataFrame, keys=("pair_id",)) -> DataFrame:
    """4-parameter least-squares fit per group: a, b, tx, ty, scale, rotation, condition, RMSE."""
    return similarity_from_sums(matches.groupBy(*keys).agg(*similarity_sums())).where(F.col("n_used") >= 2)


def refit_gates(res: DataFrame, gates=REFIT_GATES) -> DataFrame:
    """Similarity refit per residual gate; gates with fewer than 4 matches stay null."""
    pick = F.explode(F.filter(F.array(*[F.lit(float(g)) for g in gates]), lambda g: F.col("residual_px") <= g))
    fits = fit_similarity(res.withColumn("gate_px", pick), ("pair_id", "gate_px"))
    grid = res.select("pair_id").distinct().select(
        "pair_id", F.explode(F.array(*[F.lit(float(g)) for g in gates])).alias("gate_px"))
    out = grid.join(fits, ["pair_id", "gate_px"], "left").fillna(0, ["n_used"])
    ok = F.col("n_used") >= 4
    cols = [F.when(ok, F.col(c)).alias(c) for c in ("scale", "rotation_deg", "tx", "ty", "condition", "rmse_px")]
    return out.select("pair_id", "gate_px", "n_used", F.when(ok, "VALID").otherwise("INSUFFICIENT").alias("status"), *cols)


def refit_stability(res: DataFrame, gates=REFIT_GATES) -> DataFrame:
    """Spread of scale and rotation over the valid gates (zero with one gate, null with none)."""
    f = refit_gates(res, gates)
    return f.groupBy("pair_id").agg(
        F.count("scale").alias("n_valid_gates"), (F.max("scale") - F.min("scale")).alias("scale_spread"),
        (F.max("rotation_deg") - F.min("rotation_deg")).alias("rotation_spread_deg"))


def displacement_stats(res: DataFrame, gate: float = 15.0) -> DataFrame:
    inl = res.where(F.col("residual_px") <= gate)
    dx, dy = F.col("ref_x") - F.col("src_x"), F.col("ref_y") - F.col("src_y")
    return inl.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(dx).alias("mean_dx"), F.stddev_pop(dx).alias("std_dx"),
        F.avg(dy).alias("mean_dy"), F.stddev_pop(dy).alias("std_dy"))


def filter_confidence(matches: DataFrame, t: float, confidence: str = "confidence") -> DataFrame:
    """Keep matches at or above a confidence; report the new count and mean per pair."""
    return matches.where(F.col(confidence) >= t).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_kept"), F.avg(confidence).alias("mean_confidence"))


def accept_nodes(peak_min: float = 0.5, uniq_max: float = 0.9) -> Column:
    return (F.col("peak") >= peak_min) & (F.col("second_peak") < uniq_max * F.col("peak")) & ~F.col("on_edge")


def reject_reason(peak_min: float = 0.4, uniq_max: float = 0.9, radius: float = 5.0) -> Column:
    """First failing rule of a node; null for an accepted node."""
    d2 = F.col("dx_sub") * F.col("dx_sub") + F.col("dy_sub") * F.col("dy_sub")
    return (F.when(F.col("nodata"), "nodata").when(F.col("peak") < peak_min, "peak")
            .when(F.col("second_peak") >= uniq_max * F.col("peak"), "uniqueness")
            .when(F.col("on_edge") | (d2 > radius * radius), "radius"))


def acceptance_rates(nodes: DataFrame) -> DataFrame:
    """Nodes per run and reason with run and grand totals (ROLLUP)."""
    tagged = nodes.withColumn("outcome", F.coalesce(reject_reason(), F.lit("accepted")))
    return tagged.rollup("run_id", "outcome").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.avg("peak").alias("mean_peak"),
        F.grouping_id().alias("level"))


def pair_acceptance(min_mask: float = 0.40, min_std: float = 12.0, max_floor: float = 0.70, max_shadow: float = 0.60) -> Column:
    """Ordered acceptance rules of a rendered pair: first failing rule or `accepted`."""
    return (F.when(F.col("mask_coverage") < min_mask, "mask_coverage")
            .when(F.least("std_a", "std_b") < min_std, "std_dev")
            .when(F.greatest("near_floor_a", "near_floor_b") > max_floor, "near_floor")
            .when(F.greatest("shadow_a", "shadow_b") > max_shadow, "shadow").otherwise("accepted"))


def bucket_matches(matches: DataFrame, width: float, height: float, n: int = 8, cap: int | None = None,
                   x: str = "ref_x", y: str = "ref_y") -> DataFrame:
    """Best-scored matches per grid cell. Default cap: twice the mean per occupied cell, rounded half-even.

    The position in a cell comes from `dense_index`, so a cell holding most rows is not sorted in one task.
    """
    gx, gy = grid_cell(x, y, width, height, n)
    celled = matches.withColumn("cell", gy * n + gx).withColumn("_neg", -F.col("score"))
    if cap is None:
        per_cell = celled.groupBy("pair_id", "cell").agg(F.count(F.lit(1)).alias("_c"))
        caps = per_cell.groupBy("pair_id").agg(
            F.greatest(F.lit(1), F.bround(2.0 * F.avg("_c"), 0)).cast("bigint").alias("cap"))
    else:
        caps = matches.select("pair_id").distinct().withColumn("cap", F.lit(max(1, int(cap))).cast("bigint"))
    placed = dense_index(celled, ["pair_id", "cell"], "_neg", "match_id", out="cell_rank")
    return placed.join(caps, "pair_id").where(F.col("cell_rank") < F.col("cap")).drop("_neg", "_n")


def hash_order(seed, *cols) -> Column:
    """Deterministic pseudo-random integer shared with SQL: first 8 hex digits of md5('seed:col:..')."""
    parts = [F.lit(str(seed)), *[X.col(c).cast("string") for c in cols]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def assign_folds(matches: DataFrame, scheme: str, k: int = 5, stripe_px: float = 500.0, seed: int = 42,
                 keys=("pair_id",)) -> DataFrame:
    """`fold` per match: contiguous along-track blocks, interleaved stripes, or a balanced random split."""
    keys = list(keys)
    if scheme == "spatial_blocks":
        r = dense_index(matches, keys, "src_y", "match_id")
        return r.withColumn("fold", F.floor(F.col("_rank") * k / F.col("_n")).cast("int")).drop("_rank", "_n")
    if scheme == "stripes":
        lo = matches.groupBy(*keys).agg(F.min("src_y").alias("_y0"))
        return matches.join(lo, keys).withColumn(
            "fold", (F.floor((F.col("src_y") - F.col("_y0")) / stripe_px) % k).cast("int")).drop("_y0")
    if scheme == "random_kfold":
        r = dense_index(matches.withColumn("_h", hash_order(seed, "match_id")), keys, "_h", "match_id")
        return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n", "_h")
    raise ValueError(f"unknown fold scheme {scheme}")


def heldout_summary(res: DataFrame, keys: list[str], trim: float = 3.0, r: str = "heldout_px") -> DataFrame:
    """Fractions within 1/2/3 px and trimmed RMSE, median, p68, p95. Comparisons are strict."""
    v = F.col(r)
    kept = F.when(v < trim, v)
    base = res.groupBy(*keys).agg(
        F.count(v).alias("n_heldout"), *[F.avg((v < t).cast("double")).alias(f"frac_within_{t}px") for t in (1, 2, 3)],
        F.count(kept).alias("n_within_trim"), F.sqrt(F.avg(kept * kept)).alias("rmse_within_trim_px"))
    q = grouped_quantiles(res, keys, kept, {
        "median_within_trim_px": 0.5, "p68_within_trim_px": 0.68, "p95_within_trim_px": 0.95})
    return base.join(q, keys, "left")


def gate_inputs(stats: DataFrame, transforms: DataFrame) -> DataFrame:
    """One row per pair: counts, recovered scale/rotation and condition, ready for `flight_gate`."""
    scale, rot, _, _ = X.decompose_similarity("h")
    return (stats.join(transforms.select("pair_id", "h", "expected_scale"), "pair_id")
            .withColumn("condition", X.cond3("h")).withColumn("scale", scale).withColumn("rotation_deg", rot))


def flight_gate(rows: DataFrame, delta_shuffle: str | None = None, ignore_consensus: bool = False,
                require_delta_shuffle: bool = False, limits: dict = GATE) -> DataFrame:
    """Ordered acceptance rules: consensus, conditioning, rotation, scale, control difference.

    Adds `reasons`, `first_failing`, `n_failed`, `is_gated`, `status`. With `ignore_consensus` the first rule is
    left out (ablation).
    """
    consensus = (F.col("n_inliers") < limits["min_inliers"]) | (F.col("ratio_pct") < limits["min_ratio_pct"])
    cond_bad = F.coalesce(F.col("condition") > limits["max_condition"], F.lit(True))
    rot_bad = F.abs(F.col("rotation_deg")) > limits["max_rotation_deg"]
    scale_bad = (F.col("expected_scale") > 0) & (
        F.abs(F.col("scale") - F.col("expected_scale")) / F.col("expected_scale") > limits["scale_tolerance"])
    rules = [] if ignore_consensus else [(consensus, "inlier_consensus")]
    rules += [(cond_bad, "conditioning"), (rot_bad, "unphysical_rotation"), (scale_bad, "unphysical_scale")]
    if delta_shuffle:
        rules.append((F.col(delta_shuffle) < limits["delta_shuffle_min"], "delta_shuffle"))
        if require_delta_shuffle:
            rules.append((F.col(delta_shuffle).isNull(), "missing_delta_shuffle"))
    elif require_delta_shuffle:
        rules.append((F.lit(True), "missing_delta_shuffle"))
    reasons = F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))
    return (rows.withColumn("reasons", reasons).withColumn("n_failed", F.size("reasons"))
            .withColumn("first_failing", F.when(F.size("reasons") > 0, F.element_at("reasons", 1)))
            .withColumn("is_gated", F.size("reasons") > 0)
            .withColumn("status", F.when(F.size("reasons") > 0, "GATED").otherwise("PASSED")))


def check_degeneracy(rows: DataFrame, dof: int = 4, rmse: str = "rmse_cpx") -> DataFrame:
    """Degenerate fits: inliers below twice the freedom, over-fitted residual, fewer than 8 raw matches."""
    rules = [
        (F.col("n_inliers") < 2 * dof, "degrees_of_freedom"),
        ((F.col(rmse) < 0.10) & (F.col("n_inliers") < 8), "overfitted_residual"),
        (F.col("n_matches") < 8, "raw_matches"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))
    return rows.withColumn("degeneracy_reasons", reasons).withColumn("is_degenerate", F.size(reasons) > 0)


def combined_verdict(rows: DataFrame) -> DataFrame:
    """Six-rule status: DEGENERATE before GATED before PASSED."""
    return rows.withColumn("verdict", F.when(F.col("is_degenerate"), "DEGENERATE").when(F.col("is_gated"), "GATED")
                           .otherwise("PASSED"))


def run_scorecard(rows: DataFrame, metres_per_px: str = "canvas_gsd") -> DataFrame:
    """Status per matcher and site; metrics of degenerate fits are nulled, raw ones kept."""
    keep = ~F.col("is_degenerate")
    return combined_verdict(rows).select(
        "pair_id", "n_matches", "n_inliers", F.col("verdict").alias("status"),
        F.when(keep, F.round("ratio_pct", 2)).alias("inlier_ratio_pct"), F.when(keep, F.round("rmse_cpx", 2)).alias("rmse_px"),
        F.when(keep, F.round(F.col("rmse_cpx") * F.col(metres_per_px), 1)).alias("rmse_m"),
        F.round("ratio_pct", 2).alias("unfiltered_ratio_pct"), F.round("rmse_cpx", 2).alias("unfiltered_rmse_px"))


def gate_cross_check(computed: DataFrame, cached: DataFrame, tol: float = 0.01) -> DataFrame:
    """Recomputed against cached RMSE; flags a difference above the tolerance."""
    j = computed.select("pair_id", F.col("rmse_cpx").alias("computed_rmse")).join(
        cached.select("pair_id", "cached_rmse"), "pair_id")
    d = F.abs(F.col("computed_rmse") - F.col("cached_rmse"))
    return j.withColumn("abs_diff", d).withColumn("mismatch", d > tol)


def before_after(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """Long table of metric, before, after, delta for two summaries of the same pairs."""
    b = before.select("pair_id", *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics])
    a = after.select("pair_id", *[F.col(m).cast("double").alias(f"a_{m}") for m in metrics])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(f"a_{m}").alias("after"))
                               for m in metrics]))
    return b.join(a, "pair_id").select("pair_id", rows.alias("s")).select(
        "pair_id", "s.*", (F.col("s.after") - F.col("s.before")).alias("delta"))


def model_selection(scores: DataFrame, order: list[str], slack: float = 0.05, score: str = "rmse_within_trim_px") -> DataFrame:
    """Simplest model whose score is within `slack` of the pair's best (at most seven kinds per pair)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    best = scores.groupBy("pair_id").agg(F.min(score).alias("best_score"))
    ok = scores.join(best, "pair_id").where(F.col(score) <= F.col("best_score") + slack)
    return ok.groupBy("pair_id").agg(F.min_by("kind", rank).alias("kind"), F.min_by(score, rank).alias("score"),
                                     F.max("best_score").alias("best_score"))
