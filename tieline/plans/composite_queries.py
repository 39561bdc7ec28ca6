"""End-to-end queries: pair scorecard, corroboration, registration, coarse-to-fine, catalog search, grey proxy,
data-set checks, preprocessing and overlap crops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.fixed import CONTROL_ARMS, MODEL_ORDER
from tieline.functions import transforms as X
from tieline.functions.geo import az_diff, centered_window
from tieline.operators import catalog as C, controls as N, cube as K, dataset as D, fitting as M, geometry as Y, pixels as P, tiepoints as T, tiles as L
from tieline.plans.catalog_queries import BRIGHT, NEAR, tmc_iirs
from tieline.plans.pixel_queries import DESTRIPE, PROXY, REPAIR, blur_sql, cubes, unit
from tieline.plans.recipe_queries import equalise_ctes, kernel_sql, stretch_cte
from tieline.plans.source_queries import SHARDS, shards
from tieline.plans.tile_queries import moved
from tieline.plans.tiepoint_queries import CELLS, GATE_SQL, REFIT_SRC, gated, residuals, rounded, sim_fit
from tieline.registry import query
from tieline.session import cut_lineage


@query("q1_pair_scorecard", GATE_SQL.rstrip() + f""",
 cl AS (SELECT pair_id, count(*) AS occupied, stddev_pop(c) / avg(c) AS cv FROM ({CELLS}) x GROUP BY pair_id),
 rf AS (SELECT pair_id, max(scale) - min(scale) AS sp, max(rotation_deg) - min(rotation_deg) AS rp FROM ({sim_fit('pair_id, gate_px', REFIT_SRC)}) z WHERE n_used >= 4 GROUP BY pair_id),
 sw AS (SELECT pair_id, count(*) FILTER (residual_px <= 3) AS n3, count(*) FILTER (residual_px <= 15) * 4e-2 AS ex FROM {{residuals}} GROUP BY pair_id)
SELECT v.pair_id, n_matches, n_inliers, round(ratio, 6) AS ratio_pct, round(rmse, 6) AS rmse_cpx, round(med, 6) AS median_cpx, round(p95, 6) AS p95_cpx, occupied AS occupied_cells, round(cv, 6) AS cv,
 round(sp, 6) AS scale_spread, round(rp, 5) AS rotation_spread_deg, round(n3 / ex, 6) AS observed_over_expected_3px, array_to_string(reasons, ';') AS reasons,
 CASE WHEN len(reasons) > 0 THEN 'GATED' ELSE 'PASSED' END AS status
FROM v JOIN cl ON cl.pair_id = v.pair_id JOIN rf ON rf.pair_id = v.pair_id JOIN sw ON sw.pair_id = v.pair_id""")
def q1(t):
    r = cut_lineage(residuals(t))  # five summaries read it
    inl = r.where("residual_px <= 15")
    grid = T.grid_distribution(inl, 1000.0, 1000.0).select("pair_id", "occupied_cells", "cv")
    refit = T.refit_stability(r).select("pair_id", "scale_spread", "rotation_spread_deg")
    sweep = T.threshold_sweep(r, [3.0]).select("pair_id", F.col("observed_over_expected").alias("observed_over_expected_3px"))
    g = gated(t, r).select("pair_id", "n_matches", "n_inliers", "ratio_pct", "rmse_cpx", "median_cpx", "p95_cpx", F.concat_ws(";", "reasons").alias("reasons"), "status")
    return rounded(g.join(grid, "pair_id").join(refit, "pair_id").join(sweep, "pair_id"), rotation_spread_deg=5)


@query("q2_corroboration")
def _(t):
    """Every tile against all controls and null draws: significance and distance to the stated shift."""
    runs = cut_lineage(L.phase_correlation(t.pixels, P.smooth(t.pixels, [0.25, 0.5, 0.25], size=32), 32, null_draws=200)).withColumnRenamed("tile_id", "run_id")
    primary = runs.select("run_id").distinct().select("run_id", F.lit(0.0).alias("primary_dx"), F.lit(0.0).alias("primary_dy"))
    v = N.verdicts(runs, primary, 2.0, 4.72)
    null = N.null_summary(runs.where("arm = 'uniform_noise'")).select("run_id", F.col("p99").alias("null_p99"))
    return rounded(v.join(null, "run_id"))


def node_matches(t, ref, priors=None, max_prior=0.0):
    """Nodes of the strip as tie points; eight tiles form a pair."""
    n = L.match_nodes(t.pixels_b, ref, 32, 4, 4, 3, priors=priors, max_prior=max_prior)
    ok = (F.col("peak") >= 0.5) & (F.col("second") < 0.9 * F.col("peak")) & ~F.col("on_edge")
    return n.select(F.floor(F.col("tile_id") / 8).alias("pair_id"), (F.col("tile_id") * 1024 + F.col("qy") * 32 + F.col("qx")).alias("match_id"), F.col("qx").cast("double").alias("src_x"),
                    ((F.col("tile_id") % 8) * 32 + F.col("qy")).cast("double").alias("src_y"), F.col("ref_x"), ((F.col("tile_id") % 8) * 32 + F.col("ref_y")).alias("ref_y"), "peak", ok.alias("accepted"))


def control_raster(ref, arm):
    """The reference under a control: turned or mirrored tiles, the tile half a strip away, or noise."""
    if arm == "uniform_noise":
        return ref.withColumn("dn", F.pmod(F.xxhash64("tile_id", "row_no", "col_no"), F.lit(256)) * 1.0)
    if arm == "offset":
        away = N.offset_tile_pairs(ref.select("tile_id").distinct().withColumn("_g", F.lit(0)), ["_g"], "tile_id")
        return ref.join(away.select("offset_tile_id", F.col("tile_id").alias("_t")), ref["tile_id"] == F.col("offset_tile_id")).select(F.col("_t").alias("tile_id"), "row_no", "col_no", "dn")
    r, c = X.control_coords(F.lit(arm), "row_no", "col_no", F.lit(32), F.lit(32))
    return ref.select("tile_id", r.alias("row_no"), c.alias("col_no"), "dn")


def choose_model(acc, height, kinds=MODEL_ORDER):
    """Kind of each pair by held-out error in spatial blocks: the simplest within the slack of the best."""
    scores = None
    for kind in kinds:
        rows = acc.join(height, ["pair_id", "match_id"], "left") if kind == "pspline_relief" else acc
        s = M.heldout(rows, kind, "spatial_blocks", thresh=None if kind.startswith("pspline") else 1.5, iters=80, knot_px=64.0, rounds=3)[0]
        s = s.where("fold IS NULL").select("pair_id", "rmse_within_trim_px").withColumn("kind", F.lit(kind))
        scores = s if scores is None else scores.unionByName(s)
    return cut_lineage(T.model_selection(cut_lineage(scores), kinds))


def fit_chosen(acc, chosen, height, keys):
    """Fit every group with the kind chosen for its pair: rows with fit_px and is_inlier. At most seven kinds occur."""
    out = None
    for kind in sorted(r[0] for r in chosen.select("kind").distinct().collect()):
        rows = acc.join(chosen.where(F.col("kind") == kind).select("pair_id"), "pair_id", "left_semi")
        if kind.startswith("pspline"):
            rows = rows.join(height, ["pair_id", "match_id"], "left") if kind == "pspline_relief" else rows
            _, pts = M.pspline_fit(rows, 1.5, 64.0, keys, relief=kind == "pspline_relief")
        else:
            _, pts = M.ransac(rows, kind, 1.5, 300, keys=keys)
        pts = pts.select(*keys, "match_id", "src_x", "src_y", "ref_x", "ref_y", "fit_px", "is_inlier")
        out = pts if out is None else out.unionByName(pts)
    return out


def node_heights(t):
    """Height of the terrain at every node."""
    return t.dem.select(F.floor(F.col("tile_id") / 8).alias("pair_id"), (F.col("tile_id") * 1024 + F.col("row_no") * 32 + F.col("col_no")).alias("match_id"), F.col("z").alias("h"))


@query("q3_registration", """
SELECT CAST(floor(tile_id / 8e0) AS BIGINT) AS pair_id, 'registered' AS status, 'translation' AS chosen_model, 1e0 AS shift_x, 1e0 AS shift_y, 7 AS n_controls, true AS beats_controls
FROM {pixels_b} GROUP BY ALL HAVING count(*) >= 324""")
def _(t):
    """Match nodes against the moved raster and all seven controls, choose the model of each pair by held-out error over
    all kinds, fit genuine and controls with it by consensus, compare inlier ratios. Pairs without a fit keep a row."""
    ref = cut_lineage(moved(t, 1, 1))
    runs = None
    for arm in ("genuine", *CONTROL_ARMS):
        r = node_matches(t, ref if arm == "genuine" else control_raster(ref, arm)).withColumn("arm", F.lit(arm))
        runs = r if runs is None else runs.unionByName(r)
    runs = cut_lineage(runs)
    acc, height = runs.where("accepted"), node_heights(t)
    chosen = choose_model(acc.where("arm = 'genuine'").drop("arm"), height)
    pts = fit_chosen(acc, chosen, height, ("pair_id", "arm"))
    inl = F.col("is_inlier")
    fits = pts.groupBy("pair_id", "arm").agg(F.count_if(inl).alias("n_inliers"), F.avg(F.when(inl, F.col("ref_x") - F.col("src_x"))).alias("dx"), F.avg(F.when(inl, F.col("ref_y") - F.col("src_y"))).alias("dy"))
    pairs = t.pixels_b.select(F.floor(F.col("tile_id") / 8).alias("pair_id")).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 324").select("pair_id")
    seen = runs.where("arm = 'genuine'").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    arms = N.with_controls(pairs).join(seen, "pair_id", "left").join(fits, ["pair_id", "arm"], "left")
    ratio = F.coalesce(F.col("n_inliers") / F.col("n_nodes") * 100, F.lit(0.0))
    delta = N.delta_shuffle(arms.withColumn("ratio_pct", ratio).withColumnRenamed("pair_id", "run_id"))
    own = arms.where("arm = 'genuine'").select("pair_id", "n_inliers", "dx", "dy").join(chosen.select("pair_id", F.col("kind").alias("chosen_model")), "pair_id", "left")
    out = own.join(arms.groupBy("pair_id").agg((F.count(F.lit(1)) - 1).alias("n_controls")), "pair_id").join(delta.select(F.col("run_id").alias("pair_id"), "delta_shuffle"), "pair_id")
    status = F.when(F.col("chosen_model").isNull(), "no_model").when(F.coalesce("n_inliers", F.lit(0)) == 0, "fit_failed").otherwise("registered")
    return out.select("pair_id", status.alias("status"), "chosen_model", (F.round("dx") + 0.0).alias("shift_x"), (F.round("dy") + 0.0).alias("shift_y"), "n_controls", (F.col("delta_shuffle") >= 15).alias("beats_controls"))


@query("q4_coarse_to_fine", """
SELECT CAST(floor(line / 256e0) AS BIGINT) AS pair_id, CASE WHEN max(line) - min(line) >= 48 THEN 'registered' ELSE 'no_prior' END AS status,
  CASE WHEN max(line) - min(line) >= 48 THEN 2e0 END AS prior_dx, CASE WHEN max(line) - min(line) >= 48 THEN 1e0 END AS prior_dy,
  CASE WHEN max(line) - min(line) >= 48 THEN 'translation' END AS chosen_model, CASE WHEN max(line) - min(line) >= 48 THEN 2e0 END AS shift_x, CASE WHEN max(line) - min(line) >= 48 THEN 1e0 END AS shift_y
FROM {pixels_b_strip} GROUP BY ALL""")
def _(t):
    """Sliding segments of the strip give a prior shift where they beat their controls; nodes are matched around it, the
    model is chosen by held-out error, fitted, and the offsets of its inliers are reported. Every pair keeps a row."""
    ref = cut_lineage(moved(t, 2, 1))
    def segments(px):
        line = F.col("tile_id") * 32 + F.col("row_no")
        s = P.sliding_segments(px.select(line.alias("line"), "col_no", "dn"), 32, 16)
        return s.select((F.col("segment_start") / 16).cast("bigint").alias("tile_id"), (F.col("line") - F.col("segment_start")).alias("row_no"), "col_no", "dn")
    seg = cut_lineage(L.phase_correlation(segments(t.pixels_b), segments(ref), 32, null_draws=50)).withColumnRenamed("tile_id", "run_id")
    v = N.verdicts(seg).withColumn("pair_id", F.floor(F.col("run_id") / 16))
    prior = cut_lineage(N.coarse_prior(v).where("valid").select("pair_id", "prior_dx", "prior_dy"))
    most = prior.agg(F.max(F.greatest(F.abs("prior_dx"), F.abs("prior_dy")))).first()[0] or 0.0  # sets the halo
    per_tile = t.pixels_b.select("tile_id", F.floor(F.col("tile_id") / 8).alias("pair_id")).distinct().join(prior, "pair_id").select("tile_id", "prior_dx", "prior_dy")
    acc, height = cut_lineage(node_matches(t, ref, per_tile, most).where("accepted")), node_heights(t)
    chosen = choose_model(acc, height, ["translation", "affine", "pspline"])
    pairs = t.pixels_b.select(F.floor(F.col("tile_id") / 8).alias("pair_id")).distinct()
    out = pairs.join(prior, "pair_id", "left").join(chosen.select("pair_id", F.col("kind").alias("chosen_model")), "pair_id", "left")
    pts = fit_chosen(acc, chosen, height, ("pair_id",))
    if pts is None:
        out = out.withColumns({"median_dx": F.lit(None).cast("double"), "median_dy": F.lit(None).cast("double")})
    else:
        out = out.join(D.geometry_offset(pts.where("is_inlier")).select("pair_id", "median_dx", "median_dy"), "pair_id", "left")
    status = F.when(F.col("prior_dx").isNull(), "no_prior").when(F.col("chosen_model").isNull(), "no_model").when(F.col("median_dx").isNull(), "fit_failed").otherwise("registered")
    return out.select("pair_id", status.alias("status"), *[(F.round(c) + 0.0).alias(c) for c in ("prior_dx", "prior_dy")], "chosen_model",
                      (F.round("median_dx") + 0.0).alias("shift_x"), (F.round("median_dy") + 0.0).alias("shift_y"))


@query("q5_catalog_pair_search", BRIGHT)
def _(t):
    return rounded(C.bright_pairs(*tmc_iirs(t)))


@query("q6_grey_proxy_quality", f"""
WITH img AS ({PROXY}), fix AS ({REPAIR.replace('{src}', 'img')}), ds AS ({DESTRIPE.replace('{src}', 'fix')}),
 b AS (SELECT tile_id, stddev_pop(m) AS s FROM (SELECT tile_id, col_no, median(dn) AS m FROM img GROUP BY ALL) x GROUP BY tile_id), a AS (SELECT tile_id, stddev_pop(m) AS s FROM (SELECT tile_id, col_no, median(dn) AS m FROM ds GROUP BY ALL) x GROUP BY tile_id)
SELECT b.tile_id AS product_id, round(b.s, 4) AS column_std_before, round(a.s, 4) AS column_std_after FROM b JOIN a ON a.tile_id = b.tile_id""")
def _(t):
    img = K.as_pixels(K.proxy_mean(K.select_bands(cubes(t))))
    clean = P.destripe(P.repair_columns(img, P.bad_columns(img)))
    def spread(df, name):
        return df.groupBy("tile_id", "col_no").agg(F.median("dn").alias("m")).groupBy("tile_id").agg(F.stddev_pop("m").alias(name))
    j = spread(img, "column_std_before").join(spread(clean, "column_std_after"), "tile_id")
    return rounded(j.withColumnRenamed("tile_id", "product_id"), 4)


@query("q7_dataset_checks", f"""
WITH o AS (SELECT *, CASE WHEN mask_coverage < 4e-1 THEN 'mask_coverage' WHEN least(std_a, std_b) < 12 THEN 'std_dev' WHEN greatest(near_floor_a, near_floor_b) > 7e-1 THEN 'near_floor' WHEN greatest(shadow_a, shadow_b) > 6e-1 THEN 'shadow' ELSE 'accepted' END AS outcome,
   least(abs(az_a - az_b) % 360, 360 - abs(az_a - az_b) % 360) AS d FROM {{pair_stats}})
SELECT 'outcome' AS section, outcome AS item, count(*) * 1e0 AS value FROM o GROUP BY outcome
UNION ALL SELECT 'azimuth', CAST(CASE WHEN d = 180 THEN 5 ELSE CAST(floor(d / 3e1) AS INT) END AS VARCHAR), count(*) * 1e0 FROM o WHERE outcome = 'accepted' GROUP BY ALL
UNION ALL SELECT 'coverage', 'min_pct', round(min(mask_coverage) * 100, 6) FROM o WHERE outcome = 'accepted' UNION ALL SELECT 'coverage', 'mean_pct', round(avg(mask_coverage) * 100, 6) FROM o WHERE outcome = 'accepted'
UNION ALL SELECT 'shards', CAST(shard AS VARCHAR), sum(strlen(payload)) * 1e0 FROM {SHARDS} s GROUP BY shard""")
def _(t):
    o = t.pair_stats.withColumn("outcome", T.pair_acceptance())
    good = o.where("outcome = 'accepted'")
    def part(df, section, item, value):
        return df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
    counts = part(o.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), "outcome", "outcome", "n")
    az = part(D.histogram(good, az_diff("az_a", "az_b"), [0.0, 30.0, 60.0, 90.0, 120.0, 150.0, 180.0]).where("n > 0"), "azimuth", "bin", "n")
    cov = D.coverage_stats(good).select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).alias("value")) for k in ("min_pct", "mean_pct")])).alias("s")).select("s.*")
    return rounded(counts.unionByName(az).unionByName(part(cov, "coverage", "item", "value")).unionByName(part(D.shard_manifest(shards(t)), "shards", "shard", "size_bytes")))


STAT_NAMES = ["n", "mean", "min", "max", "zero_pct", "shadow_fraction", "saturation_fraction", "entropy", "std", "snr", "contrast", "dynamic_range"]
FULL_STATS = """
 bins AS (SELECT tile_id, least(255, floor(dn * 256)) AS b, count(*) AS c FROM img GROUP BY ALL),
 ent AS (SELECT tile_id, -sum(c / n * log2(c / n)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY tile_id) AS n FROM bins) x GROUP BY tile_id),
 st AS (SELECT img.tile_id, count(*) AS n, avg(dn) AS mean, min(dn) AS min, max(dn) AS max, avg(CASE WHEN dn = 0 THEN 1e2 ELSE 0 END) AS zero_pct, avg(CASE WHEN dn < 5e-2 THEN 1e0 ELSE 0 END) AS shadow_fraction,
   avg(CASE WHEN dn > 95e-2 THEN 1e0 ELSE 0 END) AS saturation_fraction, any_value(entropy) AS entropy, stddev_pop(dn) AS std, avg(dn) / (stddev_pop(dn) + 1e-6) AS snr,
   stddev_pop(dn) / (avg(dn) + 1e-6) AS contrast, max(dn) - min(dn) AS dynamic_range FROM img JOIN ent ON ent.tile_id = img.tile_id GROUP BY img.tile_id)"""
FULL_SQL = "tile_id, n, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in STAT_NAMES[1:])


@query("q8_preprocess", f"""
WITH raw AS (SELECT tile_id, row_no, col_no, tile_id * 1000 + row_no AS line, dn FROM {{pixels}}), lim AS (SELECT DISTINCT tile_id, 2e0 AS clip FROM raw), {stretch_cte('raw', 'whole', 0.01, 0.99)}, {equalise_ctes('whole', 'even', 4)},
 ev AS (SELECT tile_id, row_no, col_no, line, dn / 255e0 AS dn FROM even), bl AS ({blur_sql('ev', kernel_sql(P.gaussian_kernel(1.0)), 4)}),
 img AS (SELECT ev.tile_id, round(least(1, greatest(0, ev.dn + 3e-1 * (ev.dn - bl.dn))), 9) AS dn FROM ev JOIN bl ON bl.tile_id = ev.tile_id AND bl.row_no = ev.row_no AND bl.col_no = ev.col_no), {FULL_STATS}
SELECT {FULL_SQL}, round(greatest(0, least(1, 1 - CASE WHEN shadow_fraction > 6e-1 THEN 5e-1 * (shadow_fraction - 6e-1) / 4e-1 ELSE 0 END
  - CASE WHEN saturation_fraction > 2e-1 THEN 5e-1 * (saturation_fraction - 2e-1) / 8e-1 ELSE 0 END)), 4) + 0.0 AS confidence FROM st""")
def _(t):
    """Stretch, contrast-limited equalisation, sharpening, quality numbers and confidence per tile."""
    s = P.percentile_stretch(t.pixels, 1.0, 99.0)
    sharp = P.unsharp(P.clahe(s, 32, 4).withColumn("dn", F.col("dn") / 255.0))
    q = P.image_stats(sharp.select("tile_id", F.round("dn", 9).alias("v")))
    return rounded(q.withColumn("confidence", X.preprocess_confidence("shadow_fraction", "saturation_fraction")), 4)


def window_sql(centre):
    return f"CASE WHEN {centre} - 8 < 0 THEN 0 WHEN {centre} + 8 > 32 THEN 16 ELSE {centre} - 8 END"


@query("q9_overlap_crop", f"""
WITH {NEAR}, mid AS (SELECT floor(a_scan / 1e2) % 32 AS r, floor(a_pixel / 1e2) % 32 AS c FROM near ORDER BY d, b_scan, b_pixel LIMIT 1),
 win AS (SELECT {window_sql('r')} AS l0, {window_sql('c')} AS s0 FROM mid),
 img AS (SELECT tile_id, avg(dn) AS dn FROM (SELECT tile_id, row_no, col_no, least(dn / 7e2, 1) AS dn FROM {{pixels}}) p, win WHERE row_no >= l0 AND row_no < l0 + 16 AND col_no >= s0 AND col_no < s0 + 16
   GROUP BY tile_id, floor(row_no / 2e0), floor(col_no / 2e0)), {FULL_STATS}
SELECT {FULL_SQL} FROM st""")
def _(t):
    """Common region of two products, centred window, crop, area mean and statistics."""
    c = Y.common_region(t.geometry_b, t.geometry_a, 1.0)
    l0, l1 = centered_window(F.floor(F.col("center_a_scan") / 100) % 32, F.lit(16), F.lit(32))
    s0, s1 = centered_window(F.floor(F.col("center_a_pixel") / 100) % 32, F.lit(16), F.lit(32))
    w = c.select(l0.alias("l0"), l1.alias("l1"), s0.alias("s0"), s1.alias("s1"))
    inside = unit(t).join(F.broadcast(w), (F.col("row_no") >= F.col("l0")) & (F.col("row_no") < F.col("l1")) & (F.col("col_no") >= F.col("s0")) & (F.col("col_no") < F.col("s1")))
    return rounded(P.image_stats(P.block_mean(inside.select(*P.KEY, "v"), 2, "v")), 4)
