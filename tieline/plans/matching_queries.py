"""Registered queries of neighbour joins, fits, consensus and held-out validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.operators import controls as N, fitting as M, matching as J, tiepoints as T
from tieline.plans.tiepoint_queries import DELTA, q, residuals, rounded
from tieline.registry import query
from tieline.session import spread

KNN = """SELECT a.pair_id, a.match_id AS id, b.match_id AS neighbour, sqrt((a.src_x-b.src_x)*(a.src_x-b.src_x) + (a.src_y-b.src_y)*(a.src_y-b.src_y)) AS distance
  FROM {tiepoints} a JOIN {tiepoints} b ON b.pair_id = a.pair_id AND b.match_id <> a.match_id"""


def knn_sql(k):
    return f"SELECT *, row_number() OVER (PARTITION BY pair_id, id ORDER BY distance, neighbour) AS rank FROM ({KNN}) z QUALIFY rank <= {k}"


@query("c6_knn_self", f"SELECT pair_id, id, neighbour, round(distance, 6) AS distance, rank FROM ({knn_sql(3)}) y")
def _(t):
    return rounded(J.knn_self(t.tiepoints, 3))


@query("d3_nn_distances", f"""
SELECT pair_id, round(avg(distance), 6) AS nn_mean, round(stddev_pop(distance), 6) AS nn_std, round(min(distance), 6) AS nn_min, round(max(distance), 6) AS nn_max FROM ({knn_sql(1)}) y GROUP BY pair_id""")
def _(t):
    return rounded(J.nn_stats(t.tiepoints))


@query("e3_vector_median_filter", f"""
WITH k AS ({knn_sql(8)}), m AS (SELECT k.pair_id, k.id, median(n.ref_x - n.src_x) AS mdx, median(n.ref_y - n.src_y) AS mdy FROM k JOIN {{tiepoints}} n ON n.pair_id = k.pair_id AND n.match_id = k.neighbour GROUP BY ALL),
 d AS (SELECT p.pair_id, match_id, sqrt((ref_x - src_x - mdx)*(ref_x - src_x - mdx) + (ref_y - src_y - mdy)*(ref_y - src_y - mdy)) AS dev FROM {{tiepoints}} p JOIN m ON m.pair_id = p.pair_id AND m.id = p.match_id),
 c AS (SELECT pair_id, median(dev) AS md FROM d GROUP BY ALL), s AS (SELECT d.pair_id, 3 * median(abs(dev - md)) AS th FROM d JOIN c ON c.pair_id = d.pair_id GROUP BY ALL)
SELECT d.pair_id, match_id, round(dev, 5) AS deviation, round(th, 5) AS threshold, dev <= th AS keep FROM d JOIN s ON s.pair_id = d.pair_id""")
def _(t):
    return rounded(J.vector_median_filter(t.tiepoints).select("pair_id", "match_id", "deviation", "threshold", "keep"), 5)


def sides(t):
    d = t.descriptors
    bits = F.expr("aggregate(sequence(0, 63), 0L, (s, i) -> s | if(element_at(descriptor, i + 1) > 0, shiftleft(1L, i), 0L))")
    d = d.withColumn("bits", bits)
    return d.where("side = 'q'").drop("side"), d.where("side = 'r'").drop("side")


DIST = """SELECT a.pair_id, a.kp_id AS q_id, b.kp_id AS r_id, list_distance(a.descriptor::DOUBLE[], b.descriptor::DOUBLE[]) AS d FROM {descriptors} a JOIN {descriptors} b ON b.pair_id = a.pair_id AND a.side = 'q' AND b.side = 'r'"""


@query("c7_descriptor_knn", f"""
SELECT pair_id, q_id, r_id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, q_id ORDER BY d, r_id) AS rank FROM ({DIST}) z) y WHERE rank <= 2""")
def _(t):
    return rounded(J.descriptor_knn(*sides(t)))


@query("c8_ratio_test", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, q_id ORDER BY d, r_id) AS rank FROM ({DIST}) z)
SELECT a.pair_id, a.q_id, a.r_id, round(a.d, 6) AS distance, round(b.d, 6) AS second FROM k a JOIN k b ON a.pair_id = b.pair_id AND a.q_id = b.q_id AND a.rank = 1 AND b.rank = 2 WHERE a.d < 95e-2 * b.d""")
def _(t):
    return rounded(J.ratio_test(J.descriptor_knn(*sides(t)), 0.95))


def mutual_sql(d):
    return f"""WITH d AS ({d}) SELECT pair_id, q_id, r_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, q_id ORDER BY d, r_id) AS a,
      row_number() OVER (PARTITION BY pair_id, r_id ORDER BY d, q_id) AS b FROM d) x WHERE a = 1 AND b = 1"""


@query("c9_mutual_best", mutual_sql(DIST))
def _(t):
    return rounded(J.mutual_best(*sides(t)))


BITS = "(SELECT *, list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN descriptor[i] > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b) AS bits FROM {descriptors})"


@query("c10_hamming_mutual", mutual_sql(f"SELECT a.pair_id, a.kp_id AS q_id, b.kp_id AS r_id, bit_count(xor(a.bits, b.bits)) * 1e0 AS d FROM {BITS} a JOIN {BITS} b ON b.pair_id = a.pair_id AND a.side = 'q' AND b.side = 'r'"))
def _(t):
    return rounded(J.mutual_best(*sides(t), value="bits", metric="hamming"))


@query("e7_spatial_dedup")
def _(t):
    return rounded(J.spatial_dedup(t.tiepoints))


AFF = """SELECT *, (dxu*vv - dxv*uv) / det AS ax, (dxv*vu - dxu*uv) / det AS bx, (dyu*vv - dyv*uv) / det AS ay, (dyv*vu - dyu*uv) / det AS by_ FROM (
  SELECT *, vu*vv - uv*uv AS det FROM (SELECT pair_id, count(*) AS n_used, avg(src_x) AS mx, avg(src_y) AS my, avg(ref_x - src_x) AS mdx, avg(ref_y - src_y) AS mdy, var_pop(src_x) AS vu, var_pop(src_y) AS vv,
   covar_pop(src_x, src_y) AS uv, covar_pop(src_x, ref_x - src_x) AS dxu, covar_pop(src_y, ref_x - src_x) AS dxv, covar_pop(src_x, ref_y - src_y) AS dyu, covar_pop(src_y, ref_y - src_y) AS dyv
   FROM {residuals} WHERE residual_px <= 15 GROUP BY pair_id) a) b"""


@query("d5_fit_translation", """
SELECT pair_id, count(*) AS n_used, round(avg(ref_x - src_x), 6) + 0.0 AS dx, round(avg(ref_y - src_y), 6) + 0.0 AS dy FROM {residuals} WHERE residual_px <= 15 GROUP BY pair_id""")
def _(t):
    m = M.fit_model(residuals(t).where("residual_px <= 15"), "translation")
    return rounded(m.select("pair_id", "n_used", F.col("coef")[0].alias("dx"), F.col("coef")[1].alias("dy")))


@query("d5_fit_affine", f"""
SELECT pair_id, n_used, round(mdx, 5) + 0.0 AS c0, round(ax * sqrt(vu + vv), 5) + 0.0 AS c1, round(bx * sqrt(vu + vv), 5) + 0.0 AS c2, round(mdy, 5) + 0.0 AS c3, round(ay * sqrt(vu + vv), 5) + 0.0 AS c4,
  round(by_ * sqrt(vu + vv), 5) + 0.0 AS c5 FROM ({AFF}) z WHERE n_used >= 3""")
def _(t):
    m = M.fit_model(residuals(t).where("residual_px <= 15"), "affine").where("n_used >= 3")
    return rounded(m.select("pair_id", "n_used", *[F.col("coef")[i].alias(f"c{i}") for i in range(6)]), 5)


@query("d5_fit_poly3")
def _(t):
    m = M.fit_model(residuals(t).where("residual_px <= 15"), "poly3")
    return m.select("pair_id", "n_used", F.size("coef").alias("n_coef"), F.col("coef")[0].alias("c0"))


@query("d6_predict", f"""
SELECT p.pair_id, match_id, round(src_x + mdx + ax * (src_x - mx) + bx * (src_y - my), 4) + 0.0 AS pred_x, round(src_y + mdy + ay * (src_x - mx) + by_ * (src_y - my), 4) + 0.0 AS pred_y
FROM {{tiepoints}} p JOIN ({AFF}) z ON z.pair_id = p.pair_id""")
def _(t):
    m = M.fit_model(residuals(t).where("residual_px <= 15"), "affine")
    return rounded(M.predict(t.tiepoints, m, "affine").select("pair_id", "match_id", "pred_x", "pred_y"), 4)


def summary_sql(keys, fold):
    return f"""SELECT pair_id, {fold} AS fold, count(*) AS n_heldout, round(avg(CASE WHEN r < 1 THEN 1e0 ELSE 0 END), 6) AS frac_within_1px, round(avg(CASE WHEN r < 3 THEN 1e0 ELSE 0 END), 6) AS frac_within_3px,
  count(*) FILTER (r < 3) AS n_within_trim, round(sqrt(avg(r*r) FILTER (r < 3)), 5) AS rmse_within_trim_px, round(quantile_cont(r, 0.5) FILTER (r < 3), 5) AS median_within_trim_px FROM h GROUP BY {keys}"""


@query("d9_heldout_translation", f"""
WITH f AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY pair_id ORDER BY src_y, match_id) - 1) * 5 / count(*) OVER (PARTITION BY pair_id)) AS INT) AS fold, ref_x - src_x AS dx, ref_y - src_y AS dy
           FROM {{residuals}} WHERE residual_px <= 15),
 s AS (SELECT *, sum(dx) OVER (PARTITION BY pair_id) - sum(dx) OVER (PARTITION BY pair_id, fold) AS sx, sum(dy) OVER (PARTITION BY pair_id) - sum(dy) OVER (PARTITION BY pair_id, fold) AS sy,
        count(*) OVER (PARTITION BY pair_id) - count(*) OVER (PARTITION BY pair_id, fold) AS n FROM f),
 h AS (SELECT pair_id, fold, sqrt((dx - sx/n)*(dx - sx/n) + (dy - sy/n)*(dy - sy/n)) AS r FROM s WHERE n > 0)
{summary_sql('pair_id, fold', 'fold')} UNION ALL {summary_sql('pair_id', 'CAST(NULL AS INT)')}""")
def _(t):
    s, _ = M.heldout(residuals(t).where("residual_px <= 15"), "translation", "spatial_blocks")
    return rounded(s.select("pair_id", "fold", "n_heldout", "frac_within_1px", "frac_within_3px", "n_within_trim", "rmse_within_trim_px", "median_within_trim_px"),
                   rmse_within_trim_px=5, median_within_trim_px=5)


@query("d9_heldout_ransac")
def _(t):
    s, _ = M.heldout(t.tiepoints, "similarity", "random_kfold", thresh=8.0, iters=100)
    return rounded(s)


def ransac_sql(gates: str, iters: int) -> str:
    """Same hash sampler, complex-number fit of two points, votes, two refits."""
    def md5(j):
        return f"CAST('0x' || substr(md5('42:' || it || ':{j}'), 1, 8) AS BIGINT)"
    def refit(n, prev):
        return f""" s{n} AS (SELECT pair_id, gate, avg(u) AS mu, avg(v) AS mv, avg(dx) AS mx, avg(dy) AS my, (covar_pop(u, dx) + covar_pop(v, dy)) / (var_pop(u) + var_pop(v)) AS a, (covar_pop(u, dy) - covar_pop(v, dx)) / (var_pop(u) + var_pop(v)) AS b
      FROM {prev} WHERE e2 < gate * gate GROUP BY ALL),
   m{n} AS (SELECT pair_id, gate, a, b, mx - a*mu + b*mv AS tx, my - b*mu - a*mv AS ty FROM s{n}),
   e{n} AS (SELECT p.*, m.a, m.b, (m.a*u - m.b*v + m.tx - dx)*(m.a*u - m.b*v + m.tx - dx) + (m.b*u + m.a*v + m.ty - dy)*(m.b*u + m.a*v + m.ty - dy) AS e2 FROM p JOIN m{n} m ON m.pair_id = p.pair_id AND m.gate = p.gate)"""
    return f"""
WITH g AS (SELECT unnest({gates}) AS gate),
 p AS (SELECT *, (src_x - cx) / sc AS u, (src_y - cy) / sc AS v FROM (SELECT pair_id, gate, match_id, src_x, src_y, ref_x - src_x AS dx, ref_y - src_y AS dy, avg(src_x) OVER w AS cx, avg(src_y) OVER w AS cy,
   sqrt(var_pop(src_x) OVER w + var_pop(src_y) OVER w) AS sc, count(*) OVER w AS n, row_number() OVER (PARTITION BY pair_id, gate ORDER BY match_id) - 1 AS rk FROM {{tiepoints}}, g WINDOW w AS (PARTITION BY pair_id, gate)) z),
 h AS (SELECT pair_id, gate, it, {md5(0)} % n AS r0, {md5(1)} % (n - 1) AS r1 FROM (SELECT DISTINCT pair_id, gate, n FROM p WHERE n >= 4) d, (SELECT unnest(range({iters})) AS it) i),
 hh AS (SELECT pair_id, gate, it, r0, r1 + CASE WHEN r0 <= r1 THEN 1 ELSE 0 END AS r1 FROM h),
 f0 AS (SELECT hh.pair_id, hh.gate, it, a.u AS u0, a.v AS v0, a.dx AS x0, a.dy AS y0, b.u - a.u AS zr, b.v - a.v AS zi, b.dx - a.dx AS wr, b.dy - a.dy AS wi
   FROM hh JOIN p a ON a.pair_id = hh.pair_id AND a.gate = hh.gate AND a.rk = r0 JOIN p b ON b.pair_id = hh.pair_id AND b.gate = hh.gate AND b.rk = r1),
 f1 AS (SELECT *, (wr*zr + wi*zi) / (zr*zr + zi*zi) AS a, (wi*zr - wr*zi) / (zr*zr + zi*zi) AS b FROM f0),
 f AS (SELECT pair_id, gate, it, a, b, x0 - (a*u0 - b*v0) AS tx, y0 - (a*v0 + b*u0) AS ty FROM f1),
 vt AS (SELECT f.pair_id, f.gate, it, count(*) FILTER ((f.a*u - f.b*v + f.tx - dx)*(f.a*u - f.b*v + f.tx - dx) + (f.b*u + f.a*v + f.ty - dy)*(f.b*u + f.a*v + f.ty - dy) < f.gate*f.gate) AS votes
   FROM f JOIN p ON p.pair_id = f.pair_id AND p.gate = f.gate GROUP BY ALL),
 bs AS (SELECT pair_id, gate, it FROM vt WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY pair_id, gate ORDER BY votes DESC, it) = 1),
 e0 AS (SELECT p.*, (f.a*u - f.b*v + f.tx - dx)*(f.a*u - f.b*v + f.tx - dx) + (f.b*u + f.a*v + f.ty - dy)*(f.b*u + f.a*v + f.ty - dy) AS e2 FROM p JOIN bs ON bs.pair_id = p.pair_id AND bs.gate = p.gate
   JOIN f ON f.pair_id = bs.pair_id AND f.gate = bs.gate AND f.it = bs.it),
{refit(1, 'e0')},
{refit(2, 'e1')}
SELECT pair_id, gate AS gate_px, count(*) AS n_matches, count(*) FILTER (e2 < gate*gate) AS n_inliers, round(sqrt(avg(e2) FILTER (e2 < gate*gate)), 5) AS rmse_px,
  round(any_value(sqrt((1 + a/sc)*(1 + a/sc) + (b/sc)*(b/sc))), 6) AS fit_scale, round(any_value(degrees(atan2(b/sc, 1 + a/sc))), 5) + 0.0 AS rotation_deg FROM e2 GROUP BY pair_id, gate"""


@query("i9_ransac", ransac_sql("[8e0]", 120))
def _(t):
    return rounded(M.ransac_sweep(t.tiepoints, [8.0], iters=120), rmse_px=5, rotation_deg=5)


@query("i10_ransac_sweep", ransac_sql("[10e0, 5e0, 2e0]", 60))
def _(t):
    return rounded(M.ransac_sweep(t.tiepoints, [10.0, 5.0, 2.0], iters=60), rmse_px=5, rotation_deg=5)


@query("i10_ransac_after_filter")
def _(t):
    kept = J.vector_median_filter(t.tiepoints).where("keep").select("pair_id", "match_id", "src_x", "src_y", "ref_x", "ref_y")
    return rounded(M.ransac_sweep(kept, [10.0, 5.0], iters=60))


def jittered(t, parallax=0.0):
    """Tie points with a planted cubic along-track displacement; every tenth lies 60 px off."""
    v, h = F.col("src_y") / 1000.0, (F.col("match_id") * 67 % 1001) / 10.0
    off = F.when(F.col("match_id") % 10 == 0, 60.0).otherwise(0.0)
    return t.tiepoints.withColumn("h", h).withColumn("ref_x", F.col("src_x") + 3.0 + 2.0 * v * v + parallax * h + off).withColumn(
        "ref_y", F.col("src_y") - 1.0 + v - v * v * v + F.col("src_x") / 1000.0 - parallax / 2 * h)


@query("i11_pspline_fit", """
SELECT pair_id, count(*) AS n, count(*) FILTER (match_id % 10 <> 0) AS n_inliers, true AS close FROM {tiepoints} GROUP BY pair_id""")
def _(t):
    """Planted displacement: the points that follow it are the inliers and keep a small residual."""
    _, pts = M.pspline_fit(jittered(t), 4.0, 250.0)
    inl = F.when(F.col("is_inlier"), F.col("fit_px"))
    return pts.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count(inl).alias("n_inliers"), (F.sqrt(F.avg(inl * inl)) < 0.2).alias("close"))


def with_height(t):
    """Height of each match and a displacement that depends on it."""
    h = (F.col("match_id") * 67 % 1001) / 10.0
    return t.tiepoints.withColumn("h", h).withColumn("ref_x", F.col("ref_x") + 0.2 * F.col("h"))


@query("i12_pspline_relief", """
SELECT pair_id, count(*) FILTER (match_id % 10 <> 0) AS n_used, 2e-1 AS parallax_x, -1e-1 AS parallax_y, round(median((match_id * 67 % 1001) / 1e1), 4) AS h0 FROM {tiepoints} GROUP BY pair_id""")
def _(t):
    """Planted parallax of 0.2 and -0.1 px per metre beside the along-track displacement."""
    m, _ = M.pspline_fit(jittered(t, 0.2), 4.0, 250.0, relief=True)
    return m.select("pair_id", "n_used", F.round("px", 2).alias("parallax_x"), F.round("py", 2).alias("parallax_y"), F.round("h0", 4).alias("h0"))


@query("i13_inverse_of_fits", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, pair_id, match_id, round(src_x, 3) + 0.0 AS inv_x, round(src_y, 3) + 0.0 AS inv_y, true AS converged FROM {{tiepoints}}" for k in ("translation", "similarity", "affine", "poly2")))
def _(t):
    """Models fitted to displacements of a tenth: the inverse of every mapped position is where it came from."""
    p = t.tiepoints.withColumn("ref_x", F.col("src_x") + (F.col("ref_x") - F.col("src_x")) / 10).withColumn("ref_y", F.col("src_y") + (F.col("ref_y") - F.col("src_y")) / 10)
    out = None
    for kind in ("translation", "similarity", "affine", "poly2"):
        m = M.fit_model(p, kind)
        there = M.predict(p, m, kind).select("pair_id", "match_id", F.col("pred_x").alias("map_x"), F.col("pred_y").alias("map_y"))
        back = M.inverse_map(there, m, kind).select(F.lit(kind).alias("kind"), "pair_id", "match_id", "inv_x", "inv_y", "converged")
        out = back if out is None else out.unionByName(back)
    return rounded(out, 3)


@query("d38_parallax_check")
def _(t):
    from tieline.functions.geo import emission_from_attitude

    m, _ = M.pspline_fit(with_height(t), 12.0, 250.0, relief=True)
    j = m.join(t.transforms.select("pair_id", "canvas_gsd"), "pair_id")
    return rounded(N.parallax_check(j, F.lit(4.7), F.lit(0.0), F.lit(0.0), F.lit(-4.7)).withColumn(
        "emission_label_deg", emission_from_attitude(F.lit(12.0), F.lit(4.0), F.lit(100.0))).select("pair_id", "emission_fitted_deg", "emission_label_deg"), 4)


@query("i13_inverse_map", """
SELECT p.pair_id, match_id, round((a*(ref_x - tx) + b*(ref_y - ty)) / (a*a + b*b), 2) + 0.0 AS inv_x, round((-b*(ref_x - tx) + a*(ref_y - ty)) / (a*a + b*b), 2) + 0.0 AS inv_y
FROM {tiepoints} p JOIN (SELECT pair_id, 1 + (a - 1) / 1e1 AS a, b / 1e1 AS b, tx, ty FROM {transforms}) t ON t.pair_id = p.pair_id""")
def _(t):
    m = t.transforms.select("pair_id", (1 + (F.col("a") - 1) / 10.0).alias("a"), (F.col("b") / 10.0).alias("b"), "tx", "ty")
    p = t.tiepoints.join(m, "pair_id").withColumnsRenamed({"ref_x": "map_x", "ref_y": "map_y"})
    return rounded(M.inverse_similarity(p).select("pair_id", "match_id", "inv_x", "inv_y"), 2)


# --- control statistics -------------------------------------------------------------------------------


@query("d22_delta_shuffle", """
SELECT run_id, round(g, 6) AS genuine, round(c, 6) AS max_control, arm AS worst_control, round(g - c, 6) + 0.0 AS delta_shuffle
FROM (SELECT run_id, max(ratio_pct) FILTER (arm = 'genuine') AS g, max(ratio_pct) FILTER (arm <> 'genuine') AS c FROM {runs} GROUP BY run_id) a
LEFT JOIN (SELECT run_id AS r, arm FROM {runs} WHERE arm <> 'genuine' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ratio_pct DESC, arm DESC) = 1) b ON r = run_id""")
def _(t):
    return rounded(N.delta_shuffle(t.runs))


@query("d21_null_summary", """
SELECT run_id, count(*) AS n, round(max(psr), 6) AS max, round(avg(psr), 6) AS mean, round(stddev_pop(psr), 6) AS std, round(quantile_cont(psr, 0.99), 6) AS p99, round(quantile_cont(psr, 0.95), 6) AS p95
FROM {runs} WHERE arm = 'uniform_noise' GROUP BY run_id""")
def _(t):
    return rounded(N.null_summary(t.runs.where("arm = 'uniform_noise'")))


@query("d23_verdicts", """
WITH a AS (SELECT run_id, max(psr) FILTER (arm = 'genuine') AS g, max(psr) FILTER (arm <> 'genuine') AS c, max(psr) FILTER (arm = 'uniform_noise') AS nm FROM {runs} GROUP BY run_id),
 b AS (SELECT run_id AS r, dx, dy FROM {runs} WHERE arm = 'genuine' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY psr DESC, dx DESC, dy DESC) = 1)
SELECT run_id, round(g, 6) AS psr_genuine, round(c, 6) AS max_control_psr, round(nm, 6) AS null_max_psr, round(g - c, 6) + 0.0 AS delta_psr, g > nm AND g - c > 0 AS significant,
  round(sqrt((dx - 5)*(dx - 5) + (dy + 3)*(dy + 3)), 6) AS gap_px, sqrt((dx - 5)*(dx - 5) + (dy + 3)*(dy + 3)) <= 10 AS agree_within_tol FROM a JOIN b ON r = run_id WHERE g IS NOT NULL""")
def _(t):
    primary = t.runs.select("run_id").distinct().select("run_id", F.lit(5.0).alias("primary_dx"), F.lit(-3.0).alias("primary_dy"))
    v = N.verdicts(t.runs, primary, tol_px=10.0)
    return rounded(v.select("run_id", "psr_genuine", "max_control_psr", "null_max_psr", "delta_psr", "significant", "gap_px", "agree_within_tol"))


@query("e17_coarse_prior", """
WITH s AS (SELECT run_id AS pair_id, dx, dy FROM {runs} WHERE psr > 6), m AS (SELECT pair_id, median(dx) AS mx, median(dy) AS my FROM s GROUP BY ALL)
SELECT s.pair_id, round(any_value(mx), 6) + 0.0 AS prior_dx, round(any_value(my), 6) + 0.0 AS prior_dy, count(*) AS n_significant, count(*) FILTER (sqrt((dx-mx)*(dx-mx) + (dy-my)*(dy-my)) <= 5) AS n_agree,
  count(*) >= 2 AND count(*) FILTER (sqrt((dx-mx)*(dx-mx) + (dy-my)*(dy-my)) <= 5) >= 2 AS valid FROM s JOIN m ON m.pair_id = s.pair_id GROUP BY s.pair_id""")
def _(t):
    seg = t.runs.withColumn("significant", F.col("psr") > 6).withColumnRenamed("run_id", "pair_id")
    return rounded(N.coarse_prior(seg))


@query("g3_controls_complete", """
WITH w AS (SELECT run_id, unnest(['rot90', 'rot180', 'rot270', 'vflip', 'hflip', 'offset', 'uniform_noise']) AS arm FROM (SELECT DISTINCT run_id FROM {runs}) r),
 g AS (SELECT run_id, arm, count(*) AS n FROM {runs} WHERE arm <> 'genuine' GROUP BY ALL)
SELECT w.run_id, w.arm, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem, coalesce(n, 0) AS n FROM w LEFT JOIN g ON g.run_id = w.run_id AND g.arm = w.arm WHERE n IS NULL OR n > 1""")
def _(t):
    return N.controls_complete(t.runs)


@query("d19_correlations", """
WITH k AS (SELECT pair_id, residual_px AS x, score AS y, rank() OVER (PARTITION BY pair_id ORDER BY residual_px) + (count(*) OVER (PARTITION BY pair_id, residual_px) - 1) / 2e0 AS rx,
   rank() OVER (PARTITION BY pair_id ORDER BY score) + (count(*) OVER (PARTITION BY pair_id, score) - 1) / 2e0 AS ry FROM {residuals})
SELECT pair_id, count(*) AS n, round(corr(x, y), 8) + 0.0 AS pearson_r, round(corr(rx, ry), 8) + 0.0 AS spearman_rho FROM k GROUP BY pair_id""")
def _(t):
    return rounded(N.correlations(residuals(t), "residual_px", "score", ["pair_id"]), 8)


@query("d19_correlation_p_values")
def _(t):
    return N.correlations(residuals(t), "residual_px", "score", ["pair_id"], p_values=True)


KS = """WITH r AS (SELECT run_id, psr AS v, arm = 'genuine' AS f FROM {runs}), t AS (SELECT run_id, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2 FROM r GROUP BY ALL),
 c AS (SELECT run_id, v, sum(count(*) FILTER (f)) OVER (PARTITION BY run_id ORDER BY v) AS c1, sum(count(*) FILTER (NOT f)) OVER (PARTITION BY run_id ORDER BY v) AS c2 FROM r GROUP BY run_id, v)
SELECT c.run_id, n1, n2, {d} FROM c JOIN t ON t.run_id = c.run_id WHERE n1 > 0 AND n2 > 0 GROUP BY ALL"""


@query("d20_ks_2samp", KS.replace("{d}", "round(max(abs(c1 / n1 - c2 / n2)), 8) AS ks_d"))
def _(t):
    k = N.ks_2samp(t.runs.withColumn("first", F.col("arm") == "genuine"), "psr", "first", ["run_id"])
    return rounded(k.where("n1 > 0 AND n2 > 0"), 8)


@query("d20_ks_p_value", f"""
SELECT run_id, n1, n2, round(d, 8) AS ks_d, round(CASE WHEN t < 2e-1 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1e0, k - 1) * exp(-2 * k * k * t * t))))) END, 8) + 0.0 AS ks_p
FROM (SELECT *, sqrt(n1 * n2 / ((n1 + n2) * 1e0)) * d AS t FROM ({KS.replace("{d}", "max(abs(c1 / n1 - c2 / n2)) AS d")}) k) z""")
def _(t):
    k = N.ks_2samp(t.runs.withColumn("first", F.col("arm") == "genuine"), "psr", "first", ["run_id"], p_value=True)
    return rounded(k.where("n1 > 0 AND n2 > 0"), 8)


@query("f5_best_arm", """
SELECT run_id, arm, n AS n_accepted FROM (SELECT run_id, arm, count(*) AS n FROM {runs} WHERE ratio_pct > 5 AND arm IN ('rot90', 'vflip', 'hflip') GROUP BY ALL) x
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, list_position(['rot90', 'vflip', 'hflip'], arm)) = 1""")
def _(t):
    arms = ["rot90", "vflip", "hflip"]
    r = t.runs.where(F.col("arm").isin(arms) & (F.col("ratio_pct") > 5)).groupBy("run_id", "arm").agg(F.count(F.lit(1)).alias("n_accepted"))
    return N.best_arm(r, arms)


@query("c17_with_controls", """
SELECT pair_id, arm, count(*) AS n FROM {tiepoints}, (SELECT unnest(['genuine', 'rot90', 'rot180', 'rot270', 'vflip', 'hflip', 'offset', 'uniform_noise']) AS arm) a GROUP BY ALL""")
def _(t):
    return N.with_controls(t.tiepoints).groupBy("pair_id", "arm").agg(F.count(F.lit(1)).alias("n"))


@query("c18_offset_tile_pairs", """
WITH d AS (SELECT DISTINCT pair_id, match_id FROM {tiepoints}), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY match_id) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS n FROM d)
SELECT a.pair_id, a.match_id, b.match_id AS offset_match_id FROM r a JOIN r b ON b.pair_id = a.pair_id AND b.i = (a.i + a.n // 2) % a.n""")
def _(t):
    return N.offset_tile_pairs(t.tiepoints.select("pair_id", "match_id"), ["pair_id"], "match_id")


# --- splines over terrain: heights at predicted positions, inverse maps ---------------------------------

def on_terrain(t):
    """Matches of a pair whose reference tile is the pair's own number, with the height of the ground at the reference
    position: a plane, so that bilinear samples are exact. Displacement along the track plus parallax."""
    p = t.tiepoints.select("pair_id", "match_id", (F.col("src_x") % 40 + 4.0).alias("src_x"), (F.col("src_y") % 40 + 4.0).alias("src_y"))
    v = F.col("src_y") / 40.0
    bx, by = F.col("src_x") + 1.0 + v * v, F.col("src_y") - 0.5 + v
    # height 10 + 0.5 x + 0.25 y at the reference position, which the parallax (0.2, -0.1) moves: solved for the height
    h = (10.0 + 0.5 * bx + 0.25 * by) / (1 - 0.5 * 0.2 + 0.25 * 0.1)
    return p.withColumn("h", h).withColumn("ref_x", bx + 0.2 * h).withColumn("ref_y", by - 0.1 * h)


def terrain(t):
    """The plane's heights on 64 x 64 cells of every pair's reference tile."""
    side = F.explode(F.sequence(F.lit(-8), F.lit(71)))
    # the pairs are a small table, often one task's, and each becomes thousands of cells; dealt by another key than the one they
    # were made distinct by, or the exchange would be left out
    grid = spread(t.transforms.select(F.col("pair_id").alias("tile_id")), F.xxhash64("tile_id")).withColumn("row_no", side).withColumn("col_no", side)
    return grid.withColumn("z", 10.0 + 0.5 * F.col("col_no") + 0.25 * F.col("row_no"))


PLANTED_SQL = "SELECT pair_id, count(*) AS n, CAST(0 AS BIGINT) AS n_far FROM {tiepoints} GROUP BY pair_id"


def far_off(df, x, y, to_x, to_y):
    """Positions of a pair that lie further than a twentieth of a pixel from where they were planted."""
    far = ~(F.sqrt((F.col(x) - F.col(to_x)) ** 2 + (F.col(y) - F.col(to_y)) ** 2) < 0.05)
    return df.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(far).alias("n_far"))


@query("i12_height_lookup", PLANTED_SQL)
def _(t):
    """Positions predicted without knowing the heights: looked up on the terrain where the prediction stands."""
    pts = on_terrain(t)
    m, _ = M.pspline_fit(pts, 2.0, 10.0, relief=True)
    out = M.predict_spline(pts.drop("h").withColumn("tile_id", F.col("pair_id")), m, dem=terrain(t))
    return far_off(out, "pred_x", "pred_y", "ref_x", "ref_y")


@query("i13_inverse_of_splines", PLANTED_SQL)
def _(t):
    """Reference positions of known height go back to where they came from."""
    pts = on_terrain(t)
    m, _ = M.pspline_fit(pts, 2.0, 10.0, relief=True)
    back = M.inverse_spline(pts.withColumnsRenamed({"ref_x": "map_x", "ref_y": "map_y"}), m)
    return far_off(back.where("converged"), "inv_x", "inv_y", "src_x", "src_y")
