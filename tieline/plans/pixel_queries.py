"""Registered queries of pixel, cube and terrain operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tieline.functions import transforms as X
from tieline.operators import cube as K, pixels as P
from tieline.plans.tiepoint_queries import q, rounded
from tieline.registry import query


def unit(t):
    """Pixels scaled to [0, 1]."""
    return t.pixels.select(*P.KEY, F.least(F.col("dn") / 700.0, F.lit(1.0)).alias("v"))


def bytes_(t):
    return t.pixels.withColumn("dn", F.col("dn") % 256)


UNIT = "(SELECT tile_id, row_no, col_no, least(dn / 7e2, 1) AS v FROM {pixels})"


@query("b2_crop_none", "SELECT * FROM {pixels} WHERE row_no BETWEEN 4 AND 19 AND col_no BETWEEN 8 AND 23")
def _(t):
    return P.crop(t.pixels, 4, 20, 8, 24).select(*P.KEY, "dn")


PADGRID = """(SELECT tile_id, r, c, lo_r, hi_r, lo_c, hi_c FROM (SELECT tile_id, min(row_no) AS lo_r, max(row_no) AS hi_r, min(col_no) AS lo_c, max(col_no) AS hi_c
  FROM {pixels} GROUP BY tile_id) e, (SELECT unnest(range(-2, 6)) AS r) a, (SELECT unnest(range(28, 36)) AS c) b)"""


@query("b2_crop_zero", f"""
SELECT g.tile_id, g.r AS row_no, g.c AS col_no, coalesce(dn, 0) AS dn FROM {PADGRID} g LEFT JOIN {{pixels}} p ON p.tile_id = g.tile_id AND p.row_no = g.r AND p.col_no = g.c""")
def _(t):
    return P.crop(t.pixels, -2, 6, 28, 36, "zero").select(*P.KEY, "dn")


@query("b2_crop_edge", f"""
SELECT g.tile_id, g.r AS row_no, g.c AS col_no, dn FROM {PADGRID} g LEFT JOIN {{pixels}} p ON p.tile_id = g.tile_id AND p.row_no = least(greatest(g.r, lo_r), hi_r)
  AND p.col_no = least(greatest(g.c, lo_c), hi_c)""")
def _(t):
    return P.crop(t.pixels, -2, 6, 28, 36, "edge")


@query("b5_thumbnail", """
SELECT tile_id, CAST(row_no / 4e0 AS BIGINT) AS row_no, CAST(col_no / 4e0 AS BIGINT) AS col_no, dn FROM {pixels} WHERE row_no % 4 = 0 AND col_no % 4 = 0""")
def _(t):
    return P.thumbnail(t.pixels, 4)


@query("b10_clean_numeric", """
WITH p AS (SELECT *, CASE WHEN (row_no + col_no) % 9 <> 0 AND (row_no + col_no) % 7 <> 0 THEN dn END AS g FROM {pixels}),
 m AS (SELECT tile_id, median(g) AS md, avg(g) AS mn FROM p GROUP BY tile_id)
SELECT p.tile_id, row_no, col_no, coalesce(g, 0) AS zero_fill, coalesce(g, md) AS median_fill, round(coalesce(g, mn), 6) AS mean_fill FROM p JOIN m ON m.tile_id = p.tile_id""")
def _(t):
    s = F.col("row_no") + F.col("col_no")
    d = t.pixels.withColumn("dn", F.when(s % 9 == 0, float("nan")).when(s % 7 == 0, float("inf")).otherwise(F.col("dn")))
    for how in ("zero", "median", "mean"):
        d = P.clean_numeric(d.withColumn(f"{how}_fill", F.col("dn")), how, f"{how}_fill")
    return rounded(d.select(*P.KEY, "zero_fill", "median_fill", "mean_fill"))


@query("d11_image_stats", f"""
WITH p AS (SELECT * FROM {UNIT} u), h AS (SELECT tile_id, least(255, floor(v * 256)) AS b, count(*) AS c FROM p GROUP BY ALL),
 e AS (SELECT tile_id, -sum(c / n * log2(c / n)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY tile_id) AS n FROM h) x GROUP BY tile_id)
SELECT p.tile_id, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(CASE WHEN v = 0 THEN 1e2 ELSE 0 END), 6) AS zero_pct,
  round(avg(CASE WHEN v < 5e-2 THEN 1e0 ELSE 0 END), 6) AS shadow_fraction, round(avg(CASE WHEN v > 95e-2 THEN 1e0 ELSE 0 END), 6) AS saturation_fraction,
  round(any_value(entropy), 6) AS entropy, round(stddev_pop(v), 6) AS std, round(avg(v) / (stddev_pop(v) + 1e-6), 5) AS snr,
  round(stddev_pop(v) / (avg(v) + 1e-6), 6) AS contrast, round(max(v) - min(v), 6) AS dynamic_range
FROM p JOIN e ON e.tile_id = p.tile_id GROUP BY p.tile_id""")
def _(t):
    return rounded(P.image_stats(unit(t)), snr=5)


@query("h22_preprocess_confidence", f"""
SELECT tile_id, round(greatest(0, least(1, 1 - CASE WHEN sh > 6e-1 THEN 5e-1 * (sh - 6e-1) / 4e-1 ELSE 0 END - CASE WHEN sa > 2e-1 THEN 5e-1 * (sa - 2e-1) / 8e-1 ELSE 0 END)), 6) AS confidence
FROM (SELECT tile_id, avg(CASE WHEN v < 3e-1 THEN 1e0 ELSE 0 END) AS sh, avg(CASE WHEN v > 4e-1 THEN 1e0 ELSE 0 END) AS sa FROM {UNIT} u GROUP BY tile_id) x""")
def _(t):
    s = unit(t).groupBy("tile_id").agg(F.avg((F.col("v") < 0.3).cast("double")).alias("sh"), F.avg((F.col("v") > 0.4).cast("double")).alias("sa"))
    return rounded(s.select("tile_id", X.preprocess_confidence("sh", "sa").alias("confidence")))


@query("h23_adaptive_clip", f"""
SELECT tile_id, row_no, CASE WHEN s < 1e-1 THEN 4e0 WHEN s > 25e-2 THEN 15e-1 ELSE 2e0 END AS clip FROM (SELECT tile_id, row_no, stddev_pop(v) AS s FROM {UNIT} u GROUP BY ALL) x""")
def _(t):
    s = unit(t).groupBy("tile_id", "row_no").agg(F.stddev_pop("v").alias("s"))
    return s.select("tile_id", "row_no", X.adaptive_clip("s").alias("clip"))


@query("h24_minmax_01", """
SELECT tile_id, row_no, col_no, round((dn - lo) / (hi - lo), 6) AS dn, least(255, floor(dn)) AS u8
FROM (SELECT *, min(dn) OVER (PARTITION BY tile_id) AS lo, max(dn) OVER (PARTITION BY tile_id) AS hi FROM {pixels}) x""")
def _(t):
    return rounded(P.minmax_01(t.pixels.withColumn("u8", X.to_u8("dn"))).withColumn("u8", F.col("u8").cast("double")))


STRETCH = """SELECT tile_id, row_no, col_no, CASE WHEN q[2] - q[1] > 1e-6 THEN floor(least(255, greatest(0, (dn - q[1]) / (q[2] - q[1]) * 255))) ELSE 0 END AS dn
 FROM {src} p JOIN (SELECT tile_id AS tid, quantile_cont(dn, [0.02, 0.98]) AS q FROM {src} GROUP BY tile_id) s ON tid = tile_id"""


@query("d12_percentile_stretch", STRETCH.replace("{src}", "{pixels}"))
def _(t):
    return P.percentile_stretch(t.pixels)


BAD = """SELECT tile_id, col_no, m AS col_mean, m > md + 25e-1 * s OR m < greatest(0, md - 25e-1 * s) AS is_bad FROM (
  SELECT *, 14826e-4 * greatest(median(abs(m - md)) OVER (PARTITION BY tile_id), 1e-6) AS s FROM (
    SELECT *, median(m) OVER (PARTITION BY tile_id) AS md FROM (SELECT tile_id, col_no, avg(dn) AS m FROM {src} GROUP BY ALL) a) b) c"""
REPAIR = f"""SELECT tile_id, row_no, col_no, CASE WHEN is_bad THEN coalesce((l + r) / 2, l, r, dn) ELSE dn END AS dn FROM (
  SELECT p.*, is_bad, last_value(CASE WHEN NOT is_bad THEN dn END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
    first_value(CASE WHEN NOT is_bad THEN dn END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
  FROM {{src}} p JOIN ({BAD}) b ON b.tile_id = p.tile_id AND b.col_no = p.col_no WINDOW w AS (PARTITION BY p.tile_id, p.row_no ORDER BY p.col_no)) x"""
DESTRIPE = """SELECT p.tile_id, row_no, p.col_no, dn - 85e-2 * (m - c) AS dn FROM {src} p JOIN (
  SELECT *, median(m) OVER (PARTITION BY tile_id) AS c FROM (SELECT tile_id, col_no, median(dn) AS m FROM {src} GROUP BY ALL) a) o ON o.tile_id = p.tile_id AND o.col_no = p.col_no"""


@query("d14_bad_columns", "SELECT tile_id, col_no, round(col_mean, 6) AS col_mean, is_bad FROM (" + BAD.replace("{src}", "{pixels}") + ") z")
def _(t):
    return rounded(P.bad_columns(t.pixels))


@query("e6_repair_columns", REPAIR.replace("{src}", "{pixels}"))
def _(t):
    return P.repair_columns(t.pixels, P.bad_columns(t.pixels)).select(*P.KEY, "dn")


@query("d13_destripe", "SELECT tile_id, row_no, col_no, round(dn, 6) + 0.0 AS dn FROM (" + DESTRIPE.replace("{src}", "{pixels}") + ") z")
def _(t):
    return rounded(P.destripe(t.pixels).select(*P.KEY, "dn"))


def grad_sql(src, value, sp):
    return f"""SELECT *, CASE WHEN rn IS NOT NULL AND rp IS NOT NULL THEN (rn - rp) / (2 * {sp}) WHEN rn IS NOT NULL THEN (rn - {value}) / {sp} WHEN rp IS NOT NULL THEN ({value} - rp) / {sp} END AS d_row,
  CASE WHEN cn IS NOT NULL AND cp IS NOT NULL THEN (cn - cp) / (2 * {sp}) WHEN cn IS NOT NULL THEN (cn - {value}) / {sp} WHEN cp IS NOT NULL THEN ({value} - cp) / {sp} END AS d_col
 FROM (SELECT p.*, a.{value} AS rn, b.{value} AS rp, c.{value} AS cn, d.{value} AS cp FROM {src} p
  LEFT JOIN {src} a ON a.line = p.line + 1 AND a.col_no = p.col_no LEFT JOIN {src} b ON b.line = p.line - 1 AND b.col_no = p.col_no
  LEFT JOIN {src} c ON c.line = p.line AND c.col_no = p.col_no + 1 LEFT JOIN {src} d ON d.line = p.line AND d.col_no = p.col_no - 1) x"""


@query("e12_slope", f"""
SELECT tile_id, row_no, col_no, round(degrees(atan(sqrt(d_row*d_row + d_col*d_col))), 6) AS slope_deg FROM ({grad_sql('{dem_strip}', 'z', '5e0')}) g""")
def _(t):
    return rounded(P.slope(t.dem, size=32).select(*P.KEY, "slope_deg"))


@query("e12_normals", f"""
SELECT tile_id, row_no, col_no, round(-d_col / n, 6) + 0.0 AS nx, round(d_row / n, 6) + 0.0 AS ny, round(1 / n, 6) AS nz FROM (SELECT *, sqrt(d_row*d_row + d_col*d_col + 1) AS n FROM ({grad_sql('{dem_strip}', 'z', '5e0')}) g) y""")
def _(t):
    return rounded(P.normals(t.dem, size=32).select(*P.KEY, "nx", "ny", "nz"))


@query("h19_photometry", f"""
SELECT tile_id, row_no, col_no, round(mu, 6) + 0.0 AS mu0, round_even(least(greatest(mu, 0), 1) * 255, 0) AS lambert,
  round_even(least(CASE WHEN mu > 0 THEN 2 * mu / (mu + 1) ELSE 0 END, 1) * 255, 0) AS lommel_seeliger
FROM (SELECT *, (-d_col * sin(radians(45e0)) * cos(radians(1e1)) + d_row * cos(radians(45e0)) * cos(radians(1e1)) + sin(radians(1e1))) / sqrt(d_row*d_row + d_col*d_col + 1) AS mu
      FROM ({grad_sql('{dem_strip}', 'z', '5e0')}) g WHERE d_row IS NOT NULL AND d_col IS NOT NULL) y""")
def _(t):
    n = P.normals(t.dem, size=32).where("nx IS NOT NULL AND ny IS NOT NULL").withColumn("mu0", X.incidence_cos("nx", "ny", "nz", F.lit(45.0), F.lit(10.0)))
    return rounded(n.select(*P.KEY, "mu0", X.lambert("mu0").alias("lambert"), X.lommel_seeliger("mu0").alias("lommel_seeliger")))


@query("h25_elevation_stratum", """
SELECT CASE WHEN alt_a >= 2 AND alt_a < 6 THEN '2-6' WHEN alt_a >= 6 AND alt_a < 12 THEN '6-12' WHEN alt_a >= 12 AND alt_a <= 30 THEN '12-30' ELSE 'outside' END AS stratum, count(*) AS n
FROM {pair_stats} GROUP BY ALL""")
def _(t):
    return t.pair_stats.groupBy(X.elevation_stratum("alt_a").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


SOB = """SELECT * FROM (SELECT p.tile_id, p.row_no, p.col_no,
  sum(dx * (2 - abs(dy)) * n.dn) AS gx, sum(dy * (2 - abs(dx)) * n.dn) AS gy, count(*) AS k
 FROM (SELECT *, unnest([-1, 0, 1]) AS dy FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM {pixels_strip}) x) p JOIN {pixels_strip} n ON n.line = p.line + dy AND n.col_no = p.col_no + dx
 GROUP BY p.tile_id, p.row_no, p.col_no) s WHERE k = 9"""


@query("i5_sobel", f"SELECT tile_id, row_no, col_no, gx, gy, round(sqrt(gx*gx + gy*gy), 6) AS magnitude FROM ({SOB}) z")
def _(t):
    return rounded(P.sobel(t.pixels, size=32))


@query("i5_structure_map", f"""
WITH m AS (SELECT tile_id, row_no, col_no, sqrt(gx*gx + gy*gy) AS g FROM ({SOB}) z), s AS (SELECT tile_id, row_no, col_no, CASE WHEN hi - lo >= 1e-6 THEN (g - lo) / (hi - lo) ELSE 0 END AS s
 FROM (SELECT *, min(g) OVER (PARTITION BY tile_id) AS lo, max(g) OVER (PARTITION BY tile_id) AS hi FROM m) x),
 t AS (SELECT tile_id AS tid, avg(s) + 5e-1 * stddev_pop(s) AS th, max(s) AS mx FROM s GROUP BY tile_id)
SELECT tile_id, row_no, col_no, round(s, 6) AS s, round(CASE WHEN s >= th AND mx - th >= 1e-6 THEN (s - th) / (mx - th) ELSE 0 END, 6) + 0.0 AS structure FROM s JOIN t ON tid = tile_id""")
def _(t):
    return rounded(P.structure_sobel(t.pixels, 32))


SOB_B = SOB.replace("{pixels_strip}", "{pixels_b_strip}")


@query("i8_gradient_orientation", f"""
WITH a AS (SELECT *, sqrt(gx*gx + gy*gy) AS g FROM ({SOB}) z), b AS (SELECT *, sqrt(gx*gx + gy*gy) AS g FROM ({SOB_B}) z)
SELECT a.tile_id, count(*) AS n, round(avg(CASE WHEN a.g > 1e-3 AND b.g > 1e-3 THEN (a.gx * b.gx + a.gy * b.gy) / (a.g * b.g) ELSE 0 END), 6) + 0.0 AS score
FROM a JOIN b ON b.tile_id = a.tile_id AND b.row_no = a.row_no AND b.col_no = a.col_no GROUP BY a.tile_id""")
def _(t):
    return rounded(P.orientation_score(P.gradient_orientation(t.pixels, 32), P.gradient_orientation(t.pixels_b, 32)))


@query("i6_block_mean", """
SELECT tile_id, CAST(floor(row_no / 4e0) AS BIGINT) AS row_no, CAST(floor(col_no / 4e0) AS BIGINT) AS col_no, round(avg(dn), 6) AS dn FROM {pixels} GROUP BY ALL""")
def _(t):
    return rounded(P.block_mean(t.pixels, 4))


K5 = "[1/16e0, 4/16e0, 6/16e0, 4/16e0, 1/16e0]"


def blur_sql(src, kernel, r):
    """Blur along rows, then along the lines of the whole product; src has line, col_no and dn."""
    h = f"""SELECT p.tile_id, p.row_no, p.col_no, p.line, sum(({kernel})[d + {r} + 1] * n.dn) / sum(({kernel})[d + {r} + 1]) AS dn
 FROM (SELECT *, unnest(range(-{r}, {r} + 1)) AS d FROM {src} s) p JOIN {src} n ON n.line = p.line AND n.col_no = p.col_no + d GROUP BY p.tile_id, p.row_no, p.col_no, p.line"""
    return f"""SELECT p.tile_id, p.row_no, p.col_no, sum(({kernel})[d + {r} + 1] * n.dn) / sum(({kernel})[d + {r} + 1]) AS dn
 FROM (SELECT *, unnest(range(-{r}, {r} + 1)) AS d FROM ({h}) s) p JOIN ({h}) n ON n.line = p.line + d AND n.col_no = p.col_no GROUP BY p.tile_id, p.row_no, p.col_no"""


@query("i6_pyramid", f"""
SELECT 0 AS level, tile_id, row_no, col_no, round(dn, 8) AS dn FROM {{pixels}} UNION ALL
SELECT 1, tile_id, CAST(row_no / 2e0 AS BIGINT), CAST(col_no / 2e0 AS BIGINT), round(dn, 8) FROM ({blur_sql('{pixels_strip}', K5, 2)}) b WHERE row_no % 2 = 0 AND col_no % 2 = 0""")
def _(t):
    return rounded(P.pyramid(t.pixels, 2, 32), 8)


G1 = "[" + ", ".join(repr(k).replace("e", "e") + ("" if "e" in repr(k) else "e0") for k in P.gaussian_kernel(1.0)) + "]"


@query("i7_gaussian_unsharp", f"""
SELECT p.tile_id, p.row_no, p.col_no, round(least(1, greatest(0, p.dn + 3e-1 * (p.dn - b.dn))), 5) AS dn
FROM (SELECT tile_id, row_no, col_no, v AS dn FROM {UNIT} u) p JOIN ({blur_sql('(SELECT *, tile_id * 32 + row_no AS line FROM (SELECT tile_id, row_no, col_no, v AS dn FROM ' + UNIT + ' u) w)', G1, 4)}) b
ON b.tile_id = p.tile_id AND b.row_no = p.row_no AND b.col_no = p.col_no""")
def _(t):
    return rounded(P.unsharp(unit(t).withColumnRenamed("v", "dn"), size=32), 5)


@query("e11_hist_equalize", """
WITH h AS (SELECT tile_id, dn % 256 AS v, count(*) AS c FROM {pixels} GROUP BY ALL), d AS (SELECT *, sum(c) OVER (PARTITION BY tile_id ORDER BY v) AS cdf, sum(c) OVER (PARTITION BY tile_id) AS n FROM h),
 l AS (SELECT *, min(cdf) OVER (PARTITION BY tile_id) AS m FROM d)
SELECT p.tile_id, p.row_no, p.col_no, CASE WHEN n > m THEN round_even((cdf - m) / (n - m) * 255, 0) ELSE v END AS equalized FROM {pixels} p JOIN l ON l.tile_id = p.tile_id AND l.v = p.dn % 256""")
def _(t):
    return P.hist_equalize(bytes_(t)).select(*P.KEY, F.col("equalized").cast("double").alias("equalized"))


@query("e13_clahe", """
WITH h AS (SELECT tile_id, floor(row_no / 8e0) AS ty, floor(col_no / 8e0) AS tx, CAST(dn % 256 AS INT) AS v, count(*) AS c FROM {pixels} GROUP BY ALL),
 e AS (SELECT tile_id, ty, tx, sum(c) AS n, greatest(1e0, 2e0 * sum(c) / 256) AS lim FROM h GROUP BY ALL),
 x AS (SELECT e.tile_id, e.ty, e.tx, n, lim, sum(greatest(c - lim, 0)) AS ex FROM h JOIN e ON e.tile_id = h.tile_id AND e.ty = h.ty AND e.tx = h.tx GROUP BY ALL),
 f AS (SELECT x.*, g.v, least(coalesce(c, 0), lim) + ex / 256 AS mass FROM x CROSS JOIN (SELECT unnest(range(256)) AS v) g LEFT JOIN h ON h.tile_id = x.tile_id AND h.ty = x.ty AND h.tx = x.tx AND h.v = g.v),
 l AS (SELECT tile_id, ty, tx, v, sum(mass) OVER (PARTITION BY tile_id, ty, tx ORDER BY v) * 255 / n AS lut FROM f),
 k AS (SELECT p.*, CAST(dn % 256 AS INT) AS v, dy, dx, (row_no + 5e-1) / 8e0 - 5e-1 AS fy, (col_no + 5e-1) / 8e0 - 5e-1 AS fx FROM {pixels} p, (SELECT unnest([0, 1]) AS dy) a, (SELECT unnest([0, 1]) AS dx) b),
 w AS (SELECT *, least(greatest(floor(fy) + dy, 0), 3) AS ty, least(greatest(floor(fx) + dx, 0), 3) AS tx,
        (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM k)
SELECT w.tile_id, row_no, col_no, round(sum(w * lut) / sum(w), 5) AS dn FROM w JOIN l ON l.tile_id = w.tile_id AND l.ty = w.ty AND l.tx = w.tx AND l.v = w.v WHERE w > 0 GROUP BY ALL""")
def _(t):
    return rounded(P.clahe(bytes_(t), 32, 4), 5)


POINTS = """(SELECT tile_id, match_id, x, y FROM (SELECT o_orderkey AS match_id, CAST(floor(o_orderkey / 1024e0) AS BIGINT) AS tile_id, (o_orderkey * 7919 % 3000) / 1e2 AS x, (o_orderkey * 104729 % 3200) / 1e2 AS y FROM {orders}) z)"""


def points(t):
    k = F.col("o_orderkey")
    return t.orders.select(F.floor(k / 1024).alias("tile_id"), k.alias("match_id"), ((k * 7919) % 3000 / 100.0).alias("x"), ((k * 104729) % 3200 / 100.0).alias("y"))


@query("c11_sample_bilinear", f"""
SELECT tile_id, match_id, round(CASE WHEN k = need THEN s END, 5) AS sampled FROM (SELECT p.tile_id, match_id, count(dn) AS k, sum(w * dn) AS s, count(*) AS need FROM (
  SELECT p.*, floor(y) + dy AS r, floor(x) + dx AS c, (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
  FROM {POINTS} p, (SELECT unnest([0, 1]) AS dy) a, (SELECT unnest([0, 1]) AS dx) b) p LEFT JOIN {{pixels_strip}} q ON q.line = p.tile_id * 32 + p.r AND q.col_no = p.c WHERE w > 0 GROUP BY ALL) g""")
def _(t):
    return rounded(P.sample_raster(points(t), t.pixels, size=32).select("tile_id", "match_id", "sampled"), 5)


@query("c11_sample_nearest", f"""
SELECT p.tile_id, match_id, dn AS sampled FROM {POINTS} p LEFT JOIN {{pixels_strip}} q ON q.line = p.tile_id * 32 + round_even(y, 0) AND q.col_no = round_even(x, 0)""")
def _(t):
    return P.sample_raster(points(t), t.pixels, "nearest", size=32).select("tile_id", "match_id", "sampled")


@query("d34_slope_vs_residual", f"""
WITH s AS (SELECT tile_id, row_no, col_no, round(degrees(atan(sqrt(d_row*d_row + d_col*d_col))), 9) AS sl FROM ({grad_sql('{dem_strip}', 'z', '5e0')}) g WHERE d_row IS NOT NULL AND d_col IS NOT NULL),
 j AS (SELECT p.tile_id, r.residual_px AS x, sl AS y FROM {POINTS} p JOIN {{residuals}} r ON r.match_id = p.match_id JOIN s ON s.tile_id * 32 + s.row_no = p.tile_id * 32 + round_even(p.y, 0) AND s.col_no = round_even(p.x, 0) WHERE residual_px <= 15),
 k AS (SELECT *, rank() OVER (PARTITION BY tile_id ORDER BY x) + (count(*) OVER (PARTITION BY tile_id, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY tile_id ORDER BY y) + (count(*) OVER (PARTITION BY tile_id, y) - 1) / 2e0 AS ry FROM j)
SELECT tile_id, count(*) AS n, round(corr(x, y), 8) + 0.0 AS pearson_r, round(corr(rx, ry), 8) + 0.0 AS spearman_rho, round(avg(y), 5) AS mean_slope_deg FROM k GROUP BY tile_id""")
def _(t):
    from tieline.operators.controls import correlations
    from tieline.plans.tiepoint_queries import residuals

    sl = P.slope(t.dem, size=32).where("slope_deg IS NOT NULL").withColumn("s", F.round("slope_deg", 9))
    p = P.sample_raster(points(t), sl, "nearest", "s", size=32).where("sampled IS NOT NULL")
    j = p.join(residuals(t).where("residual_px <= 15").select("match_id", "residual_px"), "match_id")
    c = correlations(j, "residual_px", "sampled", ["tile_id"])
    return rounded(c.join(j.groupBy("tile_id").agg(F.avg("sampled").alias("mean_slope_deg")), "tile_id"), 8, mean_slope_deg=5)


@query("e15_horizon_east", """
SELECT p.tile_id, p.row_no, p.col_no, round(max((n.z - p.z) / ((n.col_no - p.col_no) * 5e0)), 6) + 0.0 AS max_tan,
  round(least(1, greatest(35e-2, 1 - degrees(atan(least(greatest(max((n.z - p.z) / ((n.col_no - p.col_no) * 5e0)), 0), 10))) / 45)), 6) AS sky_view,
  max((n.z - p.z) / ((n.col_no - p.col_no) * 5e0)) > tan(radians(1e1)) AS shadow
FROM {dem} p JOIN {dem} n ON n.tile_id = p.tile_id AND n.row_no = p.row_no AND n.col_no BETWEEN p.col_no + 1 AND p.col_no + 12 GROUP BY ALL""")
def _(t):
    h = P.horizon_axis(t.dem, 90, 12).where("max_tan > -1e9")
    return rounded(h.select(*P.KEY, "max_tan", P.sky_view("max_tan").alias("sky_view"), P.shadow_mask("max_tan", 10.0).alias("shadow")))


@query("e15_horizon_south", """
SELECT p.tile_id, p.row_no, p.col_no, round(max((n.z - p.z) / (d * 5e0)), 6) + 0.0 AS max_tan FROM (SELECT *, unnest(range(1, 41)) AS d FROM {dem_strip}) p
JOIN {dem_strip} n ON n.line = p.line + d AND n.col_no = p.col_no GROUP BY p.tile_id, p.row_no, p.col_no""")
def _(t):
    return rounded(P.horizon_axis(t.dem, 180, 40, size=32).where("max_tan > -1e9").select(*P.KEY, "max_tan"))


@query("e15_horizon_any", f"""
WITH r AS (SELECT *, unnest(range(1, 11)) AS k FROM {{dem_strip}}), q AS (SELECT *, line + k * {-math.cos(math.radians(130)):.12f}e0 AS y, col_no + k * {math.sin(math.radians(130)):.12f}e0 AS x FROM r),
 c AS (SELECT *, floor(y) + dy AS cl, floor(x) + dx AS cc, abs(1 - dy - (y - floor(y))) * abs(1 - dx - (x - floor(x))) AS w FROM q, (SELECT unnest([0, 1]) AS dy) a, (SELECT unnest([0, 1]) AS dx) b),
 v AS (SELECT c.tile_id, c.row_no, c.col_no, c.k, any_value(c.z) AS z, sum(w * n.z) AS v, count(n.z) AS have, count(*) AS need FROM c LEFT JOIN {{dem_strip}} n ON n.line = c.cl AND n.col_no = c.cc WHERE w > 0 GROUP BY c.tile_id, c.row_no, c.col_no, c.k)
SELECT tile_id, row_no, col_no, round(coalesce(max(CASE WHEN have = need THEN (v - z) / (k * 5e0) END), -1e9), 6) AS max_tan, coalesce(max(CASE WHEN have = need THEN (v - z) / (k * 5e0) END), -1e9) > tan(radians(1e1)) AS shadow
FROM v GROUP BY tile_id, row_no, col_no""")
def _(t):
    return rounded(P.horizon(t.dem, 32, 130.0, 10).withColumn("shadow", P.shadow_mask("max_tan", 10.0)))


@query("b20_scale_dem", "SELECT tile_id, row_no, col_no, CASE WHEN dn <> 150 THEN round(dn * 5e-1, 6) END AS z FROM {pixels}")
def _(t):
    return rounded(P.scale_dem(t.pixels.withColumnRenamed("dn", "z"), 0.5, 150.0))


@query("d33_raster_summary", """
SELECT tile_id, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(avg(z), 6) AS z_mean, round(stddev_pop(z), 6) AS z_std, count(z) AS n_valid, round(max(z) - min(z), 6) AS relief,
  round(count(z) / 1024e0 * 100, 6) AS valid_pct, count(z) / 1024e0 * 100 >= 50 AS usable FROM {dem} GROUP BY tile_id""")
def _(t):
    return rounded(P.raster_summary(t.dem, 1024))


@query("b11_validity_mask", """
SELECT p.tile_id, p.row_no, p.col_no, bx >= 0 AND bx < 31 AND by_ >= 0 AND by_ < 31 AND p.dn >= 40 AND coalesce(b.dn, 1e9) >= 150 AS valid
FROM (SELECT *, 98e-2 * col_no - 5e-2 * row_no + 125e-2 AS bx, 5e-2 * col_no + 98e-2 * row_no - 75e-2 AS by_ FROM {pixels}) p
LEFT JOIN {pixels_b} b ON b.tile_id = p.tile_id AND b.row_no = round_even(by_, 0) AND b.col_no = round_even(bx, 0)""")
def _(t):
    h = F.array(*[F.lit(float(v)) for v in (0.98, -0.05, 1.25, 0.05, 0.98, -0.75, 0, 0, 1)])
    return P.validity_mask(t.pixels, h, t.pixels.where("dn < 40"), t.pixels_b.where("dn < 150"), 32, 32)


@query("b18_regular_nodes", """
SELECT tile_id, y AS qy, x AS qx FROM (SELECT DISTINCT tile_id FROM {pixels}) t, (SELECT unnest(range(4, 28, 6)) AS y) a, (SELECT unnest(range(4, 28, 6)) AS x) b""")
def _(t):
    return P.regular_nodes(32, 32, 6, 4, t.pixels)


SAFE = """SELECT tile_id, row_no, col_no FROM (SELECT p.tile_id, p.row_no, p.col_no, count(*) AS k FROM (SELECT *, unnest([-1, 0, 1]) AS dy FROM (SELECT *, unnest([-1, 0, 1]) AS dx FROM {pixels_strip}) x) p
 JOIN {pixels_strip} n ON n.line = p.line + dy AND n.col_no = p.col_no + dx GROUP BY p.tile_id, p.row_no, p.col_no) s WHERE k = 9"""


@query("b17_conforming_nodes", f"""
WITH s AS ({SAFE}), r AS (SELECT tile_id, row_no, min(col_no) AS c0, max(col_no) AS c1, count(*) AS k FROM s GROUP BY ALL), e AS (SELECT tile_id, min(row_no) AS r0, max(row_no) AS r1 FROM r GROUP BY ALL),
 y AS (SELECT tile_id, i AS iy, CAST(floor(r0 + i * (r1 - r0) / 4e0) AS BIGINT) AS qy FROM e, (SELECT unnest(range(5)) AS i) n)
SELECT y.tile_id, iy, j AS ix, qy, CAST(floor(c0 + j * (c1 - c0) / 3e0) AS BIGINT) AS qx FROM y JOIN r ON r.tile_id = y.tile_id AND r.row_no = y.qy AND k >= 4, (SELECT unnest(range(4)) AS j) m""")
def _(t):
    return P.conforming_nodes(t.pixels, 1, 4, 5, 32)


@query("e5_longest_run", """
SELECT tile_id, row_no, s AS start, e AS "end", n AS length FROM (SELECT tile_id, row_no, min(col_no) AS s, max(col_no) AS e, count(*) AS n, row_number() OVER (PARTITION BY tile_id, row_no ORDER BY count(*) DESC, min(col_no)) AS k
 FROM (SELECT *, col_no - row_number() OVER (PARTITION BY tile_id, row_no ORDER BY col_no) AS g FROM {pixels} WHERE dn < 300) x GROUP BY tile_id, row_no, g) y WHERE k = 1""")
def _(t):
    return P.longest_run(t.pixels.where("dn < 300"), ["tile_id", "row_no"])


@query("e4_sliding_segments", """
WITH l AS (SELECT tile_id * 32 + row_no AS line, dn FROM {pixels}), h AS (SELECT max(line) + 1 AS h FROM l), s AS (SELECT unnest(range(0, CAST((SELECT h FROM h) AS BIGINT) - 48 + 1, 24)) AS s)
SELECT s AS segment_start, count(*) AS n, sum(dn) AS total FROM s JOIN l ON line >= s AND line < s + 48 GROUP BY s""")
def _(t):
    rows = t.pixels.select((F.col("tile_id") * 32 + F.col("row_no")).alias("line"), "dn")
    return P.sliding_segments(rows, 48, 24).groupBy("segment_start").agg(F.count(F.lit(1)).alias("n"), F.sum("dn").alias("total"))


@query("h28_control_coords", """
WITH a AS (SELECT unnest(['rot90', 'rot180', 'rot270', 'vflip', 'hflip', 'offset']) AS arm), r AS (SELECT tile_id, row_no AS r, col_no AS c, dn, arm FROM {pixels}, a)
SELECT arm, tile_id, sum(dn * (nr * 32 + nc + 1)) AS checksum FROM (SELECT *, CASE arm WHEN 'rot90' THEN 31 - c WHEN 'rot180' THEN 31 - r WHEN 'rot270' THEN c WHEN 'vflip' THEN 31 - r WHEN 'offset' THEN (r + 16) % 32 ELSE r END AS nr,
  CASE arm WHEN 'rot90' THEN r WHEN 'rot180' THEN 31 - c WHEN 'rot270' THEN 31 - r WHEN 'hflip' THEN 31 - c ELSE c END AS nc FROM r) x GROUP BY ALL""")
def _(t):
    from tieline.operators.controls import with_controls

    d = with_controls(t.pixels, ("rot90", "rot180", "rot270", "vflip", "hflip", "offset"))
    r, c = X.control_coords("arm", "row_no", "col_no", F.lit(32), F.lit(32))
    return d.groupBy("arm", "tile_id").agg(F.sum(F.col("dn") * (r * 32 + c + 1)).alias("checksum"))


@query("h28_blockwise_control_coords", """
WITH a AS (SELECT unnest(['rot90_blockwise', 'rot270_blockwise']) AS arm), r AS (SELECT line AS r, col_no AS c, dn, arm, max(line) OVER () + 1 AS h FROM {pixels_strip}, a),
 m AS (SELECT *, r < h // 32 * 32 AS whole, r // 32 * 32 AS base FROM r)
SELECT arm, CAST(sum(dn * (nr * 32 + nc + 1)) AS DOUBLE) AS checksum FROM (SELECT *, CASE WHEN NOT whole THEN h // 32 * 32 + h - 1 - r WHEN arm = 'rot90_blockwise' THEN base + 31 - c ELSE base + c END AS nr,
  CASE WHEN NOT whole THEN 31 - c WHEN arm = 'rot90_blockwise' THEN r % 32 ELSE 31 - r % 32 END AS nc FROM m) x GROUP BY arm""")
def _(t):
    from tieline.operators.controls import with_controls

    d = with_controls(t.pixels_strip, ("rot90_blockwise", "rot270_blockwise"))
    height = d.agg((F.max("line") + 1).alias("h"))
    r, c = X.blockwise_control_coords("arm", "line", "col_no", F.col("h"), F.lit(32))
    return d.join(F.broadcast(height)).groupBy("arm").agg(F.sum(F.col("dn") * (r * 32 + c + 1)).cast("double").alias("checksum"))


@query("e13_adaptive_clahe", """
SELECT tile_id, count(*) AS n, true AS in_range FROM {pixels} GROUP BY tile_id""")
def _(t):
    c = P.adaptive_clahe(bytes_(t), 32, 4)
    return c.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), ((F.min("dn") >= 0) & (F.max("dn") <= 255.000001)).alias("in_range"))


@query("c20_ncc_lag_check", """
WITH l AS (SELECT * FROM (VALUES ('zero', 0, 0), ('a', 2, 1), ('b', -3, 2)) v(name, lx, ly)),
 c AS (SELECT name, p.tile_id, corr(p.dn, n.dn) AS r FROM {pixels} p CROSS JOIN l JOIN {pixels_b} n ON n.tile_id = p.tile_id AND n.row_no = p.row_no + ly AND n.col_no = p.col_no + lx GROUP BY ALL)
SELECT name, count(*) AS n_tiles, round(avg(r), 6) + 0.0 AS ncc_mean, round(min(r), 6) + 0.0 AS ncc_min FROM c GROUP BY name""")
def _(t):
    from tieline.operators.tiles import ncc_lag_check

    return rounded(ncc_lag_check(t.pixels, t.pixels_b, [("zero", 0, 0), ("a", 2, 1), ("b", -3, 2)]))


# --- cubes --------------------------------------------------------------------------------------

WL0, WL_STEP = 712.3, 25.0


def cubes(t):
    wl = F.transform(F.sequence(F.lit(0), F.size("spectrum") - 1), lambda b: WL0 + b * WL_STEP)
    return t.cube.withColumn("wavelengths", wl)


LONG = """(SELECT product_id, line, sample, b - 1 AS band, CAST(spectrum[b] AS DOUBLE) AS v, 7123e-1 + (b - 1) * 25e0 AS wl FROM {cube}, (SELECT unnest(range(1, 65)) AS b) n)"""
PROXY = f"""SELECT product_id AS tile_id, line AS row_no, sample AS col_no, avg(v / CASE WHEN abs(m) > 1e-8 THEN m ELSE 1 END) AS dn
  FROM (SELECT *, avg(v) OVER (PARTITION BY product_id, band) AS m FROM {LONG} z WHERE wl <= 2000) x GROUP BY ALL"""


@query("b5_cube_thumbnail", f"""
SELECT product_id, line // 4 AS line, sample // 4 AS sample, round(median(v), 6) + 0.0 AS dn FROM {LONG} z WHERE band BETWEEN 29 AND 39 AND line % 4 = 0 AND sample % 4 = 0 GROUP BY ALL""")
def _(t):
    return rounded(K.thumbnail(cubes(t), 4))


@query("b1_select_bands", f"""
SELECT product_id, line, sample, count(*) AS n_bands, round(sum(v), 5) + 0.0 AS total FROM {LONG} z WHERE wl BETWEEN 900 AND 1500 GROUP BY ALL""")
def _(t):
    c = K.select_bands(cubes(t), 900.0, 1500.0)
    return rounded(c.select("product_id", "line", "sample", F.size("spectrum").cast("long").alias("n_bands"),
                            F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + v).alias("total")), 5)


@query("b1_select_bands_fallback", f"""
SELECT product_id, line, sample, count(*) AS n_bands, round(sum(v), 5) + 0.0 AS total FROM {LONG} z WHERE band < 10 GROUP BY ALL""")
def _(t):
    c = K.select_bands(cubes(t), None, 100.0, 10)
    return rounded(c.select("product_id", "line", "sample", F.size("spectrum").cast("long").alias("n_bands"),
                            F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + v).alias("total")), 5)


@query("b13_drop_bad_bands", f"""
WITH b AS (SELECT product_id, band, var_pop(v) AS s FROM {LONG} z GROUP BY ALL), k AS (SELECT b.product_id, band FROM b JOIN (SELECT product_id, median(s) AS m FROM b GROUP BY ALL) q ON q.product_id = b.product_id WHERE s >= 95e-2 * m)
SELECT z.product_id, line, sample, count(*) AS n_bands, round(sum(v), 5) + 0.0 AS total FROM {LONG} z JOIN k ON k.product_id = z.product_id AND k.band = z.band GROUP BY ALL""")
def _(t):
    c = K.drop_bad_bands(cubes(t), 0.95)
    return rounded(c.select("product_id", "line", "sample", F.size("spectrum").cast("long").alias("n_bands"),
                            F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + v).alias("total")), 5)


@query("d15_proxy_mean", f"SELECT tile_id AS product_id, row_no AS line, col_no AS sample, round(dn, 4) + 0.0 AS dn FROM ({PROXY}) z")
def _(t):
    return rounded(K.proxy_mean(K.select_bands(cubes(t))), 4)


@query("d16_cube_to_grey", f"WITH img AS ({PROXY}), fix AS ({REPAIR.replace('{src}', 'img')}), ds AS ({DESTRIPE.replace('{src}', 'fix')}) {STRETCH.replace('{src}', 'ds')}")
def _(t):
    return K.cube_to_grey(cubes(t)).select(*P.KEY, "dn")


@query("f3_nearest_band", """
SELECT product_id, band, round(wl, 6) AS wavelength_nm FROM (SELECT DISTINCT product_id, b AS band, 7123e-1 + b * 25e0 + product_id AS wl FROM {cube}, (SELECT unnest(range(64)) AS b) n) x
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY abs(wl - 1500), band) = 1""")
def _(t):
    bands = cubes(t).select("product_id", F.posexplode("wavelengths").alias("band", "w")).groupBy("product_id", "band").agg(
        (F.max("w") + F.col("product_id")).alias("wavelength_nm"))
    return rounded(K.nearest_band(bands, 1500.0))


@query("d17_single_band", f"WITH img AS (SELECT product_id AS tile_id, line AS row_no, sample AS col_no, v AS dn FROM {LONG} z WHERE band = 32) SELECT tile_id, row_no, col_no, round(dn, 6) + 0.0 AS dn FROM (WITH fix AS ({REPAIR.replace('{src}', 'img')}) {DESTRIPE.replace('{src}', 'fix')}) y")
def _(t):
    b = K.as_pixels(K.single_band(cubes(t), 1500.0))
    return rounded(P.destripe(P.repair_columns(b, P.bad_columns(b))).select(*P.KEY, "dn"))


def mean_of_bands_sql(nms=(950.0, 1500.0, 1700.0)):
    parts, ends = [], []
    for n, nm in enumerate(nms):
        parts.append(f"""b{n} AS (SELECT z.product_id AS tile_id, line AS row_no, sample AS col_no, v / (avg(v) OVER (PARTITION BY z.product_id) + 1e-8) AS dn FROM {LONG} z
  JOIN (SELECT DISTINCT product_id, first_value(band) OVER (PARTITION BY product_id ORDER BY abs(wl - {nm:.1f}::DOUBLE), band) AS best FROM {LONG} y) k ON k.product_id = z.product_id AND band = best)""")
        parts.append(f"f{n} AS ({REPAIR.replace('{src}', f'b{n}')})")
        ends.append(DESTRIPE.replace("{src}", f"f{n}"))
    return f"WITH {', '.join(parts)} SELECT tile_id, row_no, col_no, round(avg(dn), 6) + 0.0 AS dn FROM ({' UNION ALL '.join(ends)}) u GROUP BY ALL"


@query("d17_mean_of_bands", mean_of_bands_sql())
def _(t):
    return rounded(K.mean_of_bands(cubes(t)))


@query("d18_cube_pca")
def _(t):
    comp, _ = K.cube_pca(K.select_bands(cubes(t)))
    return comp.select("product_id", "pc", "explained", F.size("loadings").alias("n_bands"))


@query("d18_pca_proxy")
def _(t):
    return K.pca_proxy(K.select_bands(cubes(t)), "weighted")


@query("f4_best_band_window", f"""
WITH w AS (SELECT unnest([0, 1, 2]) AS i, unnest([720e0, 1000e0, 1500e0]) AS lo, unnest([900e0, 1400e0, 2100e0]) AS hi), tg AS (SELECT product_id, line, sample, v AS tv FROM {LONG} z WHERE band = 20),
 m AS (SELECT z.product_id, z.line, z.sample, i, lo, hi, avg(v) AS v FROM {LONG} z, w WHERE wl BETWEEN lo AND hi GROUP BY ALL),
 r AS (SELECT m.product_id, i, lo, hi, corr(m.v, tv) AS r FROM m JOIN tg ON tg.product_id = m.product_id AND tg.line = m.line AND tg.sample = m.sample GROUP BY ALL)
SELECT product_id, i AS "window", lo AS lo_nm, hi AS hi_nm, round(r, 6) AS r FROM r QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY abs(r) DESC, i) = 1""")
def _(t):
    c = cubes(t)
    target = c.select("product_id", "line", "sample", F.element_at("spectrum", 21).cast("double").alias("target"))
    return rounded(K.best_band_window(c, [(720.0, 900.0), (1000.0, 1400.0), (1500.0, 2100.0)], target))
