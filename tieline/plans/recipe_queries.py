"""Registered queries of the preprocessing recipes and of scale alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.operators import pixels as P, recipes as R
from tieline.plans.pixel_queries import K5, blur_sql, bytes_
from tieline.plans.tiepoint_queries import rounded
from tieline.registry import query


def kernel_sql(kernel):
    return "[" + ", ".join(f"CAST({k!r} AS DOUBLE)" for k in kernel) + "]"


RAW = "raw AS (SELECT tile_id, row_no, col_no, tile_id * 32 + row_no AS line, {dn} AS dn FROM {{pixels}})"
BYTES, COUNTS = RAW.format(dn="dn % 256"), RAW.format(dn="dn")
UNIT = "unit AS (SELECT tile_id, row_no, col_no, line, dn / {full} AS dn FROM raw)"


def bilateral_ctes(src, out, sigma_value, sigma_space, flat=None):
    near = "dy * dy + dx * dx <= 4"
    w = f"exp(-(dy * dy + dx * dx) / {2 * sigma_space ** 2!r} - (q.dn - p.dn) * (q.dn - p.dn) / {2 * sigma_value ** 2!r})"
    value = "f" if flat is None else f"v * (1 - greatest(0, least(1, ({flat!r} - greatest(0, s2 / n - (s / n) * (s / n))) / {flat!r}))) + f * greatest(0, least(1, ({flat!r} - greatest(0, s2 / n - (s / n) * (s / n))) / {flat!r}))"
    return f"""{out} AS (SELECT tile_id, row_no, col_no, line, {value} AS dn FROM (
  SELECT p.tile_id, p.row_no, p.col_no, p.line, any_value(p.dn) AS v, count(*) * 1e0 AS n, sum(q.dn) AS s, sum(q.dn * q.dn) AS s2,
    sum(CASE WHEN {near} THEN {w} * q.dn END) / sum(CASE WHEN {near} THEN {w} END) AS f
  FROM (SELECT z.*, dy, dx FROM {src} z, (SELECT unnest(range(-2, 3)) AS dy) a, (SELECT unnest(range(-2, 3)) AS dx) b) p
  JOIN {src} q ON q.line = p.line + dy AND q.col_no = p.col_no + dx GROUP BY p.tile_id, p.row_no, p.col_no, p.line) g)"""


def equalise_ctes(src, out, parts, size=32):
    """Contrast-limited equalisation of `src` with the limits of the table `lim` (tile_id, clip)."""
    step = f"{size / parts!r}"
    return f"""
 h AS (SELECT tile_id, floor(row_no / {step}) AS ty, floor(col_no / {step}) AS tx, CAST(dn AS INT) AS v, count(*) AS c FROM {src} GROUP BY ALL),
 e AS (SELECT tile_id, ty, tx, n, greatest(1e0, clip * n / 256) AS lim FROM (SELECT tile_id, ty, tx, sum(c) AS n FROM h GROUP BY ALL) t JOIN lim USING (tile_id)),
 x AS (SELECT e.tile_id, e.ty, e.tx, n, lim, sum(greatest(c - lim, 0)) AS ex FROM h JOIN e ON e.tile_id = h.tile_id AND e.ty = h.ty AND e.tx = h.tx GROUP BY ALL),
 f AS (SELECT x.*, g.v, least(coalesce(c, 0), lim) + ex / 256 AS mass FROM x CROSS JOIN (SELECT unnest(range(256)) AS v) g LEFT JOIN h ON h.tile_id = x.tile_id AND h.ty = x.ty AND h.tx = x.tx AND h.v = g.v),
 l AS (SELECT tile_id, ty, tx, v, sum(mass) OVER (PARTITION BY tile_id, ty, tx ORDER BY v) * 255 / n AS lut FROM f),
 k AS (SELECT p.*, CAST(dn AS INT) AS v, dy, dx, (row_no + 5e-1) / {step} - 5e-1 AS fy, (col_no + 5e-1) / {step} - 5e-1 AS fx FROM {src} p, (SELECT unnest([0, 1]) AS dy) a, (SELECT unnest([0, 1]) AS dx) b),
 w AS (SELECT *, least(greatest(floor(fy) + dy, 0), {parts - 1}) AS ty, least(greatest(floor(fx) + dx, 0), {parts - 1}) AS tx,
        (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM k),
 {out} AS (SELECT w.tile_id, row_no, col_no, line, sum(w * lut) / sum(w) AS dn FROM w JOIN l ON l.tile_id = w.tile_id AND l.ty = w.ty AND l.tx = w.tx AND l.v = w.v WHERE w > 0 GROUP BY ALL)"""


def stretch_cte(src, out, lo, hi):
    return f"""{out} AS (SELECT tile_id, row_no, col_no, line, CASE WHEN q[2] - q[1] > 1e-6 THEN floor(least(255, greatest(0, (dn - q[1]) / (q[2] - q[1]) * 255))) ELSE 0 END AS dn
  FROM {src} p JOIN (SELECT tile_id AS tid, quantile_cont(dn, [{lo!r}, {hi!r}]) AS q FROM {src} GROUP BY tile_id) s ON tid = tile_id)"""


def counts_cte(src, out, lo, hi, dark="q[1]"):
    return f"""{out} AS (SELECT tile_id, count(*) AS n_cells, any_value(q[2] - q[1]) AS dynamic_range, avg(CASE WHEN dn < {dark} THEN 1e0 ELSE 0 END) AS shadow_fraction,
    avg(CASE WHEN dn > q[2] THEN 1e0 ELSE 0 END) AS saturation_fraction
  FROM {src} p JOIN (SELECT tile_id AS tid, quantile_cont(dn, [{lo!r}, {hi!r}]) AS q FROM {src} GROUP BY tile_id) s ON tid = tile_id GROUP BY tile_id)"""


STATS = """
 bins AS (SELECT tile_id, least(255, floor(dn * 256)) AS b, count(*) AS c FROM img GROUP BY ALL),
 ent AS (SELECT tile_id, -sum(c / n * log2(c / n)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY tile_id) AS n FROM bins) x GROUP BY tile_id),
 st AS (SELECT img.tile_id, count(*) AS n, avg(dn) AS mean, avg(CASE WHEN dn < 5e-2 THEN 1e0 ELSE 0 END) AS shadow_fraction, avg(CASE WHEN dn > 95e-2 THEN 1e0 ELSE 0 END) AS saturation_fraction,
    any_value(entropy) AS entropy, stddev_pop(dn) / (avg(dn) + 1e-6) AS contrast FROM img JOIN ent ON ent.tile_id = img.tile_id GROUP BY img.tile_id)"""
STAT_COLUMNS = ["n", "mean", "shadow_fraction", "saturation_fraction", "entropy", "contrast"]
STAT_SQL = ", ".join(["n", *[f"round({c}, 5) + 0.0 AS {c}" for c in STAT_COLUMNS[1:]]])


def with_image(image, report, columns):
    """Report columns beside mean and deviation of the image."""
    seen = image.groupBy("tile_id").agg(F.avg("dn").alias("image_mean"), F.stddev_pop("dn").alias("image_std"))
    return rounded(report.join(seen, "tile_id").select("tile_id", *columns, "image_mean", "image_std", F.array_join("steps", " ").alias("steps")), 5)


SEEN = "SELECT tile_id, avg(dn) AS m, stddev_pop(dn) AS s FROM img GROUP BY tile_id"


@query("i7_denoise_bilateral", f"""
WITH {BYTES}, {bilateral_ctes('raw', 'img', 30.0, 30.0)} SELECT tile_id, row_no, col_no, round(dn, 5) AS dn FROM img""")
def _(t):
    return rounded(R.denoise(bytes_(t).select(*P.KEY, "dn"), 30.0, 30.0, size=32), 5)


@query("i7_denoise_flat", f"""
WITH {BYTES}, {UNIT.format(full='255e0')}, {bilateral_ctes('unit', 'img', 0.1, 5.0, 0.005)} SELECT tile_id, row_no, col_no, round(dn, 7) AS dn FROM img""")
def _(t):
    return rounded(R.denoise_flat(R.to_unit(bytes_(t), 8), size=32), 7)


@query("q8_ohrc_base", f"""
WITH {BYTES}, {UNIT.format(full='255e0')}, {bilateral_ctes('unit', 'calm', 0.1, 5.0, 0.005)},
 lim AS (SELECT tile_id, CASE WHEN s < 1e-1 THEN 4e0 WHEN s > 25e-2 THEN 15e-1 ELSE 25e-1 END AS clip FROM (SELECT tile_id, stddev_pop(dn) AS s FROM calm GROUP BY tile_id) z),
 whole AS (SELECT tile_id, row_no, col_no, line, floor(round(least(1, greatest(0, dn)) * 255, 6)) AS dn FROM calm), {equalise_ctes('whole', 'even', 16)},
 ev AS (SELECT tile_id, row_no, col_no, line, dn / 255e0 AS dn FROM even), bl AS ({blur_sql('ev', kernel_sql(P.gaussian_kernel(1.0)), 4)}),
 img AS (SELECT ev.tile_id, ev.row_no, ev.col_no, round(least(1, greatest(0, ev.dn + 3e-1 * (ev.dn - bl.dn))), 9) AS dn FROM ev JOIN bl ON bl.tile_id = ev.tile_id AND bl.row_no = ev.row_no AND bl.col_no = ev.col_no), {STATS}
SELECT tile_id, {STAT_SQL}, clip AS clip_limit,
  round(greatest(0, least(1, 1 - CASE WHEN shadow_fraction > 6e-1 THEN 5e-1 * (shadow_fraction - 6e-1) / 4e-1 ELSE 0 END - CASE WHEN saturation_fraction > 2e-1 THEN 5e-1 * (saturation_fraction - 2e-1) / 8e-1 ELSE 0 END)), 5) + 0.0 AS confidence,
  'unit_scale denoise_flat clip_limit=' || printf('%.2f', clip) || ' equalise sharpen report' AS steps
FROM st JOIN lim USING (tile_id)""")
def _(t):
    _, report = R.ohrc_base(bytes_(t), 32)
    return rounded(report.select("tile_id", *STAT_COLUMNS, "clip_limit", "confidence", F.array_join("steps", " ").alias("steps")), 5)


HALF = P.gaussian_kernel(0.5)


def tmc2_base_sql(equalised):
    wide = """wide AS (SELECT tile_id, row_no, col_no, line, least(1, greatest(0, CASE WHEN q[2] > q[1] THEN (dn - q[1]) / (q[2] - q[1]) ELSE dn END)) AS dn
  FROM unit JOIN (SELECT tile_id AS tid, quantile_cont(dn, [0.02, 0.98]) AS q FROM unit GROUP BY tile_id) s ON tid = tile_id)"""
    even = """, whole AS (SELECT tile_id, row_no, col_no, line, floor(round(dn * 255, 6)) AS v FROM wide), hh AS (SELECT tile_id, v, count(*) AS c FROM whole GROUP BY ALL),
 cd AS (SELECT *, sum(c) OVER (PARTITION BY tile_id ORDER BY v) AS cdf, sum(c) OVER (PARTITION BY tile_id) AS n FROM hh), lu AS (SELECT *, min(cdf) OVER (PARTITION BY tile_id) AS m FROM cd),
 eq AS (SELECT whole.tile_id, row_no, col_no, line, CASE WHEN n > m THEN round_even((cdf - m) / (n - m) * 255, 0) ELSE lu.v END / 255e0 AS dn FROM whole JOIN lu ON lu.tile_id = whole.tile_id AND lu.v = whole.v)"""
    return f"""
WITH {COUNTS}, {UNIT.format(full='65535e0')}, {wide}{even if equalised else ''},
 img AS (SELECT tile_id, row_no, col_no, round(least(1, greatest(0, dn)), 9) AS dn FROM ({blur_sql('eq' if equalised else 'wide', kernel_sql(HALF), len(HALF) // 2)}) b), {STATS}
SELECT tile_id, {STAT_SQL}, 1 - CASE WHEN contrast < 5e-2 THEN 5e-1 ELSE 0 END - CASE WHEN saturation_fraction > 3e-1 THEN 3e-1 ELSE 0 END AS confidence,
  'unit_scale stretch {'equalise ' if equalised else ''}smooth report' AS steps FROM st"""


@query("q8_tmc2_base", tmc2_base_sql(False))
def _(t):
    _, report = R.tmc2_base(t.pixels, 32)
    return rounded(report.select("tile_id", *STAT_COLUMNS, "confidence", F.array_join("steps", " ").alias("steps")), 5)


@query("q8_tmc2_base_equalised", tmc2_base_sql(True))
def _(t):
    _, report = R.tmc2_base(t.pixels, 32, equalise=True)
    return rounded(report.select("tile_id", *STAT_COLUMNS, "confidence", F.array_join("steps", " ").alias("steps")), 5)


COUNT_COLUMNS = ["n_cells", "dynamic_range", "shadow_fraction", "saturation_fraction", "clip_limit"]
COUNT_SQL = "n_cells, round(dynamic_range, 5) AS dynamic_range, round(shadow_fraction, 5) + 0.0 AS shadow_fraction, round(saturation_fraction, 5) + 0.0 AS saturation_fraction"


@query("q8_ohrc_calibrated", f"""
WITH {BYTES}, {counts_cte('raw', 'rep', 0.05, 0.95, '1275e-2')}, lim AS (SELECT tile_id, CASE WHEN dynamic_range < 30 THEN 6e0 WHEN shadow_fraction > 3e-1 THEN 45e-1 ELSE 3e0 END AS clip FROM rep),
 {bilateral_ctes('raw', 'calm', 30.0, 30.0)}, whole AS (SELECT tile_id, row_no, col_no, line, floor(round(dn + 5e-1, 6)) AS dn FROM calm), {equalise_ctes('whole', 'even', 16)},
 img AS (SELECT tile_id, round(dn / 255e0, 9) AS dn FROM even)
SELECT tile_id, {COUNT_SQL}, clip AS clip_limit, round(m, 5) AS image_mean, round(s, 5) AS image_std, 'denoise equalise unit_scale' AS steps FROM rep JOIN lim USING (tile_id) JOIN ({SEEN}) z USING (tile_id)""")
def _(t):
    return with_image(*R.ohrc_calibrated(bytes_(t), 32), COUNT_COLUMNS)


@query("q8_tmc2_calibrated", f"""
WITH {COUNTS}, {counts_cte('raw', 'rep', 0.01, 0.99)}, lim AS (SELECT tile_id, 25e-1 AS clip FROM rep), {stretch_cte('raw', 'whole', 0.01, 0.99)}, {equalise_ctes('whole', 'even', 32)},
 img AS (SELECT tile_id, round(dn / 255e0, 9) AS dn FROM ({blur_sql('even', '[25e-2, 5e-1, 25e-2]', 1)}) b)
SELECT tile_id, {COUNT_SQL}, clip AS clip_limit, round(m, 5) AS image_mean, round(s, 5) AS image_std, 'stretch equalise smooth unit_scale' AS steps FROM rep JOIN lim USING (tile_id) JOIN ({SEEN}) z USING (tile_id)""")
def _(t):
    return with_image(*R.tmc2_calibrated(t.pixels, 32), COUNT_COLUMNS)


@query("q8_iirs_calibrated", """
WITH band AS (SELECT product_id AS tile_id, line AS row_no, sample AS col_no, CAST(spectrum[24] AS DOUBLE) AS dn FROM {cube}), raw AS (SELECT *, tile_id * 32 + row_no AS line FROM band), """
       + f"""{counts_cte('raw', 'rep', 0.02, 0.98)}, lim AS (SELECT tile_id, 3e0 AS clip FROM rep), {stretch_cte('raw', 'whole', 0.02, 0.98)}, {equalise_ctes('whole', 'even', 8)},
 img AS (SELECT tile_id, round(dn / 255e0, 9) AS dn FROM even)
SELECT tile_id, {COUNT_SQL}, clip AS clip_limit, round(m, 5) AS image_mean, round(s, 5) AS image_std, 'stretch equalise unit_scale' AS steps FROM rep JOIN lim USING (tile_id) JOIN ({SEEN}) z USING (tile_id)""")
def _(t):
    """The band nearest to 1285 nm of every cube."""
    band = t.cube.select(F.col("product_id").alias("tile_id"), F.col("line").alias("row_no"), F.col("sample").alias("col_no"), F.col("spectrum")[23].cast("double").alias("dn"))
    return with_image(*R.iirs_calibrated(band, 32), COUNT_COLUMNS)


COMPACT_COLUMNS = ["n_cells", "dynamic_range", "shadow_fraction", "clip_limit"]
COMPACT_SQL = """SELECT tile_id, n_cells, round(dynamic_range, 5) AS dynamic_range, round(shadow, 5) + 0.0 AS shadow_fraction, clip AS clip_limit, round(m, 5) AS image_mean, round(s, 5) AS image_std
FROM rep JOIN lim USING (tile_id) JOIN (SELECT tile_id, avg(CASE WHEN dn < 15 THEN 1e0 ELSE 0 END) AS shadow, avg(dn) AS m, stddev_pop(dn) AS s FROM img GROUP BY tile_id) z USING (tile_id)"""


def compact_sql(raw, size):
    return f"""
WITH {raw}, {counts_cte('raw', 'rep', 0.01, 0.99)}, lim AS (SELECT tile_id, 3e0 AS clip FROM rep), {stretch_cte('raw', 'whole', 0.01, 0.99)}, {equalise_ctes('whole', 'even', 8, size)},
 img AS (SELECT tile_id, round(dn, 6) AS dn FROM even)
{COMPACT_SQL}"""


@query("q8_compact", compact_sql(COUNTS, 32))
def _(t):
    return with_image(*R.compact(t.pixels, 32), COMPACT_COLUMNS).drop("steps")


RESIZED = """SELECT tile_id, r AS row_no, c AS col_no, sum(wr * wc * dn) / sum(wr * wc) AS dn FROM (
  SELECT *, least((r + 1) * 1.6e0, row_no + 1) - greatest(r * 1.6e0, row_no) AS wr, least((c + 1) * 1.6e0, col_no + 1) - greatest(c * 1.6e0, col_no) AS wc
  FROM {pixels}, (SELECT unnest(range(20)) AS r) a, (SELECT unnest(range(20)) AS c) b
  WHERE (r + 1) * 1.6e0 - row_no > 1e-8 AND row_no + 1 - r * 1.6e0 > 1e-8 AND (c + 1) * 1.6e0 - col_no > 1e-8 AND col_no + 1 - c * 1.6e0 > 1e-8) o GROUP BY ALL"""


@query("i6_area_resize", f"SELECT tile_id, row_no, col_no, round(dn, 6) AS dn FROM ({RESIZED}) z")
def _(t):
    """32 cells to round(32 / 1.6) = 20, so that old cells are shared out over new ones."""
    return rounded(R.area_resize(t.pixels, 32, 1.6))


@query("q8_compact_synthetic", compact_sql("raw AS (SELECT tile_id, row_no, col_no, tile_id * 16 + row_no AS line, dn FROM (SELECT tile_id, CAST(floor(row_no / 2e0) AS BIGINT) AS row_no, CAST(floor(col_no / 2e0) AS BIGINT) AS col_no, avg(dn) AS dn FROM {pixels} GROUP BY ALL) b)", 16))
def _(t):
    """2.5 m reduced to 5 m before the compact recipe."""
    return with_image(*R.compact_synthetic_tmc2(t.pixels, 32, 2.5, 5.0), COMPACT_COLUMNS).drop("steps")


@query("i6_align_scales", f"""
WITH a AS ({blur_sql('{pixels_strip}', K5, 2)}), b AS (SELECT tile_id, CAST(row_no / 2e0 AS BIGINT) AS row_no, CAST(col_no / 2e0 AS BIGINT) AS col_no, dn FROM a WHERE row_no % 2 = 0 AND col_no % 2 = 0),
 c AS (SELECT *, tile_id * 16 + row_no AS line FROM b), d AS ({blur_sql('c', K5, 2)}),
 g AS (SELECT tile_id, row_no * 2 + i AS row_no, col_no * 2 + j AS col_no, least(greatest(row_no + (i + 5e-1) / 2 - 5e-1, 0), 31) AS y, least(greatest(col_no + (j + 5e-1) / 2 - 5e-1, 0), 31) AS x
   FROM {{pixels_b}}, (SELECT unnest([0, 1]) AS i) p, (SELECT unnest([0, 1]) AS j) q),
 s AS (SELECT g.tile_id, g.row_no, g.col_no, count(n.dn) AS k, count(*) AS need, sum(w * n.dn) AS v FROM (
   SELECT g.*, floor(y) + dy AS r, floor(x) + dx AS c, (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
   FROM g, (SELECT unnest([0, 1]) AS dy) u, (SELECT unnest([0, 1]) AS dx) v) g LEFT JOIN {{pixels_b}} n ON n.tile_id = g.tile_id AND n.row_no = g.r AND n.col_no = g.c WHERE w > 0 GROUP BY ALL)
SELECT 'fine' AS image, 25e-2 AS scale, tile_id, CAST(row_no / 2e0 AS BIGINT) AS row_no, CAST(col_no / 2e0 AS BIGINT) AS col_no, round(dn, 6) AS dn FROM d WHERE row_no % 2 = 0 AND col_no % 2 = 0
UNION ALL SELECT 'coarse', 2e0, tile_id, row_no, col_no, round(CASE WHEN k = need THEN v END, 6) FROM s""")
def _(t):
    """A spacing ratio of 0.22: the level of a quarter is closest; the coarse image is doubled."""
    fine, coarse = R.align_scales(t.pixels, t.pixels_b, 32, 0.22, upsample=2)
    return rounded(fine.withColumn("image", F.lit("fine")).unionByName(coarse.withColumn("image", F.lit("coarse"))).select("image", "scale", *P.KEY, "dn"))


@query("e13_adaptive_clahe_values", f"""
WITH {BYTES}, lim AS (SELECT tile_id, CASE WHEN s < 1e-1 THEN 4e0 WHEN s > 25e-2 THEN 15e-1 ELSE 2e0 END AS clip FROM (SELECT tile_id, stddev_pop(dn / 255e0) AS s FROM raw GROUP BY tile_id) z),
 {equalise_ctes('raw', 'img', 4)} SELECT tile_id, row_no, col_no, round(dn, 5) AS dn FROM img""")
def _(t):
    return rounded(P.adaptive_clahe(bytes_(t), 32, 4), 5)
