"""Registered queries of tile jobs, resampling and node surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.operators import controls as N, pixels as P, tiles as L
from tieline.plans.pixel_queries import SOB, blur_sql
from tieline.plans.tiepoint_queries import rounded
from tieline.registry import query

SURF = """nd AS (SELECT tile_id, y AS qy, x AS qx FROM (SELECT DISTINCT tile_id FROM {pixels}) t, (SELECT unnest(range(2, 30, 5)) AS y) a, (SELECT unnest(range(2, 30, 5)) AS x) b),
 tp AS (SELECT nd.*, p.row_no AS r, p.col_no AS c, p.dn AS s FROM nd JOIN {pixels} p ON p.tile_id = nd.tile_id AND p.row_no BETWEEN qy - 2 AND qy + 1 AND p.col_no BETWEEN qx - 2 AND qx + 1),
 ok AS (SELECT nd.tile_id, qy, qx FROM nd JOIN {pixels_b} p ON p.tile_id = nd.tile_id AND p.row_no BETWEEN qy - 4 AND qy + 3 AND p.col_no BETWEEN qx - 4 AND qx + 3 GROUP BY ALL HAVING count(*) = 64),
 sf AS (SELECT tile_id, qy, qx, ly, lx, CASE WHEN k IS NULL OR isnan(k) THEN 0 ELSE k END AS score FROM (SELECT tp.tile_id, tp.qy, tp.qx, ly, lx, corr(s, p.dn) AS k FROM tp JOIN ok ON ok.tile_id = tp.tile_id AND ok.qy = tp.qy AND ok.qx = tp.qx,
   (SELECT unnest(range(-2, 3)) AS ly) a, (SELECT unnest(range(-2, 3)) AS lx) b, {pixels_b} p WHERE p.tile_id = tp.tile_id AND p.row_no = r + ly AND p.col_no = c + lx GROUP BY ALL HAVING count(*) = 16) z),
 pk AS (SELECT tile_id, qy, qx, ly AS py, lx AS px, score AS peak FROM sf QUALIFY row_number() OVER (PARTITION BY tile_id, qy, qx ORDER BY round(score, 10) DESC, ly, lx) = 1),
 un AS (SELECT pk.tile_id, pk.qy, pk.qx, py, px, peak, coalesce(max(score) FILTER (abs(ly - py) > 1 OR abs(lx - px) > 1), -1) AS second, abs(py) = 2 OR abs(px) = 2 AS on_edge,
   max(score) FILTER (ly = py AND lx = px - 1) AS l, max(score) FILTER (ly = py AND lx = px + 1) AS r, max(score) FILTER (ly = py - 1 AND lx = px) AS u, max(score) FILTER (ly = py + 1 AND lx = px) AS d
   FROM pk JOIN sf ON sf.tile_id = pk.tile_id AND sf.qy = pk.qy AND sf.qx = pk.qx GROUP BY ALL)"""
SUB = """CASE WHEN NOT on_edge AND {a} - 2*peak + {b} < 0 THEN 5e-1 * ({a} - {b}) / ({a} - 2*peak + {b}) ELSE 0 END"""


def sub(a, b):
    return SUB.replace("{a}", a).replace("{b}", b)


def surface(t):
    nodes = P.regular_nodes(32, 32, 5, 2, t.pixels)
    s = L.correlation_surface(t.pixels, t.pixels_b, nodes, 2, 2)
    return s.withColumn("score", F.round("score", 10))


@query("e8_peak_uniqueness", f"WITH {SURF} SELECT tile_id, qy, qx, py AS peak_y, px AS peak_x, round(peak, 6) + 0.0 AS peak, round(second, 6) + 0.0 AS second, on_edge FROM un")
def _(t):
    return rounded(L.peak_uniqueness(surface(t), 1))


@query("e9_subpixel_peak", f"WITH {SURF} SELECT tile_id, qy, qx, round({sub('l', 'r')}, 5) + 0.0 AS sub_x, round({sub('u', 'd')}, 5) + 0.0 AS sub_y FROM un")
def _(t):
    s = surface(t)
    return rounded(L.subpixel_peak(s, L.peak_uniqueness(s, 1)).select("tile_id", "qy", "qx", "sub_x", "sub_y"), 5)


@query("i1_match_nodes_small", f"WITH {SURF} SELECT tile_id, qy, qx, py AS peak_y, px AS peak_x, round(peak, 6) + 0.0 AS peak, second < 9e-1 * peak AND peak >= 5e-1 AND NOT on_edge AS accepted FROM un")
def _(t):
    u = L.peak_uniqueness(surface(t), 1)
    ok = (F.col("second") < 0.9 * F.col("peak")) & (F.col("peak") >= 0.5) & ~F.col("on_edge")
    return rounded(u.select("tile_id", "qy", "qx", "peak_y", "peak_x", "peak", ok.alias("accepted")))


def moved(t, dx, dy):
    """The reference raster: the source moved by whole pixels along the strip (tiles follow each other)."""
    line = F.col("tile_id") * 32 + F.col("row_no") + dy
    return t.pixels_b.select(F.floor(line / 32).alias("tile_id"), (line % 32).alias("row_no"), (F.col("col_no") + dx).alias("col_no"), "dn").where("col_no BETWEEN 0 AND 31 AND tile_id >= 0")


FULL = "(SELECT tile_id FROM {pixels_b} GROUP BY tile_id HAVING count(*) = 1024)"


@query("i1_match_nodes", """
WITH r AS (SELECT line + 1 AS line, col_no + 1 AS col_no FROM {pixels_b_strip} WHERE col_no < 31),
 nd AS (SELECT tile_id, y AS qy, x AS qx, tile_id * 32 + y AS l FROM (SELECT DISTINCT tile_id FROM {pixels_b}) t, (SELECT unnest(range(5, 27, 6)) AS y) a, (SELECT unnest(range(5, 27, 6)) AS x) b),
 tp AS (SELECT nd.* FROM nd JOIN {pixels_b_strip} p ON p.line BETWEEN l - 5 AND l + 4 AND p.col_no BETWEEN qx - 5 AND qx + 4 GROUP BY ALL HAVING count(*) = 100)
SELECT tp.tile_id, qy, qx, 1e0 AS dx, 1e0 AS dy, 1e0 AS peak, false AS on_edge FROM tp JOIN r ON r.line BETWEEN l - 9 AND l + 8 AND r.col_no BETWEEN qx - 9 AND qx + 8 GROUP BY ALL HAVING count(*) = 324""")
def _(t):
    """The raster against itself moved by (1, 1): every node with a whole template and window finds the move."""
    n = L.match_nodes(t.pixels_b, moved(t, 1, 1), 32, 6, 5, 4)
    return n.select("tile_id", "qy", "qx", F.round(F.col("ref_x") - F.col("qx")).alias("dx"), F.round(F.col("ref_y") - F.col("qy")).alias("dy"), F.round("peak", 6).alias("peak"), "on_edge")


@query("i2_phase_correlation", f"""
SELECT tile_id, 2e0 AS dx, 1e0 AS dy, 57 AS n_cases FROM {FULL} f""")
def _(t):
    """Every whole tile against itself moved by (2, 1): the genuine shift beside all controls and 50 null draws."""
    full = t.pixels_b.groupBy("tile_id").count().where("count = 1024").select("tile_id")
    runs = L.phase_correlation(t.pixels_b, moved(t, 2, 1), 32, null_draws=50)
    def genuine(c):
        return F.round(F.max(F.when(F.col("arm") == "genuine", F.col(c)))) + 0.0
    return runs.groupBy("tile_id").agg(genuine("dx").alias("dx"), genuine("dy").alias("dy"), F.count(F.lit(1)).alias("n_cases")).join(full, "tile_id", "left_semi")


@query("i3_refine_matches", f"""
SELECT tile_id, match_id, 0e0 - ox AS shift_x, 0e0 - oy AS shift_y, sx + ox >= 7 AND sx + ox < 25 AND sy + oy >= 7 AND sy + oy < 25 AS refined
FROM (SELECT CAST(floor(o_orderkey / 1024e0) AS BIGINT) AS tile_id, o_orderkey AS match_id, (o_orderkey * 7919) % 2200 / 1e2 + 5 AS sx, (o_orderkey * 104729) % 2100 / 1e2 + 5 AS sy, o_orderkey % 3 - 1 AS ox, o_orderkey % 2 AS oy FROM {{orders}}) m
SEMI JOIN {FULL} f USING (tile_id) WHERE sx + ox >= 7 AND sx + ox < 25 AND sy + oy >= 7 AND sy + oy < 25""")
def _(t):
    """Matches whose reference side is off by whole pixels: the local search takes them back."""
    full = t.pixels_b.groupBy("tile_id").count().where("count = 1024").select("tile_id")
    inside = "rx >= 7 AND rx < 25 AND ry >= 7 AND ry < 25"
    r = L.refine_matches(tile_matches(t).join(full, "tile_id", "left_semi").where(inside), t.pixels_b, t.pixels_b, 32, 9, method="ncc", search=3)
    return r.select("tile_id", "match_id", (F.round("shift_x") + 0.0).alias("shift_x"), (F.round("shift_y") + 0.0).alias("shift_y"), "refined")


def tile_matches(t):
    k = F.col("o_orderkey")
    x, y = (k * 7919) % 2200 / 100.0 + 5, (k * 104729) % 2100 / 100.0 + 5
    return t.orders.select(F.floor(k / 1024).alias("tile_id"), k.alias("match_id"), x.alias("sx"), y.alias("sy"), (x + k % 3 - 1).alias("rx"), (y + k % 2).alias("ry"),
                           (((k * 29) % 100) / 100.0).alias("confidence"))


TM = """(SELECT CAST(floor(o_orderkey / 1024e0) AS BIGINT) AS tile_id, o_orderkey AS match_id, (o_orderkey * 7919) % 2200 / 1e2 + 5 AS sx, (o_orderkey * 104729) % 2100 / 1e2 + 5 AS sy, o_orderkey % 3 - 1 AS ox, o_orderkey % 2 AS oy,
  ((o_orderkey * 29) % 100) / 1e2 AS confidence FROM {orders})"""
NCC = """SELECT m.tile_id, m.match_id, any_value(m.confidence) AS confidence, CASE WHEN corr(a.{v}, b.{v}) IS NULL OR isnan(corr(a.{v}, b.{v})) THEN 0 ELSE corr(a.{v}, b.{v}) END AS ncc, count(*) AS n
 FROM {tm} m JOIN (SELECT unnest(range(-2, 3)) AS i) i ON true JOIN (SELECT unnest(range(-2, 3)) AS j) j ON true JOIN {src} a ON a.line = m.tile_id * 32 + round_even(sy, 0) + i AND a.col_no = round_even(sx, 0) + j
 JOIN {dst} b ON b.line = m.tile_id * 32 + round_even(sy + oy, 0) + i AND b.col_no = round_even(sx + ox, 0) + j GROUP BY m.tile_id, m.match_id HAVING count(*) = 25"""


def ncc_sql(src, dst, v):
    return NCC.replace("{tm}", TM).replace("{src}", src).replace("{dst}", dst).replace("{v}", v)


STRUCT = f"""sob AS (SELECT tile_id, row_no, col_no, sqrt(gx*gx + gy*gy) AS g FROM ({SOB}) z), su AS (SELECT tile_id, row_no, col_no, CASE WHEN hi - lo >= 1e-6 THEN (g - lo) / (hi - lo) ELSE 0 END AS s
 FROM (SELECT *, min(g) OVER (PARTITION BY tile_id) AS lo, max(g) OVER (PARTITION BY tile_id) AS hi FROM sob) x),
 sth AS (SELECT tile_id AS tid, avg(s) + 5e-1 * stddev_pop(s) AS th, max(s) AS mx FROM su GROUP BY tile_id),
 st AS (SELECT tile_id, row_no, col_no, tile_id * 32 + row_no AS line, CASE WHEN s >= th AND mx - th >= 1e-6 THEN (s - th) / (mx - th) ELSE 0e0 END AS structure FROM su JOIN sth ON tid = tile_id)"""


@query("d28_patch_ncc", f"SELECT m.tile_id, m.match_id, round(ncc, 6) + 0.0 AS ncc FROM {TM} m LEFT JOIN ({ncc_sql('{pixels_strip}', '{pixels_b_strip}', 'dn')}) n ON n.match_id = m.match_id")
def _(t):
    return rounded(L.patch_ncc(tile_matches(t), t.pixels, t.pixels_b, 2, size=32).select("tile_id", "match_id", "ncc"))


@query("d28_patch_ncc_summary", f"SELECT tile_id, count(*) AS n, round(avg(ncc), 6) + 0.0 AS mean_ncc, round(stddev_pop(ncc), 6) AS std_ncc FROM ({ncc_sql('{pixels_strip}', '{pixels_b_strip}', 'dn')}) n GROUP BY tile_id")
def _(t):
    n = L.patch_ncc(tile_matches(t), t.pixels, t.pixels_b, 2, size=32).where("ncc IS NOT NULL")
    return rounded(n.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ncc").alias("mean_ncc"), F.stddev_pop("ncc").alias("std_ncc")))


@query("i4_structural_verify", f"""
WITH {STRUCT}, n AS ({ncc_sql('st', 'st', 'structure')})
SELECT tile_id, match_id, round(ncc, 6) + 0.0 AS ncc, round(2 * confidence * ncc / greatest(confidence + ncc, 1e-6), 6) + 0.0 AS confidence FROM n WHERE ncc >= 2e-1""")
def _(t):
    return rounded(L.structural_verify(tile_matches(t), t.pixels, t.pixels, size=32).select("tile_id", "match_id", "ncc", "confidence"))


@query("i5_structure_composite")
def _(t):
    return rounded(L.structure_composite(t.pixels, 32))


@query("i14_phase_congruency", f"SELECT tile_id, 8 + tile_id % 16 AS line_col, true AS found, true AS in_range FROM {FULL} f")
def _(t):
    """A planted bright line one column wide: the largest moment of a row stands on it."""
    edge = 8 + F.col("tile_id") % 16
    full = t.pixels_b.groupBy("tile_id").count().where("count = 1024").select("tile_id")
    img = t.pixels_b.join(full, "tile_id", "left_semi").withColumn("dn", (F.col("row_no") * 7 + F.col("col_no") * 13) % 5 + F.when(F.col("col_no") == edge, 200.0).otherwise(0.0))
    c = L.phase_congruency(img, 32)
    best = c.where("col_no BETWEEN 3 AND 28 AND row_no BETWEEN 8 AND 23").groupBy("tile_id", "row_no").agg(F.max_by("col_no", "moment").alias("c"), F.max("pc").alias("hi"), F.min("pc").alias("lo"))
    near = F.count_if((F.col("c") - (8 + F.col("tile_id") % 16)).between(-1, 1)) >= 0.9 * F.count(F.lit(1))
    return best.groupBy("tile_id").agg(near.alias("found"), ((F.max("hi") <= 1) & (F.min("lo") >= 0)).alias("in_range")).select("tile_id", edge.alias("line_col"), "found", "in_range")


@query("i15_closure_check", f"SELECT tile_id, 1e0 AS dx, 0e0 AS dy, 1e0 AS shift_px FROM {FULL} f")
def _(t):
    """A product one column beside its reference: every whole tile shows that shift."""
    full = t.pixels_b.groupBy("tile_id").count().where("count = 1024").select("tile_id")
    c = L.closure_check(t.pixels_b, moved(t, 1, 0), 32, 0.9).join(full, "tile_id", "left_semi")
    return c.select("tile_id", *[(F.round(v) + 0.0).alias(v) for v in ("dx", "dy", "shift_px")])


LAT = """(SELECT CAST(floor(scan / 1e2) AS BIGINT) AS i, CAST(floor(pixel / 1e2) AS BIGINT) AS j, lat, lon FROM {geometry_a})"""


def source_points(t):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("match_id"), ((k * 31) % 4700 + 0.5).alias("line"), ((k * 17) % 3800 + 0.25).alias("sample"))


@query("c12_lattice_interpolate", f"""
WITH p AS (SELECT o_orderkey AS match_id, ((o_orderkey * 31) % 4700 + 5e-1) / 1e2 AS fy, ((o_orderkey * 17) % 3800 + 25e-2) / 1e2 AS fx FROM {{orders}}),
 k AS (SELECT match_id, CAST(floor(fy) AS BIGINT) + a AS i, CAST(floor(fx) AS BIGINT) + b AS j, (CASE a WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE b WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
   FROM p, (SELECT unnest([0, 1]) AS a) x, (SELECT unnest([0, 1]) AS b) y)
SELECT match_id, round(CASE WHEN count(lat) = count(*) THEN sum(w * lat) END, 9) AS lat, round(CASE WHEN count(lat) = count(*) THEN sum(w * lon) END, 9) AS lon FROM k LEFT JOIN {LAT} g ON g.i = k.i AND g.j = k.j WHERE w > 0 GROUP BY match_id""")
def _(t):
    return rounded(L.lattice_interpolate(source_points(t), t.geometry_a, 100, 100, ["lat", "lon"]).select("match_id", "lat", "lon"), 9)


BILINEAR = """SELECT {keys}, CASE WHEN count(n.dn) = count(*) THEN sum(w * n.dn) END AS v FROM (
  SELECT p.*, floor(y) + dy AS cl, floor(x) + dx AS cc, abs(1 - dy - (y - floor(y))) * abs(1 - dx - (x - floor(x))) AS w FROM {points} p, (SELECT unnest([0, 1]) AS dy) a, (SELECT unnest([0, 1]) AS dx) b) c
 LEFT JOIN {raster} n ON n.line = c.cl AND n.col_no = c.cc WHERE w > 0 GROUP BY {keys}"""


def bilinear_sql(points, raster, keys):
    """Value of a raster (line, col_no, dn) at points (y = product line, x), null where a corner is missing."""
    return BILINEAR.replace("{keys}", keys).replace("{points}", points).replace("{raster}", raster)


@query("c12_resample_to_grid", f"""
WITH p AS (SELECT o_orderkey AS match_id, ((o_orderkey * 31) % 4700 + 5e-1) / 1e2 AS fy, ((o_orderkey * 17) % 3800 + 25e-2) / 1e2 AS fx FROM {{orders}}),
 k AS (SELECT match_id, CAST(floor(fy) AS BIGINT) + a AS i, CAST(floor(fx) AS BIGINT) + b AS j, (CASE a WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE b WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
   FROM p, (SELECT unnest([0, 1]) AS a) x, (SELECT unnest([0, 1]) AS b) y),
 geo AS (SELECT match_id, CASE WHEN count(lat) = count(*) THEN sum(w * lat) END AS lat, CASE WHEN count(lat) = count(*) THEN sum(w * lon) END AS lon FROM k LEFT JOIN {LAT} g ON g.i = k.i AND g.j = k.j WHERE w > 0 GROUP BY match_id),
 pos AS (SELECT *, (lat + 6e1) * 300 AS y, (lon - 1e1) * 35 AS x FROM geo)
SELECT pos.match_id, round(lat, 9) AS lat, round(lon, 9) AS lon, round(v, 6) + 0.0 AS sampled FROM pos LEFT JOIN ({bilinear_sql('pos', '{pixels_strip}', 'match_id')}) s ON s.match_id = pos.match_id""")
def _(t):
    def to_pixel(lat, lon):
        row = (lat + 60.0) * 300
        return F.floor(row / 32).cast("bigint"), (lon - 10.0) * 35, row % 32

    r = L.resample_to_grid(source_points(t), t.geometry_a, 100, 100, t.pixels, to_pixel, 32)
    return rounded(r.select("match_id", "lat", "lon", "sampled"), 6, lat=9, lon=9)


GRID = "[" + ", ".join(f"{k!r}::DOUBLE" for k in P.gaussian_kernel(1.0)) + "]"


@query("c13_reference_grid", f"""
WITH b AS (SELECT *, tile_id * 32 + row_no AS line FROM ({blur_sql('{pixels_strip}', GRID, 4)}) z), g AS (SELECT tile_id, r AS row_no, c AS col_no, tile_id * 32 + (r + 5e-1) * 2 - 5e-1 AS y, (c + 5e-1) * 2 - 5e-1 AS x
   FROM (SELECT DISTINCT tile_id FROM {{pixels}}) t, (SELECT unnest(range(16)) AS r) a, (SELECT unnest(range(16)) AS c) d)
SELECT tile_id, row_no, col_no, round(coalesce(v, 0), 6) + 0.0 AS dn, v IS NOT NULL AS valid FROM ({bilinear_sql('g', 'b', 'c.tile_id, c.row_no, c.col_no')}) s""")
def _(t):
    return rounded(L.reference_grid(t.pixels, 32, 2.0))


@query("i13_warp", f"""
WITH g AS (SELECT tile_id, r AS row_no, c AS col_no, r - (-75e-2) AS qy, c - 15e-1 AS qx FROM (SELECT DISTINCT tile_id FROM {{pixels}}) t, (SELECT unnest(range(32)) AS r) a, (SELECT unnest(range(32)) AS c) d),
 p AS (SELECT tile_id, row_no, col_no, (101e-2 * qx + 2e-2 * qy) / (101e-2 * 101e-2 + 4e-4) AS x, tile_id * 32 + (101e-2 * qy - 2e-2 * qx) / (101e-2 * 101e-2 + 4e-4) AS y FROM g)
SELECT tile_id, row_no, col_no, round(v, 6) + 0.0 AS dn FROM ({bilinear_sql('p', '{pixels_strip}', 'c.tile_id, c.row_no, c.col_no')}) s""")
def _(t):
    return rounded(L.warp(t.pixels, 32, F.lit(1.01), F.lit(0.02), F.lit(1.5), F.lit(-0.75)))


@query("a19_rasterize_nodes", """
WITH b AS (SELECT run_id, ix, iy, max((peak, dx_sub, dy_sub)) AS m FROM {nodes} GROUP BY ALL)
SELECT r.run_id, x AS ix, y AS iy, dx_sub, dy_sub FROM (SELECT DISTINCT run_id FROM {nodes}) r, (SELECT unnest(range(16)) AS x) a, (SELECT unnest(range(70)) AS y) c
LEFT JOIN (SELECT run_id, ix, iy, peak, dx_sub, dy_sub FROM {nodes} QUALIFY row_number() OVER (PARTITION BY run_id, ix, iy ORDER BY peak DESC, dx_sub DESC, dy_sub DESC) = 1) b ON b.run_id = r.run_id AND b.ix = x AND b.iy = y""".replace("WITH b AS (SELECT run_id, ix, iy, max((peak, dx_sub, dy_sub)) AS m FROM {nodes} GROUP BY ALL)\n", "\n"))
def _(t):
    return L.rasterize_nodes(t.nodes, 16, 70, ["dx_sub", "dy_sub"])


@query("d32_geometry_offset", """
SELECT pair_id, round(median(dx), 6) + 0.0 AS median_dx, round(median(dy), 6) + 0.0 AS median_dy, round(median(n), 6) AS median_norm, round(quantile_cont(n, 0.05), 6) AS p5_norm, round(quantile_cont(n, 0.95), 6) AS p95_norm
FROM (SELECT pair_id, ref_x - src_x AS dx, ref_y - src_y AS dy, sqrt((ref_x - src_x)*(ref_x - src_x) + (ref_y - src_y)*(ref_y - src_y)) AS n FROM {residuals} WHERE residual_px <= 15) z GROUP BY pair_id""")
def _(t):
    from tieline.operators.dataset import geometry_offset
    from tieline.plans.tiepoint_queries import residuals

    return rounded(geometry_offset(residuals(t).where("residual_px <= 15")))


@query("d38_frame_jacobian", """
WITH f AS (SELECT tile_id, row_no, col_no, col_no * 47e-1 + (tile_id * 32 + row_no) * 2e-1 + dn / 1e3 AS mx, -(tile_id * 32 + row_no) * 46e-1 + dn / 2e3 AS my FROM {pixels})
SELECT f.tile_id, round(median(c.mx - f.mx), 6) AS map_x_dcol, round(median(r.mx - f.mx), 6) AS map_x_drow, round(median(c.my - f.my), 6) + 0.0 AS map_y_dcol, round(median(r.my - f.my), 6) AS map_y_drow
FROM f LEFT JOIN f c ON c.tile_id = f.tile_id AND c.row_no = f.row_no AND c.col_no = f.col_no + 1 LEFT JOIN f r ON r.tile_id * 32 + r.row_no = f.tile_id * 32 + f.row_no + 1 AND r.col_no = f.col_no GROUP BY f.tile_id""")
def _(t):
    line = F.col("tile_id") * 32 + F.col("row_no")
    f = t.pixels.withColumn("map_x", F.col("col_no") * 4.7 + line * 0.2 + F.col("dn") / 1e3).withColumn("map_y", -line * 4.6 + F.col("dn") / 2e3)
    return rounded(N.frame_jacobian(f, 32))
