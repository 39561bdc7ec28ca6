"""Registered queries of catalog, footprint and geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.functions import geo as G
from tieline.operators import catalog as C, geometry as Y
from tieline.plans.tiepoint_queries import rounded
from tieline.registry import query

R = "1737400e0"


def of(t, name):
    return t.products.where(F.col("instrument") == name)


def with_ring(df):
    return C.box_corners(df).withColumn("lat_c", F.aggregate("corners", F.lit(0.0), lambda s, c: s + c["lat"]) / 4)


@query("h1_latlon_to_xyz", """
SELECT product_id, round(17374e-1 * cos(radians(center_lat)) * cos(radians(center_lon)), 6) + 0.0 AS x,
       round(17374e-1 * cos(radians(center_lat)) * sin(radians(center_lon)), 6) + 0.0 AS y,
       round(17374e-1 * sin(radians(center_lat)), 6) + 0.0 AS z FROM {products}""")
def _(t):
    x, y, z = G.latlon_to_xyz("center_lat", "center_lon")
    return rounded(t.products.select("product_id", x.alias("x"), y.alias("y"), z.alias("z")))


HAV = """2 * 1737400e0 * atan2(sqrt(h), sqrt(1 - h))"""


@query("h2_haversine_m", f"""
SELECT product_id, round({HAV}, 3) AS distance_m FROM (
 SELECT product_id, sin(radians(center_lat + 6e1) / 2) * sin(radians(center_lat + 6e1) / 2)
   + cos(radians(center_lat)) * cos(radians(-6e1)) * sin(radians(center_lon - 1e2) / 2) * sin(radians(center_lon - 1e2) / 2) AS h
 FROM {{products}}) x""")
def _(t):
    d = G.haversine_m(F.lit(-60.0), F.lit(100.0), "center_lat", "center_lon")
    return rounded(t.products.select("product_id", d.alias("distance_m")), distance_m=3)


AEQD = """
SELECT product_id, atan2(sqrt(e*e + n*n), sp0*sp + cp0*cp*cdl) * 17374e-1 AS d, atan2(e, n) AS brg FROM (
  SELECT product_id, cp * sdl AS e, cp0*sp - sp0*cp*cdl AS n, * EXCLUDE (product_id) FROM (
    SELECT product_id, sin(radians(center_lat)) AS sp, cos(radians(center_lat)) AS cp, sin(radians(-6e1)) AS sp0, cos(radians(-6e1)) AS cp0,
           sin(radians(center_lon - 1e2)) AS sdl, cos(radians(center_lon - 1e2)) AS cdl FROM {products}) a) b"""


@query("h3_project_aeqd", f"""
SELECT product_id, round(d, 5) AS distance_km, round(brg, 6) + 0.0 AS bearing_rad, round(d * sin(brg), 5) + 0.0 AS x, round(d * cos(brg), 5) + 0.0 AS y
FROM ({AEQD}) z""")
def _(t):
    d, b = G.gc_dist_bearing(F.lit(-60.0), F.lit(100.0), "center_lat", "center_lon")
    x, y = G.project_aeqd(F.lit(-60.0), F.lit(100.0), "center_lat", "center_lon")
    return rounded(t.products.select("product_id", d.alias("distance_km"), b.alias("bearing_rad"), x.alias("x"), y.alias("y")),
                   distance_km=5, x=5, y=5)


@query("h4_equirect", f"""
SELECT product_id, round({R} * radians(center_lon - 18e1) * cos(radians(-51e0)), 3) + 0.0 AS x, round({R} * radians(center_lat), 3) + 0.0 AS y,
       round(center_lat, 6) + 0.0 AS lat_back, round(center_lon, 6) + 0.0 AS lon_back FROM {{products}}""")
def _(t):
    x, y = G.equirect_fwd("center_lat", "center_lon", -51.0, 180.0)
    lat, lon = G.equirect_inv("x", "y", -51.0, 180.0)
    p = t.products.withColumn("x", x).withColumn("y", y)
    return rounded(p.select("product_id", "x", "y", lat.alias("lat_back"), lon.alias("lon_back")), x=3, y=3)


@query("h5_polar_stereo_south", f"""
SELECT product_id, round(2 * {R} * tan(radians(9e1 + center_lat) / 2) * sin(radians(center_lon)), 2) + 0.0 AS x,
       round(2 * {R} * tan(radians(9e1 + center_lat) / 2) * cos(radians(center_lon)), 2) + 0.0 AS y FROM {{products}} WHERE center_lat < 0""")
def _(t):
    x, y = G.polar_stereo_south("center_lat", "center_lon")
    return rounded(t.products.where("center_lat < 0").select("product_id", x.alias("x"), y.alias("y")), x=2, y=2)


@query("h6_grid_to_map", """
SELECT tile_id, row_no, col_no, round(1e3 + col_no * 472e-2, 6) AS map_x, round(-2e3 - row_no * 472e-2, 6) AS map_y,
       round((1e3 + col_no * 472e-2 - 9e2) / 2e0 - 5e-1, 6) AS ref_col, round((-19e2 - (-2e3 - row_no * 472e-2)) / 2e0 - 5e-1, 6) AS ref_row
FROM {pixels}""")
def _(t):
    x, y = G.grid_to_map("col_no", "row_no", F.lit(1000.0), F.lit(-2000.0), F.lit(4.72))
    p = t.pixels.withColumn("map_x", x).withColumn("map_y", y)
    c, r = G.map_to_ref_pixel("map_x", "map_y", F.lit(900.0), F.lit(-1900.0), F.lit(2.0))
    return rounded(p.select("tile_id", "row_no", "col_no", "map_x", "map_y", c.alias("ref_col"), r.alias("ref_row")))


@query("h7_planar_latlon", f"""
SELECT p.pair_id, match_id, round(anchor_lat - (ref_y - 500) * canvas_gsd / (pi() * {R} / 18e1), 7) AS lat,
       round(anchor_lon + (ref_x - 500) * canvas_gsd / (pi() * {R} / 18e1 * cos(radians(anchor_lat))), 7) AS lon, abs(anchor_lat) > 80 AS polar_caution
FROM {{tiepoints}} p JOIN {{transforms}} t ON t.pair_id = p.pair_id""")
def _(t):
    lat, lon, polar = G.planar_latlon("ref_x", "ref_y", "anchor_lat", "anchor_lon", "canvas_gsd", 1000.0, 1000.0)
    j = t.tiepoints.join(t.transforms, "pair_id")
    return rounded(j.select("pair_id", "match_id", lat.alias("lat"), lon.alias("lon"), polar.alias("polar_caution")), lat=7, lon=7)


@query("h8_pixel_offset", f"""
SELECT product_id, CAST(round_even(-{R} * radians(center_lat + 6e1) / gsd_m, 0) AS BIGINT) AS dy,
       CAST(round_even({R} * cos(radians((center_lat - 6e1) / 2)) * radians(center_lon - 1e2) / gsd_m, 0) AS BIGINT) AS dx
FROM {{products}}""")
def _(t):
    dy, dx = G.pixel_offset("center_lat", "center_lon", F.lit(-60.0), F.lit(100.0), "gsd_m")
    return t.products.select("product_id", dy.alias("dy"), dx.alias("dx"))


@query("h9_az_diff", """
SELECT pair_id, round(least(d, 360 - d), 6) AS azimuth_difference FROM (SELECT pair_id, abs(az_a - az_b) % 360 AS d FROM {pair_stats}) x""")
def _(t):
    return rounded(t.pair_stats.select("pair_id", G.az_diff("az_a", "az_b").alias("azimuth_difference")))


@query("h10_pyramid_depth", """
SELECT product_id, round(gsd_m / g, 9) AS ratio,
       CAST(greatest(2, ceil(log2(CASE WHEN gsd_m / g < 1 THEN g / gsd_m ELSE gsd_m / g END)) + 1) AS BIGINT) AS levels
FROM (SELECT product_id, gsd_m, 3e-1 + (product_id % 90) * 11e-1 AS g FROM {products}) x""")
def _(t):
    p = t.products.withColumn("g", 0.3 + (F.col("product_id") % 90) * 1.1)
    r = G.scale_ratio("gsd_m", "g")
    return rounded(p.select("product_id", r.alias("ratio"), G.pyramid_depth(r).alias("levels")), ratio=9)


@query("h11_spec_predicates", """
SELECT product_id, 4095 AS max_dn, instrument = 'IIRS' AS hyperspectral, instrument <> 'IIRS' AS panchromatic FROM {products}""")
def _(t):
    return C.spec_join(t.products).select(
        "product_id", G.max_dn("spec_bit_depth").alias("max_dn"), G.is_hyperspectral("spec_spectral_type", "spec_num_bands").alias("hyperspectral"),
        G.is_panchromatic("spec_spectral_type", "spec_num_bands").alias("panchromatic"))


@query("c14_scale_gap", """
WITH s AS (SELECT * FROM (VALUES ('OHRC', 25e-2, 45e-2, 7e-1), ('TMC2', 5e0, 5e-1, 8e-1), ('IIRS', 8e1, 8e-1, 5e0)) v(name, gsd, lo, hi))
SELECT product_id, instrument, o.name AS other, round(a.gsd / o.gsd, 6) AS scale_ratio,
       CAST(greatest(2, ceil(log2(CASE WHEN a.gsd < o.gsd THEN o.gsd / a.gsd ELSE a.gsd / o.gsd END)) + 1) AS BIGINT) AS pyramid_levels,
       CASE WHEN greatest(a.lo, o.lo) < least(a.hi, o.hi) THEN greatest(a.lo, o.lo) END AS overlap_lo_um,
       CASE WHEN greatest(a.lo, o.lo) < least(a.hi, o.hi) THEN least(a.hi, o.hi) END AS overlap_hi_um
FROM {products} p JOIN s a ON a.name = p.instrument CROSS JOIN s o""")
def _(t):
    return rounded(C.scale_gap(t.products))


@query("h12_spectral_overlap", """
SELECT product_id, CASE WHEN lo < hi THEN lo END AS overlap_lo, CASE WHEN lo < hi THEN hi END AS overlap_hi
FROM (SELECT product_id, greatest((product_id % 7) / 1e1, 45e-2) AS lo, least((product_id % 7) / 1e1 + 2e-1, 7e-1) AS hi FROM {products}) x""")
def _(t):
    a = (F.col("product_id") % 7) / 10.0
    lo, hi = G.spectral_overlap(a, a + 0.2, F.lit(0.45), F.lit(0.7))
    return t.products.select("product_id", lo.alias("overlap_lo"), hi.alias("overlap_hi"))


@query("h13_map_keypoints", """
SELECT pair_id, match_id, round(src_x / 5e-1 + 1e2, 6) AS x, round(src_y / 5e-1 + 4e1, 6) AS y FROM {tiepoints}""")
def _(t):
    from tieline.functions.transforms import map_keypoints

    x, y = map_keypoints("src_x", "src_y", F.lit(0.5), F.lit(100.0), F.lit(40.0))
    return rounded(t.tiepoints.select("pair_id", "match_id", x.alias("x"), y.alias("y")))


@query("h26_emission_from_attitude", """
SELECT pair_id, round(degrees(asin(least(1e0, (17374e-1 + 1e2) / 17374e-1 * sin(atan(sqrt(tan(radians(alt_a)) * tan(radians(alt_a))
       + tan(radians(alt_b)) * tan(radians(alt_b)))))))), 6) AS emission_deg FROM {pair_stats}""")
def _(t):
    return rounded(t.pair_stats.select("pair_id", G.emission_from_attitude("alt_a", "alt_b", F.lit(100.0)).alias("emission_deg")))


@query("h27_corner_ranges", """
SELECT product_id, round(min_lat, 6) + 0.0 AS min_lat, round(max_lat, 6) + 0.0 AS max_lat, round(max_lat - min_lat, 6) AS lat_span,
       round(max_lon - min_lon, 6) AS lon_span, round((max_lat - min_lat) * (max_lon - min_lon), 6) AS area_deg2 FROM {products}""")
def _(t):
    r = G.corner_ranges("corners")
    return rounded(C.box_corners(t.products).select("product_id", *[r[k].alias(k) for k in ("min_lat", "max_lat", "lat_span", "lon_span", "area_deg2")]))


@query("h30_line_for_latitude", """
SELECT product_id, round((center_lat + 1e-1 - max_lat) / (min_lat - max_lat) * 4e3, 4) AS line FROM {products}""")
def _(t):
    return rounded(t.products.select("product_id", G.line_for_latitude(F.col("center_lat") + 0.1, "max_lat", "min_lat", F.lit(4000.0)).alias("line")), line=4)


@query("h31_acquisition_ts", """
SELECT o_orderkey AS product_id, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2023-08-23 12:00:00' ELSE o_orderdate END AS acquired FROM {orders}""")
def _(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.orders.select(F.col("o_orderkey").alias("product_id"), G.acquisition_ts(text).cast("timestamp_ntz").alias("acquired"))


@query("b12_normalize_instrument", """
SELECT product_id, instrument AS canonical FROM {products}""")
def _(t):
    raw = (F.when(F.col("instrument") == "TMC2", F.when(F.col("product_id") % 2 == 0, F.lit(" tmc-2")).otherwise(F.lit("Terrain_Mapping Camera")))
           .when(F.col("instrument") == "IIRS", F.lit("imaging infra-red spectrometer")).otherwise(F.lit("ohrc ")))
    return t.products.select("product_id", G.normalize_instrument(raw).alias("canonical"))


@query("b3_centered_windows", """
SELECT product_id, CASE WHEN s < 0 THEN 0 WHEN s + 800 > total THEN greatest(0, total - 800) ELSE s END AS line0,
       CASE WHEN s < 0 THEN least(total, 800) WHEN s + 800 > total THEN total ELSE s + 800 END AS line1
FROM (SELECT product_id, (product_id * 37) % 3000 - 400 AS s, 600 + (product_id * 11) % 2400 AS total FROM {products}) x""")
def _(t):
    p = t.products.select("product_id", ((F.col("product_id") * 37) % 3000).alias("c"), (600 + (F.col("product_id") * 11) % 2400).alias("total"))
    lo, hi = G.centered_window("c", F.lit(800), "total")
    return p.select("product_id", lo.alias("line0"), hi.alias("line1"))


@query("b4_bbox_to_pixels", """
SELECT product_id, r0, greatest(r0 + 1, least(1000, r1)) AS r1, c0, greatest(c0 + 1, least(800, c1)) AS c1 FROM (
 SELECT product_id, CAST(greatest(0, least(999, floor((max_lat - (center_lat + 3e-1)) / (max_lat - min_lat) * 1000))) AS BIGINT) AS r0,
        CAST(ceil((max_lat - (center_lat - 3e-1)) / (max_lat - min_lat) * 1000) AS BIGINT) AS r1,
        CAST(greatest(0, least(799, floor((center_lon - 4e-1 - min_lon) / (max_lon - min_lon) * 800))) AS BIGINT) AS c0,
        CAST(ceil((center_lon + 9e-1 - min_lon) / (max_lon - min_lon) * 800) AS BIGINT) AS c1 FROM {products}) x""")
def _(t):
    fp = {k: k for k in ("min_lat", "max_lat", "min_lon", "max_lon")}
    box = {"min_lat": F.col("center_lat") - 0.3, "max_lat": F.col("center_lat") + 0.3, "min_lon": F.col("center_lon") - 0.4, "max_lon": F.col("center_lon") + 0.9}
    r0, r1, c0, c1 = G.bbox_to_pixels(fp, box, F.lit(1000), F.lit(800))
    return t.products.select("product_id", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))


RAW = """SELECT product_id, CASE WHEN product_id % 4 = 0 THEN NULL ELSE center_lat END AS clat, CASE WHEN product_id % 4 = 0 THEN NULL ELSE center_lon END AS clon,
   CASE WHEN product_id % 5 = 0 THEN -1e0 WHEN product_id % 5 = 1 THEN NULL ELSE gsd_m END AS g, product_id % 3 <> 0 AS has, *
   FROM {products}"""


def raw_footprints(t):
    k = F.col("product_id")
    p = C.box_corners(t.products)
    return p.select(
        "product_id", F.when(k % 4 != 0, F.col("center_lat")).alias("center_lat"), F.when(k % 4 != 0, F.col("center_lon")).alias("center_lon"),
        F.when(k % 5 == 0, -1.0).when(k % 5 == 1, F.lit(None)).otherwise(F.col("gsd_m")).alias("gsd_m"),
        F.when(k % 6 == 0, F.lit(None)).otherwise((k % 200).cast("double")).alias("sun_elevation_deg"),
        F.col("sun_azimuth").alias("sun_azimuth_deg"), F.lit(None).cast("string").alias("acquisition_time"),
        F.when(k % 3 != 0, F.col("corners")).alias("corners"))


@query("b14_clean_footprints", f"""
SELECT product_id, round(la, 6) + 0.0 AS center_lat, round(lo, 6) + 0.0 AS center_lon, gg AS gsd_m, NOT has AS synthesised,
       round(CASE WHEN has THEN min_lat ELSE la - dlat END, 6) + 0.0 AS min_lat, round(CASE WHEN has THEN max_lat ELSE la + dlat END, 6) + 0.0 AS max_lat,
       round(CASE WHEN has THEN min_lon ELSE lo - dlon END, 6) + 0.0 AS min_lon, round(CASE WHEN has THEN max_lon ELSE lo + dlon END, 6) + 0.0 AS max_lon
FROM (SELECT *, degrees(500 * gg / {R}) AS dlat, degrees(500 * gg / ({R} * greatest(1e-6, cos(radians(la))))) AS dlon
      FROM (SELECT *, CASE WHEN clat IS NOT NULL THEN clat WHEN has THEN (2 * max_lat + 2 * min_lat) / 4 ELSE 0 END AS la,
                   CASE WHEN clon IS NOT NULL THEN clon WHEN has THEN (2 * max_lon + 2 * min_lon) / 4 ELSE 0 END AS lo,
                   CASE WHEN coalesce(g, 1e0) <= 0 THEN 1e0 ELSE coalesce(g, 1e0) END AS gg FROM ({RAW}) r) a) b""")
def _(t):
    return rounded(C.clean_footprints(raw_footprints(t)).select(
        "product_id", "center_lat", "center_lon", "gsd_m", "synthesised", "min_lat", "max_lat", "min_lon", "max_lon"))


@query("b15_validate_footprints", """
SELECT product_id, concat_ws(';', CASE WHEN center_lat * 11e-1 NOT BETWEEN -90 AND 90 THEN 'center_lat' END,
       CASE WHEN center_lon * 11e-1 NOT BETWEEN -180 AND 360 THEN 'center_lon' END, CASE WHEN product_id % 7 = 0 THEN 'gsd_m' END,
       CASE WHEN product_id % 200 > 90 THEN 'sun_elevation_deg' END) AS warnings FROM {products}""")
def _(t):
    k = F.col("product_id")
    p = t.products.select("product_id", (F.col("center_lat") * 1.1).alias("center_lat"), (F.col("center_lon") * 1.1).alias("center_lon"),
                          F.when(k % 7 == 0, 0.0).otherwise(F.col("gsd_m")).alias("gsd_m"), (k % 200).alias("sun_elevation_deg"),
                          F.lit(-30.0).alias("sun_azimuth_deg"))
    return C.validate_footprints(p).select("product_id", F.concat_ws(";", "warnings").alias("warnings"))


@query("b16_valid_spec", """
SELECT product_id, concat_ws(';', CASE WHEN product_id % 7 = 0 THEN 'gsd_m' END, CASE WHEN product_id % 11 = 0 THEN 'spectral_range' END,
       CASE WHEN product_id % 13 = 0 THEN 'num_bands' END) AS violations FROM {products}""")
def _(t):
    k = F.col("product_id")
    s = t.products.select("product_id", F.when(k % 7 == 0, -1.0).otherwise(F.col("gsd_m")).alias("gsd_m"), F.lit(None).cast("double").alias("gsd_oblique_m"),
                          F.lit(20.0).alias("swath_km"), F.lit(0.5).alias("min_um"), F.when(k % 11 == 0, 0.5).otherwise(0.8).alias("max_um"),
                          F.when(k % 13 == 0, 0).otherwise(1).alias("num_bands"), F.lit(12).alias("bit_depth"), F.lit(100.0).alias("orbit_altitude_km"))
    return C.valid_spec(s).select("product_id", F.concat_ws(";", "violations").alias("violations"))


@query("b19_filter_products", """
SELECT instrument, count(*) AS n FROM {products} WHERE coalesce(file_size_mb, 0) <= 6144 AND solar_incidence IS NOT NULL GROUP BY 1""")
def _(t):
    return C.filter_products(t.products, 6144.0).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


PIECES = """SELECT product_id, instrument, min_lat, max_lat, (max_lat - min_lat) * (max_lon - min_lon) AS area,
  unnest(CASE WHEN min_lon < 0 THEN [[min_lon + 360, 360e0], [0e0, max_lon]] WHEN max_lon > 360 THEN [[min_lon, 360e0], [0e0, max_lon - 360]]
              ELSE [[min_lon, max_lon]] END) AS p FROM {products}"""
OVERLAP = f"""SELECT a.product_id AS a_id, b.product_id AS b_id, greatest(a.min_lat, b.min_lat) AS min_lat, least(a.max_lat, b.max_lat) AS max_lat,
  greatest(a.p[1], b.p[1]) AS min_lon, least(a.p[2], b.p[2]) AS max_lon, a.area AS area_a, b.area AS area_b
  FROM ({PIECES}) a JOIN ({PIECES}) b ON a.instrument = 'OHRC' AND b.instrument = 'TMC2' AND least(a.max_lat, b.max_lat) > greatest(a.min_lat, b.min_lat)
   AND least(a.p[2], b.p[2]) > greatest(a.p[1], b.p[1])"""


@query("c1_footprint_overlap", f"""
SELECT a_id, b_id, round(min_lat, 6) + 0.0 AS min_lat, round(max_lat, 6) + 0.0 AS max_lat, round(min_lon, 6) + 0.0 AS min_lon, round(max_lon, 6) + 0.0 AS max_lon,
       round(least(1, (max_lat - min_lat) * (max_lon - min_lon) / area_a), 6) AS fraction_a, round(least(1, (max_lat - min_lat) * (max_lon - min_lon) / area_b), 6) AS fraction_b
FROM ({OVERLAP}) o""")
def _(t):
    return rounded(C.footprint_overlap(of(t, "OHRC"), of(t, "TMC2")))


@query("c1_overlap_at_a_crowded_site", """
SELECT a.product_id AS a_id, b.product_id AS b_id, round((least(a.max_lat, b.max_lat) - greatest(a.min_lat, b.min_lat)) * 1e3, 5) AS height_mdeg,
       round((least(a.max_lon, b.max_lon) - greatest(a.min_lon, b.min_lon)) * 1e3, 5) AS width_mdeg
FROM {site_chips} a JOIN {site_chips} b ON a.side = 'a' AND b.side = 'b' AND least(a.max_lat, b.max_lat) > greatest(a.min_lat, b.min_lat)
 AND least(a.max_lon, b.max_lon) > greatest(a.min_lon, b.min_lon)""")
def _(t):
    """All chips lie in one grid cell, which is divided until its parts are small."""
    c = t.site_chips
    o = C.footprint_overlap(c.where("side = 'a'"), c.where("side = 'b'"))
    return rounded(o.select("a_id", "b_id", ((F.col("max_lat") - F.col("min_lat")) * 1e3).alias("height_mdeg"), ((F.col("max_lon") - F.col("min_lon")) * 1e3).alias("width_mdeg")), 5)


@query("c2_search_region", f"""
SELECT r.a_id, r.b_id, round(o.min_lat, 6) + 0.0 AS min_lat, round(o.max_lat, 6) + 0.0 AS max_lat, round(o.min_lon, 6) + 0.0 AS min_lon, round(o.max_lon, 6) + 0.0 AS max_lon
FROM (SELECT c_custkey AS a_id, (c_custkey * 31) // 3 * 3 % 1500 + 1 AS b_id FROM {{customer}} WHERE c_custkey % 3 = 0
      UNION SELECT a_id, b_id FROM ({OVERLAP}) z) r LEFT JOIN ({OVERLAP}) o ON o.a_id = r.a_id AND o.b_id = r.b_id""")
def _(t):
    o = C.footprint_overlap(of(t, "OHRC"), of(t, "TMC2"))
    asked = of(t, "OHRC").select(F.col("product_id").alias("a_id"), (F.floor(F.col("product_id") * 31 / 3) * 3 % 1500 + 1).alias("b_id"))
    return rounded(C.search_region(asked.distinct(), o, every=True))


POLY = """
WITH ring AS (SELECT *, [max_lat, max_lat, min_lat, min_lat] AS la, [min_lon, max_lon, max_lon, min_lon] AS lo, (2*max_lat + 2*min_lat) / 4 AS lat_c
              FROM {products} WHERE coalesce(file_size_mb, 0) <= 6144 AND solar_incidence IS NOT NULL),
 far AS (SELECT *, cos(radians(max_lat)) * cos(radians(min_lon)) AS px, cos(radians(max_lat)) * sin(radians(min_lon)) AS py, sin(radians(max_lat)) AS pz,
        list_max([acos(least(1.0, greatest(-1.0, sin(radians(la[1])) * sin(radians(la[k])) + cos(radians(la[1])) * cos(radians(la[k])) * cos(radians(lo[k] - lo[1]))))) for k in [2, 3, 4]]) AS reach FROM ring),
 cand AS (SELECT a.product_id AS a_id, b.product_id AS b_id, a.la AS ala, a.lo AS alo, b.la AS bla, b.lo AS blo FROM far a JOIN far b
   ON a.instrument = 'TMC2' AND b.instrument = 'IIRS' AND abs(a.lat_c - b.lat_c) <= 25
      AND a.px * b.px + a.py * b.py + a.pz * b.pz >= cos(least(pi(), a.reach + 15 / 17374e-1 + b.reach * pi() / 2 + 1e-6))),
 corner AS (SELECT a_id, b_id, side, i, ala[1] AS lat0, alo[1] AS lon0, CASE side WHEN 'a' THEN ala[i] ELSE bla[i] END AS lat, CASE side WHEN 'a' THEN alo[i] ELSE blo[i] END AS lon
   FROM cand, (SELECT unnest(['a', 'b']) AS side) s, (SELECT unnest([1, 2, 3, 4]) AS i) n),
 en AS (SELECT *, cos(radians(lat)) * sin(radians(lon - lon0)) AS e,
        cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)) AS n,
        sin(radians(lat0)) * sin(radians(lat)) + cos(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)) AS c FROM corner),
 xy0 AS (SELECT a_id, b_id, side, i, atan2(sqrt(e*e + n*n), c) * 17374e-1 * sin(atan2(e, n)) AS x, atan2(sqrt(e*e + n*n), c) * 17374e-1 * cos(atan2(e, n)) AS y FROM en),
 mid AS (SELECT *, avg(x) OVER (PARTITION BY a_id, b_id, side) AS cx, avg(y) OVER (PARTITION BY a_id, b_id, side) AS cy FROM xy0),
 xy AS (SELECT a_id, b_id, side, i, CASE WHEN side = 'b' THEN x ELSE cx + (x - cx) * (sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) + 15) / sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) END AS x,
        CASE WHEN side = 'b' THEN y ELSE cy + (y - cy) * (sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) + 15) / sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) END AS y FROM mid),
 bx AS (SELECT a_id, b_id FROM xy GROUP BY a_id, b_id HAVING max(x) FILTER (side = 'a') >= min(x) FILTER (side = 'b') AND max(x) FILTER (side = 'b') >= min(x) FILTER (side = 'a')
        AND max(y) FILTER (side = 'a') >= min(y) FILTER (side = 'b') AND max(y) FILTER (side = 'b') >= min(y) FILTER (side = 'a')),
 ed AS (SELECT p.a_id, p.b_id, p.side, p.i, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM xy p JOIN bx ON bx.a_id = p.a_id AND bx.b_id = p.b_id
        JOIN xy q ON q.a_id = p.a_id AND q.b_id = p.b_id AND q.side = p.side AND q.i = p.i % 4 + 1),
 cr AS (SELECT s.a_id, s.b_id, sign((s.y2-s.y1)*(t.x1-s.x2) - (s.x2-s.x1)*(t.y1-s.y2)) AS o1, sign((s.y2-s.y1)*(t.x2-s.x2) - (s.x2-s.x1)*(t.y2-s.y2)) AS o2,
        sign((t.y2-t.y1)*(s.x1-t.x2) - (t.x2-t.x1)*(s.y1-t.y2)) AS o3, sign((t.y2-t.y1)*(s.x2-t.x2) - (t.x2-t.x1)*(s.y2-t.y2)) AS o4
        FROM ed s JOIN ed t ON t.a_id = s.a_id AND t.b_id = s.b_id AND s.side = 'a' AND t.side = 'b'),
 ins AS (SELECT e.a_id, e.b_id, e.side, count(*) FILTER ((e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1) % 2 AS odd
         FROM ed e JOIN xy p ON p.a_id = e.a_id AND p.b_id = e.b_id AND p.side <> e.side AND p.i = 1 GROUP BY e.a_id, e.b_id, e.side),
 hits AS (SELECT a_id, b_id FROM (SELECT DISTINCT a_id, b_id FROM cr WHERE o1 <> o2 AND o3 <> o4 UNION SELECT a_id, b_id FROM ins WHERE odd = 1) u
          SEMI JOIN (SELECT a_id, b_id FROM en WHERE side = 'b' AND i = 1 AND c > 0) f USING (a_id, b_id))
"""


def tmc_iirs(t):
    return with_ring(of(t, "TMC2")), with_ring(of(t, "IIRS"))


@query("c3_polygon_overlap", POLY + "SELECT a_id, b_id FROM hits")
def _(t):
    a, b = tmc_iirs(t)
    return C.polygon_overlap(C.filter_products(a, 6144.0), C.filter_products(b, 6144.0))


BRIGHT = POLY + """, br AS (SELECT h.a_id, h.b_id, (a.solar_incidence + b.solar_incidence) / 2 AS m, greatest(a.solar_incidence, b.solar_incidence) AS mx,
  abs(a.sun_azimuth - b.sun_azimuth) % 360 AS d FROM hits h JOIN {products} a ON a.product_id = h.a_id JOIN {products} b ON b.product_id = h.b_id)
SELECT a_id, b_id, round(m, 6) AS mean_incidence, round(mx, 6) AS max_incidence, round(CASE WHEN d IS NULL THEN NULL ELSE least(d, 360 - d) END, 6) AS azimuth_difference,
  round(cos(radians(m)) / cos(radians(85e0)), 6) AS radiance_gain FROM br ORDER BY m, a_id, b_id LIMIT 10"""


@query("f1_bright_pairs", BRIGHT)
def _(t):
    return rounded(C.bright_pairs(*tmc_iirs(t)))


XYZ = "17374e-1 * cos(radians(lat)) * cos(radians(lon)) AS x, 17374e-1 * cos(radians(lat)) * sin(radians(lon)) AS y, 17374e-1 * sin(radians(lat)) AS z"
NEAR = f"""
near AS (SELECT * FROM (SELECT b.scan AS b_scan, b.pixel AS b_pixel, a.scan AS a_scan, a.pixel AS a_pixel, a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon,
   sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM (SELECT *, {XYZ} FROM {{geometry_b}}) b
   JOIN (SELECT *, {XYZ} FROM {{geometry_a}}) a ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.z-b.z) <= 1) WHERE d <= 1
   QUALIFY row_number() OVER (PARTITION BY b_scan, b_pixel ORDER BY d, a_scan, a_pixel) = 1)"""


@query("c4_nearest_geo", f"""
WITH {NEAR} SELECT b_scan, b_pixel, a_scan, a_pixel, round(d, 6) AS distance_km FROM near""")
def _(t):
    n = Y.nearest_geo(t.geometry_b, t.geometry_a, 1.0)
    return rounded(n.select("b_scan", "b_pixel", "a_scan", "a_pixel", "distance_km"))


@query("c5_common_region", f"""
WITH {NEAR} SELECT count(*) AS n_overlap, min(a_scan) AS a_scan_min, max(a_scan) AS a_scan_max, min(a_pixel) AS a_pixel_min, max(a_pixel) AS a_pixel_max,
  min(b_scan) AS b_scan_min, max(b_scan) AS b_scan_max, min(b_pixel) AS b_pixel_min, max(b_pixel) AS b_pixel_max,
  round(least(min(a_lat), min(b_lat)), 6) AS lat_min, round(greatest(max(a_lat), max(b_lat)), 6) AS lat_max,
  round(least(min(a_lon), min(b_lon)), 6) AS lon_min, round(greatest(max(a_lon), max(b_lon)), 6) AS lon_max, round(min(d), 6) AS min_distance_km FROM near HAVING count(*) > 0""")
def _(t):
    c = Y.common_region(t.geometry_b, t.geometry_a, 1.0)
    return rounded(c.drop("center_a_scan", "center_a_pixel", "center_b_scan", "center_b_pixel", "center_lat", "center_lon"))


@query("f2_closest_pair", f"""
WITH {NEAR} SELECT a_scan AS center_a_scan, a_pixel AS center_a_pixel, b_scan AS center_b_scan, b_pixel AS center_b_pixel,
  round(d, 6) AS min_distance_km FROM near ORDER BY d, b_scan, b_pixel LIMIT 1""")
def _(t):
    c = Y.common_region(t.geometry_b, t.geometry_a, 1.0)
    return rounded(c.select("center_a_scan", "center_a_pixel", "center_b_scan", "center_b_pixel", "min_distance_km"))


@query("g2_lattice_gaps", """
SELECT s.scan, p.pixel FROM (SELECT DISTINCT scan FROM {geometry_a} WHERE (scan + pixel) % 1700 <> 0) s
CROSS JOIN (SELECT DISTINCT pixel FROM {geometry_a} WHERE (scan + pixel) % 1700 <> 0) p
LEFT JOIN (SELECT * FROM {geometry_a} WHERE (scan + pixel) % 1700 <> 0) g ON g.scan = s.scan AND g.pixel = p.pixel WHERE g.scan IS NULL""")
def _(t):
    return Y.lattice_gaps(t.geometry_a.where((F.col("scan") + F.col("pixel")) % 1700 != 0))


def hav_sql(a, b, c, d):
    h = f"(sin(radians({c}-{a})/2)*sin(radians({c}-{a})/2) + cos(radians({a}))*cos(radians({c}))*sin(radians({d}-{b})/2)*sin(radians({d}-{b})/2))"
    return f"2*{R}*atan2(sqrt({h}), sqrt(1-{h}))"


@query("e10_native_gsd", f"""
WITH n AS (SELECT * FROM {{geometry_a}} WHERE {hav_sql('lat', 'lon', '-59.8', '10.4')} < 20000),
 s AS (SELECT lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, pixel - lag(pixel) OVER w AS d FROM n WINDOW w AS (PARTITION BY scan ORDER BY pixel)),
 l AS (SELECT lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, scan - lag(scan) OVER w AS d FROM n WINDOW w AS (PARTITION BY pixel ORDER BY scan))
SELECT round((SELECT quantile_cont({hav_sql('lat', 'lon', 'la', 'lo')} / d, 0.5) FROM s), 5) AS sample_m,
       round((SELECT quantile_cont({hav_sql('lat', 'lon', 'la', 'lo')} / d, 0.5) FROM l), 5) AS line_m""")
def _(t):
    return rounded(Y.native_gsd(t.geometry_a, -59.8, 10.4, 20000.0), 5)


@query("c16_missing_products", """
SELECT DISTINCT o_custkey + 20 AS product_id FROM {orders} WHERE o_custkey + 20 NOT IN (SELECT product_id FROM {products} WHERE file_size_mb IS NOT NULL)""")
def _(t):
    return C.missing_products(t.orders.select((F.col("o_custkey") + 20).alias("product_id")), t.products.where("file_size_mb IS NOT NULL"))


@query("c16_backed_products", """
SELECT o_orderkey, o_custkey AS product_id FROM {orders} WHERE o_custkey IN (SELECT product_id FROM {products} WHERE sun_azimuth IS NOT NULL)""")
def _(t):
    return C.backed_products(t.orders.select("o_orderkey", F.col("o_custkey").alias("product_id")), t.products.where("sun_azimuth IS NOT NULL"))


@query("c21_bbox_search", f"""
WITH c AS (SELECT 2*{R}*tan(radians(9e1 + la)/2) AS rho, lo FROM (SELECT unnest([-84e0, -60e0]) AS la) a, (SELECT unnest([2e1, 7e1]) AS lo) b),
 b AS (SELECT min(rho*sin(radians(lo))) AS x0, max(rho*sin(radians(lo))) AS x1, min(rho*cos(radians(lo))) AS y0, max(rho*cos(radians(lo))) AS y1 FROM c)
SELECT product_id, instrument FROM (SELECT *, 2*{R}*tan(radians(9e1 + center_lat)/2)*sin(radians(center_lon)) AS x,
   2*{R}*tan(radians(9e1 + center_lat)/2)*cos(radians(center_lon)) AS y FROM {{products}}) p, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def _(t):
    return C.bbox_search(t.products, -84.0, -60.0, 20.0, 70.0).select("product_id", "instrument")


@query("c15_check_provenance", """
SELECT product_id, concat_ws(';', CASE WHEN product_id % 17 = 0 THEN 'array' END, CASE WHEN product_id % 19 = 0 THEN 'latitude' END,
   CASE WHEN product_id % 23 = 0 THEN 'resolution' END, CASE WHEN product_id % 29 = 0 AND product_id % 2 = 0 THEN 'product' END) AS violations
FROM {products} WHERE product_id % 17 = 0 OR product_id % 19 = 0 OR product_id % 23 = 0 OR (product_id % 29 = 0 AND product_id % 2 = 0)""")
def _(t):
    k = F.col("product_id")
    src = t.products.select("product_id", "center_lat", "gsd_m", F.col("instrument").alias("origin"),
                            F.sha2(F.concat_ws(",", "min_lat", "max_lat", "hlon"), 256).alias("digest"))
    out = src.select("product_id", (F.col("center_lat") + F.when(k % 19 == 0, 0.01).otherwise(0.0)).alias("center_lat"),
                     (F.col("gsd_m") + F.when(k % 23 == 0, 0.5).otherwise(0.0)).alias("gsd_m"),
                     F.when(k % 29 == 0, F.when(k % 2 == 0, "other").otherwise("")).otherwise(F.col("origin")).alias("origin"),
                     F.when(k % 17 == 0, F.lit("0")).otherwise(F.col("digest")).alias("digest"))
    return C.check_provenance(src, out).select("product_id", F.concat_ws(";", "violations").alias("violations"))


@query("c19_hub_compose", """
WITH m AS (SELECT pair_id AS hub_id, count(*) FILTER (residual_px <= 15) AS n1, avg(greatest(0e0, 1 - residual_px / 15)) AS c1,
                  count(*) FILTER (residual_px <= 3) AS n2, avg(greatest(0e0, 1 - residual_px / 3)) AS c2 FROM {residuals} GROUP BY pair_id)
SELECT hub_id, hub_id * 3 AS fine_id, hub_id * 3 + 2 AS coarse_id, n1 > 0 AND n2 > 0 AS success,
       round(CASE WHEN c1 > 0 AND c2 > 0 THEN sqrt(c1 * c2) ELSE 0 END, 6) AS confidence, 'composite' AS hop FROM m""")
def _(t):
    from tieline.functions.transforms import match_confidence
    from tieline.plans.tiepoint_queries import residuals

    def hop(gate, name, key):
        return residuals(t).groupBy(F.col("pair_id").alias("hub_id")).agg(
            F.count_if(F.col("residual_px") <= gate).alias("n_matches"), F.avg(match_confidence("residual_px", gate)).alias("confidence")
        ).withColumn(name, key)

    h = C.hub_compose(hop(15.0, "fine_id", F.col("hub_id") * 3), hop(3.0, "coarse_id", F.col("hub_id") * 3 + 2))
    return rounded(h.withColumn("hop", C.route(F.lit("OHRC"), F.lit("IIRS"))))
