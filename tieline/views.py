"""Input views derived from the given tables.

The given tables are not images, so every query starts from one of these statements. Each text is valid in
Spark SQL and in DuckDB; `{name}` stands for a table or another view. All views cover their whole table and
grow with it (pairs, tiles, runs and lines are key ranges, so their number grows and their size does not).
"""

VIEWS: dict[str, str] = {}

VIEWS["transforms"] = """
SELECT pair_id,
       CASE WHEN pair_id % 9 = 8 THEN 14e-1 ELSE 1e0 + ((pair_id % 7) - 3) * 4e-3 END AS a,
       CASE WHEN pair_id % 13 = 12 THEN 9e-1 ELSE ((pair_id % 11) - 5) * 1e-2 END AS b,
       CASE WHEN pair_id % 10 = 9 THEN 9e2 ELSE ((pair_id % 13) - 6) * 1e0 END AS tx,
       ((pair_id % 17) - 8) * 1e0 AS ty,
       1e0 AS expected_scale, 25e-2 AS src_gsd, 42e-1 + (pair_id % 5) * 1e-1 AS canvas_gsd, 24e-2 AS native_factor,
       -6e1 - (pair_id % 28) * 1e0 AS anchor_lat, (pair_id % 360) * 1e0 AS anchor_lon
FROM (SELECT DISTINCT CAST(floor(c_custkey / 3e1) AS BIGINT) AS pair_id FROM {customer}) p
"""

VIEWS["tiepoints"] = """
SELECT k.pair_id, match_id, src_x, src_y,
       t.a * src_x - t.b * src_y + t.tx + ex AS ref_x, t.b * src_x + t.a * src_y + t.ty + ey AS ref_y, score
FROM (SELECT CAST(floor(o_custkey / 3e1) AS BIGINT) AS pair_id, o_orderkey AS match_id,
             ((o_orderkey * 7919) % 100000) / 1e2 AS src_x, ((o_orderkey * 104729) % 99991) / 1e2 AS src_y,
             ((o_orderkey * 31) % 201 - 100) / 1e2 * (1 + o_orderkey % 7)
               + CASE WHEN o_orderkey % 10 < 3 OR (floor(o_custkey / 3e1) % 6 = 5 AND o_orderkey % 10 < 9)
                      THEN ((o_orderkey * 37) % 401 - 200) * 1e0 ELSE 0e0 END AS ex,
             ((o_orderkey * 57) % 199 - 99) / 1e2 * (1 + o_orderkey % 5)
               + CASE WHEN o_orderkey % 10 < 3 OR (floor(o_custkey / 3e1) % 6 = 5 AND o_orderkey % 10 < 9)
                      THEN ((o_orderkey * 53) % 397 - 198) * 1e0 ELSE 0e0 END AS ey,
             o_totalprice AS score
      FROM {orders}) k
JOIN {transforms} t ON t.pair_id = k.pair_id
"""

VIEWS["residuals"] = """
SELECT p.pair_id, match_id, src_x, src_y, ref_x, ref_y, score,
       sqrt((t.a * src_x - t.b * src_y + t.tx - ref_x) * (t.a * src_x - t.b * src_y + t.tx - ref_x)
          + (t.b * src_x + t.a * src_y + t.ty - ref_y) * (t.b * src_x + t.a * src_y + t.ty - ref_y)) AS residual_px
FROM {tiepoints} p JOIN {transforms} t ON t.pair_id = p.pair_id
"""

VIEWS["nodes"] = """
SELECT run_id, node_id, ix, iy, grid_x, grid_y, dx_sub, dy_sub, peak,
       peak * ratio AS second_peak, on_edge, nodata
FROM (SELECT l_suppkey AS run_id, l_orderkey * 8 + l_linenumber AS node_id,
             l_partkey % 16 AS ix, l_orderkey % 70 AS iy, (l_partkey % 16) * 48 + 32 AS grid_x,
             (l_orderkey % 70) * 48 + 32 AS grid_y,
             ((l_orderkey * 13 + l_partkey * 7) % 801 - 400) / 1e2 AS dx_sub,
             ((l_orderkey * 17 + l_partkey * 5 + l_linenumber) % 803 - 401) / 1e2 AS dy_sub,
             ((l_orderkey * 37 + l_partkey * 11 + l_linenumber * 101) % 1000) / 1e3 AS peak,
             ((l_partkey * 13 + l_linenumber * 7 + l_orderkey) % 100) / 1e2 AS ratio,
             l_orderkey % 17 = 0 AS on_edge, l_orderkey % 23 = 0 AS nodata
      FROM {lineitem}) n
"""

VIEWS["runs"] = """
SELECT run_id, draw,
       CASE arm_no WHEN 0 THEN 'genuine' WHEN 1 THEN 'rot90' WHEN 2 THEN 'rot180' WHEN 3 THEN 'rot270'
            WHEN 4 THEN 'vflip' WHEN 5 THEN 'hflip' WHEN 6 THEN 'offset' ELSE 'uniform_noise' END AS arm,
       value / 4e0 + CASE WHEN arm_no = 0 THEN 4e1 - (run_id % 5) * 1e1 ELSE 0e0 END AS ratio_pct,
       value / 1e1 + CASE WHEN arm_no = 0 THEN (run_id % 7) * 3e0 ELSE 0e0 END AS psr,
       ((draw * 29) % 401 - 200) / 1e1 AS dx, ((draw * 43) % 397 - 198) / 1e1 AS dy
FROM (SELECT user_id AS run_id, event_id AS draw, event_id % 8 AS arm_no, value FROM {events}) e
"""

VIEWS["products"] = """
SELECT product_id, CASE kind WHEN 0 THEN 'OHRC' WHEN 1 THEN 'TMC2' ELSE 'IIRS' END AS instrument,
       lat AS center_lat, lon AS center_lon, hlat, hlon,
       lat - hlat AS min_lat, lat + hlat AS max_lat, lon - hlon AS min_lon, lon + hlon AS max_lon,
       CASE kind WHEN 0 THEN 25e-2 WHEN 1 THEN 5e0 ELSE 8e1 END AS gsd_m,
       CASE WHEN product_id % 29 = 0 THEN NULL ELSE 3e1 + (product_id * 17) % 60 + (product_id % 97) / 1e2 END AS solar_incidence,
       CASE WHEN product_id % 31 = 0 THEN NULL ELSE ((product_id * 53) % 360) * 1e0 END AS sun_azimuth,
       CASE WHEN product_id % 37 = 0 THEN NULL ELSE ((product_id * 389) % 9000) * 1e0 END AS file_size_mb
FROM (SELECT c_custkey AS product_id, c_custkey % 3 AS kind,
             ((c_custkey * 7919) % 17000) / 1e2 - 85e0 AS lat, ((c_custkey * 104729) % 36000) / 1e2 AS lon,
             5e-1 + (c_custkey % 7) * 25e-2 AS hlat, 5e-1 + (c_custkey % 5) * 5e-1 AS hlon
      FROM {customer}) c
"""

VIEWS["geometry_a"] = """
SELECT CAST(floor(p_partkey / 4e1) AS BIGINT) * 100 AS scan, (p_partkey % 40) * 100 AS pixel,
       -6e1 + floor(p_partkey / 4e1) * 1e-2 + (p_partkey % 40) * 2e-4 AS lat,
       1e1 + (p_partkey % 40) * 2e-2 - floor(p_partkey / 4e1) * 1e-4 AS lon
FROM {part}
"""

VIEWS["geometry_b"] = """
SELECT CAST(floor(c_custkey / 3e1) AS BIGINT) * 50 AS scan, (c_custkey % 30) * 50 AS pixel,
       -598e-1 + floor(c_custkey / 3e1) * 13e-3 AS lat, 1005e-2 + (c_custkey % 30) * 31e-3 AS lon
FROM {customer}
"""

VIEWS["pixels"] = """
SELECT CAST(floor(l_orderkey / 1024e0) AS BIGINT) AS tile_id,
       CAST(floor((l_orderkey % 1024) / 32e0) AS BIGINT) AS row_no, l_orderkey % 32 AS col_no,
       sum(l_quantity) + CASE WHEN l_orderkey % 32 = 13 THEN 4e2 WHEN l_orderkey % 32 = 22 THEN 35e0 ELSE 0e0 END AS dn
FROM {lineitem} GROUP BY l_orderkey
"""

VIEWS["pixels_b"] = """
SELECT CAST(floor(o_orderkey / 1024e0) AS BIGINT) AS tile_id,
       CAST(floor((o_orderkey % 1024) / 32e0) AS BIGINT) AS row_no, o_orderkey % 32 AS col_no,
       floor(o_totalprice / 1e3) * 1e0 AS dn
FROM {orders}
"""

VIEWS["dem"] = """
SELECT tile_id, row_no, col_no,
       row_no * 2e0 + col_no * 15e-1 + ((row_no * 7 + col_no * 13) % 11) * 5e-1 + dn / 1e2 AS z
FROM {pixels}
"""

# the same rasters with the line of the whole product
for _name in ("pixels", "pixels_b", "dem"):
    VIEWS[f"{_name}_strip"] = "SELECT *, tile_id * 32 + row_no AS line FROM {" + _name + "}"

VIEWS["cube"] = """
SELECT CAST(floor(vec_id / 5e2) AS BIGINT) AS product_id, CAST(floor((vec_id % 500) / 25e0) AS BIGINT) AS line,
       vec_id % 25 AS sample, embedding AS spectrum
FROM {embeddings}
"""

VIEWS["descriptors"] = """
SELECT CAST(floor(vec_id / 1e2) AS BIGINT) AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'q' ELSE 'r' END AS side,
       vec_id AS kp_id, embedding AS descriptor
FROM {embeddings}
"""

VIEWS["train_log"] = """
SELECT CAST(extract(day FROM ts) AS BIGINT) AS epoch, count(*) AS steps, avg(value) AS val_loss
FROM {events} GROUP BY extract(day FROM ts)
"""

VIEWS["pair_stats"] = """
SELECT o_orderkey AS pair_id, ((o_orderkey * 31) % 101) / 1e2 AS mask_coverage,
       ((o_orderkey * 17) % 400) / 1e1 AS std_a, ((o_orderkey * 23) % 390) / 1e1 AS std_b,
       ((o_orderkey * 13) % 100) / 1e2 AS near_floor_a, ((o_orderkey * 7) % 100) / 1e2 AS near_floor_b,
       ((o_orderkey * 41) % 100) / 1e2 AS shadow_a, ((o_orderkey * 43) % 97) / 1e2 AS shadow_b,
       ((o_orderkey * 97) % 360) * 1e0 AS az_a, ((o_orderkey * 89) % 360) * 1e0 AS az_b,
       2e0 + (o_orderkey * 11) % 28 AS alt_a, 2e0 + (o_orderkey * 19) % 28 AS alt_b,
       85e-2 + ((o_orderkey * 3) % 41) / 1e2 AS scale_factor, o_orderstatus AS render_mode
FROM {orders}
"""

# small image chips of two instruments crowded around one site (all inside one cell of the footprint grid)
VIEWS["site_chips"] = """
SELECT product_id, side, lat - half AS min_lat, lat + half AS max_lat, lon - half AS min_lon, lon + half AS max_lon
FROM (SELECT c_custkey AS product_id, 'a' AS side, -695e-1 + ((c_custkey * 7919) % 10007) / 10007e0 AS lat,
             325e-1 + ((c_custkey * 104729) % 9973) / 9973e0 AS lon, 2e-3 + (c_custkey % 5) * 5e-4 AS half FROM {customer}
      UNION ALL
      SELECT c_custkey, 'b', -695e-1 + ((c_custkey * 31337) % 10009) / 10009e0, 325e-1 + ((c_custkey * 65537) % 9967) / 9967e0,
             3e-3 + (c_custkey % 7) * 5e-4 FROM {customer}) c
"""
