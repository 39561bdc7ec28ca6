"""Plans and helpers whose cost must follow the input: no broadcast of tables that grow, no file per row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieline.functions import geo as G
from tieline.operators import catalog as C, fitting as M, matching as J, pixels as P, recipes as R, tiles as L
from tieline.plans import catalog_queries, matching_queries  # noqa: F401
from tieline.registry import QUERIES, Tables
from tieline.session import cut_lineage
from tieline.sources import labels as A, sinks as W


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def raster(spark, values, tile=0):
    return spark.createDataFrame([(tile, r, c, float(v) if np.isfinite(v) else None) for (r, c), v in np.ndenumerate(values)], "tile_id long, row_no long, col_no long, dn double")


def test_lag_surfaces_meet_once_per_tile_and_equal_the_coefficient(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 400, (2, 14, 14))
    b[2:8, 2:8] = 7.1  # flat parts score 0
    src = raster(spark, a)
    ref = raster(spark, b).where("NOT (row_no = 11 AND col_no = 11)").unionByName(raster(spark, b).where("row_no = 0 AND col_no = 13"))
    nodes = spark.createDataFrame([(0, 5, 5), (0, 8, 5), (0, 9, 9), (0, 4, 10), (0, 6, 9), (1, 6, 6)], "tile_id long, qy long, qx long")
    s = L.correlation_surface(src, ref, nodes, 2, 2)
    assert "Join" not in plan_of(s)
    got = {(r.qy, r.qx, r.ly, r.lx): r.score for r in s.collect()}
    # (9, 9) lacks a cell of its window; (4, 10) has a cell twice
    assert {k[:2] for k in got} == {(5, 5), (8, 5), (6, 9)} and len(got) == 75
    for (y, x, ly, lx), score in got.items():
        t, w = a[y - 2:y + 2, x - 2:x + 2].ravel(), b[y + ly - 2:y + ly + 2, x + lx - 2:x + lx + 2].ravel()
        want = 0.0 if np.ptp(w) == 0 else np.corrcoef(t, w)[0, 1]
        assert score == pytest.approx(want, abs=1e-12)
    assert 0.0 in got.values()


def test_lag_surfaces_with_nulls_equal_the_sql_aggregates(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, (2, 10, 10)).astype(float)
    a[3, 3], b[4, 6] = np.nan, np.nan
    src, ref = raster(spark, a), raster(spark, b)
    got = {(r.ly, r.lx): r.score for r in L.correlation_surface(src, ref, spark.createDataFrame([(0, 5, 5)], "tile_id long, qy long, qx long"), 2, 2).collect()}
    cells = src.where("row_no BETWEEN 3 AND 6 AND col_no BETWEEN 3 AND 6")
    for ly, lx in ((0, 0), (-1, 2), (2, -2)):
        j = cells.join(ref.select((F.col("row_no") - ly).alias("row_no"), (F.col("col_no") - lx).alias("col_no"), F.col("dn").alias("v")), ["row_no", "col_no"])
        assert j.count() == 16
        want = j.agg(F.expr("coalesce(try_divide(covar_pop(dn, v), stddev_pop(dn) * stddev_pop(v)), 0D)")).first()[0]
        assert got[ly, lx] == pytest.approx(want, abs=1e-12)
    assert len(got) == 25


def test_equalisation_of_many_small_parts_makes_no_rows_of_its_tables(spark):
    """Sub-tiles of one cell each: a table of 256 values for each would be 256 rows a cell."""
    img = np.random.default_rng(7).integers(0, 256, (8, 8)).astype(float)
    img[2, 5] = np.nan
    limits = spark.createDataFrame([(0, 2.5)], "tile_id long, clip double")
    out = P.clahe(raster(spark, img), 8, 4, limits)
    assert "Generate" not in plan_of(out)
    got = {(r.row_no, r.col_no): r.dn for r in out.collect()}
    assert len(got) == 63 and (2, 5) not in got

    def look_up(y, x, v):
        part = img[2 * y:2 * y + 2, 2 * x:2 * x + 2].ravel()
        count = {u: int((part == u).sum()) for u in part[~np.isnan(part)]} | ({None: 1} if np.isnan(part).any() else {})
        lim = max(1.0, 2.5 * 4 / 256)
        excess = sum(max(c - lim, 0.0) for c in count.values())
        return sum(min(count.get(float(u), 0), lim) + excess / 256 for u in range(int(v) + 1)) * 255 / 4

    for (r, c), dn in got.items():
        fy, fx = (r + 0.5) / 2 - 0.5, (c + 0.5) / 2 - 0.5
        y, x = int(np.floor(fy)), int(np.floor(fx))
        corners = [(min(max(y + a, 0), 3), min(max(x + b, 0), 3), (fy - y if a else 1 - fy + y) * (fx - x if b else 1 - fx + x)) for a in (0, 1) for b in (0, 1)]
        assert dn == pytest.approx(sum(w * look_up(a, b, img[r, c]) for a, b, w in corners))


def test_a_label_is_parsed_once_and_equals_xpath(spark):
    xml = ("<a:P xmlns:a='u'><a:File><x><a:file_name> f.img </a:file_name></x></a:File><file_name>other</file_name><File><file_name>late</file_name><file_size>12</file_size></File>"
           "<Axis_Array><axis_name>Sample</axis_name><elements>4</elements><sequence_number>2</sequence_number></Axis_Array>"
           "<Axis_Array><axis_name>Line</axis_name><elements>9</elements><sequence_number>1</sequence_number></Axis_Array><n><axis_name>no axis</axis_name></n>"
           "<area>South <b>Pole</b></area><pixel_resolution>x</pixel_resolution><solar_incidence>1.5</solar_incidence>"
           "<System_Level_Coordinates><upper_left_latitude>1</upper_left_latitude><upper_left_longitude>2</upper_left_longitude></System_Level_Coordinates>"
           "<Refined_Corner_Coordinates><lower_right_latitude>3</lower_right_latitude><lower_right_longitude>4</lower_right_longitude><lower_left_latitude>5</lower_left_latitude></Refined_Corner_Coordinates></a:P>")
    raw = spark.createDataFrame([(1, xml), (2, None), (3, "<P/>")], "k int, xml string")
    p = A.parse_labels(raw)
    assert "xpath" not in plan_of(p).lower()
    one, none, empty = (r.asDict(True) for r in p.orderBy("k").collect())
    first = lambda under, tag: F.trim(F.xpath_string("xml", F.lit(f"{under}//*[local-name()='{tag}']")))
    want = raw.where("k = 1").select(first("//*[local-name()='File']", "file_name"), first("", "area"), F.xpath("xml", F.lit("//*[local-name()='Axis_Array']/*[local-name()='axis_name']/text()"))).first()
    assert (one["file_name"], one["area"], sorted(one["axis_names"])) == (want[0], want[1], sorted(want[2])) == ("f.img", "South Pole", ["Line", "Sample"])
    assert one["axis_names"] == ["Line", "Sample"] and one["elements"] == [9, 4] and one["file_size"] == 12
    assert one["pixel_resolution"] is None and one["solar_incidence"] == 1.5 and one["corners"] == [{"name": "lower_right", "lat": 3.0, "lon": 4.0}]
    assert none["axis_names"] is None and none["file_name"] is None and none["corners"] == []
    assert empty["axis_names"] == [] and empty["corners"] == []


def test_one_text_file_a_key_in_one_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b\nc"), (1, "a"), (3, "d")], "k int, value string")
    W.write_texts(rows, "k", str(tmp_path / "t"))
    assert sorted(f.read_text() for f in (tmp_path / "t").glob("*.txt") if f.stat().st_size) == ["a\na\n", "b\nc\n", "d\n"]
    assert len({f.name[:10] for f in (tmp_path / "t").glob("*.txt") if f.stat().st_size}) > 1  # small rows, but costly files: more than one task


def test_text_files_are_put_in_place_by_tasks(spark, tmp_path):
    """No checksum file and no process for permissions beside each file; a folder is never written twice."""
    rows = spark.createDataFrame([(1, "a"), (2, "b\nc"), (1, "a"), (3, None), (None, "\u00e9")], "k int, value string")
    path = tmp_path / "a b"
    W.write_texts(rows, "k", f"file://{path}")
    texts = {f.name: f.read_bytes() for f in path.glob("part-*") if f.stat().st_size}
    assert sorted(texts.values()) == [b"\n", b"a\na\n", b"b\nc\n", "\u00e9\n".encode()]
    assert (path / "_SUCCESS").exists() and not any((path / f".{n}.crc").exists() for n in texts)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        W.write_texts(rows, "k", str(path))
    W.write_texts(rows.limit(0), "k", str(tmp_path / "none"))
    assert A.text_lines(spark, str(tmp_path / "none")).count() == 0


def test_lines_of_many_files_equal_the_text_source(spark, tmp_path):
    """A flat folder is listed by a task and read by all; the driver holds no list of files. Other folders are Spark's."""
    import gzip

    odd = {"a b.hdr": b"\xef\xbb\xbflines = 3\r\nsamples=4\rbands = 2\n\n", "a#%c[\u00e9]@.hdr": b"x", "empty": b"", "one": b"\n", "two": b"a\n\n\rb", "bad": b"c = \xff\n", "_x": b"no", ".y": b"no", "_k=v": b"yes"}
    flat, deep = tmp_path / "flat", tmp_path / "deep"
    for d in (flat, deep):
        d.mkdir()
        for name, data in odd.items():
            (d / name).write_bytes(data)
    (deep / "z.hdr.gz").write_bytes(gzip.compress(b"p = 1\nq = 2\n"))
    rows = lambda df: sorted(map(tuple, df.selectExpr("path", "hex(value)").collect()))
    for path, own in ((flat, True), (f"file://{flat}", True), (deep, False), (f"{flat}/*.hdr", False), (f"{flat}/two", False)):
        got = A.text_lines(spark, str(path))
        assert ("FileScan" in plan_of(got)) != own
        assert rows(got) == rows(spark.read.text(str(path)).select(F.input_file_name().alias("path"), "value"))
    assert "FileScan" not in plan_of(A.scan_labels(spark, str(flat))) and "FileScan" not in plan_of(A.scan_envi_headers(spark, str(flat)))
    assert {r.lines: r.samples for r in A.scan_envi_headers(spark, str(flat)).collect()} == {3: 4, 0: 0}


def test_tie_points_of_a_pair_are_written_together(spark, tmp_path):
    rows = spark.range(400).repartition(8).select((F.col("id") % 5).alias("pair_id"), F.col("id").alias("match_id"))
    W.write_tiepoints(rows, str(tmp_path / "p"), "note")
    assert len(list((tmp_path / "p").glob("pair_id=*/*.csv"))) == 5


def test_polygons_are_tested_in_blocks_and_equal_a_comparison_of_all_pairs(spark):
    """Small and very large footprints, with three to five corners, near the poles and across the seam; repeated ids."""
    rng = np.random.default_rng(11)

    def table(first, n):
        rows = []
        for i in range(first, first + n):
            k, (lat, lon) = int(rng.integers(3, 6)), (float(rng.uniform(-86, 86)), float(rng.uniform(0, 360)))
            half = 20.0 if i % 6 == 0 else float(rng.uniform(0.3, 4))
            t = np.sort(rng.uniform(0, 2 * np.pi, k))
            ring = [(float(np.clip(lat + half * np.sin(a), -90, 90)), float((lon + 1.7 * half * np.cos(a)) % 360)) for a in t]
            rows.append((i, ring, float(np.mean([p[0] for p in ring]))))
        return spark.createDataFrame(rows + rows[:2], "product_id long, corners array<struct<lat:double,lon:double>>, lat_c double").coalesce(1)

    a, b = table(0, 140), table(1000, 150)
    out = C.polygon_overlap(a, b)
    text = plan_of(out)
    assert "MapInPandas" in text and "edges" not in text and "winding" not in text
    got = sorted((r.a_id, r.b_id) for r in out.collect())

    def km(p, q):
        d, _ = G.dist_bearing_np(*[np.float64(v) for v in (*p, *q)])
        return d

    def chord(p, q):
        return 2 * 1737.4 * np.sin(km(p, q) / 2 / 1737.4)

    want = []
    for i, ring_a, lat_a in a.collect():
        o, far_a = ring_a[0], max(km(ring_a[0], c) for c in ring_a) + 15
        for j, ring_b, lat_b in b.collect():
            far_b = 1.5708 * max(km(ring_b[0], c) for c in ring_b)
            if abs(lat_a - lat_b) <= 25 and chord(o, ring_b[0]) <= far_a + far_b:
                want.append((i, j, o, ring_a, ring_b))
    cand = spark.createDataFrame(want, "a_id long, b_id long, o struct<lat:double,lon:double>, ra array<struct<lat:double,lon:double>>, rb array<struct<lat:double,lon:double>>")
    rings = cand.select("a_id", "b_id", C.widen(C._in_plane(F.col("ra"), F.col("o.lat"), F.col("o.lon")), 15.0).alias("ra"), C._in_plane(F.col("rb"), F.col("o.lat"), F.col("o.lon")).alias("rb"))
    rings = rings.withColumn("ea", C.edges(F.col("ra"))).withColumn("eb", C.edges(F.col("rb")))
    meet = F.exists("ea", lambda s: F.exists("eb", lambda t: C.edges_meet(s, t)))
    inside = (C.winding(F.element_at("ra", 1), F.col("eb")) != 0) | (C.winding(F.element_at("rb", 1), F.col("ea")) != 0)
    expected = sorted((r.a_id, r.b_id) for r in rings.where(meet | inside).collect())
    assert len(expected) > 100 and got == expected


def spline_points(spark, n=240, pairs=3):
    rng = np.random.default_rng(21)
    rows = []
    for p in range(pairs):
        x, y, h = rng.uniform(0, 40, n), rng.uniform(0, 40, n), rng.uniform(0, 100, n)
        off = np.where(np.arange(n) % 10 == 0, 30.0, 0.0)
        rows += [(p, int(i), *map(float, v)) for i, v in enumerate(zip(x, y, x + 1 + (y / 40) ** 2 + 0.2 * h + off, y + y / 40 - 0.1 * h, h))]
    return spark.createDataFrame(rows, "pair_id long, match_id long, src_x double, src_y double, ref_x double, ref_y double, h double")


def test_splines_of_small_groups_take_no_distributed_round(spark, monkeypatch):
    """A group of one block goes through all rounds in one task; cut into blocks it gives the same model and rows."""
    points = spline_points(spark)
    stored = []
    monkeypatch.setattr(M, "cut_lineage", lambda df: stored.append(df) or cut_lineage(df))
    model, rows = M.pspline_fit(points, 8.0, 10.0, relief=True)
    assert len(stored) == 2
    monkeypatch.setattr(M, "BLOCK", 64)
    other, other_rows = M.pspline_fit(points, 8.0, 10.0, relief=True)
    assert len(stored) > 4
    a, b = ({r.pair_id: r for r in m.collect()} for m in (model, other))
    assert a.keys() == b.keys() == {0, 1, 2}
    for k in a:
        assert a[k].n_used == b[k].n_used and a[k].coef == pytest.approx(b[k].coef, abs=1e-6) and a[k].px == pytest.approx(b[k].px, abs=1e-8)
    a, b = ({(r.pair_id, r.match_id): (r.fit_px, r.is_inlier) for r in m.collect()} for m in (rows, other_rows))
    assert a.keys() == b.keys() and all(a[k][1] == b[k][1] and a[k][0] == pytest.approx(b[k][0], abs=1e-6) for k in a)


def test_terrain_is_made_by_many_tasks(spark, tmp_path):
    spark.range(1, 901).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    cells = matching_queries.terrain(Tables(spark, str(tmp_path)))
    assert cells.select(F.spark_partition_id()).distinct().count() > 1 and cells.count() == 31 * 6400


def test_patches_meet_tiles_without_a_row_per_cell(spark):
    """A match and a patch cell are no row of their own; cells that miss, repeat or have no value count as in SQL."""
    rng = np.random.default_rng(31)
    a, b = rng.uniform(0, 400, (2, 16, 8))
    b[:8, :4] = 7.1  # flat
    a[12, 6] = np.nan
    def strip(v):
        return raster(spark, v[:8], 0).unionByName(raster(spark, v[8:], 1))
    src = strip(a).unionByName(strip(a).where("tile_id = 0 AND row_no = 6 AND col_no = 1"))
    ref = strip(b).where("NOT (tile_id = 1 AND row_no = 6 AND col_no = 6)")
    rows = [(0, 1, 5.0, 4.0, 5.0, 3.0), (0, 2, 5.0, 7.0, 4.0, 8.0), (0, 3, 2.0, 2.0, 1.0, 1.0), (0, 4, 1.0, 5.0, 5.0, 4.0), (1, 5, 6.0, 3.0, 4.0, 3.0), (1, 6, 4.0, 5.0, 5.0, 5.0),
            (1, 7, 0.0, 2.0, 4.0, 3.0), (1, 8, 4.0, 1.0, 4.0, -2.0), (1, 9, 4.0, 3.0, 5.0, 2.0), (1, 9, 4.0, 3.0, 5.0, 2.0)]
    m = spark.createDataFrame(rows, "tile_id long, match_id long, sx double, sy double, rx double, ry double")
    out = L.patch_ncc(m, src, ref, 1, size=8)
    assert "sy" in out.columns and "explode(sequence(-1, 1" not in plan_of(out).lower()
    found = out.collect()
    assert len(found) == len(rows)
    def cells(df, p):
        return df.select((F.col("tile_id") * 8 + F.col("row_no")).alias(p + "l"), F.col("col_no").alias(p + "c"), F.col("dn").alias(p))
    off = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    j = m.withColumn("i", off).withColumn("j", off).select("match_id", *[(F.col("tile_id") * 8 + F.col(y) + F.col("i")).cast("bigint").alias(p + "l") for p, y in (("a", "sy"), ("b", "ry"))],
                                                         *[(F.col(x) + F.col("j")).cast("bigint").alias(p + "c") for p, x in (("a", "sx"), ("b", "rx"))])
    j = j.join(cells(src, "a"), ["al", "ac"]).join(cells(ref, "b"), ["bl", "bc"]).groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr("coalesce(try_divide(covar_pop(a, b), stddev_pop(a) * stddev_pop(b)), 0D)").alias("ncc"))
    want = {r.match_id: r.ncc for r in j.where("n = 9").collect()}
    assert want[3] == 0.0 and {1, 2, 5} <= want.keys() and not {4, 6, 7, 9} & want.keys()
    for r in found:
        assert (r.ncc is None) == (r.match_id not in want) and (r.ncc is None or r.ncc == pytest.approx(want[r.match_id], abs=1e-12))


def consensus_points(spark, n=150, pairs=3):
    rng = np.random.default_rng(22)
    rows = []
    for p in range(pairs):
        x, y = rng.uniform(0, 900, n), rng.uniform(0, 900, n)
        off = np.where(np.arange(n) % 3 == 0, rng.uniform(30, 200, n), rng.normal(0, 1, n))
        rows += [(p, int(i), *map(float, v)) for i, v in enumerate(zip(x, y, 1.01 * x - 0.02 * y + 5 + off, 0.02 * x + 1.01 * y - 3 + off / 2))]
    rows += [(0, None, None, None, None, None), rows[5], (7, 1, 0.0, 0.0, 1.0, 1.0)]  # an unknown point, a repeated one, a pair of one
    return spark.createDataFrame(rows, "pair_id long, match_id long, src_x double, src_y double, ref_x double, ref_y double")


@pytest.mark.parametrize("kind", ["translation", "similarity", "affine"])
def test_consensus_of_small_groups_is_fitted_in_one_task(spark, monkeypatch, kind):
    """A group of one block is neither ranked nor scored by distributed steps; cut into blocks it gives the same model and rows."""
    points = consensus_points(spark)
    points = points if kind != "affine" else points.where("match_id IS NOT NULL")
    ranked = []
    dense = M.dense_index
    monkeypatch.setattr(M, "dense_index", lambda *a, **k: ranked.append(a) or dense(*a, **k))
    model, rows = M.ransac(points, kind, 12.0, 60)
    assert not ranked
    monkeypatch.setattr(M, "BLOCK", 64)
    other, other_rows = M.ransac(points, kind, 12.0, 60)
    assert ranked and set(model.columns) == set(other.columns)
    a, b = ({r.pair_id: r for r in m.collect()} for m in (model, other))
    assert {0, 1, 2} <= a.keys() and {0, 1, 2} <= b.keys() and 7 not in a
    for k in (0, 1, 2):
        assert a[k].n_all == b[k].n_all and a[k].n_used == b[k].n_used and a[k].coef == pytest.approx(b[k].coef, abs=1e-9) and a[k].scale == pytest.approx(b[k].scale)
    a, b = (sorted((r.pair_id, r.match_id or -1, round(r.fit_px or 0.0, 6), r.is_inlier or False) for r in m.where("pair_id < 7").collect()) for m in (rows, other_rows))
    assert a == b and len(a) >= 450


def test_consensus_sweep_and_heldout_of_small_groups_equal_those_of_blocks(spark, monkeypatch):
    points = consensus_points(spark)
    def both():
        sweep = M.ransac_sweep(points, [12.0, 6.0], iters=40).where("pair_id < 7")
        held = M.heldout(points.where("match_id IS NOT NULL"), "similarity", "random_kfold", thresh=12.0, iters=40)[0].where("pair_id < 7")
        return [sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.select(sorted(df.columns)).collect()) for df in (sweep, held)]
    ranked = []
    dense = M.dense_index
    monkeypatch.setattr(M, "dense_index", lambda *a, **k: ranked.append(a) or dense(*a, **k))
    small = both()
    assert not ranked
    monkeypatch.setattr(M, "BLOCK", 32)
    assert both() == small and len(small[0]) == 6 and len(small[1]) == 18


def test_search_meets_the_overlaps_once_and_counts_no_pairs(spark, tmp_path):
    """Overlaps outnumber requests by far: they are made once and never made distinct."""
    spark.range(1, 61).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    plan = plan_of(QUERIES["c2_search_region"](spark, str(tmp_path)))
    assert plan.count("Generate explode(sequence") == 4 and "Union" not in plan
    o = spark.createDataFrame([(1, 2, 0.0, 1.0, 0.0, 1.0), (1, 2, 0.0, 1.0, 5.0, 6.0), (3, 4, 0.0, 2.0, 0.0, 2.0)], "a_id long, b_id long, min_lat double, max_lat double, min_lon double, max_lon double")
    asked = spark.createDataFrame([(1, 2), (8, 9)], "a_id long, b_id long")
    assert sorted((r.a_id, r.b_id, r.max_lon) for r in C.search_region(asked, o).collect() if r.a_id == 1) == [(1, 2, 1.0), (1, 2, 6.0)]
    assert {(r.a_id, r.b_id, r.max_lat) for r in C.search_region(asked, o, every=True).collect()} == {(1, 2, 1.0), (3, 4, 2.0), (8, 9, None)}


def test_filter_of_small_groups_makes_no_row_per_neighbour(spark, monkeypatch):
    """Small groups are not joined with their neighbours; cut into cells they give the same rows, also for ids that repeat."""
    points = consensus_points(spark).withColumn("tag", F.concat(F.lit("t"), "match_id")).where("match_id IS NOT NULL")
    points = points.unionByName(points.where("pair_id = 1 AND match_id IN (4, 9, 10)"))
    joined = []
    knn = J.knn_self
    monkeypatch.setattr(J, "knn_self", lambda *a, **k: joined.append(a) or knn(*a, **k))
    def rows():
        out = J.vector_median_filter(points)
        return sorted(tuple(round(v, 8) if isinstance(v, float) else str(v) for v in r) for r in out.select("pair_id", "match_id", "tag", "deviation", "threshold", "keep").collect())
    small = rows()
    assert not joined and len(small) == 455
    monkeypatch.setattr(J, "BLOCK", 100)
    assert rows() == small and joined


def test_thinning_of_small_groups_takes_no_distributed_round(spark, monkeypatch):
    points = consensus_points(spark).withColumn("score", F.when(F.col("match_id") != 17, (F.col("match_id") * 37 % 50).cast("double")))
    points = points.withColumn("src_x", F.when(F.col("match_id") < 60, F.col("src_x") / 9).otherwise(F.col("src_x")))
    stored = []
    monkeypatch.setattr(J, "cut_lineage", lambda df: stored.append(df) or cut_lineage(df))
    def rows():
        return sorted(str(tuple(r)) for r in J.spatial_dedup(points, 40.0).collect())
    small = rows()
    assert not stored and 100 < len(small) < 440
    monkeypatch.setattr(J, "BLOCK", 100)
    assert rows() == small and stored


def test_magnified_cells_make_no_row_per_corner(spark):
    """Corners are read inside a tile's task; cells that miss, repeat or have no value count as where corners are joined."""
    img = np.random.default_rng(9).uniform(0, 400, (8, 8))
    img[2, 5] = np.nan
    cells = raster(spark, img, 0).where("NOT (row_no = 6 AND col_no = 1)").unionByName(raster(spark, img, 3).where("row_no < 3"))
    cells = cells.unionByName(cells.where("tile_id = 3 AND row_no = 1 AND col_no = 4")).unionByName(cells.where("tile_id = 3 AND col_no = 2").withColumn("tile_id", F.lit(None).cast("long")))
    at = F.explode(F.array(*[F.lit(k) for k in range(3)]))
    grid = cells.withColumn("i", at).withColumn("j", at)
    def place(axis, k):
        return F.least(F.greatest(F.col(axis) + (F.col(k) + 0.5) / 3 - 0.5, F.lit(0.0)), F.lit(7.0))
    points = grid.select("tile_id", (F.col("row_no") * 3 + F.col("i")).alias("row_no"), (F.col("col_no") * 3 + F.col("j")).alias("col_no"), place("row_no", "i").alias("y"), place("col_no", "j").alias("x"))
    want = P.sample_raster(points, cells, "bilinear").select("tile_id", "row_no", "col_no", F.col("sampled").alias("dn"))
    seen = []
    old = P.sample_raster
    P.sample_raster = lambda p, *a, **k: seen.append(p) or old(p, *a, **k)
    try:
        got = R.magnify(cells, 8, 3)
    finally:
        P.sample_raster = old
    def rows(df):
        return sorted(str((r.tile_id, r.row_no, r.col_no, None if r.dn is None else round(r.dn, 8))) for r in df.collect())
    assert rows(got) == rows(want)
    assert sum(p.where("tile_id IS NOT NULL").count() for p in seen) == 0


def test_heights_of_a_tile_are_looked_up_in_one_task(spark, monkeypatch):
    """Equal to the rounds of joins, also with cells and points that repeat, cells without a value, points off the raster or on its
    last line, without a position or a tile; tiles without cells and cells without points."""
    rng = np.random.default_rng(4)
    cells = [(t, r, c, None if (r, c) == (3, 3) else float("nan") if (r, c) == (9, 2) else float(5 * r + 2 * c + rng.uniform(0, 3))) for t in (0, 1, 7) for r in range(12) for c in range(-2, 12)]
    cells += [*cells[5:9], (None, 1, 1, 1.0), (1, None, 2, 2.0)]
    dem = spark.createDataFrame(cells, "tile_id long, row_no long, col_no long, z double")
    rows = [(t % 2, i, float(x), float(y), t) for i, (t, x, y) in enumerate(zip(rng.integers(0, 3, 300).tolist(), rng.uniform(-3, 13, 300), rng.uniform(-2, 13, 300)))]
    rows += [*rows[:4], (0, 900, 2.0, 11.0, 0), (0, 901, None, 2.0, 0), (1, 902, 4.0, 4.0, None), (1, 902, 4.0, 4.0, None), (9, 903, 4.0, 4.0, 0), (0, 904, 1e300, 2.0, 1)]
    points = spark.createDataFrame(rows, "pair_id long, match_id long, src_x double, src_y double, tile_id long")
    coef = [[0.3] * 4 + [0.0] * 8 + [0.2] * 4 + [0.0] * 8, [0.0] * 24]
    model = spark.createDataFrame([(p, 0.0, 12.0, 1, 0.0, 1.0, 0.05, -0.04, c, h) for p, c, h in ((0, coef[0], 20.0), (1, coef[1], None))],
                                  "pair_id long, v0 double, v1 double, nseg int, uc double, us double, px double, py double, coef array<double>, h0 double")
    asked = []
    monkeypatch.setattr(M, "sample_raster", lambda p, *a, old=M.sample_raster: asked.append(1) or old(p, *a))
    order = lambda r: [(v is None, 0 if v is None else v) for v in r]
    safe = points.where("match_id <> 904")  # a join on cells cannot hold such a position
    got = sorted(map(tuple, M.predict_spline(safe, model, dem=dem).collect()), key=order)
    assert not asked and M.predict_spline(points.where("match_id = 904"), model, dem=dem).count() == 1
    monkeypatch.setattr(M, "BLOCK", 1)
    want = sorted(map(tuple, M.predict_spline(safe, model, dem=dem).collect()), key=order)
    assert len(asked) == 3 and len(got) == len(want) == 303
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-9, nan_ok=True)
    assert len({round(g[5] - g[2], 6) for g in got if g[2] is not None}) > 50
