"""Registered queries of sources and sinks: data derived from the tables is written to shared storage by Spark and
read back through the source under test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tieline.operators import dataset as D, tiepoints as T
from tieline.plans.tiepoint_queries import residuals, rounded, stats, transforms
from tieline.registry import query
from tieline.session import shared_path, spread
from tieline.sources import labels as A, raster as R, sinks as W, tables as S


def local(path: str) -> str:
    """Plain path of a mounted shared folder for readers that open files themselves."""
    return path.removeprefix("file:")


@query("a1_scan_geometry", "SELECT scan, pixel, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {geometry_a}")
def _(t):
    path = shared_path(t.spark, "geometry")
    t.geometry_a.select(F.col("lon").alias("Longitude"), F.col("lat").alias("Latitude"), F.col("pixel").alias("Pixel"), F.col("scan").alias("Scan")).write.option("header", True).csv(path)
    return rounded(S.scan_geometry(t.spark, path).select("scan", "pixel", "lat", "lon"))


@query("a2_scan_catalog", """
SELECT product_id, round((2 * max_lat + 2 * min_lat) / 4, 6) + 0.0 AS lat_c, solar_incidence, file_size_mb FROM {products} WHERE product_id % 11 <> 0""")
def _(t):
    path = shared_path(t.spark, "catalog")
    corner = lambda v, h: [F.col("max_lat" if v == "upper" else "min_lat").alias(f"{v}_{h}_latitude"), F.col("min_lon" if h == "left" else "max_lon").alias(f"{v}_{h}_longitude")]
    cols = [c for v in ("upper", "lower") for h in ("left", "right") for c in corner(v, h)]
    bad = t.products.select("product_id", "solar_incidence", "sun_azimuth", "file_size_mb", *cols).withColumn(
        "upper_left_latitude", F.when(F.col("product_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("upper_left_latitude").cast("string")))
    bad.write.option("header", True).csv(path)
    c = S.scan_catalog(t.spark, path)
    return rounded(c.select(F.col("product_id").cast("bigint").alias("product_id"), "lat_c", "solar_incidence", "file_size_mb"))


def tie_rows(t):
    return W.tiepoint_rows(residuals(t), t.transforms, 1000.0, 1000.0)


@query("a3_scan_tiepoints", """
SELECT match_id, round(src_x, 2) AS src_x, CAST(residual_px <= 15 AS INT) AS is_inlier FROM {residuals}""")
def _(t):
    path = shared_path(t.spark, "tiepoints")
    W.write_tiepoints(tie_rows(t), path, "Local planar approximation, not geodetic coordinates")
    return S.scan_tiepoints(t.spark, path).select("match_id", "src_x", "is_inlier")


XML = """<?xml version="1.0"?><p:Product xmlns:p="http://pds.nasa.gov/pds4/pds/v1" xmlns:i="http://example.org/i"><p:File><p:file_name>%d.img</p:file_name><p:file_size>%d</p:file_size></p:File>
<p:Array><p:Axis_Array><p:axis_name>Sample</p:axis_name><p:elements>%d</p:elements><p:sequence_number>2</p:sequence_number></p:Axis_Array><p:Axis_Array><p:axis_name>Line</p:axis_name><p:elements>%d</p:elements><p:sequence_number>1</p:sequence_number></p:Axis_Array>
<p:Element_Array><p:data_type>%s</p:data_type></p:Element_Array></p:Array><i:pixel_resolution>%s</i:pixel_resolution><i:solar_incidence>%s</i:solar_incidence><i:area>South Pole</i:area>
<i:System_Level_Coordinates><i:upper_left_latitude>0.5</i:upper_left_latitude><i:upper_left_longitude>1.5</i:upper_left_longitude></i:System_Level_Coordinates>%s%s</p:Product>"""


def labels_xml(t):
    """Label text of every product, built from its row; every third product has no refined corners."""
    k = F.col("product_id")
    tag = lambda n, c: F.concat(F.lit(f"<i:{n}>"), c.cast("string"), F.lit(f"</i:{n}>"))
    ring = F.concat(F.lit("<i:Refined_Corner_Coordinates>"), tag("upper_left_latitude", F.col("max_lat")), tag("upper_left_longitude", F.col("min_lon")),
                    tag("lower_right_latitude", F.col("min_lat")), tag("lower_right_longitude", F.col("max_lon")), F.lit("</i:Refined_Corner_Coordinates>"))
    band = F.concat_ws("", F.transform(F.sequence(F.lit(3), F.lit(1)), lambda b: F.concat(
        F.lit("<p:Band_Bin><p:band_number>"), b.cast("string"), F.lit("</p:band_number><p:center_wavelength>"), (k + b * 20).cast("string"), F.lit("</p:center_wavelength></p:Band_Bin>"))))
    lines, samples = 100 + k % 50, 40 + k % 7
    xml = F.format_string(XML, k, lines * samples * 2, samples.cast("int"), lines.cast("int"), F.when(k % 2 == 0, "UnsignedLSB2").otherwise("IEEE754LSBSingle"),
                          F.col("gsd_m").cast("string"), F.coalesce(F.col("solar_incidence").cast("string"), F.lit("")), F.when(k % 3 != 0, ring).otherwise(F.lit("")), band)
    return spread(t.products, "product_id").select("product_id", F.regexp_replace(xml, "\n", " ").alias("xml"))


@query("a4_scan_labels", """
SELECT product_id, product_id || '.img' AS file_name, (100 + product_id % 50) * (40 + product_id % 7) * 2 AS file_size, CASE WHEN product_id % 2 = 0 THEN 'UnsignedLSB2' ELSE 'IEEE754LSBSingle' END AS data_type,
  'Line,Sample' AS axes, 100 + product_id % 50 AS lines, gsd_m AS pixel_resolution, solar_incidence, 'South Pole' AS area, CASE WHEN product_id % 3 <> 0 THEN 2 ELSE 1 END AS n_corners,
  round(CASE WHEN product_id % 3 <> 0 THEN max_lat ELSE 5e-1 END, 6) + 0.0 AS first_lat FROM {products}""")
def _(t):
    p = A.parse_labels(labels_xml(t))
    return rounded(p.select("product_id", "file_name", "file_size", "data_type", F.array_join("axis_names", ",").alias("axes"), F.element_at("elements", 1).alias("lines"),
                            "pixel_resolution", "solar_incidence", "area", F.size("corners").alias("n_corners"), F.col("corners")[0]["lat"].alias("first_lat")))


@query("a4_scan_label_files", """
SELECT product_id || '.img' AS file_name, (100 + product_id % 50) * (40 + product_id % 7) * 2 AS file_size, 100 + product_id % 50 AS lines FROM {products}""")
def _(t):
    """Labels written as files, one per product, and scanned from their folder."""
    path = shared_path(t.spark, "labels")
    W.write_texts(labels_xml(t).select("product_id", F.col("xml").alias("value")), "product_id", path)
    p = A.scan_labels(t.spark, path).where(F.length("xml") > 0)  # Spark leaves an empty file where its first task has no rows
    return p.select("file_name", "file_size", F.element_at("elements", 1).alias("lines"))


@query("a6_scan_header_files", """
SELECT 100 + product_id % 50 AS lines, 40 + product_id % 7 AS samples, CASE WHEN product_id % 2 = 0 THEN 'bil' ELSE 'bsq' END AS interleave, count(*) AS n FROM {products} GROUP BY ALL""")
def _(t):
    """Layout headers written as files, one per product, and scanned from their folder."""
    path, k = shared_path(t.spark, "headers"), F.col("product_id")
    text = F.concat(F.lit("ENVI\nlines = "), (100 + k % 50).cast("string"), F.lit("\nsamples = "), (40 + k % 7).cast("string"), F.when(k % 2 == 0, F.lit("\ninterleave = BIL")).otherwise(F.lit("")))
    W.write_texts(t.products.select("product_id", text.alias("value")), "product_id", path)
    h = A.scan_envi_headers(t.spark, path)
    return h.groupBy("lines", "samples", "interleave").agg(F.count(F.lit(1)).alias("n"))


@query("a14_write_geojson", """
SELECT pair_id, count(*) AS n FROM {residuals} GROUP BY pair_id""")
def _(t):
    """Features written as lines and read back as JSON."""
    path = shared_path(t.spark, "features")
    W.write_geojson(W.geojson_features(residuals(t), "ref_x", "ref_y", ["pair_id", "match_id"]), path)
    back = t.spark.read.schema("type string, geometry struct<type:string,coordinates:array<double>>, properties struct<pair_id:bigint,match_id:bigint>").json(path)
    return back.where("geometry.type = 'Point' AND size(geometry.coordinates) = 2").groupBy("properties.pair_id").agg(F.count(F.lit(1)).alias("n"))


@query("a5_label_bands", "SELECT product_id, b AS band, (product_id + b * 20) * 1e0 AS wavelength_nm FROM {products}, (SELECT unnest([1, 2, 3]) AS b) n")
def _(t):
    return A.label_bands(labels_xml(t), "product_id")


@query("a6_scan_envi_headers", """
SELECT product_id, 100 + product_id % 50 AS lines, CASE WHEN product_id % 5 = 0 THEN 0 ELSE 40 + product_id % 7 END AS samples, 4 AS data_type, CASE WHEN product_id % 2 = 0 THEN 'bil' ELSE 'bsq' END AS interleave FROM {products}""")
def _(t):
    k = F.col("product_id")
    rows = F.array(F.lit("ENVI"), F.concat(F.lit("lines = "), (100 + k % 50).cast("string")), F.when(k % 5 == 0, F.lit("samples = many")).otherwise(F.concat(F.lit("Samples="), (40 + k % 7).cast("string"))),
                   F.when(k % 2 == 0, F.lit("interleave = BIL")).otherwise(F.lit("description = {a = b}")))
    lines = t.products.select(k.cast("string").alias("path"), F.explode(rows).alias("value"))
    return A.parse_headers(lines).select(F.col("path").cast("bigint").alias("product_id"), "lines", "samples", "data_type", "interleave")


def raster_files(t):
    """Write each pixel tile as a headerless little-endian file; returns the label table."""
    folder = local(shared_path(t.spark, "rasters"))
    full = t.pixels_b.select("tile_id", "row_no", "col_no", "dn")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        import numpy as np

        os.makedirs(folder, exist_ok=True)
        tile, lines = int(pdf["tile_id"].iloc[0]), int(pdf["row_no"].max()) + 1
        img = np.zeros((lines, 32), dtype="<u2")
        img[pdf["row_no"].to_numpy(), pdf["col_no"].to_numpy()] = pdf["dn"].to_numpy().astype("<u2")
        path = f"{folder}/{tile}.img"
        img.tofile(path)
        return pd.DataFrame({"product_id": [tile], "file_path": [path], "storage": ["<u2"], "lines": [lines], "samples": [32]})

    from tieline.session import cut_lineage

    return folder, cut_lineage(full.groupBy("tile_id").applyInPandas(write, "product_id long, file_path string, storage string, lines int, samples int"))


@query("a7_scan_rasters", """
SELECT tile_id AS product_id, row_no AS line, sum(dn * (col_no + 1)) AS checksum FROM {pixels_b} GROUP BY ALL""")
def _(t):
    _, lab = raster_files(t)
    px = R.line_pixels(R.scan_rasters(lab, 8))
    return px.groupBy("product_id", "line").agg(F.sum(F.col("dn") * (F.col("sample") + 1)).cast("double").alias("checksum"))


@query("a7_raster_source_pushdown")
def _(t):
    folder, lab = raster_files(t)
    first = lab.where("product_id = 0").select("file_path", "lines").first()
    return R.scan_raster(t.spark, first.file_path, "<u2", first.lines, 32, blocklines=4).where("line >= 5 AND line < 11")


def cube_file(t, interleave):
    """The first-product cube written by one task per line block would need a merge; a product is one file, so one
    grouped task per product writes it."""
    folder = local(shared_path(t.spark, "cubes"))
    c = t.cube.select("product_id", "line", "sample", "spectrum")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        import numpy as np

        os.makedirs(folder, exist_ok=True)
        n_lines, n_samples, nb = int(pdf["line"].max()) + 1, 25, len(pdf["spectrum"].iloc[0])
        a = np.zeros((n_lines, n_samples, nb), dtype="<f4")
        a[pdf["line"].to_numpy(), pdf["sample"].to_numpy()] = np.vstack(pdf["spectrum"].to_numpy())
        path = f"{folder}/{int(pdf['product_id'].iloc[0])}.qub"
        (a.transpose(2, 0, 1) if interleave == "bsq" else a.transpose(0, 2, 1)).astype("<f4").tofile(path)
        return pd.DataFrame({"product_id": [int(pdf["product_id"].iloc[0])], "file_path": [path], "lines": [n_lines], "bands": [nb]})

    from tieline.session import cut_lineage

    return cut_lineage(c.groupBy("product_id").applyInPandas(write, "product_id long, file_path string, lines int, bands int"))


@query("a8_scan_cube")
def _(t):
    f = cube_file(t, "bil").where("product_id = 0").first()
    c = R.scan_cube(t.spark, f.file_path, "<f4", f.lines, 25, f.bands, "bil", [0, 5, 9])
    return c.select("line", "sample", F.size("spectrum").alias("n_bands"), F.round(F.col("spectrum")[1], 6).alias("band5"))


@query("a9_check_file_sizes", """
WITH l AS (SELECT tile_id, max(row_no) + 1 AS lines FROM {pixels_b} GROUP BY tile_id)
SELECT tile_id || '.img' AS file_name, CASE WHEN tile_id % 5 = 0 THEN 'label size' WHEN tile_id % 5 = 1 THEN 'size on disk' ELSE 'missing file' END AS issue FROM l WHERE tile_id % 5 < 3""")
def _(t):
    folder, lab = raster_files(t)
    k = F.col("product_id")
    labels = lab.select(
        F.when(k % 5 == 2, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit(".img"))).alias("file_name"), F.lit("UnsignedLSB2").alias("data_type"),
        F.array((F.col("lines") + F.when(k % 5 == 1, 1).otherwise(0)), F.col("samples")).alias("elements"),
        ((F.col("lines") + F.when(k % 5 == 1, 1).otherwise(0)) * 64 + F.when(k % 5 == 0, 2).otherwise(0)).cast("bigint").alias("file_size"))
    bad = A.check_file_sizes(labels, A.stored_files(t.spark, folder))
    return bad.select(F.when(F.col("issue") == "missing file", F.concat(F.regexp_replace("file_name", "x", ""), F.lit(".img"))).otherwise(F.col("file_name")).alias("file_name"), "issue")


RESULT_SCHEMA = "matcher string, hop string, raw_matches bigint, inliers bigint, rmse_px double"


@query("a10_scan_results_json", """
SELECT pair_id % 3 || '-matcher' AS matcher, 'hop' || pair_id AS hop, count(*) AS raw_matches, count(*) FILTER (residual_px <= 15) AS inliers FROM {residuals} GROUP BY pair_id""")
def _(t):
    path = shared_path(t.spark, "results")
    r = residuals(t).groupBy("pair_id").agg(F.count(F.lit(1)).alias("raw_matches"), F.count_if(F.col("residual_px") <= 15).alias("inliers"))
    r.select(F.concat((F.col("pair_id") % 3).cast("string"), F.lit("-matcher")).alias("matcher"), F.concat(F.lit("hop"), F.col("pair_id").cast("string")).alias("hop"), "raw_matches", "inliers").write.json(path)
    return S.scan_results_json(t.spark, [path, f"{path}-absent"], RESULT_SCHEMA, arrays=False).select("matcher", "hop", "raw_matches", "inliers")


def shards(t):
    d = t.documents.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("payload"))
    return D.assign_shards(d, 100)


SHARDS = "(SELECT doc_id AS pair_id, text AS payload, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 1e2) AS BIGINT) AS shard, (row_number() OVER (ORDER BY doc_id) - 1) % 100 AS position FROM {documents})"


@query("a11_scan_pairs", f"""
SELECT shard, pair_id, row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5('7:' || shard || ':' || pair_id), 1, 8) AS BIGINT), pair_id) AS pair_order,
  CAST('0x' || substr(md5('7:' || shard), 1, 8) AS BIGINT) AS shard_order FROM {SHARDS} s WHERE shard IN (1, 3, 4) AND position < 60""")
def _(t):
    path = shared_path(t.spark, "pairs")
    W.write_shards(shards(t), path)
    p = S.scan_pairs(t.spark, path, [1, 3, 4]).withColumn("shard", F.col("shard").cast("bigint"))
    return D.read_order(p, 7, max_per_shard=60).select("shard", "pair_id", "pair_order", "shard_order")


@query("a12_dtype_lookup", "SELECT product_id, CASE WHEN product_id % 2 = 0 THEN '<u2' ELSE '<f4' END AS storage, CASE WHEN product_id % 2 = 0 THEN 2 ELSE 4 END AS item_bytes FROM {products}")
def _(t):
    d = t.products.select("product_id", F.when(F.col("product_id") % 2 == 0, "UnsignedLSB2").otherwise("IEEE754LSBSingle").alias("data_type"))
    return A.dtype_lookup(d).select("product_id", "storage", "item_bytes")


@query("a13_tiepoint_rows", """
SELECT pair_id, match_id, printf('%.2f', round(src_x, 2)) AS src_x, CAST(residual_px <= 15 AS INT) AS is_inlier FROM {residuals}""")
def _(t):
    return tie_rows(t).select("pair_id", "match_id", "src_x", "is_inlier")


@query("a14_geojson_features", """
SELECT pair_id, match_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(src_x AS VARCHAR) || ',' || CAST(src_y AS VARCHAR) || ']}},"properties":{{"match_id":' || match_id || ',"residual_px":' || CAST(round(residual_px, 4) AS VARCHAR) || '}}}}' AS feature
FROM {residuals} WHERE residual_px <= 15 AND residual_px > 1e-1""")
def _(t):
    r = residuals(t).where("residual_px <= 15 AND residual_px > 0.1")
    return W.geojson_features(r, "src_x", "src_y", [F.col("match_id"), F.round("residual_px", 4).alias("residual_px")])


@query("a15_refuse_overwrite", "SELECT pair_id, count(*) AS n, 1 AS refused FROM {tiepoints} GROUP BY pair_id")
def _(t):
    path = shared_path(t.spark, "product")
    d = t.tiepoints.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    d.write.mode("errorifexists").parquet(path)
    try:
        d.write.mode("errorifexists").parquet(path)
        refused = 0
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        refused = 1
    return t.spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query("a16_write_shards", f"SELECT shard, count(*) AS n, min(pair_id) AS first_id, max(pair_id) AS last_id FROM {SHARDS} s GROUP BY shard")
def _(t):
    path = shared_path(t.spark, "shards")
    W.write_shards(shards(t), path)
    return t.spark.read.parquet(path).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("pair_id").alias("first_id"), F.max("pair_id").alias("last_id"))


@query("a17_shard_manifest", f"""
SELECT shard, count(*) AS pair_count, CAST(sum(strlen(payload)) AS BIGINT) AS size_bytes, sha256(string_agg(sha256(payload), '' ORDER BY pair_id)) AS sha256 FROM {SHARDS} s GROUP BY shard""")
def _(t):
    return D.shard_manifest(shards(t))


@query("a18_verify_manifest", f"""
SELECT shard, CASE WHEN shard % 4 = 0 THEN 'pair_count' ELSE 'sha256' END AS problems FROM (SELECT DISTINCT shard FROM {SHARDS} s) d WHERE shard % 4 = 0 OR shard % 3 = 1""")
def _(t):
    m = D.shard_manifest(shards(t))
    k = F.col("shard")
    kept = m.withColumn("pair_count", F.col("pair_count") + F.when(k % 4 == 0, 1).otherwise(0)).withColumn("sha256", F.when((k % 3 == 1) & (k % 4 != 0), F.lit("0")).otherwise(F.col("sha256")))
    return D.verify_manifest(m, kept).select("shard", F.array_join("problems", ",").alias("problems"))


@query("h29_sha256", "SELECT doc_id, sha256(text) AS digest FROM {documents}")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("a20_append_run_log", "SELECT epoch, steps, round(val_loss, 6) AS val_loss FROM {train_log}")
def _(t):
    path = shared_path(t.spark, "log")
    for part in (t.train_log.where("epoch <= 15"), t.train_log.where("epoch > 15")):
        W.append_run_log(part, path)
    return rounded(t.spark.read.parquet(path))


@query("a21_metrics_json", """
SELECT pair_id, '{{"pair_id":' || pair_id || ',"counts":{{"n_matches":' || n || ',"n_inliers":' || k || '}},"flags":{{"gated":' || (k < 200) || '}}}}' AS metrics
FROM (SELECT pair_id, count(*) AS n, count(*) FILTER (residual_px <= 15) AS k FROM {residuals} GROUP BY pair_id) x""")
def _(t):
    s = residuals(t).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(F.col("residual_px") <= 15).alias("n_inliers"))
    return D.metrics_json(s.withColumn("gated", F.col("n_inliers") < 200), {"counts": ["n_matches", "n_inliers"], "flags": ["gated"]})


@query("a22_scorecard", """
WITH s AS (SELECT pair_id % 4 AS config, count(*) * 1e0 AS n_matches, round(sqrt(avg(residual_px * residual_px)), 6) AS rmse FROM {residuals} GROUP BY ALL)
SELECT 'n_matches' AS metric, max(n_matches) FILTER (config = 0) AS "0", max(n_matches) FILTER (config = 1) AS "1", max(n_matches) FILTER (config = 2) AS "2", max(n_matches) FILTER (config = 3) AS "3" FROM s
UNION ALL SELECT 'rmse', max(rmse) FILTER (config = 0), max(rmse) FILTER (config = 1), max(rmse) FILTER (config = 2), max(rmse) FILTER (config = 3) FROM s""")
def _(t):
    s = residuals(t).groupBy((F.col("pair_id") % 4).alias("config")).agg(F.count(F.lit(1)).alias("n_matches"), F.round(F.sqrt(F.avg(F.col("residual_px") * F.col("residual_px"))), 6).alias("rmse"))
    return D.scorecard(D.long_metrics(s, ["n_matches", "rmse"], "config"), "config", [0, 1, 2, 3])


EDGES = [0.0, 30.0, 60.0, 90.0, 120.0, 150.0, 180.0]


@query("d10_histogram", """
WITH h AS (SELECT CASE WHEN d = 180 THEN 5 ELSE CAST(floor(d / 3e1) AS INT) END AS bin, count(*) AS n FROM (SELECT least(abs(az_a - az_b) % 360, 360 - abs(az_a - az_b) % 360) AS d FROM {pair_stats}) x GROUP BY ALL)
SELECT b AS bin, b * 3e1 AS lo, b * 3e1 + 30 AS hi, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM h) * 100, 6) AS pct FROM (SELECT unnest(range(6)) AS b) g LEFT JOIN h ON bin = b""")
def _(t):
    from tieline.functions.geo import az_diff

    return rounded(D.histogram(t.pair_stats, az_diff("az_a", "az_b"), EDGES))


@query("d30_coverage_stats", """
SELECT count(*) AS n, round(min(mask_coverage) * 100, 6) AS min_pct, round(avg(mask_coverage) * 100, 6) AS mean_pct, bool_and(mask_coverage >= 4e-1) AS all_above_threshold,
  round(median(mask_coverage * 100), 6) AS median_pct FROM {pair_stats}""")
def _(t):
    return rounded(D.coverage_stats(t.pair_stats))


@query("d31_recovery_error", """
SELECT round((src_x % 1), 1) AS true_shift, count(*) AS n, round(avg(e), 6) AS mae_px, round(sqrt(avg(e*e)), 6) AS rmse_px, round(max(e), 6) AS max_px, round(avg(ex), 6) + 0.0 AS bias_x, round(avg(ey), 6) + 0.0 AS bias_y
FROM (SELECT *, ref_x - src_x AS ex, ref_y - src_y AS ey, sqrt((ref_x - src_x)*(ref_x - src_x) + (ref_y - src_y)*(ref_y - src_y)) AS e FROM {tiepoints}) z GROUP BY ALL""")
def _(t):
    tr = t.tiepoints.select(F.col("src_x").alias("true_dx"), F.col("src_y").alias("true_dy"), F.col("ref_x").alias("dx"), F.col("ref_y").alias("dy"))
    return rounded(D.recovery_error(tr, F.round(F.col("true_dx") % 1, 1)))


@query("e14_early_stop", """
SELECT epoch, round(b, 6) AS best_loss, be AS best_epoch, epoch - be AS epochs_since_best, epoch - be >= 5 AS stop FROM (
  SELECT epoch, min(val_loss) OVER w AS b, arg_min(epoch, val_loss) OVER w AS be FROM {train_log} WINDOW w AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x""")
def _(t):
    return rounded(D.early_stop(t.train_log, 5).select("epoch", "best_loss", "best_epoch", "epochs_since_best", "stop"))


@query("f6_stratified_sample", """
SELECT render_mode, pair_id, sample_no FROM (SELECT *, row_number() OVER (PARTITION BY render_mode ORDER BY CAST('0x' || substr(md5('42:' || pair_id), 1, 8) AS BIGINT), pair_id) AS sample_no FROM {pair_stats}) x WHERE sample_no <= 12""")
def _(t):
    return D.stratified_sample(t.pair_stats, 12, "render_mode").select("render_mode", "pair_id", "sample_no")


@query("f7_level_for_scale", """
SELECT pair_id, CAST(l AS INT) AS level FROM (SELECT pair_id, l, row_number() OVER (PARTITION BY pair_id ORDER BY abs(pow(5e-1, l) - scale_factor / 5), l) AS rn FROM {pair_stats}, (SELECT unnest(range(6)) AS l) g) x WHERE rn = 1""")
def _(t):
    lv = t.pair_stats.select("pair_id", (F.col("scale_factor") / 5).alias("target"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level")).withColumn("scale", F.pow(F.lit(0.5), F.col("level")))
    return D.level_for_scale(lv, "target", ["pair_id"]).select("pair_id", "level")


@query("h18_coarse_index", """
WITH c AS (SELECT pair_id, y * 8 + x AS idx_a, CAST(round_even((a * (x*8+4) - b * (y*8+4) + tx) / 8, 0) AS BIGINT) AS bx, CAST(round_even((b * (x*8+4) + a * (y*8+4) + ty) / 8, 0) AS BIGINT) AS by_
  FROM {transforms}, (SELECT unnest(range(8)) AS x) p, (SELECT unnest(range(8)) AS y) q)
SELECT pair_id, idx_a, by_ * 8 + bx AS idx_b FROM c WHERE bx BETWEEN 0 AND 7 AND by_ BETWEEN 0 AND 7""")
def _(t):
    return D.coarse_index(transforms(t).select("pair_id", "h"), 64, 8).select("pair_id", "idx_a", "idx_b")


@query("g1_union_results", """
SELECT 'inliers' AS part, pair_id, count(*) AS n, CAST(NULL AS DOUBLE) AS rmse FROM {residuals} WHERE residual_px <= 15 GROUP BY ALL
UNION ALL SELECT 'all', pair_id, count(*), round(sqrt(avg(residual_px * residual_px)), 6) FROM {residuals} GROUP BY ALL""")
def _(t):
    r = residuals(t)
    a = r.where("residual_px <= 15").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("inliers"))
    b = r.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("residual_px") * F.col("residual_px"))).alias("rmse")).withColumn("part", F.lit("all"))
    return rounded(D.union_results(a, b))


@query("g4_table_difference", """
SELECT pair_id, match_id, 'left' AS side FROM {tiepoints} WHERE match_id % 50 = 0 UNION ALL SELECT pair_id, match_id + 1000000, 'right' FROM {tiepoints} WHERE match_id % 50 = 0""")
def _(t):
    a = t.tiepoints.select("pair_id", "match_id")
    b = a.withColumn("match_id", F.col("match_id") + F.when(F.col("match_id") % 50 == 0, 1000000).otherwise(0))
    return D.table_difference(a, b)
