"""Geometry lattices: nearest points, common regions, lattice checks, native spacing.

`keys` name the columns that tell products (or, where two lattices meet, product pairs) apart; without keys a table is
one product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tieline.functions import geo as G
from tieline.operators.ranking import grouped_quantiles


def nearest_geo(b: DataFrame, a: DataFrame, max_km: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each lattice point of B the nearest point of A on the sphere, within `max_km`.

    The threshold is the cell size, so the 27 cells around a point hold every answer the threshold allows: the
    result equals a tree search. Ties go to the lower (scan, pixel). Candidate rows are reduced where they are
    produced (partial aggregation) and never shuffled as pairs.
    """
    def place(df, p):
        x, y, z = G.latlon_to_xyz("lat", "lon")
        return df.select(*keys, F.col("scan").alias(f"{p}_scan"), F.col("pixel").alias(f"{p}_pixel"), F.col("lat").alias(f"{p}_lat"),
                         F.col("lon").alias(f"{p}_lon"), x.alias(f"{p}x"), y.alias(f"{p}y"), z.alias(f"{p}z"))

    pa, pb = place(a, "a"), place(b, "b")
    for ax in "xyz":
        pa = pa.withColumn(f"_c{ax}", F.floor(F.col(f"a{ax}") / max_km))
        base = F.floor(F.col(f"b{ax}") / max_km)
        pb = pb.withColumn(f"_c{ax}", F.explode(F.array(base - 1, base, base + 1)))
    d2 = sum(((F.col(f"a{ax}") - F.col(f"b{ax}")) * (F.col(f"a{ax}") - F.col(f"b{ax}")) for ax in "yz"),
             (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")))
    cand = pb.join(pa, [*keys, "_cx", "_cy", "_cz"]).withColumn("_d", F.sqrt(d2)).where(F.col("_d") <= max_km)
    best = cand.groupBy(*keys, "b_scan", "b_pixel").agg(
        F.min(F.struct("_d", "a_scan", "a_pixel", "a_lat", "a_lon", "b_lat", "b_lon")).alias("m"))
    return best.select(*keys, "b_scan", "b_pixel", F.col("m.b_lat").alias("b_lat"), F.col("m.b_lon").alias("b_lon"), "m.a_scan", "m.a_pixel",
                       "m.a_lat", "m.a_lon", F.col("m._d").alias("distance_km"))


def common_region(b: DataFrame, a: DataFrame, max_km: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scan and pixel windows of the shared area in both products, and the closest pair; no row without overlap."""
    n = nearest_geo(b, a, max_km, keys)
    closest = F.min(F.struct("distance_km", "b_scan", "b_pixel", "a_scan", "a_pixel", "a_lat", "a_lon"))
    windows = [f(c).alias(f"{c}_{f.__name__}") for c in ("a_scan", "a_pixel", "b_scan", "b_pixel") for f in (F.min, F.max)]
    out = n.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_overlap"), *windows,
        F.least(F.min("a_lat"), F.min("b_lat")).alias("lat_min"), F.greatest(F.max("a_lat"), F.max("b_lat")).alias("lat_max"),
        F.least(F.min("a_lon"), F.min("b_lon")).alias("lon_min"), F.greatest(F.max("a_lon"), F.max("b_lon")).alias("lon_max"),
        closest.alias("c")).where("n_overlap > 0")
    return out.select("*", F.col("c.distance_km").alias("min_distance_km"), F.col("c.a_scan").alias("center_a_scan"),
                      F.col("c.a_pixel").alias("center_a_pixel"), F.col("c.b_scan").alias("center_b_scan"),
                      F.col("c.b_pixel").alias("center_b_pixel"), F.col("c.a_lat").alias("center_lat"),
                      F.col("c.a_lon").alias("center_lon")).drop("c")


def lattice_gaps(geometry: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lattice positions (scan x pixel) of a product without a row; empty when the lattice is complete.

    Only scans whose pixel count falls short are expanded, so a complete lattice costs one aggregation. The pixels of a
    product's lattice are a bounded list (its detector's width).
    """
    by = list(keys) or ["_all"]
    g = geometry if keys else geometry.withColumn("_all", F.lit(0))
    pixels = g.groupBy(*by).agg(F.collect_set("pixel").alias("_p"))
    short = g.groupBy(*by, "scan").agg(F.count_distinct("pixel").alias("_k")).join(pixels, by).where(F.col("_k") < F.size("_p"))
    wanted = short.select(*by, "scan", F.explode("_p").alias("pixel"))
    return wanted.join(g.select(*by, "scan", "pixel"), [*by, "scan", "pixel"], "left_anti").select(*keys, "scan", "pixel")


def native_gsd(geometry: DataFrame, near_lat: float, near_lon: float, radius_m: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median ground spacing per sample and per line of lattice points near a position, per product."""
    by = list(keys) or ["_all"]
    near = (geometry if keys else geometry.withColumn("_all", F.lit(0))).where(G.haversine_m("lat", "lon", F.lit(near_lat), F.lit(near_lon)) < radius_m)

    def spacing(part, along, out):
        w = Window.partitionBy(*by, part).orderBy(along)
        d = G.haversine_m("lat", "lon", F.lag("lat").over(w), F.lag("lon").over(w)) / (F.col(along) - F.lag(along).over(w))
        return grouped_quantiles(near.select(*by, d.alias("_d")), by, "_d", {out: 0.5})

    return spacing("scan", "pixel", "sample_m").join(spacing("pixel", "scan", "line_m"), by).select(*keys, "sample_m", "line_m")
