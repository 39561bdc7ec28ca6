"""Product catalog: footprints, box and polygon overlap, instrument look-ups, pair search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tieline.fixed import INSTRUMENTS, INSTRUMENT_SCHEMA, MOON_RADIUS_KM, MOON_RADIUS_M
from tieline.functions import geo as G
from tieline.functions.transforms import let
from tieline.session import cut_lineage, spread


FAN, LEVELS, MOST_CANDIDATES = 4, 12, 1_000_000


def box_join(a: DataFrame, b: DataFrame, dims: list[tuple[str, str, str, str]], cell: float | Column, on: list[str] | None = None,
             most: int = MOST_CANDIDATES, costly: bool = False) -> DataFrame:
    """Pairs of overlapping boxes through shared grid cells (an equi-join, never a nested loop).

    `dims` lists (a_low, a_high, b_low, b_high) per axis. A pair is kept only in the cell that holds the lower
    corner of the intersection, so no duplicate removal (and no shuffle for it) is needed.

    A cell with more than `most` candidate pairs is divided by FAN along each axis, its parts again, up to LEVELS times, as
    long as that is expected to halve its candidates. So boxes much smaller than `cell` that crowd in one spot are not
    compared all with all; boxes that do overlap are pairs of the result and stay. The parts of a cell do not overlap, and
    each level costs one count of the rows in divided cells. Boxes with a null bound meet nothing.

    `costly` deals the cells over all tasks before they meet: for pairs that cost much more than their bytes tell.
    """
    on = on or []
    cells = [f"_c{i}" for i in range(len(dims))]

    def first_last(lo, hi, level):
        """Cells of a level that a side reaches along one axis. FAN is a power of two: a part's number divided by it is
        exactly its cell's."""
        n = float(FAN ** level)
        return F.floor(F.col(lo) / cell * n), F.floor(F.col(hi) / cell * n)

    def in_cells(df, pick):
        for c, d in zip(cells, dims):
            df = df.withColumn(c, F.explode(F.sequence(*first_last(*pick(d), 0))))
        return df

    def inner(pick, level):
        """Parts of a row's cell that the row reaches, per axis: (first, last)."""
        reach = [first_last(*pick(d), level + 1) for d in dims]
        return [(F.greatest(lo, F.col(c) * FAN), F.least(hi, F.col(c) * FAN + FAN - 1)) for c, (lo, hi) in zip(cells, reach)]

    def crowd(df, pick, level, name):
        parts = F.lit(1.0)
        for lo, hi in inner(pick, level):
            parts = parts * (hi - lo + 1)
        return df.groupBy(*on, *cells).agg(F.count(F.lit(1)).cast("double").alias(f"_n{name}"), F.sum(parts).alias(f"_p{name}"))

    def divided(df, pick, level, hot):
        df = df.join(hot, [*on, *cells])
        for c, (lo, hi) in zip(cells, inner(pick, level)):
            df = df.withColumn(c, F.explode(F.sequence(lo, hi)))
        return df

    def met(left, right, level):
        joined = (spread(left, *on, *cells) if costly else left).join(right, [*on, *cells])
        keep = F.lit(True)
        for c, (alo, ahi, blo, bhi) in zip(cells, dims):
            keep = (keep & (F.col(alo) <= F.col(bhi)) & (F.col(blo) <= F.col(ahi))
                    & (F.col(c) == F.floor(F.greatest(alo, blo) / cell * float(FAN ** level))))
        return joined.where(keep).drop(*cells)

    def of_a(d):
        return d[:2]

    def of_b(d):
        return d[2:]

    left, right, out = in_cells(a, of_a), in_cells(b, of_b), None
    for level in range(LEVELS + 1):
        hot = None
        if level < LEVELS:
            both = crowd(left, of_a, level, "a").join(crowd(right, of_b, level, "b"), [*on, *cells])
            now = F.col("_na") * F.col("_nb")
            then = F.col("_pa") * F.col("_pb") / float(FAN ** len(dims))
            hot = cut_lineage(both.where((now > most) & (then * 2 <= now)).select(*on, *cells))
            if hot.isEmpty():
                hot = None
        cold = [df.join(hot, [*on, *cells], "left_anti") if hot is not None else df for df in (left, right)]
        pairs = met(*cold, level)
        out = pairs if out is None else out.unionByName(pairs)
        if hot is None:
            return out
        left, right = (cut_lineage(divided(df, pick, level, hot)) for df, pick in ((left, of_a), (right, of_b)))
    return out


def split_wrapped(fp: DataFrame) -> DataFrame:
    """Boxes crossing the 0/360 seam become two boxes inside [0, 360]."""
    lo, hi = F.col("min_lon"), F.col("max_lon")
    def piece(a, b):
        return F.struct(a.cast("double").alias("lo"), b.cast("double").alias("hi"))
    pieces = (F.when(lo < 0, F.array(piece(lo + 360, F.lit(360.0)), piece(F.lit(0.0), hi)))
              .when(hi > 360, F.array(piece(lo, F.lit(360.0)), piece(F.lit(0.0), hi - 360))).otherwise(F.array(piece(lo, hi))))
    return fp.withColumn("_p", F.explode(pieces)).withColumn("min_lon", F.col("_p.lo")).withColumn(
        "max_lon", F.col("_p.hi")).drop("_p")


def footprint_overlap(a: DataFrame, b: DataFrame, cell_deg: float = 2.0) -> DataFrame:
    """Overlap box and covered fraction of both footprints, one row per overlapping box piece."""
    def side(df, p):
        area = (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))
        d = split_wrapped(df.withColumn("area", area))
        return d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("product_id", "min_lat", "max_lat", "min_lon", "max_lon", "area")])

    j = box_join(side(a, "a"), side(b, "b"), [("a_min_lat", "a_max_lat", "b_min_lat", "b_max_lat"),
                                              ("a_min_lon", "a_max_lon", "b_min_lon", "b_max_lon")], cell_deg)
    lat0, lat1 = F.greatest("a_min_lat", "b_min_lat"), F.least("a_max_lat", "b_max_lat")
    lon0, lon1 = F.greatest("a_min_lon", "b_min_lon"), F.least("a_max_lon", "b_max_lon")
    area = (lat1 - lat0) * (lon1 - lon0)

    def frac(total):
        return F.when(F.col(total) > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), area / F.col(total)))).otherwise(0.0)

    return j.where((lat1 > lat0) & (lon1 > lon0)).select(
        F.col("a_product_id").alias("a_id"), F.col("b_product_id").alias("b_id"), lat0.alias("min_lat"), lat1.alias("max_lat"),
        lon0.alias("min_lon"), lon1.alias("max_lon"), frac("a_area").alias("fraction_a"), frac("b_area").alias("fraction_b"))


def search_region(requests: DataFrame, overlaps: DataFrame, every: bool = False) -> DataFrame:
    """Overlap box of each requested (a_id, b_id); null when the products do not overlap.

    With `every`, overlaps that nobody requested have their rows too. They outnumber the requests by far and meet them
    in one join: their pairs are never collected or made distinct."""
    return requests.join(overlaps.select("a_id", "b_id", "min_lat", "max_lat", "min_lon", "max_lon"), ["a_id", "b_id"], "full" if every else "left")


# --- polygons ---------------------------------------------------------------------------------

RING = ("upper_left", "upper_right", "lower_right", "lower_left")


def box_corners(df: DataFrame) -> DataFrame:
    """`corners`: ring of (lat, lon) from a footprint box."""
    def c(lat, lon):
        return F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return df.withColumn("corners", F.array(c("max_lat", "min_lon"), c("max_lat", "max_lon"), c("min_lat", "max_lon"), c("min_lat", "min_lon")))


def edges(ring: Column) -> Column:
    """Edges of a ring: start (x, y), direction (u, v)."""
    return F.transform(ring, lambda p, i: let(F.get(ring, (i + 1) % F.size(ring)), lambda q: F.struct(
        p["x"].alias("x"), p["y"].alias("y"), (q["x"] - p["x"]).alias("u"), (q["y"] - p["y"]).alias("v"))))


def _side(e, x, y) -> Column:
    """Twice the signed area of an edge and a point: which side of the edge's line the point is on."""
    return e["u"] * (y - e["y"]) - e["v"] * (x - e["x"])


def edges_meet(s, t) -> Column:
    """Neither edge has the other wholly on one side of its line, and their boxes touch (which decides edges on one line)."""
    def split(a, b):
        return _side(a, b["x"], b["y"]) * _side(a, b["x"] + b["u"], b["y"] + b["v"]) <= 0

    def boxes(at, way):
        return (F.greatest(s[at], s[at] + s[way]) >= F.least(t[at], t[at] + t[way])) & (F.greatest(t[at], t[at] + t[way]) >= F.least(s[at], s[at] + s[way]))

    return boxes("x", "u") & boxes("y", "v") & split(s, t) & split(t, s)


def winding(pt: Column, edge_list: Column) -> Column:
    """How often a ring turns around a point: upward edges with the point on their left less downward ones on their right."""
    def turn(e):
        up = (e["y"] <= pt["y"]) & (e["y"] + e["v"] > pt["y"])
        down = (e["y"] > pt["y"]) & (e["y"] + e["v"] <= pt["y"])
        at = _side(e, pt["x"], pt["y"])
        return F.when(up & (at > 0), 1).when(down & (at < 0), -1).otherwise(0)

    return F.aggregate(F.transform(edge_list, turn), F.lit(0), lambda a, b: a + b)


def _ring_edges(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges of rings (one ring a row): start x, y and direction u, v."""
    return x, y, np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y


def _sides(e: tuple[np.ndarray, ...], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the signed area of an edge and a point: which side of the edge's line the point is on."""
    return e[2] * (y - e[1]) - e[3] * (x - e[0])


def _edges_cross(s: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...]) -> np.ndarray:
    """Neither edge has the other wholly on one side of its line, and their boxes touch (which decides edges on one line)."""
    def split(a, b):
        return _sides(a, b[0], b[1]) * _sides(a, b[0] + b[2], b[1] + b[3]) <= 0

    def boxes(at):
        (s0, s1), (t0, t1) = ((e[at], e[at] + e[at + 2]) for e in (s, t))
        return (np.maximum(s0, s1) >= np.minimum(t0, t1)) & (np.maximum(t0, t1) >= np.minimum(s0, s1))

    return boxes(0) & boxes(1) & split(s, t) & split(t, s)


def _turns(x: np.ndarray, y: np.ndarray, e: tuple[np.ndarray, ...]) -> np.ndarray:
    """How often a ring turns around a point: upward edges with the point on their left less downward ones on their right."""
    x, y = x[:, None], y[:, None]
    at = _sides(e, x, y)
    up, down = (e[1] <= y) & (e[1] + e[3] > y) & (at > 0), (e[1] > y) & (e[1] + e[3] <= y) & (at < 0)
    return up.sum(1) - down.sum(1)


def _rings_touch(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whether polygons overlap, one pair a row: their boxes do, and edges meet or one holds the other's first corner.
    A missing coordinate (NaN) meets nothing."""
    def apart(a, b):
        return (np.fmax.reduce(a, 1) + 1e-6 < np.fmin.reduce(b, 1)) | (np.fmax.reduce(b, 1) + 1e-6 < np.fmin.reduce(a, 1))

    out = np.zeros(len(ax), bool)
    at = np.nonzero(~(apart(ax, bx) | apart(ay, by)))[0]
    a, b = _ring_edges(ax[at], ay[at]), _ring_edges(bx[at], by[at])
    meet = (_turns(a[0][:, 0], a[1][:, 0], b) != 0) | (_turns(b[0][:, 0], b[1][:, 0], a) != 0)
    for i in range(ax.shape[1]):
        meet |= _edges_cross(tuple(v[:, i:i + 1] for v in a), b).any(1)
    out[at] = meet
    return out


def widen(ring: Column, pad: float) -> Column:
    """Every corner moved `pad` further along its direction from the ring's mean point."""
    def mean(r, f):
        return F.aggregate(F.transform(r, lambda p: p[f]), F.lit(0.0), lambda a, b: a + b) / F.size(r)

    def moved(p, mx, my):
        return let(F.hypot(p["x"] - mx, p["y"] - my), lambda far: F.struct(
            (p["x"] + F.when(far > 1e-9, (p["x"] - mx) * pad / far).otherwise(0.0)).alias("x"),
            (p["y"] + F.when(far > 1e-9, (p["y"] - my) * pad / far).otherwise(0.0)).alias("y")))

    return let(ring, lambda r: let(F.array(mean(r, "x"), mean(r, "y")), lambda m: F.transform(r, lambda p: moved(p, m[0], m[1]))))


def _in_plane(corners: Column, lat0: Column, lon0: Column) -> Column:
    """Ring of (x, y) in the local plane about a position."""
    def place(c):
        d, brg = G.gc_dist_bearing(lat0, lon0, c["lat"], c["lon"])
        return let(F.struct(d.alias("d"), brg.alias("b")), lambda v: F.struct(
            (v["d"] * F.sin(v["b"])).alias("x"), (v["d"] * F.cos(v["b"])).alias("y")))

    return F.transform(corners, place)


def _reach(df: DataFrame, factor: float, pad: float) -> DataFrame:
    """Sphere position of the first corner and a radius (km) that bounds the ring as drawn in a local plane."""
    first = F.element_at("corners", 1)
    x, y, z = G.latlon_to_xyz(first["lat"], first["lon"])
    far = F.array_max(F.transform("corners", lambda c: G.gc_dist_bearing(first["lat"], first["lon"], c["lat"], c["lon"])[0]))
    return df.withColumn("_x", x).withColumn("_y", y).withColumn("_z", z).withColumn("_r", far * factor + pad)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)


#: Reaches (km) up to which polygons a and b count as small, and how much a plane stretches b's edges if both are.
SMALL_A, SMALL_B, STRETCH = 0.25 * MOON_RADIUS_KM, 0.4 * MOON_RADIUS_KM, 1.15


def polygon_overlap(a: DataFrame, b: DataFrame, pad_km: float = 15.0, max_lat_gap: float = 25.0, cell_km: float = 200.0) -> DataFrame:
    """Pairs (a, b) whose polygons overlap in a local plane about a's first corner, a's ring widened by `pad_km`.

    Inputs carry product_id, corners and lat_c. Candidates come from a grid join in 3-D position, which has no
    seam and no polar special case. Bound used: distances from the plane's origin are true distances; an edge of
    b is at most pi/2 times its true length there while it lies within a quarter circle, so a ring further away
    than both reaches cannot touch. Pairs more than a quarter circle apart are never reported: in the local plane
    a ring around the antipode encloses the origin although it lies on the other side of the Moon.

    Two small polygons within these reaches lie less than 0.9 radians from the origin, where the plane stretches b by less
    than STRETCH and shortens nothing: they are met by the smaller balls around their middles. Large ones keep a ball around
    the first corner, wide enough for every small partner within the reaches. a's ring is drawn once a row; b's is drawn
    and tested for many pairs at once in NumPy, in the tasks where the pairs are met.
    """
    origin = F.element_at("corners", 1)
    lat, lon = origin["lat"], origin["lon"]

    def ball(df, small, x, y, z, r, wide):
        """The box joined on: around (x, y, z) with r for small polygons, else around the first corner, `wide` larger."""
        df = df.withColumn("_small", F.coalesce((F.col("_r") <= small) & (r + x + y + z).isNotNull(), F.lit(False)))
        for ax, v in (("x", x), ("y", y), ("z", z)):
            df = df.withColumn(f"_m{ax}", F.when(F.col("_small"), v).otherwise(F.col(f"_{ax}")))
        return df.withColumn("_mr", F.when(F.col("_small"), r + 1e-6).otherwise(F.col("_r") + wide))

    def side(df, p, rows):
        sel = [F.col("product_id").alias(f"{p}_id"), F.col("lat_c").alias(f"{p}_lat_c")]
        sel += [F.col(c).alias(f"{p}{c}") for c in ("_x", "_y", "_z", "_r", "_mx", "_my", "_mz", "_mr", "_small")]
        for ax in ("x", "y", "z"):
            sel += [(F.col(f"_m{ax}") - F.col("_mr")).alias(f"{p}_{ax}0"), (F.col(f"_m{ax}") + F.col("_mr")).alias(f"{p}_{ax}1")]
        return cut_lineage(spread(df.select(*sel, *rows), f"{p}_id"))  # drawn once, dealt over all tasks

    left = _reach(a, 1.0, pad_km).withColumn("_ring", widen(_in_plane(F.col("corners"), lat, lon), pad_km))
    for f in ("x", "y"):
        left = left.withColumn(f"_ring_{f}", F.transform("_ring", lambda p: p[f])).withColumn(f"_p{f}", _mean(F.col(f"_ring_{f}")))
    far = F.array_max(F.transform("_ring", lambda p: F.hypot(p["x"] - F.col("_px"), p["y"] - F.col("_py"))))
    # the middle of a's ring, back on the sphere: `ahead` along the bearing of (px, py) in the frame of the first corner
    ahead, p0, l0 = F.hypot("_px", "_py"), F.radians(lat), F.radians(lon)
    east, north = (F.when(ahead > 1e-9, F.col(c) / ahead).otherwise(0.0) * F.sin(ahead / MOON_RADIUS_KM) for c in ("_px", "_py"))
    up = F.cos(ahead / MOON_RADIUS_KM)
    out = up * F.cos(p0) - north * F.sin(p0)
    left = ball(left, SMALL_A, MOON_RADIUS_KM * (out * F.cos(l0) - east * F.sin(l0)), MOON_RADIUS_KM * (out * F.sin(l0) + east * F.cos(l0)),
                MOON_RADIUS_KM * (up * F.sin(p0) + north * F.cos(p0)), far, 2 * SMALL_B)

    right = _reach(b, 1.5708, 0.0)
    for ax, f in (("x", 0), ("y", 1), ("z", 2)):
        right = right.withColumn(f"_w{ax}", _mean(F.transform("corners", lambda c: G.latlon_to_xyz(c["lat"], c["lon"])[f])))
    size = F.sqrt(F.col("_wx") * F.col("_wx") + F.col("_wy") * F.col("_wy") + F.col("_wz") * F.col("_wz"))
    for ax in ("x", "y", "z"):
        right = right.withColumn(f"_v{ax}", F.when(size > 0, F.col(f"_w{ax}") / size * MOON_RADIUS_KM))

    def chord(c):
        gaps = [v - F.col(f"_v{ax}") for v, ax in zip(G.latlon_to_xyz(c["lat"], c["lon"]), ("x", "y", "z"))]
        return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])

    arc = 2 * MOON_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.array_max(F.transform("corners", chord)) / (2 * MOON_RADIUS_KM)))
    right = ball(right, SMALL_B, *[F.col(f"_v{ax}") for ax in ("x", "y", "z")], arc * STRETCH, 2 * SMALL_A)

    cand = box_join(side(left, "a", [lat.alias("_lat0"), lon.alias("_lon0"), F.col("_ring_x").alias("_ax"), F.col("_ring_y").alias("_ay")]),
                    side(right, "b", [F.transform("corners", lambda c: c["lat"].cast("double")).alias("_blat"), F.transform("corners", lambda c: c["lon"].cast("double")).alias("_blon")]),
                    [(f"a_{ax}0", f"a_{ax}1", f"b_{ax}0", f"b_{ax}1") for ax in ("x", "y", "z")], cell_km, costly=True)

    def apart(at):
        gaps = [F.col(f"a_{at}{ax}") - F.col(f"b_{at}{ax}") for ax in ("x", "y", "z")]
        return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])

    near = cand.where((F.abs(F.col("a_lat_c") - F.col("b_lat_c")) <= max_lat_gap) & (apart("") <= F.col("a_r") + F.col("b_r"))
                      & (~F.col("a_small") | ~F.col("b_small") | (apart("m") <= F.col("a_mr") + F.col("b_mr"))))

    def touching(batches):
        for pdf in batches:
            rows = [pdf[c].to_numpy() for c in ("_ax", "_ay", "_blat", "_blon")]
            keep = np.zeros(len(pdf), bool)
            shapes = pd.DataFrame({"a": [len(v) for v in rows[0]], "b": [len(v) for v in rows[2]]})
            for at in shapes.groupby(["a", "b"]).indices.values():
                ax, ay, blat, blon = (np.array([*v[at]], float) for v in rows)
                lat0, lon0 = (np.asarray(pdf[c].iloc[at], float)[:, None] for c in ("_lat0", "_lon0"))
                d, brg = G.dist_bearing_np(lat0, lon0, blat, blon)
                keep[at] = _rings_touch(ax, ay, d * np.sin(brg), d * np.cos(brg))
            yield pdf.loc[keep, ["a_id", "b_id"]]

    ids = ", ".join(f"{c} {near.schema[c].dataType.simpleString()}" for c in ("a_id", "b_id"))
    return near.select("a_id", "b_id", "_lat0", "_lon0", "_ax", "_ay", "_blat", "_blon").mapInPandas(touching, ids)


def filter_products(df: DataFrame, max_mb: float) -> DataFrame:
    """Size cap (unknown size counts as 0) and known incidence."""
    return df.where((F.coalesce("file_size_mb", F.lit(0.0)) <= max_mb) & F.col("solar_incidence").isNotNull())


def bright_pairs(a: DataFrame, b: DataFrame, n: int | None = 10, pad_km: float = 15.0, max_mb: float = 6144.0) -> DataFrame:
    """Overlapping pairs by lowest mean incidence, with maximum incidence, azimuth difference and radiance gain."""
    fa, fb = filter_products(a, max_mb), filter_products(b, max_mb)
    pairs = polygon_overlap(fa, fb, pad_km)
    sa = fa.select(F.col("product_id").alias("a_id"), F.col("solar_incidence").alias("inc_a"), F.col("sun_azimuth").alias("az_a"))
    sb = fb.select(F.col("product_id").alias("b_id"), F.col("solar_incidence").alias("inc_b"), F.col("sun_azimuth").alias("az_b"))
    j = pairs.join(sa, "a_id").join(sb, "b_id")
    mean = (F.col("inc_a") + F.col("inc_b")) / 2
    out = j.select("a_id", "b_id", mean.alias("mean_incidence"), F.greatest("inc_a", "inc_b").alias("max_incidence"),
                   G.az_diff("az_a", "az_b").alias("azimuth_difference"),
                   (F.cos(F.radians(mean)) / F.cos(F.radians(F.lit(85.0)))).alias("radiance_gain"))
    ordered = out.orderBy("mean_incidence", "a_id", "b_id")
    return ordered.limit(n) if n else out


# --- footprint cleaning -----------------------------------------------------------------------

def clean_footprints(raw: DataFrame) -> DataFrame:
    """Defaults, centre inferred from corners, corners synthesised around a centre, bounding box.

    Input columns: product_id, center_lat, center_lon, gsd_m, sun_elevation_deg, sun_azimuth_deg,
    acquisition_time (text), corners array<struct<lat,lon>>, any of them null.
    """
    has = F.coalesce(F.size("corners") > 0, F.lit(False))
    mean = lambda f: F.aggregate("corners", F.lit(0.0), lambda s, c: s + c[f]) / F.size("corners")
    both = F.col("center_lat").isNotNull() & F.col("center_lon").isNotNull()
    df = (raw.withColumn("_lat", F.when(both, F.col("center_lat")).when(has, mean("lat")).otherwise(0.0))
          .withColumn("_lon", F.when(both, F.col("center_lon")).when(has, mean("lon")).otherwise(0.0))
          .withColumn("gsd_m", F.when(F.coalesce("gsd_m", F.lit(1.0)) <= 0, 1.0).otherwise(F.coalesce("gsd_m", F.lit(1.0)))))
    half = 500.0 * F.col("gsd_m")
    dlat = F.degrees(half / MOON_RADIUS_M)
    dlon = F.degrees(half / (MOON_RADIUS_M * F.greatest(F.lit(1e-6), F.cos(F.radians("_lat")))))
    def c(sy, sx):
        return F.struct((F.col("_lat") + sy * dlat).alias("lat"), (F.col("_lon") + sx * dlon).alias("lon"))
    made = F.array(c(1, -1), c(1, 1), c(-1, 1), c(-1, -1))
    df = df.withColumn("synthesised", ~has).withColumn("corners", F.when(has, F.col("corners")).otherwise(made))
    r = G.corner_ranges("corners")
    return df.select(
        "product_id", F.col("_lat").alias("center_lat"), F.col("_lon").alias("center_lon"), "gsd_m",
        F.coalesce("sun_elevation_deg", F.lit(30.0)).alias("sun_elevation_deg"),
        F.coalesce("sun_azimuth_deg", F.lit(0.0)).alias("sun_azimuth_deg"),
        G.acquisition_ts("acquisition_time").alias("acquisition_time"), "corners", "synthesised",
        *[r[k].alias(k) for k in ("min_lat", "max_lat", "min_lon", "max_lon")])


def _failed(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))


def validate_footprints(fp: DataFrame) -> DataFrame:
    """`warnings`: names of failed range checks."""
    return fp.withColumn("warnings", _failed([
        (~F.col("center_lat").between(-90, 90), "center_lat"), (~F.col("center_lon").between(-180, 360), "center_lon"),
        (F.col("gsd_m") <= 0, "gsd_m"), (~F.col("sun_elevation_deg").between(-90, 90), "sun_elevation_deg"),
        (~F.pmod(F.col("sun_azimuth_deg"), F.lit(360.0)).between(0, 360), "sun_azimuth_deg")]))


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTRUMENTS, INSTRUMENT_SCHEMA)


def valid_spec(df: DataFrame) -> DataFrame:
    """`violations`: failed invariants of an instrument record."""
    return df.withColumn("violations", _failed([
        (F.col("gsd_m") <= 0, "gsd_m"), (F.col("gsd_oblique_m") <= 0, "gsd_oblique_m"), (F.col("swath_km") <= 0, "swath_km"),
        (F.col("min_um") >= F.col("max_um"), "spectral_range"), (F.col("num_bands") < 1, "num_bands"),
        (F.col("bit_depth") < 1, "bit_depth"), (F.col("orbit_altitude_km") <= 0, "orbit_altitude_km")]))


def spec_join(products: DataFrame) -> DataFrame:
    """Instrument record beside each product (three rows, so the broadcast has a fixed bound)."""
    s = specs(products.sparkSession).select(F.col("name").alias("_name"), *[
        F.col(c).alias(f"spec_{c}") for c in ("gsd_m", "swath_km", "spectral_type", "min_um", "max_um", "num_bands", "bit_depth")])
    return products.join(F.broadcast(s), G.normalize_instrument("instrument") == F.col("_name")).drop("_name")


def scale_gap(products: DataFrame) -> DataFrame:
    """Ground-sampling ratio of each product to every instrument (the three records are a literal list)."""
    others = F.array(*[F.struct(F.lit(r[0]).alias("other"), F.lit(r[1]).alias("other_gsd"), F.lit(r[5]).alias("lo"), F.lit(r[6]).alias("hi"))
                       for r in INSTRUMENTS])
    j = spec_join(products).withColumn("o", F.explode(others))
    lo, hi = G.spectral_overlap("spec_min_um", "spec_max_um", "o.lo", "o.hi")
    ratio = F.col("spec_gsd_m") / F.col("o.other_gsd")
    return j.select("product_id", "instrument", F.col("o.other").alias("other"), ratio.alias("scale_ratio"),
                    G.pyramid_depth(ratio).alias("pyramid_levels"), lo.alias("overlap_lo_um"), hi.alias("overlap_hi_um"))


def missing_products(refs: DataFrame, present: DataFrame, key: str = "product_id") -> DataFrame:
    """References without a source product."""
    return refs.select(key).distinct().join(present.select(key), key, "left_anti")


def backed_products(refs: DataFrame, present: DataFrame, key: str = "product_id") -> DataFrame:
    return refs.join(present.select(key), key, "left_semi")


def bbox_search(catalog: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Products whose centre lies in the south polar stereographic box around four corners."""
    corners = [(a, o) for a in (min_lat, max_lat) for o in (min_lon, max_lon)]
    xy = [G.polar_stereo_south(F.lit(float(a)), F.lit(float(o))) for a, o in corners]
    x, y = G.polar_stereo_south("center_lat", "center_lon")
    xs, ys = [p[0] for p in xy], [p[1] for p in xy]
    return catalog.withColumn("x", x).withColumn("y", y).where(
        (F.col("x") >= F.least(*xs)) & (F.col("x") <= F.greatest(*xs)) & (F.col("y") >= F.least(*ys)) & (F.col("y") <= F.greatest(*ys)))


def check_provenance(source: DataFrame, output: DataFrame, key: str = "product_id", tol: float = 1e-4) -> DataFrame:
    """Differences between a source record and the output's copy: latitude, resolution, product, payload digest."""
    s = source.select(key, *[F.col(c).alias(f"s_{c}") for c in ("center_lat", "gsd_m", "origin", "digest")])
    o = output.select(key, *[F.col(c).alias(f"o_{c}") for c in ("center_lat", "gsd_m", "origin", "digest")])
    j = s.join(o, key)
    def off(c):
        return F.abs(F.col(f"s_{c}") - F.col(f"o_{c}")) > tol + 1e-5 * F.abs(F.col(f"o_{c}"))
    named = (F.length("s_origin") > 0) & (F.length("o_origin") > 0)
    return j.select(key, _failed([
        (~F.col("s_digest").eqNullSafe(F.col("o_digest")), "array"), (off("center_lat"), "latitude"), (off("gsd_m"), "resolution"),
        (named & (F.col("s_origin") != F.col("o_origin")), "product")]).alias("violations")).where(F.size("violations") > 0)


def hub_compose(hop1: DataFrame, hop2: DataFrame, key: str = "hub_id") -> DataFrame:
    """Join fine-to-hub and hub-to-coarse results; success needs matches on both, confidence is the geometric mean."""
    a = hop1.select(key, F.col("n_matches").alias("n1"), F.col("confidence").alias("c1"), "fine_id")
    b = hop2.select(key, F.col("n_matches").alias("n2"), F.col("confidence").alias("c2"), "coarse_id")
    both = (F.col("c1") > 0) & (F.col("c2") > 0)
    return a.join(b, key).select(
        key, "fine_id", "coarse_id", ((F.col("n1") > 0) & (F.col("n2") > 0)).alias("success"),
        F.when(both, F.sqrt(F.col("c1") * F.col("c2"))).otherwise(0.0).alias("confidence"))


def route(a: Column, b: Column) -> Column:
    """Hop for a pair of instruments in either order; the finer side is always the source."""
    pair = F.array_join(F.array_sort(F.array(a, b)), "-")
    return (F.when(pair == "OHRC-TMC2", "hop1").when(pair == "IIRS-TMC2", "hop2").when(pair == "IIRS-OHRC", "composite")
            .otherwise("unsupported"))
