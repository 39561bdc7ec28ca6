"""Column expressions for coordinates, distances, projections, footprints and instrument look-ups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from tieline.fixed import INSTRUMENT_ALIASES, MOON_RADIUS_KM, MOON_RADIUS_M


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


def latlon_to_xyz(lat, lon, radius_km: float = MOON_RADIUS_KM):
    """Position on the sphere as three columns, km."""
    la, lo = F.radians(col(lat)), F.radians(col(lon))
    return radius_km * F.cos(la) * F.cos(lo), radius_km * F.cos(la) * F.sin(lo), radius_km * F.sin(la)


def haversine_m(lat1, lon1, lat2, lon2, radius_m: float = MOON_RADIUS_M) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp, dl = p2 - p1, F.radians(col(lon2)) - F.radians(col(lon1))
    h = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) * F.sin(dl / 2)
    h = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return 2 * radius_m * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def gc_dist_bearing(lat0, lon0, lat, lon, radius_km: float = MOON_RADIUS_KM):
    """Great-circle distance (km) and initial bearing (radians)."""
    p0, p1, dl = F.radians(col(lat0)), F.radians(col(lat)), F.radians(col(lon) - col(lon0))
    east = F.cos(p1) * F.sin(dl)
    north = F.cos(p0) * F.sin(p1) - F.sin(p0) * F.cos(p1) * F.cos(dl)
    along = F.sin(p0) * F.sin(p1) + F.cos(p0) * F.cos(p1) * F.cos(dl)
    return F.atan2(F.sqrt(east * east + north * north), along) * radius_km, F.atan2(east, north)


def dist_bearing_np(lat0: np.ndarray, lon0: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius_km: float = MOON_RADIUS_KM):
    """gc_dist_bearing of arrays."""
    p0, p1, dl = np.radians(lat0), np.radians(lat), np.radians(lon - lon0)
    east, c0, s0, c1, s1, cl = np.cos(p1) * np.sin(dl), np.cos(p0), np.sin(p0), np.cos(p1), np.sin(p1), np.cos(dl)
    north, along = c0 * s1 - s0 * c1 * cl, s0 * s1 + c0 * c1 * cl
    return np.arctan2(np.sqrt(east * east + north * north), along) * radius_km, np.arctan2(east, north)


def project_aeqd(lat0, lon0, lat, lon):
    """Local plane (x east, y north, km) that keeps distance and bearing from the origin."""
    d, brg = gc_dist_bearing(lat0, lon0, lat, lon)
    return d * F.sin(brg), d * F.cos(brg)


def equirect_fwd(lat, lon, std_parallel: float, central_meridian: float, radius_m: float = MOON_RADIUS_M):
    x = radius_m * F.radians(col(lon) - central_meridian) * F.cos(F.radians(F.lit(std_parallel)))
    return x, radius_m * F.radians(col(lat))


def equirect_inv(x, y, std_parallel: float, central_meridian: float, radius_m: float = MOON_RADIUS_M):
    lon = F.degrees(col(x) / (radius_m * F.cos(F.radians(F.lit(std_parallel))))) + central_meridian
    return F.degrees(col(y) / radius_m), lon


def polar_stereo_south(lat, lon, radius_m: float = MOON_RADIUS_M):
    rho = 2 * radius_m * F.tan(F.radians(90 + col(lat)) / 2)
    return rho * F.sin(F.radians(col(lon))), rho * F.cos(F.radians(col(lon)))


def grid_to_map(col_no, row_no, x0, y0, gsd):
    return col(x0) + col(col_no) * col(gsd), col(y0) - col(row_no) * col(gsd)


def map_to_ref_pixel(x, y, left, top, res):
    """0-based pixel centre; pixel c is centred at left + (c + 0.5) * res."""
    return (col(x) - col(left)) / col(res) - 0.5, (col(top) - col(y)) / col(res) - 0.5


def planar_latlon(x, y, anchor_lat, anchor_lon, gsd, width: float, height: float):
    """Local approximation about an anchor: latitude, longitude and a flag for |latitude| > 80."""
    per_deg = 3.141592653589793 * MOON_RADIUS_M / 180.0
    lat = col(anchor_lat) - (col(y) - height / 2) * col(gsd) / per_deg
    lon = col(anchor_lon) + (col(x) - width / 2) * col(gsd) / (per_deg * F.cos(F.radians(col(anchor_lat))))
    return lat, lon, F.abs(col(anchor_lat)) > 80


def pixel_offset(lat_a, lon_a, lat_b, lon_b, gsd_b):
    """Integer (dy, dx) from b to a in pixels of b; half values go to the even integer."""
    north = MOON_RADIUS_M * F.radians(col(lat_a) - col(lat_b))
    mean = F.radians((col(lat_a) + col(lat_b)) / 2)
    east = MOON_RADIUS_M * F.cos(mean) * F.radians(col(lon_a) - col(lon_b))
    ok = col(gsd_b) > 0
    dy = F.when(ok, F.bround(-north / col(gsd_b), 0).cast("bigint"))
    dx = F.when(ok, F.bround(east / col(gsd_b), 0).cast("bigint"))
    return dy, dx


def az_diff(a, b) -> Column:
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(360.0))
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.least(d, 360.0 - d))


def bbox_to_pixels(fp: dict, box: dict, height, width):
    """Clamped (row0, row1, col0, col1) of a lat/lon box; null for a footprint without extent."""
    h, w = col(height), col(width)
    lat_span, lon_span = col(fp["max_lat"]) - col(fp["min_lat"]), col(fp["max_lon"]) - col(fp["min_lon"])
    ok = (lat_span > 1e-9) & (lon_span > 1e-9)
    r0 = F.floor((col(fp["max_lat"]) - col(box["max_lat"])) / lat_span * h)
    r1 = F.ceil((col(fp["max_lat"]) - col(box["min_lat"])) / lat_span * h)
    c0 = F.floor((col(box["min_lon"]) - col(fp["min_lon"])) / lon_span * w)
    c1 = F.ceil((col(box["max_lon"]) - col(fp["min_lon"])) / lon_span * w)
    r0 = F.greatest(F.lit(0), F.least(h - 1, r0)).cast("bigint")
    c0 = F.greatest(F.lit(0), F.least(w - 1, c0)).cast("bigint")
    r1 = F.greatest(r0 + 1, F.least(h, r1)).cast("bigint")
    c1 = F.greatest(c0 + 1, F.least(w, c1)).cast("bigint")
    return tuple(F.when(ok, v) for v in (r0, r1, c0, c1))


def centered_window(center, size, total):
    """Start and end of a window of `size` about `center`, moved inside [0, total)."""
    c, s, t = col(center), col(size), col(total)
    start = c - F.floor(s / 2)
    end = start + s
    lo = F.when(start < 0, F.lit(0)).when(end > t, F.greatest(F.lit(0), t - s)).otherwise(start)
    hi = F.when(start < 0, F.least(t, s)).when(end > t, t).otherwise(end)
    return lo.cast("bigint"), hi.cast("bigint")


def corner_ranges(corners):
    """Latitude and longitude range, spans and area of an array of (lat, lon) structs."""
    lats, lons = F.transform(col(corners), lambda c: c["lat"]), F.transform(col(corners), lambda c: c["lon"])
    lo_lat, hi_lat, lo_lon, hi_lon = F.array_min(lats), F.array_max(lats), F.array_min(lons), F.array_max(lons)
    return {
        "min_lat": lo_lat, "max_lat": hi_lat, "min_lon": lo_lon, "max_lon": hi_lon,
        "lat_span": hi_lat - lo_lat, "lon_span": hi_lon - lo_lon, "area_deg2": (hi_lat - lo_lat) * (hi_lon - lo_lon),
    }


def line_for_latitude(lat, top_lat, bottom_lat, lines) -> Column:
    """Linear line estimate between the corner latitudes."""
    return (col(lat) - col(top_lat)) / (col(bottom_lat) - col(top_lat)) * col(lines)


def acquisition_ts(text, default: str = "2023-08-23T12:00:00Z") -> Column:
    return F.coalesce(F.try_to_timestamp(col(text)), F.to_timestamp(F.lit(default)))


def normalize_instrument(name, strict: bool = True) -> Column:
    """Canonical instrument name; unknown names raise (or become null when not strict)."""
    folded = F.regexp_replace(F.upper(F.trim(col(name))), "[-_ ]", "")
    known = F.create_map(*[F.lit(v) for kv in INSTRUMENT_ALIASES.items() for v in kv])
    found = F.element_at(known, folded)
    if not strict:
        return found
    return F.when(found.isNotNull(), found).otherwise(
        F.raise_error(F.concat(F.lit("unknown instrument: "), F.coalesce(col(name), F.lit("null")))))


def scale_ratio(high_gsd, low_gsd) -> Column:
    return F.when((col(high_gsd) > 0) & (col(low_gsd) > 0), col(high_gsd) / col(low_gsd))


def pyramid_depth(ratio) -> Column:
    r = col(ratio)
    factor = F.when(r < 1, 1 / r).otherwise(r)
    return F.when(r > 0, F.greatest(F.lit(2), F.ceil(F.log2(factor)) + 1)).cast("bigint")


def max_dn(bits) -> Column:
    return F.expr("shiftleft(1L, {})".format(bits)) - 1 if isinstance(bits, str) else F.shiftleft(F.lit(1), bits) - 1


def is_hyperspectral(spectral_type, num_bands) -> Column:
    return (col(spectral_type) == "hyperspectral_infrared") | (col(num_bands) > 10)


def is_panchromatic(spectral_type, num_bands) -> Column:
    return (col(spectral_type) == "panchromatic_visible") & (col(num_bands) == 1)


def spectral_overlap(lo_a, hi_a, lo_b, hi_b):
    lo, hi = F.greatest(col(lo_a), col(lo_b)), F.least(col(hi_a), col(hi_b))
    return F.when(lo < hi, lo), F.when(lo < hi, hi)


def emission_from_attitude(roll_deg, pitch_deg, altitude_km) -> Column:
    """Emission angle (degrees) on the sphere for a roll/pitch attitude at an altitude."""
    tr, tp = F.tan(F.radians(col(roll_deg))), F.tan(F.radians(col(pitch_deg)))
    off = F.atan(F.sqrt(tr * tr + tp * tp))
    s = (MOON_RADIUS_KM + col(altitude_km)) / MOON_RADIUS_KM * F.sin(off)
    return F.degrees(F.asin(F.least(s, F.lit(1.0))))
