"""Column expressions for 3x3 point maps (row-major arrays of nine), scores and confidences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tieline.functions.geo import col


def similarity_matrix(a, b, tx, ty) -> Column:
    z, one = F.lit(0.0), F.lit(1.0)
    return F.array(col(a), -col(b), col(tx), col(b), col(a), col(ty), z, z, one)


def apply_h(h, x, y, guard: float = 1e-12):
    """Mapped point; a denominator closer to zero than the guard is replaced by the guard."""
    m, x, y = col(h), col(x), col(y)
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(F.abs(w) < guard, F.lit(guard)).otherwise(w)
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def residual_px(h, x, y, ref_x, ref_y) -> Column:
    px, py = apply_h(h, x, y)
    dx, dy = px - col(ref_x), py - col(ref_y)
    return F.sqrt(dx * dx + dy * dy)


def decompose_similarity(h):
    """scale, rotation (degrees), tx, ty."""
    m = col(h)
    return F.sqrt(m[0] * m[0] + m[3] * m[3]), F.degrees(F.atan2(m[3], m[0])), m[2], m[5]


def similarity_displacement(h, x, y):
    m, x, y = col(h), col(x), col(y)
    return m[0] * x + m[1] * y + m[2] - x, m[3] * x + m[4] * y + m[5] - y


def rescale_h(h, s) -> Column:
    """S H S^-1 with S = diag(s, s, 1)."""
    m, s = col(h), col(s)
    return F.array(m[0], m[1], m[2] * s, m[3], m[4], m[5] * s, m[6] / s, m[7] / s, m[8])


def let(value: Column, body) -> Column:
    """Bind an intermediate value once, so that a long formula does not repeat its expression tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _top_root(c2: Column, c1: Column, c0: Column) -> Column:
    """Largest root of z^3 - c2 z^2 + c1 z - c0 with three real roots."""
    def from_pq(s):
        r = F.sqrt(s["p"])
        cosine = F.when(s["p"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s["q"] / (s["p"] * r)))).otherwise(F.lit(1.0))
        return s["c2"] / 3 + 2 * r * F.cos(F.acos(cosine) / 3)

    return let(F.struct(c2.alias("c2"), F.greatest(c2 * c2 / 9 - c1 / 3, F.lit(0.0)).alias("p"),
                        (c2 * c2 * c2 / 27 - c2 * c1 / 6 + c0 / 2).alias("q")), from_pq)


def cond3(h) -> Column:
    """2-norm condition number of a 3x3 matrix from the invariants of H'H and of its inverse.

    Both largest singular values come from the trigonometric root, which keeps its relative accuracy; the
    smallest one is never computed as a difference. Singular matrices give null.
    """
    def invariants(h):
        m = [h[i] for i in range(9)]
        minors = [
            m[4] * m[8] - m[5] * m[7], m[3] * m[8] - m[5] * m[6], m[3] * m[7] - m[4] * m[6],
            m[1] * m[8] - m[2] * m[7], m[0] * m[8] - m[2] * m[6], m[0] * m[7] - m[1] * m[6],
            m[1] * m[5] - m[2] * m[4], m[0] * m[5] - m[2] * m[3], m[0] * m[4] - m[1] * m[3],
        ]
        det = m[0] * minors[0] - m[1] * minors[1] + m[2] * minors[2]
        return F.struct(sum((v * v for v in m[1:]), m[0] * m[0]).alias("e1"),
                        sum((v * v for v in minors[1:]), minors[0] * minors[0]).alias("e2"), (det * det).alias("d2"))

    def number(s):
        e1, e2, d2 = s["e1"], s["e2"], s["d2"]
        return F.when(d2 > 0, F.sqrt(_top_root(e1, e2, d2) * _top_root(e2 / d2, e1 / d2, 1 / d2)))

    return let(let(col(h), invariants), number)


def map_keypoints(x, y, scale, col_offset, row_offset):
    s = F.when(col(scale) > 0, col(scale)).otherwise(F.lit(1.0))
    return col(x) / s + col(col_offset), col(y) / s + col(row_offset)


def match_confidence(residual, threshold: float = 15.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - col(residual) / threshold)


def descriptor_confidence(distance, max_distance: float = 500.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - col(distance) / max_distance))


def harmonic_conf(a, b) -> Column:
    return 2 * (col(a) * col(b)) / F.greatest(col(a) + col(b), F.lit(1e-6))


def preprocess_confidence(shadow_fraction, saturation_fraction) -> Column:
    """1 minus penalties for deep shadow above 60 % and saturation above 20 %, kept in [0, 1]."""
    sh, sa = col(shadow_fraction), col(saturation_fraction)
    c = (1.0 - F.when(sh > 0.6, 0.5 * (sh - 0.6) / 0.4).otherwise(0.0)
         - F.when(sa > 0.2, 0.5 * (sa - 0.2) / 0.8).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def contrast_confidence(contrast) -> Column:
    """Penalty for low contrast (below 0.1)."""
    c = col(contrast)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.when(c < 0.1, 0.5 * (0.1 - c) / 0.1).otherwise(0.0)))


def adaptive_clip(std, default: float = 2.0) -> Column:
    return F.when(col(std) < 0.1, 4.0).when(col(std) > 0.25, 1.5).otherwise(F.lit(default))


def elevation_stratum(elevation) -> Column:
    e = col(elevation)
    return (F.when((e >= 2) & (e < 6), "2-6").when((e >= 6) & (e < 12), "6-12")
            .when((e >= 12) & (e <= 30), "12-30").otherwise("outside"))


def sun_vector(azimuth_deg, elevation_deg):
    """Unit vector towards the sun: east, north, up; azimuth clockwise from north."""
    az, el = F.radians(col(azimuth_deg)), F.radians(col(elevation_deg))
    return F.sin(az) * F.cos(el), F.cos(az) * F.cos(el), F.sin(el)


def incidence_cos(nx, ny, nz, azimuth_deg, elevation_deg) -> Column:
    sx, sy, sz = sun_vector(azimuth_deg, elevation_deg)
    return col(nx) * sx + col(ny) * sy + col(nz) * sz


def lambert(mu0) -> Column:
    return F.bround(F.least(F.greatest(col(mu0), F.lit(0.0)), F.lit(1.0)) * 255, 0)


def lommel_seeliger(mu0, albedo: float = 1.0) -> Column:
    """Nadir-view response scaled so that normal incidence gives 255; facets turned away give 0."""
    r = F.when(col(mu0) > 0, 2 * col(mu0) / (col(mu0) + 1)).otherwise(0.0)
    return F.bround(F.least(r, F.lit(1.0)) * 255 * albedo, 0)


def control_coords(arm, row, column, height, width):
    """Where a pixel moves under a control arm; rot90 is counter-clockwise. Square arms keep the shape."""
    a, r, c, h, w = col(arm), col(row), col(column), col(height), col(width)
    new_r = (F.when(a == "rot90", w - 1 - c).when(a == "rot180", h - 1 - r).when(a == "rot270", c)
             .when(a == "vflip", h - 1 - r).when(a == "offset", F.pmod(r + F.floor(h / 2), h)).otherwise(r))
    new_c = (F.when(a == "rot90", r).when(a == "rot180", w - 1 - c).when(a == "rot270", h - 1 - r)
             .when(a == "hflip", w - 1 - c).otherwise(c))
    return new_r.cast("bigint"), new_c.cast("bigint")


def blockwise_control_coords(arm, row, column, height, width):
    """Rotation of each width-by-width block of a strip; leftover rows are turned by 180 degrees."""
    a, r, c, h, w = col(arm), col(row), col(column), col(height), col(width)
    full = F.floor(h / w) * w
    base, inner = F.floor(r / w) * w, F.pmod(r, w)
    in_block = r < full
    new_r = (F.when(in_block & (a == "rot90_blockwise"), base + w - 1 - c)
             .when(in_block & (a == "rot270_blockwise"), base + c).otherwise(full + (h - 1 - r)))
    new_c = (F.when(in_block & (a == "rot90_blockwise"), inner)
             .when(in_block & (a == "rot270_blockwise"), w - 1 - inner).otherwise(w - 1 - c))
    return new_r.cast("bigint"), new_c.cast("bigint")


def to_u8(v) -> Column:
    return F.floor(F.least(F.greatest(col(v), F.lit(0.0)), F.lit(255.0)))
