"""Pixel operators over (tile_id, row_no, col_no, dn). A missing row is nodata.

A tile is a fixed window of the raster (for example 512 x 512), so every per-tile group is bounded by
construction: medians and windows inside a tile are safe whatever the size of the product or the catalog.

Tiles of a product follow each other along the strip: product line = tile_id * size + row_no. Stencils and samplers
given `size` look across tile borders in both directions; sideways a tile's border is the strip's border.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.functions import transforms as X
from tieline.functions.transforms import col

KEY = ["tile_id", "row_no", "col_no"]


def crop(pixels: DataFrame, line0: int, line1: int, samp0: int, samp1: int, pad: str = "none") -> DataFrame:
    """Window [line0, line1) x [samp0, samp1) per tile; outside the data: dropped, zero, or the nearest edge value."""
    inside = pixels.where(F.col("row_no").between(line0, line1 - 1) & F.col("col_no").between(samp0, samp1 - 1))
    if pad == "none":
        return inside
    ext = pixels.groupBy("tile_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("row_no", "col_no") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    grid = ext.withColumn("row_no", F.explode(F.sequence(F.lit(line0).cast("bigint"), F.lit(line1 - 1).cast("bigint")))).withColumn(
        "col_no", F.explode(F.sequence(F.lit(samp0).cast("bigint"), F.lit(samp1 - 1).cast("bigint"))))
    if pad == "zero":
        return grid.select(*KEY).join(pixels, KEY, "left").fillna(0.0, ["dn"])
    near = grid.select(*KEY, F.least(F.greatest("row_no", "row_no_lo"), F.col("row_no_hi")).alias("_r"),
                       F.least(F.greatest("col_no", "col_no_lo"), F.col("col_no_hi")).alias("_c"))
    src = pixels.select("tile_id", F.col("row_no").alias("_r"), F.col("col_no").alias("_c"), "dn")
    return near.join(src, ["tile_id", "_r", "_c"], "left").select(*KEY, "dn")


def thumbnail(pixels: DataFrame, step: int) -> DataFrame:
    """Every step-th line and sample."""
    return pixels.where((F.col("row_no") % step == 0) & (F.col("col_no") % step == 0)).select(
        "tile_id", F.floor(F.col("row_no") / step).alias("row_no"), F.floor(F.col("col_no") / step).alias("col_no"), "dn")


def clean_numeric(df: DataFrame, how: str, value: str = "dn", group: str = "tile_id") -> DataFrame:
    """Replace null, NaN and infinities by zero or by the mean or median of the valid values of the tile."""
    v = F.col(value)
    good = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    if how == "zero":
        return df.withColumn(value, F.coalesce(good, F.lit(0.0)))
    agg = F.avg(good) if how == "mean" else F.median(good)
    fill = df.groupBy(group).agg(agg.alias("_fill"))
    return df.join(fill, group).withColumn(value, F.coalesce(good, F.col("_fill"), F.lit(0.0))).drop("_fill")


def image_stats(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Range, mean, zero %, SNR, contrast, 256-bin entropy, shadow and saturation fractions of values in [0, 1].

    One scan: bin summaries are aggregated first (256 rows per tile), tiles second.
    """
    v = F.col(value)
    b = F.least(F.lit(255), F.floor(v * 256))
    bins = pixels.groupBy("tile_id", b.alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
        F.count_if(v == 0).alias("_z"), F.count_if(v < 0.05).alias("_d"), F.count_if(v > 0.95).alias("_u"))
    w = F.sum("_c")
    a = bins.groupBy("tile_id").agg(
        w.alias("n"), (F.sum("_s") / w).alias("mean"), (F.sum("_q") / w).alias("_m2"), F.min("_lo").alias("min"), F.max("_hi").alias("max"),
        (F.sum("_z") / w * 100).alias("zero_pct"), (F.sum("_d") / w).alias("shadow_fraction"), (F.sum("_u") / w).alias("saturation_fraction"),
        (F.log2(w) - F.sum(F.col("_c") * F.log2("_c")) / w).alias("entropy"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_m2") - F.col("mean") * F.col("mean")))
    return a.withColumn("std", std).withColumn("snr", F.col("mean") / (F.col("std") + 1e-6)).withColumn(
        "contrast", F.col("std") / (F.col("mean") + 1e-6)).withColumn("dynamic_range", F.col("max") - F.col("min")).drop("_m2")


def percentile_stretch(pixels: DataFrame, lo: float = 2.0, hi: float = 98.0, top: float = 255.0, whole: bool = True,
                       value: str = "dn") -> DataFrame:
    """Clip to two percentiles of the tile and scale to [0, top]; zero where the range is empty."""
    q = pixels.groupBy("tile_id").agg(F.percentile(value, [lo / 100.0, hi / 100.0]).alias("_q"))
    span = F.col("_q")[1] - F.col("_q")[0]
    s = F.when(span > 1e-6, F.least(F.lit(top), F.greatest(F.lit(0.0), (F.col(value) - F.col("_q")[0]) / span * top))).otherwise(0.0)
    out = pixels.join(q, "tile_id")
    return out.withColumn(value, F.floor(s).cast("double") if whole else s).drop("_q")


def bad_columns(pixels: DataFrame, mad: float = 2.5) -> DataFrame:
    """Columns whose mean lies further than `mad` scaled MADs from the median column mean."""
    means = pixels.groupBy("tile_id", "col_no").agg(F.avg("dn").alias("col_mean"))
    med = means.groupBy("tile_id").agg(F.median("col_mean").alias("_med"))
    dev = means.join(med, "tile_id").withColumn("_d", F.abs(F.col("col_mean") - F.col("_med")))
    spread = dev.groupBy("tile_id").agg(F.first("_med").alias("_med"), (1.4826 * F.greatest(F.median("_d"), F.lit(1e-6))).alias("_s"))
    j = means.join(spread, "tile_id")
    high, low = F.col("_med") + mad * F.col("_s"), F.greatest(F.lit(0.0), F.col("_med") - mad * F.col("_s"))
    return j.withColumn("is_bad", (F.col("col_mean") > high) | (F.col("col_mean") < low)).drop("_med", "_s")


def repair_columns(pixels: DataFrame, bad: DataFrame) -> DataFrame:
    """Replace bad columns by the mean of the nearest healthy left and right value of the same row."""
    j = pixels.join(bad.select("tile_id", "col_no", "is_bad"), ["tile_id", "col_no"])
    healthy = F.when(~F.col("is_bad"), F.col("dn"))
    w = Window.partitionBy("tile_id", "row_no").orderBy("col_no")
    left = F.last(healthy, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(healthy, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    fixed = F.coalesce((left + right) / 2.0, left, right, F.col("dn"))
    return j.withColumn("dn", F.when(F.col("is_bad"), fixed).otherwise(F.col("dn"))).drop("is_bad")


def destripe(pixels: DataFrame, alpha: float = 0.85) -> DataFrame:
    """Subtract alpha times each column's median offset from the median of column medians."""
    med = pixels.groupBy("tile_id", "col_no").agg(F.median("dn").alias("_m"))
    common = med.groupBy("tile_id").agg(F.median("_m").alias("_c"))
    off = med.join(common, "tile_id").select("tile_id", "col_no", (F.col("_m") - F.col("_c")).alias("_o"))
    return pixels.join(off, ["tile_id", "col_no"]).withColumn("dn", F.col("dn") - alpha * F.col("_o")).drop("_o")


def with_halo(df: DataFrame, size: int, halo: int, product: tuple[str, ...] = ()) -> DataFrame:
    """Copy border rows to the tiles before and after (tiles follow each other along the strip), over as many tiles as
    the halo is long. `product` names the columns that tell products apart; tile numbers then count within a product.

    Halo rows carry row numbers outside [0, size), so a job can drop them after filtering.
    """
    def copy(shift, cond):
        return F.when(cond, F.struct((F.col("tile_id") + shift).alias("t"), (F.col("row_no") - shift * size).alias("r")))

    steps = [(n, halo - (n - 1) * size) for n in range(1, -(-halo // size) + 1)]
    targets = F.array_compact(F.array(F.struct(F.col("tile_id").alias("t"), F.col("row_no").alias("r")), *[c for n, rest in steps for c in (
        copy(-n, (F.col("row_no") < rest) & (F.col("tile_id") >= n)), copy(n, F.col("row_no") >= size - rest))]))
    tiles = df.select(*product, "tile_id").distinct()
    out = df.withColumn("_t", F.explode(targets)).withColumn("tile_id", F.col("_t.t")).withColumn("row_no", F.col("_t.r")).drop("_t")
    return out.join(tiles, [*product, "tile_id"], "left_semi")


def seamless(df: DataFrame, size: int | None, reach: int, stencil) -> DataFrame:
    """Run a per-tile stencil so that it sees `reach` rows of the neighbouring tiles; results for those rows are
    dropped. Without `size` every tile is an image of its own."""
    if size is None:
        return stencil(df)
    return stencil(with_halo(df, size, reach)).where(F.col("row_no").between(0, size - 1))


def in_tile(tile: str | Column, row: Column, size: int | None) -> tuple[Column, Column]:
    """Tile and row of a product row that is counted from the start of a tile and may lie outside it."""
    if size is None:
        return col(tile), row
    return col(tile) + F.floor(row / size), F.pmod(row, F.lit(size))


def neighbour(value: str | Column, axis: str, offset: int, other: str) -> Column:
    """Value `offset` cells along an axis of the tile; null when that cell is missing."""
    w = Window.partitionBy("tile_id", other).orderBy(axis)
    f = F.lag if offset < 0 else F.lead
    k = abs(offset)
    return F.when(f(axis, k).over(w) == F.col(axis) + offset, f(col(value), k).over(w))


def by_tile(df: DataFrame) -> DataFrame:
    """Place tiles once; row and column windows of the same tile then need no further exchange."""
    return df.repartition("tile_id")


def gradients(df: DataFrame, value: str, spacing: float = 1.0, size: int | None = None) -> DataFrame:
    """Central differences along rows and columns, one-sided where only one neighbour exists."""
    return seamless(df, size, 1, lambda d: _gradients(d, value, spacing))


def _gradients(df: DataFrame, value: str, spacing: float) -> DataFrame:
    def diff(axis, other):
        nxt, prv, v = F.col(f"_{axis}n"), F.col(f"_{axis}p"), F.col(value)
        return (F.when(nxt.isNotNull() & prv.isNotNull(), (nxt - prv) / (2 * spacing)).when(nxt.isNotNull(), (nxt - v) / spacing)
                .when(prv.isNotNull(), (v - prv) / spacing))

    d = by_tile(df)
    for axis, other in (("row_no", "col_no"), ("col_no", "row_no")):
        d = d.withColumn(f"_{axis}n", neighbour(value, axis, 1, other)).withColumn(f"_{axis}p", neighbour(value, axis, -1, other))
    d = d.withColumn("d_row", diff("row_no", "col_no")).withColumn("d_col", diff("col_no", "row_no"))
    return d.drop(*[c for c in d.columns if c.startswith("_row_no") or c.startswith("_col_no")])


def sobel(pixels: DataFrame, value: str = "dn", size: int | None = None) -> DataFrame:
    """Sobel gx, gy and magnitude where the whole 3 x 3 neighbourhood exists."""
    return seamless(pixels, size, 1, lambda d: _sobel(d, value))


def _sobel(pixels: DataFrame, value: str) -> DataFrame:
    d = by_tile(pixels)
    d = d.withColumn("_e", neighbour(value, "col_no", 1, "row_no")).withColumn("_w", neighbour(value, "col_no", -1, "row_no"))
    d = d.withColumn("_d", F.col("_e") - F.col("_w")).withColumn("_s", F.col("_e") + 2 * F.col(value) + F.col("_w"))
    for c in ("_d", "_s"):
        d = d.withColumn(c + "n", neighbour(c, "row_no", 1, "col_no")).withColumn(c + "p", neighbour(c, "row_no", -1, "col_no"))
    d = d.withColumn("gx", F.col("_dp") + 2 * F.col("_d") + F.col("_dn")).withColumn("gy", F.col("_sn") - F.col("_sp"))
    return d.where("gx IS NOT NULL AND gy IS NOT NULL").select(*KEY, "gx", "gy", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("magnitude"))


def structure_sobel(pixels: DataFrame, size: int | None = None) -> DataFrame:
    """Gradient magnitude scaled to [0, 1] per tile, then soft threshold at mean + std/2 and scaled again."""
    m = sobel(pixels, size=size)
    lim = m.groupBy("tile_id").agg(F.min("magnitude").alias("_lo"), F.max("magnitude").alias("_hi"))
    def unit(lo, hi, c):
        return F.when(F.col(hi) - F.col(lo) >= 1e-6, (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)
    s = m.join(lim, "tile_id").withColumn("s", unit("_lo", "_hi", "magnitude")).drop("_lo", "_hi")
    t = s.groupBy("tile_id").agg((F.avg("s") + 0.5 * F.stddev_pop("s")).alias("_t"), F.max("s").alias("_m"))
    top = F.greatest(F.col("_m") - F.col("_t"), F.lit(0.0))
    return s.join(t, "tile_id").select(*KEY, "s", F.when((F.col("s") >= F.col("_t")) & (top >= 1e-6), (F.col("s") - F.col("_t")) / top).otherwise(0.0).alias("structure"))


def gradient_orientation(pixels: DataFrame, size: int | None = None) -> DataFrame:
    """Unit gradient vectors; zero where the gradient is flat."""
    s = sobel(pixels, size=size)
    ok = F.col("magnitude") > 1e-3
    return s.select(*KEY, F.when(ok, F.col("gx") / F.col("magnitude")).otherwise(0.0).alias("ux"),
                    F.when(ok, F.col("gy") / F.col("magnitude")).otherwise(0.0).alias("uy"))


def orientation_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean dot product of unit gradients per tile."""
    r = b.select(*KEY, F.col("ux").alias("_vx"), F.col("uy").alias("_vy"))
    return a.join(r, KEY).groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ux") * F.col("_vx") + F.col("uy") * F.col("_vy")).alias("score"))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    r = max(1, int(truncate * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return [float(x) for x in w / w.sum()]


def smooth(pixels: DataFrame, kernel: list[float], value: str = "dn", size: int | None = None) -> DataFrame:
    """Separable weighted mean over existing cells (weights of missing cells are left out and the rest rescaled)."""
    r = len(kernel) // 2
    weights = F.array(*[F.lit(float(k)) for k in kernel])

    def along(df, axis, other):
        w = Window.partitionBy("tile_id", other).orderBy(axis).rangeBetween(-r, r)
        cells = F.collect_list(F.struct(F.col(axis).alias("a"), F.col(value).alias("v"))).over(w)
        d = df.withColumn("_cells", cells)
        tot = F.aggregate(F.transform("_cells", lambda c: F.struct(
            (F.element_at(weights, (c["a"] - F.col(axis) + r + 1).cast("int")) * c["v"]).alias("s"),
            F.element_at(weights, (c["a"] - F.col(axis) + r + 1).cast("int")).alias("w"))),
            F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
            lambda acc, x: F.struct((acc["s"] + x["s"]).alias("s"), (acc["w"] + x["w"]).alias("w")), lambda acc: acc["s"] / acc["w"])
        return d.withColumn(value, tot).drop("_cells")

    return seamless(pixels, size, r, lambda d: along(along(by_tile(d), "col_no", "row_no"), "row_no", "col_no"))


def unsharp(pixels: DataFrame, sigma: float = 1.0, strength: float = 0.3, size: int | None = None) -> DataFrame:
    """v + strength (v - blur v), kept in [0, 1]."""
    blurred = smooth(pixels.withColumn("_v", F.col("dn")), gaussian_kernel(sigma), size=size)
    s = F.col("_v") + strength * (F.col("_v") - F.col("dn"))
    return blurred.withColumn("dn", F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))).drop("_v")


def block_mean(pixels: DataFrame, k: int, value: str = "dn") -> DataFrame:
    """Area mean of k x k blocks."""
    return pixels.groupBy("tile_id", F.floor(F.col("row_no") / k).alias("row_no"), F.floor(F.col("col_no") / k).alias("col_no")).agg(
        F.avg(value).alias(value))


def pyramid(pixels: DataFrame, levels: int, size: int | None = None) -> DataFrame:
    """Level 0 is the input; each further level is a 5-tap blur followed by keeping even lines and samples. A tile's
    size must be divisible by two for every level."""
    if size is not None and size % 2 ** (levels - 1):
        raise ValueError("tiles cannot be halved that often")
    out = pixels.select(*KEY, "dn").withColumn("level", F.lit(0))
    cur = pixels.select(*KEY, "dn")
    for lv in range(1, levels):
        cur = thumbnail(smooth(cur, [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16], size=size and size >> (lv - 1)), 2)
        out = out.unionByName(cur.withColumn("level", F.lit(lv)))
    return out


def hist_equalize(pixels: DataFrame, value: str = "dn") -> DataFrame:
    """Histogram equalisation of integer values 0..255 per tile."""
    h = pixels.groupBy("tile_id", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy("tile_id").orderBy("_v")
    cdf = h.withColumn("_cdf", F.sum("_c").over(run)).withColumn("_n", F.sum("_c").over(Window.partitionBy("tile_id")))
    first = cdf.withColumn("_min", F.min("_cdf").over(Window.partitionBy("tile_id")))
    lut = F.when(F.col("_n") > F.col("_min"), F.bround((F.col("_cdf") - F.col("_min")) / (F.col("_n") - F.col("_min")) * 255, 0)).otherwise(F.col("_v"))
    return pixels.join(first.select("tile_id", F.col("_v").alias(value), lut.alias("equalized")), ["tile_id", value])


def clahe(pixels: DataFrame, size: int, parts: int = 4, clip: float | DataFrame = 2.0) -> DataFrame:
    """Contrast-limited equalisation: clipped histogram per sub-tile, blend of the four nearest look-up tables.

    Clip count is clip * n / 256 (at least 1); the excess is spread evenly over all 256 values. `dn` is 0..255. `clip`
    may be a table of one limit per tile (tile_id, clip).
    A tile's cells meet in one task; its histograms and look-up tables never become rows.
    """
    step = size / parts
    cells = pixels.where(F.col("tile_id").isNotNull() & F.col("row_no").isNotNull() & F.col("col_no").isNotNull()).select(
        *[F.col(k).cast("bigint").alias(k) for k in KEY], F.col("dn").cast("int").alias("_v"))
    cells = cells.join(clip.select("tile_id", F.col("clip").cast("double").alias("_clip")), "tile_id") if isinstance(clip, DataFrame) else cells.withColumn("_clip", F.lit(float(clip)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = clahe_values(pdf["row_no"].to_numpy(), pdf["col_no"].to_numpy(), pdf["_v"].to_numpy(float), step, parts, float(pdf["_clip"].iloc[0]))
        out.insert(0, "tile_id", int(pdf["tile_id"].iloc[0]))
        return out

    out = cells.groupBy("tile_id").applyInPandas(run, "tile_id long, row_no long, col_no long, dn double")
    return out.select(*[F.col(k).cast(pixels.schema[k].dataType).alias(k) for k in KEY], "dn")


def clahe_values(row: np.ndarray, column: np.ndarray, v: np.ndarray, step: float, parts: int, clip: float) -> pd.DataFrame:
    """Blended look-ups of one tile's cells. Null values (NaN) and those outside 0..255 count in the histograms, but are
    not looked up; sub-tiles without cells have no table; a repeated cell gets the mean of its rows."""
    ty, tx = np.floor(row / step).astype(np.int64), np.floor(column / step).astype(np.int64)
    own = (ty >= 0) & (ty < parts) & (tx >= 0) & (tx < parts)
    sub, known = ty * parts + tx, (v >= 0) & (v <= 255)
    n = np.bincount(sub[own], minlength=parts * parts).astype(float)
    lim = np.maximum(1.0, clip * n / 256)
    inside = own & known
    hist = np.bincount(sub[inside] * 256 + v[inside].astype(np.int64), minlength=parts * parts * 256).reshape(parts * parts, 256).astype(float)
    excess = np.maximum(hist - lim[:, None], 0.0).sum(1)
    other = own & ~known
    if other.any():
        group, times = np.unique(np.column_stack([sub[other], v[other]]), axis=0, return_counts=True, equal_nan=True)
        # unique rows do not merge NaN in every version: nulls of a sub-tile are one group
        null = np.isnan(group[:, 1])
        lost = np.bincount(group[null, 0].astype(np.int64), times[null], parts * parts)
        at = group[~null, 0].astype(np.int64)
        excess += np.maximum(lost - lim, 0.0) + np.bincount(at, np.maximum(times[~null] - lim[at], 0.0), parts * parts)
    table = (np.minimum(hist, lim[:, None]) + excess[:, None] / 256).cumsum(1) * 255 / np.maximum(n, 1.0)[:, None]
    row, column, value = row[known], column[known], v[known].astype(np.int64)
    fy, fx = (row + 0.5) / step - 0.5, (column + 0.5) / step - 0.5
    total, weight = np.zeros(len(row)), np.zeros(len(row))
    for dy in (0, 1):
        for dx in (0, 1):
            y, x = (np.clip(np.floor(f) + d, 0, parts - 1).astype(np.int64) for f, d in ((fy, dy), (fx, dx)))
            w = np.abs(1 - dy - (fy - np.floor(fy))) * np.abs(1 - dx - (fx - np.floor(fx))) * (n[y * parts + x] > 0)
            total, weight = total + w * table[y * parts + x, value], weight + w
    place, at = np.unique(np.column_stack([row, column]), axis=0, return_inverse=True)
    at = at.ravel()
    total, weight = (np.bincount(at, x, len(place)) for x in (total, weight))
    place, total, weight = place[weight > 0], total[weight > 0], weight[weight > 0]
    return pd.DataFrame({"row_no": place[:, 0].astype(np.int64), "col_no": place[:, 1].astype(np.int64), "dn": total / weight})


def adaptive_clahe(pixels: DataFrame, size: int, parts: int = 4, default: float = 2.0) -> DataFrame:
    """`clahe` with the clip limit that the contrast of each tile asks for (deviation of dn / 255)."""
    std = pixels.groupBy("tile_id").agg(X.adaptive_clip(F.stddev_pop(F.col("dn") / 255.0), default).alias("_clip"))
    sorted_out = pixels.join(std, "tile_id")
    out = None
    for limit in (4.0, 1.5, default):  # the three limits that occur; each tile takes part once
        c = clahe(sorted_out.where(F.col("_clip") == limit).drop("_clip"), size, parts, limit)
        out = c if out is None else out.unionByName(c)
    return out


def minmax_01(df: DataFrame, value: str = "dn") -> DataFrame:
    """Scale each tile to [0, 1]; a flat tile becomes zero."""
    lim = df.groupBy("tile_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(lim, "tile_id").withColumn(value, F.when(span > 0, (F.col(value) - F.col("_lo")) / span).otherwise(0.0)).drop("_lo", "_hi")


def sample_raster(points: DataFrame, raster: DataFrame, how: str = "bilinear", value: str = "dn", x: str = "x", y: str = "y", size: int | None = None) -> DataFrame:
    """Value at (x, y) of a tile: nearest cell or bilinear over the four corner cells (null when one is missing or
    the position is). With `size`, y may reach beyond the tile: the cells then come from the tiles before or after.

    Equi-joins on cell keys only; the four corners arrive with one explode and one aggregation per point.
    """
    cells = raster.select(F.col("tile_id").alias("_t"), F.col("row_no").alias("_r"), F.col("col_no").alias("_c"), F.col(value).alias("_v"))
    if how == "nearest":
        t, r = in_tile("tile_id", F.bround(F.col(y), 0).cast("bigint"), size)
        p = points.withColumn("_t", t).withColumn("_r", r).withColumn("_c", F.bround(F.col(x), 0).cast("bigint"))
        return p.join(cells, ["_t", "_r", "_c"], "left").withColumnRenamed("_v", "sampled").drop("_t", "_r", "_c")
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    corner = F.array(*[F.struct((F.floor(y) + dy).cast("bigint").alias("_r"), (F.floor(x) + dx).cast("bigint").alias("_c"),
                                ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("_w")) for dy in (0, 1) for dx in (0, 1)])
    keys = points.columns
    p = points.withColumn("_k", F.explode_outer(F.filter(corner, lambda k: k["_w"] > 0))).select(*keys, "_k.*")
    t, r = in_tile("tile_id", F.col("_r"), size)
    j = p.withColumn("_t", t).withColumn("_r", r).join(cells, ["_t", "_r", "_c"], "left")
    return j.groupBy(*keys).agg(F.when(F.count_if(F.col("_v").isNull()) == 0, F.sum(F.col("_w") * F.col("_v"))).alias("sampled"))


def tile_job(df: DataFrame, fn, size: int, schema: str, value: str = "dn", extra: list[str] | None = None) -> DataFrame:
    """Run `fn(array with NaN for nodata, row offset) -> DataFrame` once per tile in NumPy."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0 = int(pdf["row_no"].min())
        h = int(pdf["row_no"].max()) - r0 + 1
        img = np.full((h, size), np.nan)
        img[pdf["row_no"].to_numpy() - r0, pdf["col_no"].to_numpy()] = pdf[value].to_numpy()
        out = fn(img, r0)
        out.insert(0, "tile_id", int(pdf["tile_id"].iloc[0]))
        return out

    return df.groupBy("tile_id").applyInPandas(run, schema)


def longest_run(cells: DataFrame, keys: list[str], axis: str = "col_no") -> DataFrame:
    """Longest contiguous run along an axis per group (earliest on ties); a run is an island of axis - position."""
    isl = cells.withColumn("_g", F.col(axis) - F.row_number().over(Window.partitionBy(*keys).orderBy(axis)))
    runs = isl.groupBy(*keys, "_g").agg(F.min(axis).alias("start"), F.max(axis).alias("end"), F.count(F.lit(1)).alias("length"))
    return runs.groupBy(*keys).agg(F.max(F.struct("length", -F.col("start"), "start", "end")).alias("m")).select(
        *keys, "m.start", "m.end", "m.length")


def sliding_segments(rows: DataFrame, height: int, step: int, line: str = "line", product: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping row segments of each product: every row appears once in each full segment that covers it.

    Lines count from 0 in a product. The last start keeps segments inside the strip, like a range(0, H - height + 1, step).
    """
    lines = rows.groupBy(*product).agg((F.max(line) + 1).alias("_h"))
    first = F.greatest(F.lit(0), F.ceil((F.col(line) - height + 1) / step))
    last = F.least(F.floor(F.col(line) / step), F.floor((F.col("_h") - height) / step))
    starts = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    with_height = rows.join(lines, list(product)) if product else rows.join(F.broadcast(lines))  # one row without a product
    return with_height.withColumn("_s", F.explode(starts)).withColumn("segment_start", F.col("_s") * step).drop("_s", "_h")


def regular_nodes(height: int, width: int, spacing: int, margin: int, tiles: DataFrame) -> DataFrame:
    """Fixed lattice of nodes for each tile, `margin` away from the border."""
    def axis(n):
        return F.explode(F.sequence(F.lit(margin).cast("bigint"), F.lit(n - margin - 1).cast("bigint"), F.lit(spacing).cast("bigint")))
    return tiles.select("tile_id").distinct().withColumn("qy", axis(height)).withColumn("qx", axis(width))


def conforming_nodes(valid: DataFrame, half: int, nx: int, ny: int, size: int | None = None) -> DataFrame:
    """Node lattice that follows the valid swath: the mask is eroded by `half`, ny rows span its extent in each tile
    and nx nodes span each row's safe extent."""
    side = 2 * half + 1
    rw = Window.partitionBy("tile_id", "row_no").orderBy("col_no").rangeBetween(-half, half)
    cw = Window.partitionBy("tile_id", "col_no").orderBy("row_no").rangeBetween(-half, half)
    def eroded(d):
        d = by_tile(d).withColumn("_h", F.count(F.lit(1)).over(rw) == side)
        return d.withColumn("_v", F.count_if(F.col("_h")).over(cw) == side).where("_v")
    safe = seamless(valid.select(*KEY), size, half, eroded)
    rows = safe.groupBy("tile_id", "row_no").agg(F.min("col_no").alias("c0"), F.max("col_no").alias("c1"), F.count(F.lit(1)).alias("k"))
    span = rows.groupBy("tile_id").agg(F.min("row_no").alias("r0"), F.max("row_no").alias("r1"))
    def linspace(a, b, n):
        return F.floor(F.col(a) + F.col("_i") * (F.col(b) - F.col(a)) / max(n - 1, 1))
    ys = span.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).select("tile_id", F.col("_i").alias("iy"), linspace("r0", "r1", ny).alias("row_no"))
    xs = ys.join(rows.where(F.col("k") >= nx), ["tile_id", "row_no"]).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return xs.select("tile_id", "iy", F.col("_i").alias("ix"), F.col("row_no").alias("qy"), linspace("c0", "c1", nx).alias("qx"))


def validity_mask(pixels: DataFrame, h: Column, shadow_a: DataFrame, shadow_b: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels not shadowed in A, not shadowed at their place in B, and mapping inside B under `h`."""
    x, y = F.col("col_no").cast("double"), F.col("row_no").cast("double")
    w = h[6] * x + h[7] * y + h[8]
    safe = F.when(F.abs(w) < 1e-8, F.lit(1e-8)).otherwise(w)
    bx, by = (h[0] * x + h[1] * y + h[2]) / safe, (h[3] * x + h[4] * y + h[5]) / safe
    inb = (w > 0) & (bx >= 0) & (bx < width - 1) & (by >= 0) & (by < height - 1)
    a = shadow_a.select(*KEY, F.lit(True).alias("_sa"))
    b = shadow_b.select("tile_id", F.col("row_no").alias("_br"), F.col("col_no").alias("_bc"), F.lit(True).alias("_sb"))
    p = pixels.withColumn("_in", inb).withColumn("_br", F.bround(by, 0).cast("bigint")).withColumn("_bc", F.bround(bx, 0).cast("bigint"))
    j = p.join(a, KEY, "left").join(b, ["tile_id", "_br", "_bc"], "left")
    return j.select(*KEY, (F.col("_in") & F.col("_sa").isNull() & F.col("_sb").isNull()).alias("valid"))


# --- terrain ------------------------------------------------------------------------------------

def scale_dem(df: DataFrame, scale: float, nodata: float, value: str = "z") -> DataFrame:
    """Counts to metres above datum; the nodata code becomes null."""
    return df.withColumn(value, F.when(F.col(value) != nodata, F.col(value) * scale))


def slope(dem: DataFrame, spacing: float = 5.0, size: int | None = None) -> DataFrame:
    g = gradients(dem, "z", spacing, size)
    return g.withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.col("d_row") * F.col("d_row") + F.col("d_col") * F.col("d_col")))))


def normals(dem: DataFrame, spacing: float = 5.0, size: int | None = None) -> DataFrame:
    """Unit normals (east, north, up): row numbers grow southwards."""
    g = gradients(dem, "z", spacing, size)
    n = F.sqrt(F.col("d_row") * F.col("d_row") + F.col("d_col") * F.col("d_col") + 1)
    return g.withColumn("nx", -F.col("d_col") / n).withColumn("ny", F.col("d_row") / n).withColumn("nz", 1 / n)


def horizon_axis(dem: DataFrame, azimuth: int, steps: int, spacing: float = 5.0, size: int | None = None) -> DataFrame:
    """Largest obstacle tangent along a ray that follows a row or a column (azimuth 0, 90, 180 or 270)."""
    axis, other, sign = {0: ("row_no", "col_no", -1), 180: ("row_no", "col_no", 1), 90: ("col_no", "row_no", 1), 270: ("col_no", "row_no", -1)}[azimuth]
    w = Window.partitionBy("tile_id", other).orderBy(axis)
    w = w.rangeBetween(1, steps) if sign > 0 else w.rangeBetween(-steps, -1)
    t = F.array_max(F.transform("_ray", lambda p: (p["z"] - F.col("z")) / (F.abs(p["a"] - F.col(axis)) * spacing)))
    def rays(d):
        d = by_tile(d).withColumn("_ray", F.collect_list(F.struct(F.col(axis).alias("a"), F.col("z").alias("z"))).over(w))
        return d.withColumn("max_tan", F.coalesce(t, F.lit(-1e9))).drop("_ray")
    return seamless(dem, size if axis == "row_no" else None, steps, rays)


def sky_view(max_tan: str | Column) -> Column:
    obs = F.degrees(F.atan(F.least(F.greatest(col(max_tan), F.lit(0.0)), F.lit(10.0))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.35), 1 - obs / 45))


def shadow_mask(max_tan: str | Column, elevation_deg: float) -> Column:
    return col(max_tan) > F.tan(F.radians(F.lit(float(elevation_deg))))


def horizon(dem: DataFrame, size: int, azimuth_deg: float, steps: int, spacing: float = 5.0) -> DataFrame:
    """Any azimuth: bilinear steps along the ray on tiles that carry a halo of `steps` rows (vectorised per tile)."""
    dc, dr = (round(float(v), 12) + 0.0 for v in (np.sin(np.radians(azimuth_deg)), -np.cos(np.radians(azimuth_deg))))
    halo = int(np.ceil(steps * abs(dr))) + 1

    def job(img: np.ndarray, r0: int) -> pd.DataFrame:
        h, w = img.shape
        rr, cc = np.mgrid[0:h, 0:w].astype(float)
        best = np.full((h, w), -1e9)
        for k in range(1, steps + 1):
            y, x = rr + k * dr, cc + k * dc
            y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
            ok = (y0 >= 0) & (x0 >= 0) & (y0 < h) & (x0 < w) & (np.ceil(y) < h) & (np.ceil(x) < w)
            y1, x1 = np.clip(y0 + 1, 0, h - 1), np.clip(x0 + 1, 0, w - 1)
            y0c, x0c = np.clip(y0, 0, h - 1), np.clip(x0, 0, w - 1)
            fy, fx = y - y0, x - x0
            v = ((img[y0c, x0c] * (1 - fy) * (1 - fx)) + np.where(fx > 0, img[y0c, x1] * (1 - fy) * fx, 0)
                 + np.where(fy > 0, img[y1, x0c] * fy * (1 - fx), 0) + np.where((fx > 0) & (fy > 0), img[y1, x1] * fy * fx, 0))
            t = np.where(ok & np.isfinite(v), (v - img) / (k * spacing), -1e9)
            best = np.fmax(best, t)
        keep = np.isfinite(img) & (rr + r0 >= 0) & (rr + r0 < size)
        return pd.DataFrame({"row_no": (rr[keep] + r0).astype("int64"), "col_no": cc[keep].astype("int64"), "max_tan": best[keep]})

    return tile_job(with_halo(dem, size, halo), job, size, "tile_id long, row_no long, col_no long, max_tan double", "z")


def raster_summary(dem: DataFrame, cells_per_tile: int, min_valid_pct: float = 50.0) -> DataFrame:
    """Minimum, maximum, mean, deviation, relief and valid share of each tile."""
    a = dem.groupBy("tile_id").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"),
                                   F.stddev_pop("z").alias("z_std"), F.count("z").alias("n_valid"))
    pct = F.col("n_valid") / cells_per_tile * 100
    return a.withColumn("relief", F.col("z_max") - F.col("z_min")).withColumn("valid_pct", pct).withColumn("usable", pct >= min_valid_pct)
