"""Preprocessing recipes: raw tiles to enhanced images, each with a report per tile.

Three families: `base` recipes work on [0, 1] and judge their own result, `calibrated` ones start from calibrated counts
and pick the clip limit from them, `compact` ones are a stretch and an equalisation. Every recipe returns (image,
report): the image has tile_id, row_no, col_no, dn; the report one row per tile with the steps taken (in order), the
numbers the recipe decides by, and for base recipes the quality numbers of the image. Tiles follow each other along the
strip: with `size`, stencils see the rows of the neighbouring tiles.

Images are written once to the shared folder, since image and report both read them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.functions import transforms as X
from tieline.operators import pixels as P
from tieline.session import cut_lineage

KEY = P.KEY


def patches(pixels: DataFrame, reach: int, value: str = "dn") -> DataFrame:
    """tile_id, row_no, col_no, the value and `_patch`: the existing cells within `reach` rows and columns as (dy, dx, v),
    the cell itself included.

    Each cell hands its value to the places beside it in its row, so that a place knows its stretch of the row even if it
    has no cell itself; a window down the column then joins those stretches. All of it happens where the tile lies."""
    beside = F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1)]))
    handed = P.by_tile(pixels).select(*KEY, F.col(value).alias("v"), beside.alias("dx"))
    places = handed.groupBy("tile_id", "row_no", (F.col("col_no") - F.col("dx")).alias("col_no")).agg(
        F.collect_list(F.struct("dx", "v")).alias("_line"), F.max(F.when(F.col("dx") == 0, F.col("v"))).alias(value), F.max((F.col("dx") == 0).cast("int")).alias("_own"))
    down = Window.partitionBy("tile_id", "col_no").orderBy("row_no").rangeBetween(-reach, reach)
    rows = places.withColumn("_lines", F.collect_list(F.struct(F.col("row_no").alias("r"), F.col("_line").alias("cells"))).over(down)).where("_own = 1")
    cells = F.flatten(F.transform("_lines", lambda l: F.transform(l["cells"], lambda c: F.struct(
        (l["r"] - F.col("row_no")).cast("int").alias("dy"), c["dx"].alias("dx"), c["v"].alias("v")))))
    return rows.select(*KEY, value, cells.alias("_patch"))


def _sum(cells: Column, of) -> Column:
    return F.aggregate(F.transform(cells, of), F.lit(0.0), lambda a, x: a + x)


def _edge_keeping_mean(value: str, sigma_value: float, sigma_space: float, reach: int) -> Column:
    """Mean over the disc of radius `reach`, weighted by distance and by likeness to the cell itself."""
    disc = F.filter("_patch", lambda c: c["dy"] * c["dy"] + c["dx"] * c["dx"] <= reach * reach)

    def weight(c):
        gap = c["v"] - F.col(value)
        return F.exp(-(c["dy"] * c["dy"] + c["dx"] * c["dx"]) / F.lit(2.0 * sigma_space ** 2) - gap * gap / F.lit(2.0 * sigma_value ** 2))

    return _sum(disc, lambda c: weight(c) * c["v"]) / _sum(disc, weight)


def denoise(pixels: DataFrame, sigma_value: float, sigma_space: float, reach: int = 2, size: int | None = None) -> DataFrame:
    """Bilateral mean of `dn`; cells beyond the strip are left out of both sums."""
    return P.seamless(pixels, size, reach, lambda d: patches(d, reach).withColumn("dn", _edge_keeping_mean("dn", sigma_value, sigma_space, reach)).drop("_patch"))


def denoise_flat(pixels: DataFrame, sigma_value: float = 0.1, sigma_space: float = 5.0, reach: int = 2, flat: float = 0.005, size: int | None = None) -> DataFrame:
    """Bilateral mean where the neighbourhood is flat, the value itself where its variance reaches `flat`, a blend of the
    two between. `dn` is in [0, 1]; the variance is that of the existing cells of the square of side 2 reach + 1."""
    def stencil(d):
        n = F.size("_patch")
        mean = _sum(F.col("_patch"), lambda c: c["v"]) / n
        spread = F.greatest(F.lit(0.0), _sum(F.col("_patch"), lambda c: c["v"] * c["v"]) / n - mean * mean)
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(flat) - spread) / F.lit(flat)))
        blend = F.col("dn") * (1 - share) + _edge_keeping_mean("dn", sigma_value, sigma_space, reach) * share
        return patches(d, reach).withColumn("dn", blend).drop("_patch")

    return P.seamless(pixels, size, reach, stencil)


def to_unit(pixels: DataFrame, bits: int | None = None) -> DataFrame:
    """Counts to [0, 1]: by the full scale of 8 or 16 bits, or without `bits` from the tile's minimum to its maximum (a
    flat tile becomes 0). Values that are null or not finite first become the tile's median."""
    clean = P.clean_numeric(pixels.select(*KEY, F.col("dn").cast("double").alias("dn")), "median")
    return clean.withColumn("dn", F.col("dn") / (2.0 ** bits - 1)) if bits else P.minmax_01(clean)


def whole_counts(v) -> Column:
    """[0, 1] to whole counts 0..255; rounding to six decimals first keeps a value on a step from falling below it."""
    return F.floor(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * 255.0, 6)).cast("double")


def area_resize(pixels: DataFrame, size: int, factor: float) -> DataFrame:
    """Tiles of `size` cells a side reduced by `factor` to round(size / factor) a side: each new cell is the mean of the
    old ones weighted by the area they share. A factor below 1 or one that leaves no cell is an error."""
    to = round(size / factor)
    if factor < 1 or to < 1:
        raise ValueError(f"cannot reduce {size} cells by {factor}")
    step = size / to

    def parts(axis):
        first, last = F.floor(F.col(axis) / step), F.floor((F.col(axis) + 1) / step - 1e-9)
        share = lambda i: F.least((i + 1) * F.lit(step), F.col(axis) + 1) - F.greatest(i * F.lit(step), F.col(axis))
        return F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), share(i).alias("w")))

    rows = pixels.select("tile_id", "dn", F.explode(parts("row_no")).alias("r"), "col_no").select("tile_id", "dn", "r", F.explode(parts("col_no")).alias("c"))
    w = F.col("r.w") * F.col("c.w")
    return rows.groupBy("tile_id", F.col("r.i").alias("row_no"), F.col("c.i").alias("col_no")).agg((F.sum(w * F.col("dn")) / F.sum(w)).alias("dn"))


def counts_report(pixels: DataFrame, lo: float, hi: float, dark: float | None = None) -> DataFrame:
    """Per tile: dynamic_range between two percentiles, shadow_fraction (share of cells below the lower one, or below
    `dark` if given) and saturation_fraction (share above the upper one)."""
    q = pixels.groupBy("tile_id").agg(F.percentile("dn", [lo / 100.0, hi / 100.0]).alias("_q"))
    below = F.col("dn") < (F.col("_q")[0] if dark is None else F.lit(dark))
    return pixels.select("tile_id", "dn").join(q, "tile_id").groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_cells"), (F.first("_q")[1] - F.first("_q")[0]).alias("dynamic_range"),
        F.avg(below.cast("double")).alias("shadow_fraction"), F.avg((F.col("dn") > F.col("_q")[1]).cast("double")).alias("saturation_fraction"))


def _steps(*names) -> Column:
    return F.array(*[n if isinstance(n, Column) else F.lit(n) for n in names]).alias("steps")


def ohrc_base(pixels: DataFrame, size: int, parts: int = 16, bits: int | None = 8, clip: float = 2.5, adaptive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Unit scale, denoising of flat ground, equalisation with a clip limit that follows the tile's contrast, gentle
    sharpening. Confidence falls with shadow above 60 % and saturation above 20 % of the cells."""
    calm = cut_lineage(denoise_flat(to_unit(pixels, bits), size=size))
    limit = X.adaptive_clip(F.stddev_pop("dn"), clip) if adaptive else F.lit(clip)
    limits = calm.groupBy("tile_id").agg(limit.alias("clip_limit"), F.count(F.lit(1)).alias("_n")).drop("_n")
    even = P.clahe(calm.withColumn("dn", whole_counts(F.col("dn"))), size, parts, limits.withColumnRenamed("clip_limit", "clip"))
    image = cut_lineage(P.unsharp(even.withColumn("dn", F.col("dn") / 255.0), size=size).select(*KEY, F.round("dn", 9).alias("dn")))
    report = P.image_stats(image, "dn").join(limits, "tile_id").withColumn("confidence", X.preprocess_confidence("shadow_fraction", "saturation_fraction"))
    chosen = F.concat(F.lit("clip_limit="), F.format_number("clip_limit", 2))
    return image, report.withColumn("steps", _steps("unit_scale", "denoise_flat", chosen, "equalise", "sharpen", "report"))


def tmc2_base(pixels: DataFrame, size: int, bits: int | None = 16, lo: float = 2.0, hi: float = 98.0, equalise: bool = False, sigma: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Unit scale, percentile stretch (a tile without range keeps its values), optional histogram equalisation, light
    smoothing. Confidence loses 0.5 for contrast below 0.05 and 0.3 for saturation above 30 %."""
    unit = to_unit(pixels, bits)
    q = unit.groupBy("tile_id").agg(F.percentile("dn", [lo / 100.0, hi / 100.0]).alias("_q"))
    span = F.col("_q")[1] - F.col("_q")[0]
    wide = unit.join(q, "tile_id").withColumn("dn", F.when(span > 0, (F.col("dn") - F.col("_q")[0]) / span).otherwise(F.col("dn"))).drop("_q")
    image = wide.withColumn("dn", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dn"))))
    if equalise:
        image = P.hist_equalize(image.withColumn("dn", whole_counts(F.col("dn")))).select(*KEY, (F.col("equalized") / 255.0).alias("dn"))
    if sigma > 0:
        image = P.smooth(image, P.gaussian_kernel(sigma), size=size)
    image = cut_lineage(image.select(*KEY, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dn"))), 9).alias("dn")))
    report = P.image_stats(image, "dn")
    loss = F.when(F.col("contrast") < 0.05, 0.5).otherwise(0.0) + F.when(F.col("saturation_fraction") > 0.3, 0.3).otherwise(0.0)
    names = ["unit_scale", "stretch", *(["equalise"] if equalise else []), *(["smooth"] if sigma > 0 else []), "report"]
    return image, report.withColumn("confidence", F.greatest(F.lit(0.0), 1.0 - loss)).withColumn("steps", _steps(*names))


def ohrc_calibrated(pixels: DataFrame, size: int, parts: int = 16, clip: float = 3.0, sigma_value: float = 30.0, sigma_space: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """8-bit counts: bilateral denoising and equalisation. The clip limit doubles where the 5-95 % range is below 30
    counts and grows by half where over 30 % of the cells lie in shadow (below a twentieth of full scale)."""
    report = counts_report(pixels, 5.0, 95.0, dark=0.05 * 255)
    limit = F.when(F.col("dynamic_range") < 30, clip * 2).when(F.col("shadow_fraction") > 0.3, clip * 1.5).otherwise(F.lit(clip))
    report = cut_lineage(report.withColumn("clip_limit", limit))
    calm = denoise(pixels.select(*KEY, "dn"), sigma_value, sigma_space, size=size).withColumn("dn", F.floor(F.round(F.col("dn") + 0.5, 6)).cast("double"))
    image = P.clahe(cut_lineage(calm), size, parts, report.select("tile_id", F.col("clip_limit").alias("clip")))
    return _finish(image), report.withColumn("steps", _steps("denoise", "equalise", "unit_scale"))


def _finish(image: DataFrame) -> DataFrame:
    return cut_lineage(image.select(*KEY, F.round(F.col("dn") / 255.0, 9).alias("dn")))


def tmc2_calibrated(pixels: DataFrame, size: int, parts: int = 32, clip: float = 2.5, lo: float = 1.0, hi: float = 99.0, smooth: bool = True) -> tuple[DataFrame, DataFrame]:
    """16-bit counts: stretch to whole counts 0..255, equalisation, a gentle 3 x 3 blur."""
    even = P.clahe(P.percentile_stretch(pixels.select(*KEY, "dn"), lo, hi), size, parts, clip)
    image = P.smooth(cut_lineage(even), [0.25, 0.5, 0.25], size=size) if smooth else even
    report = counts_report(pixels, lo, hi).withColumn("clip_limit", F.lit(clip))
    return _finish(image), report.withColumn("steps", _steps("stretch", "equalise", *(["smooth"] if smooth else []), "unit_scale"))


def iirs_calibrated(band: DataFrame, size: int, parts: int = 8, clip: float = 3.0, lo: float = 2.0, hi: float = 98.0) -> tuple[DataFrame, DataFrame]:
    """One band of a cube (or its first component) as tiles: stretch and equalisation."""
    return tmc2_calibrated(band, size, parts, clip, lo, hi, smooth=False)


def compact(pixels: DataFrame, size: int, parts: int = 8, clip: float = 3.0, dark: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """Stretch between the 1st and 99th percentile and equalisation; the image keeps counts 0..255. shadow_fraction is
    the share of the finished image below `dark`."""
    image = cut_lineage(P.clahe(P.percentile_stretch(pixels.select(*KEY, "dn"), 1.0, 99.0), size, parts, clip).select(*KEY, F.round("dn", 6).alias("dn")))
    shadow = image.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_cells"), F.avg((F.col("dn") < dark).cast("double")).alias("shadow_fraction"), F.avg("dn").alias("mean"))
    q = pixels.groupBy("tile_id").agg(F.percentile("dn", [0.01, 0.99]).alias("_q"))
    report = shadow.join(q.select("tile_id", (F.col("_q")[1] - F.col("_q")[0]).alias("dynamic_range")), "tile_id")
    return image, report.withColumn("clip_limit", F.lit(clip)).withColumn("steps", _steps("stretch", "equalise"))


def compact_synthetic_tmc2(pixels: DataFrame, size: int, gsd: float, target_gsd: float = 5.0, parts: int = 8, clip: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """The compact recipe on a fine image reduced to the ground spacing of a coarser instrument."""
    coarse = cut_lineage(area_resize(pixels, size, target_gsd / gsd))
    image, report = compact(coarse, round(size * gsd / target_gsd), parts, clip)
    return image, report.withColumn("steps", F.concat(F.array(F.lit("reduce")), "steps"))


def align_scales(fine: DataFrame, coarse: DataFrame, size: int, ratio: float, upsample: int = 1) -> tuple[DataFrame, DataFrame]:
    """(fine image at the pyramid level closest to `ratio`, coarse image magnified `upsample` times), ready for matching.

    ratio: ground spacing of the fine image over that of the coarse one (below 1). The pyramid is as deep as the ratio
    asks for, but stops before a level would be smaller than 4 cells a side; of equally close levels the finer is taken.
    Both results carry `scale`, their size relative to the input. Magnification is bilinear."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    depth = max(2, math.ceil(math.log2(1 / ratio)) + 1)
    levels = [k for k in range(depth) if size % 2 ** k == 0 and (k == 0 or size >> k - 1 >= 8)]
    best = min(levels, key=lambda k: (abs(2.0 ** -k - ratio), k))
    src = P.pyramid(fine, best + 1, size).where(F.col("level") == best).select(*KEY, "dn", F.lit(2.0 ** -best).alias("scale"))
    dst = coarse.select(*KEY, "dn") if upsample == 1 else magnify(coarse, size, upsample)
    return src, dst.withColumn("scale", F.lit(float(upsample)))


def magnify(pixels: DataFrame, size: int, times: int) -> DataFrame:
    """Each cell becomes times x times cells, bilinear between cell centres; positions beyond the tile's outer centres
    take the outer cells' values. A tile's cells meet in one task, corners never become rows. Cells that repeat count as in
    `sample_raster`."""
    known = F.col("tile_id").isNotNull() & F.col("row_no").isNotNull() & F.col("col_no").isNotNull()
    cells = pixels.where(known).select(*[F.col(k).cast("bigint").alias(k) for k in KEY], F.col("dn").cast("double").alias("dn"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = magnified(*(pdf[c].to_numpy() for c in ("row_no", "col_no", "dn")), size, times)
        out.insert(0, "tile_id", int(pdf["tile_id"].iloc[0]))
        return out

    out = cells.groupBy("tile_id").applyInPandas(run, "tile_id long, row_no long, col_no long, dn double")
    return out.unionByName(_magnify_places(pixels.where(~known), pixels, size, times))


def magnified(row: np.ndarray, col: np.ndarray, value: np.ndarray, size: int, times: int) -> pd.DataFrame:
    """The magnified cells of one tile."""
    at, place, copies = np.unique(np.stack([row, col], 1), axis=0, return_inverse=True, return_counts=True)
    place = place.ravel()
    total = np.bincount(place, np.nan_to_num(value), len(at))
    total[np.bincount(place, np.isnan(value), len(at)) > 0] = np.nan
    (r0, c0), (r1, c1) = at.min(0), at.max(0)
    grid = np.full((r1 - r0 + 1, c1 - c0 + 1), np.nan)  # NaN: no cell there, or one without a value
    grid[at[:, 0] - r0, at[:, 1] - c0] = total
    i, j = (v.ravel() for v in np.meshgrid(np.arange(times), np.arange(times), indexing="ij"))
    new = [at[:, n:n + 1] * times + k for n, k in ((0, i), (1, j))]
    y, x = (np.clip(at[:, n:n + 1] + (k + 0.5) / times - 0.5, 0.0, size - 1.0) for n, k in ((0, i), (1, j)))
    out = np.zeros(y.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            r, c = np.floor(y).astype(int) + dy - r0, np.floor(x).astype(int) + dx - c0
            w = (y - np.floor(y) if dy else 1 - (y - np.floor(y))) * (x - np.floor(x) if dx else 1 - (x - np.floor(x)))
            inside = (r >= 0) & (r < grid.shape[0]) & (c >= 0) & (c < grid.shape[1])
            v = np.where(inside, grid[np.clip(r, 0, grid.shape[0] - 1), np.clip(c, 0, grid.shape[1] - 1)], np.nan)
            out += np.where(w > 0, w * v, 0.0)
    return pd.DataFrame({"row_no": new[0].ravel(), "col_no": new[1].ravel(), "dn": (out * copies[:, None]).ravel()})


def _magnify_places(cells: DataFrame, pixels: DataFrame, size: int, times: int) -> DataFrame:
    """Cells without a full position, by join."""
    at = F.explode(F.array(*[F.lit(k) for k in range(times)]))
    grid = cells.select(*KEY).withColumn("_i", at).withColumn("_j", at)
    place = lambda axis, k: F.least(F.greatest(F.col(axis) + (F.col(k) + 0.5) / times - 0.5, F.lit(0.0)), F.lit(size - 1.0))
    points = grid.select("tile_id", (F.col("row_no") * times + F.col("_i")).alias("row_no"), (F.col("col_no") * times + F.col("_j")).alias("col_no"),
                         place("row_no", "_i").alias("y"), place("col_no", "_j").alias("x"))
    return P.sample_raster(points, pixels, "bilinear").select(*KEY, F.col("sampled").alias("dn"))
