"""Hyperspectral cubes: (product_id, line, sample, spectrum array, wavelengths array)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tieline.fixed import PROXY_FALLBACK_BANDS, PROXY_MAX_NM
from tieline.functions.stats import safe_corr
from tieline.operators import pixels as P
from tieline.session import cut_lineage


def band_indices(lo: float | None = None, hi: float = PROXY_MAX_NM, fallback: int = PROXY_FALLBACK_BANDS) -> Column:
    """1-based positions of bands in a wavelength range; the first `fallback` bands when there is none."""
    every = F.sequence(F.lit(1), F.size("wavelengths"))
    def fits(i):
        w = F.element_at("wavelengths", i)
        return (w <= hi) & (w >= lo) if lo is not None else w <= hi
    sel = F.filter(every, fits)
    return F.when(F.size(sel) > 0, sel).otherwise(F.filter(every, lambda i: i <= fallback))


def finite(v: Column) -> Column:
    return F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v.cast("double"))


def select_bands(cube: DataFrame, lo: float | None = None, hi: float = PROXY_MAX_NM, fallback: int = PROXY_FALLBACK_BANDS) -> DataFrame:
    """Keep only the chosen bands of both arrays (no explode)."""
    c = cube.withColumn("_sel", band_indices(lo, hi, fallback))
    return (c.withColumn("spectrum", F.transform("_sel", lambda i: finite(F.element_at("spectrum", i))))
            .withColumn("wavelengths", F.transform("_sel", lambda i: F.element_at("wavelengths", i))).drop("_sel"))


def band_stats(cube: DataFrame) -> DataFrame:
    """Mean and population variance per product and band (mergeable sums, combined before the shuffle)."""
    long = cube.select("product_id", F.posexplode("spectrum").alias("band", "v"))
    return long.groupBy("product_id", "band").agg(F.avg(finite(F.col("v"))).alias("mean"), F.var_pop(finite(F.col("v"))).alias("variance"),
                                                  F.count(F.lit(1)).alias("n"))


def _by_band(stats: DataFrame, value: str, out: str) -> DataFrame:
    return stats.groupBy("product_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("band", F.col(value).alias("x")))), lambda s: s["x"]).alias(out))


def drop_bad_bands(cube: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Drop bands whose variance is below `fraction` of the product's median band variance."""
    v = _by_band(band_stats(cube), "variance", "_var")
    med = band_stats(cube).groupBy("product_id").agg(F.median("variance").alias("_med"))
    j = cube.join(v.join(med, "product_id"), "product_id")
    keep = F.filter(F.sequence(F.lit(1), F.size("_var")), lambda i: F.element_at("_var", i) >= fraction * F.col("_med"))
    j = j.withColumn("_keep", keep)
    return (j.withColumn("spectrum", F.transform("_keep", lambda i: F.element_at("spectrum", i)))
            .withColumn("wavelengths", F.transform("_keep", lambda i: F.element_at("wavelengths", i))).drop("_keep", "_var", "_med"))


def proxy_mean(cube: DataFrame) -> DataFrame:
    """Average of the bands after dividing each by its mean over the product (means below 1e-8 count as 1)."""
    means = _by_band(band_stats(cube), "mean", "_means")
    norm = F.zip_with("spectrum", "_means", lambda v, m: finite(v) / F.when(F.abs(m) > 1e-8, m).otherwise(F.lit(1.0)))
    j = cube.join(means, "product_id").withColumn("_norm", norm)
    return j.select("product_id", "line", "sample", (F.aggregate("_norm", F.lit(0.0), lambda s, v: s + v) / F.size("_norm")).alias("dn"))


def as_pixels(proxy: DataFrame) -> DataFrame:
    return proxy.select(F.col("product_id").alias("tile_id"), F.col("line").alias("row_no"), F.col("sample").alias("col_no"), "dn")


def cube_to_grey(cube: DataFrame, max_nm: float = PROXY_MAX_NM, alpha: float = 0.85, lo: float = 2.0, hi: float = 98.0) -> DataFrame:
    """Band selection, normalised band mean, bad-column repair, destriping and 0..255 stretch."""
    img = cut_lineage(as_pixels(proxy_mean(select_bands(cube, None, max_nm))))  # read again by every step
    fixed = cut_lineage(P.repair_columns(img, P.bad_columns(img)))
    return P.percentile_stretch(P.destripe(fixed, alpha), lo, hi)


def thumbnail(cube: DataFrame, step: int, first: int = 30, last: int = 40) -> DataFrame:
    """Every step-th line and sample of the median over bands `first` to `last` (1-based, values that are not finite left out)."""
    v = F.array_sort(F.filter(F.transform(F.slice("spectrum", first, last - first + 1), finite), lambda x: x.isNotNull()))
    n = F.size(v)
    middle = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    kept = cube.where((F.col("line") % step == 0) & (F.col("sample") % step == 0))
    return kept.select("product_id", F.floor(F.col("line") / step).alias("line"), F.floor(F.col("sample") / step).alias("sample"), middle.alias("dn"))


def nearest_band(bands: DataFrame, nm: float) -> DataFrame:
    """Band closest to a wavelength per product (lower number on ties). Columns product_id, band, wavelength_nm."""
    d = F.abs(F.col("wavelength_nm") - nm)
    return bands.groupBy("product_id").agg(F.min(F.struct(d.alias("d"), "band", "wavelength_nm")).alias("m")).select(
        "product_id", "m.band", "m.wavelength_nm")


def single_band(cube: DataFrame, nm: float) -> DataFrame:
    """Value of the band nearest to a wavelength."""
    order = F.transform("wavelengths", lambda w: F.abs(w - nm))
    return cube.select("product_id", "line", "sample", finite(F.element_at("spectrum", F.array_position(order, F.array_min(order)).cast("int"))).alias("dn"))


def mean_of_bands(cube: DataFrame, nms=(950.0, 1500.0, 1700.0)) -> DataFrame:
    """Mean of destriped single bands, each divided by its own mean."""
    total = None
    for nm in nms:
        b = as_pixels(single_band(cube, nm))
        m = b.groupBy("tile_id").agg((F.avg("dn") + 1e-8).alias("_m"))
        n = b.join(m, "tile_id").withColumn("dn", F.col("dn") / F.col("_m")).drop("_m")
        d = P.destripe(P.repair_columns(n, P.bad_columns(n)))
        total = d if total is None else total.unionByName(d)
    return total.groupBy("tile_id", "row_no", "col_no").agg(F.avg("dn").alias("dn"))


def best_band_window(cube: DataFrame, windows: list[tuple[float, float]], target: DataFrame) -> DataFrame:
    """Wavelength window whose mean image has the largest |Pearson r| with a target (product_id, line, sample, target)."""
    cand = F.array(*[F.struct(F.lit(i).alias("window"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(windows)])
    w = F.col("w")
    inside = F.filter(F.sequence(F.lit(1), F.size("wavelengths")), lambda i: F.element_at("wavelengths", i).between(w["lo"], w["hi"]))
    j = cube.join(target, ["product_id", "line", "sample"]).withColumn("w", F.explode(cand)).withColumn("_i", inside).where(F.size("_i") > 0)
    v = F.aggregate("_i", F.lit(0.0), lambda s, i: s + finite(F.element_at("spectrum", i))) / F.size("_i")
    r = j.select("product_id", "w", "target", v.alias("v")).groupBy("product_id", "w").agg(safe_corr("v", "target").alias("r"))
    return r.groupBy("product_id").agg(F.max(F.struct(F.abs("r").alias("a"), -F.col("w.window"), "w", "r")).alias("m")).select(
        "product_id", F.col("m.w.window").alias("window"), F.col("m.w.lo").alias("lo_nm"), F.col("m.w.hi").alias("hi_nm"), F.col("m.r").alias("r"))


def gram_sums(cube: DataFrame) -> DataFrame:
    """Sums and cross products of spectra per product. Each Arrow batch is reduced in NumPy before any shuffle."""
    def reduce(batches):
        for pdf in batches:
            for pid, g in pdf.groupby("product_id"):
                x = np.nan_to_num(np.vstack(g["spectrum"].to_numpy()).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
                yield pd.DataFrame({"product_id": [pid], "n": [float(len(x))], "d": [x.shape[1]],
                                    "flat": [np.concatenate([x.sum(0), (x.T @ x).ravel()])]})

    part = cube.select("product_id", "spectrum").mapInPandas(reduce, "product_id long, n double, d int, flat array<double>")
    n = part.groupBy("product_id", "d").agg(F.sum("n").alias("n"))
    cells = part.select("product_id", F.posexplode("flat").alias("i", "v")).groupBy("product_id", "i").agg(F.sum("v").alias("v"))
    flat = cells.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("flat"))
    return n.join(flat, "product_id")


def cube_pca(cube: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Principal components of standardised bands per product: (components, scores).

    components: product_id, pc, explained (share of the total variance), loadings. The first component is turned
    so that it correlates positively with the mean image. One aggregated row per product reaches the solver.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            d, n, flat = int(r.d), float(r.n), np.asarray(r.flat)
            mean, xx = flat[:d] / n, flat[d:].reshape(d, d) / n
            cov = xx - np.outer(mean, mean)
            sd = np.sqrt(np.clip(np.diag(cov), 0, None))
            sd[sd == 0] = 1.0
            vals, vecs = np.linalg.eigh(cov / np.outer(sd, sd))
            order = np.argsort(vals)[::-1][:k]
            total = max(vals.sum(), 1e-300)
            for pc, j in enumerate(order):
                v = vecs[:, j]
                s = np.sign(v @ (cov / sd[:, None]).sum(1)) or 1.0
                v = v * (s if pc == 0 else np.sign(v[np.argmax(np.abs(v))]))
                out.append((r.product_id, pc, float(vals[j] / total), (v / sd).tolist(), float(-(mean / sd) @ v)))
        return pd.DataFrame(out, columns=["product_id", "pc", "explained", "loadings", "offset"])

    comp = gram_sums(cube).groupBy("product_id").applyInPandas(
        solve, "product_id long, pc int, explained double, loadings array<double>, offset double")
    dot = F.aggregate(F.zip_with("spectrum", "loadings", lambda v, l: finite(v) * l), F.lit(0.0), lambda s, x: s + x)
    scores = cube.join(comp, "product_id").select("product_id", "line", "sample", "pc", "explained", (dot + F.col("offset")).alias("score"))
    return comp, scores


def pca_proxy(cube: DataFrame, mode: str = "pc1", k: int = 3, albedo: DataFrame | None = None) -> DataFrame:
    """Grey proxy from component scores: first component, variance-weighted sum, or the component that
    correlates best with an albedo image (product_id, line, sample, albedo)."""
    _, scores = cube_pca(cube, k)
    if mode == "pc1":
        return scores.where("pc = 0").select("product_id", "line", "sample", F.col("score").alias("dn"))
    if mode == "weighted":
        return scores.groupBy("product_id", "line", "sample").agg(
            (F.sum(F.col("score") * F.col("explained")) / F.sum("explained")).alias("dn"))
    j = scores.join(albedo, ["product_id", "line", "sample"])
    best = j.groupBy("product_id", "pc").agg(safe_corr("score", "albedo").alias("r")).groupBy("product_id").agg(
        F.max(F.struct(F.abs("r").alias("a"), "pc", "r")).alias("m")).select("product_id", F.col("m.pc").alias("pc"), F.signum("m.r").alias("s"))
    return scores.join(best, ["product_id", "pc"]).select("product_id", "line", "sample", (F.col("score") * F.col("s")).alias("dn"))
