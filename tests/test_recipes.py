"""Preprocessing recipes, scale alignment and splines over terrain against NumPy and on odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieline.operators import fitting as M, pixels as P, recipes as R

SIZE = 16


def tiles(spark, image, size=SIZE):
    """Rows of a strip (NaN: no cell)."""
    rows = [(y // size, y % size, x, float(v)) for (y, x), v in np.ndenumerate(image) if not np.isnan(v)]
    return spark.createDataFrame(rows, "tile_id bigint, row_no bigint, col_no bigint, dn double")


def back(df, shape, size=SIZE, value="dn"):
    out = np.full(shape, np.nan)
    for r in df.select(*P.KEY, value).collect():
        out[r[0] * size + r[1], r[2]] = r[3]
    return out


@pytest.fixture(scope="module")
def strip():
    rng = np.random.default_rng(4)
    image = np.floor(rng.random((40, SIZE)) * 40 + np.linspace(0, 200, SIZE))
    image[5, 3] = image[17, 0] = image[30:32, 5:9] = np.nan
    return image


def bilateral(image, sv, ss, flat=None):
    h, w = image.shape
    out = np.full(image.shape, np.nan)
    for y, x in zip(*np.nonzero(~np.isnan(image))):
        seen = [(dy, dx, image[y + dy, x + dx]) for dy in range(-2, 3) for dx in range(-2, 3)
                if 0 <= y + dy < h and 0 <= x + dx < w and not np.isnan(image[y + dy, x + dx])]
        disc = [(math.exp(-(dy * dy + dx * dx) / (2 * ss * ss) - (v - image[y, x]) ** 2 / (2 * sv * sv)), v) for dy, dx, v in seen if dy * dy + dx * dx <= 4]
        f = sum(a * v for a, v in disc) / sum(a for a, _ in disc)
        if flat is not None:
            share = min(1.0, max(0.0, (flat - np.var([v for *_, v in seen])) / flat))
            f = image[y, x] * (1 - share) + f * share
        out[y, x] = f
    return out


def test_denoising_across_tiles_and_gaps(spark, strip):
    df = tiles(spark, strip)
    assert np.allclose(back(R.denoise(df, 30.0, 3.0, size=SIZE), strip.shape), bilateral(strip, 30.0, 3.0), equal_nan=True)
    unit = strip / 255
    got = back(R.denoise_flat(tiles(spark, unit), size=SIZE), strip.shape)
    assert np.allclose(got, bilateral(unit, 0.1, 5.0, 0.005), equal_nan=True)
    assert R.denoise(df.limit(0), 1.0, 1.0).count() == 0


def test_unit_scale(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 1, 10.0), (0, 1, 0, float("nan")), (0, 1, 1, None), (0, 2, 0, 20.0), (1, 0, 0, 7.0)], "tile_id int, row_no int, col_no int, dn double")
    assert [r.dn for r in R.to_unit(df).orderBy(*P.KEY).collect()] == [0.0, 0.5, 0.5, 0.5, 1.0, 0.0]
    assert [r.dn for r in R.to_unit(df, 8).where("tile_id = 1").collect()] == [7 / 255]


@pytest.mark.parametrize("factor", [1, 1.6, 2, 3.3, 16])
def test_area_resize(spark, factor):
    rng = np.random.default_rng(1)
    image = rng.random((SIZE, SIZE))
    to = round(SIZE / factor)
    weight = np.zeros((to, SIZE))
    for i in range(to):
        for k in range(SIZE):
            weight[i, k] = max(0.0, min((i + 1) * SIZE / to, k + 1) - max(i * SIZE / to, k))
    weight /= weight.sum(1, keepdims=True)
    got = back(R.area_resize(tiles(spark, image), SIZE, factor), (to, to), to)
    assert np.allclose(got, weight @ image @ weight.T)


def test_area_resize_refuses_magnification(spark, strip):
    with pytest.raises(ValueError):
        R.area_resize(tiles(spark, strip), SIZE, 0.5)
    with pytest.raises(ValueError):
        R.area_resize(tiles(spark, strip), SIZE, 40)


@pytest.mark.parametrize("recipe", [R.ohrc_base, R.tmc2_base, R.ohrc_calibrated, R.tmc2_calibrated, R.iirs_calibrated, R.compact])
def test_recipes_keep_every_cell(spark, strip, recipe):
    strip = strip.copy()
    strip[32:] = 9.0  # a flat tile
    df = tiles(spark, strip).withColumn("_q", F.lit("clash")).withColumn("clip", F.lit(1))
    image, report = recipe(df, SIZE)
    out = back(image, strip.shape)
    assert (np.isnan(out) == np.isnan(strip)).all() and np.nanmin(out) >= 0 and np.nanmax(out) <= (255 if recipe is R.compact else 1)
    rows = report.orderBy("tile_id").collect()
    assert [r.tile_id for r in rows] == [0, 1, 2] and all(r.steps for r in rows)
    empty = recipe(df.limit(0), SIZE)
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_clip_limit_follows_the_counts(spark):
    rng = np.random.default_rng(2)
    dim, dark, plain = 100 + rng.random((SIZE, SIZE)) * 20, rng.random((SIZE, SIZE)) * 200, rng.random((SIZE, SIZE)) * 200 + 20
    dark[:8] = 3
    _, report = R.ohrc_calibrated(tiles(spark, np.floor(np.vstack([dim, dark, plain]))), SIZE)
    assert [r.clip_limit for r in report.orderBy("tile_id").collect()] == [6.0, 4.5, 3.0]


def test_align_scales(spark):
    image = np.tile(np.arange(SIZE, dtype=float), (SIZE, 1))
    fine, coarse = R.align_scales(tiles(spark, image), tiles(spark, image), SIZE, 0.3, upsample=3)
    assert {r.scale for r in fine.collect()} == {0.25} and fine.count() == 16
    got = back(coarse, (3 * SIZE, 3 * SIZE), 3 * SIZE)
    assert np.allclose(got, np.tile(np.clip((np.arange(3 * SIZE) + 0.5) / 3 - 0.5, 0, SIZE - 1), (3 * SIZE, 1)))
    assert {r.scale for r in R.align_scales(tiles(spark, image), tiles(spark, image), SIZE, 0.01)[0].collect()} == {0.25}  # no level below 4 cells
    with pytest.raises(ValueError):
        R.align_scales(fine, coarse, SIZE, 2.0)


# ---- splines

@pytest.fixture(scope="module")
def lattice_pairs(spark):
    """Two pairs on the same lattice of positions with different displacements: 2 and -3 px along x, bent along y."""
    rows = [(p, 1000 * p + i, float(x), float(y), x + s + y * y / 2000, y - s + y / 50, float((x * 7 + y * 3) % 50))
            for p, s in ((1, 2.0), (2, -3.0)) for i, (x, y) in enumerate((x, y) for y in range(0, 60, 4) for x in range(0, 40, 5))]
    return spark.createDataFrame(rows, "pair_id bigint, match_id bigint, src_x double, src_y double, ref_x double, ref_y double, h double")


def test_pairs_on_one_lattice_keep_their_models(lattice_pairs):
    model, points = M.pspline_fit(lattice_pairs.drop("h"), 1.0, 20.0)
    assert points.where("is_inlier").count() == lattice_pairs.count()
    out = M.predict_spline(lattice_pairs.drop("h"), model).collect()
    assert len(out) == lattice_pairs.count() and max(math.hypot(r.pred_x - r.ref_x, r.pred_y - r.ref_y) for r in out) < 0.05
    there = lattice_pairs.drop("h").withColumnsRenamed({"ref_x": "map_x", "ref_y": "map_y"})
    home = M.inverse_spline(there, model).collect()
    assert all(r.converged for r in home) and max(math.hypot(r.inv_x - r.src_x, r.inv_y - r.src_y) for r in home) < 0.05


def test_heights_are_looked_up(spark, lattice_pairs):
    lifted = lattice_pairs.withColumn("ref_x", F.col("ref_x") + 0.1 * F.col("h"))
    model, _ = M.pspline_fit(lifted, 1.0, 20.0, relief=True)
    known = M.predict_spline(lifted, model).collect()
    assert max(math.hypot(r.pred_x - r.ref_x, r.pred_y - r.ref_y) for r in known) < 0.1
    h0 = {r.pair_id: r.h0 for r in model.collect()}
    px = {r.pair_id: r.px for r in model.collect()}
    flat = spark.createDataFrame([(t, r, c, 30.0) for t in (0,) for r in range(-10, 90) for c in range(-10, 70)], "tile_id bigint, row_no bigint, col_no bigint, z double")
    points = lifted.drop("h").withColumn("tile_id", F.lit(0).cast("bigint"))
    base = {r.match_id: r.pred_x for r in M.predict_spline(points, model).collect()}
    on_flat = M.predict_spline(points, model, dem=flat).collect()
    assert all(math.isclose(r.pred_x, base[r.match_id] + (30.0 - h0[r.pair_id]) * px[r.pair_id], abs_tol=1e-9) for r in on_flat)
    outside = M.predict_spline(points.withColumn("tile_id", F.lit(5).cast("bigint")), model, dem=flat).collect()
    assert all(math.isclose(r.pred_x, base[r.match_id], abs_tol=1e-9) for r in outside) and len(outside) == len(base)
    assert M.predict_spline(points.limit(0), model, dem=flat).count() == 0
