"""Known-truth, property and negative tests of operators that plain SQL does not state, and of skewed groups."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tieline.fixed import CONTROL_ARMS
from tieline.functions import geo as G, transforms as X
from tieline.functions.stats import incomplete_beta
from tieline.operators import catalog as C, controls as N, dataset as D, fitting as M, geometry as Y, matching as J, pixels as P, ranking as R, tiepoints as T, tiles as L


def matches(spark, src, ref, pair=0):
    n = len(src)
    return spark.createDataFrame(pd.DataFrame({
        "pair_id": np.broadcast_to(pair, n).astype("int64"), "match_id": np.arange(n, dtype="int64"), "src_x": src[:, 0], "src_y": src[:, 1],
        "ref_x": ref[:, 0], "ref_y": ref[:, 1]}))


def similarity(p, a=1.02, b=0.05, tx=12.0, ty=-7.0):
    return np.column_stack([a * p[:, 0] - b * p[:, 1] + tx, b * p[:, 0] + a * p[:, 1] + ty])


# --- residuals, sweeps, grids -------------------------------------------------------------------


def test_residual_of_three_four_is_five(spark):
    m = matches(spark, np.array([[10.0, 20], [30, 40]]), np.array([[10.0, 20], [33, 44]]))
    h = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "pair_id long, h array<double>")
    assert [r.residual_px for r in T.with_residuals(m, h).orderBy("match_id").collect()] == [0.0, 5.0]


def test_sweep_counts(spark):
    d = spark.createDataFrame([(0, v) for v in (0.5, 2.5, 4.0, 12.0, 20.0)], "pair_id long, residual_px double")
    got = {r.gate_px: r.n_within_gate for r in T.threshold_sweep(d).collect()}
    assert got[15.0] == 4 and got[1.0] == 1


def test_two_occupied_cells(spark):
    pts = np.array([[5.0, 5], [6, 6], [7, 7], [8, 8], [990, 990], [995, 995]])
    r = T.grid_distribution(matches(spark, pts, pts), 1000.0, 1000.0).first()
    assert r.occupied_cells == 2 and abs(r.cv - 1 / 3) < 1e-12


@pytest.mark.parametrize("inliers,total,ratio,reasons", [(15, 137, 11.0, ["inlier_consensus"]), (25, 100, 25.0, [])])
def test_gate_consensus(spark, inliers, total, ratio, reasons):
    row = spark.createDataFrame([(inliers, total, ratio, 700.0, 1.0, 0.0, 1.0)],
                                "n_inliers long, n_matches long, ratio_pct double, condition double, scale double, rotation_deg double, expected_scale double")
    assert T.flight_gate(row).first().reasons == reasons
    assert T.flight_gate(row, require_delta_shuffle=True).first().reasons[-1] == "missing_delta_shuffle"


def test_delta_shuffle_and_missing_controls(spark):
    rows = [(1, "genuine", 22.58), (1, "rot180", 27.73), (1, "rot90", 3.0)]
    runs = spark.createDataFrame(rows, "run_id long, arm string, ratio_pct double")
    r = N.delta_shuffle(runs).first()
    assert abs(r.delta_shuffle + 5.15) < 1e-9 and r.worst_control == "rot180"
    assert {x.arm for x in N.controls_complete(runs).collect()} == set(CONTROL_ARMS) - {"rot180", "rot90"}


def test_condition_number_matches_svd(spark):
    rng = np.random.default_rng(3)
    hs = [rng.normal(size=(3, 3)) * [1, 1, s] for s in (1.0, 30.0, 1e3)] + [np.eye(3)]
    df = spark.createDataFrame([(i, [float(v) for v in h.ravel()]) for i, h in enumerate(hs)], "i long, h array<double>")
    for r in df.select("i", X.cond3("h").alias("c")).collect():
        assert r.c == pytest.approx(np.linalg.cond(hs[r.i]), rel=1e-6)


def test_published_p_values():
    def p(r, n):
        return float(incomplete_beta([(n - 2) / 2], [0.5], [1 - r * r])[0])

    assert p(0.1955, 49) == pytest.approx(0.1782, abs=2e-3)
    assert p(0.0052, 124) == pytest.approx(0.9547, abs=2e-3)


# --- skewed groups ----------------------------------------------------------------------------------


def skewed(spark, n=6000, seed=0):
    """A third of all rows in one group, and half of that group with one equal value."""
    rng = np.random.default_rng(seed)
    g = np.where(np.arange(n) % 3 == 0, 0, 1 + np.arange(n) % 17)
    v = np.round(rng.normal(size=n) * 50, 3)
    v[(g == 0) & (np.arange(n) % 2 == 0)] = 7.0
    return pd.DataFrame({"g": g.astype("int64"), "id": np.arange(n, dtype="int64"), "v": v})


def odd_groups():
    """Skewed groups beside one of nulls only, one with some nulls and one with a value far from all others."""
    rows = skewed(None)
    n = len(rows)
    extra = [(50, None)] * 4 + [(51, v) for v in (None, 3.0, 1.0, None, 2.0)] + [(52, v) for v in (*range(40), 1e15)]
    return pd.concat([rows, pd.DataFrame({"g": [g for g, _ in extra], "id": n + np.arange(len(extra)), "v": [v for _, v in extra]})], ignore_index=True)


def nullable(spark, pdf):
    return spark.createDataFrame([(int(g), int(i), None if pd.isna(v) else float(v)) for g, i, v in pdf[["g", "id", "v"]].itertuples(index=False)], "g long, id long, v double")


def test_quantiles_of_hot_and_odd_groups(spark):
    pdf = odd_groups()
    got = {r.g: (r.a, r.m, r.z) for r in R.grouped_quantiles(nullable(spark, pdf), ["g"], "v", {"a": 0.05, "m": 0.5, "z": 0.95}).collect()}
    assert got[50] == (None, None, None) and set(got) == set(pdf.g)
    for g, part in pdf[pdf.g != 50].groupby("g"):
        np.testing.assert_allclose(got[g], np.percentile(part.v.dropna(), [5, 50, 95]))
    whole = R.grouped_quantiles(nullable(spark, pdf), [], "v", {"m": 0.5}).first()
    assert whole.m == np.median(pdf.v.dropna())


def test_positions_of_hot_and_odd_groups(spark):
    pdf = odd_groups()
    got = R.dense_index(nullable(spark, pdf), ["g"], "v", "id").toPandas().set_index("id")
    want = pdf.sort_values(["g", "v", "id"], na_position="first").assign(r=lambda d: d.groupby("g").cumcount()).set_index("id")
    assert (got["_rank"].sort_index() == want["r"].sort_index()).all()
    assert (got.groupby("g")["_n"].first() == pdf.groupby("g").size()).all()


def test_a_hot_group_is_spread(spark):
    """No task that orders rows holds a whole group with a third of all rows."""
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id % 50) AS g", "id", "id % 700 * 1.0 AS v").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        parts = R.dense_index(df, ["g"], "v", "id").where("g = 0").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(parts) > 1 and max(r["count"] for r in parts) < 10_400


def test_ks_and_correlation_of_a_hot_group(spark):
    pdf = skewed(spark).assign(first=lambda d: d["id"] % 3 == 1, w=lambda d: d["v"] ** 2 + d["id"] % 7)
    df = spark.createDataFrame(pdf)
    ks = N.ks_2samp(df, "v", "first", ["g"]).toPandas().set_index("g")
    cor = N.correlations(df, "v", "w", ["g"]).toPandas().set_index("g")
    for g, p in pdf.groupby("g"):
        a, b = np.sort(p.v[p["first"]]), np.sort(p.v[~p["first"]])
        if len(a) and len(b):
            at = np.concatenate([a, b])
            assert ks.loc[g, "ks_d"] == pytest.approx(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())
        assert cor.loc[g, "spearman_rho"] == pytest.approx(p.v.rank().corr(p.w.rank()))


def brute_knn(pdf, k):
    out = set()
    for g, p in pdf.groupby("pair_id"):
        xy, ids = p[["src_x", "src_y"]].to_numpy(), p["match_id"].to_numpy()
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        for i in range(len(p)):
            order = np.lexsort((ids, d[i]))[: min(k, len(p) - 1)]
            out |= {(int(g), int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate(order)}
    return out


def test_knn_with_a_crowded_spot(spark):
    rng = np.random.default_rng(5)
    n = 1500
    xy = rng.uniform(0, 1000, (n, 2))
    xy[: n // 3] = 500 + rng.normal(0, 0.01, (n // 3, 2))  # a third of all rows on one spot
    xy[: n // 10] = xy[0]  # exact copies
    pdf = pd.DataFrame({"pair_id": np.where(np.arange(n) % 40 == 0, 1, 0).astype("int64"), "match_id": np.arange(n, dtype="int64"), "src_x": xy[:, 0], "src_y": xy[:, 1]})
    got = {(r.pair_id, r.id, r.neighbour, r["rank"]) for r in J.knn_self(spark.createDataFrame(pdf), 3).collect()}
    assert got == brute_knn(pdf, 3)


def test_thinning_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(8)
    n = 400
    src, ref = rng.uniform(0, 300, (n, 2)), rng.uniform(0, 300, (n, 2))
    src[:120] = 150 + rng.normal(0, 3, (120, 2))
    score = rng.integers(0, 50, n).astype(float)
    m = matches(spark, src, ref).join(spark.createDataFrame(pd.DataFrame({"match_id": np.arange(n), "score": score})), "match_id")
    got = {r.match_id for r in J.spatial_dedup(m, 20.0).collect()}
    kept = []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        if all(np.hypot(*(src[i] - src[j])) > 20 and np.hypot(*(ref[i] - ref[j])) > 20 for j in kept):
            kept.append(i)
    assert got == set(kept)


def test_descriptor_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = np.random.default_rng(2)
    q, r = rng.normal(size=(70, 8)), rng.normal(size=(90, 8))
    def table(x):
        return spark.createDataFrame([(0, i, [float(v) for v in d]) for i, d in enumerate(x)], "pair_id long, kp_id long, descriptor array<double>")
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(-1))
    got = {(x.q_id, x.r_id, x["rank"]) for x in J.descriptor_knn(table(q), table(r), 2).collect()}
    assert got == {(i, int(j), n + 1) for i in range(70) for n, j in enumerate(np.argsort(d[i])[:2])}
    mutual = {(x.q_id, x.r_id) for x in J.mutual_best(table(q), table(r)).collect()}
    assert mutual == {(i, int(d[i].argmin())) for i in range(70) if d[:, d[i].argmin()].argmin() == i}


def test_box_join_equals_brute_force_and_handles_the_seam(spark):
    rng = np.random.default_rng(4)
    def boxes(n, k):
        lat, lon = rng.uniform(-80, 80, n), rng.uniform(0, 360, n)
        return pd.DataFrame({"product_id": np.arange(n) * 2 + k, "min_lat": lat - 2, "max_lat": lat + 2, "min_lon": lon - 3, "max_lon": lon + 3})
    a, b = boxes(150, 0), boxes(150, 1)
    got = {(r.a_id, r.b_id) for r in C.footprint_overlap(spark.createDataFrame(a), spark.createDataFrame(b), 1.7).collect()}
    want = set()
    for x in a.itertuples():
        for y in b.itertuples():
            gap = abs((x.min_lon - y.min_lon + 180) % 360 - 180)
            if abs(x.min_lat - y.min_lat) < 4 and gap < 6:
                want.add((x.product_id, y.product_id))
    assert got == want


@pytest.mark.parametrize("cell", [2.0, "grid"])
def test_crowded_cells_are_divided_and_lose_no_pair(spark, monkeypatch, cell):
    """Small boxes in one cell, some that span many parts, touching ones, copies and null bounds."""
    rng = np.random.default_rng(8)
    def boxes(p, n):
        x, y, h = rng.uniform(0.1, 1.9, n), rng.uniform(0.1, 1.9, n), np.where(np.arange(n) % 40 == 0, 0.4, 0.005)
        x[:30], y[:30], h[:30] = 0.5, 1.5, 0.01
        x[30:40], h[30:40] = np.arange(10) / 8, 1 / 16
        d = pd.DataFrame({f"{p}": np.arange(n), "k": np.arange(n) % 2, "grid": 2.0, f"{p}x0": x - h, f"{p}x1": x + h, f"{p}y0": y - h, f"{p}y1": y + h})
        return d

    a, b = boxes("a", 300), boxes("b", 260)
    want = {(x.a, y.b) for x in a.itertuples() for y in b.itertuples()
            if x.k == y.k and x.ax0 <= y.bx1 and y.bx0 <= x.ax1 and x.ay0 <= y.by1 and y.by0 <= x.ay1}
    stored, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    left, right = spark.createDataFrame(a), spark.createDataFrame(b)
    left = left.unionByName(left.limit(1).withColumn("ax0", F.lit(None).cast("double")))
    dims = [("ax0", "ax1", "bx0", "bx1"), ("ay0", "ay1", "by0", "by1")]
    on, cell = (["k"], cell) if cell == 2.0 else (["k", "grid"], F.col("grid"))
    drop = [] if "grid" in on else ["grid"]
    got = [(r.a, r.b) for r in C.box_join(left.drop(*drop), right.drop(*drop), dims, cell, on, most=400).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hot, rows = [t.count() for t in stored if "ax0" not in t.columns and "bx0" not in t.columns], [t for t in stored if "ax0" in t.columns]
    assert hot[0] == 2 and hot[1] > 2 and hot[-1] == 0
    most = rows[0].groupBy("k", "_c0", "_c1").count().agg(F.max("count")).first()[0]
    assert most < 100


# --- fits --------------------------------------------------------------------------------------------------


TERMS = {"translation": 1, "affine": 3, "poly2": 6, "poly3": 10}


def lattice(nx, ny, step):
    """Nodes of a regular lattice, as a match job leaves them."""
    y, x = np.mgrid[0:ny, 0:nx]
    return np.column_stack([x.ravel() * step + 17.0, y.ravel() * step + 29.0])


@pytest.mark.parametrize("kind", sorted(TERMS))
def test_polynomial_displacements_are_fitted_exactly(spark, kind):
    """Displacements made of the kind's own terms leave no residual, those of the next degree do."""
    src = lattice(9, 14, 61.0)
    u, v = src[:, 0] / 700 - 0.3, src[:, 1] / 900 - 0.6
    powers = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3), (4, 0)]
    def bent(terms):
        return sum(np.outer(u ** i * v ** j, ((-1.7) ** k, 2.3 - k)) for k, (i, j) in enumerate(powers[:terms]))
    def worst(terms):
        m = matches(spark, src, src + bent(terms))
        return M.model_residuals(m, M.fit_model(m, kind), kind).agg(F.max("fit_px")).first()[0]
    assert worst(TERMS[kind]) < 1e-7 < 1e-3 < worst(TERMS[kind] + 1)


def test_similarity_fit_is_exact_for_turned_and_scaled_pairs(spark):
    src = lattice(6, 6, 111.0)
    turned = similarity(src, 0.7, -0.9, 31.0, 8.0)
    m = matches(spark, src, turned)
    assert M.model_residuals(m, M.fit_model(m, "similarity"), "similarity").agg(F.max("fit_px")).first()[0] < 1e-7


@pytest.mark.parametrize("kind,bad_share", [("similarity", 2), ("affine", 4), ("poly2", 5)])
def test_consensus_separates_a_second_motion(spark, kind, bad_share, monkeypatch):
    """Every bad_share-th node of a lattice follows another, smooth motion: the larger motion wins, whole."""
    monkeypatch.setattr(M, "BLOCK", 48)  # several blocks and chunks per pair
    monkeypatch.setattr(M, "CHUNK", 32)
    src = lattice(16, 20, 45.0)
    wobble = 0.3 * np.column_stack([np.sin(src[:, 1]), np.cos(1.7 * src[:, 0])])
    other = np.arange(len(src)) % bad_share == 0 if bad_share > 2 else np.arange(len(src)) % 5 < 2
    ref = np.where(other[:, None], src[::-1] * 0.4 + 900.0, similarity(src, 1.1, -0.03, -25.0, 60.0)) + wobble
    model, pts = M.ransac(matches(spark, src, ref), kind, 1.5, 160)
    inlier = pts.toPandas().set_index("match_id").sort_index()["is_inlier"].to_numpy(bool)
    assert model.count() == 1 and inlier[~other].all() and not inlier[other].any()


def test_consensus_skips_small_groups(spark):
    src = np.array([[0.0, 0], [1, 1], [2, 0]])
    assert M.ransac(matches(spark, src, src), "similarity", 1.0, 20)[0].count() == 0


@pytest.mark.parametrize("scheme", ["spatial_blocks", "stripes", "random_kfold"])
def test_heldout_error_of_a_checkerboard_of_errors(spark, scheme):
    """Errors of +-1 px in x that alternate between neighbours average out of every fold's fit and stay as residual."""
    src = lattice(24, 24, 90.0)
    sign = np.where((np.arange(24)[:, None] + np.arange(24)) % 2, 1.0, -1.0).ravel()
    m = matches(spark, src, src + np.column_stack([8.0 + sign, np.full(len(src), -5.0)]))
    plain, rows = M.heldout(m, "translation", scheme)
    assert rows.count() == len(src) and plain.where("fold IS NULL").first().rmse_within_trim_px == pytest.approx(1.0, abs=0.05)
    robust, rows = M.heldout(m, "translation", scheme, thresh=2.5, iters=40)
    assert rows.count() == len(src) and robust.where("fold IS NULL").first().rmse_within_trim_px == pytest.approx(1.0, abs=0.05)


def test_folds_never_divide_a_stripe(spark):
    src = np.column_stack([np.arange(84) % 7 * 13.0, np.arange(84) * 37.0])
    f = T.assign_folds(matches(spark, src, src), "stripes", 3, 250.0).toPandas().sort_values("src_y")
    stripe = ((f.src_y - f.src_y.min()) // 250).astype(int)
    assert f.groupby(stripe)["fold"].nunique().max() == 1 and f["fold"].nunique() == 3


def strip(n=1500, seed=11):
    rng = np.random.default_rng(seed)
    src = np.column_stack([rng.uniform(0, 300, n), rng.uniform(0, 4000, n)])
    d = np.column_stack([6 * np.sin(src[:, 1] / 600) + src[:, 0] / 100, 3 * np.cos(src[:, 1] / 900)])
    return rng, src, d


def test_spline_follows_along_track_jitter(spark):
    rng, src, d = strip()
    ref = src + d + rng.normal(0, 0.1, src.shape)
    ref[:150] += 60
    _, pts = M.pspline_fit(matches(spark, src, ref), 1.5, 250.0)
    p = pts.toPandas().set_index("match_id").sort_index()
    assert p.is_inlier[150:].mean() > 0.99 and p.is_inlier[:150].mean() < 0.02
    assert np.sqrt((p.fit_px[150:] ** 2).mean()) < 0.25


def test_relief_parallax_is_recovered(spark):
    rng, src, d = strip(seed=12)
    h = rng.uniform(-200, 200, len(src))
    ref = src + d + h[:, None] * np.array([0.02, -0.01]) + rng.normal(0, 0.05, src.shape)
    m = matches(spark, src, ref).join(spark.createDataFrame(pd.DataFrame({"match_id": np.arange(len(src)), "h": h})), "match_id")
    r = M.pspline_fit(m, 1.5, 250.0, relief=True)[0].first()
    assert r.px == pytest.approx(0.02, abs=5e-4) and r.py == pytest.approx(-0.01, abs=5e-4)


# --- tiles ----------------------------------------------------------------------------------------------------


def scene(h=64, w=64, seed=0):
    """Craters on rolling ground: overlapping round bumps of several sizes."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    ground = np.full((h, w), 500.0)
    for radius, count in ((9.0, h * w // 300), (4.0, h * w // 60), (2.0, h * w // 25)):
        for cy, cx, depth in zip(rng.uniform(0, h, count), rng.uniform(0, w, count), rng.uniform(-40, 40, count)):
            dy, dx = np.minimum(abs(y - cy), h - abs(y - cy)), np.minimum(abs(x - cx), w - abs(x - cx))
            ground += depth * np.exp(-(dx * dx + dy * dy) / (2 * radius * radius))
    return ground


def shifted(img, dx, dy):
    fy, fx = np.fft.fftfreq(img.shape[0])[:, None], np.fft.fftfreq(img.shape[1])[None, :]
    return np.fft.ifft2(np.fft.fft2(img) * np.exp(-2j * np.pi * (fx * dx + fy * dy))).real


def tile(spark, img, t=0):
    r, c = np.indices(img.shape)
    return spark.createDataFrame(pd.DataFrame({"tile_id": np.int64(t), "row_no": r.ravel().astype("int64"), "col_no": c.ravel().astype("int64"), "dn": img.ravel()}))


@pytest.mark.parametrize("dx,dy", [(3.0, -2.0), (1.37, 0.62)])
def test_phase_correlation_known_shift(dx, dy):
    a = scene()
    got = L.shift_between(a, shifted(a, dx, dy), lowpass=0.2)
    assert got[0] == pytest.approx(dx, abs=0.1) and got[1] == pytest.approx(dy, abs=0.1)


def test_phase_correlation_beats_its_controls(spark):
    a = scene()
    fixed = tile(spark, a, 0).union(tile(spark, scene(seed=1), 1))
    moving = tile(spark, shifted(a, 2, 1), 0).union(tile(spark, shifted(scene(seed=1), 2, 1), 1))
    runs = L.phase_correlation(fixed, moving, 64, null_draws=6, lowpass=0.2).withColumnRenamed("tile_id", "run_id")
    v = N.verdicts(runs).collect()
    assert len(v) == 2 and all(r.significant and abs(r.dx - 2) < 0.15 and abs(r.dy - 1) < 0.15 for r in v)


def test_node_matching_finds_a_shift(spark):
    a = scene()
    n = L.match_nodes(tile(spark, a), tile(spark, shifted(a, 2, -1)), 64, 8, 6, 4).toPandas()
    ok = n[~n.on_edge & (n.peak > 0.8)]
    assert len(ok) > 5 and np.allclose((ok.ref_x - ok.qx).median(), 2, atol=0.1) and np.allclose((ok.ref_y - ok.qy).median(), -1, atol=0.1)


def test_refinement_moves_matches_to_the_peak(spark):
    a = scene()
    pts = spark.createDataFrame([(0, i, 20.0 + 3 * i, 25.0 + i, 20.0 + 3 * i, 25.0 + i) for i in range(6)], "tile_id long, match_id long, sx double, sy double, rx double, ry double")
    r = L.refine_matches(pts, tile(spark, a), tile(spark, shifted(a, 1.4, -0.6)), 64, 15, method="ncc").toPandas()
    assert r.refined.all() and abs(r.shift_x.mean() - 1.4) < 0.2 and abs(r.shift_y.mean() + 0.6) < 0.2


def test_phase_congruency_range_and_edges(spark):
    img = np.full((64, 64), 10.0)
    img[:, 32:] = 200.0
    p = L.phase_congruency(tile(spark, img), 64).toPandas()
    assert p.pc.between(0, 1).all() and p.moment.between(0, 255).all()
    assert p[p.col_no.between(30, 33)].moment.mean() > p[p.col_no.between(10, 20)].moment.mean()


def test_closure_of_a_good_product_is_small(spark):
    a = scene()
    r = L.closure_check(tile(spark, a), tile(spark, a + 3.0), 64).first()
    assert r.shift_px < 0.05


def test_inverse_map_and_warp(spark):
    a = scene()
    w = L.warp(tile(spark, a), 64, F.lit(1.0), F.lit(0.0), F.lit(3.0), F.lit(2.0)).where("dn IS NOT NULL").toPandas()
    assert all(abs(r.dn - a[r.row_no - 2, r.col_no - 3]) < 1e-9 for r in w.itertuples())


def test_horizon_any_azimuth_agrees_with_the_axis_form(spark):
    dem = tile(spark, scene(32, 32)).withColumnRenamed("dn", "z")
    a = P.horizon_axis(dem, 90, 6).where("max_tan > -1e9").select(*P.KEY, "max_tan").toPandas().set_index(P.KEY).sort_index()
    b = P.horizon(dem, 32, 90.0, 6).where("max_tan > -1e9").toPandas().set_index(P.KEY).sort_index()
    np.testing.assert_allclose(a.max_tan, b.max_tan, atol=1e-6)


def test_shadow_length_at_two_degrees(spark):
    z = np.zeros((4, 64))
    z[:, 40] = 5.0
    s = P.horizon_axis(tile(spark, z).withColumnRenamed("dn", "z"), 90, 40, 5.0).select("row_no", "col_no", P.shadow_mask("max_tan", 2.0).alias("s")).where("s").toPandas()
    reach = 5.0 / np.tan(np.radians(2.0)) / 5.0
    assert s.col_no.min() == 40 - int(reach) and s.col_no.max() == 39


def test_flat_terrain_has_vertical_normals(spark):
    n = P.normals(tile(spark, np.full((8, 8), 3.0)).withColumnRenamed("dn", "z")).toPandas()
    assert (n.nz == 1).all() and (n.nx == 0).all()


def test_halo_rows_come_from_both_neighbours(spark):
    d = tile(spark, np.zeros((8, 8)), 0).union(tile(spark, np.ones((8, 8)), 1)).union(tile(spark, np.full((8, 8), 2.0), 2))
    h = P.with_halo(d, 8, 2).where("tile_id = 1").toPandas()
    assert set(h[h.row_no < 0].dn) == {0.0} and set(h[h.row_no > 7].dn) == {2.0} and len(h) == 12 * 8


# --- geography, labels, files ---------------------------------------------------------------------------------


def test_pole_is_on_the_axis(spark):
    x, y, z = G.latlon_to_xyz(F.lit(90.0), F.lit(0.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), z.alias("z")).first()
    assert abs(r.x) < 1e-9 and abs(r.y) < 1e-9 and abs(r.z - 1737.4) < 1e-9


def test_unknown_instrument_is_an_error(spark):
    with pytest.raises(Exception, match="unknown instrument"):
        spark.range(1).select(G.normalize_instrument(F.lit("HIRISE")).alias("x")).collect()


def test_geometry_without_a_column_is_an_error(spark, tmp_path):
    from tieline.sources import tables as S

    (tmp_path / "g.csv").write_text("Longitude,Latitude,Pixel\n1,2,3\n")
    with pytest.raises(ValueError, match="Scan"):
        S.scan_geometry(spark, str(tmp_path / "g.csv"))


def test_results_json_arrays_and_absent_files(spark, tmp_path):
    from tieline.sources import tables as S

    (tmp_path / "a.json").write_text(json.dumps([{"matcher": "x", "inliers": 3}, {"matcher": "y", "inliers": 5}]))
    d = S.scan_results_json(spark, [str(tmp_path / "a.json"), str(tmp_path / "none.json")], "matcher string, inliers long")
    assert sorted(map(tuple, d.collect())) == [("x", 3), ("y", 5)]


@pytest.mark.parametrize("interleave", ["bsq", "bil"])
def test_cube_source_reads_only_the_asked_lines_and_bands(spark, tmp_path, interleave):
    from tieline.sources import raster

    cube = np.arange(4 * 10 * 3, dtype="<f4").reshape(4, 10, 3)  # band, line, sample
    (cube if interleave == "bsq" else cube.transpose(1, 0, 2)).tofile(tmp_path / "c.qub")
    d = raster.scan_cube(spark, str(tmp_path / "c.qub"), "<f4", 10, 3, 4, interleave, [1, 3]).where("line >= 4 AND line < 6").collect()
    assert {(r.line, r["sample"], tuple(r.spectrum)) for r in d} == {(i, s, (float(cube[1, i, s]), float(cube[3, i, s]))) for i in (4, 5) for s in range(3)}


def test_manifest_change_is_found(spark):
    p = spark.createDataFrame([(i, f"text {i}") for i in range(25)], "pair_id long, payload string")
    m = D.shard_manifest(D.assign_shards(p, 10))
    assert m.count() == 3 and D.verify_manifest(m, m).count() == 0
    changed = D.shard_manifest(D.assign_shards(p.withColumn("payload", F.when(F.col("pair_id") == 12, "x").otherwise(F.col("payload"))), 10))
    assert [r.shard for r in D.verify_manifest(changed, m).collect()] == [1]


def test_lattice_gaps(spark):
    g = spark.createDataFrame([(s, p) for s in range(5) for p in range(4) if (s, p) != (3, 2)], "scan long, pixel long")
    from tieline.operators import geometry as Y

    assert [tuple(r) for r in Y.lattice_gaps(g).collect()] == [(3, 2)]


# --- kernels against plain forms ------------------------------------------------------------------------------


def test_surfaces_equal_the_direct_coefficient():
    rng = np.random.default_rng(6)
    windows, templates = rng.normal(300, 40, (5, 21, 19)), rng.normal(10, 3, (5, 7, 6))
    windows[2, 4:15, 3:16] = 7.0  # a flat part
    got = L.lag_surfaces(windows, templates)
    for k in range(5):
        for i in range(15):
            for j in range(14):
                part = windows[k, i:i + 7, j:j + 6]
                want = np.corrcoef(part.ravel(), templates[k].ravel())[0, 1] if part.std() > 1e-6 else 0.0
                assert got[k, i, j] == pytest.approx(want, abs=1e-8)


def test_peaks_of_surfaces():
    y, x = np.mgrid[0:11, 0:11]
    hill = 1 - 0.01 * ((y - 4.3) ** 2 + (x - 6.2) ** 2)
    ramp = (y + x) / 20.0
    py, px, sy, sx, peak, second, border = L.surface_peaks(np.stack([hill, ramp]), 2)
    assert (py[0], px[0]) == (4, 6) and sy[0] == pytest.approx(0.3) and sx[0] == pytest.approx(0.2) and not border[0]
    assert (py[1], px[1], sy[1], sx[1]) == (10, 10, 0, 0) and border[1] and peak[1] == 1.0 and second[1] == pytest.approx(17 / 20)


def test_penalised_gram_equals_direct_solutions():
    rng = np.random.default_rng(4)
    nb, n = 6, 80
    x, d = rng.normal(size=(n, 3 * nb)), rng.normal(size=(n, 2))
    gram, rhs = x.T @ x, x.T @ d
    second = np.diff(np.eye(nb), n=2, axis=0)
    penalty = np.kron(np.eye(3), second.T @ second)
    pg = M.PenalisedGram(gram, nb)
    scores = []
    for lam in M.LAMBDAS:
        hat = np.linalg.inv(gram + lam * penalty)
        np.testing.assert_allclose(pg.solve(rhs, lam), hat @ rhs, rtol=1e-5, atol=1e-7)
        scores.append(((d - x @ hat @ rhs) ** 2).sum() / (n - np.trace(hat @ gram)) ** 2)
    assert pg.best_lambda(rhs, (d ** 2).sum(), n) == M.LAMBDAS[int(np.argmin(scores))]


def test_a_halo_longer_than_a_tile(spark):
    rows = [(t, r, 0, float(t * 4 + r)) for t in range(6) for r in range(4)]
    got = P.with_halo(spark.createDataFrame(rows, "tile_id long, row_no long, col_no long, dn double"), 4, 9).where("tile_id = 3").collect()
    assert sorted((r.row_no, r.dn) for r in got) == [(r, 12.0 + r) for r in range(-9, 12) if r < 12]


def test_rings_meet_like_a_fine_raster(spark):
    """Overlap of random rings, convex and not, against shared points of a fine grid and crossing edges by hand."""
    rng = np.random.default_rng(10)
    rings = [np.column_stack([c[0] + r * np.cos(t), c[1] + r * np.sin(t)]) for c, r, t in (
        (rng.uniform(0, 10, 2), rng.uniform(1, 4, 4), np.sort(rng.uniform(0, 2 * np.pi, 4))) for _ in range(60))]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)], "i int, r array<struct<x:double,y:double>>")
    pairs = df.selectExpr("i", "r AS a").join(df.selectExpr("i AS j", "r AS b"), F.col("i") < F.col("j"))
    e = pairs.withColumn("ea", C.edges(F.col("a"))).withColumn("eb", C.edges(F.col("b")))
    meet = F.exists("ea", lambda s: F.exists("eb", lambda t: C.edges_meet(s, t)))
    inside = (C.winding(F.element_at("a", 1), F.col("eb")) != 0) | (C.winding(F.element_at("b", 1), F.col("ea")) != 0)
    got = {(r.i, r.j): r.hit for r in e.select("i", "j", (meet | inside).alias("hit")).collect()}
    gx, gy = (g.ravel() for g in np.meshgrid(np.linspace(-5, 15, 400), np.linspace(-5, 15, 400)))
    def covers(ring):
        odd = np.zeros(len(gx), bool)
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0)):
            odd ^= ((y0 > gy) != (y1 > gy)) & (gx < x0 + (gy - y0) * (x1 - x0) / (y1 - y0))
        return odd
    area = [covers(r) for r in rings]
    shared = {(i, j): int((area[i] & area[j]).sum()) for i, j in got}
    assert all(got[k] for k, n in shared.items() if n) and sum(got[k] for k, n in shared.items() if not n) <= 0.05 * len(got)


def test_two_products_at_once_equal_each_alone(spark):
    """Lattice operators with a product key: every product gets the answer it has alone."""
    def lattice(product, lat, lon, step):
        return [(product, i * 10, j * 10, lat + i * step, lon + j * step * 1.1 + i * step / 7) for i in range(14) for j in range(9) if (i, j) != (5, product)]
    cols = "pair_id long, scan long, pixel long, lat double, lon double"
    a = spark.createDataFrame(lattice(1, -20.0, 10.0, 0.011) + lattice(2, -20.05, 10.02, 0.017), cols)
    b = spark.createDataFrame(lattice(1, -19.97, 10.03, 0.008) + lattice(2, -20.0, 10.0, 0.013), cols)
    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    def alone(df, p):
        return df.where(F.col("pair_id") == p).drop("pair_id")
    for many, one in ((lambda k: Y.nearest_geo(b, a, 1.0, k), lambda p: Y.nearest_geo(alone(b, p), alone(a, p), 1.0)),
                      (lambda k: Y.common_region(b, a, 1.0, k), lambda p: Y.common_region(alone(b, p), alone(a, p), 1.0)),
                      (lambda k: Y.lattice_gaps(a, k), lambda p: Y.lattice_gaps(alone(a, p))),
                      (lambda k: Y.native_gsd(a, -19.95, 10.05, 3000.0, k), lambda p: Y.native_gsd(alone(a, p), -19.95, 10.05, 3000.0))):
        assert rows(many(("pair_id",))) == sorted((p, *r) for p in (1, 2) for r in rows(one(p)))
    at = spark.createDataFrame([(p, i, i * 3.5 + 40, i * 2.25 + 20) for p in (1, 2) for i in range(12)], "pair_id long, match_id long, line double, sample double")
    got = L.lattice_interpolate(at, a, 10, 10, ["lat", "lon"], ("pair_id",))
    assert rows(got) == sorted((p, *r) for p in (1, 2) for r in rows(L.lattice_interpolate(alone(at, p), alone(a, p), 10, 10, ["lat", "lon"])))
