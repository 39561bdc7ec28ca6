"""Model fits for many pairs at once: polynomial maps, seeded consensus, held-out validation, along-track splines.

Fits read mergeable moment sums: a hot pair is summed map-side and only one small row per group reaches a
solver. Models map source (x, y) to a displacement in coordinates centred and scaled per pair.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tieline.fixed import MIN_SAMPLES
from tieline.operators.pixels import sample_raster
from tieline.operators.ranking import dense_index, grouped_quantiles
from tieline.operators.tiepoints import assign_folds, hash_order, heldout_summary
from tieline.session import by_size, cut_lineage, spread

# exponents of u and v, lower degrees first
TERMS = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]
N_TERMS = {"translation": 1, "affine": 3, "poly2": 6, "poly3": 10}
BLOCK = 4096
CHUNK = 250


def frame(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and RMS scale of the source points of a group."""
    s = F.sqrt(F.var_pop("src_x") + F.var_pop("src_y"))
    return matches.groupBy(*keys).agg(F.avg("src_x").alias("cx"), F.avg("src_y").alias("cy"), F.when(s > 0, s).otherwise(1.0).alias("scale"),
                                      F.count(F.lit(1)).alias("n_all"))


def _uv(df: DataFrame) -> DataFrame:
    return (df.withColumn("_u", (F.col("src_x") - F.col("cx")) / F.col("scale")).withColumn("_v", (F.col("src_y") - F.col("cy")) / F.col("scale"))
            .withColumn("_dx", F.col("ref_x") - F.col("src_x")).withColumn("_dy", F.col("ref_y") - F.col("src_y")))


def _mono(i: int, j: int) -> Column:
    c = F.lit(1.0)
    for _ in range(i):
        c = c * F.col("_u")
    for _ in range(j):
        c = c * F.col("_v")
    return c


def _exponents(kind: str):
    terms = [(0, 0), (1, 0), (0, 1)] if kind == "similarity" else TERMS[: N_TERMS[kind]]
    pairs = sorted({(a + c, b + d) for a, b in terms for c, d in terms}, key=lambda e: (e[0] + e[1], -e[0]))
    return terms, pairs


def moments(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Moment sums of a group: `m` (powers), `mx`, `my` (powers times displacement), `n_used`."""
    terms, pairs = _exponents(kind)
    named = [F.sum(_mono(i, j)).alias(f"m{i}{j}") for i, j in pairs]
    named += [F.sum(_mono(i, j) * F.col(f"_d{a}")).alias(f"d{a}{i}{j}") for a in "xy" for i, j in terms]
    agg = rows.groupBy(*keys).agg(*named)
    return agg.select(*keys, F.array(*[f"m{i}{j}" for i, j in pairs]).alias("m"), F.array(*[f"dx{i}{j}" for i, j in terms]).alias("mx"),
                      F.array(*[f"dy{i}{j}" for i, j in terms]).alias("my"), F.col("m00").cast("bigint").alias("n_used"))


def _solved(kind: str, mm: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Coefficients of moment rows (x terms then y terms; a, b, tx, ty for similarity)."""
    terms, pairs = _exponents(kind)
    at = {e: n for n, e in enumerate(pairs)}
    if kind == "similarity":
        n, su, sv, q = mm[:, at[(0, 0)]], mm[:, at[(1, 0)]], mm[:, at[(0, 1)]], mm[:, at[(2, 0)]] + mm[:, at[(0, 2)]]
        z = np.zeros_like(n)
        a = np.stack([np.stack([q, z, su, sv], -1), np.stack([z, q, -sv, su], -1), np.stack([su, -sv, n, z], -1), np.stack([sv, su, z, n], -1)], 1)
        b = np.stack([bx[:, 1] + by[:, 2], by[:, 1] - bx[:, 2], bx[:, 0], by[:, 0]], -1)[..., None]
    else:
        k = len(terms)
        a = np.empty((len(mm), k, k))
        for i, s in enumerate(terms):
            for j, t in enumerate(terms):
                a[:, i, j] = mm[:, at[(s[0] + t[0], s[1] + t[1])]]
        b = np.stack([bx, by], -1)
    try:
        c = np.linalg.solve(a, b)
        bad = ~np.isfinite(c).all(axis=(1, 2))
    except np.linalg.LinAlgError:
        c, bad = np.zeros_like(b), np.ones(len(a), bool)
    if bad.any():
        c[bad] = np.linalg.pinv(a[bad], hermitian=True) @ b[bad]
    return c[:, :, 0] if kind == "similarity" else np.concatenate([c[:, :, 0], c[:, :, 1]], 1)


def _solve(kind: str):
    """Vectorised solver over moment rows."""
    @F.pandas_udf("array<double>")
    def run(m: pd.Series, mx: pd.Series, my: pd.Series) -> pd.Series:
        if len(m) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(_solved(kind, np.vstack(m), np.vstack(mx), np.vstack(my))))

    return run


def solve_moments(mom: DataFrame, kind: str) -> DataFrame:
    if kind == "translation":
        return mom.withColumn("coef", F.array(F.col("mx")[0] / F.col("m")[0], F.col("my")[0] / F.col("m")[0])).drop("m", "mx", "my")
    return mom.withColumn("coef", _solve(kind)("m", "mx", "my")).drop("m", "mx", "my")


def fit_model(matches: DataFrame, kind: str, keys=("pair_id",)) -> DataFrame:
    """Least-squares displacement model per group: cx, cy, scale, n_used, coef."""
    keys = list(keys)
    fr = frame(matches, keys)
    return fr.join(solve_moments(moments(_uv(matches.join(fr, keys)), keys, kind), kind), keys).withColumn("kind", F.lit(kind))


def predict(points: DataFrame, model: DataFrame, kind: str, keys=("pair_id",)) -> DataFrame:
    """Add pred_x, pred_y."""
    keys = list(keys)
    j = points.join(model.select(*keys, "cx", "cy", "scale", "coef"), keys)
    u, v, c = (F.col("src_x") - F.col("cx")) / F.col("scale"), (F.col("src_y") - F.col("cy")) / F.col("scale"), F.col("coef")
    if kind == "similarity":
        dx, dy = c[0] * u - c[1] * v + c[2], c[1] * u + c[0] * v + c[3]
    else:
        j = j.withColumn("_u", u).withColumn("_v", v)
        n = N_TERMS[kind]
        t = F.array(*[_mono(i, jj) for i, jj in TERMS[:n]])
        j = j.withColumn("_t", t)
        def dot(start):
            return F.aggregate(F.zip_with("_t", F.slice("coef", start, n), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        dx, dy = dot(1), dot(n + 1)
    out = j.withColumn("pred_x", F.col("src_x") + dx).withColumn("pred_y", F.col("src_y") + dy)
    return out.drop("cx", "cy", "scale", "coef", "_u", "_v", "_t")


def model_residuals(points: DataFrame, model: DataFrame, kind: str, keys=("pair_id",), out: str = "fit_px") -> DataFrame:
    p = predict(points, model, kind, keys)
    ex, ey = F.col("pred_x") - F.col("ref_x"), F.col("pred_y") - F.col("ref_y")
    return p.withColumn(out, F.sqrt(ex * ex + ey * ey)).drop("pred_x", "pred_y")


# --- seeded consensus -------------------------------------------------------------------------------

def hypotheses(fr: DataFrame, keys: list[str], k: int, iters: int, seed) -> DataFrame:
    """k distinct point positions per iteration, drawn without replacement from a hash of (seed, iteration, draw)."""
    def draw(it):
        def add(acc, j):
            r = hash_order(seed, it, j) % (F.col("n_all") - j)
            shifted = F.aggregate(F.array_sort(acc), r, lambda v, p: v + (p <= v).cast("bigint"))
            return F.concat(acc, F.array(shifted))
        return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.expr("cast(array() as array<bigint>)"), add)

    it = fr.where(F.col("n_all") >= 2 * k).withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
    return it.select(*keys, "it", F.posexplode(draw(F.col("it"))).alias("draw", "_rank"))


def _sample_fits(kind: str, U: np.ndarray, V: np.ndarray, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Exact fit of each minimal sample (one a row, in drawing order)."""
    if kind == "translation":
        return np.concatenate([X, Y], 1)
    if kind == "similarity":
        z, w = (U[:, 1] - U[:, 0]) + 1j * (V[:, 1] - V[:, 0]), (X[:, 1] - X[:, 0]) + 1j * (Y[:, 1] - Y[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            s = w / z
        s = np.where(np.isfinite(s), s, 0)
        t = X[:, 0] + 1j * Y[:, 0] - s * (U[:, 0] + 1j * V[:, 0])
        return np.stack([s.real, s.imag, t.real, t.imag], 1)
    T = np.stack([U ** i * V ** j for i, j in TERMS[: N_TERMS[kind]]], -1)
    c = np.linalg.pinv(T) @ np.stack([X, Y], -1)
    return np.concatenate([c[:, :, 0], c[:, :, 1]], 1)


def _fit_samples(kind: str):
    @F.pandas_udf("array<double>")
    def run(u: pd.Series, v: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
        if len(u) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(_sample_fits(kind, *(np.vstack(s) for s in (u, v, dx, dy)))))

    return run


def _displaced(kind: str, C: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of every point (a, b) under every model of C."""
    if kind == "similarity":
        return C[:, :1] * a - C[:, 1:2] * b + C[:, 2:3], C[:, 1:2] * a + C[:, :1] * b + C[:, 3:4]
    T = np.stack([a ** i * b ** j for i, j in TERMS[: N_TERMS[kind]]])
    return C[:, :len(T)] @ T, C[:, len(T):] @ T


def _count_inliers(kind: str):
    """Inliers of each hypothesis of a chunk among the points of a block (one NumPy pass per pair of rows)."""
    @F.pandas_udf("array<bigint>")
    def run(u: pd.Series, v: pd.Series, dx: pd.Series, dy: pd.Series, coefs: pd.Series, thresh: pd.Series) -> pd.Series:
        out = []
        for a, b, x, y, cs, t in zip(u, v, dx, dy, coefs, thresh):
            a, b, x, y, C = np.asarray(a), np.asarray(b), np.asarray(x), np.asarray(y), np.vstack(cs)
            px, py = _displaced(kind, C, a, b)
            out.append((((px - x) ** 2 + (py - y) ** 2) < t * t).sum(1))
        return pd.Series(out)

    return run


@lru_cache(maxsize=16)
def _draws(seed: str, iters: int, k: int) -> np.ndarray:
    """hash_order of (seed, iteration, draw) for every iteration and draw."""
    return np.array([[int(md5(f"{seed}:{it}:{j}".encode()).hexdigest()[:8], 16) for j in range(k)] for it in range(iters)], dtype=np.int64)


def _samples(seed: str, iters: int, k: int, n: int) -> np.ndarray:
    """The point positions of `hypotheses` for a group of n rows, one sample a row."""
    drawn = np.empty((iters, 0), np.int64)
    for j in range(k):
        at = _draws(seed, iters, k)[:, j] % (n - j)
        for p in np.sort(drawn, 1).T:
            at = at + (p <= at)
        drawn = np.column_stack([drawn, at])
    return drawn


def _centre(v: np.ndarray) -> tuple[float, float]:
    """Mean and variance of the values there are; equal values have no variance at all."""
    v = v[~np.isnan(v)]
    if not len(v):
        return np.nan, np.nan
    mean = v[0] + np.mean(v - v[0])
    return float(mean), float(np.mean((v - mean) ** 2))


def _consensus(kind: str, x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, thr: np.ndarray, iters: int, seed: str, place) -> tuple | None:
    """One group, its rows in the order of their ids: (cx, cy, scale, n_used, coefficients), or None without consensus."""
    k, n = MIN_SAMPLES[kind], len(x)
    if n < 2 * k:
        return None
    if place is None:
        (cx, sx), (cy, sy) = _centre(x), _centre(y)
        s = np.sqrt(sx + sy)
        place = cx, cy, float(s) if s > 0 else 1.0
    cx, cy, scale = place
    a, b, dx, dy = (x - cx) / scale, (y - cy) / scale, u - x, v - y
    at = _samples(seed, iters, k, n)
    known = ~np.isnan(np.stack([a, b, dx, dy])).any(0)
    its = np.nonzero(known[at].all(1))[0]  # a sample with an unknown point has no inlier
    if not len(its):
        return None
    C = _sample_fits(kind, *(c[at[its]] for c in (a, b, dx, dy)))
    x, y, u, v, a, b, dx, dy, thr = (c[known] for c in (x, y, u, v, a, b, dx, dy, thr))
    most = thr.max()
    votes = np.concatenate([(((px - dx) ** 2 + (py - dy) ** 2) < most * most).sum(1) for part in range(0, len(C), CHUNK) for px, py in [_displaced(kind, C[part:part + CHUNK], a, b)]])
    if votes.max() < k:
        return None
    coef = C[np.argmax(votes)]
    terms, pairs = _exponents(kind)
    for _ in range(2):
        px, py = _displaced(kind, coef[None], a, b)
        near = np.hypot(x + px[0] - u, y + py[0] - v) < thr
        if not near.any():
            return None
        power = {e: a[near] ** e[0] * b[near] ** e[1] for e in pairs}
        coef = _solved(kind, np.array([[power[e].sum() for e in pairs]]), *(np.array([[(power[e] * d[near]).sum() for e in terms]]) for d in (dx, dy)))[0]
    return cx, cy, scale, int(near.sum()), coef.tolist()


def _ransac_small(matches: DataFrame, kind: str, lim: Column, iters: int, seed, keys: list[str], frames: DataFrame | None) -> DataFrame:
    """Models of groups of at most BLOCK rows: a group is one bounded row and goes from samples to the last refit inside one task."""
    values = ["src_x", "src_y", "ref_x", "ref_y"]
    rows = spread(matches.select(*keys, "match_id", *[F.col(c).cast("double").alias(c) for c in values], lim.alias("thr")), *keys)
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("match_id", *values, "thr"))).alias("p")).select(*keys, *[F.col(f"p.{c}").alias(c) for c in (*values, "thr")])
    framed = frames is not None
    if framed:
        groups = groups.join(frames.select(*keys, "cx", "cy", "scale"), keys)
    named = [*keys, "cx", "cy", "scale", "n_all", "n_used", "coef"]
    ks = ", ".join(f"{k} {matches.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                cols = [np.asarray(getattr(r, c), float) for c in (*values, "thr")]
                found = _consensus(kind, *cols, iters, str(seed), (r.cx, r.cy, r.scale) if framed else None)
                if found is not None:
                    out.append((*[getattr(r, k) for k in keys], *found[:3], len(cols[0]), *found[3:]))
            yield pd.DataFrame(out, columns=named)

    return groups.mapInPandas(run, f"{ks}, cx double, cy double, scale double, n_all long, n_used long, coef array<double>")


def _ransac_large(matches: DataFrame, kind: str, lim: Column, iters: int, seed, keys: list[str], frames: DataFrame | None) -> DataFrame:
    """Models of groups of many blocks. Points are scored in blocks of a few thousand rows against chunks of hypotheses, so
    rows are never multiplied by the number of iterations and one huge pair is scored by many tasks."""
    k = MIN_SAMPLES[kind]
    fr = frames if frames is not None else frame(matches, keys)
    counts = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"))
    fr = fr.drop("n_all").join(counts, keys)
    idx = cut_lineage(_uv(dense_index(matches.join(fr.drop("n_all"), keys), keys, "match_id")).withColumn("_thr", lim))
    hyp = hypotheses(fr, keys, k, iters, seed)
    arr = lambda c: F.transform(F.array_sort("s"), lambda x: x[c])
    samples = hyp.join(idx.select(*keys, "_rank", "_u", "_v", "_dx", "_dy"), [*keys, "_rank"]).groupBy(*keys, "it").agg(
        F.collect_list(F.struct("draw", "_u", "_v", "_dx", "_dy")).alias("s"))
    fits = cut_lineage(samples.select(*keys, "it", _fit_samples(kind)(arr("_u"), arr("_v"), arr("_dx"), arr("_dy")).alias("coef")))
    blocks = idx.groupBy(*keys, F.floor(F.col("_rank") / BLOCK).alias("_blk")).agg(
        *[F.collect_list(c).alias(c) for c in ("_u", "_v", "_dx", "_dy")], F.max("_thr").alias("_thr"))
    chunks = fits.groupBy(*keys, F.floor(F.col("it") / CHUNK).alias("_chk")).agg(F.array_sort(F.collect_list(F.struct("it", "coef"))).alias("h"))
    scored = spread(blocks.join(chunks, keys), *keys, "_blk", "_chk").select(*keys, F.transform("h", lambda x: x["it"]).alias("its"), _count_inliers(kind)(
        "_u", "_v", "_dx", "_dy", F.transform("h", lambda x: x["coef"]), "_thr").alias("cnt"))
    votes = scored.select(*keys, F.explode(F.arrays_zip("its", "cnt")).alias("z")).groupBy(*keys, F.col("z.its").alias("it")).agg(F.sum("z.cnt").alias("votes"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("votes", -F.col("it"))).alias("b")).where(F.col("b.votes") >= k).select(*keys, (-F.col("b.col2")).alias("it"))
    model = fits.join(best, [*keys, "it"]).drop("it").join(fr, keys)
    for _ in range(2):
        r = _refit_rows(idx, model, kind, keys)
        model = fr.join(solve_moments(moments(r.where(F.col("fit_px") < F.col("_thr")), keys, kind), kind), keys)
    return model


def ransac(matches: DataFrame, kind: str = "similarity", thresh: float = 15.0, iters: int = 300, seed=42, keys=("pair_id",),
           frames: DataFrame | None = None, points: DataFrame | None = None, thresh_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeded consensus per group: (model, points). The best hypothesis (first on ties) is refitted by least
    squares, inliers are recomputed once and refitted. Points carry fit_px and is_inlier (strict <).

    A group of at most BLOCK rows is fitted inside one task, with the same samples as a larger one. `points` may name
    other rows to evaluate (held-out validation).
    """
    keys = list(keys)
    lim = F.col(thresh_col) if thresh_col else F.lit(float(thresh))
    small, large = by_size(matches, keys, BLOCK)
    model = _ransac_small(small, kind, lim, iters, seed, keys, frames)
    if large is not None:
        model = model.unionByName(_ransac_large(large, kind, lim, iters, seed, keys, frames).select(*model.columns))
    model = cut_lineage(model.withColumn("kind", F.lit(kind)))
    target = points if points is not None else matches
    res = model_residuals(target, model, kind, keys)
    return model, res.withColumn("is_inlier", F.col("fit_px") < lim)


def _refit_rows(idx: DataFrame, model: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    return _uv(model_residuals(idx.drop("cx", "cy", "scale"), model, kind, keys).join(model.select(*keys, "cx", "cy", "scale"), keys))


def ransac_sweep(nodes: DataFrame, thresholds: list[float], kind: str = "similarity", iters: int = 300, seed=42) -> DataFrame:
    """Inliers, ratio, RMSE and recovered scale/rotation per threshold; all thresholds run as one job."""
    rows = nodes.withColumn("gate_px", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    model, pts = ransac(rows, kind, iters=iters, seed=seed, keys=("pair_id", "gate_px"), thresh_col="gate_px")
    inl = F.when(F.col("is_inlier"), F.col("fit_px"))
    agg = pts.groupBy("pair_id", "gate_px").agg(F.count(F.lit(1)).alias("n_matches"), F.count(inl).alias("n_inliers"), F.sqrt(F.avg(inl * inl)).alias("rmse_px"))
    a, b = 1 + F.col("coef")[0] / F.col("scale"), F.col("coef")[1] / F.col("scale")
    return agg.join(model.select("pair_id", "gate_px", F.sqrt(a * a + b * b).alias("fit_scale"), F.degrees(F.atan2(b, a)).alias("rotation_deg")), ["pair_id", "gate_px"])


# --- held-out validation -----------------------------------------------------------------------------

def heldout(matches: DataFrame, kind: str, scheme: str, k: int = 5, trim: float = 3.0, thresh: float | None = None, iters: int = 200,
            seed=42, stripe_px: float = 500.0, knot_px: float = 250.0, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Residuals of matches under a model that never saw their fold: (summary, rows).

    Without `thresh` the training fit is plain least squares: moments of the other folds are the group's total
    minus the fold's own, so no row is repeated. With `thresh` each training set is fitted by `ransac`. The spline
    kinds `pspline` and `pspline_relief` (the latter needs column `h`) are fitted on the other folds over the pair's
    whole domain. Each fold's training set is a group of its own there, so rows are repeated k - 1 times.

    The summary has one row per pair and fold and one per pair (fold null); `status` is `fit_failed` where the
    training points were too few for the kind, and the numbers are then null.
    """
    folded = cut_lineage(assign_folds(matches, scheme, k, stripe_px, seed))
    fr = frame(folded, ["pair_id"])
    if kind.startswith("pspline"):
        others = folded.withColumn("_f", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))))
        folds = folded.select("pair_id", "fold").distinct()
        whole = folded.groupBy("pair_id").agg(F.min("src_y").alias("v0"), F.max("src_y").alias("v1"), F.avg("src_x").alias("uc"),
                                              F.when(F.stddev_pop("src_x") > 0, F.stddev_pop("src_x")).otherwise(1.0).alias("us"))
        train = others.drop("fold").withColumnRenamed("_f", "fold")
        _, rows = pspline_fit(train, thresh or float("inf"), knot_px, ("pair_id", "fold"), rounds, kind == "pspline_relief", folds.join(whole, "pair_id"), folded)
        rows = rows.withColumnRenamed("fit_px", "heldout_px").drop("is_inlier")
    elif thresh is None:
        mom = moments(_uv(folded.join(fr, "pair_id")), ["pair_id", "fold"], kind)
        flat = mom.select("pair_id", "fold", F.concat("m", "mx", "my").alias("f"), F.size("m").alias("a"), F.size("mx").alias("b"))
        total = flat.select("pair_id", F.posexplode("f").alias("i", "x")).groupBy("pair_id", "i").agg(F.sum("x").alias("x")).groupBy("pair_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("t"))
        rest = flat.join(total, "pair_id").withColumn("r", F.zip_with("t", "f", lambda x, y: x - y))
        train = rest.select("pair_id", "fold", F.expr("slice(r, 1, a)").alias("m"), F.expr("slice(r, a + 1, b)").alias("mx"),
                            F.expr("slice(r, a + b + 1, b)").alias("my"), F.expr("cast(r[0] as bigint)").alias("n_used"))
        model = solve_moments(train.where(F.col("n_used") >= MIN_SAMPLES[kind]), kind).join(fr, "pair_id")
        rows = model_residuals(folded, model, kind, ["pair_id", "fold"], "heldout_px")
    else:
        others = folded.withColumn("_f", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))))
        train = others.drop("fold").withColumnRenamed("_f", "fold")
        frames = folded.select("pair_id", "fold").distinct().join(fr, "pair_id")
        _, rows = ransac(train, kind, thresh, iters, seed, ("pair_id", "fold"), frames, folded)
        rows = rows.withColumnRenamed("fit_px", "heldout_px").drop("is_inlier")
    folds = folded.select("pair_id", F.col("fold").cast("int").alias("fold")).distinct()
    per_fold = folds.join(heldout_summary(rows, ["pair_id", "fold"], trim), ["pair_id", "fold"], "left")
    overall = folds.select("pair_id").distinct().join(heldout_summary(rows, ["pair_id"], trim), "pair_id", "left").withColumn("fold", F.lit(None).cast("int"))
    status = F.when(F.col("n_heldout") > 0, "ok").otherwise("fit_failed")
    return per_fold.unionByName(overall).withColumn("status", status), rows


# --- along-track penalised splines --------------------------------------------------------------------

def _basis(v: np.ndarray, v0, v1, nseg: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and the four cubic B-spline values at v on nseg uniform segments with clamped ends. The ends are numbers
    or one number per value."""
    v0, v1 = np.broadcast_to(np.asarray(v0, float), v.shape), np.broadcast_to(np.asarray(v1, float), v.shape)
    step = (v1 - v0) / nseg

    def knot(k):
        at = np.clip(k - 3, 0, nseg)
        return np.where(at == nseg, v1, v0 + at * step)

    v = np.minimum(np.maximum(v, v0), v1 - 1e-9 * np.maximum(np.abs(v1), 1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        span = np.where(step > 0, np.floor((v - v0) / step), 0.0)
    span = np.clip(np.nan_to_num(span), 0, nseg - 1).astype(int)
    span = np.clip(span + (knot(span + 4) <= v) - (knot(span + 3) > v), 0, nseg - 1)
    vals = np.zeros((len(v), 4))
    vals[:, 0] = 1.0
    left, right = np.zeros((len(v), 4)), np.zeros((len(v), 4))
    for d in range(1, 4):
        left[:, d], right[:, d] = v - knot(span + 4 - d), knot(span + 3 + d) - v
        saved = np.zeros(len(v))
        for r in range(d):
            t = vals[:, r] / np.maximum(right[:, r + 1] + left[:, d - r], 1e-300)
            vals[:, r] = saved + right[:, r + 1] * t
            saved = left[:, d - r] * t
        vals[:, d] = saved
    return span, vals


def _design(x: np.ndarray, y: np.ndarray, hc: np.ndarray, v0: float, v1: float, nseg: int, uc: float, us: float) -> np.ndarray:
    """Columns: three blocks of nseg + 3 splines (times 1, u, u^2) and, last, height minus the reference height."""
    first, vals = _basis(y, v0, v1, nseg)
    u, nb, rows = (x - uc) / us, nseg + 3, np.arange(len(y))
    out = np.zeros((len(y), 3 * nb + 1))
    for j in range(4):
        for b, w in enumerate((1.0, u, u * u)):
            out[rows, b * nb + first + j] = vals[:, j] * w
    out[:, -1] = hc
    return out


LAMBDAS = 10.0 ** np.arange(-3, 4)


@lru_cache(maxsize=64)
def _penalty(nb: int) -> np.ndarray:
    rough = np.diff(np.eye(nb), n=2, axis=0)
    return np.kron(np.eye(3), rough.T @ rough)


class PenalisedGram:
    """Least squares from Gram sums with a second-difference penalty on each of three coefficient blocks.

    Gram matrix and penalty are diagonalised together once, so every lambda costs a division: in the joint basis the
    Gram matrix is the identity and the penalty diagonal."""

    def __init__(self, gram: np.ndarray, nb: int):
        root = np.linalg.cholesky(gram + 1e-9 * max(np.trace(gram) / len(gram), 1.0) * np.eye(len(gram)))
        half = np.linalg.solve(root, _penalty(nb))
        self.rough, turn = np.linalg.eigh(np.linalg.solve(root, half.T))
        self.rough = np.maximum(self.rough, 0.0)
        self.basis = np.linalg.solve(root.T, turn)

    def solve(self, rhs: np.ndarray, lam: float) -> np.ndarray:
        return self.basis @ ((self.basis.T @ rhs) / (1 + lam * self.rough)[:, None])

    def best_lambda(self, rhs: np.ndarray, total: float, n: float) -> float:
        """Lambda of the smallest generalised cross-validation score; total is the data's sum of squares."""
        weight = 1 / (1 + np.outer(LAMBDAS, self.rough))
        load = ((self.basis.T @ rhs) ** 2).sum(1)
        rss = np.maximum(total - (2 * weight - weight ** 2) @ load, 0.0)
        return float(LAMBDAS[np.argmin(n * rss / np.maximum(n - weight.sum(1), 1.0) ** 2)])


def solve_round(n: float, dd: float, g: np.ndarray, xy: np.ndarray, nb: int, p: np.ndarray, relief: bool, last: bool):
    """One trimming round from Gram sums: (spline coefficients, lambda, parallax), or None for too few points."""
    if n < (20 if relief else 10):
        return None
    smooth, tilt, hh = PenalisedGram(g[:-1, :-1], nb), g[:-1, -1:], max(g[-1, -1], 1e-300)
    rhs = xy[:-1] - tilt * p
    lam = smooth.best_lambda(rhs, float(dd - 2 * p @ xy[-1] + (p @ p) * g[-1, -1]), n)
    c = smooth.solve(rhs, lam)
    if relief and last:  # spline and parallax together: eliminate the spline, then put the parallax back
        free, lean = smooth.solve(xy[:-1], lam), smooth.solve(tilt, lam)
        p = (xy[-1] - tilt[:, 0] @ free) / max(g[-1, -1] - float(tilt[:, 0] @ lean[:, 0]), 1e-300)
        c = free - lean * p
    elif relief:
        p = (xy[-1] - tilt[:, 0] @ c) / hh
    return c, lam, p


def fit_trimmed(x: np.ndarray, d: np.ndarray, nb: int, limits: list[float], relief: bool):
    """All trimming rounds of one group of a bounded number of points: design matrix x, displacements d, and the largest
    residual that enters each following round. (coefficients, lambda, parallax, points used) or None."""
    keep, p, out = np.ones(len(x), bool), np.zeros(2), None
    for it, limit in enumerate(limits):
        a, b = x[keep], d[keep]
        found = solve_round(len(a), float((b * b).sum()), a.T @ a, a.T @ b, nb, p, relief, relief and it == len(limits) - 1)
        if found is None:
            return None
        c, lam, p = found
        out = c, lam, p, len(a)
        keep = np.hypot(*(x @ np.vstack([c, p]) - d).T) < limit
    return out


ROWS_AT_ONCE = 1 << 20


def _by_model(models: list[pd.Series]):
    """Rows of an Arrow batch whose models (columns SPLINE) have as many segments, each row with its own model: (places,
    number of segments, v0, v1, uc, us, parallax (rows x 2), coefficients (rows x 6 nb)). A part holds a bounded number of
    coefficients."""
    v0, v1, nseg, uc, us, px, py, coef = models
    for n, at in pd.Series(nseg.to_numpy()).groupby(nseg.to_numpy()).indices.items():
        step = max(ROWS_AT_ONCE // (6 * (int(n) + 3)), 1)
        for part in (at[i:i + step] for i in range(0, len(at), step)):
            num = [s.to_numpy(float)[part] for s in (v0, v1, uc, us, px, py)]
            yield part, int(n), *num[:4], np.stack(num[4:], 1), np.vstack(coef.iloc[part])


def _shift(x, y, hc, n, v0, v1, uc, us, p, coef) -> np.ndarray:
    """Displacement of points under one model each (rows x 2)."""
    first, vals = _basis(y, v0, v1, n)
    u, nb = (x - uc) / us, n + 3
    at, rows = first[:, None] + np.arange(4), np.arange(len(y))[:, None]
    out = hc[:, None] * p
    for axis in (0, 1):
        for b, w in enumerate((1.0, u, u * u)):
            out[:, axis] += (vals * coef[rows, (3 * axis + b) * nb + at]).sum(1) * w
    return out


def _spline_shifts(x, y, hc) -> Column:
    """Displacement (dx, dy) of points on plain Arrow batches; each row carries its model."""
    @F.pandas_udf("dx double, dy double")
    def run(sx: pd.Series, sy: pd.Series, hc: pd.Series, v0: pd.Series, v1: pd.Series, nseg: pd.Series, uc: pd.Series, us: pd.Series, px: pd.Series,
            py: pd.Series, coef: pd.Series) -> pd.DataFrame:
        x, y, h = sx.to_numpy(float), sy.to_numpy(float), hc.to_numpy(float)
        shift = np.full((len(x), 2), np.nan)
        for at, *model in _by_model([v0, v1, nseg, uc, us, px, py, coef]):
            shift[at] = _shift(x[at], y[at], h[at], *model)
        return pd.DataFrame(shift, columns=["dx", "dy"])

    return run(x, y, hc, *[F.col(c) for c in SPLINE])


SPLINE = ("v0", "v1", "nseg", "uc", "us", "px", "py", "coef")


def predict_spline(points: DataFrame, model: DataFrame, keys=("pair_id",), dem: DataFrame | None = None, height: str = "z", size: int | None = None,
                   rounds: int = 3) -> DataFrame:
    """Reference position of (src_x, src_y) under splines of pspline_fit: adds pred_x, pred_y.

    The relief term needs the ground's height at the reference position, which is not known beforehand. Without `dem` a
    column h is used (none: no relief term). With `dem` (tile_id, row_no, col_no, height) the height is looked up where
    the prediction stands, bilinear, and the prediction moved accordingly, `rounds` times; outside the raster it counts as
    the model's reference height. Points then need tile_id, the tile their y counts from (with `size` it may reach over
    the tile's edge). Points of a group without a model are left out.

    A tile of at most BLOCK points meets its cells once and goes through all rounds in one task. For tiles of more points,
    and with `size`, each round is one join on raster cells."""
    keys = list(keys)
    h = F.col("h") if dem is None and "h" in points.columns else F.lit(None).cast("double")
    zero = F.lit(0.0)

    def lifted(df, at):
        gap = F.coalesce(at - F.col("h0"), zero)
        return df.withColumn("pred_x", F.col("_bx") + gap * F.col("px")).withColumn("pred_y", F.col("_by") + gap * F.col("py"))

    def based(some):
        j = some.join(model.select(*keys, *SPLINE, "h0"), keys)
        j = j.withColumn("_s", _spline_shifts("src_x", "src_y", zero)).withColumn("_bx", F.col("src_x") + F.col("_s.dx")).withColumn("_by", F.col("src_y") + F.col("_s.dy"))
        return lifted(j, h).select(*points.columns, "_bx", "_by", "px", "py", "h0", "pred_x", "pred_y")

    def joined(j):
        # points and raster meet by a sort: a table of points that is small when compressed would be large as a broadcast
        for _ in range(rounds):
            seen = sample_raster(cut_lineage(j), dem.hint("merge"), "bilinear", height, "pred_x", "pred_y", size)
            j = lifted(seen, F.col("sampled")).drop("sampled")
        return j

    places = [*points.columns, "pred_x", "pred_y"]
    if dem is None:
        return based(points).select(*places)
    if size is not None or points.schema["tile_id"].dataType != dem.schema["tile_id"].dataType:
        return joined(based(points)).select(*places)
    few, many = by_size(points, ["tile_id"], BLOCK)
    out = _heights_by_tile(based(few), dem, height, rounds).select(*places)
    out = out.unionByName(based(points.where(F.col("tile_id").isNull())).distinct().select(*places))  # no tile, no height
    return out if many is None else out.unionByName(joined(based(many)).select(*places))


def _heights_by_tile(j: DataFrame, dem: DataFrame, height: str, rounds: int) -> DataFrame:
    """All look-up rounds of predict_spline for tiles of a bounded number of points. As in sample_raster equal rows become
    one, whose first height counts once for each, and a cell that comes more than once counts as its sum."""
    whole = [F.col(c).cast("bigint") for c in ("row_no", "col_no")]
    cells = dem.where((whole[0] == F.col("row_no")) & (whole[1] == F.col("col_no")) & F.col("tile_id").isNotNull()).select(
        "tile_id", whole[0].alias("_r"), whole[1].alias("_c"), F.col(height).cast("double").alias("_v"))
    met = spread(j, "tile_id").groupBy(*j.columns).agg(F.count(F.lit(1)).alias("_m"))

    def run(points, ground):
        def num(c):
            return points[c].to_numpy().astype(float)

        def put(table, c, values, known):
            return table.set_column(table.schema.get_field_index(c), c, pa.array(values, mask=~known))

        if not points.num_rows:
            return points.drop_columns(["_m"])
        bx, by, px, py, h0 = (num(c) for c in ("_bx", "_by", "px", "py", "h0"))
        is_x, is_y = (np.logical_and(*[points[c].is_valid().to_numpy() for c in pair]) for pair in (("_bx", "px"), ("_by", "py")))
        based = points["h0"].is_valid().to_numpy()
        at = raster_lookup(*(ground[c].to_numpy() for c in ("_r", "_c")), ground["_v"].to_numpy().astype(float), ground["_v"].is_null().to_numpy())
        x, y, times = num("pred_x"), num("pred_y"), num("_m")
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(rounds):
                z, known = at(x, y)
                gap = np.where(known & is_x & is_y & based, z * times - h0, 0.0)
                x, y, times = bx + gap * px, by + gap * py, 1.0
        return put(put(points, "pred_x", x, is_x), "pred_y", y, is_y).drop_columns(["_m"])

    return met.groupBy("tile_id").cogroup(cells.groupBy("tile_id")).applyInArrow(run, j.schema)


def raster_lookup(row: np.ndarray, col: np.ndarray, value: np.ndarray, missing: np.ndarray):
    """Bilinear look-up in the cells of one tile: a function of positions that gives heights and whether they are known.
    Corners of no weight need no cell."""
    first, width = (col.min(), col.max() - col.min() + 1) if len(col) else (0, 1)
    code, of = np.unique(row * width + (col - first), return_inverse=True)
    total, bad = np.bincount(of, np.where(missing, 0.0, value), len(code)), np.bincount(of, missing, len(code)) > 0

    def look(x: np.ndarray, y: np.ndarray):
        z, known = np.zeros(len(x)), (np.abs(np.nan_to_num(x)) < 2.0 ** 53) & (np.abs(np.nan_to_num(y)) < 2.0 ** 53) & (len(code) > 0)
        place = [np.where(known, np.nan_to_num(np.floor(v)), 0.0) for v in (x, y)]
        fx, fy = x - place[0], y - place[1]
        for dy in (0, 1):
            for dx in (0, 1):
                w = (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
                need = known & ~(w <= 0)
                r, c = place[1][need].astype(np.int64) + dy, place[0][need].astype(np.int64) + dx
                want = r * width + (c - first)
                at = np.minimum(np.searchsorted(code, want), len(code) - 1)
                hit = (code[at] == want) & (c >= first) & (c < first + width) & ~bad[at]
                z[need] += np.where(hit, w[need] * total[at], 0.0)
                known[need] &= hit
        return z, known

    return look


def inverse_spline(points: DataFrame, model: DataFrame, keys=("pair_id",), tol: float = 1e-6, rounds: int = 200) -> DataFrame:
    """Source position of (map_x, map_y) under splines of pspline_fit: adds inv_x, inv_y, last_step and converged.

    Rounds q <- map - d(q) as in inverse_map. The relief term depends on the height at the map position alone: a column
    h (null or missing: the model's reference height), so it stays fixed during the rounds. A position that does not
    settle keeps its last place and is not converged."""
    @F.pandas_udf("x double, y double, step double")
    def run(mx: pd.Series, my: pd.Series, hc: pd.Series, v0: pd.Series, v1: pd.Series, nseg: pd.Series, uc: pd.Series, us: pd.Series, px: pd.Series,
            py: pd.Series, coef: pd.Series) -> pd.DataFrame:
        to, h = np.stack([mx.to_numpy(float), my.to_numpy(float)], 1), hc.to_numpy(float)
        out = np.full((len(to), 3), np.nan)
        for at, *model in _by_model([v0, v1, nseg, uc, us, px, py, coef]):
            target, ht = to[at], h[at]
            place, step = target.copy(), np.full(len(at), np.inf)
            n, *own = model
            open_ = np.arange(len(at))  # positions that still move
            for _ in range(rounds):
                now = target[open_] - _shift(place[open_, 0], place[open_, 1], ht[open_], n, *[m[open_] for m in own])
                with np.errstate(over="ignore", invalid="ignore"):
                    step[open_] = np.hypot(*(now - place[open_]).T)
                going = np.isfinite(step[open_])
                place[open_[going]] = now[going]
                open_ = open_[going & (step[open_] >= tol)]
                if not len(open_):
                    break
            out[at] = np.column_stack([place, step])
        return pd.DataFrame(out, columns=["x", "y", "step"])

    keys = list(keys)
    j = points.join(model.select(*keys, *SPLINE, F.col("h0").alias("_h0")), keys)
    gap = F.coalesce(F.col("h") - F.col("_h0"), F.lit(0.0)) if "h" in points.columns else F.lit(0.0)
    out = j.withColumn("_i", run("map_x", "map_y", gap, *[F.col(c) for c in SPLINE]))
    return out.select(*points.columns, F.col("_i.x").alias("inv_x"), F.col("_i.y").alias("inv_y"), F.col("_i.step").alias("last_step"), F.coalesce(F.col("_i.step") < tol, F.lit(False)).alias("converged"))


def pspline_fit(matches: DataFrame, thresh: float, knot_px: float, keys=("pair_id",), rounds: int = 6, relief: bool = False,
                domain: DataFrame | None = None, points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Penalised along-track spline per group with trimming rounds: (model, points with fit_px and is_inlier).

    d(u, v) = sum_j B_j(v) (c0_j + c1_j u + c2_j u^2), plus (h - h0) p with `relief` (needs column `h`).
    A group of at most BLOCK points goes through all rounds inside one task. In larger ones each round is one
    distributed accumulation: blocks of at most a few thousand points build Gram sums in NumPy, the sums are added by
    Spark, and one small row per group picks lambda by GCV. The first two rounds keep residuals below four times the
    threshold.
    """
    keys = list(keys)
    if not relief:
        matches = matches.withColumn("h", F.lit(0.0))
        points = points.withColumn("h", F.lit(0.0)) if points is not None else None
    ok = matches.where(F.col("h").isNotNull())
    dom = domain if domain is not None else matches.groupBy(*keys).agg(
        F.min("src_y").alias("v0"), F.max("src_y").alias("v1"), F.avg("src_x").alias("uc"),
        F.when(F.stddev_pop("src_x") > 0, F.stddev_pop("src_x")).otherwise(1.0).alias("us"))
    h0 = grouped_quantiles(ok, keys, "h", {"h0": 0.5})
    n_blocks = F.ceil(F.count(F.lit(1)) / BLOCK)
    meta = dom.join(h0, keys).join(ok.groupBy(*keys).agg(n_blocks.alias("nblk")), keys).withColumn(
        "nseg", F.greatest(F.ceil((F.col("v1") - F.col("v0")) / knot_px), F.lit(1)).cast("int"))
    meta = cut_lineage(meta)
    whole = ("v0", "v1", "nseg", "uc", "us")
    ks = ", ".join(f"{k} {matches.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{ks}, coef array<double>, lam double, px double, py double, n_used long"
    limits = [thresh if it > 1 else 4 * thresh for it in range(rounds + (1 if relief else 0))]

    def model_row(head: dict, c: np.ndarray, lam: float, p: np.ndarray, n: float) -> dict:
        return {**head, "coef": np.concatenate([c[:, 0], c[:, 1]]).tolist(), "lam": float(lam), "px": float(p[0]), "py": float(p[1]), "n_used": int(n)}

    def prepared(df, groups):
        return df.join(groups, keys).withColumn("hc", F.col("h") - F.col("h0"))

    def fit_small(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = _design(*(np.asarray(v, float) for v in (r.src_x, r.src_y, r.hc)), r.v0, r.v1, int(r.nseg), r.uc, r.us)
                d = np.stack([np.asarray(r.ref_x, float) - np.asarray(r.src_x, float), np.asarray(r.ref_y, float) - np.asarray(r.src_y, float)], 1)
                found = fit_trimmed(x, d, int(r.nseg) + 3, limits, relief)
                if found is not None:
                    out.append(model_row({k: getattr(r, k) for k in keys}, *found))
            yield pd.DataFrame(out, columns=[*keys, "coef", "lam", "px", "py", "n_used"])

    # a group of one block is a bounded row and goes through all rounds at once
    values = ["src_x", "src_y", "hc", "ref_x", "ref_y"]
    small = spread(prepared(ok, meta.where("nblk = 1")).select(*keys, *whole, *values), *keys).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in whole], F.collect_list(F.struct(*values)).alias("p")).select(*keys, *whole, *[F.col(f"p.{c}").alias(c) for c in values])
    model = small.mapInPandas(fit_small, schema)
    large = meta.where("nblk > 1")
    if not large.isEmpty():
        model = model.unionByName(_fit_large(prepared(ok, large), large, keys, ks, schema, limits, relief, model_row))
    model = cut_lineage(model)
    fitted = model.join(meta, keys)
    target = prepared(points if points is not None else matches, fitted).where(F.col("hc").isNotNull())
    s = target.withColumn("_s", _spline_shifts("src_x", "src_y", F.col("hc")))
    ex, ey = F.col("src_x") + F.col("_s.dx") - F.col("ref_x"), F.col("src_y") + F.col("_s.dy") - F.col("ref_y")
    res = s.withColumn("fit_px", F.sqrt(ex * ex + ey * ey)).withColumn("is_inlier", F.col("fit_px") < thresh)
    return fitted, res.drop(*SPLINE, "lam", "n_used", "h0", "nblk", "hc", "_s")


def _fit_large(points: DataFrame, meta: DataFrame, keys: list[str], ks: str, schema: str, limits: list[float], relief: bool, model_row) -> DataFrame:
    """Models of groups of many blocks: each round is one distributed accumulation of the blocks' Gram sums."""
    rows = cut_lineage(spread(points.withColumn("blk", F.pmod(F.xxhash64("match_id"), F.col("nblk"))), *keys, "blk"))

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        nb = int(one["nseg"]) + 3
        x = _design(*(pdf[c].to_numpy(float) for c in ("src_x", "src_y", "hc")), float(one["v0"]), float(one["v1"]), int(one["nseg"]), float(one["uc"]), float(one["us"]))
        d = pdf[["ref_x", "ref_y"]].to_numpy(float) - pdf[["src_x", "src_y"]].to_numpy(float)
        flat = np.concatenate([[len(x), (d * d).sum()], (x.T @ x).ravel(), (x.T @ d).ravel()])
        at = np.nonzero(flat)[0]
        out = pd.DataFrame({"i": at.astype("int64"), "x": flat[at]})
        for n, key in enumerate(keys):
            out.insert(n, key, pdf[key].iloc[0])
        out["nb"] = nb
        return out

    def solve(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            nb = int(pdf["nb"].iloc[0])
            m = 3 * nb + 1
            flat = np.zeros(2 + m * m + 2 * m)
            flat[pdf["i"].to_numpy()] = pdf["x"].to_numpy()
            n, dd, g, xy = flat[0], flat[1], flat[2:2 + m * m].reshape(m, m), flat[2 + m * m:].reshape(m, 2)
            found = solve_round(n, dd, g, xy, nb, np.array([pdf["px"].iloc[0], pdf["py"].iloc[0]], float), relief, last)
            out = [] if found is None else [model_row({key: pdf[key].iloc[0] for key in keys}, *found, n)]
            return pd.DataFrame(out, columns=[*keys, "coef", "lam", "px", "py", "n_used"])
        return run

    def residual(df: DataFrame, model: DataFrame) -> DataFrame:
        """Prediction on plain Arrow batches; each row carries its own model."""
        j = df.join(model.select(*keys, "coef", "px", "py"), keys)
        s = j.withColumn("_s", _spline_shifts("src_x", "src_y", F.col("hc")))
        ex, ey = F.col("src_x") + F.col("_s.dx") - F.col("ref_x"), F.col("src_y") + F.col("_s.dy") - F.col("ref_y")
        return s.withColumn("fit_px", F.sqrt(ex * ex + ey * ey)).drop("coef", "px", "py", "_s")

    model, keep = None, rows
    for it, limit in enumerate(limits):
        sums = spread(keep, *keys, "blk").groupBy(*keys, "blk").applyInPandas(gram, f"{ks}, i long, x double, nb int").groupBy(*keys, "nb", "i").agg(F.sum("x").alias("x"))
        prev = model.select(*keys, "px", "py") if model is not None else meta.select(*keys, F.lit(0.0).alias("px"), F.lit(0.0).alias("py"))
        model = cut_lineage(spread(sums.join(prev, keys), *keys).groupBy(*keys).applyInPandas(solve(relief and it == len(limits) - 1), schema))
        keep = residual(rows, model).where(F.col("fit_px") < limit).drop("fit_px")
    return model


def inverse_map(points: DataFrame, model: DataFrame, kind: str, keys=("pair_id",), tol: float = 1e-6, rounds: int = 200) -> DataFrame:
    """Source position of (map_x, map_y) under a fitted model of any polynomial kind or a similarity: adds inv_x, inv_y,
    `last_step` (pixels moved in the last round) and `converged`.

    Rounds q <- map - d(q) run on plain Arrow batches until every row of the batch moves less than `tol`. A position
    that does not settle (displacement steeper than the map itself) keeps its last place and is not converged.
    """
    @F.pandas_udf("x double, y double, step double")
    def run(mx: pd.Series, my: pd.Series, cx: pd.Series, cy: pd.Series, scale: pd.Series, coef: pd.Series) -> pd.DataFrame:
        if len(mx) == 0:
            return pd.DataFrame({"x": [], "y": [], "step": []}, dtype=float)
        tx, ty, ox, oy, s, c = mx.to_numpy(float), my.to_numpy(float), cx.to_numpy(float), cy.to_numpy(float), scale.to_numpy(float), np.vstack(coef)
        x, y, step = tx.copy(), ty.copy(), np.full(len(tx), np.inf)
        for _ in range(rounds):
            u, v = (x - ox) / s, (y - oy) / s
            if kind == "similarity":
                dx, dy = c[:, 0] * u - c[:, 1] * v + c[:, 2], c[:, 1] * u + c[:, 0] * v + c[:, 3]
            else:
                powers = np.stack([u ** i * v ** j for i, j in TERMS[: N_TERMS[kind]]], 1)
                dx, dy = (powers * c[:, :powers.shape[1]]).sum(1), (powers * c[:, powers.shape[1]:]).sum(1)
            with np.errstate(over="ignore", invalid="ignore"):
                nx, ny = tx - dx, ty - dy
                step = np.hypot(nx - x, ny - y)
            going = np.isfinite(step)
            x, y = np.where(going, nx, x), np.where(going, ny, y)
            if not (step[going] >= tol).any():
                break
        return pd.DataFrame({"x": x, "y": y, "step": step})

    j = points.join(model.select(*keys, "cx", "cy", "scale", "coef"), list(keys))
    out = j.withColumn("_i", run("map_x", "map_y", "cx", "cy", "scale", "coef")).drop("cx", "cy", "scale", "coef")
    return out.select(*points.columns, F.col("_i.x").alias("inv_x"), F.col("_i.y").alias("inv_y"), F.col("_i.step").alias("last_step"), F.coalesce(F.col("_i.step") < tol, F.lit(False)).alias("converged"))


# --- inverse maps -----------------------------------------------------------------------------------------

def inverse_similarity(points: DataFrame, a: str = "a", b: str = "b", tx: str = "tx", ty: str = "ty", rounds: int = 8) -> DataFrame:
    """Source position of (map_x, map_y) by fixed-point rounds p <- q - d(p), as plain projections."""
    out = points.withColumn("inv_x", F.col("map_x")).withColumn("inv_y", F.col("map_y"))
    for _ in range(rounds):
        x, y = F.col("inv_x"), F.col("inv_y")
        nx = F.col("map_x") - (F.col(a) * x - F.col(b) * y + F.col(tx) - x)
        ny = F.col("map_y") - (F.col(b) * x + F.col(a) * y + F.col(ty) - y)
        out = out.withColumn("_i", F.struct(nx.alias("x"), ny.alias("y"))).withColumn("inv_x", F.col("_i.x")).withColumn("inv_y", F.col("_i.y")).drop("_i")
    return out
