"""Neighbour joins: nearest points, descriptor matching, vector median filter, greedy thinning.

None of these emits all pairs of a group. Points are cut into blocks of bounded size, block pairs are the unit of
work, and each block pair returns only the best k rows per point, so one huge pair spreads over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.operators.catalog import box_join
from tieline.operators.ranking import dense_index, grouped_quantiles
from tieline.session import by_size, cut_lineage, spread

CELL = 256
BLOCK = 1024


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _spread_bits(v: Column) -> Column:
    """Put zeros between the 16 low bits of a value."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def _nearest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and distance of the k smallest finite entries of each row; equal distances go to the lower id."""
    kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    row, at = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
    dist, other = d[row, at], ids[at]
    order = np.lexsort((other, dist, row))
    row, other, dist = row[order], other[order], dist[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], other[keep], dist[keep]


def point_cells(points: DataFrame, keys: list[str], x: str, y: str, ident: str, size: int = CELL) -> DataFrame:
    """Cut each group into cells of `size` to 2*size-1 points that are close together (Z-order runs).

    Cells hold a bounded number of points whatever the density: a crowded spot becomes many small cells.
    """
    ext = points.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"),
                                    F.count(F.lit(1)).alias("_m"))
    def scaled(v, lo, hi):
        return F.when(F.col(hi) > F.col(lo), F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * 65535)).otherwise(0).cast("bigint")
    z = _spread_bits(scaled(x, "_x0", "_x1")).bitwiseOR(F.shiftleft(_spread_bits(scaled(y, "_y0", "_y1")), 1))
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-9))
    grid = side / F.ceil(F.sqrt(F.ceil(F.col("_m") / size)))
    placed = points.join(ext, keys).select(*keys, F.col(ident).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                                           z.alias("_z"), grid.alias("grid"))
    idx = dense_index(placed, keys, "_z", "id")
    cell = F.least(F.floor(F.col("_rank") / size), F.greatest(F.floor(F.col("_n") / size) - 1, F.lit(0)))
    return idx.withColumn("cell", cell).groupBy(*keys, "cell").agg(
        F.collect_list("id").alias("ids"), F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"), F.max("grid").alias("grid"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def knn_self(points: DataFrame, k: int, x: str = "src_x", y: str = "src_y", ident: str = "match_id", keys=("pair_id",)) -> DataFrame:
    """The k nearest other points of each point of its group: keys, id, neighbour, distance, rank (1-based).

    A cell's own points bound every k-th distance; only cells whose box comes that close are compared.
    """
    keys = list(keys)
    cells = point_cells(points, keys, x, y, ident, max(CELL, k + 1))

    @F.pandas_udf("double")
    def reach(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xs, ys):
            a, b = np.asarray(a), np.asarray(b)
            if len(a) <= k:
                out.append(0.0)
                continue
            d = np.sqrt((a[:, None] - a[None, :]) ** 2 + (b[:, None] - b[None, :]) ** 2)
            out.append(float(np.partition(d, k, axis=1)[:, k].max()))
        return pd.Series(out)

    # both sides of the cell join read this table
    c = cut_lineage(spread(cells, *keys, "cell").withColumn("r", reach("xs", "ys") * (1 + 1e-9)))
    a = c.select(*keys, "grid", F.col("cell").alias("ca"), F.col("ids").alias("ia"), F.col("xs").alias("xa"), F.col("ys").alias("ya"), (F.col("x0") - F.col("r")).alias("ax0"),
                 (F.col("x1") + F.col("r")).alias("ax1"), (F.col("y0") - F.col("r")).alias("ay0"), (F.col("y1") + F.col("r")).alias("ay1"))
    b = c.select(*keys, "grid", F.col("cell").alias("cb"), F.col("ids").alias("ib"), F.col("xs").alias("xb"), F.col("ys").alias("yb"), *[F.col(v).alias("b" + v) for v in ("x0", "x1", "y0", "y1")])
    pairs = box_join(a, b, [("ax0", "ax1", "bx0", "bx1"), ("ay0", "ay1", "by0", "by1")], F.col("grid"), [*keys, "grid"])

    def best(batches):
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                ia, ib = np.asarray(r.ia), np.asarray(r.ib)
                d = np.sqrt((np.asarray(r.xa)[:, None] - np.asarray(r.xb)[None, :]) ** 2 + (np.asarray(r.ya)[:, None] - np.asarray(r.yb)[None, :]) ** 2)
                d[ia[:, None] == ib[None, :]] = np.inf
                row, other, dist = _nearest(d, ib, k)
                found.append(({key: np.full(len(row), getattr(r, key)) for key in keys}, ia[row], other, dist))
            if found:  # one frame for all cell pairs of a batch
                groups = {key: np.concatenate([f[0][key] for f in found]) for key in keys}
                yield pd.DataFrame({**groups, **{name: np.concatenate([f[n] for f in found]) for n, name in ((1, "id"), (2, "neighbour"), (3, "distance"))}})

    rows = spread(pairs.select(*keys, "ca", "cb", "ia", "xa", "ya", "ib", "xb", "yb"), *keys, "ca", "cb").mapInPandas(best, f"{_key_schema(points, keys)}, id long, neighbour long, distance double")
    w = Window.partitionBy(*keys, "id").orderBy("distance", "neighbour")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nn_stats(points: DataFrame, x: str = "src_x", y: str = "src_y") -> DataFrame:
    """Mean, deviation, minimum and maximum of nearest-neighbour distances per pair."""
    return knn_self(points, 1, x, y).groupBy("pair_id").agg(
        F.avg("distance").alias("nn_mean"), F.stddev_pop("distance").alias("nn_std"), F.min("distance").alias("nn_min"), F.max("distance").alias("nn_max"))


def _deviations(ids: np.ndarray, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, k: int) -> np.ndarray:
    """Distance of each row's displacement (dx, dy) from the median of its k nearest rows with another id. Rows of one id
    share their neighbours, and a neighbour counts with all rows of its id."""
    order = np.argsort(ids, kind="stable")
    ids, x, y, dx, dy = (v[order] for v in (ids, x, y, dx, dy))
    d = np.sqrt((x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2)
    d[ids[:, None] == ids[None, :]] = np.inf
    row, other, dist = _nearest(d, np.arange(len(ids)), k)
    mx, my = np.full((2, len(ids)), np.nan)
    first, place = np.unique(ids, return_index=True, return_inverse=True)[1:]
    known = ~(np.isnan(dx) | np.isnan(dy)).any()
    if len(first) == len(ids) and known and len(row):
        n = np.bincount(row, minlength=len(ids))
        for size in set(n.tolist()) - {0}:  # one size unless distances are missing
            at = n == size
            near = other[at[row]].reshape(-1, size)
            mx[at], my[at] = np.median(dx[near], 1), np.median(dy[near], 1)
    else:
        for i in range(len(first)):
            mine = place[row] == i
            near = place[other[mine]]
            near = near[np.lexsort((near, dist[mine]))[:k]]
            rows = np.concatenate([np.nonzero(place == j)[0] for j in near]) if len(near) else np.empty(0, int)
            for m, v in ((mx, dx[rows]), (my, dy[rows])):
                m[place == i] = np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else np.nan
    out = np.empty(len(ids))
    out[order] = np.sqrt((dx - mx) ** 2 + (dy - my) ** 2)
    return out


def _filter_small(nodes: DataFrame, k: int, x: str, y: str, ident: str) -> DataFrame:
    """The filter of groups of at most BLOCK rows: a group is one bounded row, its neighbours never become rows."""
    @F.pandas_udf("dev array<double>, limit double")
    def run(ids: pd.Series, xs: pd.Series, ys: pd.Series, sx: pd.Series, sy: pd.Series, rx: pd.Series, ry: pd.Series) -> pd.DataFrame:
        devs, limits = [], []
        for i, *values in zip(ids, xs, ys, sx, sy, rx, ry):
            a, b, ax, ay, bx, by = (np.asarray(v, float) for v in values)
            at = np.nonzero(np.array([v >= 0 for v in i], bool) & ~np.isnan(a) & ~np.isnan(b))[0]
            dev, limit = np.full(len(a), np.nan), np.nan
            if len(at):
                dev[at] = _deviations(np.asarray(i)[at], a[at], b[at], (bx - ax)[at], (by - ay)[at], k)
            seen = dev[~np.isnan(dev)]
            if len(seen):
                limit = 3.0 * np.median(np.abs(seen - np.median(seen)))
            devs.append(dev)
            limits.append(limit)
        return pd.DataFrame({"dev": devs, "limit": limits})

    groups = spread(nodes, "pair_id").groupBy("pair_id").agg(F.collect_list(F.struct(*nodes.columns)).alias("p"))
    # ids travel as their places in the group's order (-1: none)
    known = F.array_sort(F.array_distinct(F.filter(F.col(f"p.{ident}"), lambda v: v.isNotNull())))
    groups = groups.withColumn("_ids", known).withColumn("_at", F.transform(F.col(f"p.{ident}"), lambda v: F.coalesce(F.array_position("_ids", v) - 1, F.lit(-1).cast("bigint"))))
    found = groups.withColumn("_d", run("_at", *[F.transform(F.col(f"p.{c}"), lambda v: v.cast("double")) for c in (x, y, "src_x", "src_y", "ref_x", "ref_y")]))
    rows = found.select(F.size("p").alias("_m"), F.col("_d.limit").alias("_t"), F.explode(F.arrays_zip("p", F.col("_d.dev").alias("v"))).alias("r"))
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    keep = (F.col("_m") <= k) | (F.col("deviation") <= F.col("threshold"))
    return rows.select("_m", "r.p.*", number("r.v").alias("deviation"), number("_t").alias("threshold")).withColumn("keep", keep).drop("_m")


def vector_median_filter(nodes: DataFrame, k: int = 8, x: str = "src_x", y: str = "src_y", ident: str = "match_id") -> DataFrame:
    """Deviation of each displacement from the median of its k neighbours; kept when <= 3 MAD of deviations.

    Groups with at most k rows are returned whole. Adds `deviation`, `threshold`, `keep`. A group of at most BLOCK rows is
    filtered inside one task.
    """
    small, large = by_size(nodes, ["pair_id"], BLOCK)
    out = _filter_small(small, k, x, y, ident)
    return out if large is None else out.unionByName(_filter_large(large, k, x, y, ident))


def _filter_large(nodes: DataFrame, k: int, x: str, y: str, ident: str) -> DataFrame:
    d = nodes.select("pair_id", F.col(ident).alias("neighbour"), (F.col("ref_x") - F.col("src_x")).alias("ndx"), (F.col("ref_y") - F.col("src_y")).alias("ndy"))
    med = knn_self(nodes, k, x, y, ident).join(d, ["pair_id", "neighbour"]).groupBy("pair_id", F.col("id").alias(ident)).agg(
        F.median("ndx").alias("mdx"), F.median("ndy").alias("mdy"))
    sizes = nodes.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_m"))
    ex, ey = F.col("ref_x") - F.col("src_x") - F.col("mdx"), F.col("ref_y") - F.col("src_y") - F.col("mdy")
    dev = nodes.join(med, ["pair_id", ident], "left").join(sizes, "pair_id").withColumn("deviation", F.sqrt(ex * ex + ey * ey)).drop("mdx", "mdy")
    dev = cut_lineage(dev)
    centre = grouped_quantiles(dev, ["pair_id"], "deviation", {"_med": 0.5})
    spread = grouped_quantiles(dev.join(centre, "pair_id"), ["pair_id"], F.abs(F.col("deviation") - F.col("_med")), {"_mad": 0.5})
    out = dev.join(spread, "pair_id", "left").withColumn("threshold", 3.0 * F.col("_mad"))
    return out.withColumn("keep", (F.col("_m") <= k) | (F.col("deviation") <= F.col("threshold"))).drop("_mad", "_m")


# --- descriptors ----------------------------------------------------------------------------------

def _blocks(df: DataFrame, keys: list[str], value: str, p: str) -> DataFrame:
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_nb"))
    blk = F.pmod(F.xxhash64("kp_id"), F.col("_nb"))
    return df.join(n, keys).withColumn("_blk", blk).groupBy(*keys, "_blk").agg(
        F.collect_list("kp_id").alias(f"{p}_ids"), F.collect_list(value).alias(f"{p}_v")).drop("_blk")


def _distances(a: list, b: list, metric: str) -> np.ndarray:
    if metric == "hamming":
        x, y = (np.asarray(v, dtype=np.int64).view(np.uint64) for v in (a, b))  # signed values would count their magnitude's bits
        return np.bitwise_count(x[:, None] ^ y[None, :]).astype(float)
    x, y = np.vstack(a).astype(float), np.vstack(b).astype(float)
    d = np.empty((len(x), len(y)))
    for i in range(0, len(x), 64):  # small slabs keep memory flat and avoid the cancellation of the expanded square
        d[i:i + 64] = np.sqrt(((x[i:i + 64, None, :] - y[None, :, :]) ** 2).sum(-1))
    return d


def _block_top(q: DataFrame, r: DataFrame, keys: list[str], k: int, value: str, metric: str, both_ways: bool) -> DataFrame:
    pairs = _blocks(q, keys, value, "q").join(_blocks(r, keys, value, "r"), keys)

    def top(ia, ib, d):
        row, other, dist = _nearest(d, ib, k)
        return ia[row], other, dist

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ia, ib = np.asarray(row.q_ids), np.asarray(row.r_ids)
                d = _distances(row.q_v, row.r_v, metric)
                parts = [("q", *top(ia, ib, d))]
                if both_ways:
                    parts.append(("r", *top(ib, ia, d.T)))
                for side, a, b, dist in parts:
                    out = pd.DataFrame({"side": side, "id": a, "other": b, "distance": dist})
                    for n, key in enumerate(keys):
                        out.insert(n, key, getattr(row, key))
                    yield out

    return spread(pairs, *keys, "q_ids", "r_ids").mapInPandas(run, f"{_key_schema(q, keys)}, side string, id long, other long, distance double")


def descriptor_knn(q: DataFrame, r: DataFrame, k: int = 2, value: str = "descriptor", metric: str = "l2", keys=("pair_id",)) -> DataFrame:
    """Exact k nearest reference descriptors per query descriptor: keys, q_id, r_id, distance, rank."""
    keys = list(keys)
    rows = _block_top(q, r, keys, k, value, metric, False)
    w = Window.partitionBy(*keys, "id").orderBy("distance", "other")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        *keys, F.col("id").alias("q_id"), F.col("other").alias("r_id"), "distance", "rank")


def ratio_test(knn: DataFrame, t: float = 0.75, keys=("pair_id",)) -> DataFrame:
    """Best match kept when its distance is below t times the second."""
    best = knn.groupBy(*keys, "q_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("r_id"))).alias("r_id"), F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("distance"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    return best.where(F.col("distance") < t * F.col("second"))


def mutual_best(q: DataFrame, r: DataFrame, value: str = "descriptor", metric: str = "l2", keys=("pair_id",)) -> DataFrame:
    """Pairs that are each other's best match. Both directions come from one pass over the block pairs."""
    keys = list(keys)
    rows = _block_top(q, r, keys, 1, value, metric, True)
    best = rows.groupBy(*keys, "side", "id").agg(F.min(F.struct("distance", "other")).alias("m"))
    a = best.where("side = 'q'").select(*keys, F.col("id").alias("q_id"), F.col("m.other").alias("r_id"), F.col("m.distance").alias("distance"))
    b = best.where("side = 'r'").select(*keys, F.col("id").alias("r_id"), F.col("m.other").alias("q_id"))
    return a.join(b, [*keys, "q_id", "r_id"])


# --- greedy thinning -------------------------------------------------------------------------------

def _thinned(ids: np.ndarray, score: np.ndarray, places: list[tuple[np.ndarray, np.ndarray]], radius: float, size: float) -> np.ndarray:
    """The rounds of spatial_dedup on one group: which rows are kept. `ids` grow with the match ids."""
    rank = np.empty(len(ids), int)
    rank[np.lexsort((ids, -np.nan_to_num(score, nan=-np.inf), np.isnan(score)))] = np.arange(len(ids))  # best first, without score last
    near, cells = np.zeros((len(ids), len(ids)), bool), []
    for x, y in places:
        near |= (x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2 <= radius * radius
        cell = np.stack([np.nan_to_num(np.floor(v / size), nan=1e300) for v in (x, y)], 1)
        cells.append(np.unique(cell, axis=0, return_inverse=True)[1].ravel())
    near &= ids[:, None] != ids[None, :]
    outranks = near & ((score[:, None] > score[None, :]) | ((score[:, None] == score[None, :]) & (ids[:, None] < ids[None, :])))
    undecided, kept = np.ones(len(ids), bool), np.zeros(len(ids), bool)
    while undecided.any():
        best = np.ones(ids.max() + 1, bool)
        for cell in cells:
            order = np.nonzero(undecided)[0]
            order = order[np.lexsort((rank[order], cell[order]))]
            top = np.zeros(len(best), bool)
            top[ids[order[np.r_[True, np.diff(cell[order]) != 0]]]] = True
            best &= top
        cand = undecided & best[ids]
        blocked = cand & outranks[undecided].any(0)
        won = cand & ~np.isin(ids, ids[blocked])
        gone = undecided & (near[:, won].any(1) | won)
        kept |= won
        undecided &= ~np.isin(ids, ids[gone])
    return kept


def _dedup_small(matches: DataFrame, radius: float, size: float, score: str, cols: list[str]) -> DataFrame:
    """Thinning of groups of at most BLOCK rows: a group is one bounded row and takes all rounds inside one task."""
    @F.pandas_udf("array<boolean>")
    def run(ids: pd.Series, value: pd.Series, sx: pd.Series, sy: pd.Series, rx: pd.Series, ry: pd.Series) -> pd.Series:
        out = []
        for i, *columns in zip(ids, value, sx, sy, rx, ry):
            v, a, b, c, d = (np.asarray(u, float) for u in columns)
            out.append(_thinned(np.asarray(i, int), v, [(a, b), (c, d)], radius, size).tolist())
        return pd.Series(out)

    groups = spread(matches.select(*cols, score), "pair_id").groupBy("pair_id").agg(F.collect_list(F.struct(*cols, F.col(score))).alias("p"))
    groups = groups.withColumn("_ids", F.array_sort(F.array_distinct("p.match_id"))).withColumn("_at", F.transform("p.match_id", lambda v: F.array_position("_ids", v)))
    found = groups.withColumn("_k", run("_at", *[F.transform(F.col(f"p.{c}"), lambda v: v.cast("double")) for c in (score, "src_x", "src_y", "ref_x", "ref_y")]))
    return found.select(F.explode(F.filter(F.arrays_zip("p", "_k"), lambda r: r["_k"])).alias("r")).select("r.p.*")


def spatial_dedup(matches: DataFrame, radius: float = 20.0, score: str = "score") -> DataFrame:
    """Greedy thinning by score: a match stays only if it is more than `radius` from every better kept match in
    both images. The same set as the one-by-one greedy loop, reached in rounds.

    In one round a match is kept when no undecided match outranks it within the radius. Cells have a diagonal
    below the radius, so only a cell's best match can be kept, and every row is compared with at most one
    candidate per neighbouring cell: work is linear in the rows however crowded a cell is. A group of at most BLOCK rows
    takes its rounds inside one task; for larger ones each round is written to the checkpoint folder, which bounds the
    lineage and survives lost executors. Matches without an id have no rank and are left out.
    """
    cols = ["pair_id", "match_id", "src_x", "src_y", "ref_x", "ref_y"]
    small, large = by_size(matches.where(F.col("match_id").isNotNull()), ["pair_id"], BLOCK)
    out = _dedup_small(small, radius, radius / 1.4143, score, cols)
    return out if large is None else out.unionByName(_dedup_large(large, radius, radius / 1.4143, score, cols))


def _dedup_large(matches: DataFrame, radius: float, size: float, score: str, cols: list[str]) -> DataFrame:
    span = int(np.ceil(radius / size))
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-span, span + 1) for j in range(-span, span + 1)])
    und = matches.select(*cols, F.col(score).alias("_score"))
    for p in ("src", "ref"):
        und = und.withColumn(f"_{p}i", F.floor(F.col(f"{p}_x") / size)).withColumn(f"_{p}j", F.floor(F.col(f"{p}_y") / size))
    und = cut_lineage(und)
    kept = None
    rank = F.struct(F.col("_score"), -F.col("match_id"))

    def near(rows: DataFrame, cand: DataFrame, p: str) -> DataFrame:
        """Rows within the radius of a candidate of a neighbouring cell in one image."""
        c = cand.select("pair_id", F.col("match_id").alias("_cid"), F.col("_score").alias("_cs"), F.col(f"{p}_x").alias("_cx"), F.col(f"{p}_y").alias("_cy"),
                        F.col(f"_{p}i").alias("_i"), F.col(f"_{p}j").alias("_j"), F.explode(offs).alias("o"))
        c = c.withColumn(f"_{p}i", F.col("_i") + F.col("o.i")).withColumn(f"_{p}j", F.col("_j") + F.col("o.j")).drop("_i", "_j", "o")
        dx, dy = F.col(f"{p}_x") - F.col("_cx"), F.col(f"{p}_y") - F.col("_cy")
        return rows.join(c, ["pair_id", f"_{p}i", f"_{p}j"]).where((dx * dx + dy * dy <= radius * radius) & (F.col("match_id") != F.col("_cid")))

    while True:  # every round decides the best undecided match of every pair at least
        best = None
        for p in ("src", "ref"):
            top = und.groupBy("pair_id", f"_{p}i", f"_{p}j").agg(F.max(rank).alias("m")).select("pair_id", (-F.col("m.col2")).alias("match_id"))
            best = top if best is None else best.join(top, ["pair_id", "match_id"])
        cand = und.join(best, ["pair_id", "match_id"])
        outranks = (F.col("_score") > F.col("_cs")) | ((F.col("_score") == F.col("_cs")) & (F.col("match_id") < F.col("_cid")))
        blocked = near(und, cand, "src").where(outranks).select("pair_id", F.col("_cid").alias("match_id")).union(
            near(und, cand, "ref").where(outranks).select("pair_id", F.col("_cid").alias("match_id"))).distinct()
        won = cut_lineage(cand.join(blocked, ["pair_id", "match_id"], "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        gone = near(und, won, "src").select("pair_id", "match_id").union(near(und, won, "ref").select("pair_id", "match_id")).union(
            won.select("pair_id", "match_id")).distinct()
        und = cut_lineage(und.join(gone, ["pair_id", "match_id"], "left_anti"))
        if und.isEmpty():
            return kept.select(*cols, F.col("_score").alias(score))
