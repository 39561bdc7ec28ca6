"""Data-set operators: shards, manifests, histograms, coverage, training log, samples, result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.operators.ranking import dense_index, grouped_quantiles
from tieline.operators.tiepoints import hash_order


def assign_shards(pairs: DataFrame, size: int, ident: str = "pair_id") -> DataFrame:
    """Fixed-size shards in id order. Positions are computed bin by bin, never in one global sort task."""
    r = dense_index(pairs.withColumn("_g", F.lit(0)), ["_g"], ident)
    return r.withColumn("shard", F.floor(F.col("_rank") / size)).withColumn("position", F.col("_rank") % size).drop("_g", "_rank", "_n")


def shard_manifest(shards: DataFrame, payload: str = "payload", ident: str = "pair_id") -> DataFrame:
    """Count, bytes and SHA-256 per shard. The shard digest is the digest of its rows' digests in id order, so a
    shard's payload is never gathered in one place (a shard holds a fixed number of rows)."""
    d = F.struct(F.col(ident).alias("i"), F.sha2(F.col(payload).cast("binary"), 256).alias("h"))
    digests = F.transform(F.array_sort(F.collect_list(d)), lambda s: s["h"])
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("pair_count"), F.sum(F.octet_length(payload)).alias("size_bytes"),
                                       F.sha2(F.array_join(digests, ""), 256).alias("sha256"))


def verify_manifest(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shards whose count, size or digest differs from the manifest, or that exist on one side only."""
    c = current.select("shard", *[F.col(x).alias(f"c_{x}") for x in ("pair_count", "size_bytes", "sha256")])
    m = manifest.select("shard", *[F.col(x).alias(f"m_{x}") for x in ("pair_count", "size_bytes", "sha256")])
    j = c.join(m, "shard", "full")
    bad = [F.when(F.col("c_pair_count").isNull(), F.lit("missing")), F.when(F.col("m_pair_count").isNull(), F.lit("unlisted"))]
    both = F.col("c_pair_count").isNotNull() & F.col("m_pair_count").isNotNull()
    bad += [F.when(both & ~F.col(f"c_{x}").eqNullSafe(F.col(f"m_{x}")), F.lit(x)) for x in ("pair_count", "size_bytes", "sha256")]
    return j.select("shard", F.array_compact(F.array(*bad)).alias("problems")).where(F.size("problems") > 0)


def read_order(pairs: DataFrame, seed, shards: list[int] | None = None, max_per_shard: int | None = None) -> DataFrame:
    """Training order: shards in hashed order, pairs hashed within a shard. The optional cap keeps the first rows of
    a shard by position, as the feature asks; `shards` prunes partitions."""
    p = pairs.where(F.col("shard").isin(shards)) if shards is not None else pairs
    if max_per_shard is not None:
        p = p.where(F.col("position") < max_per_shard)
    p = p.withColumn("shard_order", hash_order(seed, "shard")).withColumn("_h", hash_order(seed, "shard", "pair_id"))
    w = Window.partitionBy("shard").orderBy("_h", "pair_id")
    return p.withColumn("pair_order", F.row_number().over(w)).drop("_h")


def histogram(df: DataFrame, value: Column, edges: list[float], keys: list[str] | None = None) -> DataFrame:
    """Counts and percentages in fixed bins; the last edge is inclusive; empty bins appear with zero."""
    keys = keys or []
    last = len(edges) - 2
    b = F.when((value < edges[0]) | (value > edges[-1]), F.lit(None))
    for i in range(last + 1):
        b = b.when(value < edges[i + 1], i)
    b = b.otherwise(last)
    counts = df.groupBy(*keys, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin IS NOT NULL")
    table = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("lo"), F.lit(float(edges[i + 1])).alias("hi")) for i in range(last + 1)])
    if keys:
        grid = df.select(*keys).distinct()
    else:
        grid = df.sparkSession.range(1).select(F.lit(0).alias("_one"))
    grid = grid.withColumn("b", F.explode(table)).select(*keys, "b.*")
    j = grid.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return j.withColumn("pct", F.when(total > 0, F.col("n") / total * 100).otherwise(0.0))


def coverage_stats(pairs: DataFrame, value: str = "mask_coverage", threshold: float = 0.40) -> DataFrame:
    base = pairs.groupBy().agg(F.count(F.lit(1)).alias("n"), (F.min(value) * 100).alias("min_pct"), (F.avg(value) * 100).alias("mean_pct"),
                               F.bool_and(F.col(value) >= threshold).alias("all_above_threshold"))
    return base.join(grouped_quantiles(pairs, [], F.col(value) * 100, {"median_pct": 0.5}))


def recovery_error(trials: DataFrame, bins: Column | None = None) -> DataFrame:
    """MAE, RMSE and largest error of recovered shifts; with `bins`, the bias by true shift (peak locking)."""
    ex, ey = F.col("dx") - F.col("true_dx"), F.col("dy") - F.col("true_dy")
    e = F.sqrt(ex * ex + ey * ey)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae_px"), F.sqrt(F.avg(e * e)).alias("rmse_px"), F.max(e).alias("max_px"), F.avg(ex).alias("bias_x"), F.avg(ey).alias("bias_y")]
    return trials.groupBy(bins.alias("true_shift")).agg(*aggs) if bins is not None else trials.groupBy().agg(*aggs)


def geometry_offset(points: DataFrame) -> DataFrame:
    """Median dx, dy and norm (with p5 and p95) between stated and matched position per pair."""
    d = points.withColumn("_dx", F.col("ref_x") - F.col("src_x")).withColumn("_dy", F.col("ref_y") - F.col("src_y")).withColumn(
        "_n", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    return (grouped_quantiles(d, ["pair_id"], "_dx", {"median_dx": 0.5}).join(grouped_quantiles(d, ["pair_id"], "_dy", {"median_dy": 0.5}), "pair_id")
            .join(grouped_quantiles(d, ["pair_id"], "_n", {"median_norm": 0.5, "p5_norm": 0.05, "p95_norm": 0.95}), "pair_id"))


def early_stop(log: DataFrame, patience: int, run: str | None = None) -> DataFrame:
    """Running best validation loss, epochs since it improved, and the stop flag (one row per epoch: a short log)."""
    key = [F.col(run)] if run else [F.lit(0)]
    w = Window.partitionBy(*key).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    best_epoch = F.min_by("epoch", "val_loss").over(w)
    d = log.withColumn("best_loss", F.min("val_loss").over(w)).withColumn("best_epoch", best_epoch)
    return d.withColumn("epochs_since_best", F.col("epoch") - F.col("best_epoch")).withColumn("stop", F.col("epochs_since_best") >= patience)


def stratified_sample(pairs: DataFrame, n: int, stratum: str, ident: str = "pair_id", seed=42) -> DataFrame:
    """n rows per stratum in hashed order (the limit is the feature). A literal rank filter lets Spark keep only n
    rows per stratum and task before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, ident), ident)
    return pairs.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= n)


def level_for_scale(levels: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """Pyramid level whose scale is closest to a target (lower level on ties)."""
    return levels.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("scale") - F.col(target)).alias("d"), "level", "scale")).alias("m")).select(*keys, "m.level", "m.scale")


def coarse_index(pairs: DataFrame, size: int, stride: int, h: str = "h") -> DataFrame:
    """Coarse cell correspondences under a 3x3 map: idx_a, idx_b for cells whose image lies inside the grid."""
    from tieline.functions.transforms import apply_h

    n = size // stride
    axis = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = pairs.withColumn("cy", axis).withColumn("cx", axis)
    x, y = apply_h(h, F.col("cx") * stride + stride / 2.0, F.col("cy") * stride + stride / 2.0, 1e-6)
    c = c.withColumn("bx", F.bround(x / stride, 0).cast("bigint")).withColumn("by", F.bround(y / stride, 0).cast("bigint"))
    inside = F.col("bx").between(0, n - 1) & F.col("by").between(0, n - 1)
    return c.where(inside).withColumn("idx_a", (F.col("cy") * n + F.col("cx")).cast("bigint")).withColumn("idx_b", F.col("by") * n + F.col("bx")).drop("cy", "cx", "bx", "by")


def union_results(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table without an equal row in the other (empty when the tables are equal, duplicates counted)."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def metrics_json(stats: DataFrame, sections: dict[str, list[str]], key: str = "pair_id") -> DataFrame:
    """One nested JSON document per pair."""
    parts = [F.struct(*cols).alias(name) for name, cols in sections.items()]
    return stats.select(key, F.to_json(F.struct(F.col(key), *parts)).alias("metrics"))


def long_metrics(stats: DataFrame, metrics: list[str], key: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return stats.select(key, rows.alias("s")).select(key, "s.*")


def scorecard(long: DataFrame, config: str, configs: list) -> DataFrame:
    """One row per metric, one column per configuration (the column list is given, so no extra job finds it)."""
    return long.groupBy("metric").pivot(config, configs).agg(F.first("value"))
