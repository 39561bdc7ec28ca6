"""Exact ranks and quantiles per group that never bring an unbounded group to one task.

One plan for every size: rows are dealt by range over (group, value), so a group that holds a third of all rows covers
a third of the partitions; the weights that each partition holds of each group give the partition's starting rank
(one small row per group and partition), and only rows of one group in one partition are ordered together. Equal
values are one weighted row before they are dealt.

Null values have no rank in a quantile (a group of only nulls has null quantiles); in an index they come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.session import cut_lineage


def running_total(rows: DataFrame, keys: list[str], order: list[str], weight: str) -> DataFrame:
    """Add `_start`, the weight of the rows before this one in its group by `order` (nulls first), and `_total`, the
    group's weight. Ranges depend on a sample, so the dealt rows are stored before they are read twice."""
    dealt = cut_lineage(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order)]).withColumn("_p", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    held = dealt.groupBy(*keys, "_p").agg(F.sum(weight).alias("_held"))
    first = held.withColumn("_first", F.coalesce(F.sum("_held").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "_total", F.sum("_held").over(group)).select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("_p").alias("_q"), "_first", "_total")
    same = F.col("_p") == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    inside = Window.partitionBy(*keys, "_p").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(first, same).withColumn("_start", F.col("_first") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.drop("_p", "_q", "_first", *[f"_g_{k}" for k in keys])


def grouped_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group with the columns named in `probs`.

    Null values have weight 0 (NaN becomes null at ingest), so their group keeps its row. Pass `F.when(cond, v)`
    rather than a filtered input to keep groups without a value.
    """
    v = F.col(value) if isinstance(value, str) else value
    named = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    distinct = base.select(*named, v.cast("double").alias("_v")).groupBy(*named, "_v").agg(F.count("_v").alias("_k"))
    placed = running_total(distinct, named, ["_v"], "_k")

    def at(rank: Column, name: str) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_k")), F.col("_v"))).alias(name)

    place = {n: F.lit(float(p)) * (F.col("_total") - 1) for n, p in probs.items()}
    ends = placed.groupBy(*named).agg(F.max("_total").alias("_total"), *[at(f(x), tag + n) for n, x in place.items() for tag, f in (("_f_", F.floor), ("_c_", F.ceil))])
    return ends.select(*keys, *[(F.col("_f_" + n) + (F.col("_c_" + n) - F.col("_f_" + n)) * (x - F.floor(x))).alias(n) for n, x in place.items()])


def dense_index(df: DataFrame, keys: list[str], order: str, tie: str | None = None, out: str = "_rank") -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by (order, tie), plus `_n` the group size."""
    placed = running_total(df.withColumn("_one", F.lit(1)), keys, [order, *([tie] if tie else [])], "_one")
    return placed.withColumn(out, F.col("_start").cast("bigint")).withColumnRenamed("_total", "_n").drop("_start", "_one")
