"""Session helpers shared by operators that need to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir (or one set on the context). Only a local session,
    whose driver and executors are one process, gets a scratch folder where none is set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tieline-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an iterative step to shared storage and read it back: lost executors do not replay earlier rounds, the
    step is computed once, and its size is known to the optimizer."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path on the shared checkpoint storage."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(spark: SparkSession, path: str) -> str | None:
    """Plain path of a place in a mounted folder, which tasks may open themselves; None in any other store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return at.toUri().getPath() if fs.getScheme() == "file" else None


def spread(df: DataFrame, *cols) -> DataFrame:
    """Hash rows over all shuffle partitions before NumPy work. The explicit number keeps adaptive execution from
    merging a few small but costly rows (cells, blocks, tiles) into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def by_size(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most `most` rows and those of larger groups (None where there are none). Of the groups only
    the list of large ones is kept, at most one for `most` rows. Rows with a null key are in no group."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    large = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys))
    if large.isEmpty():
        return rows, None
    return rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi")
