"""Text and JSON sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

GEOMETRY_COLUMNS = ["Longitude", "Latitude", "Pixel", "Scan"]
CORNER_COLUMNS = [f"{v}_{h}_{a}" for v in ("upper", "lower") for h in ("left", "right") for a in ("latitude", "longitude")]


def scan_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Geometry grid CSV; a file without one of the four columns is an error."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in GEOMETRY_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"geometry file lacks columns {missing}")
    return raw.select(F.col("Longitude").cast("double").alias("lon"), F.col("Latitude").cast("double").alias("lat"),
                      F.col("Pixel").cast("bigint").alias("pixel"), F.col("Scan").cast("bigint").alias("scan"))


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog CSV: numbers cast, rows with a malformed corner dropped, mean latitude added."""
    raw = spark.read.option("header", True).csv(path)
    num = CORNER_COLUMNS + [c for c in ("solar_incidence", "sun_azimuth", "file_size_mb", "pixel_resolution") if c in raw.columns]
    rest = [c for c in raw.columns if c not in num]
    out = raw.select(*rest, *[F.col(c).try_cast("double").alias(c) for c in num]).dropna(subset=CORNER_COLUMNS)
    lats = [F.col(c) for c in CORNER_COLUMNS if c.endswith("latitude")]
    return out.withColumn("lat_c", (lats[0] + lats[1] + lats[2] + lats[3]) / 4.0)


TIEPOINT_SCHEMA = ("match_id bigint, src_x double, src_y double, ref_x double, ref_y double, residual_px double, is_inlier int, "
                   "src_lat double, src_lon double, ref_lat double, ref_lon double, confidence double")


def scan_tiepoints(spark: SparkSession, path: str, schema: str = TIEPOINT_SCHEMA) -> DataFrame:
    """Tie-point CSV with `#` comment lines."""
    return spark.read.schema(schema).option("comment", "#").option("header", True).csv(path)


def scan_results_json(spark: SparkSession, paths: list[str], schema: str, arrays: bool = True) -> DataFrame:
    """Results from several JSON files (one array per file, or one object per line); absent files count as empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    def exists(p):
        q = jvm.org.apache.hadoop.fs.Path(p)
        return q.getFileSystem(conf).exists(q)
    out = spark.createDataFrame([], schema)
    for p in paths:
        if exists(p):
            out = out.unionByName(spark.read.schema(schema).option("multiLine", arrays).json(p), allowMissingColumns=True)
    return out


def scan_pairs(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """Pair shards; the shard filter prunes partition folders."""
    df = spark.read.parquet(path)
    return df.where(F.col("shard").isin(shards)) if shards is not None else df
