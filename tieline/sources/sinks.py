"""Writers. Products are never overwritten: every writer uses mode `errorifexists` unless it appends a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions.geo import planar_latlon
from tieline.functions.transforms import match_confidence
from tieline.session import mounted, spread


def tiepoint_rows(res: DataFrame, transforms: DataFrame, width: float, height: float, gate: float = 15.0) -> DataFrame:
    """Tie points as fixed-decimal text columns in file order, with local latitude and longitude."""
    j = res.join(transforms.select("pair_id", "anchor_lat", "anchor_lon", "src_gsd", "canvas_gsd"), "pair_id")
    slat, slon, _ = planar_latlon("src_x", "src_y", "anchor_lat", "anchor_lon", "canvas_gsd", width, height)
    rlat, rlon, _ = planar_latlon("ref_x", "ref_y", "anchor_lat", "anchor_lon", "canvas_gsd", width, height)
    inl = F.col("residual_px") <= gate
    conf = F.when(inl, match_confidence("residual_px", gate)).otherwise(0.0)
    def fix(c, d):
        return F.format_string(f"%.{d}f", F.round(c, d))
    return j.select(
        "pair_id", "match_id", *[fix(F.col(c), 2).alias(c) for c in ("src_x", "src_y", "ref_x", "ref_y")], fix(F.col("residual_px"), 4).alias("residual_px"),
        inl.cast("int").alias("is_inlier"), fix(slat, 7).alias("src_lat"), fix(slon, 7).alias("src_lon"), fix(rlat, 7).alias("ref_lat"), fix(rlon, 7).alias("ref_lon"),
        fix(conf, 4).alias("confidence"))


def write_tiepoints(rows: DataFrame, path: str, note: str) -> None:
    """CSV parts per pair and a sidecar text with the comment header. Rows of a pair meet before they are written, so that
    not every task writes a file for every pair; a hot pair is divided by size."""
    rows.hint("rebalance", "pair_id").write.mode("errorifexists").partitionBy("pair_id").option("header", True).csv(path)
    rows.sparkSession.createDataFrame([(f"# {note}",)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}_note")


def geojson_features(points: DataFrame, lon: str, lat: str, properties: list[Column | str]) -> DataFrame:
    """One GeoJSON feature text per row."""
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    f = F.struct(F.lit("Feature").alias("type"), geom.alias("geometry"), F.struct(*properties).alias("properties"))
    return points.select("pair_id", "match_id", F.to_json(f).alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Line-delimited features."""
    features.select(F.col("feature").alias("value")).write.mode("errorifexists").text(path)


def write_texts(rows: DataFrame, key: str, path: str) -> None:
    """One text file per key (rows: key, value; equal keys share a file), all in one folder. Tasks put their files in
    place themselves: no folder per file is made, moved or listed by the driver.

    In a mounted folder (`file:`) tasks write plain files: Hadoop's local file system starts a process for each file's and each
    checksum's permissions, which takes many times as long as the file. A file is named by its key and appears whole,
    so a repeated task replaces it by the same one. Other stores are written by Spark."""
    # spread first: after the grouping it would count as the grouping's own exchange, which is merged into a few tasks
    files = spread(rows, key).groupBy(key).agg(F.concat_ws("\n", F.collect_list("value")).alias("value"))
    spark, folder = rows.sparkSession, mounted(rows.sparkSession, path)
    if folder is None:
        files.select("value").write.mode("errorifexists").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    # makes the folder, or refuses it, as every other writer does; a read of a folder without any file would fail
    spark.createDataFrame([], "value string").write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path)

    def put(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = f"{folder}/.{name}.{task.taskAttemptId()}"
                with open(own, "wb") as f:
                    f.write(text + b"\n")
                os.replace(own, f"{folder}/part-{task.partitionId():05d}-{name}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    named = files.select(F.md5(F.to_json(F.struct(key)).cast("binary")), F.col("value").cast("binary"))
    named.mapInArrow(put, "n bigint").agg(F.sum("n")).collect()
    with open(f"{folder}/_SUCCESS", "w"):
        pass


def write_shards(pairs: DataFrame, path: str) -> None:
    """Parquet partitioned by shard; rows of a shard meet in one task because a shard has a fixed size."""
    pairs.repartition("shard").write.mode("errorifexists").partitionBy("shard").parquet(path)


def append_run_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)
