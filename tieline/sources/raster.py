"""Headerless binary rasters and cubes as a Spark data source and as a catalog-scale scan.

`spark.read.format("rawraster")` reads one product: partitions are line blocks, filters on `line` are pushed into
the byte ranges, and a band list reads only those bands. `scan_rasters` reads many products at once from a label
table: line blocks are rows, so thousands of files spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


def read_lines(path: str, storage: str, lines: int, samples: int, bands: int, interleave: str, wanted: list[int], lo: int, hi: int, offset: int = 0) -> np.ndarray:
    """Lines [lo, hi) as (line, band, sample); only the needed byte ranges are read."""
    dt = np.dtype(storage)
    out = np.empty((hi - lo, len(wanted), samples), dtype=dt)

    def fetch(f, at, count):
        f.seek(offset + at * dt.itemsize)
        return np.frombuffer(f.read(count * dt.itemsize), dtype=dt, count=count)

    with open(path, "rb") as f:
        for k, b in enumerate(wanted):
            if interleave == "bsq":
                out[:, k, :] = fetch(f, (b * lines + lo) * samples, (hi - lo) * samples).reshape(hi - lo, samples)
            else:  # bil
                for line in range(lo, hi):
                    out[line - lo, k, :] = fetch(f, (line * bands + b) * samples, samples)
    return out


class LineBlock(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class RawRasterReader(DataSourceReader):
    def __init__(self, options):
        self.o = options
        self.lines, self.samples, self.bands = int(options["lines"]), int(options["samples"]), int(options.get("bands", 1))
        self.block = int(options.get("blocklines", 512))
        self.lo, self.hi = 0, self.lines

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            at = getattr(f, "attribute", None)
            if at != ("line",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, GreaterThanOrEqual):
                self.lo = max(self.lo, f.value)
            elif isinstance(f, GreaterThan):
                self.lo = max(self.lo, f.value + 1)
            elif isinstance(f, LessThanOrEqual):
                self.hi = min(self.hi, f.value + 1)
            elif isinstance(f, LessThan):
                self.hi = min(self.hi, f.value)
            elif isinstance(f, EqualTo):
                self.lo, self.hi = max(self.lo, f.value), min(self.hi, f.value + 1)
            else:
                yield f

    def partitions(self):
        return [LineBlock(a, min(a + self.block, self.hi)) for a in range(self.lo, self.hi, self.block)] or [LineBlock(0, 0)]

    def read(self, part):
        if part.hi <= part.lo:
            return
        cube = self.o.get("cube", "false") == "true"
        wanted = [int(b) for b in self.o["bandlist"].split(",")] if self.o.get("bandlist") else list(range(self.bands))
        a = read_lines(self.o["path"], self.o["storage"], self.lines, self.samples, self.bands, self.o.get("interleave", "bsq"), wanted, part.lo, part.hi, int(self.o.get("offset", 0)))
        for i in range(part.hi - part.lo):
            if cube:
                for s in range(self.samples):
                    yield part.lo + i, s, [float(v) for v in a[i, :, s]]
            else:
                yield part.lo + i, [int(v) for v in a[i, 0]]


class RawRaster(DataSource):
    """Options: path, storage, lines, samples, bands, interleave (bsq or bil), bandlist, cube, blocklines, offset."""

    @classmethod
    def name(cls):
        return "rawraster"

    def schema(self):
        return "line bigint, sample int, spectrum array<double>" if self.options.get("cube", "false") == "true" else "line bigint, samples array<int>"

    def reader(self, schema):
        return RawRasterReader(self.options)


def scan_raster(spark: SparkSession, path: str, storage: str, lines: int, samples: int, **options) -> DataFrame:
    """Line rows of one 2-D raster."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawRaster)
    return spark.read.format("rawraster").options(path=path, storage=storage, lines=lines, samples=samples, **options).load()


def scan_cube(spark: SparkSession, path: str, storage: str, lines: int, samples: int, bands: int, interleave: str = "bsq", bandlist: list[int] | None = None) -> DataFrame:
    """Spectra of one 3-D cube, optionally only some bands."""
    extra = {"bandlist": ",".join(map(str, bandlist))} if bandlist is not None else {}
    return scan_raster(spark, path, storage, lines, samples, bands=bands, interleave=interleave, cube="true", **extra)


def scan_rasters(labels: DataFrame, block_lines: int = 512) -> DataFrame:
    """Line rows of many 2-D rasters: labels carry product_id, file_path, storage, lines, samples."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lines").cast("bigint") - 1, F.lit(block_lines).cast("bigint")))
    blocks = labels.withColumn("lo", starts).withColumn("hi", F.least(F.col("lo") + block_lines, F.col("lines")))
    blocks = blocks.select("product_id", "file_path", "storage", "lines", "samples", "lo", "hi").repartition("product_id", "lo")

    def read(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = read_lines(r.file_path, r.storage, int(r.lines), int(r.samples), 1, "bsq", [0], int(r.lo), int(r.hi))[:, 0, :]
                yield pd.DataFrame({"product_id": r.product_id, "line": np.arange(r.lo, r.hi), "samples": list(a.astype("int32"))})

    return blocks.mapInPandas(read, "product_id long, line long, samples array<int>")


def line_pixels(lines: DataFrame) -> DataFrame:
    """Line rows to long pixels."""
    return lines.select("product_id", "line", F.posexplode("samples").alias("sample", "dn"))
