"""A zone map: which offsets of which topic-partitions each file of a journal or table holds.

A vector that starts late in one partition and early in another has a wide hull, but few files overlap it. The map
is a small table beside the files, ``_zones/n=<n>``, which readers of the files do not see; each entry adds the files
that came since. A range read joins it with the ranges and opens only the files that overlap.

Names of files are rows: the driver has up to ``LISTED`` of them at a time, however many files there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake import schemas
from offsetlake.operators.bounds import TP
from offsetlake.operators.skew import join_control
from offsetlake.operators.snapshot import read_range
from offsetlake.sources import many_files, storage
from offsetlake.sources.table import complete

ZONES = schemas.struct(
    file=schemas.STRING, topic=schemas.STRING, partition=schemas.INT, low=schemas.LONG, high=schemas.LONG, rows=schemas.LONG, bytes=schemas.LONG
)
LISTED = 1_000  # files that a read names one by one
LISTING = 4  # tasks a core that list folders, or read small files


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While files are listed: a few tasks a core. Spark takes one for each folder or named file, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(_tasks(spark)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _tasks(spark: SparkSession) -> int:
    return LISTING * spark.sparkContext.defaultParallelism


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, modified`` of all data files below a path; nothing is opened.

    Tasks list the folders. Only on file systems that pyarrow does not know, Spark's own listing gathers them on the driver.
    """
    root = many_files.opened_root(spark, path)
    if root is not None:
        return many_files.listed_files(spark, root, _tasks(spark))
    if not storage.has_children(spark, path):
        return spark.createDataFrame([], "file STRING, bytes LONG, modified TIMESTAMP")
    with few_listing_tasks(spark):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    entries = complete(spark, f"{path}/_zones")
    if not entries:
        return spark.createDataFrame([], ZONES)
    return spark.read.schema(ZONES).parquet(*[f"{path}/_zones/n={n}" for n in entries])


def update_zones(spark: SparkSession, path: str) -> int | None:
    """Add the files that are not in the map yet; returns the entry's number, or None without new files.

    Only position columns of the new files are read, and folded per file before the shuffle.
    """
    fresh = _not_mapped(list_files(spark, path), read_zones(spark, path))
    some = [r.file for r in fresh.select("file").limit(LISTED + 1).collect()]
    if not some:
        return None
    files = len(some) if len(some) <= LISTED else fresh.count()
    root = many_files.opened_root(spark, path) if files > LISTED else None
    if root is not None:
        parts = many_files.positions(fresh.repartition(_tasks(spark)), root)
    else:
        rows = _positions(spark, path, some if files <= LISTED else None)
        if files > LISTED and complete(spark, f"{path}/_zones"):
            # Without a map so far, every file is fresh.
            rows = join_control(rows, fresh.select("file"), ["file"], "left_semi")
        parts = rows.withColumns({"low": F.col("offset"), "high": F.col("offset") + 1, "rows": F.lit(1)})
    zones = parts.groupBy("file", *TP).agg(*[of(n).alias(n) for n, of in (("low", F.min), ("high", F.max), ("rows", F.sum), ("bytes", F.max))])
    entries = complete(spark, f"{path}/_zones")
    number = entries[-1] + 1 if entries else 0
    storage.overwriting(zones.select(*ZONES.names).coalesce(max(1, files // 10_000))).parquet(f"{path}/_zones/n={number}")
    return number


def _reader(spark: SparkSession, path: str, schema: T.StructType, files: list[str] | None) -> DataFrame:
    """All files below the path, or some of them; partition columns come from their directories either way."""
    reader = spark.read.schema(schema).option("basePath", path)
    with few_listing_tasks(spark):
        return reader.parquet(*files) if files is not None else reader.parquet(path)


def _positions(spark: SparkSession, path: str, files: list[str] | None) -> DataFrame:
    rows = _reader(spark, path, schemas.OFFSETS, files)
    return rows.select(*schemas.POSITION, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))


def _not_mapped(files: DataFrame, zones: DataFrame) -> DataFrame:
    # Both sides may have a row per file, which a broadcast would gather on the driver.
    return files.join(zones.select("file").distinct().hint("merge"), "file", "left_anti")


def _met(zones: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    ranges = targets.select(*TP, F.col("offset").alias("_target")).join(starts.select(*TP, F.col("offset").alias("_start")), TP)
    return join_control(zones, ranges.filter("_start < _target"), TP).filter("low < _target AND high > _start")


def overlapping(zones: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of a zone map that ``[start, target)`` of their topic-partition meets."""
    return _met(zones, starts, targets).select(*zones.columns)


def read_pruned(spark: SparkSession, path: str, starts: DataFrame, targets: DataFrame, schema: T.StructType = schemas.LOG) -> DataFrame:
    """``read_range`` of a directory that opens only files of the zone map that overlap, and files not in it yet.

    Up to ``LISTED`` files are named in a scan; with more, tasks take their names from a table and read them. Only on file
    systems that pyarrow does not know, the whole directory is scanned then, with the range pushed down as ever.
    """
    zones = read_zones(spark, path)
    fresh = _not_mapped(list_files(spark, path), zones).withColumns({n: F.lit(None).cast("long") for n in ("low", "high")})
    ends = (F.min(F.greatest("low", "_start")).alias("low"), F.max(F.least("high", "_target")).alias("high"))
    wanted = _met(zones, starts, targets).groupBy("file").agg(*ends).unionByName(fresh.select(*many_files.WANTED.names))
    files = [r.file for r in wanted.select("file").limit(LISTED + 1).collect()]
    if not files:
        return spark.createDataFrame([], schema)
    root = many_files.opened_root(spark, path) if len(files) > LISTED else None
    if root is not None:
        rows = many_files.records(storage.written(wanted, "wanted"), root, schema, _tasks(spark))
    else:
        rows = _reader(spark, path, schema, files if len(files) <= LISTED else None)
    return read_range(rows.select(*schema.names), starts, targets)


def opened_files(read: DataFrame) -> DataFrame:
    """``file`` of each file that a pruned read opens, by its plan: those its scan names, or those of the table that its tasks read."""
    inputs, spark = read.inputFiles(), read.sparkSession
    tables = [f for f in inputs if re.search("/wanted-[0-9a-f]{32}/", f)]
    if tables:
        return spark.read.schema(many_files.WANTED).parquet(*tables).select("file").distinct()
    return spark.createDataFrame([(f.replace("file:///", "file:/"),) for f in inputs], "file STRING")
