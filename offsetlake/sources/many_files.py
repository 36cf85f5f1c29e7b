"""Many small files, listed and read by tasks, so that the driver holds neither their names nor a scan of them.

A file scan of Spark keeps the status, the directory and the task of every file on the driver. Here the names are rows
that tasks take; a folder of any number of files costs the driver the same. Folders are opened through ``pyarrow.fs``,
as the vector stream does it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from offsetlake import schemas
from offsetlake.operators.skew import pin
from offsetlake.sources import storage
from offsetlake.sources.vector_stream import BATCH_ROWS, TASK_OFFSETS, _range, file_system

WANTED = schemas.struct(file=schemas.STRING, low=schemas.LONG, high=schemas.LONG)
FEW_FOLDERS, FEW_ENTRIES = 1_000, 10_000  # a level of folders that is held and not written
ROWS_A_BATCH = 1_000


class Root(NamedTuple):
    """A folder as Spark's scans name it, and as a URI for pyarrow."""

    name: str
    uri: str


def opened_root(spark: SparkSession, path: str) -> Root | None:
    """The folder, or None where pyarrow does not know its file system."""
    name = storage.qualified(spark, path).rstrip("/")
    root = Root(name, quote(name, safe=":/@"))
    try:
        file_system(root.uri)
    except (pa.ArrowException, OSError, ValueError):
        return None
    return root


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_batches(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_A_BATCH:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _shown(name: str) -> bool:
    """Spark's readers pass over the other names."""
    return not name.startswith(".") and not name.endswith("._COPYING_") and (not name.startswith("_") or "=" in name)


def _entries(folders: DataFrame, uri: str) -> DataFrame:
    """What lies directly in some folders: names below the root, and whether they are folders themselves."""
    schema = pa.schema([("name", pa.string()), ("folder", pa.bool_()), ("bytes", pa.int64()), ("modified", pa.int64())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = file_system(uri)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    for i in source.get_file_info(pafs.FileSelector(base + folder, allow_not_found=True)):
                        if _shown(i.base_name):
                            yield f"{folder}/{i.base_name}", i.type == pafs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000

        yield from _in_batches(schema, rows())

    return folders.mapInArrow(listed, "name STRING, folder BOOLEAN, bytes LONG, modified LONG")


def listed_files(spark: SparkSession, root: Root, tasks: int) -> DataFrame:
    """``file, bytes, modified`` of all Parquet files below the root, level by level; names go from task to task."""
    level, folders, found = spark.createDataFrame([("",)], "name STRING").coalesce(1), 1, []
    while folders:
        entries = _entries(level, root.uri)
        held = pin(entries, FEW_ENTRIES) if folders <= FEW_FOLDERS else None
        entries = storage.written(entries, "listing") if held is None else held
        found.append(entries.filter("NOT folder AND endswith(name, '.parquet')"))
        level = entries.filter("folder").select("name")
        folders = level.count()
        level = level.repartition(max(1, min(tasks, folders)))
    files = reduce(DataFrame.unionByName, found)
    return files.select(F.concat(F.lit(root.name), "name").alias("file"), "bytes", F.timestamp_millis("modified").alias("modified"))


def _path_values(name: str) -> dict[str, str | None]:
    """Partition columns that the directories of a file name, as Spark writes them."""
    pairs = [part.split("=", 1) for part in name.split("/")[:-1] if "=" in part]
    return {unquote(k): None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in pairs}


def _constant(value: str | None, kind: pa.DataType, size: int) -> pa.Array:
    return pa.nulls(size, kind) if value is None else pa.array([value] * size, pa.string()).cast(kind)


def _batches(source: pafs.FileSystem, base: str, name: str, schema: pa.Schema, low: int | None, high: int | None) -> Iterator[pa.RecordBatch]:
    """Columns of a file, or of its rows with ``low <= offset < high``; only row groups that meet these are read."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    values = _path_values(name)
    with source.open_input_file(base + name) as opened:
        parquet = pq.ParquetFile(opened, coerce_int96_timestamp_unit="us")
        there = set(parquet.schema_arrow.names)
        groups = list(range(parquet.num_row_groups))
        if low is not None:
            held = [(g, _range(parquet, g)) for g in groups]
            groups = [g for g, r in held if r is not None and r[0] < high and r[1] > low]
        stored = [n for n in dict.fromkeys([*schema.names, "offset"]) if n in there and n not in values]
        for batch in parquet.iter_batches(BATCH_ROWS, groups, stored) if groups else ():
            if low is not None:
                offset = batch.column("offset")
                batch = batch.filter(pc.and_(pc.greater_equal(offset, low), pc.less(offset, high)))
            if batch.num_rows:
                of = lambda f: batch.column(f.name).cast(f.type) if f.name in stored else _constant(values.get(f.name), f.type, batch.num_rows)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([of(f) for f in schema], schema=schema)


def positions(files: DataFrame, root: Root) -> DataFrame:
    """``file, topic, partition, low, high, rows, bytes`` of each file and topic-partition, in one row or several.

    Only position columns of ``file, bytes`` are read, and folded where they are read.
    """
    position = to_arrow_schema(schemas.OFFSETS)
    out = pa.schema([("file", pa.string()), ("topic", pa.string()), ("partition", pa.int32()), *((n, pa.int64()) for n in ("low", "high", "rows", "bytes"))])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = file_system(root.uri)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for file, size in zip(*(batch.column(n).to_pylist() for n in ("file", "bytes")), strict=True):
                    for part in _batches(source, base, file.removeprefix(root.name), position, None, None):
                        keys = pa.Table.from_batches([part]).group_by(["topic", "partition"])
                        found = keys.aggregate([("offset", "min"), ("offset", "max"), ([], "count_all")]).to_pylist()
                        for r in found:
                            high = None if r["offset_max"] is None else r["offset_max"] + 1
                            yield file, r["topic"], r["partition"], r["offset_min"], high, r["count_all"], size

        yield from _in_batches(out, rows())

    return files.select("file", "bytes").mapInArrow(folded, "file STRING, topic STRING, partition INT, low LONG, high LONG, rows LONG, bytes LONG")


def records(wanted: DataFrame, root: Root, schema: T.StructType, tasks: int) -> DataFrame:
    """The records of the wanted files with ``low <= offset < high``, or all of a file without such bounds.

    A task takes several files, and bounded offset ranges of large ones.
    """
    arrow = to_arrow_schema(schema)
    total = wanted.agg(F.sum(F.col("high") - F.col("low")).alias("n")).first().n or 0
    start = F.explode(F.coalesce(F.sequence("low", F.col("high") - 1, F.lit(TASK_OFFSETS)), F.array(F.lit(None).cast("long"))))
    pieces = wanted.select("file", "high", start.alias("low"))
    pieces = pieces.select("file", "low", F.least("high", F.col("low") + TASK_OFFSETS).alias("high"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = file_system(root.uri)
        for batch in batches:
            for r in batch.to_pylist():
                yield from _batches(source, base, r["file"].removeprefix(root.name), arrow, r["low"], r["high"])

    return pieces.repartition(max(tasks, -(-total // TASK_OFFSETS))).mapInArrow(read, schema)
