"""What several operators share: words, batches of Python values, intermediate tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake.sources import storage

# A word is a run of characters other than ASCII white space. bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a column's text, modulo ``divisor``; null keys count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def crc_remainder(value, divisor: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % divisor


class Work:
    """Intermediate tables of one call in the folder that ``spark.checkpoint.dir`` names.

    ``keep`` writes a table and reads it back, which cuts lineage in a way that survives lost
    executors. ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = storage.work_dir(spark, name)

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        # A few sorted or skewed tasks must not become a few huge files.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, *names: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in names:
            path = hadoop.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, size: Callable[[int], int], limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose sizes sum up to about ``limit``, so that arrays stay bounded."""
    start = total = 0
    for row in range(batch.num_rows):
        total += size(row)
        if total >= limit:
            yield batch.slice(start, row + 1 - start)
            start, total = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut to about ``limit`` bytes of text, with the texts as Python strings ("" for null)."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for part in slices(batch, lambda row: int(lengths[row]), limit):
            yield part, [text or "" for text in part.column(column).to_pylist()]


def record_batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
