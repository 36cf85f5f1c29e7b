"""A journal as a stream that is addressed by offset vectors, like Spark's Kafka source.

Spark's file streams know files; a checkpoint of one cannot say where it stands in the log, and a stream that begins
at a vector has to read and drop all before it. Here the stream's own offset is the vector: it begins exactly at
``starts``, ends at ``targets``, and takes at most ``max_offsets`` offsets a trigger.

The zone map of the journal is its list of finished files: Spark publishes the files of one append one after the other,
so a file that is there may still lack those before it. Whoever appends calls ``zones.update_zones`` afterwards; what is
not in the map is not in the stream yet. The driver holds one row of the map per file; the records go from the files
to Spark as Arrow batches, in tasks of bounded offset ranges that read several small files each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from offsetlake import schemas
from offsetlake.sources import storage
from offsetlake.sources.log import kafka_offsets

TASK_OFFSETS = 1_000_000
LEAST_TASK_OFFSETS = 20_000
TASKS = 4  # a core, unless that makes tasks too small or too large
BATCH_ROWS = 4_096

TopicPartition = tuple[str, int]
Vector = dict[TopicPartition, int]


class Zone(NamedTuple):
    """The offsets ``[low, high)`` that one file holds of a topic-partition."""

    file: str
    topic: str
    partition: int
    low: int
    high: int


def parsed(nested: dict[str, dict[str, int]]) -> Vector:
    return {(topic, int(p)): offset for topic, parts in nested.items() for p, offset in parts.items()}


def nested(vector: Vector) -> dict[str, dict[str, int]]:
    return json.loads(kafka_offsets([(t, p, o) for (t, p), o in vector.items()]))


def admitted(at: Vector, available: Vector, limit: int | None) -> Vector:
    """How far one trigger goes: to what is available, or ``limit`` offsets shared in proportion to what is left.

    Every record has an offset of its own, so a trigger never takes more than ``limit`` records. What rounding
    leaves over goes one by one to the partitions with most left, so any limit makes progress.
    """
    left = {tp: max(0, available.get(tp, 0) - at.get(tp, 0)) for tp in at.keys() | available.keys()}
    total = sum(left.values())
    if limit is None or total <= limit:
        return {tp: at.get(tp, 0) + n for tp, n in left.items()}
    share = {tp: limit * n // total for tp, n in left.items()}
    rest = limit - sum(share.values())
    for tp in sorted(left, key=lambda tp: (-left[tp], tp))[:rest]:
        share[tp] += 1
    return {tp: at.get(tp, 0) + n for tp, n in share.items()}


def lost(zones: Sequence[Zone], starts: Vector, ends: Vector) -> list[str]:
    """Topic-partitions whose ``[start, end)`` reaches outside of what the journal holds."""
    held: dict[TopicPartition, tuple[int, int]] = {}
    for zone in zones:
        low, high = held.get((zone.topic, zone.partition), (zone.low, zone.high))
        held[zone.topic, zone.partition] = min(low, zone.low), max(high, zone.high)
    found = []
    for tp, end in sorted(ends.items()):
        start = starts.get(tp, 0)
        low, high = held.get(tp, (end, start))
        if start < end and (low > start or high < end):
            there = f"[{low}, {high}) is there" if tp in held else "nothing is there"
            found.append(f"{tp[0]}/{tp[1]}: [{start}, {end}) is wanted, {there}")
    return found


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as Hadoop writes it, and the path there."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _range(parquet, group: int) -> tuple[int, int] | None:
    """The offsets of a row group by its statistics, or by the column where a writer left none."""
    import pyarrow.compute as pc

    described = parquet.metadata.row_group(group)
    if not described.num_rows:
        return None
    column = described.column(parquet.schema.names.index("offset"))
    if column.statistics is not None and column.statistics.has_min_max:
        return column.statistics.min, column.statistics.max + 1
    held = pc.min_max(parquet.read_row_group(group, ["offset"]).column(0)).as_py()
    return held["min"], held["max"] + 1


class JournalFiles:
    """The zones of a journal's files, as its zone map has them; each entry of the map is read once."""

    def __init__(self, uri: str):
        self.source, self.root = file_system(uri)
        self.prefix = unquote(urlsplit(uri).path)
        self.held: list[Zone] = []
        self.entries: set[str] = set()

    def _listed(self, path: str) -> list[str]:
        return [i.path for i in self.source.get_file_info(pafs.FileSelector(path, allow_not_found=True))]

    def zones(self) -> list[Zone]:
        import pyarrow.parquet as pq

        for entry in sorted(set(self._listed(f"{self.root}/_zones")) - self.entries):
            files = self._listed(entry)
            if f"{entry}/_SUCCESS" not in files:
                continue
            for name in (f for f in files if f.endswith(".parquet")):
                with self.source.open_input_file(name) as opened:
                    rows = pq.read_table(opened, columns=["file", "topic", "partition", "low", "high"]).to_pylist()
                self.held += [Zone(self._plain(r["file"]), r["topic"], r["partition"], r["low"], r["high"]) for r in rows]
            self.entries.add(entry)
        return self.held

    def _plain(self, uri: str) -> str:
        """A file as pyarrow names it; the map has the URI that Spark reports."""
        return self.root + unquote(urlsplit(uri).path).removeprefix(self.prefix)

    def gone(self, files: Sequence[str]) -> list[str]:
        return [i.path for i in self.source.get_file_info(list(files)) if not i.is_file]


def _records(source: pafs.FileSystem, piece: Zone) -> Iterator[pa.RecordBatch]:
    """The records of a piece of a file; only row groups that meet it are read."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    schema = to_arrow_schema(schemas.LOG)
    stored = [n for n in schemas.LOG.names if n not in ("topic", "partition")]
    with source.open_input_file(piece.file) as opened:
        parquet = pq.ParquetFile(opened, coerce_int96_timestamp_unit="us")
        held = [(g, _range(parquet, g)) for g in range(parquet.num_row_groups)]
        groups = [g for g, r in held if r is not None and r[0] < piece.high and r[1] > piece.low]
        for batch in parquet.iter_batches(BATCH_ROWS, groups, stored) if groups else ():
            offset = batch.column("offset")
            batch = batch.filter(pc.and_(pc.greater_equal(offset, piece.low), pc.less(offset, piece.high)))
            if batch.num_rows:
                fixed = {
                    "topic": pa.array([piece.topic] * batch.num_rows, pa.string()),
                    "partition": pa.array([piece.partition] * batch.num_rows, pa.int32()),
                }
                columns = [fixed[f.name] if f.name in fixed else batch.column(f.name).cast(f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class Pieces(InputPartition):
    """Zones of some files, cut to the offsets that one task reads."""

    def __init__(self, zones: Sequence[Zone]):
        super().__init__([tuple(z) for z in zones])


def dealt(zones: Sequence[Zone], most: int, tasks: int) -> list[list[Zone]]:
    """The zones in tasks of up to ``most`` offsets, and about as many tasks as wanted."""
    total = sum(z.high - z.low for z in zones)
    size = min(most, max(LEAST_TASK_OFFSETS, -(-total // tasks)))
    found: list[list[Zone]] = []
    room = 0
    for zone in zones:
        for cut in range(zone.low, zone.high, most):
            piece = zone._replace(low=cut, high=min(zone.high, cut + most))
            n = piece.high - piece.low
            if n > room:
                found.append([])
                room = size
            found[-1].append(piece)
            room -= n
    return found


class VectorReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.starts = parsed(json.loads(options["starts"]))
        self.targets = parsed(json.loads(options["targets"])) if options.get("targets") else None
        self.limit = int(options["max_offsets"]) if options.get("max_offsets") else None
        self.task_offsets = int(options.get("task_offsets") or TASK_OFFSETS)
        self.tasks = int(options.get("tasks") or 1)
        self.topics = set(options["topics"].split(",")) if options.get("topics") else None
        self.at: Vector | None = None
        self.files: JournalFiles | None = None

    def _zones(self) -> list[Zone]:
        if self.files is None:
            self.files = JournalFiles(self.path)
        return [z for z in self.files.zones() if self.topics is None or z.topic in self.topics]

    def _checked(self, zones: Sequence[Zone], starts: Vector, ends: Vector) -> None:
        missing = lost(zones, starts, ends)
        if missing:
            raise RuntimeError("the journal has lost records: " + "; ".join(missing[:10]))

    def initialOffset(self) -> dict:
        self.at = dict(self.starts)
        return nested(self.at)

    def latestOffset(self) -> dict:
        """The end of the next batch; the position moves when a batch is planned, not here."""
        at = self.at if self.at is not None else self.starts
        zones = self._zones()
        available: Vector = {}
        for zone in zones:
            tp = (zone.topic, zone.partition)
            available[tp] = max(available.get(tp, 0), zone.high)
        if self.targets is not None:
            available = {tp: min(available.get(tp, 0), end) for tp, end in self.targets.items()}
        self._checked(zones, at, {tp: end for tp, end in available.items() if end > at.get(tp, 0)})
        return nested(admitted(at, available, self.limit))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """Tasks of a batch. Spark also calls this with an empty range, to tell a restarted stream where it stands."""
        first, last = parsed(start), parsed(end)
        self.at = last
        if first == last:
            return []
        zones = self._zones()
        self._checked(zones, first, last)
        met = [z for z in zones if z.low < last.get((z.topic, z.partition), 0) and z.high > first.get((z.topic, z.partition), 0)]
        gone = self.files.gone([z.file for z in met])
        if gone:
            raise RuntimeError("the journal has lost files: " + "; ".join(gone[:10]))
        wanted = []
        for zone in met:
            tp = (zone.topic, zone.partition)
            wanted.append(zone._replace(low=max(zone.low, first.get(tp, 0)), high=min(zone.high, last.get(tp, 0))))
        return [Pieces(some) for some in dealt(wanted, self.task_offsets, self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """The records of a task's pieces, file by file."""
        source, _ = file_system(self.path)
        for piece in partition.value:
            yield from _records(source, Zone(*piece))

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the vector."""


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offset_journal"

    def schema(self):
        return schemas.LOG

    def streamReader(self, schema) -> VectorReader:
        return VectorReader(self.options)


def read_from_vector(
    spark: SparkSession,
    path: str,
    starts: DataFrame,
    targets: DataFrame | None = None,
    topics: Sequence[str] | None = None,
    max_offsets: int | None = None,
    task_offsets: int = TASK_OFFSETS,
) -> DataFrame:
    """Stream a journal from an exact vector on, and up to ``targets`` where given.

    Partitions that ``starts`` leaves out begin at offset 0; with ``targets``, partitions that it leaves out are not
    read. A journal that no longer holds an offset from which on records are wanted fails the query, as does one that
    ends before a vector that a checkpoint has seen, or has lost a file; gaps inside are not lost records. A journal
    without a zone map has nothing to read yet. ``max_offsets`` bounds each trigger of a stream by interval;
    ``availableNow`` takes the offset it finds at its start as the end of its only batch, so there it bounds the run.

    The journal is opened through ``pyarrow.fs``, so its folder must be one that it can open.
    """
    spark.dataSource.register(VectorSource)

    def vector(rows: DataFrame) -> str:
        return kafka_offsets([(r.topic, r.partition, r.offset) for r in rows.collect()])

    reader = spark.readStream.format("offset_journal").option("starts", vector(starts)).option("task_offsets", task_offsets)
    reader = reader.option("tasks", TASKS * spark.sparkContext.defaultParallelism)
    if targets is not None:
        reader = reader.option("targets", vector(targets))
    if topics is not None:
        reader = reader.option("topics", ",".join(topics))
    if max_offsets is not None:
        reader = reader.option("max_offsets", max_offsets)
    return reader.load(storage.qualified(spark, path))
