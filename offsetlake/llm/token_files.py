"""Token files: bit-packed with an index, or flat without one.

A packed file holds ids of the fewest bits that the vocabulary needs, lowest bit first, in blocks of
``BLOCK_IDS``; every block starts at a byte of its own, and the offsets of all blocks, the
documents' keys and their lengths stand at the end, as in Parquet. So any range of ids can be read without
the rest, and a block is unpacked by a few numpy operations.

A flat file holds nothing but ids of two or four bytes. Documents in it end with a separator.
``scan_flat`` finds them with block reads in parallel and one prefix scan over the blocks.

Tasks write files under names of their own attempt. A file counts only if it is in the table
that the tasks return, so what lost or repeated attempts leave behind is never read.
"""

from __future__ import annotations

import io
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offsetlake.llm.common import Work, record_batch, text_slices

BLOCK_IDS = 4096
FILE_IDS = 32_000_000
FILE_DOCUMENTS = 500_000
SCAN_BYTES = 4 * 1024 * 1024
CACHED_WORDS = 1_000_000
JOINED_WORDS = 2000
BETWEEN = "\u2603"
MAGIC = b"IDBITS01"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class Encoder:
    """Encodes whole texts with a public tokenizer that works on white-space separated words.

    Normalisation and splitting of such a tokenizer never look across white space, so a text's ids
    are those of its words in turn. Ids of words seen before are kept, up to ``CACHED_WORDS``.
    """

    def __init__(self, path: str, literal_specials: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.between = np.array(self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids, np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words in turn, and how many each has.

        Many words go through the tokenizer as one text, with a word between them that none of them
        contains; its ids tell where the next one begins. Should they not, words go one by one.
        """
        parts, counts = [], []
        for start in range(0, len(words), JOINED_WORDS):
            some = words[start : start + JOINED_WORDS]
            if not any(BETWEEN in w for w in some):
                text = f" {BETWEEN} ".join(some)
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                n = max(0, len(ids) - len(self.between) + 1)
                same = [ids[i : i + n] == one for i, one in enumerate(self.between)]
                marks = np.flatnonzero(np.logical_and.reduce(same))
                if len(marks) == len(some) - 1:
                    cuts = np.concatenate([[0], marks, [len(ids)]]).astype(np.int64)
                    lengths = np.diff(cuts)
                    lengths[1:] -= len(self.between)
                    keep = np.ones(len(ids), bool)
                    for n in range(len(self.between)):
                        keep[cuts[1:-1] + n] = False
                    parts.append(ids[keep])
                    counts.append(lengths)
                    continue
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            parts.append(np.array([i for f in found for i in f], np.uint32))
            counts.append(np.array([len(f) for f in found], np.int64))
        return np.concatenate(parts), np.concatenate(counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each text has."""
        split = [t.encode("utf-8").split() for t in texts]
        words = [w for part in split for w in part]
        if not words:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.known) > CACHED_WORDS:
            self._forget()
        array = np.empty(len(words), object)
        array[:] = words
        codes, distinct = pd.factorize(array)
        places = list(map(self.known.get, distinct))
        if None in places:
            fresh = [w for w, place in zip(distinct, places, strict=True) if place is None]
            ids, lengths = self._encode_words([w.decode() for w in fresh])
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            places = list(map(self.known.get, distinct))
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        starts = np.cumsum(self.lengths) - self.lengths
        word = np.array(places, np.int64)[codes]
        lengths = self.lengths[word]
        ends = np.cumsum(lengths)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(starts[word] - ends + lengths, lengths)]
        last = np.cumsum([len(part) for part in split])
        upto = np.concatenate([[0], ends])[last]
        return ids, np.diff(upto, prepend=0)


@cache
def encoder(path: str, literal_specials: bool = False) -> Encoder:
    """One encoder per process, so that its known words last over the tasks of a Python worker."""
    return Encoder(path, literal_specials)


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of documents with an id appended to each."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, lowest bit first, up to the next whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpacked(data: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.zeros((count, 32), np.uint8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    bits[:, :width] = flat[: count * width].reshape(count, width)
    return np.packbits(bits.reshape(-1), bitorder="little").view("<u4").astype(np.uint32)


class PackedWriter:
    """Writes one packed file to a binary stream."""

    def __init__(self, stream, width: int, block_ids: int = BLOCK_IDS):
        self.stream, self.width, self.block = stream, width, block_ids
        self.waiting, self.offsets = np.zeros(0, np.uint32), []
        self.n_ids = self.at = 0
        self.index: list[tuple[pa.Array, np.ndarray]] = []
        self.documents = 0

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.index.append((keys, lengths))
        self.documents += len(lengths)
        self.n_ids += len(ids)
        self.waiting = np.concatenate([self.waiting, ids])
        whole = len(self.waiting) // self.block * self.block
        self._write(self.waiting[:whole])
        self.waiting = self.waiting[whole:]

    def _write(self, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.block):
            data = packed(ids[start : start + self.block], self.width)
            self.offsets.append(self.at)
            self.at += self.stream.write(data) or len(data)

    def close(self) -> None:
        self._write(self.waiting)
        keys = pa.concat_arrays([k for k, _ in self.index])
        lengths = np.concatenate([n for _, n in self.index])
        table = pa.table({"key": keys, "length": pa.array(lengths, pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        offsets, documents = np.array(self.offsets, "<u8").tobytes(), sink.getvalue()
        head = {"width": self.width, "block": self.block, "ids": self.n_ids, "at": self.at, "blocks": len(self.offsets)}
        footer = json.dumps(head | {"documents": len(documents)}).encode()
        self.stream.write(offsets + documents + footer + len(footer).to_bytes(4, "little") + MAGIC)
        self.stream.close()


class PackedFile:
    """Random access to a packed file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        length, magic = int.from_bytes(source.read_at(4, size - 12), "little"), source.read_at(8, size - 8)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        head = json.loads(source.read_at(length, size - 12 - length))
        self.width, self.block, self.n_ids = head["width"], head["block"], head["ids"]
        self.end = head["at"]
        self.offsets = np.frombuffer(source.read_at(8 * head["blocks"], self.end), "<u8")
        documents = source.read_at(head["documents"], self.end + 8 * head["blocks"])
        index = pa.ipc.open_stream(documents).read_all()
        self.keys, self.lengths = index.column("key").combine_chunks(), index.column("length").to_numpy()

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids at start, start + 1, ... of the file; only their blocks are read."""
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        data, out = self.source.read_at(end - begin, begin), []
        for block in range(first, last + 1):
            at = int(self.offsets[block]) - begin
            n = min(self.block, self.n_ids - block * self.block)
            out.append(unpacked(data[at : at + -(-n * self.width // 8)], self.width, n))
        return np.concatenate(out)[start - first * self.block :][:count]


def _task_name() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"


def write_packed(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode whole texts and write packed files in ascending order of the key; one row per file.

    Returns ``part, file, path, documents, ids``: files in order of part and file hold ascending keys,
    null keys first. ``end_id`` follows every document; a null text is an empty one. Rows with the
    same key stand side by side. An empty table gives no file. ``path`` is in storage that all executors
    share. Evaluate the result once: it is the list of what was written.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    schema = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        encode, part = encoder(tokenizer), int(_task_name().split("-")[0])
        number, writer, name = 0, None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            return record_batch(schema, [[part], [number], [name], [writer.documents], [writer.n_ids]])

        for batch, texts in text_slices(batches, "text", 3_000_000):
            if writer is None:
                name = f"{path}/{_task_name()}-{number:04d}.bits"
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}")
                writer = PackedWriter(stream, bits_for(encode.vocabulary), block_ids)
            writer.add(batch.column("key"), *with_ends(*encode.encode(texts), end_id))
            if writer.n_ids >= file_ids or writer.documents >= FILE_DOCUMENTS:
                yield closed()
                number, writer = number + 1, None
        if writer is not None:
            yield closed()

    return ordered.mapInArrow(write, "part long, file long, path string, documents long, ids long")


def read_packed(files: DataFrame, key_type: T.DataType, with_ids: bool = False) -> DataFrame:
    """Documents of packed files: ``key, start, n_tokens, ids_crc32`` and ``ids`` if asked for.

    ``start`` counts the ids of all documents before it, over all files in order. ``ids_crc32`` is the
    checksum of the ids as little-endian unsigned 32-bit integers.
    """
    before = W.orderBy("part", "file").rowsBetween(W.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("path", "base")
    spread = based.repartition(F.col("path"))
    fields = [("key", key_type), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                fs, name = file_system(one["path"])
                with fs.open_input_file(name) as source:
                    file = PackedFile(source)
                    ends = np.cumsum(file.lengths)
                    first = 0
                    while first < len(ends):
                        begin = int(ends[first - 1]) if first else 0
                        last = max(first + 1, int(np.searchsorted(ends, begin + 1_000_000, side="right")))
                        ids = file.ids(begin, int(ends[last - 1]) - begin).astype("<u4")
                        cuts = ends[first:last] - begin
                        parts = [ids[a:b] for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True)]
                        starts = one["base"] + begin + cuts - file.lengths[first:last]
                        columns = [file.keys.slice(first, last - first), starts, file.lengths[first:last]]
                        columns.append([zlib.crc32(p) for p in parts])
                        names = ["key", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                            names.append("ids")
                        arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)
                        first = last

    return spread.mapInArrow(read, T.StructType([T.StructField(n, t) for n, t in fields]))


def write_flat(
    documents: DataFrame, path: str, tokenizer: str, separator: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode whole texts and write flat files, each document followed by the separator.

    Returns ``path, ids, width, keys``, one row per file, with the keys of its documents in turn. The
    strings of special tokens in a text are encoded as ordinary text, so the separator is no
    document's own. Documents stay in the partitions they are read in. A null text is an empty one.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        encode = encoder(tokenizer, True)
        width = 2 if encode.vocabulary <= 1 << 16 else 4
        number, stream, name, ids, keys = 0, None, "", 0, []

        def closed() -> pa.RecordBatch:
            stream.close()
            all_keys = pa.concat_arrays(keys)
            listed = pa.ListArray.from_arrays(pa.array([0, len(all_keys)], pa.int32()), all_keys)
            arrays = [pa.array([name]), pa.array([ids], pa.int64()), pa.array([width], pa.int32()), listed]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "ids", "width", "keys"])

        for batch, texts in text_slices(batches, "text", 3_000_000):
            if stream is None:
                name = f"{path}/{_task_name()}-{number:04d}.ids"
                fs.create_dir(root, recursive=True)
                stream, ids, keys = fs.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}"), 0, []
            found, _ = with_ends(*encode.encode(texts), separator)
            stream.write(found.astype(f"<u{width}").tobytes())
            ids += len(found)
            keys.append(batch.column("key"))
            if ids >= file_ids or sum(map(len, keys)) >= FILE_DOCUMENTS:
                yield closed()
                number, stream = number + 1, None
        if stream is not None:
            yield closed()

    fields = [("path", T.StringType()), ("ids", T.LongType()), ("width", T.IntegerType()), ("keys", T.ArrayType(key_type))]
    return rows.mapInArrow(write, T.StructType([T.StructField(n, t) for n, t in fields]))


def scan_flat(files: DataFrame, separator: int, block_bytes: int = SCAN_BYTES) -> DataFrame:
    """Documents of flat files ``path, ids, width``: ``path, document, start, n_tokens, closed``.

    Blocks of all files are searched on their own, and what they find is written once. A prefix scan over the
    blocks of each file, one narrow row a block, carries the separators counted so far and the place of
    the last one; joined back to the blocks it numbers the documents and closes those that cross blocks, so
    a file of any size is spread over tasks. ``n_tokens`` leaves out the separator; ids after the last one are a
    document that is not ``closed``. A file without ids has no document, an empty table gives an empty
    result, a document may span any number of blocks, and a file that is listed twice is read once.
    Other columns are not read, whatever their names.
    """
    work = Work(files.sparkSession, "flat-scan")
    per_block = F.floor(F.lit(block_bytes) / F.col("width"))
    blocks = (
        files.filter("ids > 0")
        .select("path", "ids", "width")
        .distinct()
        .select("path", "ids", "width", F.explode(F.sequence(F.lit(0), F.ceil(F.col("ids") / per_block) - 1)).alias("block"))
        .withColumn("first", F.col("block") * per_block)
        .withColumn("count", F.least(per_block, F.col("ids") - F.col("first")))
        .repartition("path", "block")
    )
    numbers = [("n", pa.int64()), ("top", pa.int64()), ("places", pa.list_(pa.int64()))]
    schema = pa.schema([("path", pa.string()), ("ids", pa.int64()), ("block", pa.int64()), ("final", pa.bool_()), *numbers])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                fs, name = file_system(one["path"])
                with fs.open_input_file(name) as source:
                    data = source.read_at(one["count"] * one["width"], one["first"] * one["width"])
                found = np.flatnonzero(np.frombuffer(data, f"<u{one['width']}") == separator) + one["first"]
                final = one["first"] + one["count"] == one["ids"]
                top = int(found[-1]) if len(found) else None
                places = pa.array([found], pa.list_(pa.int64()))
                yield record_batch(schema, [[one["path"]], [one["ids"]], [one["block"]], [final], [len(found)], [top], places])

    found = work.keep(
        blocks.mapInArrow(search, "path string, ids long, block long, final boolean, n long, top long, places array<long>"), "blocks"
    )
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = found.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max("top").over(earlier), F.lit(-1)).alias("last"),
    )
    scanned = found.hint("merge").join(carried.hint("merge"), ["path", "block"])
    # The rest after a file's last separator ends where the file does.
    rest = F.greatest(F.col("last"), F.coalesce("top", F.lit(-1))) + 1
    ends = F.when(F.col("final") & (rest < F.col("ids")), F.concat("places", F.array("ids"))).otherwise(F.col("places"))
    each = scanned.withColumn("ends", ends).select(
        "path", "ids", "before", "last", "ends", F.posexplode("ends").alias("place", "end")
    )
    start = F.when(F.col("place") > 0, F.get("ends", F.col("place") - 1)).otherwise(F.col("last")) + 1
    return each.select(
        "path",
        (F.col("before") + F.col("place")).alias("document"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        (F.col("end") < F.col("ids")).alias("closed"),
    )


def packed_documents(documents: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write documents to packed files in the shared folder and read them back."""
    work = Work(documents.sparkSession, "packed-ids")
    files = work.keep(write_packed(documents, f"{work.path}/ids", tokenizer, end_id, key, text), "files")
    return read_packed(files, documents.schema[key].dataType)


def scanned_documents(documents: DataFrame, tokenizer: str, separator: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write documents to flat files in the shared folder, and count their ids by a separator scan.

    The keys come from the list of written files, by file and place; the counts from the files alone.
    """
    work = Work(documents.sparkSession, "flat-ids")
    files = work.keep(write_flat(documents, f"{work.path}/ids", tokenizer, separator, key, text), "files")
    keys = files.select("path", F.posexplode("keys").alias("document", "key"))
    # Sorted keys compress so well that Spark takes their list for small; it has a row per document.
    return scan_flat(files, separator).hint("merge").join(keys.hint("merge"), ["path", "document"]).select("key", "n_tokens")
