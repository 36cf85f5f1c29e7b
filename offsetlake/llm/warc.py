"""WARC archives: writing with segments, chunks and revisits, and reading with reassembly.

A page becomes an HTTP response with chunked transfer framing. Blocks beyond ``SEGMENT_BYTES`` go on in
continuation records. Of equal payloads of some size, one is a response and the others are
revisit records that refer to it. Spark's text writer stores the records, with the four bytes
that end a WARC record as its line separator and in gzip, so files are committed like any other output.

Reading parses each file by its records' Content-Length, regroups segments by the identifier of
their first record, in the order of their numbers, checks the total length and decodes the
chunks. Only segments are shuffled; a whole record is decoded where it was read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake.llm.common import record_batch, slices

SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
LEAST_REVISIT = 100
FILE_RECORDS = 2048
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for start in range(0, len(payload), size):
        part = payload[start : start + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body with chunked transfer framing; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size without end")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than it says")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, without its headers and transfer framing."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("HTTP header without end")
    lines = [line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line]
    fields = {name.strip().lower(): value.strip().lower() for name, value in lines}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(kind: str, block: bytes, **fields: object) -> bytes:
    """One WARC record without the line ends that close it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of an archive, plain or in gzip members."""
    if data.startswith(b"\x1f\x8b"):
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        head = data.find(END, at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines)}
        start = head + len(END)
        end = start + int(fields["content-length"])
        if data[end : end + len(END)] != END:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, data[start:end]
        at = end + len(END)


def _record_id(page: str) -> str:
    return f"<urn:page:{page}>"


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    least_revisit: int = LEAST_REVISIT,
) -> None:
    """Write every page to WARC files under ``path``.

    The payload is the html in UTF-8, empty for null. Of pages with equal payloads of at least
    ``least_revisit`` bytes, that with the smallest key is the response; rows that repeat its key are
    responses too. Pages without a key are written as pages of key null, and a null url as none.
    An empty table writes no record.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), body.cast("binary").alias("payload"), F.sha2(body.cast("binary"), 256).alias("digest")
    )
    # Digests that occur once need no partner; their rows pass the left join unchanged.
    first = (
        rows.filter(F.octet_length("payload") >= least_revisit)
        .groupBy("digest")
        .agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .drop("n")
    )
    schema = pa.schema([("record", pa.binary())])

    def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("payload")
            for part in slices(batch, lambda row: len(lengths[row].as_buffer()), 8_000_000):
                out = []
                for row in part.to_pylist():
                    page = f"{row['key']}:{row['digest']}" if row["key"] is not None else f"null:{row['digest']}"
                    common = {
                        "WARC_Record_ID": _record_id(page),
                        "WARC_Target_URI": row["url"].replace("\r", "%0D").replace("\n", "%0A") if row["url"] is not None else None,
                        "WARC_Payload_Digest": f"sha256:{row['digest']}",
                    }
                    if row["first"] is not None and row["first"] != row["key"]:
                        to = _record_id(f"{row['first']}:{row['digest']}")
                        out.append(record("revisit", HTTP, **common, WARC_Profile=PROFILE, WARC_Refers_To=to))
                        continue
                    block = HTTP + chunked(row["payload"])
                    cuts = range(0, len(block), segment_bytes)
                    if len(cuts) == 1:
                        out.append(record("response", block, **common))
                        continue
                    for number, cut in enumerate(cuts, 1):
                        piece = block[cut : cut + segment_bytes]
                        if number == 1:
                            out.append(record("response", piece, **common, WARC_Segment_Number=1))
                            continue
                        total = len(block) if number == len(cuts) else None
                        out.append(
                            record(
                                "continuation",
                                piece,
                                WARC_Record_ID=_record_id(f"{page}#{number}"),
                                WARC_Segment_Origin_ID=common["WARC_Record_ID"],
                                WARC_Segment_Number=number,
                                WARC_Segment_Total_Length=total,
                            )
                        )
                yield record_batch(schema, [out])

    records = rows.join(first, "digest", "left").mapInArrow(recorded, "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write
    writer = writer.mode("overwrite").option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_RECORDS)
    writer.option("compression", "gzip").text(path)


FOUND = "record_id string, kind string, refers_to string, digest string, payload_bytes long, payload binary, problem string"


def _decoded(block: bytes, declared: str | None, payloads: bool) -> tuple:
    """Digest, length, payload and problem of a whole HTTP block."""
    try:
        payload = payload_of(block)
    except ValueError as error:
        return None, None, None, str(error)
    digest = hashlib.sha256(payload).hexdigest()
    problem = "payload digest differs" if declared and declared != digest else None
    return digest, len(payload), payload if payloads else None, problem


def _digest(value: str | None) -> str | None:
    return value.partition(":")[2] if value else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("content")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Logical records of all archives under ``path``.

    Returns ``record_id, kind, refers_to, digest, payload_bytes, payload, problem``: one row per record
    that is no continuation. ``payload`` is null unless ``payloads``. For revisits digest is
    the declared one, and length and payload are null. ``problem`` names missing or doubled
    segments, a wrong total length, broken framing or a wrong digest; such records have no
    payload, but for a wrong digest. Records written n times with all their segments are n rows.
    A file that is no WARC raises. No records give an empty result.

    Files are passed over twice: once for whole records, which are decoded at once, and once for
    segments, so that only those are shuffled.
    """
    whole_schema = pa.schema(
        [("record_id", pa.string()), ("kind", pa.string()), ("refers_to", pa.string()), ("digest", pa.string())]
        + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())]
    )
    segment_schema = pa.schema(
        [("record_id", pa.string()), ("kind", pa.string()), ("declared", pa.string()), ("number", pa.int64())]
        + [("total", pa.int64()), ("block", pa.binary())]
    )

    def whole(head: dict[str, str], block: bytes) -> tuple | None:
        if "warc-segment-number" in head:
            return None
        kind, declared = head["warc-type"], _digest(head.get("warc-payload-digest"))
        if kind == "revisit":
            return head["warc-record-id"], kind, head.get("warc-refers-to"), declared, None, None, None
        if kind == "response":
            return head["warc-record-id"], kind, None, *_decoded(block, declared, payloads)
        return None

    def segment(head: dict[str, str], block: bytes) -> tuple | None:
        if "warc-segment-number" not in head:
            return None
        origin = head.get("warc-segment-origin-id") or head["warc-record-id"]
        total = head.get("warc-segment-total-length")
        declared = _digest(head.get("warc-payload-digest"))
        return origin, head["warc-type"], declared, int(head["warc-segment-number"]), total and int(total), block

    def scan(row_of, schema: pa.Schema):
        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    out, size = [], 0
                    for head, block in parsed(batch.column(0)[row].as_py()):
                        if (found := row_of(head, block)) is not None:
                            out.append(found)
                            size += len(block)
                        if size > 8_000_000:
                            yield record_batch(schema, list(zip(*out, strict=True)))
                            out, size = [], 0
                    if out:
                        yield record_batch(schema, list(zip(*out, strict=True)))

        return scanned

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                kind, declared, total, numbers = "response", None, None, []
                blocks: dict[int, bytes] = {}
                for part in one["parts"]:
                    numbers.append(part["number"])
                    blocks[part["number"]] = part["block"]
                    if part["number"] == 1:
                        kind, declared = part["kind"], part["declared"]
                    total = part["total"] if part["total"] is not None else total
                copies = numbers.count(1) or 1
                block = b"".join(blocks[n] for n in sorted(blocks))
                if sorted(blocks) != list(range(1, len(blocks) + 1)) or total is None:
                    found = (None, None, None, "segments are missing")
                elif len(numbers) != copies * len(blocks):
                    found = (None, None, None, "segments are doubled")
                elif total != len(block):
                    found = (None, None, None, "total length differs")
                else:
                    found = _decoded(block, declared, payloads)
                for _ in range(copies):
                    yield record_batch(whole_schema, [[v] for v in (one["record_id"], kind, None, *found)])

    out = "record_id string, kind string, refers_to string, digest string, payload_bytes long, payload binary, problem string"
    parts = "record_id string, kind string, declared string, number long, total long, block binary"
    records = _files(spark, path).mapInArrow(scan(whole, whole_schema), out)
    segments = _files(spark, path).mapInArrow(scan(segment, segment_schema), parts)
    grouped = segments.groupBy("record_id").agg(
        F.collect_list(F.struct("number", "kind", "declared", "total", "block")).alias("parts")
    )
    return records.unionByName(grouped.mapInArrow(joined, out))


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of the response that a revisit refers to.

    ``problem`` of a revisit says if that response is missing or has another digest.
    """
    answers = (
        records.filter("kind = 'response' and problem is null")
        .select(F.col("record_id").alias("_to"), F.col("digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), F.col("payload").alias("_payload"))
        .dropDuplicates(["_to"])
    )
    revisit = F.col("kind") == "revisit"
    problem = (
        F.when(revisit & F.col("_to").isNull(), "refers to no response")
        .when(revisit & (F.col("digest") != F.col("_digest")), "refers to another payload")
        .otherwise(F.col("problem"))
    )
    return records.join(answers, records["refers_to"] == answers["_to"], "left").select(
        "record_id", "kind", "refers_to", "digest",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload", "_payload").alias("payload"),
        problem.alias("problem"),
    )


def page_key(record_id: str):
    """The key of a page from the identifier of its record; null if the page had none."""
    return F.regexp_extract(record_id, r"^<urn:page:(.*):[0-9a-f]{64}>$", 1)
