import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from offsetlake.llm import warc


@given(st.binary(max_size=5000), st.integers(1, 700))
def test_chunks_round_trip(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.payload_of(warc.HTTP + warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("body", [b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"", b"3\r\nabc"])
def test_broken_chunks_are_refused(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)


def test_chunk_extensions_are_skipped():
    assert warc.unchunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


def test_records_in_a_file_round_trip():
    blocks = [b"", b"x" * 10, b"WARC/1.1\r\n\r\n\r\nabc\r\n\r\n"]
    data = b"".join(warc.record("response", b, WARC_Record_ID=i) + warc.END for i, b in enumerate(blocks))
    assert [(int(f["warc-record-id"]), b) for f, b in warc.parsed(data)] == list(enumerate(blocks))
    with pytest.raises(ValueError):
        list(warc.parsed(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.parsed(b"junk" + data))


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def rows_of(spark, frame, path, **options):
    warc.write_archives(frame, path, **options)
    return warc.resolved(warc.read_archives(spark, path)).collect()


def test_pages_round_trip(spark, path):
    draw = random.Random(8)
    rows = [(i, f"http://h/{i}", "".join(draw.choices("abé\r\n<>", k=draw.choice([0, 1, 99, 100, 5000])))) for i in range(80)]
    rows += [(100 + i, "u", "same page of more than a hundred bytes " * 5) for i in range(30)]
    rows += [(7000, "u\r\nX: y", None), (7001, None, ""), (7002, "u", "short"), (7003, "u", "short")]
    got = rows_of(spark, pages(spark, rows).repartition(4), path(), segment_bytes=700)
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    first = {}
    for page, _, html in rows:
        first[html or ""] = min(first.get(html or "", page), page)
    html = {page: h or "" for page, _, h in rows}
    for r in got:
        page = int(r.record_id.split(":")[2])
        body = html[page].encode()
        assert (r.payload_bytes, bytes(r.payload), r.digest) == (len(body), body, hashlib.sha256(body).hexdigest())
        revisit = len(body) >= 100 and first[html[page]] != page
        assert r.kind == ("revisit" if revisit else "response")
        assert (r.refers_to is not None) == revisit
        if revisit:
            assert int(r.refers_to.split(":")[2]) == first[html[page]]


def test_repeated_and_null_keys(spark, path):
    long = "a page that is longer than a hundred bytes, so that copies of it are revisits " * 20
    rows = [(1, "u", long), (1, "u", long), (1, "u", "other"), (None, "u", long), (None, "u", "x"), (2, "u", long)]
    got = rows_of(spark, pages(spark, rows), path(), segment_bytes=500)
    assert sorted((r.kind, r.payload_bytes) for r in got) == sorted(
        [("response", len(long))] * 2 + [("response", 5), ("response", 1)] + [("revisit", len(long))] * 2
    )
    assert all(r.problem is None for r in got)


def test_lost_and_wrong_segments_are_named(spark, path):
    def segments(name, total, numbers, block=b"x" * 50):
        for n in numbers:
            fields = {"WARC_Segment_Number": n, "WARC_Segment_Total_Length": total if n == max(numbers) else None}
            if n == 1:
                yield warc.record("response", block, WARC_Record_ID=name, **fields)
            else:
                yield warc.record("continuation", block, WARC_Record_ID=f"{name}{n}", WARC_Segment_Origin_ID=name, **fields)

    whole = warc.HTTP + warc.chunked(b"payload" * 10)
    parts = [*segments("gap", 150, [1, 3]), *segments("length", 99, [2, 1]), *segments("open", None, [1, 2])]
    parts += [warc.record("response", whole[:-9], WARC_Record_ID="cut")]
    parts += [warc.record("response", whole, WARC_Record_ID="digest", WARC_Payload_Digest="sha256:00")]
    parts += [warc.record("revisit", warc.HTTP, WARC_Record_ID="lost", WARC_Refers_To="nobody")]
    parts += [warc.record("metadata", b"m", WARC_Record_ID="skipped")]
    data = b"".join(p + warc.END for p in parts)
    clean = path()
    stripped = data.removesuffix(warc.END).decode()
    spark.createDataFrame([(stripped,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(clean)
    got = {r.record_id: r.problem for r in warc.resolved(warc.read_archives(spark, clean)).collect()}
    assert got == {
        "gap": "segments are missing",
        "length": "total length differs",
        "open": "segments are missing",
        "cut": "chunk of another length than it says",
        "digest": "payload digest differs",
        "lost": "refers to no response",
    }


def test_empty(spark, path):
    assert rows_of(spark, pages(spark, []), path()) == []
