import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offsetlake.llm import token_files
from offsetlake.llm.common import Work
from offsetlake.llm.queries import tokenizer_path
from tests.llm.hard import documents, hard_rows

ODD = ["AΣ b́ c", "<|endoftext|> x<|endoftext|>y", "don't  WE'LL\t\x0bΑΣ ΣΑΣ.", "é x\x1cy\x85z", "", "\n", "İ ǅ ﬁ ½ 1234 !!!??? '' 's"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 32), st.integers(0, 100), st.integers(0, 2**32))
def test_bits_round_trip(width, count, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << width, count).astype(np.uint32)
    data = token_files.packed(ids, width)
    assert len(data) == -(-count * width // 8)
    assert (token_files.unpacked(data, width, count) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_encode_as_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ODD
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids, counts = token_files.encoder(tokenizer_path()).encode(texts)
    cuts = np.split(ids, np.cumsum(counts)[:-1])
    for text, got in zip(texts, cuts, strict=True):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_random_access_reads_only_the_blocks_needed():
    ids = np.random.default_rng(0).integers(0, 1 << 17, 1000).astype(np.uint32)
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = token_files.PackedWriter(sink, 17, block_ids=64)
    lengths = np.array([300, 0, 1, 699])
    writer.add(pa.array([1, 2]), ids[:300], lengths[:2])
    writer.add(pa.array([None, 4]), ids[300:], lengths[2:])
    writer.close()

    class Counted:
        def __init__(self, data):
            self.data, self.read = data, 0

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            self.read += n
            return self.data[at : at + n]

    source = Counted(sink.getvalue())
    file = token_files.PackedFile(source)
    assert file.keys.to_pylist() == [1, 2, None, 4] and file.lengths.tolist() == lengths.tolist()
    for start, count in [(0, 1000), (63, 2), (999, 1), (128, 64), (5, 0)]:
        source.read = 0
        assert (file.ids(start, count) == ids[start : start + count]).all()
        assert source.read <= (count // 64 + 2) * 64 * 17 // 8


def test_packed_documents(spark, tokenizer):
    rows = [(i * 3 % 101, f"text {i} " + ODD[i % len(ODD)] * (i % 9), "en", "s") for i in range(101)]
    got = token_files.packed_documents(documents(spark, rows).repartition(3), tokenizer_path(), 1).collect()
    assert len(got) == len(rows)
    start = 0
    texts = {r[0]: r[1] for r in rows}
    for r in sorted(got, key=lambda r: r.key):
        ids = [*tokenizer.encode(texts[r.key], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_several_files_and_ids(spark, tokenizer, path):
    rows = [(i, "some words here " * (i % 7), "en", "s") for i in range(60)]
    frame = documents(spark, rows)
    work = Work(spark, "test")
    files = work.keep(token_files.write_packed(frame, path(), tokenizer_path(), 1, file_ids=40, block_ids=8), "files")
    found = token_files.read_packed(files, frame.schema["doc_id"].dataType, with_ids=True).collect()
    for r in found:
        assert r.ids == [*tokenizer.encode(rows[r.key][1], add_special_tokens=False).ids, 1]


def test_separator_scan_over_block_boundaries(spark, path):
    separator = 9
    draw = np.random.default_rng(1)
    place, rows, wanted = path(), [], []
    fs, root = token_files.file_system(place)
    fs.create_dir(root, recursive=True)
    cases = [draw.choice([1, 2, 3, 9], 200), np.array([9, 9, 9]), np.array([1, 2]), np.array([9]), np.array([1] * 50 + [9]), np.array([], int)]
    for i, ids in enumerate(cases):
        with fs.open_output_stream(f"{root}/{i}") as out:
            out.write(ids.astype("<u2").tobytes())
        rows.append((f"{place}/{i}", len(ids), 2))
        start = 0
        for at in [*np.flatnonzero(ids == separator).tolist(), len(ids)]:
            if at < len(ids) or start < at:
                number = sum(w[0] == rows[-1][0] for w in wanted)
                wanted.append((rows[-1][0], number, start, at - start, at < len(ids)))
            start = at + 1
    files = spark.createDataFrame(rows, "path string, ids long, width int")
    for block_bytes in (2, 6, 14, 1 << 20):
        got = token_files.scan_flat(files, separator, block_bytes).collect()
        assert sorted(map(tuple, got)) == sorted(wanted)
    listed = files.union(files).selectExpr("*", "1 AS n", "2 AS block", "'x' AS places", "true AS final")
    found = token_files.scan_flat(listed, separator, 14)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    # The scan over a file's blocks sees no places of separators.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,block:bigint,n:bigint,top:bigint>" in plan
    assert token_files.scan_flat(files.limit(0), separator).collect() == []


def test_scanned_documents(spark, tokenizer):
    tokenizer.encode_special_tokens = True
    rows = hard_rows() + [(50 + i, t, "en", "s") for i, t in enumerate(ODD)]
    got = token_files.scanned_documents(documents(spark, rows), tokenizer_path(), 49407).collect()
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    sort = lambda pairs: sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    assert sort((r.key, r.n_tokens) for r in got) == sort((k, count(t)) for k, t, _, _ in rows)


def test_hard_rows(spark, tokenizer):
    frame = documents(spark, hard_rows())
    got = token_files.packed_documents(frame, tokenizer_path(), 1).collect()
    assert len(got) == len(hard_rows())
    order = sorted(got, key=lambda r: r.start)
    keys = [r.key for r in order]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]
    assert token_files.packed_documents(frame.limit(0), tokenizer_path(), 1).collect() == []
    assert token_files.scanned_documents(frame.limit(0), tokenizer_path(), 49407).collect() == []
