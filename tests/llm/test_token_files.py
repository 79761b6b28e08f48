import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from depotlens.llm import textnum as X
from depotlens.llm.bytebpe import Encoder
from depotlens.llm.op13_token_files import op13_token_files, read_tokens, write_tokens
from depotlens.llm.tokenfile import FileReader, FileWriter, manifest

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start long, n_tokens string"
PARTS = [" ", " ", "\n", "\t", "  ", "a", "the", "Word", "é", "ß", "×", "÷", "ǅ", "9", "42", ".", ",", "!", "'", "'s", "'ll", "\"", "-", " ", "　", "\u0085", " ",
         "​", "\x1c", "\x1f", "\x00", "\x7f", "日本", "Привет", "😀", "…", "—", "<|endoftext|>", "<|", "|>", "\r\n", "\x0b", "½", "²", "_", "x" * 70, "İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, docs):
    """(doc_id, start, ids) by the library, whole texts one by one."""
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)).astype(np.int64)))
    out, at = [], 0
    for i, text in order:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, at, ids))
        at += len(ids)
    return out


def test_pieces_encode_as_whole_texts(library):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS if k % 4 == 0 else [p for p in PARTS if p != "<|endoftext|>"]) for _ in range(r.randint(0, 14))) for k in range(6000)]
    encoder = Encoder(PATH, 0)
    for limit in (40, 1 << 20):  # few texts at once, then all with a warm cache
        got = []
        for _, _, buf, off in X.chunks(pa.array(texts, pa.large_string()), limit):
            ids, counts = encoder.encode(buf, off)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_cache_is_bounded(monkeypatch, library):
    from depotlens.llm import bytebpe
    monkeypatch.setattr(bytebpe, "SLOTS", 1 << 10)
    encoder = Encoder(PATH, 0)
    for k in range(20):
        text = " ".join(f"w{k}x{i}" for i in range(40))
        buf = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(buf, np.array([0, len(buf)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids + [0]
        assert encoder.cache.entries <= 1 << 10


def test_cases(spark, tmp_path, library):
    docs = [(5, "five"), (None, "no id"), (None, None), (2, None), (2, "two"), (2, "two again"), (1, ""), (9, "x" * 70_000 + " tail"), (8, "eight words are in this very text, no?"), (8, "eight words are in this very text, no?"),
            (-4, "minus <|endoftext|> four"), (7, "long text " * 60_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], SCHEMA)
    path = f"{tmp_path}/t"
    write_tokens(df, path, files=3, frame_bytes=4096)
    want = expected(library, docs)
    got = sorted((tuple(r) for r in read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [(i, s, n, ids) for i, s, n, ids in got] == [(i, s, len(ids), ids) for i, s, ids in want]
    digests = sorted((tuple(r) for r in read_tokens(spark, f"file://{path}", digest=True).collect()), key=lambda r: r[1])
    assert digests == [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in want]
    some = sorted((tuple(r) for r in read_tokens(spark, path, doc_ids=[8, 1, 77]).collect()), key=lambda r: r[1])
    assert some == [(i, s, len(ids), ids) for i, s, ids in want if i in (1, 8)]
    with pytest.raises(Exception, match="overwrite"):
        write_tokens(df, path)


def test_no_rows(spark, tmp_path):
    write_tokens(spark.createDataFrame([], SCHEMA), f"{tmp_path}/t")
    assert read_tokens(spark, f"{tmp_path}/t").count() == 0 and manifest(f"{tmp_path}/t") == []


def test_format_and_partial_reads(tmp_path):
    counts = np.array([10, 0, 5000, 3, 100_000, 1])
    ids = np.random.default_rng(1).integers(0, 50_000, counts.sum()).astype(np.uint32)
    name = f"{tmp_path}/f.zst"
    writer = FileWriter(pa.OSFile(name, "wb"), 2, frame_bytes=2048)
    writer.add(pa.array([3, None, 5, 6, 7, 8], pa.int64()), ids, counts)
    writer.close()
    raw = open(name, "rb").read()
    # any zstandard decoder reads the frames in turn and skips index and table
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == ids.astype("<u2").tobytes()
    reader = FileReader(pa.OSFile(name))
    (group, got), = reader.documents(np.array([3, 5]))
    assert got.tolist() == ids[[*range(5010, 5013), 105013]].tolist() and reader.decompressed == 2 < len(reader.frames)
    at = int(reader.frame_begin[0]) + 40
    open(name, "wb").write(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:])
    with pytest.raises(Exception):
        list(FileReader(pa.OSFile(name)).documents(np.array([0])))


def test_huge_document_spans_frames(tmp_path, monkeypatch):
    from depotlens.llm import tokenfile
    monkeypatch.setattr(tokenfile, "MOST_FRAME_BYTES", 1 << 12)
    ids = np.arange(9000, dtype=np.uint32)
    writer = FileWriter(pa.OSFile(f"{tmp_path}/f", "wb"), 4, frame_bytes=1 << 10)
    writer.add(pa.array([1, 2]), ids, np.array([8000, 1000]))
    writer.close()
    reader = FileReader(pa.OSFile(f"{tmp_path}/f"))
    assert len(reader.frames) > 8 and np.concatenate([x for _, x in reader.documents(np.arange(2))]).tolist() == ids.tolist()


def test_query(spark, library):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in expected(library, docs)]
    assert sorted((tuple(r) for r in op13_token_files(spark, path).collect()), key=lambda r: r[1]) == want
