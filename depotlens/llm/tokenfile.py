"""Token files: a Spark data source ``token_file`` of seekable zstandard files.

A file holds the token ids of whole documents, one after another, as
little-endian unsigned integers, cut into independent zstandard frames (each
with its content checksum).  Behind them come two skippable frames: the
document index (ids and lengths, compressed, with a CRC-32) and, last, the seek
table of the public seekable format: compressed size, decompressed size and
low 32 bits of XXH64 of every frame, then frame count, descriptor and magic.
A reader takes the tail of a file, looks up the documents it wants and
decompresses only the frames that hold them.

Writing: every task writes one file under a name of its own; the names that
count are those in ``_manifest.json``, which the driver writes last, when all
tasks have reported.  A task that runs again writes another file, so a lost
executor or a crash before the manifest leaves no half-written data set.
"""
from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# fixed values of the public seekable format
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

FRAME_BYTES = 1 << 18
MOST_FRAME_BYTES = 1 << 26
MANIFEST = "_manifest.json"
READ_IDS = 1 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A local path or any URI that Arrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


class FileWriter:
    """Writes one file; documents come whole, in batches."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.open, self.open_bytes = [], 0
        self.ids, self.counts = [], []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.counts.append(counts)
        data = memoryview(ids.astype(f"<u{self.width}").tobytes())
        at = 0
        for end in (np.cumsum(counts) * self.width).tolist():
            # a frame ends with a document, unless that document is huge
            while end - at + self.open_bytes > MOST_FRAME_BYTES:
                cut = at + (MOST_FRAME_BYTES - self.open_bytes)
                self._push(data[at:cut])
                at = cut
                self._frame()
            if end - at + self.open_bytes >= self.frame_bytes:
                self._push(data[at:end])
                at = end
                self._frame()
        self._push(data[at:])

    def _push(self, piece) -> None:
        if len(piece):
            self.open.append(bytes(piece))
            self.open_bytes += len(piece)

    def _frame(self) -> None:
        import xxhash
        if self.open_bytes:
            raw = b"".join(self.open)
            packed = self.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.open_bytes = [], 0

    def close(self) -> None:
        self._frame()
        ids = pa.chunked_array(self.ids, pa.int64()).combine_chunks() if self.ids else pa.array([], pa.int64())
        known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
        counts = np.concatenate([np.zeros(0, np.int64), *self.counts])
        body = self.compress(ids.fill_null(0).to_numpy().astype("<i8").tobytes() + counts.astype("<i8").tobytes() + known.tobytes())
        body = struct.pack("<QBI", len(counts), self.width, zlib.crc32(body)) + body
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.frames.append((len(body) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)
        self.out.close()


class FileReader:
    """Index of one file, and the ids of chosen documents."""

    def __init__(self, source):
        import zstandard
        self.source, size = source, source.size()
        unpack = zstandard.ZstdDecompressor()
        self.unpack = unpack.decompress
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * frames, 12 * frames)
        sizes = np.frombuffer(table, "<u4").reshape(frames, 3).astype(np.int64)
        begin = np.cumsum(sizes[:, 0]) - sizes[:, 0]
        head, body = begin[-1] + 8, sizes[-1, 0] - 8
        body = self._at(int(head), int(body))
        n, self.width, crc = struct.unpack_from("<QBI", body)
        if zlib.crc32(body[13:]) != crc:
            raise ValueError("the document index is damaged")
        body = self.unpack(body[13:])
        self.doc_ids = pa.array(np.frombuffer(body, "<i8", n), mask=np.frombuffer(body, np.uint8, n, 16 * n) == 0)
        self.counts = np.frombuffer(body, "<i8", n, 8 * n)
        self.start = np.cumsum(self.counts) - self.counts  # in ids, within the file
        self.frames = sizes[:-1]
        self.frame_begin = begin[:-1]
        self.frame_ids = np.concatenate([[0], np.cumsum(self.frames[:, 1] // self.width)])
        self.decompressed = 0

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, i: int) -> np.ndarray:
        import xxhash
        raw = self.unpack(self._at(int(self.frame_begin[i]), int(self.frames[i, 0])), max_output_size=int(self.frames[i, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        self.decompressed += 1
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of documents, their ids one after another), in order, in
        groups of about READ_IDS ids; frames without a chosen document stay
        packed, and each needed one is unpacked once."""
        lo = 0
        last, data = -1, None
        while lo < len(chosen):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(self.counts[chosen[lo:lo + READ_IDS]]), READ_IDS)))
            group, parts = chosen[lo:hi], []
            for d in group.tolist():
                at, end = int(self.start[d]), int(self.start[d] + self.counts[d])
                f = int(np.searchsorted(self.frame_ids, at, side="right")) - 1
                while at < end:
                    if f != last:
                        last, data = f, self.frame(f)
                    base, upto = int(self.frame_ids[f]), min(end, int(self.frame_ids[f + 1]))
                    parts.append(data[at - base:upto - base])
                    at, f = upto, f + 1
            yield group, np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            lo = hi


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    n_docs: int
    n_tokens: int
    low: int | None
    high: int | None
    nulls: int


class TokenWriter(DataSourceArrowWriter):
    """Encodes and writes the rows (doc_id long, text string) of each task in
    the order they come."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.tokenizer, self.end_id = options["tokenizer"], int(options.get("end_id", 0))
        self.frame_bytes, self.level = int(options.get("frame_bytes", FRAME_BYTES)), int(options.get("level", 3))
        self.chunk = int(options.get("chunk_bytes", 1 << 20))
        files, path = file_system(self.path)
        if not overwrite and files.get_file_info(f"{path}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} holds a token data set; overwrite it or choose another path")
        files.create_dir(path, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from .textnum import chunks, text_column
        encoder = worker_encoder(self.tokenizer, self.end_id)
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex[:16]}.zst"
        files, path = file_system(self.path)
        writer, docs, tokens, nulls, low, high = None, 0, 0, 0, None, None
        for b in batches:
            ident = b.column(b.schema.get_field_index("doc_id")).cast(pa.int64())
            for lo, hi, buf, off in chunks(text_column(b, "text"), self.chunk):
                writer = writer or FileWriter(files.open_output_stream(f"{path}/{name}", compression=None), encoder.width, self.frame_bytes, self.level)
                ids, counts = encoder.encode(buf, off)
                some = ident.slice(lo, hi - lo)
                writer.add(some, ids, counts)
                docs, tokens, nulls = docs + hi - lo, tokens + len(ids), nulls + some.null_count
                known = [x for x in (some.drop_null().to_numpy(),) if len(x)]
                for x in known:
                    low, high = min(int(x.min()), x.min() if low is None else low), max(int(x.max()), x.max() if high is None else high)
        if writer is None:
            return Written(part, "", 0, 0, None, None, 0)
        writer.close()
        return Written(part, name, docs, tokens, None if low is None else int(low), None if high is None else int(high), nulls)

    def commit(self, messages: list[Written]) -> None:
        parts = sorted((m for m in messages if m and m.file), key=lambda m: m.part)
        files, path = file_system(self.path)
        body = json.dumps({"parts": [vars(m) for m in parts]}).encode()
        with files.open_output_stream(f"{path}/{MANIFEST}.new") as out:
            out.write(body)
        files.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")

    def abort(self, messages: list[Written]) -> None:
        files, path = file_system(self.path)
        for m in messages:
            if m and m.file:
                files.delete_file(f"{path}/{m.file}")


@dataclass
class Part(InputPartition):
    file: str
    start: int


def manifest(path: str) -> list[dict]:
    files, at = file_system(path.rstrip("/"))
    with files.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())["parts"]


class TokenReader(DataSourceReader):
    """One task per file; with ``doc_ids`` only files, and frames of them, that
    hold a requested document are read."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.digest = options.get("digest", "false").lower() == "true"
        wanted = options.get("doc_ids")
        self.wanted = None if wanted is None else sorted({int(x) for x in wanted.split(",") if x.strip()})

    def partitions(self) -> list[Part]:
        out, start = [], 0
        for m in manifest(self.path):
            if self.wanted is None or m["low"] is not None and any(m["low"] <= w <= m["high"] for w in self.wanted):
                out.append(Part(m["file"], start))
            start += m["n_tokens"]
        return out or [Part("", 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        files, path = file_system(self.path)
        with files.open_input_file(f"{path}/{part.file}") as source:
            reader = FileReader(source)
            chosen = np.arange(len(reader.counts))
            if self.wanted is not None:
                ids = reader.doc_ids.fill_null(0).to_numpy()
                chosen = chosen[np.isin(ids, self.wanted) & reader.doc_ids.is_valid().to_numpy(zero_copy_only=False)]
            for group, ids in reader.documents(chosen):
                counts = reader.counts[group]
                cols = [reader.doc_ids.take(pa.array(group)), pa.array(part.start + reader.start[group]), pa.array(counts)]
                if self.digest:
                    raw, ends = memoryview(ids.astype("<u4").tobytes()), [0, *(4 * np.cumsum(counts)).tolist()]
                    cols.append(pa.array([zlib.crc32(raw[a:z]) for a, z in zip(ends, ends[1:])], pa.int64()))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32" if self.digest else "ids"])


class TokenFileSource(DataSource):
    """``df.write.format("token_file")`` of (doc_id, text) and
    ``spark.read.format("token_file")`` of (doc_id, start, n_tokens, ids).

    Write options: tokenizer (file of the tokenizers library), end_id (0),
    frame_bytes, level, chunk_bytes.  Read options: doc_ids (comma-separated),
    digest (ids_crc32 instead of the ids)."""

    @classmethod
    def name(cls) -> str:
        return "token_file"

    def schema(self) -> str:
        last = "ids_crc32 long" if self.options.get("digest", "false").lower() == "true" else "ids array<int>"
        return f"doc_id long, start long, n_tokens long, {last}"

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options), overwrite)


_ENCODERS: dict = {}


def worker_encoder(path: str, end_id: int):
    """One encoder per worker and tokenizer; its cache serves later tasks."""
    from .bytebpe import Encoder
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]
