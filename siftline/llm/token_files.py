"""Token ids in binary files: independent zstandard frames, a trailing seek table, per-frame checksums.

A file is a sequence of zstandard frames, each holding the ids (little-endian, unsigned 32 bits) of
some whole documents, followed by two skippable frames: an index (for each document its id, its
number of ids and its frame) and a seek table as in the published seekable format (compressed and
raw size and checksum of every frame, then their number and the format's magic number). Plain
zstandard tools still decompress the file; this module's reader finds documents by the index and
decompresses only their frames, each checked against its checksum.

The corpus is dealt over files by ranges of doc_id, so ids run through the files in ascending
order. A task writes a file under a name of its own and returns it; only names returned by tasks
that succeeded enter the manifest, so files of lost or repeated attempts are never read.

Defined results: null text is empty, and an empty text is the end id alone; a null doc_id comes
first; rows that repeat a doc_id follow each other in the order of their texts; texts of any length
are encoded whole, and a document is never parted, so one longer than a frame is a frame of its own; all
rows of one doc_id are in one file; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, blocks_for, lists, scratch_dir, stored, text_or_empty
from .tokens import encoder

# Fixed values of the zstandard frame formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

FRAME_BYTES = 1 << 18
#: Words that a worker keeps: texts with many rare words cost most where these are asked for again (about 0.2 GB a worker at most).
CACHE_WORDS = 800_000
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u4"), ("frame", "<u4")])
MANIFEST = "file string, docs long, tokens long, min_doc_id long"


class FrameWriter:
    """Writes documents' ids to an open binary file."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.size = 0
        self.seeks: list[bytes] = []
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self.seeks)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        raw = b"".join(self.held)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.seeks.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zstd.compress(np.array(self.index, INDEX).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC - 1, len(index)) + index)
        table = b"".join(self.seeks) + struct.pack("<IBI", len(self.seeks), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class FrameReader:
    """Reads chosen documents from a file of FrameWriter; frames_read counts the frames that it decompressed."""

    def __init__(self, source):
        self.source, self.frames_read = source, 0
        size = source.seek(0, 2) or source.tell()
        frames, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the file's end")
        table = size - 9 - 12 * frames
        self.seeks = np.frombuffer(self.at(table, 12 * frames), "<u4").reshape(frames, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.seeks[:, 0].astype(np.int64))])
        magic, length = struct.unpack("<II", self.at(int(self.starts[-1]), 8))
        if magic != SKIPPABLE_MAGIC - 1:
            raise ValueError("no index before the seek table")
        self.index = np.frombuffer(zstandard.decompress(self.at(int(self.starts[-1]) + 8, length)), INDEX)
        before = np.cumsum(self.index["n"].astype(np.int64)) - self.index["n"]
        first = np.searchsorted(self.index["frame"], self.index["frame"])
        self.offsets = before - before[first] if len(before) else before

    def at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        got = self.source.read(length)
        if len(got) != length:
            raise ValueError("the file ends early")
        return got

    def frame(self, k: int) -> bytes:
        self.frames_read += 1
        packed, raw, check = map(int, self.seeks[k])
        data = zstandard.decompress(self.at(int(self.starts[k]), packed), max_output_size=raw)
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def read(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of the documents asked for, or of all, in the file's order."""
        want = np.ones(len(self.index), bool) if doc_ids is None else np.isin(self.index["doc_id"], list(doc_ids)) & (self.index["null"] == 0)
        k, data = -1, b""
        for i in np.flatnonzero(want):
            doc_id, null, n, frame = self.index[i].item()
            if frame != k:
                k, data = frame, self.frame(frame)
            at = int(self.offsets[i]) * 4
            yield None if null else doc_id, data[at : at + n * 4]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Local, HDFS and object stores alike, by the scheme of the shared folder's address."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, path: str, end_id: int, spaced: bool, folder: str | None = None, per_file: int = 1 << 14) -> DataFrame:
    """Tokenises docs into files of about per_file documents and returns the manifest: file, docs, tokens, min_doc_id, part."""
    spark = docs.sparkSession
    folder = f"{folder or scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, fs, name = encoder(path, spaced, CACHE_WORDS).encode, None, None, ""
        docs = tokens = 0
        first = None
        for ids, texts in lists(batches):
            if writer is None:
                fs, root = file_system(folder)
                fs.create_dir(root, recursive=True)
                name, first = f"{folder}/{uuid.uuid4().hex}.tok.zst", ids[0]
                writer = FrameWriter(fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None))
            for doc_id, text in zip(ids, texts, strict=True):
                got = encode(text) + end
                writer.add(doc_id, got)
                docs, tokens = docs + 1, tokens + len(got) // 4
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [docs], "tokens": [tokens], "min_doc_id": pa.array([first], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    files = blocks_for(rows.count(), per_file, 16)
    ordered = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = stored(ordered.mapInArrow(write, MANIFEST), "manifest")
    order = Window.orderBy(F.col("min_doc_id").asc_nulls_first(), "file")  # one row per file
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(manifest.withColumn("first", before.cast("long")).withColumn("part", F.row_number().over(order)), "manifest")


def read_token_files(manifest: DataFrame, derive: Callable[[bytes], tuple] | None = None, schema: str = "ids binary", files: Column | None = None, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and what derive(ids) gives, read from the files of a manifest; doc_ids limits what is decompressed."""
    derive = derive or (lambda ids: (ids,))
    spec = f"doc_id long, start long, n_tokens long, {schema}"
    kinds = arrow_schema(T._parse_datatype_string(spec))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, starts in lists(batches):
            for name, first in zip(names, starts, strict=True):
                fs, at = file_system(name)
                with fs.open_input_file(at) as source:
                    reader = FrameReader(source)
                    before = first + np.cumsum(reader.index["n"].astype(np.int64)) - reader.index["n"]
                    chosen = np.arange(len(reader.index)) if doc_ids is None else np.flatnonzero(np.isin(reader.index["doc_id"], doc_ids) & (reader.index["null"] == 0))
                    rows, held = [], 0
                    for i, (doc_id, ids) in zip(chosen, reader.read(doc_ids), strict=True):
                        rows.append((doc_id, int(before[i]), len(ids) // 4, *derive(ids)))
                        held += len(ids)
                        if held > 1 << 24 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], kinds.names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], kinds.names)

    chosen = (manifest if files is None else manifest.where(files)).select("file", "first")
    return chosen.repartition(max(1, min(manifest.count(), 4096)), "file").mapInArrow(read, spec)


def crc32(ids: bytes) -> tuple[int]:
    return (zlib.crc32(ids),)
