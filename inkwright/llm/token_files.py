"""Token-ID output: independent zstandard frames with a trailing seek table and checksums.

A file holds the ids of documents in ascending doc_id order as little-endian unsigned 32-bit
integers. It is a plain zstandard stream:

* data frames, each compressed on its own, cut at document ends once FRAME_IDS ids are waiting
  (a longer document is cut into several frames);
* a skippable frame with the index of documents: their ids, token counts, and which ids are null;
* a skippable frame with the seek table of the public seekable format: compressed size,
  decompressed size and the low 32 bits of the xxh64 of each frame's content.

A reader takes the two tables from the end of the file, then decompresses only the frames that
hold the documents it was asked for, and checks each frame against its checksum.

Null text is an empty document (the end id alone). Documents with the same doc_id stay apart, in the
order of their texts; a null doc_id comes first and is kept as null. An empty table gives no file. Other
columns are ignored. Files are written under a temporary name and renamed, so a task that is run
again after the loss of an executor leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, small_batches, tidy, written
from .tokens import END_ID, encoder

FRAME_IDS = 1 << 16
_INDEX_MAGIC, _SEEK_MAGIC, _SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_END = np.asarray([END_ID], "<u4").tobytes()


def _open(uri: str):
    """Any store that Arrow knows (file, s3, gs, hdfs), so that driver and executors see the same files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FrameWriter:
    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level)
        self.waiting, self.size, self.frames, self.docs = [], 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((0 if doc_id is None else doc_id, len(ids) // 4, doc_id is None))
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= 4 * FRAME_IDS:
            data = b"".join(self.waiting)
            for at in range(0, len(data), 16 * FRAME_IDS):
                self._frame(data[at : at + 16 * FRAME_IDS])
            self.waiting, self.size = [], 0

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.waiting:
            self._frame(b"".join(self.waiting))
        index = self.zstd.compress(np.asarray(self.docs, "<i8").T.tobytes())
        self.out.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        table = np.asarray(self.frames, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Reads documents by their position in the file; only the frames that hold them are decompressed."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(source.size() - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        at = source.size() - 9 - 12 * n
        source.seek(at)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(table[:, 1])])
        source.seek(int(self.packed[-1]))
        _, size = struct.unpack("<II", source.read(8))
        self.doc_ids, self.counts, self.null_ids = np.frombuffer(self.zstd.decompress(source.read(size)), "<i8").reshape(3, -1)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.held = (-1, b"")

    def _frame(self, k: int) -> bytes:
        import xxhash

        if self.held[0] != k:
            self.source.seek(int(self.packed[k]))
            data = self.zstd.decompress(self.source.read(int(self.packed[k + 1] - self.packed[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.held = (k, data)
        return self.held[1]

    def ids(self, position: int) -> bytes:
        begin, end = 4 * int(self.starts[position]), 4 * int(self.starts[position + 1])
        parts, k = [], int(np.searchsorted(self.plain, begin, "right")) - 1
        while begin < end:
            data, base = self._frame(k), int(self.plain[k])
            parts.append(data[begin - base : end - base])
            begin, k = base + len(data), k + 1
        return b"".join(parts)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str) -> DataFrame:
    """Write every document's ids below `path`; returns the manifest (part, file, docs, tokens), kept there too."""
    spark = docs.sparkSession
    small_batches(spark)

    @tidy
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, store, writer = encoder(tokenizer_path), None, None
        part = TaskContext.get().partitionId()
        name = f"ids-{part:06d}.zst"
        for batch in batches:
            for doc_id, null, ids in zip(batch["doc_id"], batch["null_id"], enc.encode_all(batch["text"])):
                if writer is None:
                    store, top = _open(path)
                    store.create_dir(top, recursive=True)
                    temporary = f"{top}/.{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                    writer = FrameWriter(out)
                writer.add(None if null else int(doc_id), ids + _END)
        if writer is not None:
            writer.close()
            out.close()
            store.move(temporary, f"{top}/{name}")
            yield pd.DataFrame({"part": [part], "file": [name], "docs": [len(writer.docs)], "tokens": [sum(n for _, n, _ in writer.docs)]})

    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.desc("null_id"), "text")
    manifest = rows.mapInPandas(write, "part int, file string, docs long, tokens long")
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, all from the files themselves."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _open(path)
        for batch in batches:
            for file, first in zip(batch["file"], batch["first"]):
                with store.open_input_file(f"{top}/{file}") as source:
                    reader = FrameReader(source)
                    for at in range(0, len(reader.counts), 10_000):
                        span = range(at, min(at + 10_000, len(reader.counts)))
                        ids = zip(reader.doc_ids[at : at + 10_000].tolist(), reader.null_ids[at : at + 10_000])
                        yield pd.DataFrame({
                            "doc_id": pd.array([None if null else x for x, null in ids], "Int64"),
                            "start": reader.starts[at : at + len(span)] + int(first),
                            "n_tokens": reader.counts[at : at + len(span)],
                            "ids_crc32": [zlib.crc32(reader.ids(k)) for k in span],
                        })

    # One row per file, so the running sum over all files is small.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("first")).repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = scratch(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, path, tokenizer_path)
    return written(read_token_files(manifest, path), "token-index")
