"""Token ids in seekable Zstandard files.

A file holds one or more independent frames per document (a long text gets several), a
skippable frame with the document index, and a last skippable frame with the seek table of
the public seekable format: compressed and decompressed size and the low 32 bits of XXH64 for
every frame. A reader opens the two tables at the end of the file and then decompresses only
the frames of the documents it was asked for.

Documents are written in ascending order of doc_id (NULL first; equal ids by text), one file
per range partition. NULL and empty texts hold only the end id. Repeated rows are written as
often as they occur, an empty table gives no files, extra columns are not read. Attempts of
tasks that were lost leave files that the manifest does not name.
"""

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsemill.llm.tokens import encoded, encoder

INDEX_MAGIC, TABLE_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS, END_ID = 1 << 20, 0

MANIFEST = ("file_no long, file string, n_docs long, n_tokens long, n_bytes long")


class FileWriter:
    """Frames one document after another into an output stream."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.table, self.docs, self.bytes = [], [], 0
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=False)

    def _put(self, data: bytes):
        self.out.write(data)
        self.bytes += len(data)

    def add(self, doc_id, ids: np.ndarray):
        ids = ids.astype("<u2" if self.width == 2 else "<u4")
        self.docs.append((doc_id, len(ids), len(self.table)))
        for at in range(0, len(ids), FRAME_IDS):
            raw = ids[at:at + FRAME_IDS].tobytes()
            frame = self.zstd.compress(raw)
            self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self._put(frame)

    def close(self):
        known = np.array([d is not None for d, _, _ in self.docs], np.uint8)
        body = self.zstd.compress(b"".join((
            np.array([d or 0 for d, _, _ in self.docs], "<i8").tobytes(), known.tobytes(),
            np.array([n for _, n, _ in self.docs], "<i8").tobytes(),
            np.array([f for _, _, f in self.docs], "<u4").tobytes())))
        index = struct.pack("<IQ", self.width, len(self.docs)) + body
        # the index is a frame of its own, with nothing to decompress, so that a plain reader
        # of the seekable format finds the right offsets
        self.table.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        rows = np.array(self.table, "<u4").reshape(-1, 3).tobytes()
        foot = struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self._put(struct.pack("<II", TABLE_MAGIC, len(rows) + len(foot)) + rows + foot)


class FileReader:
    """Random access to the documents of one file (anything with size, seek and read)."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("not a seekable token file")
        rows = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3)
        self.sizes, self.raw, self.sums = (rows[:, i].astype(np.int64) for i in range(3))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        index = self._at(int(self.offsets[-2]) + 8, int(self.sizes[-1]) - 8)
        self.width, docs = struct.unpack("<IQ", index[:12])
        body = zstandard.ZstdDecompressor().decompress(index[12:], max_output_size=21 * docs + 1)
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        self.known = np.frombuffer(body, np.uint8, docs, 8 * docs).astype(bool)
        self.lengths = np.frombuffer(body, "<i8", docs, 9 * docs)
        self.first = np.append(np.frombuffer(body, "<u4", docs, 17 * docs), n - 1).astype(np.int64)

    def _at(self, offset, n) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def ids(self, i: int, data: bytes = None, start: int = 0) -> np.ndarray:
        """Ids of the i-th document as uint32, from the file or from its part `data` at `start`."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        if data is None:
            start = int(self.offsets[a])
            data = self._at(start, int(self.offsets[b]) - start)
        out, at = [], int(self.offsets[a]) - start
        for f in range(a, b):
            raw = self.zstd.decompress(
                data[at:at + int(self.sizes[f])], max_output_size=int(self.raw[f]) + 1)
            at += int(self.sizes[f])
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[f]:
                raise ValueError(f"frame {f} is damaged")
            out.append(np.frombuffer(raw, "<u2" if self.width == 2 else "<u4"))
        return np.concatenate(out).astype("<u4")

    def span(self, lo: int, hi: int) -> list:
        """Ids of the documents lo to hi - 1, with one read."""
        start, end = (int(self.offsets[self.first[i]]) for i in (lo, hi))
        data = self._at(start, end - start)
        return [self.ids(i, data, start) for i in range(lo, hi)]

    def find(self, doc_id) -> list:
        """Ids of every document with this doc_id; only their frames are read."""
        lo, hi = (np.searchsorted(self.doc_ids[self.known], doc_id, s) for s in ("left", "right"))
        skip = int((~self.known).sum())
        return [self.ids(skip + i) for i in range(lo, hi)]


def filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write all documents below `root`; returns the manifest, one row per file."""
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", "text"))

    def write(batches):
        where, base = filesystem(root)
        enc = encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], "<u4")
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}.zst"
        out = writer = None
        tokens = 0
        for b in batches:
            for doc_id, data in encoded(enc, b):
                if writer is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                    writer = FileWriter(out, width)
                ids = np.concatenate([np.frombuffer(data, "<u4"), end])
                writer.add(doc_id, ids)
                tokens += len(ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "file_no": pa.array([number], pa.int64()), "file": [name],
                "n_docs": pa.array([len(writer.docs)], pa.int64()),
                "n_tokens": pa.array([tokens], pa.int64()),
                "n_bytes": pa.array([writer.bytes], pa.int64())})

    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{root}/manifest")
    return docs.sparkSession.read.parquet(f"{root}/manifest")


def read_token_files(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, the
    ids, of every document in the files that the manifest names."""
    base = F.sum("n_tokens").over(Window.orderBy("file_no")) - F.col("n_tokens")
    files = spark.read.parquet(f"{root}/manifest").select("file", base.alias("base"))

    def read(batches):
        where, top = filesystem(root)
        for b in batches:
            for name, at in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with where.open_input_file(f"{top}/{name}") as source:
                    r = FileReader(source)
                    starts = at + np.cumsum(r.lengths) - r.lengths
                    step = max(1, int(2_000_000 / max(1, r.lengths.mean()))) if len(r.lengths) else 1
                    for lo in range(0, len(r.lengths), step):
                        part = range(lo, min(lo + step, len(r.lengths)))
                        ids = r.span(lo, part.stop)
                        cols = {
                            "doc_id": pa.array(r.doc_ids[lo:part.stop], pa.int64(), mask=~r.known[lo:part.stop]),
                            "start": pa.array(starts[lo:part.stop], pa.int64()),
                            "n_tokens": pa.array(r.lengths[lo:part.stop], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())}
                        if with_ids:
                            cols["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # A number of tasks that small rows do not reduce: each of them reads a file.
    return files.repartition(max(1, files.count())).mapInArrow(read, schema)


def read_documents(spark: SparkSession, root: str, doc_ids: list) -> pd.DataFrame:
    """The ids of a few documents; of each file only the tables and their frames are read."""
    files = spark.read.parquet(f"{root}/manifest").select("file")
    wanted = sorted({int(d) for d in doc_ids})

    def read(batches):
        where, top = filesystem(root)
        for b in batches:
            for name in b.column("file").to_pylist():
                with where.open_input_file(f"{top}/{name}") as source:
                    r = FileReader(source)
                    for d in wanted:
                        for ids in r.find(d):
                            yield pa.RecordBatch.from_pydict({
                                "doc_id": pa.array([d], pa.int64()),
                                "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})

    return files.mapInArrow(read, "doc_id long, ids array<int>")
