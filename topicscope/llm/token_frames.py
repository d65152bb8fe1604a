"""Token-id files of independent zstandard frames with a trailing seek table.

A shard file is a sequence of zstandard frames, one for each document in
ascending id order, then two skippable frames: the document index (ids and
token counts) and the seek table in the public zstd seekable layout (size of
each frame before and after compression, and the low 32 bits of the XXH64 of
its content).  A reader takes the tail of a file, looks the wanted documents up
in the index and decompresses their frames alone.

Documents are range-partitioned and sorted by id; each task streams one shard,
so memory is bounded by the largest document and the index (12 bytes a
document).  A task attempt writes a file name of its own and only the names in
the committed manifest count, so lost executors and repeated attempts leave no
double or half file behind in a result.

Defined results: a null or empty text has the end id alone; a null id sorts
first; rows with the same id are ordered by a hash of the text, then the text; an
empty table gives an empty manifest and no rows.  Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder

#: Fixed values of the public zstd seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HEAD = struct.Struct("<qBB")        # document id, id is null, bytes of a token id
INDEX_MAGIC = b"TKIX"
MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint"
DIGEST = "shard int, pos bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"


def open_fs(uri: str):
    """(file system, path) of a uri: local and mounted folders, or any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Write frames to an open binary stream."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.comp = out, zstandard.ZstdCompressor(level=level)
        self.seek, self.docs, self.counts, self.at = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        width = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
        body = HEAD.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
        frame = self.comp.compress(body)
        self.out.write(frame)
        self.seek.append((len(frame), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is None))
        self.counts.append(len(ids))

    def close(self) -> None:
        index = (INDEX_MAGIC + np.array([d for d, _ in self.docs], "<i8").tobytes()
                 + np.array(self.counts, "<u4").tobytes() + np.array([x for _, x in self.docs], "u1").tobytes())
        table = np.array(self.seek, "<u4").tobytes() + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Random access to the documents of one shard file (a seekable stream)."""

    def __init__(self, src, size: int):
        import zstandard

        self.src, self.dec = src, zstandard.ZstdDecompressor()
        src.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", src.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        tail, self.n = 8 + 12 * n + 9, n
        src.seek(size - tail)
        head = src.read(8)
        if struct.unpack("<II", head) != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.seek = np.frombuffer(src.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype="i8")])
        src.seek(int(self.starts[-1]))
        kind, length = struct.unpack("<II", src.read(8))
        index = src.read(length)
        if kind != SKIPPABLE_INDEX or index[:4] != INDEX_MAGIC:
            raise ValueError("damaged document index")
        self.docs = np.frombuffer(index, "<i8", n, 4)
        self.counts = np.frombuffer(index, "<u4", n, 4 + 8 * n)
        self.nulls = np.frombuffer(index, "u1", n, 4 + 12 * n).astype(bool)

    def frame(self, i: int) -> tuple[int | None, np.ndarray]:
        """Decompress frame ``i`` alone and check it."""
        import xxhash

        self.src.seek(int(self.starts[i]))
        body = self.dec.decompress(self.src.read(int(self.seek[i, 0])), max_output_size=int(self.seek[i, 1]))
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != int(self.seek[i, 2]):
            raise ValueError(f"checksum of frame {i} differs")
        doc_id, null, width = HEAD.unpack_from(body)
        return None if null else doc_id, np.frombuffer(body, f"<u{width}", -1, HEAD.size).astype("<u4")

    def find(self, wanted: Iterable[int]) -> list[int]:
        """Frames of the wanted ids (every row of a repeated id)."""
        want = np.unique(np.fromiter(wanted, "i8"))
        return np.flatnonzero(np.isin(self.docs, want) & ~self.nulls).tolist()


def write_frames(docs: DataFrame, out_dir: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 2, level: int = 3) -> DataFrame:
    """Write all documents under ``out_dir`` (shared by all executors); returns the committed manifest."""
    spark = docs.sparkSession
    tie = F.xxhash64(text_col)
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
            .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        shard = TaskContext.get().partitionId()
        w = name = out = None
        n_docs = n_tokens = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist())):
                if w is None:
                    fs, base = open_fs(out_dir)
                    fs.create_dir(base, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.zst"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    w = FrameWriter(out, level)
                ids = np.frombuffer(raw + end, "<u4")
                w.add(doc_id, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
        if w is not None:
            w.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{out_dir}/{name}", "n_docs": n_docs, "n_tokens": n_tokens}],
                                             schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def _each_file(manifest: DataFrame, read, schema: str) -> DataFrame:
    """One file at a time in each task; files are dealt out by path, about one a task (a file's row is tiny, so no coalescing)."""
    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)


def read_documents(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of the wanted documents (all by default); only their frames are decompressed."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, p = open_fs(path)
                with fs.open_input_file(p) as src:
                    r = FrameReader(src, src.size())
                    for i in range(r.n) if wanted is None else r.find(wanted):
                        doc_id, ids = r.frame(i)
                        yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "ids": ids.tolist()}], schema=schema)

    return _each_file(manifest, read, "doc_id bigint, ids array<bigint>")


def read_digests(manifest: DataFrame, batch_rows: int = 4096) -> DataFrame:
    """From the files: doc_id, start (ids before it in the whole output), n_tokens, ids_crc32."""
    schema = pa.schema([("shard", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as src:
                    r, rows, at = FrameReader(src, src.size()), [], 0
                    for i in range(r.n):
                        doc_id, ids = r.frame(i)
                        rows.append((shard, i, doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) == batch_rows or i == r.n - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []

    # one row per file: the prefix sum over shards is small
    base = manifest.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("base"))
    return (_each_file(manifest, read, DIGEST).join(base, "shard")
            .select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))


def write_and_digest(spark: SparkSession, docs: DataFrame, out_dir: str, tokenizer: str, **kw) -> DataFrame:
    return read_digests(write_frames(docs, out_dir, tokenizer, **kw))
