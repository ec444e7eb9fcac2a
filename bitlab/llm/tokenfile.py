"""Token ids as files of fixed-width packed bits, with blocks for random access.

A file, all numbers little-endian: the magic bytes, then the blocks, then the footer, then the
footer's place and length (two uint64) and the magic again. A block is up to ``BLOCK_IDS`` ids,
each in ``width`` bits (most significant first), filled up to a whole byte. The footer is JSON
(width, block_ids, n_ids, n_docs, blocks: the bytes of each block's start) of which the length
precedes it as a uint64, then one int64 doc_id, one uint64 first id and one byte (0: null doc_id)
for each document.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlab.llm.common import new_folder, stage
from bitlab.llm.tokens import encoder, vocabulary_of

MAGIC = b"BLTOKENS"
BLOCK_IDS = 8192


def width_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, most significant bit first, padded with zero bits to a byte."""
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack_ids(data: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of ``pack_ids``."""
    if width == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width - 1, -1, -1, dtype=np.uint32))


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's names of the S3 scheme are known too."""
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


class Writer:
    """Writes one file; holds one block of ids and the documents' index."""

    def __init__(self, out, width: int, block_ids: int = BLOCK_IDS):
        self.out, self.width, self.block_ids = out, width, block_ids
        self.at, self.n, self.blocks, self.docs, self.rest = len(MAGIC), 0, [], [], np.zeros(0, np.uint32)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Append a document's ids."""
        self.docs.append((doc_id, self.n))
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        while len(self.rest) >= self.block_ids:
            self._block(self.rest[: self.block_ids])
            self.rest = self.rest[self.block_ids :]

    def _block(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id does not fit in {self.width} bits")
        data = pack_ids(ids, self.width)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        """Write the last block and the footer."""
        if len(self.rest):
            self._block(self.rest)
        head = json.dumps({"width": self.width, "block_ids": self.block_ids, "n_ids": self.n, "n_docs": len(self.docs), "blocks": self.blocks}).encode()
        own = np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes()
        first = np.array([s for _, s in self.docs], "<u8").tobytes()
        there = bytes(d is not None for d, _ in self.docs)
        foot = len(head).to_bytes(8, "little") + head + own + first + there
        self.out.write(foot + self.at.to_bytes(8, "little") + len(foot).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access to one file (anything with ``seek`` and ``read``)."""

    def __init__(self, src):
        self.src = src
        src.seek(0, 2)
        size = src.tell()
        src.seek(size - 16 - len(MAGIC))
        tail = src.read(16 + len(MAGIC))
        if tail[16:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        src.seek(at)
        foot = src.read(n)
        k = 8 + int.from_bytes(foot[:8], "little")
        head = json.loads(foot[8:k])
        self.width, self.block_ids, self.n_ids, self.n_docs, self.blocks = (head[x] for x in ("width", "block_ids", "n_ids", "n_docs", "blocks"))
        d = self.n_docs
        self.doc_ids = np.frombuffer(foot, "<i8", d, k)
        self.first = np.append(np.frombuffer(foot, "<u8", d, k + 8 * d), self.n_ids).astype(np.int64)
        self.there = np.frombuffer(foot, np.uint8, d, k + 16 * d)
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, i: int) -> np.ndarray:
        """The ids of block ``i``; the last one read is kept."""
        if self.held[0] != i:
            n = min(self.block_ids, self.n_ids - i * self.block_ids)
            self.src.seek(self.blocks[i])
            self.held = i, unpack_ids(self.src.read((n * self.width + 7) // 8), n, self.width)
        return self.held[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``."""
        b = self.block_ids
        parts = [self.block(i)[max(start - i * b, 0) : end - i * b] for i in range(start // b, -(-end // b))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's ``k``-th document."""
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tokenizer: str | None = None, vocabulary: int | None = None, files: int | None = None) -> DataFrame:
    """Write token files below ``folder``, in ascending id order over files and within; return their manifest.

    One row per file: path, n_docs, n_ids, start (ids in all files before). Null ids come first,
    rows of equal ids next to each other. A null or empty text is the end id alone. A task writes
    under a name of its own attempt, and only the attempt that Spark commits is in the manifest,
    so lost executors and repeated attempts leave whole files only. An empty table has no files.
    ``vocabulary`` sets the width of ids; by default it is read from the tokenizer. Other columns of
    ``docs``, whatever their names, are not read.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    width = width_for(max(vocabulary or vocabulary_of(path), end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, enc = TaskContext.get(), encoder(path, False)
        place, base = _place(folder)
        name = f"part-{ctx.partitionId():08d}-{ctx.taskAttemptId()}.tokens"
        writer = out = None
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                if writer is None:
                    place.create_dir(base, recursive=True)
                    out = place.open_output_stream(f"{base}/{name}")
                    writer = Writer(out, width)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    writer.add(doc, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [ctx.partitionId()], "path": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.n]}, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = src.repartitionByRange(files, "doc_id") if files else src.repartitionByRange("doc_id")
    manifest = stage(ranged.sortWithinPartitions("doc_id").mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document read back from the files: doc_id, start over all files, n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                place, at = _place(r["path"])
                with place.open_input_file(at) as src:
                    reader = Reader(src)
                    for i in range(0, reader.n_docs, 1024):
                        rows = range(i, min(i + 1024, reader.n_docs))
                        data = [reader.document(k).astype("<u4").tobytes() for k in rows]
                        cols = [pa.array([int(reader.doc_ids[k]) if reader.there[k] else None for k in rows], pa.int64()), pa.array([r["start"] + int(reader.first[k]) for k in rows], pa.int64()), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(data if with_ids else [None] * len(data), pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # a task per file: with an explicit number the planner does not merge the small manifest's partitions
    n = max(1, manifest.count())
    files = manifest.withColumn("nth", F.row_number().over(Window.orderBy("part")) - 1).repartitionById(n, F.col("nth").cast("int")).select("path", "start")
    out = files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_tokens(docs, new_folder(spark, "tokens")))
