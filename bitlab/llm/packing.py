"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document fills whole windows while it is
longer than one; what is left goes to the open window that it fits best, and when it fits none
the fullest window is emitted. The windows still open at the end are few; they are laid end to
end and cut anew, those of all partitions together or, where order counts, each partition's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.llm.common import stage
from bitlab.llm.mixing import in_order as in_mixture
from bitlab.llm.tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"
#: Open windows that one merging task takes.
MERGE = 8192
FIRST_MERGED = 1 << 62


def _schema() -> pa.Schema:
    return pa.schema([(n, pa.bool_() if t == "boolean" else pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in PIECE.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, open_windows: int = 64, end_id: int = 0, tokenizer: str | None = None, keep_ids: bool = False, in_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A document is its text's ids and ``end_id``; its pieces tile it, each id in one piece. Within a
    sequence of at most ``window`` ids pieces tile without a gap. A null or empty text is the end id
    alone; repeated rows are packed each; a null doc_id stays null. ``ids`` are little-endian
    unsigned 32-bit integers. The rest of a window is padding and not part of any row.

    ``in_order``: sequence ids follow the order of partitions, and in each the order of the windows'
    first pieces; what is still open at a partition's end makes that partition's last sequences.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 34
        enc = encoder(path, True)
        opened: dict[int, list] = {}  # window -> [used, pieces]
        made = 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part, out = b.slice(i, 64), []
                ids_of = enc.encode([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), ids_of, strict=True):
                    ids += end
                    n = len(ids) // 4
                    whole = n // window * window
                    for s in range(0, whole, window):
                        x = ids[4 * s : 4 * (s + window)]
                        out.append((doc, s, window, zlib.crc32(x), n, first + made, 0, False, x if keep_ids else None))
                        made += 1
                    if left := n - whole:
                        best = max((w for w in opened if opened[w][0] + left <= window), key=lambda w: opened[w][0], default=None)
                        if best is None:
                            if len(opened) == open_windows:
                                out += closed(opened.pop(max(opened, key=lambda w: opened[w][0]))[1])
                            best = first + made
                            made += 1
                            opened[best] = [0, []]
                        x, used = ids[4 * whole :], opened[best][0]
                        opened[best][1].append((doc, whole, left, zlib.crc32(x), n, best, used, False, x))
                        opened[best][0] += left
                        if opened[best][0] == window:
                            out += closed(opened.pop(best)[1])
                if out:
                    yield _batch(out)
        if opened and in_order:
            yield _batch(cut([p for w in sorted(opened) for p in opened[w][1]], first + made)[0])
        elif opened:
            yield _batch([(*p[:7], True, p[8]) for _, pieces in opened.values() for p in pieces])

    def closed(pieces: list[tuple]) -> list[tuple]:
        return pieces if keep_ids else [(*p[:8], None) for p in pieces]

    def cut(pieces: list[tuple], first: int, at: int = 0) -> tuple[list[tuple], int]:
        """Pieces laid end to end from ``at`` and cut anew into windows, and where they end."""
        out = []
        for doc, start, length, _, n_doc, _, _, _, ids in pieces:
            done = 0
            while done < length:
                n = min(length - done, window - at % window)
                x = ids[4 * done : 4 * (done + n)]
                out.append((doc, start + done, n, zlib.crc32(x), n_doc, first + at // window, at % window, False, x if keep_ids else None))
                done += n
                at += n
        return out, at

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = FIRST_MERGED + (TaskContext.get().partitionId() << 34)
        at = 0
        for b in batches:
            out, at = cut([tuple(r.values()) for r in b.to_pylist()], first, at)
            if out:
                yield _batch(out)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if in_order:
        return src.mapInArrow(run, PIECE).drop("open", *([] if keep_ids else ["ids"]))
    pieces = stage(src.mapInArrow(run, PIECE), "pieces")
    left = pieces.where("open")
    tasks = max(1, left.where("offset = 0").count() // MERGE)
    merged = left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(merge, PIECE)
    return pieces.where("not open").unionAll(merged).drop("open", *([] if keep_ids else ["ids"]))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, in the order of the mixture.

    Files are read in any order, so the slots are told anew from ids and sources: partitions
    are ranges of slots, and sequence ids rise with them. Edges: see ``pack`` and ``mixing.mix``.
    """
    return pack(in_mixture(docs, ["doc_id", "text"]), in_order=True)
