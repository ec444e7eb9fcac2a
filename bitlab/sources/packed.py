"""Files of packed symbols (gzip over the 2-bit code, four to a byte, high bits first), with JSON beside them; result documents."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE = np.frombuffer(b"01()", np.uint8)


def pack(text: str) -> bytes:
    """Symbols as bytes; the last byte is filled up with zeros, so keep the length."""
    codes = np.searchsorted(np.array([40, 41, 48, 49]), np.frombuffer(text.encode(), np.uint8))
    two = np.array([2, 3, 0, 1], np.uint8)[codes]
    two = np.concatenate([two, np.zeros(-len(two) % 4, np.uint8)]).reshape(-1, 4)
    return (two << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def unpack(data: bytes, n: int | None = None) -> str:
    """The first ``n`` symbols, or all that the bytes hold."""
    two = np.frombuffer(data, np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return CODE[two.ravel()[:n]].tobytes().decode()


def read_packed(spark: SparkSession, path: str, limit: int | None = None, clean: bool = False) -> DataFrame:
    """(path, pos, sym) of every file that ``path`` matches, or its first ``limit`` symbols; ``clean`` leaves out parentheses.

    A file is inflated in pieces of 1 MB; its metadata (sequence_length, in a file of the same name
    that ends with .json) says where padding begins, and without it padding reads as zeros.
    """
    meta = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.regexp_replace("path", r"\.json$", "").alias("stem"), F.get_json_object(F.col("content").cast("string"), "$.sequence_length").cast("long").alias("length"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.struct.gz").load(path).select("path", F.regexp_replace("path", r"\.struct\.gz$", "").alias("stem"), "content")
    both = files.join(meta, "stem", "left").select("path", "content", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for b in batches:
            for at_path, content, length in zip(b["path"], b["content"], b["length"], strict=True):
                most = min(x for x in (limit, None if pd.isna(length) else int(length), 1 << 62) if x is not None)
                at = 0
                with gzip.open(io.BytesIO(content)) as f:
                    while at < most and (piece := f.read(1 << 20)):
                        text = unpack(piece, most - at)
                        yield pd.DataFrame({"path": at_path, "pos": range(at, at + len(text)), "sym": list(text)})
                        at += len(text)

    out = both.mapInPandas(run, "path string, pos long, sym string")
    return out.where(F.col("sym").isin("0", "1")) if clean else out


def write_packed(texts: list[tuple[str, str]], folder: str) -> None:
    """Write (name, text) pairs as small local files of this format, with metadata; for exchange, not for bulk."""
    for name, text in texts:
        with gzip.open(f"{folder}/{name}.struct.gz", "wb") as f:
            f.write(pack(text))
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump({"sequence_length": len(text), "format": "v33_structural", "encoding": "2bit"}, f)


def write_results(results: DataFrame, path: str) -> None:
    """Patterns or rules as JSON lines, one folder."""
    results.write.mode("overwrite").json(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, n) out of result documents ``{"patterns": {"observable": [{"pattern_data", "recurrence"}]}}``."""
    schema = "patterns struct<observable:array<struct<pattern_data:string,recurrence:long>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("patterns.observable").alias("p")).select(F.col("p.pattern_data").alias("pattern"), F.col("p.recurrence").alias("n"))
