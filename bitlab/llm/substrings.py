"""Repeated passages across documents, by seed and extend.

Seeds are winnowed anchors: of the ``SEED``-word sequences within each window of ``min_words``
words the one with the smallest hash. Equal windows choose equal anchors at equal places, so two
documents that share a window meet at its anchor. Documents are joined on anchors; from each
anchor a match is extended both ways, word by word, first over the windows that the anchor stands for:

1. Occurrences whose whole extension is equal form a class; all but those of its smallest
   document are repeats as far as the extension goes.
2. The others are extended step by step: each window start becomes a row, and rows of an anchor
   with the same offset and the same words form a group with a smallest document.

Then over the neighbouring anchors' matches: extensions that touch or overlap are one, so what comes out
are maximal repeats, which no repeated window precedes or follows. Groups are combined with min() only; none is collected, and no pair of documents is formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.llm.common import join_hot, stage

SEED = 20
#: An odd multiplier, its inverse modulo 2^64 and mixing constants (splitmix64).
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Stands for a null id: such rows are the largest, and never repeat one another.
NO_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Roller:
    """Hashes of all ``k``-word sequences of a document, from its words' 64-bit hashes."""

    def __init__(self):
        self.up, self.down = _powers(MULTIPLIER, 1 << 12), _powers(INVERSE, 1 << 12)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        """Prefix sums that ``sequences`` takes."""
        while len(self.up) < len(h) + 1:
            self.up, self.down = _powers(MULTIPLIER, 2 * len(self.up)), _powers(INVERSE, 2 * len(self.down))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: len(h)])])

    def sequences(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Mixed hashes of words [i, i + k) for every i."""
        n = len(sums) - k
        return _mix((sums[k:] - sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_list(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def anchors(ws: list[bytes], roller: Roller, min_words: int) -> tuple[np.ndarray, ...]:
    """Per anchor: its hash, the first and the last window start that it stands for; and all windows' hashes."""
    if len(ws) < min_words:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    digest = xxhash.xxh3_64_intdigest
    sums = roller.prefix(np.fromiter(map(digest, ws), np.uint64, len(ws)))
    seeds, windows = roller.sequences(sums, SEED), roller.sequences(sums, min_words)
    span = min_words - SEED + 1
    at = np.empty(len(windows), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(seeds, span)
    for i in range(0, len(view), 8192):
        at[i : i + 8192] = view[i : i + 8192].argmin(axis=1) + np.arange(i, min(i + 8192, len(view)))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return seeds[at[first]], first, last, windows, at[first]


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats: id, th (a hash of the text), runs array of (first, last) window starts in order.

    A run is a row of windows of ``min_words`` words that also start in a document of a smaller
    id, and the windows before and after it do not: the words [first, last + min_words) repeat. Rows of one id are one document; a null id counts as larger than all others. Only rows
    with a run are returned. Sequences are compared by 64-bit hashes at two levels (the anchor's
    words, the window's words).
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(*_key(), "text")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cols: list[list] = [[] for _ in range(7)]
                for doc, th, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    h, first, last, windows, at = anchors(word_list(text), roller, min_words)
                    if not len(h):
                        continue
                    sums = roller.prefix(windows)
                    ext = _mix((sums[last + 1] - sums[first]) * roller.down[first] + (at - first).astype(np.uint64) * np.uint64(MULTIPLIER) + (last - first).astype(np.uint64))
                    for c, x in zip(cols, (h.view(np.int64), ext.view(np.int64), np.full(len(h), doc), np.full(len(h), th), first.astype(np.int32), last.astype(np.int32), at.astype(np.int32)), strict=True):
                        c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "ext", "id", "th", "first", "last", "at"])

    seeds = stage(src.mapInArrow(seed, "anchor long, ext long, id long, th long, first int, last int, at int"), "seeds")
    # anchors that two documents share; per class of equal extensions its smallest document
    classes = seeds.groupBy("anchor", "ext").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = classes.groupBy("anchor").agg((F.min("low") < F.max("high")).alias("shared"), F.count(F.lit(1)).alias("classes")).where("shared")
    known = stage(classes.join(shared.select("anchor", "classes"), "anchor"), "classes")
    placed = stage(join_hot(seeds, known.select("anchor", "ext", "low", "classes", "n"), ["anchor", "ext"], "n", seeds.count()), "placed")
    whole = placed.where("id > low").select("id", "th", "first", "last")
    open_ = placed.where("id = low AND classes > 1").groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "first", "last", "at")).alias("open"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cols: list[list] = [[], [], [], [], [], []]
                for doc, th, text, open_list in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    ws = word_list(text)
                    sums = roller.prefix(np.fromiter(map(digest, ws), np.uint64, len(ws)))
                    windows = roller.sequences(sums, min_words)
                    for o in open_list:
                        q = np.arange(o["first"], o["last"] + 1)
                        n = len(q)
                        for c, x in zip(cols, (np.full(n, o["anchor"]), (o["at"] - q).astype(np.int32), windows[q].view(np.int64), np.full(n, doc), np.full(n, th), q.astype(np.int32)), strict=True):
                            c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "step", "words", "id", "th", "at"])

    steps = src.join(open_, ["id", "th"]).select("id", "th", "text", "open").mapInArrow(extend, "anchor long, step int, words long, id long, th long, at int")
    steps = stage(steps.distinct(), "steps")
    low = steps.groupBy("anchor", "step", "words").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    single = join_hot(steps, stage(low.drop("high"), "steps-low"), ["anchor", "step", "words"], "n", steps.count()).where("id > low").select("id", "th", F.col("at").alias("first"), F.col("at").alias("last"))
    found = whole.unionByName(single).groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("parts"))

    def longer(runs: Column, x: Column) -> Column:
        end = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))))
        return F.when(x["first"] <= end["last"] + 1, joined).otherwise(F.concat(runs, F.array(x)))

    return found.select("id", "th", F.aggregate(F.slice("parts", 2, F.size("parts")), F.slice("parts", 1, 1), longer).alias("runs"))


def remove_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, the kept text and ``runs``, the maximal repeats, of every row.

    Kept words are joined by one space. Null and empty texts have no words and keep the empty
    text; an empty table has no rows. See ``repeats`` for what is removed. Other columns of ``docs``,
    whatever their names, are not read.
    """
    spans = repeats(docs, min_words, id_col, text_col).select(F.col("id").alias("id_"), F.col("th").alias("th_"), "runs")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = src.select("doc_id", *_key(), "text")
    joined = src.join(spans, (F.col("id") == F.col("id_")) & (F.col("th") == F.col("th_")), "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, n, gone, kept = b.slice(i, 256), [], [], []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    ws = word_list(text)
                    away = np.zeros(len(ws) + 1, np.int64)
                    for r in runs or ():
                        away[r["first"]] += 1
                        away[r["last"] + min_words] -= 1
                    stay = np.cumsum(away)[:-1] == 0
                    n.append(len(ws))
                    gone.append(int(len(ws) - stay.sum()))
                    kept.append(b" ".join(ws) if not runs else b" ".join([ws[k] for k in np.flatnonzero(stay)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()), part.column(2)], names=["doc_id", "n_words", "n_removed", "kept", "runs"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, runs array<struct<first:int,last:int>>")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words or more that a smaller doc_id has."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    longest = F.array_max(F.transform("runs", lambda r: r["last"] - r["first"] + 50)).cast("long")
    n = F.coalesce(F.array_size("runs"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), n.alias("n_repeats"), F.coalesce(longest, F.lit(0)).alias("longest_repeat"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN m USING (h), range(50) r(k) WHERE low < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (doc_id, p) GROUP BY 1),
i AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT DISTINCT doc_id, i FROM g JOIN m USING (h) WHERE low < doc_id)),
r AS (SELECT doc_id, count(*) AS n_repeats, max(n) + 49 AS longest FROM (SELECT doc_id, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(n_repeats, 0) AS n_repeats, coalesce(longest, 0) AS longest_repeat
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
