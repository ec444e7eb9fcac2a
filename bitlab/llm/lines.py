"""Lines that many documents share, dropped from all documents but one, as DataFrame expressions only.

Every text is split into lines, and every line is normalised to a key. Keys are exploded as two 64-bit
hashes; per key its rows and its smallest and largest document are counted, and of keys with
two documents or more the lines of all others go. What stays is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.llm.common import join_hot, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\x0c\r"
#: Stands for a null id: such rows are one document, larger than all others.
NO_ID = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n; one empty line for null or nothing."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """A line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _row() -> list[Column]:
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]


def shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(id, th, drops) of the rows of ``docs`` (doc_id, text) that lose lines: the positions, in no order.

    th is a hash of the text. A line of a key of ``min_chars`` code points or more goes if ``min_docs``
    documents or more have the key and the row's document is not the smallest of them.
    Keys are compared by 128 bits. Frequent keys are counted where they are read and then broadcast (see ``join_hot``), so
    none is gathered in one task.
    """
    keys = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(key_of(x).alias("key"), i.alias("at")))
    long_enough = F.filter(keys, lambda k: F.char_length(k["key"]) >= min_chars)
    hashed = F.transform(long_enough, lambda k: F.struct(F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit(min_chars), k["key"]).alias("h2"), k["at"].alias("at")))
    lines = stage(docs.select(*_row(), F.explode(hashed).alias("x")).select("id", "th", "x.*"), "lines")
    per_key = lines.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    if min_docs > 2:
        wide = lines.join(per_key.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
        per_key = per_key.join(wide.where(F.col("docs") >= min_docs).select("h1", "h2"), ["h1", "h2"])
    shared = stage(per_key.select("h1", "h2", "low", "n"), "shared-lines")
    gone = join_hot(lines, shared, ["h1", "h2"], "n", lines.count()).where("id > low")
    return gone.groupBy("id", "th").agg(F.collect_set("at").alias("drops"))


def drop_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row: its lines that stay, joined by \\n.

    See ``shared_lines`` for what goes. Rows of one id are one document; a null id counts as larger than
    all others. A null or empty text is one empty line, which stays. Repeated rows come out once each.
    If all lines go, ``kept`` is empty. An empty table has no rows. Other columns of ``docs``, whatever
    their names, are not read. Texts are moved once, to meet the positions that go.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = shared_lines(src, min_chars, min_docs)
    joined = src.select("doc_id", "text", *_row()).join(gone, ["id", "th"], "left")
    split = joined.select("doc_id", "drops", lines_of(F.col("text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    n = F.size("lines").cast("long")
    return split.select("doc_id", n.alias("n_lines"), F.coalesce(F.array_size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that a document of a smaller id has."""
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
s AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT doc_id, line, i, coalesce(doc_id > low, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1
"""
