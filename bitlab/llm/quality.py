"""Quality rules judged per document and per host, as DataFrame expressions only.

Every document gets rule metrics. Rule failures are counted per host, each host's rate is shrunk
towards the corpus with an empirical beta prior (fitted to all hosts by the method of moments),
and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.llm.common import WHITE_CLASS, let, one_per_row, spare_prefix, stage, words

#: Symbols counted by ``n_symbols``.
SYMBOLS = "[#*$%&|<>]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
WINDOW = 8
RULES = ("short", "repeats", "symbols", "lines")


def _repeat_words(ws: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that occur at least twice in the array ``ws``."""

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda j, e: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            again = F.filter(s, lambda e, j: same(j - 1, e) | same(j + 1, e))
            return F.sort_array(F.transform(again, lambda e: e["i"]))

        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["total"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("total"), (p + WINDOW).alias("end"))
        return F.aggregate(let(by_hash, places), start, step, lambda a: a["total"])

    def hashes(h: Column) -> Column:
        ends = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(ends, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    windows = let(F.transform(ws, lambda w: F.xxhash64(w)), hashes)
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_m`` of long rule metrics.

    n_words, word_chars (code points in words), n_symbols, n_lines (\\n-split lines with a word),
    n_dup_lines (those equal to an earlier one), n_repeat_words. A null text counts as empty.
    Windows are compared by a 64-bit hash of their words within one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    ws = words(text)
    counts = let(ws, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    word_chars = F.length(text) - F.regexp_count(text, F.lit(WHITE_CLASS))
    n_symbols = F.regexp_count(text, F.lit(SYMBOLS))
    both = F.struct(counts.alias("c"), of_lines.alias("l"), word_chars.cast("long").alias("word_chars"), n_symbols.cast("long").alias("n_symbols"))
    flat = let(both, lambda b: F.struct(b["c"]["n_words"].alias("n_words"), b["word_chars"].alias("word_chars"), b["n_symbols"].alias("n_symbols"), b["l"]["n_lines"].alias("n_lines"), b["l"]["n_dup_lines"].alias("n_dup_lines"), b["c"]["n_repeat_words"].alias("n_repeat_words")))
    return docs.withColumn("_m", flat)


def rule_failures(m: Column, min_words: int = 20, max_repeat_pct: int = 30, max_symbol_pct: int = 10, max_dup_line_pct: int = 30) -> dict[str, Column]:
    """The rules, by name, as booleans over a metrics struct."""
    return {
        "short": m["n_words"] < min_words,
        "repeats": 100 * m["n_repeat_words"] > max_repeat_pct * m["n_words"],
        "symbols": 100 * m["n_symbols"] > max_symbol_pct * m["n_words"],
        "lines": 100 * m["n_dup_lines"] > max_dup_line_pct * m["n_lines"],
    }


def host_verdicts(failures: DataFrame, host_col: str, rules: tuple[str, ...] = RULES, max_rate: float = 0.5) -> DataFrame:
    """One row per host: counts, each rule's shrunk failure rate and ``host_bad``.

    With n documents and f failures, the rate is (f + a) / (n + a + b); Beta(a, b) has the mean and
    the between-host variance of all hosts' rates (sampling variance taken off; capped to a
    strength of 1 to 1e6 documents). A host is bad if any rule's shrunk rate exceeds ``max_rate``.
    A null host is one host of its own.
    """
    sums = failures.groupBy(host_col).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"f_{r}").cast("long")).alias(f"n_{r}") for r in rules])
    parts = []
    for r in rules:
        rate = F.col(f"n_{r}") / F.col("n")
        parts += [(F.sum(F.col(f"n_{r}")) / F.sum("n")).alias(f"mean_{r}"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias(f"var_{r}")]
    corpus = sums.agg(F.avg(1 / F.col("n")).alias("inv_n"), *parts)
    out = sums.crossJoin(F.broadcast(corpus))  # one row
    for r in rules:
        mean = F.coalesce(F.col(f"mean_{r}"), F.lit(0.0))
        spread = mean * (1 - mean)
        between = F.greatest(F.col(f"var_{r}") - spread * F.col("inv_n"), F.lit(0.0))
        strength = F.when(between > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), spread / between - 1))).otherwise(F.lit(1e6))
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + strength * mean) / (F.col("n") + strength))
    bad = F.greatest(*[F.col(f"rate_{r}") for r in rules]) > max_rate
    return out.select(host_col, F.col("n").alias("host_docs"), *[f"rate_{r}" for r in rules], F.coalesce(bad, F.lit(False)).alias("host_bad"))


def judge(docs: DataFrame, keep_cols: list[str], text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, prefix: str = "", **limits: int) -> DataFrame:
    """``keep_cols`` of every row of ``docs``, its metrics, ``failed`` rules, the host's rates and ``kept``.

    A row is kept if it passes "short", "repeats" and "symbols", and its host is not bad; "lines"
    only counts through the host. Rows, also repeated ones, come out once each; an empty or null
    text has no words and fails "short"; an empty table gives an empty result. Only ``keep_cols``
    are taken from ``docs``, so its other columns may have any names; ``prefix`` goes before the names
    of new columns, for ``keep_cols`` that clash with them.
    """
    src = one_per_row(docs, list(dict.fromkeys([*keep_cols, host_col, text_col])))
    names = {c: f"k{i}" for i, c in enumerate(src.columns)}
    src = src.toDF(*names.values())
    text, host = names[text_col], names[host_col]
    scored = metrics(src, text)
    kept_cols = list(dict.fromkeys([names[c] for c in keep_cols] + [host]))
    staged = stage(scored.select(*kept_cols, "_m.*"), "quality")
    m = {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    fails = rule_failures(m, **limits)  # type: ignore[arg-type]
    flagged = staged.select("*", *[f.alias(f"f_{r}") for r, f in fails.items()])
    hosts = stage(host_verdicts(flagged, host, max_rate=max_rate), "hosts").withColumnRenamed(host, "host")
    joined = flagged.join(hosts, F.col(host).eqNullSafe(F.col("host")), "left")
    failed = F.filter(F.array(*[F.when(F.col(f"f_{r}"), F.lit(r)) for r in fails]), lambda x: x.isNotNull())
    base_failed = F.col("f_short") | F.col("f_repeats")
    new = {**m, "base_failed": base_failed, "failed": failed, **{f"rate_{r}": F.col(f"rate_{r}") for r in RULES}, "host_bad": F.col("host_bad")}
    new["kept"] = ~base_failed & ~F.col("f_symbols") & ~F.col("host_bad")
    return joined.select(*[F.col(names[c]).alias(c) for c in keep_cols], *[x.alias(prefix + k) for k, x in new.items()])


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule metrics and host-aware verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, unchanged; their columns may have any names. Edges: see ``judge``."""
    columns, prefix = docs.columns, spare_prefix(docs, "__quality_")
    return judge(docs, columns, prefix=prefix).where(F.col(f"{prefix}kept")).select(*columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g), range(8) r(k) WHERE n > 1 GROUP BY 1),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 100 * n_symbols > 10 * n_words AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM m),
r AS (SELECT source, v.rule, count(*) AS n, sum(CASE v.rule WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END::INTEGER) AS k FROM f, (VALUES (1), (2), (3), (4)) v(rule) GROUP BY 1, 2),
p AS (SELECT rule, sum(k)::DOUBLE / sum(n) AS mean, var_pop(k::DOUBLE / n) AS var, avg(1.0::DOUBLE / n) AS inv FROM r GROUP BY 1),
b AS (SELECT rule, mean, mean * (1 - mean) AS spread, greatest(var - mean * (1 - mean) * inv, 0) AS between FROM p),
s AS (SELECT rule, mean, CASE WHEN between > 0 THEN greatest(1.0::DOUBLE, least(1e6, spread / between - 1)) ELSE 1e6 END AS strength FROM b),
h AS (SELECT source, bool_or((k + strength * mean) / (n + strength) > 0.5) AS bad FROM r JOIN s USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed, NOT (f1 OR f2 OR f3 OR bad) AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
"""
