"""Spelling variants of a vocabulary, by search schemes in FM-indexes of its delimited words.

A word with one error has its left or its right half right. So two schemes find all words one error away:

* left half exactly, then on across the right half with one error, in an index that extends to the right;
* right half exactly, then on across the left half with one error, in an index that extends to the left.

Both indexes are FM-indexes (of the words backwards, and as they are), in which a step is two ranks in the
Burrows-Wheeler transform and a matched part is an interval of suffix ranks. Errors are one replaced or one
left-out letter of the query; an inserted letter is the same pair seen from the other word. Words are dealt
by the half that has to match, so that a query meets all it can find in one place: an index of
bounded size. A half of very many words is dealt over several indexes, and its queries go to each of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.llm.common import stage

RUN = re.compile("[a-zÀ-ÿ]+")
#: Words of an index, on average; a half of more words is split.
BLOCK_WORDS = 1 << 15
#: One run in so many loses a letter in ``noisy_words``.
NOISE = 199
#: Distinct words that a task counts before it passes them on.
HELD = 200_000


def _lower(text: str) -> str:
    """``text`` with only A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def noisy_words(docs: DataFrame, min_chars: int = 6, min_count: int = 5, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE) -> DataFrame:
    """(word, n): the words of whole texts with at least ``min_chars`` code points and ``min_count`` occurrences.

    Runs of letters [A-Za-z\\u00C0-\\u00FF] are taken with A-Z in lower case. Let h be the CRC-32 of
    ``<id>:<run>``: if ``noise`` divides h, the run loses its code point h % length. A null id is written
    as nothing; null and empty texts have no runs. Repeated rows count each. Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(b":" if doc is None else f"{doc}:".encode())
                runs: dict[str, int] = {}
                for m in RUN.finditer(_lower(text or "")):
                    runs[m[0]] = runs.get(m[0], 0) + 1
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % noise == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) >= min_chars:
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD:
                    yield give()
                    held.clear()
        yield give()

    counts = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Index:
    """An FM-index of distinct words in which a matched part is extended to the right.

    The text is every word backwards and then a delimiter; delimiters are the smallest letters, in the order of the words.
    ``keys`` holds letter * size + rank of every place of the transform, in order: the place of a key
    among them is the number of suffixes before it, so a step to the interval of one letter more is two searches.
    """

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(self.lengths + 1)
        self.size = int(ends[-1])
        points = np.frombuffer("\0".join(w[::-1] for w in [*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)  # the delimiter is letter 0
        self.word_at = np.repeat(np.arange(len(words)), self.lengths + 1)
        # suffix ranks by prefix doubling; each delimiter has a rank of its own, so that all differ in the end
        rank = np.where(text == 0, self.word_at, text + len(words)).astype(np.int64)
        step = 1
        while True:
            order = np.argsort(rank, kind="stable")
            rank_sorted = rank[order]
            new = np.empty(self.size, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(rank_sorted[1:] != rank_sorted[:-1])])
            if new[order[-1]] == self.size - 1:
                break
            rank = new * (self.size + 1) + np.concatenate([new[step:] + 1, np.zeros(min(step, self.size), np.int64)])
            step *= 2
        self.suffixes = order
        self.before = text[order - 1]  # the transform; before the first letter comes the last delimiter
        self.keys = np.sort(self.before.astype(np.int64) * self.size + np.arange(self.size))

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The letters of all words in a row, -1 where the index has none such, and where each word begins."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        return np.where(self.alphabet[at] == points, at, -1), begin

    def step(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with one letter more."""
        low, high = np.searchsorted(self.keys, letter * self.size + lo), np.searchsorted(self.keys, letter * self.size + hi)
        return low, np.where(letter < 0, low, high)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every letter that goes on from an interval: (number of the interval, letter). Intervals are equal or apart."""
        first, of = np.unique(lo, return_inverse=True)
        last = np.zeros(len(first), np.int64)
        last[of] = hi
        width = last - first
        places = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - first, width)
        edges = np.unique(np.repeat(np.arange(len(first)), width) * len(self.alphabet) + self.before[places])
        edge_of, letter = edges // len(self.alphabet), edges % len(self.alphabet)
        count = np.bincount(edge_of, minlength=len(first))
        from_, n = (np.cumsum(count) - count)[of], count[of]
        picked = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - from_, n)
        return np.repeat(np.arange(len(lo)), n), letter[picked]

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals end in a whole word, and its number."""
        at = np.searchsorted(self.keys, lo)  # letter 0: keys of delimiters are ranks
        place = self.keys[np.minimum(at, self.size - 1)]
        there = (at < self.size) & (place < hi) & (lo < hi)
        return np.flatnonzero(there), self.word_at[self.suffixes[place[there]]]

    def one_error(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): words that come of a query by replacing or leaving out one letter after the first ``exact``."""
        letters, begin = self.letters(queries)
        length = np.diff(begin)
        q, lo, hi = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), len(self.lengths))
        eq = elo = ehi = np.zeros(0, np.int64)  # states that have had their error
        found_q, found_w = [], []
        for i in range(int(length.max(initial=0)) + 1):
            ends = length[eq] == i
            hit, word = self.whole(elo[ends], ehi[ends])
            found_q.append(eq[ends][hit])
            found_w.append(word)
            eq, elo, ehi = eq[~ends], elo[~ends], ehi[~ends]
            live = (length[q] > i) & (lo < hi)
            q, lo, hi = q[live], lo[live], hi[live]
            if not len(q) and not len(eq):
                break
            elo, ehi = self.step(letters[begin[eq] + i], elo, ehi)
            own = letters[begin[q] + i]
            free = np.flatnonzero(exact[q] <= i)
            of, letter = self.branches(lo[free], hi[free])
            other = (letter > 0) & (letter != own[free][of])
            of, letter = free[of[other]], letter[other]
            slo, shi = self.step(letter, lo[of], hi[of])
            eq, elo, ehi = np.concatenate([eq, q[of], q[free]]), np.concatenate([elo, slo, lo[free]]), np.concatenate([ehi, shi, hi[free]])
            there = elo < ehi
            eq, elo, ehi = eq[there], elo[there], ehi[there]
            lo, hi = self.step(own, lo, hi)
        return np.concatenate(found_q), np.concatenate(found_w)


def near_pairs(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, near, near_n), both ways round, of all distinct words of ``vocabulary`` (word, n) one error apart.

    An error is one inserted, left-out or replaced code point. Words of fewer than two code points have no
    halves and are left out. An empty vocabulary has no pairs.
    """
    n = F.char_length("word")
    half, up = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")

    def role(scheme: int, exact, query: bool):
        text = F.reverse("word") if scheme else F.col("word")
        return F.struct(F.lit(scheme).alias("scheme"), exact.cast("int").alias("exact"), F.substring(text, F.lit(1), exact).alias("part"), F.lit(query).alias("query"))

    # a word is found by queries of its own length and by those of one letter more
    longer = lambda s, mine, theirs: F.when(mine != theirs, role(s, theirs, False))
    roles = F.array_compact(F.array(role(0, half, True), longer(0, half, up), role(1, n - half, True), longer(1, n - half, n + 1 - up)))
    dealt = stage(vocabulary.where(n >= 2).select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*"), "halves")
    total = dealt.count()
    split = dealt.groupBy("scheme", "exact", "part").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block_words)
    split = stage(split.select("scheme", "exact", "part", F.ceil(F.col("rows") / block_words).cast("int").alias("parts")), "split")  # at most total / block_words rows
    placed = dealt.join(F.broadcast(split), ["scheme", "exact", "part"], "left") if split.count() <= 1 << 20 else dealt.join(split, ["scheme", "exact", "part"], "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    copies = F.when(F.col("query"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    placed = placed.withColumn("own", own).withColumn("copy", F.explode(copies))
    block = F.pmod(F.xxhash64("exact", "part", "copy"), F.lit(max(1, total // block_words))).cast("int")
    rows = placed.select("scheme", block.alias("block"), "word", "n", "exact", "query", (F.col("own") == F.col("copy")).alias("indexed"))

    def search(table: pa.Table) -> pa.Table:
        backwards = table["scheme"][0].as_py() == 1
        turn = lambda words: [w[::-1] for w in words] if backwards else words
        counts: dict[str, int] = {}
        inside = table.filter(table["indexed"])
        counts.update(zip(inside["word"].to_pylist(), inside["n"].to_pylist(), strict=True))  # a word may come by two lengths
        asked = table.filter(table["query"])
        names, queries = sorted(counts), asked["word"].to_pylist()
        q = w = np.zeros(0, np.int64)
        if names and queries:
            q, w = Index(turn(names)).one_error(turn(queries), asked["exact"].to_numpy())
        near = [names[k] for k in w.tolist()]
        return pa.table({"word": pa.array([queries[k] for k in q.tolist()], pa.string()), "n": asked["n"].take(pa.array(q)), "near": pa.array(near, pa.string()), "near_n": pa.array([counts[x] for x in near], pa.int64())})

    found = rows.groupBy("scheme", "block").applyInArrow(search, "word string, n long, near string, near_n long")
    back = found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.unionAll(back).distinct()


def variant_groups(vocabulary: DataFrame, factor: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``vocabulary`` (word, n).

    A word's form is its near word of the largest n, the smallest in code-point order of equal ones, if that n is at
    least ``factor`` times its own; else null. root is where following forms ends. Forms rise by ``factor``
    at each step, so chains are short; they are halved by pointer jumping. An empty vocabulary has no rows.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    vocabulary = stage(vocabulary, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(vocabulary, block_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    strong = -F.col("best.less") >= factor * F.col("n")
    groups = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "groups")
    roots, rest = groups.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1
    while rest:
        roots = stage(roots, "roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        rest = roots.join(on, "root", "left_semi").count()
        if rest:
            roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return groups.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their near words, forms and roots."""
    words = noisy_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return variant_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM l),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
                                     lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT DISTINCT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT d.word, d.n, v.word AS near, v.n AS near_n FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.less = v.word
  UNION SELECT a.word, a.n, b.word, b.n FROM d a JOIN d b USING (less, i) WHERE a.word <> b.word),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n FROM p GROUP BY 1),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n,
         CASE WHEN form_n >= 5 * v.n THEN (SELECT min(near) FROM p WHERE p.word = v.word AND p.near_n = g.form_n) END AS form FROM v LEFT JOIN g USING (word)),
chain AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON chain.onward = f.word)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON f.word = chain.word AND chain.onward IS NULL
"""
