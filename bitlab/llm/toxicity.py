"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults and threats (weighted, learned as words or stems from labelled
rows, with a small list to begin with), targets, negations and reporting verbs. Five small
transducers read a clause's symbols side by side: insult and threat mark a match, target marks the
clause that names someone, negation marks the next match, reported speech the rest of its clause.
Composed, they are one machine whose state is the product of theirs and whose output is the union of
their marks. A match weighs its word's weight; by its marks it falls into one of twelve classes, and each class has a
factor: a prior one, which labelled rows move. Only scores of matched clauses feed the logistic model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.llm.common import stage

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n|]")
ENDS = frozenset(".!?;:\n|")
STEMS = (4, 5, 6, 7)
#: Symbols by word, in the corpus' languages: targets, negations, reporting verbs, threats.
TARGET = frozenset("you your yours u he she they him her them his their du dich dir dein deine ihr sie er tu te ti usted vosotros ella ellos vous toi ton ta votre il elle ils".split())
NEGATION = frozenset("not no never none neither nor cannot nicht kein keine nie niemals nunca jamas ningun ne pas jamais aucun".split())
REPORT = frozenset("said says say told tells wrote writes claimed claims called calls quoted reported sagte sagt schrieb dijo dice escribio dit disait ecrit".split())
#: Words of the grammar are never insults.
GRAMMATICAL = TARGET | NEGATION | REPORT
THREAT = frozenset("kill hurt destroy beat burn stab shoot punish attack murder".split())
#: Insults to begin with; what labelled rows teach comes on top.
SEEDS = {
    "=" + w: 3.0
    for w in (
        "idiot idiots moron morons imbecile stupid dumb fool loser losers scum trash garbage worthless pathetic disgusting clown vermin "
        "dumm dummkopf trottel abschaum versager idiota idiotas imbécil estúpido basura escoria perdedor crétin débile ordure minable imbécile"
    ).split()
}
O, INSULT, THREATEN, AIM, DENY, TELL, END = range(7)


#: Marks: a match, of violence, denied, reported; and the clause that ends names someone.
HIT, VIOLENT, DENIED, TOLD, AIMED = 1, 2, 4, 8, 16


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over symbols: (state, symbol) -> (state, marks).

    Symbols without an arc keep the state and mark nothing.
    """

    arcs: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    states: int = 1

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, 0))


INSULTS = Transducer({(0, INSULT): (0, HIT)})
THREATS = Transducer({(0, THREATEN): (0, HIT | VIOLENT)})
#: Whether a clause names someone is known at its end, wherever in it the name stands.
TARGETS = Transducer({(0, AIM): (1, 0), (1, END): (0, AIMED)}, 2)
#: A negation is used up by the next match, a reporting verb by the end of its clause.
NEGATIONS = Transducer({(0, DENY): (1, 0), (1, INSULT): (0, DENIED), (1, THREATEN): (0, DENIED), (1, END): (0, 0)}, 2)
REPORTS = Transducer({(0, TELL): (1, 0), (1, INSULT): (1, TOLD), (1, THREATEN): (1, TOLD), (1, END): (0, 0)}, 2)


def compose(*parts: Transducer) -> Transducer:
    """The machine that runs all ``parts`` side by side and marks what any of them marks."""
    number = {s: i for i, s in enumerate(product(*(range(p.states) for p in parts)))}
    arcs = {}
    for s, i in number.items():
        for symbol in range(7):
            steps = [p.step(q, symbol) for p, q in zip(parts, s, strict=True)]
            marks = 0
            for x in steps:
                marks |= x[1]
            arcs[i, symbol] = (number[tuple(x[0] for x in steps)], marks)
    return Transducer(arcs, len(number))


GRAMMAR = compose(INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS)
#: A match's class within its clause: 3 for violence, plus 1 if denied, 2 if told; 6 more in a clause that is aimed.
CLASS = {m: 3 * bool(m & VIOLENT) + (1 if m & DENIED else 2 if m & TOLD else 0) for m in range(32)}
#: Prior factors of the twelve classes: violence half as much again, what is denied or told half, what is aimed a quarter more.
PRIOR = np.array([(1.5 if v else 1.0) * (0.5 if d else 1.0) * (1.25 if a else 1.0) for a in (0, 1) for v in (0, 1) for d in (0, 1, 2)])
#: Of the scores of clauses: total, largest, second, number, total for the length; then the sum of each class.
BASE = 5
FEATURES = BASE + 12


class Scorer:
    """Clause scores of texts under a lexicon of weighted words and stems ("=word", "stem+")."""

    def __init__(self, lexicon: dict[str, float], grammar: Transducer = GRAMMAR):
        self.lexicon, self.grammar = lexicon, grammar
        self.known: dict[str, tuple[int, float] | None] = {t: (END, 0.0) for t in ENDS}

    def symbol(self, token: str) -> tuple[int, float] | None:
        """(symbol, weight) of a word; None for the many that say nothing."""
        if token in ENDS:
            return END, 0.0
        weight = max([self.lexicon.get("=" + token, 0.0), *(self.lexicon.get(token[:n] + "+", 0.0) for n in STEMS if len(token) >= n)])
        if token in THREAT:
            return THREATEN, max(weight, 1.0)
        if weight and token not in GRAMMATICAL:
            return INSULT, weight
        kind = AIM if token in TARGET else DENY if token in NEGATION else TELL if token in REPORT else O
        return (kind, 0.0) if kind else None

    def clauses(self, text: str | None) -> tuple[list[list[float]], int]:
        """The twelve classes' weights of every clause with a match, and the number of tokens."""
        tokens = TOKEN.findall(text.lower()) if text else []
        known, symbols, arcs = self.known, [], self.grammar.arcs
        if len(known) > 300_000:
            known.clear()
            known.update({t: (END, 0.0) for t in ENDS})
        for t in tokens:
            if t in known:
                s = known[t]
            else:
                s = self.symbol(t)
                if len(t) <= 40:
                    known[t] = s
            if s:
                symbols.append(s)
        out, now, state = [], None, 0
        for kind, weight in [*symbols, (END, 0.0)]:
            state, marks = arcs[state, kind]
            if marks & HIT:
                now = now or [0.0] * 6
                now[CLASS[marks]] += weight
            if kind == END and now:
                none = [0.0] * 6
                out.append(none + now if marks & AIMED else now + none)
                now = None
        return out, len(tokens)

    def features(self, text: str | None) -> list[float]:
        """See ``BASE``: all from matched clauses; zero for a text without any."""
        matched, n = self.clauses(text)
        if not matched:
            return [0.0] * FEATURES
        sums = np.array(matched)
        scores = np.sort(sums @ PRIOR)[::-1]
        second = scores[1] if len(scores) > 1 else 0.0
        total = scores.sum()
        return [*np.log1p([total, scores[0], second, len(scores)]), 30 * total / (n + 100), *np.log1p(sums.sum(axis=0))]


def _patterns(text) -> Column:
    ws = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}]+"), F.lit(0)))

    def stems(n: int) -> Column:
        return F.transform(F.filter(ws, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("+")))

    return F.array_distinct(F.concat(F.transform(ws, lambda w: F.concat(F.lit("="), w)), *[stems(n) for n in STEMS]))


def learn_lexicons(rows: DataFrame, size: int = 4000, min_weight: float = 2.5) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Words and stems that toxic rows (text, y, fold) hold far oftener than others, with their log rate ratio.

    Three lexicons of at most ``size`` entries each, from one count: without fold 0, without fold 1, of all rows.
    """
    def masked(kept: int, y: int) -> Column:
        return F.sum(F.when((F.col("y") == y) & (F.lit(kept == 2) | (F.col("fold") == kept)), 1).otherwise(0))

    names = [(kept, y) for kept in (1, 0, 2) for y in (0, 1)]
    totals = rows.agg(*[F.coalesce(masked(k, y), F.lit(0)).alias(f"t{k}{y}") for k, y in names]).first()
    min_docs = 3 + totals["t21"] // 150  # a pattern of fewer toxic rows says too little
    counts = rows.select("y", "fold", F.explode(_patterns(F.col("text"))).alias("pattern")).groupBy("pattern").agg(*[masked(k, y).alias(f"n{k}{y}") for k, y in names])
    counts = stage(counts.where(F.col("n21") >= min_docs), "patterns")
    out = []
    for k in (1, 0, 2):
        rate = lambda y, k=k: F.log((F.col(f"n{k}{y}") + 0.5) / (totals[f"t{k}{y}"] + 1.0))
        found = counts.where(F.col(f"n{k}1") >= min_docs).select("pattern", (rate(1) - rate(0)).alias("w"), F.col(f"n{k}1").alias("pos"))
        best = found.where(F.col("w") >= min_weight).orderBy(F.desc(F.col("w") * F.log1p("pos")), "pattern").limit(size)
        out.append(SEEDS | {r["pattern"]: float(r["w"]) for r in best.collect()})
    return tuple(out)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps: a weight for each feature, then the constant.

    The classes' own sums are held near zero, so a class that labels say little of keeps its prior factor.
    """
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.array([1e-2] * BASE + [0.5] * 12 + [1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray
    grammar: Transducer = GRAMMAR

    def scores(self, texts: list[str | None], scorer: Scorer) -> np.ndarray:
        x = np.array([scorer.features(t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def held_out(doc_id) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, grammar: Transducer = GRAMMAR) -> Model:
    """Lexicon and weights from at most ``max_rows`` labelled documents (of smallest id hash) that are not held out.

    Labels are bounded by ``max_rows`` before they are joined, so they are broadcast; of several labels
    of one id the largest counts, of several documents the one whose text has the smallest hash, and null ids
    and labels do not count. Columns but doc_id, text and toxic are not read. The weights
    are fitted to scores of each half of the sample under the lexicon of the other half; the lexicon
    kept is that of all the sample. Without both classes the model
    says 0.5 less a little for all.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = usable.groupBy(F.col("doc_id").cast("long").alias("id_")).agg(F.max("toxic").cast("int").alias("y")).withColumn("h", F.xxhash64("id_"))
    # the smallest hashes; what lies far beyond max_rows of them is left out before rows go anywhere
    below = -float(1 << 63) + min(1.0, 2.0 * max_rows / max(1, rows.count())) * float(1 << 64)
    sample = rows.where(F.col("h").cast("double") <= below).orderBy("h", "id_").limit(max_rows).drop("h")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("fold")
    joined = text.join(F.broadcast(sample), F.col("doc_id") == F.col("id_"))
    one = joined.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # a row per id of the sample
    rows = stage(one.select("text", "y", fold), "toxic-rows")
    *others, lexicon = learn_lexicons(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(x, grammar) for x in others]
        for b in batches:
            x = [scorers[k].features(t) for t, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = rows.select("text", "y", "fold").mapInArrow(run, "x array<double>, y int").collect()  # at most max_rows rows
    x, y = np.array([r["x"] for r in got], float).reshape(-1, FEATURES), np.array([r["y"] for r in got], float)
    weights = fit(x, y) if len(set(y.tolist())) == 2 else np.array([0.0] * FEATURES + [-0.1])
    return Model(lexicon, weights, grammar)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null or empty text has no clauses and scores the constant.

    Equal texts score the same, repeated rows come out once each, a null id stays null, an empty table
    has no rows. Other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon, model.grammar)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist(), scorer), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for all documents, learned from labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
