"""Every registered query of the sequence operators, with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.functions import codec, kernels
from bitlab.operators import collapse, entropy, grid, patterns, rules, scaling, scan, structure, survival
from bitlab.operators.chunks import bit_ngrams, chunks, ranked
from bitlab.operators.staging import checkpointed
from bitlab.sources import generators, snapshots
from bitlab.sources.tables import cohort_bits, event_bits, event_symbols, order_bits, user_bits, user_symbols

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the oracle: bits of all events, of users, of orders; each as one string too.
BASE = """
ev AS (SELECT 'ev' AS seq_id, event_id AS pos, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS bit FROM events),
us AS (SELECT CAST(user_id AS VARCHAR) AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
  CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS bit, event_type FROM events),
od AS (SELECT 'ord' AS seq_id, o_orderkey AS pos, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS bit FROM orders),
evs AS (SELECT seq_id, string_agg(CAST(bit AS VARCHAR), '' ORDER BY pos) AS s FROM ev GROUP BY 1),
uss AS (SELECT seq_id, string_agg(CAST(bit AS VARCHAR), '' ORDER BY pos) AS s FROM us GROUP BY 1)"""


def grams(table: str, lengths: list[int], name: str = "g") -> str:
    """A CTE (seq_id, len, pos, pattern) of all windows of the strings in ``table``."""
    each = ", ".join(f"({n})" for n in lengths)
    return f"""
{name} AS (SELECT seq_id, len, i - 1 AS pos, substr(s, i, len) AS pattern FROM (
  SELECT seq_id, s, len, unnest(range(1, length(s) - len + 2)) AS i FROM {table}, (VALUES {each}) v(len)))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql and sql.startswith("RECURSIVE "):
            SQL[f.__name__] = f"WITH RECURSIVE {BASE.strip()}, {sql.removeprefix('RECURSIVE ').strip()}"
        elif sql:
            SQL[f.__name__] = f"WITH {BASE.strip()}, {sql.strip()}" if not sql.lstrip().startswith("SELECT") else f"WITH {BASE.strip()} {sql.strip()}"
        return f

    return add


TRANS = """
t AS (SELECT seq_id, len - 1 AS ord, left(pattern, len - 1) AS ctx, CAST(right(pattern, 1) AS INTEGER) AS nxt, count(*) AS support FROM g GROUP BY ALL),
tt AS (SELECT *, sum(support) OVER (PARTITION BY seq_id, ord, ctx) AS total FROM t)"""


@query(grams("evs", [3]) + "," + TRANS + " SELECT ctx, nxt, support, round(CAST(support AS DOUBLE) / total, 6) AS confidence FROM tt")
def markov_order2(spark, d):
    """Which bit follows two bits."""
    return rules.transitions(event_bits(spark, d), [2]).select("ctx", "nxt", "support", "confidence")


@query(grams("evs", [2, 3, 4, 5, 6]) + "," + TRANS + " SELECT seq_id, CAST(ord AS INTEGER) AS ord, ctx, nxt, support, round(CAST(support AS DOUBLE) / total, 6) AS confidence FROM tt WHERE total >= 3 AND CAST(support AS DOUBLE) / total >= 0.5")
def markov_rules(spark, d):
    """Transitions of orders 1 to 5 with enough support and confidence."""
    return rules.transitions(event_bits(spark, d), [1, 2, 3, 4, 5], 3, 0.5)


@query(grams("uss", [3]) + "," + TRANS + " SELECT seq_id, ctx, max(CASE WHEN nxt = 0 THEN round(CAST(support AS DOUBLE) / total, 6) END) AS p0, max(CASE WHEN nxt = 1 THEN round(CAST(support AS DOUBLE) / total, 6) END) AS p1 FROM tt GROUP BY 1, 2")
def markov_matrix_by_user(spark, d):
    """Each user's 4 by 2 matrix of order-2 confidences."""
    return rules.transition_matrix(rules.transitions(user_bits(spark, d), [2]))


@query(grams("evs", [3, 4, 5, 6, 7, 8]) + " SELECT seq_id, CAST(len AS INTEGER) AS len, pattern, count(*) AS n, min(pos) AS first_pos FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def ngram_counts(spark, d):
    """Patterns of 3 to 8 bits."""
    return patterns.pattern_counts(event_bits(spark, d), range(3, 9))


@query(grams("uss", [4, 5, 6]) + " SELECT seq_id, CAST(len AS INTEGER) AS len, pattern, count(*) AS n, min(pos) AS first_pos FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def ngram_counts_by_user(spark, d):
    """Patterns of 4 to 6 bits in each user's sequence."""
    return patterns.pattern_counts(user_bits(spark, d), range(4, 7), 3)


@query(grams("evs", [4, 8, 12]) + " SELECT seq_id, CAST(len AS INTEGER) AS len, CAST(count(*) AS BIGINT) AS windows, count(DISTINCT pattern) AS patterns, round(CAST(count(DISTINCT pattern) AS DOUBLE) / count(*), 6) AS ratio FROM g GROUP BY 1, 2")
def pattern_saturation(spark, d):
    """How many windows are distinct."""
    return patterns.saturation(event_bits(spark, d), [4, 8, 12])


@query(grams("evs", [4, 5, 6, 7, 8]) + """, c AS (SELECT len, pattern, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, len, pattern LIMIT 50)
SELECT 'sw_' || substr(md5(pattern), 1, 8) AS pattern_id, CAST(len AS INTEGER) AS len, pattern, n, round(CAST(n AS DOUBLE) * len / (SELECT max(pos) + 1 FROM ev), 6) AS density FROM c""")
def top_patterns(spark, d):
    """The 50 commonest patterns with their density."""
    bits = event_bits(spark, d)
    return patterns.top_patterns(patterns.pattern_counts(bits, range(4, 9)), bits.groupBy("seq_id").agg((F.max("pos") + 1).alias("size")), 50)


GAPS = grams("evs", [6]) + ", p AS (SELECT pattern, lead(pos) OVER (PARTITION BY pattern ORDER BY pos) - pos AS gap FROM g), q AS (SELECT * FROM p WHERE gap IS NOT NULL)"


@query(GAPS + """, c AS (SELECT pattern, gap, count(*) AS n, sum(count(*)) OVER (PARTITION BY pattern) AS gaps FROM q GROUP BY 1, 2)
SELECT pattern, gap AS period, n, round(CAST(n AS DOUBLE) / gaps, 6) AS confidence FROM c WHERE gaps >= 2 AND n >= 2""")
def periodicity(spark, d):
    """Distances at which patterns of 6 bits come again."""
    return patterns.periodicity(event_bits(spark, d), 6).select("pattern", "period", "n", "confidence")


@query(GAPS + " SELECT pattern, count(*) AS gaps, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS std_gap FROM q GROUP BY 1")
def pattern_recurrence(spark, d):
    """Mean and deviation of those distances."""
    return patterns.recurrence(event_bits(spark, d), 6).select("pattern", "gaps", "mean_gap", "std_gap")


@query(grams("evs", [5, 8, 13]) + " SELECT CAST(len AS INTEGER) AS period, pattern AS tile, count(*) AS n FROM g WHERE pos % len = 0 GROUP BY 1, 2 HAVING count(*) >= 2")
def periodic_tiles(spark, d):
    """Identical tiles at three periods."""
    return patterns.tiles(event_bits(spark, d), [5, 8, 13]).select("period", "tile", "n")


COUNTS = grams("evs", [2, 3, 4, 5, 6]) + ", c AS (SELECT pattern, len, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(COUNTS + ' SELECT a.pattern AS "left", b.pattern AS "right", w.pattern AS whole, a.n AS n_left, b.n AS n_right, w.n AS n_whole FROM c a JOIN c b ON a.pattern <> b.pattern JOIN c w ON w.pattern = a.pattern || b.pattern')
def pattern_compositions(spark, d):
    """Patterns that join to a counted pattern."""
    return patterns.compositions(patterns.pattern_counts(event_bits(spark, d), range(2, 7))).select("left", "right", "whole", "n_left", "n_right", "n_whole")


@query(COUNTS + """, k AS (SELECT unnest(range(1, 6)) AS k), p AS (
  SELECT a.pattern AS l, b.pattern AS r, k.k, a.pattern || substr(b.pattern, k.k + 1) AS whole FROM c a, c b, k
  WHERE a.pattern <> b.pattern AND k.k < a.len AND k.k < b.len AND right(a.pattern, k.k) = left(b.pattern, k.k))
SELECT l AS "left", r AS "right", CAST(max(k) AS INTEGER) AS overlap, arg_max(whole, k) AS whole FROM p WHERE whole IN (SELECT pattern FROM c) GROUP BY 1, 2""")
def pattern_overlaps(spark, d):
    """Patterns that overlap to make a counted pattern."""
    return patterns.overlaps(patterns.pattern_counts(event_bits(spark, d), range(2, 7))).select("left", "right", "overlap", "whole")


#: The patterns whose torsion is measured.
TORSION = ["00", "11", "01", "10", "000", "111", "010", "101", "0000", "1111", "0101", "1010"]


@query(grams("evs", [2, 3, 4]) + f""", z AS (SELECT *, (SELECT (max(pos) + 1) // 10 FROM ev) AS w FROM g WHERE pattern IN ({", ".join(f"'{p}'" for p in TORSION)})),
c AS (SELECT pattern, pos // w AS seg, count(*) AS n FROM z WHERE pos // w < 10 AND pos + len <= (pos // w + 1) * w GROUP BY 1, 2),
m AS (SELECT pattern, sum(n) / 10.0::DOUBLE AS mean, sum(n * n) / 10.0::DOUBLE AS sq FROM c GROUP BY 1)
SELECT pattern, round(mean, 6) AS mean, round((sq - mean * mean) / mean, 6) AS torsion FROM m""")
def torsion(spark, d):
    """How unevenly twelve patterns are spread over ten segments."""
    return patterns.torsion(event_bits(spark, d), TORSION, 10).select("pattern", "mean", "torsion")


INDEX = grams("evs", [2, 3, 4, 5, 6]) + """, r AS (
  SELECT len - 1 AS ctx_len, left(pattern, len - 1) AS ctx, least(pos // ((SELECT max(pos) + 1 FROM ev) // 4), 3) AS segment, CAST(right(pattern, 1) AS BIGINT) AS nxt FROM g),
i AS (SELECT CAST(ctx_len AS INTEGER) AS ctx_len, ctx, CAST(coalesce(segment, -1) AS INTEGER) AS segment, count(*) AS n, CAST(sum(1 - nxt) AS BIGINT) AS c0, CAST(sum(nxt) AS BIGINT) AS c1
  FROM r GROUP BY GROUPING SETS ((ctx_len, ctx, segment), (ctx_len, ctx)))"""
RULES = INDEX + """, a AS (SELECT ctx_len, ctx, CASE WHEN c1 > c0 THEN 1 ELSE 0 END AS prediction, n AS support, CAST(greatest(c0, c1) AS DOUBLE) / n AS precision FROM i WHERE segment = -1),
b AS (SELECT i.ctx_len, i.ctx, CAST(CASE WHEN prediction = 1 THEN c1 ELSE c0 END AS DOUBLE) / n AS share FROM i JOIN a USING (ctx_len, ctx) WHERE segment >= 0),
c AS (SELECT ctx_len, ctx, greatest(0, avg(share) - stddev_pop(share)) AS stability, count(*) FILTER (share > 0) / 4.0::DOUBLE AS reproducibility FROM b GROUP BY 1, 2),
rr AS (SELECT ctx_len, ctx, prediction, support, round(precision, 6) AS precision, round(stability, 6) AS stability, round(reproducibility, 6) AS reproducibility FROM a JOIN c USING (ctx_len, ctx))"""


@query(INDEX + " SELECT * FROM i")
def context_index(spark, d):
    """Next-bit counts by context, in four segments and in all."""
    return rules.context_index(event_bits(spark, d), [1, 2, 3, 4, 5]).drop("seq_id")


@query(RULES + " SELECT * FROM rr")
def rule_metrics(spark, d):
    """Precision and stability of each context's rule."""
    return rules.rule_metrics(rules.context_index(event_bits(spark, d), [1, 2, 3, 4, 5])).drop("seq_id")


@query(RULES + """, x AS (SELECT *, 'after ' || ctx || ' comes ' || prediction AS description FROM rr), y AS (SELECT *, length(description) / 100.0::DOUBLE + 1 + 0.5 * ctx_len AS cx FROM x)
SELECT ctx, description, round(cx, 6) AS complexity, round(least(1, greatest(0, 0.3::DOUBLE * reproducibility + 0.25::DOUBLE * stability + 0.25::DOUBLE * precision + 0.2::DOUBLE * greatest(0, 1 - cx / 10.0::DOUBLE))), 6) AS quality, ((precision = 1 AND support <= 1) OR precision < 0.8) AS trivial FROM y""")
def rule_complexity(spark, d):
    """Complexity and quality of the rules."""
    return rules.rule_complexity(rules.rule_metrics(rules.context_index(event_bits(spark, d), [1, 2, 3, 4, 5]))).drop("seq_id")


@query(RULES + """ SELECT count(*) AS rules, round(avg(precision), 6) AS mean_precision, round(stddev_pop(precision), 6) AS std_precision, round(avg(stability), 6) AS mean_stability,
  count(*) FILTER (precision >= 0.6) AS valid, count(*) FILTER (stability >= 0.9) AS stable, min(stability) AS weakest FROM rr""")
def rule_validation(spark, d):
    """The rules' metrics taken together."""
    return rules.validation_summary(rules.rule_metrics(rules.context_index(event_bits(spark, d), [1, 2, 3, 4, 5]))).drop("seq_id")


@query(grams("uss", [4]) + "," + TRANS + """, ids AS (SELECT seq_id, CAST(CAST('0x' || substr(md5(seq_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM uss),
p AS (SELECT ctx, CASE WHEN 2 * sum(support * nxt) > sum(support) THEN 1 ELSE 0 END AS prediction FROM t GROUP BY 1),
a AS (SELECT ctx, fold, CAST(sum(CASE WHEN nxt = prediction THEN support ELSE 0 END) AS DOUBLE) / sum(support) AS acc FROM t JOIN ids USING (seq_id) JOIN p USING (ctx) GROUP BY 1, 2)
SELECT ctx, round(avg(acc), 6) AS mean_accuracy, round(stddev_pop(acc), 6) AS std_accuracy, count(*) AS folds FROM a GROUP BY 1""")
def rule_kfold(spark, d):
    """Rules tested on five folds of users."""
    return rules.kfold(user_bits(spark, d), 3, 5)


@query(grams("uss", [6]) + "," + TRANS + """, c AS (SELECT seq_id, -sum(CAST(support AS DOUBLE) / t * log2(CAST(support AS DOUBLE) / total)) AS h_given FROM (SELECT *, sum(support) OVER (PARTITION BY seq_id) AS t FROM tt) GROUP BY 1),
h AS (SELECT seq_id, CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0 END AS h FROM (SELECT seq_id, avg(bit) AS p FROM us GROUP BY 1))
SELECT seq_id, round(h, 6) AS h, round(h_given, 6) AS h_given, round(CASE WHEN h > 0 THEN greatest(0, 1 - h_given / h) ELSE 1 END, 6) AS predictability FROM h JOIN c USING (seq_id)""")
def causality_by_user(spark, d):
    """How far five bits foretell the next, for each user."""
    return rules.causality(user_bits(spark, d), 5)


ENT = grams("evs", [1, 2, 4, 8]) + """, b AS (SELECT len AS size, pattern, count(*) AS n FROM g WHERE pos % len = 0 GROUP BY 1, 2),
bb AS (SELECT *, sum(n) OVER (PARTITION BY size) AS t FROM b),
e AS (SELECT CAST(size AS INTEGER) AS size, CAST(max(t) AS BIGINT) AS blocks, count(*) AS states, -sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)) AS h FROM bb GROUP BY 1)"""


@query(ENT + " SELECT size, blocks, states, round(h, 6) AS entropy, round(h / size, 6) AS rate FROM e")
def block_entropy(spark, d):
    """Entropy of disjoint blocks of 1 to 8 bits."""
    return entropy.block_entropy(event_bits(spark, d), [1, 2, 4, 8]).drop("seq_id")


@query(ENT + """, y AS (SELECT log2(size) AS x, round(h, 6) / log2(least(pow(2.0::DOUBLE, size), blocks)) AS y FROM e)
SELECT count(*) AS scales, round(stddev_pop(y) / avg(y), 6) AS cv, round(regr_slope(y, x), 6) AS slope FROM y""")
def entropy_hierarchy(spark, d):
    """How block entropies change with size."""
    return entropy.hierarchy(entropy.block_entropy(event_bits(spark, d), [1, 2, 4, 8])).drop("seq_id")


def blocks_sql(table: str, sizes: list[int], name: str = "k") -> str:
    """A CTE (seq_id, size, block, ones) of whole blocks."""
    return f"""
{name} AS (SELECT seq_id, size, pos // size AS block, CAST(sum(bit) AS BIGINT) AS ones FROM {table}, (VALUES {", ".join(f"({s})" for s in sizes)}) v(size) GROUP BY 1, 2, 3 HAVING count(*) = size)"""


GOLDEN, DOUBLING = [3, 5, 8, 13, 21, 34], [2, 4, 8, 16, 32]


def density_sql(sizes: list[int], n: str) -> str:
    return blocks_sql("ev", sizes, f"k{n}") + f""", h{n} AS (SELECT size, least(ones * 10 // size, 9) AS bin, count(*) AS n FROM k{n} GROUP BY 1, 2),
e{n} AS (SELECT CAST(size AS INTEGER) AS size, CAST(sum(n) AS BIGINT) AS blocks, round(-sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY size) AS t FROM h{n}) GROUP BY 1)"""


@query(density_sql(GOLDEN, "1") + " SELECT * FROM e1")
def density_entropy(spark, d):
    """Entropy of block densities at golden scales."""
    return entropy.density_entropy(event_bits(spark, d), GOLDEN).drop("seq_id")


@query(density_sql(GOLDEN, "1") + "," + density_sql(DOUBLING, "2") + ", a AS (SELECT 1 / (1 + var_pop(entropy)) AS g FROM e1), b AS (SELECT 1 / (1 + var_pop(entropy)) AS d FROM e2) SELECT round(g, 6) AS golden_strength, round(d, 6) AS doubling_strength, round(g / d, 6) AS preference FROM a, b")
def scale_preference(spark, d):
    """Golden scales against doubling ones."""
    bits = event_bits(spark, d)
    return entropy.scale_preference(entropy.density_entropy(bits, GOLDEN), entropy.density_entropy(bits, DOUBLING)).drop("seq_id")


MI = """
jj AS (SELECT *, sum(n) OVER (PARTITION BY lag) AS t, sum(n) OVER (PARTITION BY lag, x) AS nx, sum(n) OVER (PARTITION BY lag, y) AS ny FROM j)
SELECT CAST(lag AS INTEGER) AS lag, CAST(sum(n) AS BIGINT) AS pairs, round(greatest(0, sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) * t / (CAST(nx AS DOUBLE) * ny)))), 6) AS mi FROM jj GROUP BY 1"""


@query(blocks_sql("ev", [8]) + """, s AS (SELECT block, CASE WHEN 2 * ones > 8 THEN 1 ELSE 0 END AS x FROM k),
j AS (SELECT lag, a.x, b.x AS y, count(*) AS n FROM s a, (VALUES (1), (2), (5), (10)) v(lag), s b WHERE b.block = a.block + lag GROUP BY 1, 2, 3), """ + MI)
def lagged_information(spark, d):
    """Mutual information of majority blocks some blocks apart."""
    return entropy.lagged_information(event_bits(spark, d), 8, [1, 2, 5, 10]).drop("seq_id")


TE = blocks_sql("ev", [1, 2, 4, 8]) + """, s AS (SELECT size, block, CASE WHEN 2 * ones > size THEN 1 ELSE 0 END AS x FROM k),
h AS (SELECT size, block, x, lag(x, 3) OVER w || '' || lag(x, 2) OVER w || lag(x, 1) OVER w AS past FROM s WINDOW w AS (PARTITION BY size ORDER BY block)),
j AS (SELECT a.size AS src, b.size AS dst, a.past AS xp, b.past AS yp, b.x AS y, count(*) AS n FROM h a JOIN h b ON a.block = b.block AND a.size <> b.size WHERE a.past IS NOT NULL AND b.past IS NOT NULL GROUP BY ALL),
jj AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src, dst) AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY src, dst, yp, xp) AS DOUBLE) AS n_yx, CAST(sum(n) OVER (PARTITION BY src, dst, yp) AS DOUBLE) AS n_y, CAST(sum(n) OVER (PARTITION BY src, dst, yp, y) AS DOUBLE) AS n_yy FROM j),
te AS (SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(sum(n) AS BIGINT) AS n, greatest(0, sum(n / t * log2(n * n_y / (n_yx * n_yy)))) AS te FROM jj GROUP BY 1, 2)"""


@query(TE + " SELECT src, dst, n, round(te, 6) AS te FROM te")
def transfer_entropy(spark, d):
    """Transfer entropy between four scales, both ways."""
    return entropy.transfer_entropy(event_bits(spark, d), [1, 2, 4, 8]).drop("seq_id")


@query(TE + """, a AS (SELECT avg(te) FILTER (src < dst) AS up, avg(te) FILTER (src > dst) AS down FROM te)
SELECT round(up, 6) AS up, round(down, 6) AS down, round(up - down, 6) AS asymmetry, CASE WHEN up - down > 0.01 THEN 'bottom-up' WHEN up - down < -0.01 THEN 'top-down' ELSE 'balanced' END AS direction FROM a""")
def transfer_directions(spark, d):
    """The balance of the two ways."""
    return entropy.directions(entropy.transfer_entropy(event_bits(spark, d), [1, 2, 4, 8], digits=None)).drop("seq_id")


def runs_sql(table: str) -> str:
    return f"""
c AS (SELECT *, CASE WHEN lag(bit) OVER w IS DISTINCT FROM bit THEN 1 ELSE 0 END AS new FROM {table} WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
n AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT seq_id, CAST(run AS BIGINT) AS run, min(bit) AS bit, min(pos) AS start, count(*) AS len FROM n GROUP BY 1, 2)"""


@query(runs_sql("ev") + " SELECT bit, len, count(*) AS n FROM r GROUP BY 1, 2")
def run_lengths(spark, d):
    """Lengths of stretches of equal bits."""
    return scaling.run_histogram(scaling.runs(event_bits(spark, d))).drop("seq_id")


@query(runs_sql("us") + f""", q AS (SELECT seq_id, CAST(len AS DOUBLE) / lag(len) OVER (PARTITION BY seq_id ORDER BY run) AS r FROM r)
SELECT seq_id, count(r) AS ratios, round(avg(r), 6) AS mean_ratio, round(avg(CASE WHEN abs(r - {scaling.PHI}) < 0.3 OR abs(r - {1 / scaling.PHI}) < 0.3 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS near_phi FROM q WHERE r IS NOT NULL GROUP BY 1""")
def run_ratios_by_user(spark, d):
    """Ratios of successive runs, for each user."""
    return scaling.run_ratios(scaling.runs(user_bits(spark, d)))


@query(runs_sql("od") + ", m AS (SELECT max(len) AS top FROM r) SELECT round(CAST(len AS DOUBLE) / top, 6) AS death, count(*) AS n FROM r, m GROUP BY 1")
def run_persistence(spark, d):
    """Lifespans of the runs of orders."""
    return scaling.persistence(scaling.runs(order_bits(spark, d))).drop("seq_id")


@query(blocks_sql("ev", [2, 3, 5, 8, 13, 21]) + """, s AS (SELECT size, block, CASE WHEN ones > size // 2 THEN 1 ELSE 0 END AS x FROM k),
l AS (SELECT *, lag(x) OVER (PARTITION BY size ORDER BY block) AS was FROM s)
SELECT CAST(size AS INTEGER) AS scale, count(*) FILTER (x = 1 AND coalesce(was, 0) = 0) AS components, count(*) FILTER (was <> x) AS alternations FROM l GROUP BY 1""")
def betti_by_scale(spark, d):
    """Components and alternations of majority blocks."""
    return scaling.betti(event_bits(spark, d), [2, 3, 5, 8, 13, 21]).drop("seq_id")


BOXES = [2, 3, 4, 6, 8, 12, 16, 24, 32, 49]
BOX = f"""
x AS (SELECT size, pos // size AS box, count(*) AS n, max(bit) AS one FROM ev, (VALUES {", ".join(f"({s})" for s in BOXES)}) v(size) GROUP BY 1, 2),
bx AS (SELECT CAST(size AS INTEGER) AS size, count(*) AS boxes, CAST(sum(one) AS BIGINT) AS filled FROM x WHERE n = size GROUP BY 1)"""


@query(BOX + " SELECT * FROM bx")
def box_counts(spark, d):
    """Boxes that hold a one."""
    return scaling.box_counts(event_bits(spark, d), BOXES).drop("seq_id")


@query(BOX + " SELECT round(least(2, greatest(0, -regr_slope(ln(filled), ln(size)))), 6) AS dimension FROM bx WHERE filled > 0")
def box_dimension(spark, d):
    """The box-counting dimension."""
    return scaling.box_dimension(scaling.box_counts(event_bits(spark, d), BOXES)).drop("seq_id")


DFA_SIZES = [4, 8, 16, 32, 64, 128, 256]


def dfa_sql(q: float) -> str:
    return f"""
y AS (SELECT pos, sum(bit - m) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS y FROM ev, (SELECT avg(bit) AS m FROM ev)),
b AS (SELECT size, pos // size AS box, count(*) AS n, var_pop(y) AS vy, var_pop(CAST(pos % size AS DOUBLE)) AS vx, covar_pop(y, CAST(pos % size AS DOUBLE)) AS c FROM y, (VALUES {", ".join(f"({s})" for s in DFA_SIZES)}) v(size) GROUP BY 1, 2),
f AS (SELECT CAST(size AS INTEGER) AS size, count(*) AS boxes, round(pow(avg(pow(greatest(0, vy - c * c / vx), {q / 2})), {1 / q}), 6) AS f FROM b WHERE n = size GROUP BY 1)"""


@query(dfa_sql(2.0) + " SELECT * FROM f")
def fluctuations(spark, d):
    """Detrended fluctuations by box size."""
    return scaling.fluctuations(event_bits(spark, d), DFA_SIZES).drop("seq_id")


@query(dfa_sql(2.0) + " SELECT round(regr_slope(ln(f), ln(size)), 5) AS h, round(regr_r2(ln(f), ln(size)), 5) AS r2 FROM f WHERE f > 0")
def fluctuation_exponent(spark, d):
    """Their scaling exponent."""
    return scaling.exponent(scaling.fluctuations(event_bits(spark, d), DFA_SIZES)).drop("seq_id")


@query(dfa_sql(4.0) + " SELECT 4.0::DOUBLE AS q, round(regr_slope(ln(f), ln(size)), 5) AS h, round(4 * round(regr_slope(ln(f), ln(size)), 5) - 1, 5) AS tau FROM f WHERE f > 0")
def multifractal_q4(spark, d):
    """The generalised exponent of order 4."""
    return scaling.multifractal(event_bits(spark, d), DFA_SIZES, [4.0]).drop("seq_id")


DAILY = """
g AS (SELECT CAST(user_id % 4 AS INTEGER) AS seq_id, CAST(floor(event_id / 500) AS INTEGER) AS iteration, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT seq_id, iteration, CAST(sum(n) OVER (PARTITION BY seq_id ORDER BY iteration) AS BIGINT) AS length FROM g)"""


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, iteration, length): cohorts' accumulated events after each 500 events."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    per = e.groupBy((F.col("user_id") % 4).cast("int").alias("seq_id"), F.floor(F.col("event_id") / 500).cast("int").alias("iteration")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("seq_id", "iteration", F.sum("n").over(Window.partitionBy("seq_id").orderBy("iteration")).alias("length"))


@query(DAILY + """, w AS (SELECT *, length - lag(length) OVER (PARTITION BY seq_id ORDER BY iteration) AS dd FROM s),
z AS (SELECT *, CAST(dd AS DOUBLE) / lag(dd) OVER (PARTITION BY seq_id ORDER BY iteration) AS r FROM w)
SELECT seq_id, round(regr_slope(ln(length), iteration), 6) AS slope, round(regr_r2(ln(length), iteration), 6) AS r2, round(quantile_cont(r, 0.5), 6) AS median_ratio FROM z GROUP BY 1""")
def growth(spark, d):
    """Growth of accumulated lengths."""
    return scaling.growth(_lengths(spark, d))


@query(DAILY + " SELECT seq_id, round(regr_slope(length, iteration), 6) AS slope, round(regr_intercept(length, iteration), 6) AS intercept, round(corr(length, iteration), 6) AS r, round(CASE WHEN regr_slope(length, iteration) <> 0 THEN (1 - regr_intercept(length, iteration)) / regr_slope(length, iteration) END, 3) AS to_unity FROM s GROUP BY 1")
def trend(spark, d):
    """A straight line through them."""
    return scaling.trend(_lengths(spark, d), "length")


@query(runs_sql("ev") + f""", q AS (SELECT CAST(len AS DOUBLE) / lag(len) OVER (ORDER BY run) AS r FROM r),
o AS (SELECT count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM q),
kc AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in scaling.CONSTANTS.items())}) v(name, c)), e AS (SELECT *, abs(mean - c) AS d, abs(mean - c) / (sd / sqrt(n)) AS z FROM o, kc),
-- the area under the bell curve by Simpson's rule
a AS (SELECT name, sum(exp(-pow(z * i / 2000.0::DOUBLE, 2) / 2) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * z / 6000 / sqrt(2 * pi()) AS half FROM e, range(2001) r(i) WHERE z < 6 GROUP BY name, z)
SELECT name, n, round(mean, 6) AS mean, round(d, 6) AS distance, round(z, 4) AS z, round(CASE WHEN z < 6 THEN 1 - 2 * half ELSE 0 END, 6) AS p, round((abs(mean - 1) - min(d) OVER ()) / sd, 6) AS effect, CAST(row_number() OVER (ORDER BY d, name) AS INTEGER) AS rank FROM e LEFT JOIN a USING (name)""")
def constant_tests(spark, d):
    """Which constant the mean ratio of runs is nearest."""
    run = scaling.runs(event_bits(spark, d))
    before = run.select((F.col("run") + 1).alias("run"), F.col("len").alias("was"))
    return scaling.constant_tests(run.join(before, "run").select((F.col("len").cast("double") / F.col("was")).alias("r")), "r")


DEEP = """
sy AS (SELECT seq_id, pos, CASE event_type WHEN 'signup' THEN '(' WHEN 'error' THEN ')' WHEN 'click' THEN '1' WHEN 'purchase' THEN '1' ELSE '0' END AS sym FROM us),
d1 AS (SELECT *, sum(CASE sym WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM sy),
d2 AS (SELECT *, least(0, min(s) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS low FROM d1),
d3 AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY seq_id ORDER BY pos), 0) AS was FROM d2),
dp AS (SELECT seq_id, pos, sym, CAST(s - low + CASE WHEN sym = ')' THEN 1 ELSE 0 END AS INTEGER) AS depth,
  CAST(count(*) FILTER (sym = '1') OVER v AS BIGINT) AS ones, CAST(count(*) FILTER (sym = '0') OVER v AS BIGINT) AS zeros FROM d3 WHERE low = was WINDOW v AS (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""
NODES = DEEP + """,
op AS (SELECT *, row_number() OVER (PARTITION BY seq_id, depth ORDER BY pos) AS k FROM dp WHERE sym = '('),
cp AS (SELECT *, row_number() OVER (PARTITION BY seq_id, depth ORDER BY pos) AS k FROM dp WHERE sym = ')'),
nd AS (SELECT op.seq_id, op.pos AS open_pos, cp.pos AS close_pos, op.depth, cp.ones - op.ones AS n_ones, cp.zeros - op.zeros AS n_zeros FROM op JOIN cp USING (seq_id, depth, k)),
np AS (SELECT nd.*, (SELECT max(p.pos) FROM op p WHERE p.seq_id = nd.seq_id AND p.depth = nd.depth - 1 AND p.pos < nd.open_pos) AS parent_pos FROM nd)"""
H2 = "CASE WHEN {o} > 0 AND {z} > 0 THEN -({o} / ({o} + {z})::DOUBLE * log2({o} / ({o} + {z})::DOUBLE) + {z} / ({o} + {z})::DOUBLE * log2({z} / ({o} + {z})::DOUBLE)) ELSE 0 END"


def _deep(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(structure.depths(checkpointed(user_symbols(spark, d))))


@query(DEEP + " SELECT seq_id, count(*) FILTER (sym = '(') AS opens, count(*) FILTER (sym = ')') AS closes, max(depth) AS max_depth, count(*) FILTER (sym IN ('0', '1')) AS bits FROM dp GROUP BY 1")
def depth_stats(spark, d):
    """Nesting of each user's symbols."""
    return structure.depth_stats(_deep(spark, d))


@query(DEEP + " SELECT depth, count(*) AS opens FROM dp WHERE sym = '(' GROUP BY 1")
def depth_histogram(spark, d):
    """Opens by depth."""
    return structure.depth_histogram(_deep(spark, d))


@query(DEEP + ", p AS (SELECT depth, lag(depth) OVER (PARTITION BY seq_id ORDER BY pos) AS prev_depth FROM dp WHERE sym IN ('(', ')')) SELECT prev_depth, depth, count(*) AS n FROM p WHERE prev_depth IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1000")
def depth_transitions(spark, d):
    """Steps between depths."""
    return structure.depth_transitions(_deep(spark, d))


@query(NODES + " SELECT seq_id, open_pos, close_pos, depth, n_ones, n_zeros, coalesce(parent_pos, -1) AS parent_pos FROM np")
def nesting_nodes(spark, d):
    """All groups with their parents; -1 for none."""
    return structure.nodes(_deep(spark, d)).select("seq_id", "open_pos", "close_pos", "depth", "n_ones", "n_zeros", F.coalesce("parent_pos", F.lit(-1).cast("long")).alias("parent_pos"))


@query(NODES + f" SELECT n_ones + n_zeros AS length, count(*) AS groups, round(avg({H2.format(o='n_ones', z='n_zeros')}), 6) AS mean_entropy FROM nd GROUP BY 1")
def containment(spark, d):
    """Groups by the bits that they hold."""
    return structure.containment(structure.nodes(_deep(spark, d)))


@query(NODES + """, bs AS (SELECT seq_id, string_agg(sym, '' ORDER BY pos) AS s FROM dp WHERE sym IN ('0', '1') GROUP BY 1),
ct AS (SELECT nd.*, coalesce(substr(s, CAST(op.ones + op.zeros + 1 AS INTEGER), CAST(n_ones + n_zeros AS INTEGER)), '') AS content FROM nd JOIN op ON op.seq_id = nd.seq_id AND op.pos = nd.open_pos LEFT JOIN bs ON bs.seq_id = nd.seq_id)
SELECT count(*) AS groups, round(avg(n_ones + n_zeros), 6) AS mean_length, round(stddev_samp(n_ones + n_zeros), 6) AS std_length, count(DISTINCT content) AS distinct_contents, round(1 - CAST(count(DISTINCT content) AS DOUBLE) / count(*), 6) AS repetition FROM ct""")
def containment_summary(spark, d):
    """Their lengths and repetition."""
    deep = _deep(spark, d)
    return structure.containment_summary(deep, structure.nodes(deep))


STRATA = DEEP + f""", i AS (SELECT *, coalesce(lag(sym) OVER (PARTITION BY seq_id ORDER BY pos), '(') IN ('0', '1') AS goes_on FROM dp),
st AS (SELECT depth, count(*) FILTER (sym = '0') AS zeros, count(*) FILTER (sym = '1') AS ones, count(*) FILTER (NOT goes_on) AS runs FROM i WHERE sym IN ('0', '1') AND depth > 0 GROUP BY 1),
ss AS (SELECT depth, zeros, ones, runs, round({H2.format(o='ones', z='zeros')}, 6) AS entropy, round(CAST(ones AS DOUBLE) / (ones + zeros), 6) AS density FROM st)"""
ORDER = """
hh AS (SELECT depth, count(*) AS opens FROM dp WHERE sym = '(' GROUP BY 1),
h1 AS (SELECT count(*) AS depths, round(-sum(CAST(opens AS DOUBLE) / t * log2(CAST(opens AS DOUBLE) / t)), 6) AS entropy FROM (SELECT *, sum(opens) OVER () AS t FROM hh)),
h2 AS (SELECT round(2 * CAST(sum(i * opens) AS DOUBLE) / (count(*) * sum(opens)) - CAST(count(*) + 1 AS DOUBLE) / count(*), 6) AS gini FROM (SELECT *, row_number() OVER (ORDER BY opens, depth) AS i FROM hh))"""


@query(STRATA + " SELECT * FROM ss")
def stratified_order(spark, d):
    """Direct bits and islands by depth."""
    return structure.stratified(_deep(spark, d))


@query(DEEP + "," + ORDER + " SELECT depths, entropy, gini FROM h1, h2")
def depth_order(spark, d):
    """Entropy and Gini coefficient of the depths."""
    return structure.depth_order(_deep(spark, d))


PARTS = NODES + STRATA[len(DEEP) :] + """,
hh AS (SELECT depth, count(*) AS opens FROM dp WHERE sym = '(' GROUP BY 1),
p1 AS (SELECT greatest(0, least(1, 1 - -sum(CAST(opens AS DOUBLE) / t * log2(CAST(opens AS DOUBLE) / t)) / CASE WHEN max(depth) > 1 THEN log2(max(depth)) ELSE 1 END)) AS organisation FROM (SELECT *, sum(opens) OVER () AS t FROM hh)),
p2 AS (SELECT 1 / (1 + abs(coalesce(regr_slope(entropy, depth), 0))) AS gradient FROM ss),
p3 AS (SELECT 1 / (1 + coalesce(var_pop(n_ones + n_zeros), 0)) AS regularity, count(*) AS groups FROM nd),
pp AS (SELECT organisation, gradient, regularity, CASE WHEN (SELECT count(*) FROM sy WHERE sym IN ('(', ')')) = 2 * groups THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS balance FROM p1, p2, p3)"""


def order_parts(spark: SparkSession, d: str) -> DataFrame:
    """What the order index weighs, over all users' symbols."""
    deep = _deep(spark, d)
    return structure.order_parts(user_symbols(spark, d), deep, structure.nodes(deep))


@query(PARTS + " SELECT round(organisation, 6) AS organisation, round(gradient, 6) AS gradient, round(regularity, 6) AS regularity, balance, round(0.3::DOUBLE * organisation + 0.3::DOUBLE * gradient + 0.2::DOUBLE * regularity + 0.2::DOUBLE * balance, 6) AS index FROM pp")
def order_index(spark, d):
    """The order emergence index and its parts."""
    return structure.order_index(order_parts(spark, d))


@query(DEEP + """, b AS (SELECT seq_id, depth, CAST(sym AS INTEGER) AS b, row_number() OVER (PARTITION BY seq_id, depth ORDER BY pos) AS k FROM dp WHERE sym IN ('0', '1'))
SELECT x.depth, count(*) AS n, round(coalesce(CASE WHEN isnan(corr(x.b, y.b)) THEN 0 ELSE corr(x.b, y.b) END, 0), 6) AS r FROM b x JOIN b y ON x.seq_id = y.seq_id AND y.depth = x.depth + 1 AND x.k = y.k GROUP BY 1""")
def depth_correlation(spark, d):
    """Bits at a depth against those one deeper."""
    return structure.depth_correlation(_deep(spark, d))


@query(NODES + """, kk AS (SELECT seq_id, parent_pos AS open_pos, count(*) AS kids FROM np WHERE parent_pos IS NOT NULL GROUP BY 1, 2)
SELECT depth, count(*) AS nodes, count(kids) AS branching, round(coalesce(avg(kids), 0), 6) AS mean_children, round(avg(n_ones + n_zeros), 6) AS mean_content FROM np LEFT JOIN kk USING (seq_id, open_pos) GROUP BY 1""")
def nesting_tree(spark, d):
    """Children and content by depth."""
    return structure.tree(structure.nodes(_deep(spark, d)))


@query(NODES + ", z AS (SELECT (SELECT count(*) FROM nd b WHERE b.seq_id = a.seq_id AND b.open_pos >= a.open_pos AND b.close_pos <= a.close_pos) AS size FROM nd a) SELECT size, count(*) AS nodes FROM z GROUP BY 1")
def subtree_sizes(spark, d):
    """How many groups are within groups."""
    return structure.subtree_sizes(structure.nodes(_deep(spark, d)))


PAT = grams("uss", [4, 5, 6, 7]) + ", p AS (SELECT CAST(CAST(seq_id AS BIGINT) % 4 AS INTEGER) AS iteration, pattern, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 5)"


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return survival.iteration_patterns(cohort_bits(spark, d), range(4, 8), 5)


SURV = PAT + """, a AS (SELECT *, iteration - 1 AS prev FROM p),
f AS (SELECT coalesce(p.iteration, a.prev) AS iteration, p.pattern IS NOT NULL AS here, a.pattern IS NOT NULL AS there FROM p FULL JOIN a ON p.iteration = a.prev AND p.pattern = a.pattern),
sv AS (SELECT iteration, count(*) FILTER (here AND there) AS survived, count(*) FILTER (NOT there) AS lost, count(*) FILTER (NOT here) AS gained FROM f WHERE iteration < (SELECT max(iteration) FROM p) AND iteration >= (SELECT min(iteration) FROM p) GROUP BY 1)"""


@query(SURV + " SELECT *, round(CAST(survived AS DOUBLE) / (survived + lost), 6) AS rate FROM sv")
def pattern_survival(spark, d):
    """Patterns that survive, go and come between cohorts."""
    return survival.survival(_patterns(spark, d))


@query(SURV + """, c AS (SELECT iteration, gained - lost AS x, gained + lost AS y, lead(gained - lost) OVER w AS x2, lead(gained + lost) OVER w AS y2 FROM sv WINDOW w AS (ORDER BY iteration))
SELECT iteration, round(CAST(abs(x2 - x) AS DOUBLE) / (y + y2), 6) AS curvature FROM c WHERE y + y2 > 0""")
def pattern_curvature(spark, d):
    """How those steps bend."""
    return survival.curvature(survival.survival(_patterns(spark, d)))


@query(PAT + " SELECT pattern, count(DISTINCT iteration) AS iterations, CAST(sum(n) AS BIGINT) AS total FROM p GROUP BY 1 HAVING count(DISTINCT iteration) = (SELECT count(DISTINCT iteration) FROM p)")
def core_patterns(spark, d):
    """Patterns of all cohorts."""
    return survival.core(_patterns(spark, d))


@query(PAT + " SELECT b.pattern, b.iteration, b.n, round(CAST(b.n AS DOUBLE) / a.n, 6) AS ratio FROM p a JOIN p b ON a.pattern = b.pattern AND b.iteration = a.iteration + 1")
def pattern_growth(spark, d):
    """Growth of patterns between cohorts."""
    return survival.growth_ratios(_patterns(spark, d))


@query(PAT + ", l AS (SELECT pattern, CAST(max(iteration) - min(iteration) + 1 AS INTEGER) AS span, sum(n) AS total FROM p GROUP BY 1) SELECT span, count(*) AS patterns, round(avg(total), 6) AS mean_total FROM l GROUP BY 1")
def pattern_lifespans(spark, d):
    """For how many cohorts patterns last."""
    return survival.lifespans(_patterns(spark, d))


@query(PAT + """, f AS (SELECT p.n, a.pattern IS NOT NULL AS there FROM p LEFT JOIN p a ON a.pattern = p.pattern AND a.iteration = p.iteration + 1 WHERE p.iteration < (SELECT max(iteration) FROM p)),
c AS (SELECT DISTINCT n AS t FROM f), r AS (SELECT t, count(*) FILTER (NOT there AND n < t) AS lb, count(*) FILTER (NOT there AND n >= t) AS la, count(*) FILTER (there AND n < t) AS sb, count(*) FILTER (there AND n >= t) AS sa FROM c, f GROUP BY 1)
SELECT t AS threshold, round(CAST(lb + sa AS DOUBLE) / (lb + la + sb + sa) * 100, 6) AS accuracy, lb AS lost_below, la AS lost_above, sb AS survived_below, sa AS survived_above FROM r ORDER BY lb + sa DESC, t LIMIT 1""")
def survival_threshold(spark, d):
    """The count that tells best which patterns survive."""
    return survival.best_threshold(_patterns(spark, d))


@query("""a AS (SELECT CAST(seq_id AS BIGINT) // 2 AS pair, pos, bit FROM us WHERE CAST(seq_id AS BIGINT) % 2 = 0), b AS (SELECT CAST(seq_id AS BIGINT) // 2 AS pair, pos, bit FROM us WHERE CAST(seq_id AS BIGINT) % 2 = 1),
f AS (SELECT pair, pos, a.bit AS x, b.bit AS y FROM a FULL JOIN b USING (pair, pos)), m AS (SELECT pair, min(pos) FILTER (x IS DISTINCT FROM y) AS first, count(*) AS size FROM f GROUP BY 1)
SELECT pair, first, coalesce(first, size) AS same FROM m""")
def first_divergence(spark, d):
    """Where the sequences of neighbouring users part."""
    bits = user_bits(spark, d).withColumn("pair", F.floor(F.col("seq_id").cast("long") / 2).cast("long"))
    odd = F.col("seq_id").cast("long") % 2
    return survival.first_divergence(bits.where(odd == 0), bits.where(odd == 1), ["pair"])


def hilbert_sql(order: int, cell: int) -> str:
    """The CTEs of a Hilbert map: the curve grown by quadrants, each a turned copy of the one before, and its cells' counts."""
    grown = ["h0 AS (SELECT 0 AS d, 0 AS x, 0 AS y)"]
    for k in range(order):
        s, n = 1 << k, 4**k
        grown.append(
            f"h{k + 1} AS (SELECT d, y AS x, x AS y FROM h{k} UNION ALL SELECT d + {n}, x, y + {s} FROM h{k} UNION ALL SELECT d + {2 * n}, x + {s}, y + {s} FROM h{k} "
            f"UNION ALL SELECT d + {3 * n}, {2 * s - 1} - y, {s - 1} - x FROM h{k})"
        )
    fit = f"(SELECT greatest({cell}, CAST(ceil((max(pos) + 1) / {4**order}.0::DOUBLE) AS BIGINT)) FROM ev)"
    return ", ".join(grown) + f", by_cell AS (SELECT pos // {fit} AS d, sum(bit) AS ones, count(*) AS total FROM ev GROUP BY 1), cells AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, ones, total FROM by_cell JOIN h{order} USING (d)), dd AS (SELECT x, y, CAST(ones AS DOUBLE) / total AS d FROM cells)"


@query(hilbert_sql(6, 1) + """, r AS (SELECT CAST(sum(ones) AS DOUBLE) / sum(total) AS d FROM cells GROUP BY x // 4, y // 4)
SELECT count(*) AS cells, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS lowest, round(max(d), 6) AS highest FROM r""")
def hilbert_density(spark, d):
    """Densities of the events' bits on a Hilbert map."""
    return grid.density_stats(grid.rebin(grid.grid(event_bits(spark, d), 6), 4))


@query(hilbert_sql(5, 4) + """, k AS (SELECT * FROM (VALUES (1, 0), (0, 1)) v(dx, dy))
SELECT k.dx, k.dy, count(*) AS n, round(coalesce(corr(a.d, b.d), 0), 6) AS r FROM dd b, k, dd a WHERE a.x = (b.x + k.dx) % 32 AND a.y = (b.y + k.dy) % 32 GROUP BY 1, 2""")
def hilbert_neighbours(spark, d):
    """Correlation of neighbouring cells."""
    return grid.neighbour_correlation(grid.grid(event_bits(spark, d), 5, 4), 5)


@query(hilbert_sql(5, 4) + """, k AS (SELECT unnest(range(-2, 3)) AS k)
SELECT a.x + i.k AS x, a.y + j.k AS y, round(sum(a.d) / 25, 6) AS mean FROM dd a, k i, k j WHERE a.x + i.k BETWEEN 0 AND 31 AND a.y + j.k BETWEEN 0 AND 31 GROUP BY 1, 2""")
def hilbert_local_mean(spark, d):
    """Mean density around each cell."""
    return grid.local_mean(grid.grid(event_bits(spark, d), 5, 4), 5)


#: Users' symbols and those of all events as one sequence, unmatched closes dropped; results of any length are compared in parts.
TEXTS = DEEP.replace("FROM us)", "FROM us UNION ALL SELECT 'ev', event_id, CASE event_type WHEN 'signup' THEN '(' WHEN 'error' THEN ')' WHEN 'click' THEN '1' WHEN 'purchase' THEN '1' ELSE '0' END FROM events)")
TEXTS += ", tx AS (SELECT seq_id, string_agg(sym, '' ORDER BY pos) AS s FROM dp GROUP BY 1)"


def parts_sql(table: str, **rules: str) -> str:
    """The parts of ``recut`` of each rule's text, an expression over s."""
    each = " UNION ALL ".join(f"SELECT seq_id, '{k}' AS rule, {x} AS r FROM {table}" for k, x in rules.items())
    return f"SELECT seq_id, rule, part, substr(r, part * 1024 + 1, 1024) AS text FROM (SELECT seq_id, rule, r, unnest(range(0, (length(r) + 1023) // 1024)) AS part FROM ({each}))"


def _parts(**rules: DataFrame) -> DataFrame:
    """(seq_id, rule, part, text) of the texts of each rule."""
    every = [scan.recut(x).select("seq_id", F.lit(k).alias("rule"), "part", "text") for k, x in rules.items()]
    return reduce(DataFrame.unionByName, every)


def _all_deep(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(structure.depths(checkpointed(user_symbols(spark, d).unionByName(event_symbols(spark, d)))))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, chunk, text): symbols of each user and of all events, unmatched closes dropped, in chunks."""
    return checkpointed(scan.texts_of(_all_deep(spark, d)))


def _bit_texts(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, chunk, text): bits of each user and of all events, in chunks."""
    bits = user_bits(spark, d).select("seq_id", "pos", "bit").unionByName(event_bits(spark, d))
    return checkpointed(scan.texts_of(bits, "bit"))


BOTH = "bx AS (SELECT * FROM uss UNION ALL SELECT * FROM evs)"
LOCAL = r"translate(regexp_replace(regexp_replace({}, '\(1+\)', 'u', 'g'), '\([01]+\)', 'z', 'g'), 'uz', '10')"


@query(TEXTS + " " + parts_sql("tx", local_one=LOCAL.format("s"), local_two=LOCAL.format(LOCAL.format("s")), whole="CASE WHEN regexp_matches(translate(s, '()', ''), '^1+$') THEN '1' ELSE '0' END"))
def collapse_passes(spark, d):
    """Innermost groups collapsed once and twice, and all at once, of sequences of any length."""
    texts = _texts(spark, d)
    bits = texts.select("seq_id", F.explode(F.split(collapse.strip(F.col("text")), "")).alias("b")).where("b <> ''").groupBy("seq_id").agg(F.min("b").alias("text"))
    whole = texts.select("seq_id").distinct().join(bits, "seq_id", "left").select("seq_id", F.lit(0).cast("long").alias("chunk"), F.coalesce("text", F.lit("0")).alias("text"))
    one = checkpointed(collapse.local_passes(texts))
    return _parts(local_one=one, local_two=collapse.local_passes(one.drop("lengths")), whole=whole)


def phase_sql(x: str, first: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '{first}', '0', 'g'), '0+', '0', 'g'), '1+', '1', 'g')"


@query(BOTH + " " + parts_sql("bx", e=phase_sql(phase_sql("s", "01"), "10"), i=phase_sql(phase_sql("s", "10"), "01")))
def collapse_phases(spark, d):
    """Two-phase collapse in both orders, of sequences of any length."""
    texts = _bit_texts(spark, d)
    return _parts(e=collapse.phases(texts, "01", "10"), i=collapse.phases(texts, "10", "01"))


@query(NODES + " SELECT seq_id, open_pos, CASE WHEN n_zeros = 0 AND n_ones > 0 THEN 1 ELSE 0 END AS value FROM nd")
def collapse_tree(spark, d):
    """Every group's value when all within is collapsed."""
    return collapse.tree_collapse(structure.nodes(_deep(spark, d)))


FIRST = r"regexp_replace(s, '^(.*?)\([01]+\)', CASE WHEN regexp_matches(regexp_extract(s, '\(([01]+)\)', 1), '^1+$') THEN '\11' ELSE '\10' END)"
WHOLE = "CASE WHEN {0} = '' THEN '0' ELSE regexp_replace(regexp_replace({0}, '[01]*0[01]*', '0', 'g'), '1+', '1', 'g') END"


def frames_sql(ones: str, any_: str) -> str:
    return f"regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(s, '{ones}', 'u', 'g'), '{any_}', 'z', 'g'), 'uz', '10'), '0{{2,}}', '0', 'g'), '1{{2,}}', '1', 'g')"


@query(TEXTS + " " + parts_sql("tx", first_local=FIRST, first_whole=WHOLE.format(FIRST), pass_whole=WHOLE.format(LOCAL.format("s")), frames=frames_sql(r"1\(1+\)", r"1\([01]+\)"), frames_suffix=frames_sql(r"\(1+\)1", r"\([01]+\)1")))
def collapse_steps(spark, d):
    """The leftmost group alone, it and each pass with the bits between parentheses simplified after it, and atomic frames from both sides."""
    texts = _texts(spark, d)
    marked = checkpointed(scan.rewrite(texts, [collapse.marked(")", "(")], backwards=True)).drop("lengths")
    after = lambda *layers: scan.rewrite(marked, list(layers))
    first, every, base = collapse.groups_to_bits(first_only=True), collapse.groups_to_bits(), collapse.based()
    return _parts(first_local=after(first), first_whole=after(first, base), pass_whole=after(every, base), frames=after(collapse.frames_to_bits("(", ")"), collapse.squeezed()), frames_suffix=collapse.frames(texts, suffix=True))


@query(DEEP + " , t AS (SELECT seq_id, count(*) FILTER (sym = '(') AS o, count(*) FILTER (sym = ')') AS c, max(depth) AS max_depth, count(*) FILTER (sym IN ('0', '1')) AS bits FROM dp GROUP BY 1) SELECT max_depth, count(*) AS sequences, CAST(sum(least(o, c)) AS BIGINT) AS groups, CAST(sum(bits) AS BIGINT) AS bits FROM t GROUP BY 1")
def sequences_by_depth(spark, d):
    """Users by how deep their symbols nest."""
    return structure.by_max_depth(structure.depth_stats(_deep(spark, d)))


@query(grams("evs", [4, 5, 6]) + ", r AS (SELECT pattern, pos, count(*) OVER (PARTITION BY pattern) AS n, row_number() OVER (PARTITION BY pattern ORDER BY pos) AS i FROM g) SELECT pattern, any_value(n) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM r WHERE i <= 100 GROUP BY 1")
def pattern_positions(spark, d):
    """Counts of patterns and where they are first seen."""
    found = patterns.positions(event_bits(spark, d), range(4, 7))
    return found.select("pattern", "n", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(grams("evs", [4, 5, 6, 7, 8]) + """, m AS (SELECT pattern, 'sliding' AS method, count(*) AS n FROM g WHERE len < 8 GROUP BY 1 UNION ALL SELECT pattern, 'tiles', count(*) FROM g WHERE pos % len = 0 AND len > 5 GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, method) AS i FROM m) SELECT pattern, method, n FROM b WHERE i = 1 AND n >= 2""")
def merged_patterns(spark, d):
    """Sliding patterns and tiles as one set without duplicates."""
    bits = event_bits(spark, d)
    sliding = patterns.pattern_counts(bits, range(4, 8), 1).select("pattern", F.lit("sliding").alias("method"), "n")
    tiles = patterns.tiles(bits, [6, 7, 8], 1).select(F.col("tile").alias("pattern"), F.lit("tiles").alias("method"), "n")
    return patterns.merged(sliding, tiles)


@query(grams("evs", [3, 4, 5, 6, 7, 8]) + """, c AS (SELECT pattern, count(*) AS n, len AS k FROM g GROUP BY 1, 3 HAVING count(*) >= 2),
x AS (SELECT pattern, n, k, list_transform(string_split(pattern, ''), lambda v: CAST(v AS INTEGER)) AS b FROM c),
y AS (SELECT *, list_sum(list_transform(range(1, k), lambda l: list_sum(list_transform(range(1, k - l + 1), lambda i: b[i] * b[i + l])))) AS total FROM x)
SELECT pattern, n, round(CASE WHEN k >= 4 THEN CAST(total AS DOUBLE) / greatest(list_sum(b), 1) / (k - 1) ELSE 0 END, 6) AS autosimilarity FROM y""")
def pattern_autosimilarity(spark, d):
    """How much patterns are like themselves when shifted."""
    return patterns.autosimilarity(patterns.pattern_counts(event_bits(spark, d), range(3, 9)).select("pattern", "n"))


@query(grams("uss", [4]) + "," + TRANS + """, r AS (SELECT ctx, nxt, support, round(CAST(support AS DOUBLE) / total, 6) AS confidence FROM tt),
b AS (SELECT *, row_number() OVER (PARTITION BY ctx, nxt ORDER BY confidence DESC, support DESC) AS i FROM r) SELECT ctx, nxt, support, confidence FROM b WHERE i = 1""")
def distinct_rules(spark, d):
    """Users' rules without duplicates."""
    return rules.distinct_rules(rules.transitions(user_bits(spark, d), [3]))


@query(TEXTS + """, k0 AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS i, depth = 0 OR (sym = '(' AND depth = 1) AS outside FROM dp),
k1 AS (SELECT *, CASE WHEN outside AND row_number() OVER (PARTITION BY seq_id, i // 20, outside ORDER BY i) = 1 THEN 1 ELSE 0 END AS cut FROM k0),
k2 AS (SELECT *, sum(cut) OVER (PARTITION BY seq_id ORDER BY i) AS block FROM k1),
k3 AS (SELECT seq_id || ':' || CAST(block AS VARCHAR) AS seq_id, string_agg(sym, '' ORDER BY i) AS s FROM k2 GROUP BY seq_id, block) """ + parts_sql("k3", block=LOCAL.format("s")))
def collapse_blocks(spark, d):
    """Blocks cut where no group is open, each collapsed once; a block may be of any length."""
    blocks = collapse.safe_cuts(_all_deep(spark, d), 20).select(F.concat_ws(":", "seq_id", "block").alias("seq_id"), "chunk", "text")
    return _parts(block=collapse.local_passes(checkpointed(blocks)))


@query("RECURSIVE " + TEXTS.strip() + ", fx AS (SELECT seq_id, s, 0 AS i FROM tx UNION ALL SELECT seq_id, t, i + 1 FROM (SELECT seq_id, s, i, " + LOCAL.format("s") + " AS t FROM fx) WHERE t <> s), fl AS (SELECT seq_id, arg_max(s, i) AS s FROM fx GROUP BY 1) " + parts_sql("fl", full="s"))
def collapse_fixpoint(spark, d):
    """Groups collapsed pass by pass until none is left, of sequences of any length."""
    return _parts(full=collapse.collapse_to_end(_texts(spark, d)))


@query(TEXTS + """ SELECT seq_id, length(s) AS symbols, (length(s) + 3) // 4 AS packed_bytes, length(translate(s, '()', '')) AS clean_bits, round(1 - CAST((length(s) + 3) // 4 AS DOUBLE) / greatest(length(s), 1), 6) AS savings, true AS same FROM tx""")
def packed_storage(spark, d):
    """Symbols packed four to a byte, and unpacked again, chunk by chunk; chunks are of whole bytes."""
    dense = ranked(_all_deep(spark, d), "i").select("seq_id", (F.col("i") - 1).alias("pos"), "sym")
    t = scan.texts_of(dense).withColumn("p", codec.encode(F.col("text"))).withColumn("z", codec.storage(F.col("text")))
    same = (codec.decode(F.col("p"), F.length("text")) == F.col("text")) & (F.length("p") == 2 * F.col("z.packed_bytes"))
    out = t.groupBy("seq_id").agg(*[F.sum(f"z.{c}").alias(c) for c in ("symbols", "packed_bytes", "clean_bits")], F.every(same).alias("same"))
    return out.select("seq_id", "symbols", "packed_bytes", "clean_bits", F.round(1 - F.col("packed_bytes").cast("double") / F.greatest("symbols", F.lit(1)), 6).alias("savings"), "same")


@query(f"SELECT count(*) AS positions, CAST(sum(CASE WHEN f = bit THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM (SELECT bit, CAST(floor((pos + 2) / {scaling.PHI}::DOUBLE) - floor((pos + 1) / {scaling.PHI}::DOUBLE) AS INTEGER) AS f FROM ev)")
def fibonacci_agreement(spark, d):
    """How often events' bits equal those of the Fibonacci word."""
    bits = event_bits(spark, d)
    word = generators.fibonacci_word(bits.select("pos")).select("pos", F.col("bit").alias("f"))
    return bits.join(word, "pos").agg(F.count(F.lit(1)).alias("positions"), F.sum((F.col("f") == F.col("bit")).cast("long")).alias("agree"))


@query("s AS (SELECT k AS segment, CAST(floor(k / 10.0::DOUBLE * greatest((SELECT max(pos) + 1 FROM ev) - 100, 0)) AS BIGINT) AS start FROM range(10) r(k)) SELECT CAST(segment AS INTEGER) AS segment, min(pos) AS start, count(*) AS n, CAST(sum(bit) AS BIGINT) AS ones FROM ev JOIN s ON pos >= start AND pos < start + 100 GROUP BY 1")
def even_segments(spark, d):
    """Ten evenly spaced segments of 100 bits."""
    s = snapshots.segments(event_bits(spark, d), 10, 100)
    return s.groupBy("segment").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"))


@query("SELECT CAST(step AS INTEGER) AS step, count(*) AS n, CAST(sum(bit) AS BIGINT) AS ones FROM ev, (VALUES (1), (10), (100)) v(step) WHERE pos % step = 0 GROUP BY 1")
def systematic_samples(spark, d):
    """Every bit, every tenth and every hundredth."""
    return snapshots.every(event_bits(spark, d), [1, 10, 100]).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"))


@query("SELECT count(*) AS n, CAST(sum(bit) AS BIGINT) AS ones, min(pos) AS first FROM ev WHERE pos >= ((SELECT max(pos) + 1 FROM ev) - 500) // 2 AND pos < ((SELECT max(pos) + 1 FROM ev) - 500) // 2 + 500")
def centre_sample(spark, d):
    """The 500 bits in the middle."""
    return snapshots.centre(event_bits(spark, d), 500).agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"), F.min("pos").alias("first"))


@query(grams("evs", [3]) + ", c AS (SELECT pattern, count(*) AS n FROM g GROUP BY 1) SELECT round(sum(CAST(n AS DOUBLE) * n) / pow(sum(n), 2), 6) AS rate, CAST(sum(n) AS BIGINT) AS states FROM c")
def recurrence_rate(spark, d):
    """How often embedded states of three bits recur: counts by state, no pairs."""
    per = bit_ngrams(event_bits(spark, d), [3]).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n"), F.lit(2)), 6).alias("rate"), F.sum("n").alias("states"))


@query(None)
def chunk_complexity(spark, d):
    """LZ76, spectral slope, sample entropy and recurrence of chunks of the events' bits."""
    return kernels.per_chunk(chunks(event_bits(spark, d), size=2048, halo=0), kernels.complexity, kernels.COMPLEXITY).drop("seq_id")


@query(None)
def complexity_by_user(spark, d):
    """The same for each chunk of 1,024 bits of each user's sequence."""
    return kernels.per_chunk(chunks(user_bits(spark, d), halo=0), kernels.complexity, kernels.COMPLEXITY).select("seq_id", "chunk", "n", "phrases", "lz", "sampen")


@query(None)
def takens_persistence(spark, d):
    """Components of delay embeddings of chunks."""
    return kernels.per_chunk(chunks(event_bits(spark, d), size=1024, halo=0), kernels.takens, "points long, mean_life double, longer long").drop("seq_id")


@query(None)
def shuffle_control(spark, d):
    """Transfer entropy of the events' bits against that of their shuffled copy, and the class of the ratio."""
    bits = event_bits(spark, d)
    te = entropy.transfer_entropy(bits, [1, 2, 4]).select("src", "dst", "te")
    null = entropy.transfer_entropy(generators.shuffled(bits), [1, 2, 4]).select("src", "dst", F.col("te").alias("shuffled"))
    ratio = F.col("te") / F.greatest(F.col("shuffled"), F.lit(1e-9))
    kind = F.when(ratio >= 2, "strong").when(ratio >= 1.5, "moderate").when(ratio >= 1.1, "weak").otherwise("none")
    return te.join(null, ["src", "dst"]).select("src", "dst", "te", "shuffled", kind.alias("class"))
