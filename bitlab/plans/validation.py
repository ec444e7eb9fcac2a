"""Registered queries of rule validation, planning by length, growth ratios and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitlab.operators import entropy, patterns, reports, rules, scaling, structure, validation
from bitlab.plans.catalog import DAILY, DFA_SIZES, MI, RULES, STRATA, _deep, _lengths, blocks_sql, dfa_sql, grams, query
from bitlab.sources.tables import event_bits, user_bits


def _rules(spark, d):
    return rules.rule_metrics(rules.context_index(event_bits(spark, d), [1, 2, 3, 4, 5]))


@query(grams("uss", [4]) + """, q AS (SELECT seq_id, pattern, lead(pos) OVER (PARTITION BY seq_id, pattern ORDER BY pos) - pos AS gap FROM g),
t AS (SELECT seq_id, pattern, count(*) AS tests FROM q WHERE gap IS NOT NULL GROUP BY 1, 2),
m AS (SELECT pattern, sum(tests) AS tests FROM t GROUP BY 1),
r AS (SELECT DISTINCT pattern, gap AS period FROM q WHERE gap IS NOT NULL),
s AS (SELECT r.pattern, r.period, count(q.gap) AS hits, CAST(count(q.gap) AS DOUBLE) / any_value(t.tests) AS score
  FROM r JOIN t USING (pattern) LEFT JOIN q ON q.seq_id = t.seq_id AND q.pattern = r.pattern AND q.gap = r.period GROUP BY r.pattern, r.period, t.seq_id)
SELECT s.pattern, period, CAST(m.tests AS BIGINT) AS tests, round(CAST(sum(hits) AS DOUBLE) / m.tests, 6) AS accuracy, round(1 - stddev_pop(score), 6) AS stability
FROM s JOIN m USING (pattern) GROUP BY s.pattern, period, m.tests HAVING sum(hits) >= 2""")
def periodicity_validation(spark, d):
    """Periods of patterns of 4 bits, held against every user's sequence."""
    return validation.periodicity_validation(user_bits(spark, d), 4)


@query(grams("uss", [5]) + """, c AS (SELECT seq_id, left(pattern, 4) AS ctx, count(*) AS n, avg(CAST(right(pattern, 1) AS INTEGER)) AS p1 FROM g GROUP BY 1, 2),
o AS (SELECT DISTINCT left(pattern, 4) AS ctx, CAST(right(pattern, 1) AS INTEGER) AS prediction FROM g),
s AS (SELECT ctx, prediction, n, CASE WHEN prediction = 1 THEN p1 ELSE 1 - p1 END AS score FROM o JOIN c USING (ctx))
SELECT ctx, prediction, CAST(sum(n) AS BIGINT) AS tests, round(avg(score), 6) AS accuracy, round(CASE WHEN count(*) > 1 THEN greatest(0, 1 - stddev_pop(score)) ELSE 0.5 END, 6) AS stability FROM s GROUP BY 1, 2""")
def generic_validation(spark, d):
    """Which bit follows four bits, by the shares of all users."""
    return validation.generic_validation(user_bits(spark, d), 4)


@query(grams("evs", [2, 3, 4]) + ", " + grams("uss", [4, 5, 6, 7, 8], "gu").strip() + """, c AS (SELECT pattern, len, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT unnest(range(1, 4)) AS k),
p AS (SELECT a.pattern AS l, b.pattern AS r, k.k, a.pattern || substr(b.pattern, k.k + 1) AS whole FROM c a, c b, k
  WHERE a.pattern <> b.pattern AND k.k < a.len AND k.k < b.len AND right(a.pattern, k.k) = left(b.pattern, k.k)),
ru AS (SELECT l, r, arg_max(whole, k) AS whole FROM p WHERE whole IN (SELECT pattern FROM c) GROUP BY 1, 2),
o AS (SELECT seq_id, l, r, whole, CAST(contains(substr(s, greatest(0, pos - 20) + 1, pos + len + 20 - greatest(0, pos - 20)), whole) AS INTEGER) AS hit FROM ru JOIN gu ON gu.pattern = l || r JOIN uss USING (seq_id)),
sc AS (SELECT l, r, whole, seq_id, count(*) AS n, sum(hit) AS h FROM o GROUP BY 1, 2, 3, 4)
SELECT l AS "left", r AS "right", whole, CAST(sum(n) AS BIGINT) AS tests, round(CAST(sum(h) AS DOUBLE) / sum(n), 6) AS accuracy,
  round(CASE WHEN count(*) > 1 THEN 1 - stddev_pop(CAST(h AS DOUBLE) / n) ELSE 0.5 END, 6) AS stability FROM sc GROUP BY 1, 2, 3""")
def composition_validation(spark, d):
    """Overlapping patterns of the events, held against users' sequences."""
    found = patterns.overlaps(patterns.pattern_counts(event_bits(spark, d), range(2, 5)))
    return validation.composition_validation(user_bits(spark, d), found, [4, 5, 6, 7, 8])


@query(RULES + " SELECT stability >= 0.9 AS stable, count(*) AS rules, round(avg(stability), 6) AS mean, round(stddev_pop(stability), 6) AS std, min(stability) AS lowest, max(stability) AS highest FROM rr GROUP BY 1")
def stability_split(spark, d):
    """Stable and unstable rules."""
    return validation.stability_split(_rules(spark, d))


@query(RULES + """, adv AS (SELECT count(*) AS rules, avg(precision) AS mean, count(*) FILTER (precision < 0.6) AS poor, count(*) FILTER (precision > 0.9 AND stability > 0.9) AS excellent,
  count(*) FILTER (stability < 0.9) AS unstable FROM rr)
SELECT rules, poor, excellent, unstable, concat_ws('; ', CASE WHEN mean < 0.6 THEN 'adjust detection' END, CASE WHEN poor > 0 THEN 'drop or refine poor rules' END,
  CASE WHEN excellent > 0 THEN 'build on excellent rules' END, CASE WHEN unstable > rules * 0.3 THEN 'widen contexts' END) AS advice FROM adv""")
def rule_recommendations(spark, d):
    """What to do about the rules of contexts."""
    return validation.recommendations(_rules(spark, d))


SIZES = "z AS (SELECT seq_id, count(*) AS length FROM us GROUP BY 1 UNION ALL SELECT seq_id, count(*) FROM ev GROUP BY 1)"


def _sizes(spark, d):
    return validation.lengths(user_bits(spark, d).unionByName(event_bits(spark, d)))


@query(SIZES + """ SELECT seq_id, length, least(491, length) AS optimal, round(100 * CAST(least(491, length) AS DOUBLE) / length, 6) AS share,
CAST(floor(length * 0.05::DOUBLE) AS BIGINT) AS minimum, CAST(floor(log2(length * 50.0::DOUBLE / 6)) AS INTEGER) AS max_reliable FROM z""")
def sample_plan(spark, d):
    """Samples that patterns of 12 bits need, and the longest reliable pattern, of each sequence."""
    return validation.sample_plan(_sizes(spark, d), 12)


@query(SIZES + """, w AS (SELECT seq_id, length, greatest(64, least(CAST(floor(sqrt(length / 8.0::DOUBLE)) AS BIGINT), 4096)) AS side FROM z)
SELECT seq_id, length, CAST((SELECT max(p) FROM (SELECT unnest([64, 128, 256, 512, 1024, 2048, 4096]) AS p) WHERE p <= side) AS BIGINT) AS grid FROM w""")
def grid_plan(spark, d):
    """The side of each sequence's map."""
    return validation.grid_plan(_sizes(spark, d))


@query(DAILY + """, x AS (SELECT a.seq_id, count(*) AS runs FROM s a JOIN s b ON b.seq_id = a.seq_id AND b.iteration = a.iteration + 1 JOIN s c ON c.seq_id = a.seq_id AND c.iteration = a.iteration + 2 GROUP BY 1)
SELECT seq_id, count(*) AS iterations, coalesce(any_value(runs), 0) AS runs, coalesce(any_value(runs), 0) > 0 AS ready FROM s LEFT JOIN x USING (seq_id) GROUP BY 1""")
def iterations_ready(spark, d):
    """Which cohorts have three iterations in a row."""
    return validation.consecutive(_lengths(spark, d))


RATIOS = DAILY + ", x AS (SELECT seq_id, iteration, CAST(length AS DOUBLE) / lag(length) OVER (PARTITION BY seq_id ORDER BY iteration) AS ratio FROM s), rt AS (SELECT * FROM x WHERE ratio IS NOT NULL)"


@query(RATIOS + " SELECT floor(ratio / 0.5::DOUBLE) * 0.5::DOUBLE AS low, count(*) AS n FROM rt GROUP BY 1")
def ratio_histogram(spark, d):
    """Growth ratios of cohorts in bins of one half."""
    return validation.ratio_histogram(validation.growth_ratios(_lengths(spark, d)))


@query(RATIOS + ", k AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in scaling.CONSTANTS.items()) + ") v(constant, value)) SELECT constant, count(*) AS n, round(avg(abs(ratio - value)), 6) AS distance FROM rt, k GROUP BY 1")
def ratio_proximity(spark, d):
    """How far growth ratios lie from constants."""
    return validation.ratio_proximity(validation.growth_ratios(_lengths(spark, d)), scaling.CONSTANTS)


@query(STRATA + " SELECT count(*) AS depths, round(avg(entropy), 6) AS mean, round(var_pop(entropy), 6) AS variance, round(coalesce(regr_slope(entropy, depth), 0), 6) AS slope FROM ss")
def stratified_entropy(spark, d):
    """Mean, variance and slope of entropy over depths."""
    return validation.entropy_trend(structure.stratified(_deep(spark, d)))


@query(dfa_sql(2.0) + """, x AS (SELECT round(regr_slope(ln(f), ln(size)), 5) AS h FROM f WHERE f > 0)
SELECT h, CASE WHEN h < 0.4 THEN 'anti-persistent' WHEN h < 0.6 THEN 'uncorrelated' WHEN h < 0.85 THEN 'persistent' WHEN h <= 1.1 THEN 'critical' ELSE 'non-stationary' END AS class FROM x""")
def fluctuation_class(spark, d):
    """The class of the scaling exponent."""
    h = scaling.exponent(scaling.fluctuations(event_bits(spark, d), DFA_SIZES))
    return h.select("h", reports.classify(F.col("h"), reports.HURST, "non-stationary", closed=True).alias("class"))


@query(blocks_sql("ev", [8]) + """, s AS (SELECT block, CASE WHEN 2 * ones > 8 THEN 1 ELSE 0 END AS x FROM k),
j AS (SELECT lag, a.x, b.x AS y, count(*) AS n FROM s a, (VALUES (1), (2), (5), (10)) v(lag), s b WHERE b.block = a.block + lag GROUP BY 1, 2, 3), """
       + MI.replace("SELECT CAST(lag", ", mm AS (SELECT CAST(lag") + ") SELECT lag, mi, CASE WHEN mi < 0.01 THEN 'none' WHEN mi < 0.05 THEN 'weak' WHEN mi < 0.1 THEN 'moderate' ELSE 'strong' END AS class FROM mm")
def information_class(spark, d):
    """The class of mutual information at each lag."""
    mi = entropy.lagged_information(event_bits(spark, d), 8, [1, 2, 5, 10])
    return mi.select("lag", "mi", reports.classify(F.col("mi"), reports.INFORMATION, "strong").alias("class"))
