"""Registered queries of reports, tests and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitlab.functions import kernels
from bitlab.operators import collapse, entropy, patterns, reports, rules, scaling, structure, survival
from bitlab.operators.chunks import chunks
from bitlab.plans.catalog import BOTH, COUNTS, DAILY, DFA_SIZES, GAPS, PARTS, PAT, SURV, TORSION, TRANS, _bit_texts, _lengths, _patterns, dfa_sql, grams, order_parts, query, runs_sql
from bitlab.sources.generators import shuffled
from bitlab.sources.tables import event_bits, order_bits, user_bits


@query(grams("uss", [2]) + """, z AS (SELECT seq_id, max(pos) + 1 AS size FROM us GROUP BY 1),
a AS (SELECT seq_id, CAST(least(pos * 2 // size, 1) AS INTEGER) AS part, count(*) FILTER (pattern = '01') AS n01, count(*) FILTER (pattern = '10') AS n10 FROM g JOIN z USING (seq_id) GROUP BY 1, 2),
b AS (SELECT seq_id, CAST(least(pos * 2 // size, 1) AS INTEGER) AS part, round(avg(bit), 6) AS density FROM us JOIN z USING (seq_id) GROUP BY 1, 2)
SELECT seq_id, part, n01, n10, round(CAST(n01 AS DOUBLE) / nullif(n10, 0), 6) AS ratio, density FROM a JOIN b USING (seq_id, part)""")
def pair_balance(spark, d):
    """Rises against falls in both halves of users' sequences."""
    return reports.pair_balance(user_bits(spark, d))


@query(COUNTS + " SELECT CAST(len AS INTEGER) AS len, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS occurrences, round(avg(n), 6) AS mean, max(n) AS highest FROM c GROUP BY 1")
def pattern_report(spark, d):
    """Patterns by length."""
    return reports.pattern_report(patterns.pattern_counts(event_bits(spark, d), range(2, 7)))


ALL_TRANS = grams("evs", [2, 3, 4, 5, 6]) + "," + TRANS + ", q AS (SELECT ctx, support, round(CAST(support AS DOUBLE) / total, 6) AS confidence FROM tt)"


@query(ALL_TRANS + " SELECT CAST(least(floor(confidence * 50), 49) AS INTEGER) AS bin, count(*) AS rules, CAST(sum(support) AS BIGINT) AS support FROM q GROUP BY 1")
def confidence_histogram(spark, d):
    """Confidences of all transitions in 50 bins."""
    return reports.confidence_histogram(rules.transitions(event_bits(spark, d), [1, 2, 3, 4, 5]))


@query(ALL_TRANS + """ SELECT count(*) AS rules, round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN confidence >= 0.99 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS sure, round(avg(CASE WHEN confidence >= 0.9 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS likely,
  round(stddev_pop(support) / avg(support), 6) AS cv_support, round(CAST(count(DISTINCT ctx) AS DOUBLE) / count(*), 6) AS diversity FROM q""")
def rule_report(spark, d):
    """Their confidence bands and diversity."""
    return reports.rule_report(rules.transitions(event_bits(spark, d), [1, 2, 3, 4, 5]))


AROUND = grams("evs", [7]) + """, a AS (SELECT 'before' AS side, left(pattern, 3) AS ctx FROM g WHERE right(pattern, 4) = '0110' UNION ALL SELECT 'after', right(pattern, 3) FROM g WHERE left(pattern, 4) = '0110'),
cx AS (SELECT side, ctx, count(*) AS n, sum(count(*)) OVER (PARTITION BY side) AS t FROM a GROUP BY 1, 2)"""


@query(AROUND + " SELECT side, ctx, n, round(CAST(n AS DOUBLE) / t, 6) AS confidence FROM cx WHERE n >= 2")
def contexts_around(spark, d):
    """What stands around 0110."""
    return reports.contexts_around(event_bits(spark, d), "0110", 3).drop("seq_id")


@query(AROUND + ", p AS (SELECT DISTINCT side, ctx, n, substr(ctx, i, 2) AS part FROM cx, (VALUES (1), (2)) v(i) WHERE n >= 2 UNION SELECT side, ctx, n, ctx FROM cx WHERE n >= 2) SELECT side, part, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2")
def common_substrings(spark, d):
    """Parts that those contexts share."""
    return reports.common_substrings(reports.contexts_around(event_bits(spark, d), "0110", 3), range(2, 4))


SIM = grams("evs", [8]) + """, b AS (SELECT pattern, count(*) AS n FROM g WHERE pos % 8 = 0 GROUP BY 1),
m AS (SELECT x.pattern AS a, y.pattern AS b, round(1 - CAST(list_sum(list_transform(range(1, 9), lambda i: CASE WHEN substr(x.pattern, i, 1) <> substr(y.pattern, i, 1) THEN 1 ELSE 0 END)) AS DOUBLE) / 8, 6) AS match FROM b x JOIN b y ON x.pattern < y.pattern)"""


@query(SIM + " SELECT * FROM m")
def block_similarity(spark, d):
    """Similarity of all blocks of 8 bits."""
    return reports.block_similarity(event_bits(spark, d), 8)


@query(SIM + ", o AS (SELECT a FROM m WHERE match >= 0.8 UNION ALL SELECT b FROM m WHERE match >= 0.8) SELECT a, count(*) AS neighbours FROM o GROUP BY 1")
def block_neighbours(spark, d):
    """How many of them are alike."""
    return reports.similar_groups(reports.block_similarity(event_bits(spark, d), 8), 0.8)


@query(GAPS + f", m AS (SELECT pattern, count(*) AS gaps, round(avg(gap), 6) AS mean_gap FROM q GROUP BY 1) SELECT count(*) AS patterns, round(CAST(sum(greatest(0, 1 - abs(mean_gap / 6 - {reports.PHI}::DOUBLE) / {reports.PHI}::DOUBLE) * gaps) AS DOUBLE) / sum(gaps), 6) AS coherence FROM m")
def phi_coherence(spark, d):
    """How near mean gaps over length are to the golden ratio."""
    return reports.phi_coherence(patterns.recurrence(event_bits(spark, d), 6), 6)


@query(grams("evs", [5]) + """, c AS (SELECT pattern, least(pos * 10 // (SELECT max(pos) + 1 FROM ev), 9) AS seg, count(*) AS n FROM g GROUP BY 1, 2), s AS (SELECT pattern, CAST(sum(n) AS DOUBLE) / 10 AS m, CAST(sum(n * n) AS DOUBLE) / 10 AS sq FROM c GROUP BY 1)
SELECT pattern, round((sq - m * m) / (m * m), 6) AS torsion, round((sq - m * m) / (m * m), 6) > 0.1 AS flagged FROM s ORDER BY 2 DESC, 1 LIMIT 50""")
def position_torsion(spark, d):
    """Patterns that are spread unevenly."""
    return reports.position_torsion(event_bits(spark, d), 5, 10).drop("seq_id")


@query("r AS (SELECT seq_id, count(*) AS n, CAST(sum(bit) AS BIGINT) AS t FROM us GROUP BY 1) SELECT count(*) AS points, round(covar_samp(ln(t), ln(n)) / var_pop(ln(n)), 6) AS exponent FROM r WHERE n > 0 AND t > 0")
def scaling_exponent(spark, d):
    """Ones against length over users, on logarithmic scales."""
    return reports.scaling_exponent(user_bits(spark, d).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("t")))


@query(grams("uss", [3]) + """, c AS (SELECT seq_id, count(*) FILTER (left(pattern, 2) = '01' AND right(pattern, 1) = '1') AS tp, count(*) FILTER (left(pattern, 2) = '01' AND right(pattern, 1) <> '1') AS fp, count(*) FILTER (left(pattern, 2) <> '01' AND right(pattern, 1) = '1') AS fn FROM g GROUP BY 1)
SELECT seq_id, tp, fp, fn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(2 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def position_scores(spark, d):
    """One rule's precision and recall by user."""
    return reports.position_scores(user_bits(spark, d), "01", 1)


@query("RECURSIVE " + BOTH + r""", tr AS (
  SELECT seq_id, 'both' AS rule, 0 AS i, s, 'initial' AS action, false AS still FROM bx UNION ALL SELECT seq_id, '01 first', 0, s, 'initial', false FROM bx
  UNION ALL
  SELECT seq_id, rule, i + 1, t, act, t = s FROM (SELECT *, CASE WHEN rule = 'both' THEN 'both' WHEN i % 3 = 0 THEN '01' WHEN i % 3 = 1 THEN '10' ELSE 'squeeze' END AS act,
    CASE WHEN rule = 'both' THEN regexp_replace(s, '01|10', '', 'g') WHEN i % 3 = 0 THEN regexp_replace(s, '01', '', 'g') WHEN i % 3 = 1 THEN regexp_replace(s, '10', '', 'g') ELSE regexp_replace(regexp_replace(s, '0+', '0', 'g'), '1+', '1', 'g') END AS t FROM tr) WHERE i < 60 AND s <> ''),
tl AS (SELECT seq_id, rule, i, action, length(s) AS length FROM tr UNION ALL SELECT seq_id, rule, 1000, 'squeeze', length(regexp_replace(regexp_replace(s, '0+', '0', 'g'), '1+', '1', 'g')) FROM tr WHERE rule = 'both' QUALIFY row_number() OVER (PARTITION BY seq_id, rule ORDER BY i DESC) = 1),
tw AS (SELECT *, lag(length) OVER (PARTITION BY seq_id, rule ORDER BY i) AS was FROM tl)
SELECT seq_id, rule, CAST(row_number() OVER (PARTITION BY seq_id, rule ORDER BY i) - 1 AS INTEGER) AS step, action, length, round(CASE WHEN was > 0 THEN CAST(length AS DOUBLE) / was END, 6) AS ratio FROM tw WHERE was IS NULL OR length < was""")
def deletion_trace(spark, d):
    """Lengths as pairs are deleted until nothing changes, of each user's bits and of all events' as one sequence, by two rules."""
    texts = _bit_texts(spark, d)
    both = collapse.deletion_trace(texts, "both").withColumn("rule", F.lit("both"))
    return both.unionByName(collapse.deletion_trace(texts, "01 first").withColumn("rule", F.lit("01 first")))


@query("m AS (SELECT avg(bit) AS m, var_pop(bit) AS v FROM od), x AS (SELECT pos, bit - m AS x, v FROM od, m) SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(avg(a.x * b.x) / any_value(a.v), 6) AS r FROM x a, range(1, 13) r(lag), x b WHERE b.pos = a.pos + lag GROUP BY 1")
def autocorrelation(spark, d):
    """Autocorrelation of the orders' bits at 12 lags."""
    return reports.autocorrelation(order_bits(spark, d), 12).drop("seq_id")


#: Areas under Student's curve are areas under a power of the cosine, by Simpson's rule over 200 steps; the quantile is found by halving the angle.
@query("RECURSIVE " + DAILY.strip() + """, fq AS (SELECT seq_id, count(*) AS n, max(iteration) + 2 AS target, regr_slope(length, iteration) AS b, regr_intercept(length, iteration) AS a, regr_sxx(length, iteration) AS sxx, regr_syy(length, iteration) AS syy, regr_avgx(length, iteration) AS mx FROM s GROUP BY 1),
gq AS (SELECT *, a + b * target AS expected, CASE WHEN n > 2 THEN greatest(0, (syy - b * b * sxx) / (n - 2)) END AS mse FROM fq),
hq AS (SELECT *, sqrt(mse * (1 + 1.0::DOUBLE / n + (target - mx) * (target - mx) / nullif(sxx, 0))) AS se, CASE WHEN mse > 0 AND sxx > 0 THEN atan(abs(b / sqrt(mse / sxx)) / sqrt(n - 2)) END AS angle FROM gq),
wt AS (SELECT i / 200.0::DOUBLE AS x, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 600.0::DOUBLE AS w FROM range(201) r(i)),
tf AS (SELECT df, sum(w * pow(cos(pi() / 2 * x), df - 1)) * pi() / 2 AS area FROM (SELECT DISTINCT n - 2 AS df FROM fq WHERE n > 2), wt GROUP BY 1),
hv AS (SELECT df, area, 0 AS i, 0.0::DOUBLE AS low, pi() / 2 AS high FROM tf UNION ALL
  SELECT df, area, i + 1, CASE WHEN part < 0.95::DOUBLE THEN mid ELSE low END, CASE WHEN part < 0.95::DOUBLE THEN high ELSE mid END FROM (
    SELECT hv.*, (low + high) / 2 AS mid, (SELECT sum(w * pow(cos((hv.low + hv.high) / 2 * x), hv.df - 1)) FROM wt) * (low + high) / 2 / area AS part FROM hv WHERE i < 50)),
tq AS (SELECT df, area, sqrt(df) * tan((low + high) / 2) AS q FROM hv WHERE i = 50),
ap AS (SELECT seq_id, 1 - sum(w * pow(cos(angle * x), n - 3)) * angle / any_value(area) AS p FROM hq JOIN tq ON df = n - 2, wt WHERE angle IS NOT NULL GROUP BY seq_id, angle)
SELECT seq_id, n, target, round(expected, 4) AS expected, round(se, 4) AS error, round(expected - q * se, 3) AS low, round(expected + q * se, 3) AS high, round(p, 6) AS p FROM hq LEFT JOIN tq ON df = n - 2 LEFT JOIN ap USING (seq_id)""")
def forecast(spark, d):
    """Lengths two iterations on."""
    return reports.forecast(_lengths(spark, d), "length", 2)


@query("""r AS (SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS variant, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean_value FROM events GROUP BY ROLLUP (event_type)) SELECT variant, n, users, mean_value FROM r""")
def variant_summary(spark, d):
    """Each kind of event, and all."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.rollup("event_type").agg(F.grouping("event_type").alias("all"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean_value")).select(F.when(F.col("all") == 1, "all").otherwise(F.col("event_type")).alias("variant"), "n", "users", "mean_value")


@query(PAT + """, a AS (SELECT iteration, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS occurrences FROM p GROUP BY 1) SELECT iteration, patterns, occurrences, round(CAST(patterns AS DOUBLE) / lag(patterns) OVER (ORDER BY iteration), 6) AS change FROM a ORDER BY 1 DESC LIMIT 3""")
def pattern_evolution(spark, d):
    """Numbers of patterns in the last three cohorts."""
    from pyspark.sql import Window

    per = _patterns(spark, d).groupBy("iteration").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("occurrences"))
    w = Window.partitionBy(F.lit(0)).orderBy("iteration")  # a row per cohort
    return per.withColumn("change", F.round(F.col("patterns").cast("double") / F.lag("patterns").over(w), 6)).orderBy(F.desc("iteration")).limit(3)


DRAW = "CASE WHEN u < 24109 THEN 0 WHEN u < 48219 THEN 1 WHEN u < 60273 THEN 2 WHEN u < 64292 THEN 3 WHEN u < 65296 THEN 4 ELSE 5 END"


@query(runs_sql("ev") + f""", x AS (SELECT len, g, i, CAST('0x' || substr(md5(seq_id || '|' || start || '|' || g), 4 * i + 1, 4) AS INTEGER) AS u FROM r, range(12) a(g), range(8) b(i)),
m AS (SELECT g, i, CAST(sum(len * {DRAW}) AS DOUBLE) / sum({DRAW}) AS m FROM x GROUP BY 1, 2)
SELECT (SELECT count(*) FROM r) AS n, (SELECT round(avg(len), 6) FROM r) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_runs(spark, d):
    """An interval for the mean length of runs."""
    out = reports.bootstrap_mean(scaling.runs(event_bits(spark, d)), "len", ["seq_id", "start"])
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(None)
def permutation_runs(spark, d):
    """The number of runs against that of 20 shuffled copies, with all three alternatives."""
    bits = event_bits(spark, d)
    own = scaling.runs(bits).agg(F.count(F.lit(1)).alias("runs"))
    copies = bits.withColumn("seq_id", F.explode(F.array(*[F.lit(f"copy{i}") for i in range(20)])))
    null = scaling.runs(shuffled(copies)).groupBy("seq_id").agg(F.count(F.lit(1)).alias("null"))
    return reports.permutation_test(null, own.withColumnRenamed("runs", "observed"))


@query(PARTS + """, w AS (SELECT * FROM (VALUES ('organisation', 0.3::DOUBLE), ('gradient', 0.3::DOUBLE), ('regularity', 0.2::DOUBLE), ('balance', 0.2::DOUBLE)) v(weight, w)),
m AS (SELECT a.weight, c.change, b.weight AS part, CASE WHEN a.weight = b.weight THEN greatest(0.05::DOUBLE, b.w + c.change) ELSE b.w END AS w FROM w a, w b, (VALUES (-0.1::DOUBLE), (0.1::DOUBLE)) c(change)),
v AS (UNPIVOT pp ON organisation, gradient, regularity, balance INTO NAME part VALUE x)
SELECT weight, change, round(sum(w * x) / sum(w), 6) AS index FROM m JOIN v USING (part) GROUP BY 1, 2""")
def order_sensitivity(spark, d):
    """The order index as its weights move."""
    return reports.sensitivity(order_parts(spark, d), structure.ORDER_WEIGHTS)


@query(None)
def complexity_index(spark, d):
    """A composite of fluctuation exponent, entropy rate and transfer, with its class."""
    bits = event_bits(spark, d)
    h = scaling.exponent(scaling.fluctuations(bits, DFA_SIZES)).select("seq_id", "h")
    e = entropy.block_entropy(bits, [8]).select("seq_id", "rate")
    t = entropy.directions(entropy.transfer_entropy(bits, [1, 2, 4])).select("seq_id", "up")
    out = h.join(e, "seq_id").join(t, "seq_id")
    return out.select("h", "rate", "up", F.round(reports.complexity_index(F.col("h"), F.col("rate"), F.col("up")), 6).alias("index"), reports.classify(F.col("h"), reports.HURST, "non-stationary", closed=True).alias("hurst"))


@query(None)
def welch_spectrum(spark, d):
    """Mean power of chunks by frequency bin, and its slope's ingredients."""
    return kernels.spectrum(chunks(event_bits(spark, d), size=256, halo=0), 256)


@query(None)
def spectral_peaks(spark, d):
    """Frequencies that stand out of that spectrum, with their periods."""
    return kernels.spectrum_peaks(kernels.spectrum(chunks(event_bits(spark, d), size=256, halo=0), 256))


@query(SURV + """, cc AS (SELECT iteration, gained - lost AS x, gained + lost AS y, lead(gained - lost) OVER w AS x2, lead(gained + lost) OVER w AS y2 FROM sv WINDOW w AS (ORDER BY iteration)),
cv AS (SELECT iteration, round(CAST(abs(x2 - x) AS DOUBLE) / (y + y2), 6) AS curvature FROM cc WHERE y + y2 > 0), rs AS (SELECT iteration, round(CAST(survived AS DOUBLE) / (survived + lost), 6) AS rate FROM sv),""" + grams("evs", [2, 3, 4], "ge") + """,
zt AS (SELECT *, (SELECT (max(pos) + 1) // 10 FROM ev) AS w FROM ge WHERE list_contains(""" + str(TORSION) + """, pattern)),
ct AS (SELECT pattern, pos // w AS seg, count(*) AS n FROM zt WHERE pos // w < 10 AND pos + len <= (pos // w + 1) * w GROUP BY 1, 2),
mt AS (SELECT pattern, sum(n) / 10.0::DOUBLE AS mean, sum(n * n) / 10.0::DOUBLE AS sq FROM ct GROUP BY 1),
av AS (SELECT sum(round((sq - mean * mean) / mean, 6)) / 12.0::DOUBLE AS t FROM mt)
SELECT iteration, round(curvature * curvature + t * t + (1 - rate), 6) AS energy FROM rs JOIN cv USING (iteration), av""")
def energy(spark, d):
    """Curvature, torsion and loss by step between cohorts, with weights of one each."""
    steps = survival.survival(_patterns(spark, d))
    t = patterns.torsion(event_bits(spark, d), TORSION, 10).agg((F.coalesce(F.sum("torsion"), F.lit(0.0)) / len(TORSION)).alias("t"))
    return reports.energy(steps.join(survival.curvature(steps), "iteration").crossJoin(F.broadcast(t))).select("iteration", F.round("energy", 6).alias("energy"))  # one row




@query("z AS (SELECT (SELECT max(pos) + 1 FROM ev) AS n), p AS (SELECT 'start' AS part, 0 AS s FROM z UNION ALL SELECT 'middle', greatest(0, (n - 1000) // 2) FROM z UNION ALL SELECT 'end', greatest(0, n - 1000) FROM z) SELECT part, count(*) AS n, CAST(sum(bit) AS BIGINT) AS ones, min(pos) AS first FROM ev JOIN p ON pos >= s AND pos < s + 1000 GROUP BY 1")
def three_part_sample(spark, d):
    """A thousand bits from the start, the middle and the end."""
    from bitlab.sources.snapshots import three_parts

    return three_parts(event_bits(spark, d), 1000).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"), F.min("pos").alias("first"))


@query(None)
def stratified_sample(spark, d):
    """Bits of segments drawn one from each region."""
    from bitlab.sources.snapshots import stratified

    return stratified(event_bits(spark, d), 1000, 50).groupBy("segment").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"))


SINGULAR = dfa_sql(2.0).strip().split("\nf AS")[0] + """
sf AS (SELECT q, size, round(pow(avg(pow(greatest(0, vy - c * c / vx), q / 2)), 1 / q), 6) AS f FROM b, (VALUES (-4.0::DOUBLE), (-2.0::DOUBLE), (-1.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) v(q) WHERE n = size GROUP BY 1, 2),
sh AS (SELECT q, round(q * round(regr_slope(ln(f), ln(size)), 5) - 1, 5) AS tau FROM sf WHERE f > 0 GROUP BY 1),
sw AS (SELECT q, tau, (coalesce(lead(tau) OVER w, tau) - coalesce(lag(tau) OVER w, tau)) / (coalesce(lead(q) OVER w, q) - coalesce(lag(q) OVER w, q)) AS alpha FROM sh WINDOW w AS (ORDER BY q))"""


@query(SINGULAR + " SELECT q, round(alpha, 5) AS alpha, round(q * alpha - tau, 5) AS f FROM sw")
def singularity_spectrum(spark, d):
    """The multifractal spectrum of the events' bits."""
    return scaling.singularity(scaling.multifractal(event_bits(spark, d), DFA_SIZES, [-4.0, -2.0, -1.0, 1.0, 2.0, 4.0])).drop("seq_id")


@query(None)
def complexity_by_scale(spark, d):
    """LZ76 complexity of chunks at golden and doubling sizes, averaged by size."""
    bits = event_bits(spark, d)
    parts = [kernels.per_chunk(chunks(bits, size=n, halo=0), kernels.complexity, kernels.COMPLEXITY).where(F.col("n") == n).select(F.lit(n).alias("size"), "lz") for n in (89, 128, 144, 233, 256, 377, 512)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("size").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("lz"), 6).alias("mean_lz"), F.round(F.var_pop("lz"), 8).alias("var_lz"))
