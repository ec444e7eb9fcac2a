"""Registered queries of block clusters, distant blocks and structured complexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitlab.functions import kernels
from bitlab.operators import clusters, entropy, indexes, rules, scaling, spectra
from bitlab.operators.chunks import chunks
from bitlab.operators.codes import text_of
from bitlab.plans.catalog import DFA_SIZES, ENT, TRANS, dfa_sql, grams, query
from bitlab.sources.tables import event_bits, user_bits

#: Block sizes that are clustered, the similarity of neighbours and the count that makes a core.
SIZES, SIMILARITY, MIN_COUNT = (8, 16), 0.8, 3


def _clusters_sql(size: int) -> str:
    """CTEs of the clusters of one size, by all pairs and the closure of the cores' links."""
    k, reach = f"_{size}", int((1 - SIMILARITY) * size + 1e-9)
    return f"""
b{k} AS (SELECT substr(s, i, {size}) AS pattern, i - 1 AS pos FROM (SELECT s, unnest(range(1, length(s) - {size} + 2, {size // 2})) AS i FROM evs)),
c{k} AS MATERIALIZED (SELECT pattern, list_reduce(list_transform(string_split(pattern, ''), lambda x: CAST(x AS BIGINT)), lambda a, x: 2 * a + x) AS code, count(*) AS n, min(pos) AS first_pos FROM b{k} GROUP BY 1),
e{k} AS MATERIALIZED (SELECT a.code AS a, b.code AS b, b.n AS m FROM c{k} a JOIN c{k} b ON a.code <> b.code AND bit_count(xor(a.code, b.code)) <= {reach}),
d{k} AS MATERIALIZED (SELECT c.*, c.n + coalesce(m, 0) >= {MIN_COUNT} AS core FROM c{k} c LEFT JOIN (SELECT a, sum(m) AS m FROM e{k} GROUP BY 1) x ON x.a = c.code),
l{k} AS MATERIALIZED (SELECT a, b FROM e{k} JOIN d{k} x ON x.code = a AND x.core JOIN d{k} y ON y.code = b AND y.core),
r{k} AS (SELECT code, code AS other FROM d{k} WHERE core UNION SELECT r{k}.code, l{k}.b FROM r{k} JOIN l{k} ON r{k}.other = l{k}.a),
n{k} AS MATERIALIZED (SELECT r.code, min(d.first_pos) AS cluster FROM r{k} r JOIN d{k} d ON d.code = r.other GROUP BY 1),
o{k} AS (SELECT a AS code, min(cluster) AS border FROM e{k} JOIN n{k} ON n{k}.code = b GROUP BY 1),
f{k} AS (SELECT CAST({size} AS INTEGER) AS size, pattern, n, first_pos, core, coalesce(CASE WHEN core THEN cluster ELSE border END, -1) AS cluster FROM d{k} LEFT JOIN n{k} USING (code) LEFT JOIN o{k} USING (code))"""


@query("RECURSIVE " + ",".join(_clusters_sql(n) for n in SIZES).strip() + " " + " UNION ALL ".join(f"SELECT * FROM f_{n}" for n in SIZES))
def block_clusters(spark, d):
    """Blocks of 8 and 16 bits clustered by density under the Hamming distance; noise is cluster -1."""
    bits, found = event_bits(spark, d), None
    for size in SIZES:
        blocks = clusters.density_clusters(clusters.stepped_blocks(bits, size), size, SIMILARITY, MIN_COUNT)
        one = blocks.select(F.lit(size).alias("size"), text_of(F.col("code"), F.lit(size)).alias("pattern"), "n", "first_pos", "core", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
        found = one if found is None else found.unionByName(one)
    return found


DISTANT = """zn AS (SELECT max(pos) + 1 AS n FROM ev), zm AS (SELECT n, CASE WHEN n >= 10200 THEN 10000 ELSE (n - 200) // 2 END AS most FROM zn),
zd AS (SELECT n, most, least(20, most // 100) AS k FROM zm WHERE most >= 100),
zs AS (SELECT n, CAST(floor(100 + (most - 100) * i / CAST(greatest(1, k - 1) AS DOUBLE)) AS BIGINT) AS distance FROM (SELECT *, unnest(range(k)) AS i FROM zd)),
zp AS (SELECT n, distance, CAST(unnest(range(greatest(1, least(10, (n - 100 - distance) // 200)))) AS INTEGER) AS nth FROM zs),
zt AS (SELECT distance, nth, CAST('0x' || substr(md5('42|' || distance || '|' || nth), 1, 15) AS BIGINT) % (n - 100 - distance) AS start FROM zp),
zx AS (SELECT distance, nth, start, 2 * a.bit + b.bit AS cell FROM zt, range(100) r(i), ev a, ev b WHERE a.pos = start + i AND b.pos = start + distance + i),
zc AS (SELECT distance, nth, start, cell, count(*) / 100.0::DOUBLE AS p FROM zx GROUP BY ALL),
zq AS (SELECT *, sum(p) OVER (PARTITION BY distance, nth, cell // 2) AS p1, sum(p) OVER (PARTITION BY distance, nth, cell % 2) AS p2 FROM zc),
zi AS (SELECT distance, nth, start, greatest(0, sum(p * log2(p / (p1 * p2)))) AS mi FROM zq GROUP BY 1, 2, 3)"""


@query(DISTANT + " SELECT distance, nth, start, round(mi, 6) AS mi FROM zi")
def distant_information(spark, d):
    """Mutual information of drawn pairs of distant blocks."""
    return clusters.distant_information(event_bits(spark, d)).withColumn("mi", F.round("mi", 6))


@query(DISTANT + " SELECT count(*) AS n, round(avg(mi), 6) AS mean, round(stddev_pop(mi) / sqrt(count(*)), 6) AS error FROM zi")
def distant_coherence(spark, d):
    """Its mean and standard error over all pairs."""
    out = clusters.mean_and_error(clusters.distant_information(event_bits(spark, d)), "mi")
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"))


@query("RECURSIVE " + grams("uss", [6]).strip() + "," + TRANS + """, cg AS (SELECT seq_id, -sum(CAST(support AS DOUBLE) / t * log2(CAST(support AS DOUBLE) / total)) AS h_given FROM (SELECT *, sum(support) OVER (PARTITION BY seq_id) AS t FROM tt) GROUP BY 1),
ch AS (SELECT seq_id, CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0 END AS h FROM (SELECT seq_id, avg(bit) AS p FROM us GROUP BY 1)),""" + grams("uss", [1, 2, 4, 8], "gb") + """,
bb AS (SELECT seq_id, len AS size, pattern, count(*) AS n FROM gb WHERE pos % len = 0 GROUP BY 1, 2, 3),
be AS (SELECT seq_id, size, sum(n) AS blocks, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY seq_id, size) AS DOUBLE) AS t FROM bb) GROUP BY 1, 2),
by_ AS (SELECT seq_id, round(e, 6) / log2(least(pow(2.0::DOUBLE, size), blocks)) AS y FROM be WHERE blocks > 1),
hi AS (SELECT seq_id, round(stddev_pop(y) / avg(y), 6) AS cv FROM by_ GROUP BY 1),
ck AS (SELECT seq_id, part, substr(s, part * 1024 + 1, 1024) AS s FROM (SELECT seq_id, s, unnest(range((length(s) + 1023) // 1024)) AS part FROM uss)),
lz AS (SELECT seq_id, part, s, 0 AS i, 0 AS c FROM ck UNION ALL
  SELECT seq_id, part, s, i + 1 + coalesce(list_max(list_filter(range(1, least(length(s) - i, i) + 1), lambda l: contains(substr(s, 1, i), substr(s, i + 1, l)))), 0), c + 1 FROM lz WHERE i < length(s)),
ln_ AS (SELECT seq_id, part, length(s) AS n, max(c) AS c FROM lz GROUP BY ALL),
lq AS (SELECT seq_id, sum(c) AS phrases, round(avg(CASE WHEN n > 1 THEN least(1, c * log2(n) / n) ELSE 0 END), 6) AS lz FROM ln_ GROUP BY 1),
sx AS (SELECT seq_id, round(greatest(0, h - h_given), 6) AS transfer, phrases, lz, cv, (1 - abs(2 * lz - 1)) * 0.5::DOUBLE AS nontrivial, least(1, greatest(0, h - h_given) / 0.5::DOUBLE) AS causal FROM ch JOIN cg USING (seq_id) JOIN hi USING (seq_id) JOIN lq USING (seq_id)),
sy AS (SELECT *, 0.35::DOUBLE * least(1, cv * 2) + 0.4::DOUBLE * causal + 0.25::DOUBLE * nontrivial AS sci FROM sx)
SELECT seq_id, transfer, CASE WHEN transfer < 0.1 THEN 'weak' WHEN transfer < 0.3 THEN 'moderate' WHEN transfer < 0.6 THEN 'strong' ELSE 'very strong' END AS causality, CAST(phrases AS BIGINT) AS phrases, lz, cv AS hierarchy, round(nontrivial, 6) AS nontriviality,
  CASE WHEN nontrivial < 0.2 THEN 'trivial' WHEN nontrivial < 0.4 THEN 'low' WHEN nontrivial < 0.6 THEN 'moderate' WHEN nontrivial < 0.8 THEN 'high' ELSE 'very high' END AS nontrivial_class, round(sci, 5) AS sci,
  CASE WHEN sci < 0.2 THEN 'low' WHEN sci < 0.4 THEN 'moderate' WHEN sci < 0.6 THEN 'good' WHEN sci < 0.8 THEN 'high' ELSE 'very high' END AS sci_class FROM sy""")
def structured_complexity(spark, d):
    """The structured complexity index of each user's bits, with what it is made of; LZ76 is the mean over chunks of 1,024 bits."""
    bits = user_bits(spark, d)
    transfer = F.greatest(F.lit(0.0), F.col("h") - F.col("h_given"))
    cause = rules.conditional(bits, 5).select("seq_id", transfer.alias("t"))
    hierarchy = entropy.hierarchy(entropy.block_entropy(bits, [1, 2, 4, 8])).select("seq_id", "cv")
    phrases = kernels.per_chunk(chunks(bits, halo=0), kernels.phrases, "phrases long")
    lz = phrases.groupBy("seq_id").agg(F.sum("phrases").alias("phrases"), F.round(F.avg(indexes.normalised_lz(F.col("phrases"), F.col("n"))), 6).alias("lz"))
    all_ = cause.join(hierarchy, "seq_id").join(lz, "seq_id")
    nontrivial = indexes.nontriviality(F.col("lz"), F.lit(0.5))
    sci = indexes.sci(F.least(F.lit(1.0), F.col("cv") * 2), F.least(F.lit(1.0), F.col("t") / 0.5), nontrivial)
    t = F.round("t", 6)
    return all_.select(
        "seq_id", t.alias("transfer"), indexes.class_of(t, indexes.TRANSFER, "very strong").alias("causality"), "phrases", "lz", F.col("cv").alias("hierarchy"), F.round(nontrivial, 6).alias("nontriviality"),
        indexes.class_of(nontrivial, indexes.NONTRIVIAL, "very high").alias("nontrivial_class"), F.round(sci, 5).alias("sci"), indexes.class_of(sci, indexes.SCI, "very high").alias("sci_class"))


def _dft_sql(table: str, window: int) -> str:
    """CTEs of ``welch`` with half overlap by the definition of the transform: zb (seq_id, bin, freq, windows, power)."""
    return f"""zr AS (SELECT seq_id, w, pos - w * {window // 2} AS i, bit FROM (SELECT seq_id, pos, bit, unnest([pos // {window // 2} - 1, pos // {window // 2}]) AS w FROM {table}) WHERE w >= 0),
zw AS (SELECT *, bit - avg(bit) OVER (PARTITION BY seq_id, w) AS x, count(*) OVER (PARTITION BY seq_id, w) AS n FROM zr),
zk AS (SELECT seq_id, w, bin, sum(x * cos(2 * pi() * ((bin * i) % {window}) / {window}.0::DOUBLE)) AS re, sum(x * sin(2 * pi() * ((bin * i) % {window}) / {window}.0::DOUBLE)) AS im FROM zw, range(1, {window // 2 + 1}) r(bin) WHERE n = {window} GROUP BY ALL),
zb AS MATERIALIZED (SELECT seq_id, bin, CAST(bin AS DOUBLE) / {window} AS freq, count(*) AS windows, avg(re * re + im * im) AS power FROM zk GROUP BY seq_id, bin)"""


@query(_dft_sql("ev", 256) + " SELECT bin, freq, windows, round(power, 5) AS power FROM zb")
def overlapping_spectrum(spark, d):
    """Mean power of half-overlapping windows of 256 bits of the whole sequence."""
    return spectra.welch(event_bits(spark, d), 256).drop("seq_id").withColumn("power", F.round("power", 5))


@query(_dft_sql("ev", 256) + " SELECT count(*) AS points, round(-regr_slope(log10(power), log10(freq)), 5) AS beta, round(regr_r2(log10(power), log10(freq)), 5) AS r2, coalesce(count(*) >= 50 AND -regr_slope(log10(power), log10(freq)) BETWEEN 0.2 AND 2.5 AND regr_r2(log10(power), log10(freq)) >= 0.95, false) AS accepted FROM zb WHERE freq > 0.01 AND freq < 0.4")
def spectral_beta(spark, d):
    """How steeply power falls with frequency, and whether the fit is accepted."""
    return spectra.slope(spectra.welch(event_bits(spark, d), 256), 0.01, 0.4).drop("seq_id")


@query(_dft_sql("ev", 1024) + """, lg AS (SELECT log10(freq) AS x, log10(power) AS y FROM zb WHERE power > 0), le AS (SELECT min(x) AS a, max(x) AS b FROM lg),
lb AS (SELECT floor((x - a) / (b - a) * 80) AS bin, avg(x) AS x, avg(y) AS y FROM lg, le WHERE x < b GROUP BY 1 HAVING count(*) >= 3),
lp AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x) - 1 AS i, x, y FROM lb), nn AS (SELECT count(*) AS n FROM lp),
lm AS (SELECT [0, n] AS cuts FROM nn UNION ALL SELECT [0, s, n] FROM nn, range(10, greatest(10, n - 10)) r(s) UNION ALL SELECT [0, s, t, n] FROM nn, range(10, greatest(10, n - 20), 5) r(s), range(s + 10, greatest(s + 10, n - 10), 5) q(t)),
lf AS (SELECT cuts, k, cuts[k] AS from_, cuts[k + 1] AS to_, count(*) AS points, regr_slope(y, x) AS b, regr_r2(y, x) AS r2 FROM (SELECT cuts, unnest(range(1, len(cuts))) AS k FROM lm), lp WHERE i >= cuts[k] AND i < cuts[k + 1] GROUP BY ALL),
ls AS (SELECT cuts, round(sum(r2 * points) / sum(points) - 0.02::DOUBLE * (len(cuts) - 2), 9) AS score FROM lf GROUP BY 1 HAVING min(points) FILTER (k = 1) >= 5 ORDER BY score DESC, len(cuts), cuts LIMIT 1)
SELECT CAST(len(cuts) - 1 AS INTEGER) AS model, round(score, 5) AS score, CAST(k AS INTEGER) AS segment, CAST(from_ AS INTEGER) AS first, CAST(to_ - 1 AS INTEGER) AS last, points, round(-b, 4) AS beta, round(r2, 5) AS r2 FROM lf JOIN ls USING (cuts)""")
def spectral_segments(spark, d):
    """One, two or three straight lines through the logarithmic bins of the spectrum."""
    return spectra.segmented(spectra.log_bins(spectra.welch(event_bits(spark, d), 1024))).drop("seq_id")


PEAKS = _dft_sql("us", 16) + """, zo AS (SELECT *, first_value(bin) OVER (PARTITION BY seq_id, c ORDER BY power DESC, bin) AS top FROM (SELECT *, unnest(range(bin - 4, bin + 5)) AS c FROM zb)),
zh AS (SELECT z.seq_id, z.bin, z.freq, z.power FROM zb z JOIN (SELECT DISTINCT seq_id, c AS bin, top FROM zo) t USING (seq_id, bin) JOIN (SELECT seq_id, 2 * avg(power) AS most FROM zb GROUP BY 1) m USING (seq_id) WHERE top = z.bin AND power > most AND freq < 0.5)"""


@query(PEAKS + " SELECT seq_id, bin, freq, round(power, 4) AS power, CAST(floor(1 / freq) AS INTEGER) AS period FROM zh")
def user_peaks(spark, d):
    """Frequencies that stand out of the spectrum of windows of 16 bits of each user's sequence."""
    return spectra.peaks(spectra.welch(user_bits(spark, d), 16)).withColumn("power", F.round("power", 4))


@query(PEAKS + """, zq AS (SELECT DISTINCT seq_id, CAST(floor(1 / freq) AS BIGINT) AS period FROM zh),
zt AS (SELECT seq_id, period, substr(s, i + 1, period) AS tile FROM (SELECT q.seq_id, period, s, unnest(range(0, length(s) - period + 1, period)) AS i FROM zq q JOIN uss USING (seq_id)))
SELECT seq_id, CAST(period AS INTEGER) AS period, tile, count(*) AS n FROM zt GROUP BY ALL HAVING count(*) >= 2""")
def spectral_tiles(spark, d):
    """Tiles of each user's sequence that recur at the periods found in its own spectrum."""
    bits = user_bits(spark, d)
    found = spectra.peaks(spectra.welch(bits, 16)).select("seq_id", "period")
    return spectra.periodic_tiles(bits, found)


#: What the indexes are made of, each by its own definition: exponent, slope, LZ of chunks of 1,024 bits, distant information, block entropies.
PARTS_OF_EMERGENCE = (
    dfa_sql(2.0).strip().replace("y AS (SELECT pos", "fy AS (SELECT pos", 1).replace("FROM y,", "FROM fy,").replace("b AS (SELECT size, pos", "fb AS (SELECT size, pos", 1).replace("AS f FROM b WHERE", "AS f FROM fb WHERE").replace("f AS (SELECT CAST(size", "ff AS (SELECT CAST(size", 1)
    + ", fh AS (SELECT round(regr_slope(ln(f), ln(size)), 5) AS h FROM ff WHERE f > 0), "
    + _dft_sql("ev", 256)
    + ", fs AS (SELECT -round(-regr_slope(log10(power), log10(freq)), 5) AS slope FROM zb WHERE freq > 0 AND freq < 0.5 AND power > 0), "
    + DISTANT
    + ", fm AS (SELECT round(coalesce(avg(mi), 0), 6) AS mi FROM zi), "
    + ENT.strip()
    + """, fe AS (SELECT round(stddev_pop(y) / avg(y), 6) AS cv, round(avg(y), 6) AS mean_entropy FROM (SELECT round(h, 6) / log2(least(pow(2.0::DOUBLE, size), blocks)) AS y FROM e WHERE blocks > 1)),
ck AS (SELECT part, substr(s, part * 1024 + 1, 1024) AS s FROM (SELECT s, unnest(range((length(s) + 1023) // 1024)) AS part FROM evs)),
lz AS (SELECT part, s, 0 AS i, 0 AS c FROM ck UNION ALL
  SELECT part, s, i + 1 + coalesce(list_max(list_filter(range(1, least(length(s) - i, i, 200) + 1), lambda l: contains(substr(s, 1, i), substr(s, i + 1, l)))), 0), c + 1 FROM lz WHERE i < length(s)),
fl AS (SELECT round(avg(CASE WHEN n > 1 THEN least(1, c * log2(n) / n) ELSE 0 END), 6) AS lz FROM (SELECT part, length(s) AS n, max(c) AS c FROM lz GROUP BY ALL)),
fp AS (SELECT *, 1 - lz AS s_order, CASE WHEN lz <= 0.3 THEN 0.7 + lz / 0.3::DOUBLE * 0.3::DOUBLE WHEN lz <= 0.7 THEN 1 ELSE greatest(0, 1 - (lz - 0.7::DOUBLE) / 0.3::DOUBLE) END AS s_complexity,
  greatest(0, 1 - abs(slope + 1) / 2) AS s_criticality, least(1, mi * 10) AS s_coherence,
  least(1, cv * 2) * CASE WHEN mean_entropy < 0.3 THEN mean_entropy / 0.3::DOUBLE WHEN mean_entropy > 0.9 THEN (1 - mean_entropy) / 0.1::DOUBLE ELSE 1 END AS s_hierarchy,
  CASE WHEN h IS NULL THEN 0 WHEN h > 1.1 THEN greatest(0, 1 - (h - 1.1::DOUBLE) / 0.4::DOUBLE) WHEN h >= 0.85 THEN 1 WHEN h >= 0.6 THEN 0.6::DOUBLE + (h - 0.6::DOUBLE) / 0.25::DOUBLE * 0.4::DOUBLE ELSE greatest(0, h) END AS s_fluctuation,
  (coalesce(greatest(0, (h - 0.5::DOUBLE) * 2), 0) + CASE WHEN slope < 0 THEN greatest(0, least(1, -slope)) ELSE 0 END) / 2 AS s_non FROM fh, fs, fm, fe, fl),
fi AS (SELECT *, 0.3::DOUBLE * s_order + 0.3::DOUBLE * s_hierarchy + 0.2::DOUBLE * s_coherence + 0.2::DOUBLE * s_non AS sei,
  0.25::DOUBLE * s_criticality + 0.25::DOUBLE * s_complexity + 0.2::DOUBLE * s_coherence + 0.15::DOUBLE * s_hierarchy + 0.15::DOUBLE * s_fluctuation AS eci FROM fp)"""
)


@query("RECURSIVE " + PARTS_OF_EMERGENCE + """ SELECT h AS hurst, slope, lz, mi, cv AS hierarchy, mean_entropy, CASE WHEN lz < 0.1 THEN 'very low' WHEN lz < 0.3 THEN 'low' WHEN lz <= 0.7 THEN 'structured' ELSE 'high' END AS lz_class,
  CASE WHEN slope BETWEEN -1.2 AND -0.8 THEN '1/f' WHEN slope > -0.3 THEN 'white' WHEN slope < -1.5 THEN 'brownian' ELSE 'intermediate' END AS slope_class, CASE WHEN mi < 0.01 THEN 'none' WHEN mi < 0.05 THEN 'weak' WHEN mi < 0.1 THEN 'moderate' ELSE 'strong' END AS mi_class,
  round(sei, 5) AS sei, CASE WHEN sei < 0.3 THEN 'low' WHEN sei < 0.5 THEN 'moderate' WHEN sei < 0.7 THEN 'high' ELSE 'very high' END AS sei_class, round(eci, 5) AS eci, CASE WHEN eci < 0.3 THEN 'far' WHEN eci < 0.5 THEN 'approaching' WHEN eci < 0.7 THEN 'near' ELSE 'at the edge' END AS eci_class,
  round(least(1, sqrt((1 - lz) * least(1, mi * 5)) * least(1, cv * 2) * (CASE WHEN h <= 1.1 THEN 1 - abs(h - 0.85::DOUBLE) / 0.85::DOUBLE ELSE 0.5 END + (1 - abs(slope + 1) / 2)) / 2), 5) AS icc FROM fi""")
def emergence_index(spark, d):
    """The structural emergence index, the edge index and the coherence index of all events' bits, with what they are made of."""
    bits = event_bits(spark, d)
    hurst = scaling.exponent(scaling.fluctuations(bits, DFA_SIZES)).select("seq_id", F.col("h").alias("hurst"))
    slope = spectra.slope(spectra.welch(bits, 256), 0.0, 0.5).select("seq_id", (-F.col("beta")).alias("slope"))
    n = F.log2(F.least(F.pow(F.lit(2.0), F.col("size").cast("double")), F.col("blocks").cast("double")))
    blocks = entropy.block_entropy(bits, [1, 2, 4, 8])
    mean = blocks.where("blocks > 1").groupBy("seq_id").agg(F.round(F.avg(F.col("entropy") / n), 6).alias("mean_entropy"))
    hierarchy = entropy.hierarchy(blocks).select("seq_id", F.col("cv").alias("hierarchy"))
    phrases = kernels.per_chunk(chunks(bits, halo=0), kernels.phrases, "phrases long")
    lz = phrases.groupBy("seq_id").agg(F.round(F.avg(indexes.normalised_lz(F.col("phrases"), F.col("n"))), 6).alias("lz"))
    mi = clusters.mean_and_error(clusters.distant_information(bits), "mi").select(F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mi"))
    out = hurst.join(slope, "seq_id").join(mean, "seq_id").join(hierarchy, "seq_id").join(lz, "seq_id").crossJoin(F.broadcast(mi))  # one row each
    of = indexes.scores(*[F.col(c) for c in ("lz", "hierarchy", "mean_entropy", "mi", "hurst", "slope")])
    sei, eci = indexes.weighted(of, indexes.SEI_WEIGHTS), indexes.weighted(of, indexes.ECI_WEIGHTS)
    icc = indexes.icc(1 - F.col("lz"), F.least(F.lit(1.0), F.col("mi") * 5), F.least(F.lit(1.0), F.col("hierarchy") * 2), indexes.criticality(F.col("hurst"), F.col("slope")))
    return out.select(
        "hurst", "slope", "lz", "mi", "hierarchy", "mean_entropy", indexes.lz_class(F.col("lz")).alias("lz_class"), indexes.slope_class(F.col("slope")).alias("slope_class"), indexes.class_of(F.col("mi"), indexes.INFORMATION, "strong").alias("mi_class"),
        F.round(sei, 5).alias("sei"), indexes.class_of(sei, indexes.EMERGENCE, "very high").alias("sei_class"), F.round(eci, 5).alias("eci"), indexes.class_of(eci, indexes.EDGE, "at the edge").alias("eci_class"), F.round(icc, 5).alias("icc"))
