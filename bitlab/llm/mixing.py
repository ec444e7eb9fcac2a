"""Mixing sources to target weights by Pfair scheduling, as DataFrame expressions only.

Every source's records are cut into blocks. Of a source with share w of all weights, block i (from 0)
is released at slot floor(i / w) and due at slot ceil((i + 1) / w). Of the released blocks the one with
the earliest deadline takes the next slot. As shares add up to one, every deadline is met and each
source is always less than one block away from its target. When a source has no blocks left,
shares are taken anew among the others, from that slot on. Blocks stay as large as they are, however many there are: the
schedule is cut into pieces, and the state at the beginning of a piece follows from the windows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlab.llm.common import one_per_row, spare_prefix, stage

#: Weights are taken as whole parts, the largest as so many; an exact share is a fraction of the parts.
PARTS = 1 << 24
#: Slots that a row folds, or as many as four of the longest windows; a quarter of it without an end of a source is not folded one after another.
MAX_SLOTS = 1 << 12
#: Hex digits of the record's hash that name a chunk; records are ranked within chunks.
CHUNK_DIGITS = 3

#: Slots folded before their blocks are put aside, so that short arrays grow.
FRAME = 256


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _next(n: str, i: str, t0: str, total: str, had: str) -> str:
    """Block ``n`` of source ``i``: its release, its key (deadline, then source) and number; without the first two if there is none.

    Columns: ps and bs, all sources' parts and blocks. An epoch, from one end of a source to the next, has its first slot (t0),
    the parts of its sources (total) and the blocks that each had before (had).
    """
    return f"""if({n} < bs[{i}], named_struct(
        'r', {t0} + ({n} - {had}) * {total} div ps[{i}], 'k', ({t0} + (({n} - {had} + 1) * {total} + ps[{i}] - 1) div ps[{i}]) * size(ps) + {i}, 'n', {n}),
        named_struct('r', cast(NULL AS bigint), 'k', cast(NULL AS bigint), 'n', {n}))"""


def _state(t: str, e: str) -> str:
    """The blocks that come next at slot ``t`` of the epoch ``e``, while none of its sources has ended: no slots are folded.

    By then a source has all blocks that are due, and the one whose window holds ``t`` may have had its slot too. Earliest
    deadlines go first, so these blocks are taken by (deadline, source) as long as, for every s, the
    blocks released from s on have room in the slots from s to ``t`` (``caps``, less the blocks that are due).
    """
    low = "zip_with(ps, zip_with(e.had, bs, (h, b) -> h < b), (p, alive) -> if(alive, u * p div e.total, cast(0 AS bigint)))"
    open_ = """array_sort(filter(transform(ps, (p, i) -> if(e.had[i] < bs[i] AND u * p % e.total <> 0,
        named_struct('d', ((low[i] + 1) * e.total + p - 1) div p, 'i', i, 'r', low[i] * e.total div p), NULL)), x -> x IS NOT NULL))"""
    caps = """if(first + 1 < u, transform(sequence(first + 1, u - 1), s -> u - s - aggregate(zip_with(ps, low, (p, n) -> greatest(n - (s * p + e.total - 1) div e.total, 0L)), 0L, (x, y) -> x + y)),
        cast(array() AS array<bigint>))"""
    took = """aggregate(open, named_struct('left', u - aggregate(low, 0L, (x, y) -> x + y), 'caps', caps, 'got', cast(array() AS array<int>)),
        (g, x) -> if(g.left > 0 AND coalesce(array_min(slice(g.caps, 1, cast(x.r - first AS int))) > 0, true),
           named_struct('left', g.left - 1, 'caps', transform(g.caps, (c, q) -> if(q < x.r - first, c - 1, c)), 'got', concat(g.got, array(x.i))), g)).got"""
    n = "e.had[i] + l + if(array_contains(got, i), 1L, 0L)"
    nx = f"transform(low, (l, i) -> {_let('n', n, _next('n', 'i', 'e.t0', 'e.total', 'e.had[i]'))})"
    first = "coalesce(array_min(transform(open, x -> x.r)), u)"
    body = _let("low", low, _let("open", open_, _let("first", first, _let("caps", caps, _let("got", took, nx)))))
    return _let("e", e, _let("u", f"{t} - e.t0", f"named_struct('t0', e.t0, 'total', e.total, 'had', e.had, 'nx', {body})"))


def _resumed(e: str) -> str:
    """The state of which ``e`` has the epoch and the blocks that each source has had (done)."""
    return f"named_struct('t0', {e}.t0, 'total', {e}.total, 'had', {e}.had, 'nx', transform({e}.done, (n, i) -> {_next('n', 'i', f'{e}.t0', f'{e}.total', f'{e}.had[i]')}))"


def _slot(planned: bool) -> str:
    """One step of a fold: state ``a`` after slot ``t``, which the released block with the smallest key takes."""
    plan = ", 'plan', concat(a.plan, array(named_struct('slot', t, 'j', j, 'nth', n - 1, 'release', a.nx[j].r, 'deadline', m div size(ps))))" if planned else ""
    same = f"""named_struct('t0', a.t0, 'total', a.total, 'had', a.had,
        'nx', transform(a.nx, (x, i) -> if(i = j, {_next("n", "j", "a.t0", "a.total", "a.had[j]")}, x)){plan})"""
    ended = f"""named_struct('t0', t + 1, 'total', a.total - ps[j], 'had', had,
        'nx', transform(had, (h, i) -> {_next("h", "i", "(t + 1)", "(a.total - ps[j])", "h")}){plan})"""
    ended = _let("had", "transform(a.nx, (x, i) -> if(i = j, n, x.n))", ended)
    body = _let("j", "cast(m % size(ps) AS int)", _let("n", "a.nx[j].n + 1", f"if(n < bs[j], {same}, {ended})"))
    return _let("m", "array_min(transform(a.nx, x -> if(x.r <= t, x.k, NULL)))", body)


def _schedule(state: str, start: str, end: str) -> str:
    """The blocks of the slots from ``start`` to ``end`` (not empty), folded from ``state``, in frames."""
    made = "slot:bigint,j:int,nth:bigint,release:bigint,deadline:bigint"
    fields = lambda x: f"'t0', {x}.t0, 'total', {x}.total, 'had', {x}.had, 'nx', {x}.nx"
    inner = f"""aggregate(sequence(f, least(f + {FRAME}, {end}) - 1), named_struct({fields("all")}, 'plan', cast(array() AS array<struct<{made}>>)), (a, t) -> {_slot(True)})"""
    zero = _let("z", state, f"named_struct({fields('z')}, 'plan', cast(array() AS array<array<struct<{made}>>>))")
    return f"""aggregate(sequence({start}, {end} - 1, {FRAME}L), {zero},
        (all, f) -> {_let("b", inner, f"named_struct({fields('b')}, 'plan', concat(all.plan, array(b.plan)))")}).plan"""


def _pieces() -> str:
    """The schedule cut into pieces (at, upto, step, t0, total, had, done), for which only slots near the ends of sources are folded.

    No source ends before the first release of a last block, so up to there a long stretch is one piece, cut later on at each ``step``
    slots; its end has a state without a fold. From there slots are folded, a few at a time.
    """
    alive = "filter(transform(ps, (p, i) -> if(c.nx[i].n < bs[i], {}, NULL)), x -> x IS NOT NULL)"
    until = f"array_min({alive.format('c.t0 + (bs[i] - 1 - c.had[i]) * c.total div p')})"
    window = f"c.total div array_min({alive.format('p')}) + 2"
    few = f"greatest({max(1, MAX_SLOTS // 16)}L, size(ps))"
    piece = lambda at, upto, step, x: f"named_struct('at', {at}, 'upto', {upto}, 'step', {step}, 't0', {x}.t0, 'total', {x}.total, 'had', {x}.had, 'done', transform({x}.nx, x -> x.n))"
    state = lambda x: f"named_struct('t0', {x}.t0, 'total', {x}.total, 'had', {x}.had, 'nx', {x}.nx)"
    after = f"aggregate(sequence(at, upto - 1), b, (a, t) -> {_slot(False)})"
    leaps = f"until - c.t > greatest({MAX_SLOTS // 4}L, 2 * window)"
    out = f"concat(c.out, if(at > c.t, array({piece('c.t', 'at', f'greatest({MAX_SLOTS}L, 4 * window)', 'c')}), array()), array({piece('at', 'upto', 'upto - at', 'b')}))"
    turn = _let("d", after, f"named_struct('t', upto, 't0', d.t0, 'total', d.total, 'had', d.had, 'nx', d.nx, 'out', {out})")
    turn = _let("b", f"if(at > c.t, {_state('at', state('c'))}, {state('c')})", _let("upto", f"least(slots, at + {few})", turn))
    turn = _let("until", until, _let("window", window, _let("at", f"if({leaps}, until, c.t)", turn)))
    zero = "named_struct('t0', 0L, 'total', aggregate(ps, 0L, (x, p) -> x + p), 'had', transform(ps, p -> 0L), 'done', transform(ps, p -> 0L))"
    kinds = "at:bigint,upto:bigint,step:bigint,t0:bigint,total:bigint,had:array<bigint>,done:array<bigint>"
    zero = _let("e", zero, _let("z", _resumed("e"), f"named_struct('t', 0L, 't0', z.t0, 'total', z.total, 'had', z.had, 'nx', z.nx, 'out', cast(array() AS array<struct<{kinds}>>))"))
    return f"aggregate(sequence(0L, slots div {few}), {zero}, (c, turn) -> if(c.t < slots, {turn}, c)).out"


def parts(sources: DataFrame) -> DataFrame:
    """(source, n, weight) with p, the weight in whole parts of which the largest has ``PARTS``."""
    most = sources.agg(F.max("weight").alias("most"))
    return sources.crossJoin(F.broadcast(most)).withColumn("p", F.greatest(F.round(F.col("weight") / F.col("most") * PARTS).cast("long"), F.lit(1).cast("long"))).drop("most")


def pfair(sources: DataFrame) -> DataFrame:
    """(source, p, nth, slot, release, deadline) of every block of ``sources`` (source, p, blocks), by earliest deadline first.

    Slots run from 0 without gaps. Equal deadlines go to the smaller name. One row holds all sources and finds the pieces of the
    schedule (see ``_pieces``); the pieces, in tasks of their own, fold over their slots, each of which looks at all sources. Where
    sources end so often that there are no long stretches, the slots are folded twice, once in one row.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = sources.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "p", "blocks"))).alias("s"), F.sum("blocks").alias("slots"))
    one = one.where("slots > 0").select("slots", F.col("s.p").alias("ps"), F.col("s.blocks").alias("bs"))
    cut = one.select("ps", "bs", F.explode(F.expr(_pieces())).alias("e")).select("ps", "bs", "e", F.explode(F.expr("sequence(e.at, e.upto - 1, e.step)")).alias("at"))
    cut = cut.repartitionById(n, F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")).withColumn("upto", F.expr("least(at + e.step, e.upto)"))
    blocks = cut.select(F.explode(F.flatten(F.expr(_schedule(f"if(at = e.at, {_resumed('e')}, {_state('at', 'e')})", "at", "upto")))).alias("x")).select("x.*")
    names = sources.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "p"))).alias("s")).select(F.posexplode("s").alias("j", "o")).select("j", "o.*")
    return blocks.join(F.broadcast(names), "j").select("source", "p", "nth", "slot", "release", "deadline")


def _placed(docs: DataFrame, keep_cols: list[str], id_col: str, source_col: str, weights: DataFrame | None, block: int, prefix: str) -> tuple[DataFrame, int]:
    src = one_per_row(docs, list(dict.fromkeys([*keep_cols, id_col, source_col])))
    names = {c: f"k{i}" for i, c in enumerate(src.columns)}
    src = src.toDF(*names.values()).withColumn("source", F.coalesce(F.col(names[source_col]).cast("string"), F.lit("")))
    src = src.withColumn("hash", F.md5(F.coalesce(F.col(names[id_col]).cast("string"), F.lit("")).cast("binary"))).withColumn("chunk", F.substring("hash", 1, CHUNK_DIGITS))
    chunks = stage(src.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n")), "chunks")
    sources = chunks.groupBy("source").agg(F.sum("n").alias("n"))
    sources = sources.withColumn("weight", F.sqrt("n")) if weights is None else sources.join(weights.select("source", F.col("weight").cast("double").alias("weight")), "source", "left")
    sources = stage(parts(sources), "sources")
    size = sources.agg(F.count(F.lit(1)), F.count(F.when(F.col("weight") > 0, 1))).first()
    if size[0] != size[1]:
        raise ValueError(f"{size[0] - size[1]} sources have no weight above zero")
    schedule = stage(pfair(sources.select("source", "p", F.ceil(F.col("n") / block).cast("long").alias("blocks"))), "schedule")
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # 16^3 rows a source
    held = chunks.select("source", "chunk", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a chunk's blocks in one row: documents, dealt by chunk for their ranks, find theirs without being dealt again
    held = held.select("source", "chunk", "offset", F.explode(F.expr(f"sequence(offset div {block}, (offset + n - 1) div {block})")).alias("block"))
    held = held.join(schedule.withColumnRenamed("nth", "block"), ["source", "block"]).groupBy("source", "chunk")
    held = stage(held.agg(F.first("offset").alias("offset"), F.first("p").alias("p"), F.sort_array(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("places")), "places")
    rank = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("hash", names[id_col])) - 1
    ranked = src.withColumn("rank", rank).join(held.hint("merge"), ["source", "chunk"]).withColumn("rank", F.col("rank") + F.col("offset"))
    out = ranked.withColumn("place", F.get("places", F.expr(f"cast(rank div {block} - offset div {block} AS int)"))).withColumn("in_block", (F.col("rank") % block).cast("long"))
    new = {"share": "p", "block": "place.block", "in_block": "in_block", **{c: f"place.{c}" for c in ("slot", "release", "deadline")}}
    return out.select(*[F.col(names[c]).alias(c) for c in keep_cols], *[F.col(c).alias(prefix + k) for k, c in new.items()]), schedule.count()


def mix(docs: DataFrame, keep_cols: list[str], id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None, block: int = 4, prefix: str = "") -> DataFrame:
    """``keep_cols`` of every row, its source's share (in parts, see ``parts``), block, in_block, slot, release and deadline.

    weights: (source, weight > 0) for every source; by default the square root of its number of rows.
    Within a source, records are ordered by the MD5 of their id and cut into blocks of ``block`` rows, however many there are. Every
    block has a slot of its own, slots have no gaps, and release <= slot < deadline; nothing is dropped or
    repeated. A null source is the source "". A source without a weight is an error. Ties
    (repeated ids) are ranked in any order, once each. An empty table has no rows. ``prefix`` goes before the names of new
    columns, for ``keep_cols`` that clash with them.
    """
    return _placed(docs, keep_cols, id_col, source_col, weights, block, prefix)[0]


def in_order(docs: DataFrame, keep_cols: list[str]) -> DataFrame:
    """``keep_cols``, of any names, of every row in the order of the mixture: partitions are even ranges of slots, sorted within."""
    prefix = spare_prefix(docs, "__mix_")
    placed, slots = _placed(docs, keep_cols, "doc_id", "source", None, 4, prefix)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col(f"{prefix}slot") * n / max(1, slots)).cast("int")
    return placed.repartitionById(n, part).sortWithinPartitions(f"{prefix}slot", f"{prefix}in_block").select(*keep_cols)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' places in a mixture of sources weighted by the square root of their sizes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "source"])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid down in the order of the mixture. Rows and columns stay as they are; see ``mix`` for edges."""
    return in_order(docs, docs.columns)


ORACLE = f"""
WITH RECURSIVE n AS (
  SELECT coalesce(source, '') AS source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY 1),
k AS (
  SELECT source, CAST(ceil(n / 4) AS BIGINT) AS blocks, greatest(CAST(round(weight / (SELECT max(weight) FROM n) * {PARTS}) AS BIGINT), 1) AS p FROM n),
s AS (SELECT list(p ORDER BY source) AS ps, list(blocks ORDER BY source) AS bs, list(source ORDER BY source) AS names, CAST(sum(blocks) AS BIGINT) AS slots, CAST(sum(p) AS BIGINT) AS every FROM k),
fold AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ps, lambda x: CAST(0 AS BIGINT)) AS done, list_transform(ps, lambda x: CAST(0 AS BIGINT)) AS had, CAST(0 AS BIGINT) AS t0, every AS total,
         CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS release, CAST(0 AS BIGINT) AS deadline FROM s
  UNION ALL
  SELECT t + 1, new, CASE WHEN ended THEN new ELSE had END, CASE WHEN ended THEN t + 2 ELSE t0 END, CASE WHEN ended THEN total - part ELSE total END, i, nth, release, deadline FROM (
    SELECT t, had, t0, total, i, list_transform(done, lambda x, q: CASE WHEN q = i THEN x + 1 ELSE x END) AS new, done[i] + 1 = bs[i] AS ended, ps[i] AS part, done[i] AS nth,
           t0 + (done[i] - had[i]) * total // ps[i] AS release, t0 + ((done[i] - had[i] + 1) * total + ps[i] - 1) // ps[i] AS deadline FROM (
      SELECT fold.*, s.*, list_min(list_filter(list_transform(ps, lambda x, q:
        CASE WHEN done[q] < bs[q] AND (done[q] - had[q]) * total // x <= t + 1 - t0 THEN (t0 + ((done[q] - had[q] + 1) * total + x - 1) // x) * 100000 + q END), lambda x: x IS NOT NULL)) % 100000 AS i
      FROM fold, s WHERE t + 1 < slots))),
plan AS (
  SELECT names[j] AS source, ps[j] AS share, nth, t AS slot, release, deadline FROM fold, s WHERE t >= 0),
d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents)
SELECT d.doc_id, d.source, CAST(share AS BIGINT) AS share, rank // 4 AS block, rank % 4 AS in_block, slot, CAST(release AS BIGINT) AS release, CAST(deadline AS BIGINT) AS deadline
FROM d JOIN plan ON d.src = plan.source AND plan.nth = rank // 4
"""
