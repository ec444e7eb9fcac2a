from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitlab.functions import codec, kernels
from bitlab.operators import collapse, grid, patterns, reports, rules, scaling, structure, survival, validation
from bitlab.operators.chunks import bit_ngrams, chunks, ngrams, running_sum
from bitlab.plans import catalog
from bitlab.sources import generators, snapshots
from bitlab.streaming.counts import user_transitions, windowed_ones


def bits_of(spark, **texts):
    return spark.createDataFrame([(k, i, int(c)) for k, t in texts.items() for i, c in enumerate(t)], "seq_id string, pos long, bit int")


def symbols_of(spark, **texts):
    return spark.createDataFrame([(k, i, c) for k, t in texts.items() for i, c in enumerate(t)], "seq_id string, pos long, sym string")


def random_text(n, seed=0):
    return "".join(map(str, np.random.default_rng(seed).integers(0, 2, n)))


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_ngrams_do_not_depend_on_chunks(spark, size):
    text = random_text(300)
    got = ngrams(chunks(bits_of(spark, a=text), size=size, halo=6), [1, 3, 5]).collect()
    assert sorted((r["len"], r["pos"], r["pattern"]) for r in got) == sorted((n, i, text[i : i + n]) for n in (1, 3, 5) for i in range(len(text) - n + 1))


def test_ngrams_longer_than_a_chunk_of_the_last_symbols(spark):
    text = random_text(41, 3)
    got = bit_ngrams(bits_of(spark, a=text), [40]).count()
    assert got == 2


@pytest.mark.parametrize("size", [3, 50])
def test_running_sum(spark, size):
    text = random_text(100, 1)
    got = {r["pos"]: r["s"] for r in running_sum(bits_of(spark, a=text), F.col("bit"), "s", size).collect()}
    assert [got[i] for i in range(100)] == np.cumsum([int(c) for c in text]).tolist()


#: input: one pass, full collapse
COLLAPSE = {
    "(01)": ("0", "0"), "(10)": ("0", "0"), "(11)": ("1", "1"), "(00)": ("0", "0"), "((01))": ("(0)", "0"), "((01)1)": ("(01)", "0"), "(0(10))": ("(00)", "0"), "((01)(10))": ("(00)", "0"),
    "(01)(10)(11)": ("001", "001"), "((01)1)0((10)0)1": ("(01)0(00)1", "0001"), "(((01)1)0)": ("((01)0)", "0"), "((((01)0)1)0)": ("(((00)1)0)", "0"), "0(01)1(10)0": ("00100", "00100"), "1((01)(10))0": ("1(00)0", "100"),
}


def test_collapse(spark):
    df = spark.createDataFrame([(k,) for k in COLLAPSE], "s string").select("s", collapse.collapse_local(F.col("s")).alias("one"), collapse.collapse_full(F.col("s"), 4).alias("full"))
    assert {r["s"]: (r["one"], r["full"]) for r in df.collect()} == COLLAPSE


def test_collapse_phases_and_frames(spark):
    r = spark.range(1).select(collapse.collapse_e(F.lit("0110")).alias("e"), collapse.collapse_frames(F.lit("01(11)0(01)1")).alias("n"), collapse.simplify(F.lit("")).alias("x")).first()
    assert (r["e"], r["x"]) == ("0", "0")
    assert r["n"] == "010(01)1"  # the last group has its 1 behind it, which only counts from the other side


def test_collapse_then_the_whole_with_its_parentheses(spark):
    # the base rule runs over what a pass has left, parentheses and all
    df = spark.createDataFrame([("((01)1)0((10)0)1",), ("(1)(11)1",), ("",), ("1101",), ("111",)], "s string")
    one, first, s = collapse.collapse_local(F.col("s")), collapse.collapse_first(F.col("s")), F.col("s")
    got = {r[0]: r[1:] for r in df.select("s", collapse.then_whole(one), collapse.then_whole(first), collapse.collapse_frames(s), collapse.collapse_frames(s, True)).collect()}
    assert got["((01)1)0((10)0)1"] == ("(0)0(0)1", "(0)0((0)0)1", "((01)1)0((10)0)1", "(0)0((10)0)1")
    assert got["(1)(11)1"] == ("1", "1(1)1", "(1)(1)1", "(1)1")
    assert got[""][:2] == ("0", "0") and got["1101"][0] == "0" and got["111"][0] == "1"


@pytest.mark.parametrize("size", [5, 13, 10_000])
def test_safe_cuts_collapse_like_the_whole(spark, size):
    text = "((01)1)0((10)0)1" * 30
    deep = structure.depths(symbols_of(spark, a=text))
    parts = collapse.safe_cuts(deep, size).withColumn("c", collapse.collapse_full(F.col("text"), 2)).orderBy("start").collect()
    whole = spark.range(1).select(collapse.collapse_full(F.lit(text), 2).alias("c")).first()["c"]
    assert "".join(r["c"] for r in parts) == whole == "0001" * 30
    assert all(r["text"].count("(") == r["text"].count(")") for r in parts)


def test_codec_round_trip(spark):
    df = spark.createDataFrame([("(01)1",), ("",), ("0",), ("((01)1)",)], "s string").withColumn("p", codec.encode(F.col("s")))
    got = df.select("s", "p", codec.decode(F.col("p"), F.length("s")).alias("back")).collect()
    assert all(r["s"] == r["back"] for r in got)
    assert next(r["p"] for r in got if r["s"] == "(01)1") == "8740"  # 10 00 01 11 | 01 and padding


def test_structure_against_a_stack(spark):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("01()"), 400, p=[0.3, 0.3, 0.22, 0.18]))
    stack, want = [], set()
    for i, c in enumerate(text):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            o = stack.pop()
            inner = text[o + 1 : i]
            want.add((o, i, inner.count("1"), inner.count("0"), stack[-1] if stack else None))
    got = structure.nodes(structure.depths(symbols_of(spark, a=text))).collect()
    assert {(r["open_pos"], r["close_pos"], r["n_ones"], r["n_zeros"]) for r in got} == {w[:4] for w in want}
    assert all(r["parent_pos"] == p for r in got for o, *_, p in want if o == r["open_pos"])  # also where the parent never closes


def test_generators(spark):
    pos = spark.range(9).select(F.col("id").alias("pos"))
    assert "".join(str(r["bit"]) for r in generators.fibonacci_word(pos).orderBy("pos").collect()) == "101101011"
    assert "".join(str(r["bit"]) for r in generators.rule30_bits(spark, 16).orderBy("pos").collect()) == "1101110011000101"
    assert "".join(str(r["bit"]) for r in generators.pi_bits(spark, 5).orderBy("pos").collect()) == "00010100000101011001"
    x, want = 0.5123, ""
    for _ in range(50):
        x = 3.99 * x * (1 - x)
        want += str(int(x >= 0.5))
    assert "".join(str(r["bit"]) for r in generators.logistic_bits(spark, 50).orderBy("pos").collect()) == want
    ones = generators.random_bits(spark, 20_000).agg(F.avg("bit")).first()[0]
    assert abs(ones - 0.5) < 0.02
    b = bits_of(spark, a=random_text(200))
    s = generators.shuffled(b)
    assert s.agg(F.sum("bit"), F.count_distinct("pos"), F.max("pos")).first()[:] == (b.agg(F.sum("bit")).first()[0], 200, 199)


def test_snapshots(spark, tmp_path):
    rows = [("B", i, p, c) for i, t in ((1, "0(0)101"), (2, "01")) for p, c in enumerate(t)] + [("E", 1, 0, "1")]
    df = spark.createDataFrame(rows, "variant string, iteration int, pos long, sym string")
    snapshots.save(df, str(tmp_path / "s"))
    back = snapshots.load(spark, str(tmp_path / "s"), "B", 1, 1, limit=5, clean=True)
    assert "".join(r["sym"] for r in back.orderBy("pos").collect()) == "001"
    cat = snapshots.catalog(snapshots.load(spark, str(tmp_path / "s")))
    assert {(r["variant"], r["iteration"]) for r in snapshots.latest(cat).collect()} == {("B", 2), ("E", 1)}
    assert [r["iteration"] for r in snapshots.common_iterations(cat, ["B", "E"]).collect()] == [1]
    assert snapshots.retained(cat, 1).count() == 2


def brute_lz(s):
    i = n = 0
    while i < len(s):
        k = 0
        while i + k < len(s) and s[i : i + k + 1] in s[:i]:
            k += 1
        i, n = i + k + 1, n + 1
    return n


def test_kernels():
    for seed in range(5):
        t = random_text(200, seed)
        assert kernels.lz76(t) == brute_lz(t)
    assert kernels.lz76("0" * 16) == brute_lz("0" * 16)
    bits = np.array([0, 1] * 50, np.uint8)
    assert kernels.autocorrelation(bits.astype(float), 4)[2] > 0.9
    assert kernels.sample_entropy(bits) < 0.05
    assert kernels.persistence_h0(np.array([[0.0], [1.0], [3.0]])).tolist() == [1.0, 2.0]
    f = np.abs(np.fft.rfft(np.sin(np.arange(256) * 2 * np.pi * 16 / 256))) ** 2
    assert kernels.peaks(f).tolist() == [16]
    rate, det = kernels.recurrence_rates(np.array([0] * 10, np.uint8))
    assert det > 0.9 and rate > 0.8


def test_hilbert_is_a_path(spark):
    got = spark.range(256).select(grid.hilbert(F.col("id"), 4).alias("h"), "id").orderBy("id").select("h.x", "h.y").collect()
    assert len(set(got)) == 256 and all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in pairwise(got))


@pytest.mark.parametrize(("n", "cell"), [(10, 1), (16, 1), (17, 1), (1000, 1), (1000, 4)])
def test_grid_has_every_position(spark, n, cell):
    got = grid.grid(bits_of(spark, a=random_text(n, 3)), 2, cell).agg(F.sum("total"), F.sum("ones"), F.max("x"), F.max("y")).first()
    assert got[0] == n and got[1] == random_text(n, 3).count("1") and got[2] < 4 and got[3] < 4


def test_recurrence_reads_whole_chunks():
    text = random_text(2000, 3) + "1" * 48
    got = kernels.complexity(text)
    assert (got["rate"], got["determinism"]) == kernels.recurrence_rates(np.array([int(c) for c in text], np.uint8))


def test_complexity_by_user_names_its_chunks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "user_bits", lambda spark, d: bits_of(spark, a=random_text(2500, 4), b=random_text(30, 5)))
    got = catalog.QUERIES["complexity_by_user"](spark, "").collect()
    assert sorted((r["seq_id"], r["chunk"], r["n"]) for r in got) == [("a", 0, 1024), ("a", 1, 1024), ("a", 2, 452), ("b", 0, 30)]


def test_grid_neighbours_wrap(spark):
    cells = spark.createDataFrame([(x, y, (x * 7 + y * 3) % 5, 5) for x in range(4) for y in range(4)], "x long, y long, ones long, total long")
    got = {(r["dx"], r["dy"]): r["r"] for r in grid.neighbour_correlation(cells, 2).collect()}
    d = np.array([[(x * 7 + y * 3) % 5 / 5 for y in range(4)] for x in range(4)])
    assert got[1, 0] == pytest.approx(np.corrcoef(d.ravel(), np.roll(d, 1, 0).ravel())[0, 1], abs=1e-5)
    assert grid.local_mean(cells, 2, 1).where("x = 1 AND y = 1").first()["mean"] == pytest.approx(d[0:3, 0:3].mean(), abs=1e-5)


def test_runs_of_several_sequences(spark):
    got = scaling.runs(bits_of(spark, a="0011101", b="1")).collect()
    assert sorted((r["seq_id"], r["start"], r["bit"], r["len"]) for r in got) == [("a", 0, 0, 2), ("a", 2, 1, 3), ("a", 5, 0, 1), ("a", 6, 1, 1), ("b", 0, 1, 1)]


def test_fluctuations_against_numpy(spark):
    text = random_text(300, 9)
    y = np.cumsum([int(c) for c in text] - np.mean([int(c) for c in text]))
    for r in scaling.fluctuations(bits_of(spark, a=text), [10, 25]).collect():
        rest = []
        for k in range(len(y) // r["size"]):
            seg, x = y[k * r["size"] : (k + 1) * r["size"]], np.arange(r["size"])
            rest.append(np.mean((seg - np.polyval(np.polyfit(x, seg, 1), x)) ** 2))
        assert r["f"] == pytest.approx(np.sqrt(np.mean(rest)), abs=1e-5)


def test_empty_tables(spark):
    b = bits_of(spark, a="01").where("false")
    assert rules.transitions(b, [2]).count() == patterns.pattern_counts(b, range(2, 4)).count() == scaling.runs(b).count() == 0
    assert survival.first_divergence(b, b, ["seq_id"]).count() == 0


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = user_transitions(stream).writeStream.format("memory").queryName("moves").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["seq_id"], r["ctx"], r["nxt"]): r["n"] for r in spark.sql("SELECT seq_id, ctx, nxt, sum(n) AS n FROM moves GROUP BY 1, 2, 3").collect()}
    from bitlab.sources.tables import user_bits

    want = {(r["seq_id"], r["ctx"], r["nxt"]): r["support"] for r in rules.transitions(user_bits(spark, "/root/testdata/sf0.001"), [2]).collect()}
    assert got == want
    q = windowed_ones(stream).writeStream.format("memory").queryName("ones").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM ones").first()[0] == events.count()


@pytest.mark.parametrize(("size", "order"), [(64, 2), (7, 3), (1024, 1)])
def test_streams_in_any_order(spark, tmp_path, size, order):
    """Micro-batches of bits in random order, some of them twice, give the transitions of the batch query."""
    from bitlab.streaming.counts import position_transitions

    texts = {"a": random_text(300, 1), "b": random_text(65, 2), "c": "0"}
    df = bits_of(spark, **texts)
    rng, parts = np.random.default_rng(size), df.collect()
    order_of = rng.permutation(len(parts))
    for i, at in enumerate(np.array_split(order_of, 5)):
        again = rng.choice(order_of, 10)
        spark.createDataFrame([parts[k] for k in (*at, *again)], df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = position_transitions(stream, order, size).writeStream.format("memory").queryName(f"any{size}").outputMode("append").start()
    q.processAllAvailable()
    assert len(q.recentProgress) >= 5
    q.stop()
    got = {(r["seq_id"], r["ctx"], r["nxt"]): r["n"] for r in spark.sql(f"SELECT seq_id, ctx, nxt, sum(n) AS n FROM any{size} GROUP BY 1, 2, 3").collect()}
    assert got == {(r["seq_id"], r["ctx"], r["nxt"]): r["support"] for r in rules.transitions(df, [order]).collect()}


def test_recurrence(spark):
    from bitlab.operators.collapse import accumulate

    got = spark.range(1).select(accumulate(1).alias("a"), accumulate(2).alias("b")).first()
    assert got["a"] == "0(0)101"
    assert got["b"] == "0(0)1010" + "(0(0)1010)1" + "(001010)1" + "01"


def test_packed_files(spark, tmp_path):
    from bitlab.sources import packed

    assert packed.pack("(01)1").hex() == "8740" and packed.unpack(packed.pack("(01)1")) == "(01)1000"
    texts = [("phi_iter1", "(01)1"), ("phi_iter2", "".join(np.random.default_rng(1).choice(list("01()"), 1001)))]
    packed.write_packed(texts, str(tmp_path))
    got = packed.read_packed(spark, str(tmp_path)).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]), "").alias("s")).collect()
    assert sorted(r["s"] for r in got) == sorted(t for _, t in texts)
    assert packed.read_packed(spark, str(tmp_path), limit=3, clean=True).where(F.col("path").contains("iter1")).count() == 2


def test_pattern_documents(spark, tmp_path):
    from bitlab.sources import packed

    (tmp_path / "r.json").write_text('{"patterns": {"observable": [{"pattern_data": "01", "recurrence": 3}], "structural": []}, "x": 1}')
    assert [tuple(r) for r in packed.read_patterns(spark, str(tmp_path / "r.json")).collect()] == [("01", 3)]
    packed.write_results(packed.read_patterns(spark, str(tmp_path / "r.json")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stratified(spark):
    got = snapshots.stratified(bits_of(spark, a=random_text(1000)), 500, 30).groupBy("segment").agg(F.min("pos").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 10 and all(r["n"] == 30 and r["segment"] * 100 <= r["a"] <= r["segment"] * 100 + 70 for r in got)


def symbols_of(spark, **texts):
    return spark.createDataFrame([(k, i, c) for k, t in texts.items() for i, c in enumerate(t)], "seq_id string, pos long, sym string")


def test_contents_are_told_apart_by_order(spark):
    deep = structure.depths(symbols_of(spark, a="(01)(10)(01)((01)1)", b="(011)()(10)"))
    groups = structure.nodes(deep)
    got = structure.contents(deep, groups).select("seq_id", "open_pos", "h1", "h2").collect()
    content = {("a", 0): "01", ("a", 4): "10", ("a", 8): "01", ("a", 12): "011", ("a", 13): "01", ("b", 0): "011", ("b", 5): "", ("b", 7): "10"}
    by = {}
    for r in got:
        by.setdefault(content[r["seq_id"], r["open_pos"]], set()).add((r["h1"], r["h2"]))
    assert len(got) == len(content) and all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)
    assert structure.containment_summary(deep, groups).first()["distinct_contents"] == 4


def test_order_index_by_hand(spark):
    """((01)1)(1): depths 1, 2, 1; strata 1: bits 1, 1 and 2: 0, 1; lengths 3, 2, 1; balanced."""
    s = symbols_of(spark, a="((01)1)(1)")
    deep = structure.depths(s)
    got = structure.order_index(structure.order_parts(s, deep, structure.nodes(deep))).first()
    entropy = -(2 / 3 * np.log2(2 / 3) + 1 / 3 * np.log2(1 / 3))
    want = (1 - entropy / np.log2(2), 1 / (1 + 1), 1 / (1 + np.var([3, 2, 1])), 1.0)
    assert tuple(got)[:4] == pytest.approx(want, abs=1e-6)
    assert got["index"] == pytest.approx(0.3 * want[0] + 0.3 * want[1] + 0.2 * want[2] + 0.2 * want[3], abs=1e-6)
    open_ = symbols_of(spark, a="((01)1)(1)(")
    deep = structure.depths(open_)
    assert structure.order_parts(open_, deep, structure.nodes(deep)).first()["balance"] == 0


def test_first_collapse(spark):
    from bitlab.operators import collapse

    cases = {"(01)(10)(11)": "0(10)(11)", "((01)1)": "(01)", "(11)(0)": "1(0)", "0(1(11)0)": "0(110)", "0110": "0110", "()(01)": "()0", "((0)(11))": "(0(11))"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["x"] for r in df.select("s", collapse.collapse_first(F.col("s")).alias("x")).collect()}
    import re

    want = {k: re.sub(r"\([01]+\)", lambda m: "1" if set(m[0].strip("()")) == {"1"} else "0", k, count=1) for k in cases}
    assert got == want == cases


def test_threshold_tells_survivors(spark):
    rows = [(0, "a", 250), (0, "b", 7), (0, "c", 300), (0, "d", 9), (0, "e", 240), (1, "a", 5), (1, "c", 5), (1, "e", 5)]
    got = survival.best_threshold(spark.createDataFrame(rows, "iteration int, pattern string, n long")).first()
    assert (got["threshold"], got["accuracy"], got["lost_below"], got["survived_above"]) == (240, 100.0, 2, 3)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.range(500).selectExpr("id", "id % 7 AS v")
    a, b = (reports.bootstrap_mean(x, "v", ["id"]).first() for x in (rows.coalesce(1), rows.repartition(9)))
    assert a == b and a["low"] < a["mean"] < a["high"]
    assert a["high"] - a["low"] == pytest.approx(2 * 1.96 * np.std(np.arange(500) % 7) / np.sqrt(500), rel=0.35)


def test_merged_and_distinct(spark):
    one = spark.createDataFrame([("01", "x", 5), ("011", "x", 1)], "pattern string, method string, n long")
    two = spark.createDataFrame([("01", 9), ("011", 1), ("00", 3)], "pattern string, n long").withColumn("method", F.lit("y"))
    assert sorted(map(tuple, patterns.merged(one, two).collect())) == [("00", "y", 3), ("01", "y", 9)]
    t = spark.createDataFrame([("a", "01", 1, 4, 0.5), ("b", "01", 1, 9, 0.7), ("b", "00", 0, 2, 1.0)], "seq_id string, ctx string, nxt int, support long, confidence double")
    assert list(map(tuple, rules.distinct_rules(t, 1).collect())) == [("00", 0, 2, 1.0)] and rules.distinct_rules(t).count() == 2


def test_periodicity_validation_by_hand(spark):
    # "10" recurs in a at 2, 2 and in b at 3, 3, 2; sequences without it do not count
    got = {(r.pattern, r.period): r for r in validation.periodicity_validation(bits_of(spark, a="101010", b="10010010100", c="000"), 2).collect()}
    hit = got[("10", 2)]
    assert (hit.tests, hit.accuracy) == (5, 0.6)
    assert abs(hit.stability - (1 - np.std([1, 1 / 3]))) < 1e-6
    assert abs(got[("10", 3)].stability - (1 - np.std([0, 2 / 3]))) < 1e-6


def test_generic_validation_by_hand(spark):
    got = {(r.ctx, r.prediction): r for r in validation.generic_validation(bits_of(spark, a="1010", b="1110"), 1).collect()}
    assert (got[("1", 0)].tests, got[("1", 0)].accuracy) == (5, round((1 + 1 / 3) / 2, 6))
    assert (got[("0", 1)].tests, got[("0", 1)].accuracy, got[("0", 1)].stability) == (1, 1.0, 0.5)
    assert ("0", 0) not in got  # no rule without a hit
    assert validation.generic_validation(bits_of(spark, a="1"), 1).count() == 0


def test_plans_by_length(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10_000), ("c", 8 * 300 * 300)], "seq_id string, length long")
    assert {r.seq_id: (r.optimal, r.minimum, r.max_reliable) for r in validation.sample_plan(sizes, 12).collect()} == {"a": (100, 5, 9), "b": (491, 500, 16), "c": (491, 36000, 22)}
    assert {r.seq_id: r.grid for r in validation.grid_plan(sizes).collect()} == {"a": 64, "b": 64, "c": 256}
    assert {r.seq_id: r.grid for r in validation.grid_plan(sizes, 128).collect()}["c"] == 128


def test_consecutive_iterations(spark):
    table = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4)] + [("b", i) for i in (1, 2, 4, 5)], "seq_id string, iteration int")
    assert {r.seq_id: (r.iterations, r.runs, r.ready) for r in validation.consecutive(table).collect()} == {"a": (4, 2, True), "b": (4, 0, False)}


def test_classes_at_their_bounds(spark):
    values = spark.createDataFrame([(0.4,), (1.1,), (1.2,), (None,)], "h double")
    got = [r[0] for r in values.select(reports.classify(F.col("h"), reports.HURST, "non-stationary", closed=True)).collect()]
    assert got == ["uncorrelated", "critical", "non-stationary", None]


def test_recommendations(spark):
    table = spark.createDataFrame([(0.5, 0.5), (0.95, 0.95), (0.7, 0.95)], "precision double, stability double")
    row = validation.recommendations(table).first()
    assert row.asDict() == {"rules": 3, "poor": 1, "excellent": 1, "unstable": 1, "advice": "drop or refine poor rules; build on excellent rules; widen contexts"}
    assert validation.recommendations(table.limit(0)).count() == 0


def test_composition_validation_at_the_ends(spark):
    rules_ = spark.createDataFrame([("11", "00", "1100"), ("11", "00", "101"), ("01", "10", "0")], '"left" string, "right" string, whole string'.replace('"', ""))
    table = bits_of(spark, a="1100", b="1100" + "0" * 19 + "101", c="1100" + "0" * 17 + "101")
    got = {(r.left, r.right, r.whole): (r.tests, r.accuracy) for r in validation.composition_validation(table, rules_, [4]).collect()}
    assert got == {("11", "00", "1100"): (3, 1.0), ("11", "00", "101"): (3, 0.333333)}  # in c it lies within 20 bits, in b it does not


def test_runs_send_no_side_of_their_join_through_the_driver(spark):
    bits = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") % 3 % 2).cast("int").alias("bit"))
    copies = bits.withColumn("seq_id", F.explode(F.array(F.lit("a"), F.lit("b"))))  # estimated as no more rows than before
    run = scaling.runs(copies)
    assert run.count() == 2 * 334
    assert "LeftOuter, BuildRight" not in run._jdf.queryExecution().executedPlan().toString()
