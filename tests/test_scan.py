"""Scans over chunks against the same rules on whole strings, with chunks and groups of any size."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from bitlab.operators import chunks, collapse, scan, structure
from bitlab.operators.chunks import previous, ranked, running_sum
from bitlab.operators.staging import checkpointed


def texts(seed, alphabet, lengths):
    rnd = random.Random(seed)
    return {f"s{n}": "".join(rnd.choices(alphabet, k=n)) for n in lengths}


def frame(spark, seqs, size):
    rows = [(k, i, c) for k, t in seqs.items() for i, c in enumerate(t)]
    return checkpointed(scan.texts_of(spark.createDataFrame(rows, "seq_id string, pos long, sym string").repartition(5), size=size))


def whole(df, index="chunk"):
    out = {}
    for r in df.select("seq_id", index, "text").orderBy(index).collect():
        out[r["seq_id"]] = out.get(r["seq_id"], "") + r["text"]
    return out


@pytest.fixture(params=[(1, 2), (3, 3), (7, 1024), (1000, 1024)])
def cut(request, monkeypatch):
    """Chunk size and fan-out: from one symbol in a chunk and two chunks in a group on."""
    size, fan = request.param
    monkeypatch.setattr(chunks, "FAN", fan)
    monkeypatch.setattr(scan, "FAN", fan)
    return size


def phase(t, first):
    return re.sub("1+", "1", re.sub("0+", "0", t.replace(first, "0")))


def base(t):
    return "1" if set(t) == {"1"} else "0"


def local(t, rule=base, count=0):
    return re.sub(r"\(([01]+)\)", lambda m: rule(m[1]), t, count=count)


def frames(t, suffix):
    pattern = r"\(([01]+)\)1" if suffix else r"1\(([01]+)\)"
    return re.sub("1{2,}", "1", re.sub("0{2,}", "0", re.sub(pattern, lambda m: base(m[1]), t)))


def segments(t):
    return re.sub("[01]+", lambda m: base(m[0]), t)


def test_phases_and_deletions(spark, cut):
    seqs = texts(1, "01", [1, 2, 3, 10, 37, 200])
    df = frame(spark, seqs, cut)
    assert whole(collapse.phases(df, "01", "10")) == {k: phase(phase(t, "01"), "10") for k, t in seqs.items()}
    assert whole(collapse.phases(df, "10", "01")) == {k: phase(phase(t, "10"), "01") for k, t in seqs.items()}
    out = scan.rewrite(df, [collapse.without_pairs(), collapse.squeezed()])
    want = {k: re.sub("01|10", "", t) for k, t in seqs.items()}
    assert whole(out) == {k: re.sub("1+", "1", re.sub("0+", "0", t)) for k, t in want.items()}
    assert {r[0]: r[1] for r in out.groupBy("seq_id").agg(F.sum(F.get("lengths", F.lit(0)))).collect()} == {k: len(t) for k, t in want.items()}


def test_groups(spark, cut):
    seqs = texts(2, "01()", [1, 5, 60, 150]) | {"n": "((01)1)0((10)0)1" * 6, "e": "()(1)((", "f": "1(1)(1)1(0)1(1(1))", "g": "(1)1(0)1(1)"}
    df = frame(spark, seqs, cut)
    marked = checkpointed(scan.rewrite(df, [collapse.marked(")", "(")], backwards=True))
    after = lambda *layers: whole(scan.rewrite(marked, list(layers)))
    assert after(collapse.groups_to_bits()) == {k: local(t) for k, t in seqs.items()}
    assert after(collapse.groups_to_bits(first_only=True)) == {k: local(t, count=1) for k, t in seqs.items()}
    assert after(collapse.groups_to_bits(), collapse.based()) == {k: segments(local(t)) for k, t in seqs.items()}
    assert whole(collapse.frames(df)) == {k: frames(t, False) for k, t in seqs.items()}
    assert whole(collapse.frames(df, suffix=True)) == {k: frames(t, True) for k, t in seqs.items()}


def to_end(t, rule):
    while (u := local(t, rule)) != t:
        t = u
    return t


@pytest.mark.parametrize("variant", ["B", "E", "I"])
def test_collapse_to_the_end(spark, monkeypatch, variant):
    monkeypatch.setattr(scan, "FAN", 4)
    rule = {"B": base, "E": lambda t: phase(phase(t, "01"), "10"), "I": lambda t: phase(phase(t, "10"), "01")}[variant]
    layers = {"B": None, "E": collapse.phase_layers("01", "10"), "I": collapse.phase_layers("10", "01")}[variant]
    seqs = {"ten": "((01)1)0((10)0)1" * 10, "thousand": "((01)1)0((10)0)1" * 1000} | texts(3, "001()", [300])
    assert whole(collapse.collapse_to_end(frame(spark, seqs, 100), layers)) == {k: to_end(t, rule) for k, t in seqs.items()}


@pytest.mark.parametrize("rule", ["both", "01 first", "10 first"])
def test_deletion_trace(spark, rule):
    seqs = texts(4, "01", [1, 9, 100, 3000]) | {"deep": "0" * 9 + "1" * 9}
    got = {}
    for r in collapse.deletion_trace(frame(spark, seqs, 64), rule).orderBy("seq_id", "step").collect():
        got.setdefault(r["seq_id"], []).append((r["action"], r["length"]))
    squeeze = lambda t: re.sub("1+", "1", re.sub("0+", "0", t))
    steps = {"both": [("both", lambda t: re.sub("01|10", "", t))], "01 first": [("01", lambda t: t.replace("01", "")), ("10", lambda t: t.replace("10", "")), ("squeeze", squeeze)]}
    steps["10 first"] = [steps["01 first"][i] for i in (1, 0, 2)]
    for k, t in seqs.items():
        want, was = [("initial", len(t))], None
        while t != was:
            was = t
            for action, f in steps[rule]:
                if (u := f(t)) != t:
                    t = u
                    want.append((action, len(t)))
        if rule == "both" and squeeze(t) != t:
            want.append(("squeeze", len(squeeze(t))))
        assert got[k] == want


@pytest.fixture
def spread(spark, monkeypatch):
    """A sequence of many groups of chunks, dealt over many partitions that are not merged, as those of large tables: a group is still read in order by one task."""
    monkeypatch.setattr(chunks, "FAN", 4)
    monkeypatch.setattr(scan, "FAN", 4)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"

    def make(alphabet):
        seqs = texts(12, alphabet, [2000])
        return checkpointed(frame(spark, seqs, 10).repartition(16)), seqs["s2000"]

    spark.conf.set(merged, "false")
    yield make
    spark.conf.unset(merged)


def test_passes_of_a_sequence_in_many_partitions(spread):
    df, t = spread("01()")
    assert whole(collapse.local_passes(df, 2)) == {"s2000": local(local(t))}


def test_phases_of_a_sequence_in_many_partitions(spread):
    df, t = spread("01")
    assert whole(collapse.phases(df, "01", "10")) == {"s2000": phase(phase(t, "01"), "10")}
    assert whole(collapse.phases(df, "10", "01")) == {"s2000": phase(phase(t, "10"), "01")}


def test_steps_of_a_sequence_in_many_partitions(spread):
    df, t = spread("01()")
    marked = checkpointed(scan.rewrite(df, [collapse.marked(")", "(")], backwards=True))
    assert whole(scan.rewrite(marked, [collapse.groups_to_bits(first_only=True), collapse.based()])) == {"s2000": segments(local(t, count=1))}
    assert whole(collapse.frames(df, suffix=True)) == {"s2000": frames(t, True)}


def test_deletions_of_a_sequence_in_many_partitions(spread):
    df, t = spread("01")
    got = [r["length"] for r in collapse.deletion_trace(df, "01 first").orderBy("step").collect()]
    first = t.replace("01", "")
    assert got[:3] == [len(t), len(first), len(first.replace("10", ""))]


def test_recut(spark):
    seqs = texts(5, "01", [0, 1, 9, 10, 11, 95])
    df = frame(spark, seqs, 7)
    got = scan.recut(df, size=10).collect()
    assert sorted((r["seq_id"], r["part"], r["text"]) for r in got) == sorted((k, i // 10, t[i : i + 10]) for k, t in seqs.items() for i in range(0, len(t), 10))


def test_unknown_symbols_and_empty_tables(spark):
    empty = spark.createDataFrame([], "seq_id string, chunk long, text string")
    assert scan.rewrite(empty, [collapse.squeezed()]).count() == 0
    with pytest.raises(Exception, match="symbols other than"):
        scan.rewrite(spark.createDataFrame([("a", 0, "01x")], "seq_id string, chunk long, text string"), [collapse.squeezed()]).collect()


@pytest.mark.parametrize(("size", "fan"), [(1, 2), (4, 3), (1024, 1024)])
def test_prefixes_in_levels(spark, monkeypatch, size, fan):
    monkeypatch.setattr(chunks, "FAN", fan)
    rnd = random.Random(6)
    rows = [(s, p, rnd.randint(-3, 3)) for s in "ab" for p in sorted(rnd.sample(range(80), 50))]
    df = spark.createDataFrame(rows, "seq_id string, pos long, v int").repartition(3)
    got = running_sum(ranked(previous(df, "v", "was", size), "nth", size), F.col("v"), "sum", size).collect()
    for s in "ab":
        mine, own = sorted((r for r in got if r["seq_id"] == s), key=lambda r: r["pos"]), [r[2] for r in rows if r[0] == s]
        assert [r["nth"] for r in mine] == list(range(1, 51)) and [r["was"] for r in mine] == [None, *own[:-1]]
        assert [r["sum"] for r in mine] == [sum(own[: i + 1]) for i in range(50)]


def stack_nodes(text):
    stack, out, ones, zeros, closed = [], set(), 0, 0, 0
    for i, c in enumerate(text):
        ones, zeros = ones + (c == "1"), zeros + (c == "0")
        if c == "(":
            stack.append((i, ones, zeros, closed))
        elif c == ")" and stack:
            o, n1, n0, n = stack.pop()
            closed += 1
            out.add((o, i, len(stack) + 1, ones - n1, zeros - n0, closed - n, stack[-1][0] if stack else None))
    return out


@pytest.mark.parametrize(("size", "fan"), [(1, 2), (5, 3), (64, 1024)])
def test_nodes_against_a_stack_whatever_the_chunks(spark, monkeypatch, size, fan):
    monkeypatch.setattr(chunks, "FAN", fan)
    text = texts(8, "(()01", [150])["s150"] + texts(9, "())01", [150])["s150"]
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(text)], "seq_id string, pos long, sym string").repartition(4)
    got = structure.nodes(checkpointed(structure.depths(df, size)), size).drop("seq_id").collect()
    assert set(map(tuple, got)) == stack_nodes(text)


def test_a_sequence_of_a_million_symbols(spark):
    """Depths, nodes and safe cuts of one sequence; no task has more than a few chunks of it."""
    rnd = random.Random(10)
    text = "".join(rnd.choices("(()))0101", k=1_000_000))
    chunked = spark.createDataFrame([("a", i, text[i * 1000 : (i + 1) * 1000]) for i in range(1000)], "seq_id string, chunk long, text string")
    symbols = chunked.select("seq_id", "chunk", F.posexplode(F.split("text", ""))).where("col <> ''").select("seq_id", (F.col("chunk") * 1000 + F.col("pos")).alias("pos"), F.col("col").alias("sym"))
    deep = checkpointed(structure.depths(checkpointed(symbols)))
    want = stack_nodes(text)
    got = structure.nodes(deep).agg(F.count(F.lit(1)), F.sum("close_pos"), F.max("depth"), F.sum("n_ones"), F.sum("size"), F.sum(F.coalesce("parent_pos", F.lit(-1)))).first()
    assert tuple(got) == (len(want), *(f(w[i] for w in want) for f, i in ((sum, 1), (max, 2), (sum, 3), (sum, 5))), sum(-1 if w[6] is None else w[6] for w in want))
    cuts = collapse.safe_cuts(deep, 500).agg(F.max(F.length("text")), F.sum(F.length("text"))).first()
    assert cuts[0] <= 1024 and cuts[1] == deep.count()


@pytest.mark.parametrize("n", [1, 31, 32, 33, 64, 200])
def test_window_codes(spark, n):
    from bitlab.operators import codes

    text = texts(11, "01", [n])[f"s{n}"]
    bits = spark.createDataFrame([("a", i, int(c)) for i, c in enumerate(text)], "seq_id string, pos long, bit int").repartition(3)
    lengths = [1, 2, 7, 31, 32]
    windows = [(k, i, text[i : i + k]) for k in lengths for i in range(n - k + 1)]
    got = codes.gram_counts(bits, lengths).select("len", codes.text_of(F.col("code"), F.col("len")), "n", "first_pos").collect()
    assert sorted(map(tuple, got)) == sorted((k, t, sum(w[0] == k and w[2] == t for w in windows), min(i for l, i, u in windows if (l, u) == (k, t))) for k, t in {(w[0], w[2]) for w in windows})
    by_part = codes.gram_counts(bits, [2], segments=4).select("segment", codes.text_of(F.col("code"), F.col("len")), "n").collect()
    want = {}
    for k, i, t in windows:
        if k == 2:
            key = (min(i // max(n // 4, 1), 3), t)
            want[key] = want.get(key, 0) + 1
    assert {(s, t): c for s, t, c in by_part} == want
    tiles = codes.tile_counts(bits, [1, 2, 5, 7, 32]).select("len", codes.text_of(F.col("code"), F.col("len")), "n").collect()
    cut = [(k, text[i : i + k]) for k in (1, 2, 5, 7, 32) for i in range(0, n - k + 1, k)]
    assert sorted(map(tuple, tiles)) == sorted((*x, cut.count(x)) for x in set(cut))
    assert sorted(map(tuple, codes.gram_codes(bits, 32).select("pos", codes.text_of(F.col("code"), F.lit(32))).collect())) == [(i, t) for k, i, t in windows if k == 32]
    with pytest.raises(ValueError, match="within"):
        codes.gram_counts(bits, [33])
