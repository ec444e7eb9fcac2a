"""Each operator against brute force on whole small tables, and on the cases at the edge."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bitlab.llm import hamming, mixing, packing, quality, queries, secrets, sharding, simhash, substrings, tokenfile, toxicity
from bitlab.llm.common import new_folder
from bitlab.llm.components import components
from bitlab.llm.tokens import Encoder, vocabulary_of

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return (text or "").encode().split()


# 1 quality rules
def brute_quality(text):
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_quality(request, which):
    df = request.getfixturevalue(which)
    got = quality.judge(df, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(d, *(b := brute_quality(t)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for d, t in pairs(df)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_quality_hosts(spark):
    good = " ".join(f"w{i}" for i in range(50))
    rows = [(f"h{h}", "bad") for h in range(2) for _ in range(60)] + [(f"g{h}", good) for h in range(10) for _ in range(60)] + [("h0", good), ("tiny", "bad"), (None, good)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {(r["source"], r["base_failed"]): (r["host_bad"], r["kept"]) for r in quality.judge(df, ["doc_id", "source"]).collect()}
    assert got["h0", False] == (True, False)  # a clean document of a bad host
    assert got["g1", False] == (False, True) and got[None, False] == (False, True)
    f = {f"f_{r}": F.col("x") for r in quality.RULES}
    rates = quality.host_verdicts(spark.createDataFrame([("a", 1)] * 3 + [("b", 0)] * 300, "h string, x int").select("h", *[c.alias(k) for k, c in f.items()]), "h").collect()
    assert all(0 < r["rate_short"] < 1 for r in rates)


# 2 sharding
@pytest.mark.parametrize(("which", "shards", "ranges"), [("edge", 3, None), ("docs", 16, None), ("docs", 5, 7)])
def test_sharding(request, which, shards, ranges):
    df = request.getfixturevalue(which)
    got = sharding.shard(df, shards, ranges=ranges).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(df))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r)
    for rows in per.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["slot"]) if r["doc_id"] is not None]
        assert ids == sorted(ids)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in per[s]) - total / shards) <= most for s in range(shards))


def test_sharding_hot_key(spark):
    df = spark.createDataFrame([(7 if i % 3 else i, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(df, 4, ranges=32).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert max(r["s"] for r in got) - min(r["s"] for r in got) <= 102
    records = df.select(F.col("doc_id").alias("key"), F.monotonically_increasing_id().alias("tie"), (F.length("text") + 1).alias("size"))
    ranges = sharding._with_range(records, sharding.splitters_for(records, 32)).groupBy("range").agg(F.sum("size").alias("s")).collect()
    assert max(r["s"] for r in ranges) <= 4 * sum(r["s"] for r in ranges) / 32  # the hot key is cut too


def test_splitters_are_never_dropped(spark, monkeypatch):
    """With room for few splitters all of those found stay, over all the keys, and the largest ranges are cut first."""
    df = spark.range(20_000).select((F.col("id") * 7).alias("key"), F.col("id").alias("tie"), (1 + F.col("id") % 90).alias("size"))
    monkeypatch.setattr(sharding, "MAX_RANGES", 34)
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)
    found = sharding.splitters_for(df, 32)
    sizes = [r["s"] for r in sharding._with_range(df, found).groupBy("range").agg(F.sum("size").alias("s")).collect()]
    assert len(found) <= 34 and max(sizes) <= 5 * sum(sizes) / 32


# 3 packing
def own_tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize(("which", "window"), [("edge", 64), ("docs", 1024), ("docs", 50)])
def test_packing(request, which, window):
    df = request.getfixturevalue(which)
    t = own_tokenizer("byte_bpe_50k.json")
    ids = {(d, x): np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for d, x in pairs(df)}
    got = packing.pack(df, window=window, keep_ids=True, open_windows=8).collect()
    n = Counter(pairs(df))
    assert sum(r["length"] for r in got) == sum(k * len(ids[p]) for p, k in n.items())
    starts = defaultdict(Counter)
    for r in got:
        x = np.frombuffer(r["ids"], "<u4")
        assert len(x) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert any(d == r["doc_id"] and len(v) == r["doc_tokens"] and (v[r["start"] : r["start"] + r["length"]] == x).all() for (d, _), v in ids.items())
        starts[r["sequence_id"]][r["offset"]] += r["length"]
    for at in starts.values():
        end = 0
        for offset, length in sorted(at.items()):
            assert offset == end
            end += length
        assert end <= window
    if which == "docs" and window == 50:
        assert sum(r["length"] for r in got) > 0.97 * window * len(starts)


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_is_exact(edge, docs, name, spaced):
    rng = np.random.default_rng(3)
    bits = ["a", "B", "é", "'s", "'re", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", " ", "1", "²", "½", "_", "-", "!!", ",", ".", "'", "ß", "İ", "β", "漢", "́", "é", "😀", "foo", "<|endoftext|>", "</w>", "×", "Ω", "ſ", "Ǆ"]
    texts = [t or "" for _, t in pairs(edge) + pairs(docs)] + ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in own_tokenizer(name).encode_batch(texts, add_special_tokens=False)]
    assert Encoder(public_tokenizers.path(name), spaced).encode(texts) == want


# 4 secrets
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_secret_base_spans(request, which):
    df = request.getfixturevalue(which)
    want = Counter()
    for d, t in pairs(df):
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        want[d, tuple(sorted(s))] += 1
    got = Counter((r["doc_id"], tuple((x["start"], x["kind"], x["end"]) for x in r["spans"] if x["kind"] < 3)) for r in secrets.find_secrets(df).collect())
    assert got == want


def brute_classes(df):
    """Spans with classes by document, from owners and repositories counted over the whole table."""
    kinds = {0: ASSIGN, 1: re.compile("AKIA[A-Z0-9]+"), 2: re.compile("[0-9a-f]+")}
    least = {0: 12, 1: 18, 2: 16}
    free = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
    bad = re.compile("example|sample|dummy|placeholder|changeme|your|xxxx|test|0123456789|abcdef", re.IGNORECASE)
    bits = lambda v: -sum(n / len(v) * np.log2(n / len(v)) for n in Counter(v).values())
    mixed = lambda v: any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
    repos, owners, live, spans = defaultdict(set), defaultdict(set), defaultdict(bool), defaultdict(list)
    for r in df.collect():
        t, found = r["text"] or "", []
        for k, p in kinds.items():
            for m in p.finditer(t):
                v = m[2] if k == 0 else m[0]
                if len(v) >= least[k]:
                    found.append((m.start(), k, m.end(), v))
        for m in free.finditer(t):
            if mixed(m[0]) and bits(m[0]) >= 3.5 and not bad.search(m[0]) and not any(a < m.end() and m.start() < b for a, _, b, _ in found):
                found.append((m.start(), 3, m.end(), m[0]))
        for _, k, _, v in found:
            repos[v].add(str(r["doc_id"]) if r["doc_id"] is not None else "")
            owners[v].add(r["source"] or "")
            live[v] |= k == 3 or not bad.search(v) and (bits(v) >= 2.5 if k < 2 else bits(v) >= 3 and mixed(v))
        spans[r["doc_id"]].append(sorted(found))
    out = Counter()
    for d, rows in spans.items():
        for found in rows:
            named = []
            for a, k, b, v in found:
                n = len(owners[v])
                c = "example" if not live[v] or n >= 3 or n > 1 and len(repos[v]) >= 5 * n else "owned" if n == 1 else "shared"
                if k < 3 or c == "owned":
                    named.append((a, k, b, c))
            out[d, tuple(named)] += 1
    return out


@pytest.mark.parametrize("which", ["edge", "docs", "larger"])
def test_secret_classes(request, spark, which):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if which == "larger" else request.getfixturevalue(which)
    want = brute_classes(df)
    assert Counter((r["doc_id"], tuple((x["start"], x["kind"], x["end"], x["class"]) for x in r["spans"])) for r in secrets.find_secrets(df).collect()) == want
    if which == "larger":
        assert {c for _, s in want for *_, c in s} >= {"example", "owned"}


def test_repositories_tell_copies_from_shared(spark):
    v, w = "k9Xv2Qm7Lp4Zt8Rw3Yb6Nc1D", "Zq8Ws4Ed2Rf6Tg9Yh1UjKo3L"
    rows = [(i, f"password = {v}", f"o{i % 2}") for i in range(12)] + [(20 + i, f"password = {w}", f"o{i % 2}") for i in range(4)]
    got = {r["doc_id"]: r["spans"][0]["class"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {got[i] for i in range(12)} == {"example"} and {got[i] for i in range(20, 24)} == {"shared"}


def test_secret_ownership(spark):
    live, example, free = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "Zx9Qw7Er5Ty3Ui1Op8As6Df4"
    rows = [(1, f"token = {live}", "a"), (2, f"again {live}", "a"), (5, f"key {free}", "b")] + [(10 + i, f"token = {example}", f"o{i}") for i in range(4)] + [(20 + i, f"key Aa1{'Bb2Cc3' * 4}", f"o{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: [(x["kind"], x["class"]) for x in r["spans"]] for r in secrets.find_secrets(df).collect()}
    assert set(got[1]) == {(0, "owned"), (2, "owned")} and got[5] == [(3, "owned")]
    assert {c for _, c in got[10]} == {"example"} and got[20] == []
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(df).collect()}
    assert masked == {r["doc_id"]: r["text"] for r in secrets.mask_secrets(df, max_spared=-1).collect()}
    assert masked[1] == "[SECRET]" and masked[2] == "again [SECRET]" and masked[5] == "key [SECRET]" and masked[10] == rows[3][1]


# 5 substrings
def brute_substrings(rows, n=50):
    first = {}
    key = lambda d: (1 << 63) - 1 if d is None else d
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, 1 << 64), key(d))
    out = Counter()
    for d, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < key(d):
                gone[i : i + n] = True
        out[d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    return out


@pytest.mark.parametrize(("which", "n"), [("edge", 50), ("docs", 50), ("docs", 21)])
def test_substrings(request, which, n):
    df = request.getfixturevalue(which)
    if which == "edge":
        df = df.where("doc_id IS NULL OR doc_id <> 6").unionByName(df.where("doc_id = 6").withColumn("text", F.substring("text", 1, 4000)))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(df, n).collect())
    assert got == brute_substrings(pairs(df), n)


def test_substrings_random(spark):
    rng = np.random.default_rng(1)
    base = [str(x) for x in rng.integers(0, 4, 400)]
    rows = []
    for i in range(60):
        a, b = sorted(rng.integers(0, 400, 2))
        w = base[a:b] + [str(x) for x in rng.integers(0, 4, 30)] + base[: rng.integers(0, 120)]
        rows.append((int(rng.integers(0, 50)), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(df).collect())
    assert got == brute_substrings(rows)


def test_masking_does_not_depend_on_the_way(spark):
    """A value of two owners is masked where it is named a secret, and free-standing it stays, in one document too."""
    v = "k9Xv2Qm7Lp4Zt8Rw3Yb6Nc1D"
    rows = [(1, f"password = {v} and then {v} alone", "a"), (2, f"password = {v}", "b"), (None, f"see {v} here", "a"), (None, f"password = {v}", "b"), (3, "token = Zq8Ws4Ed2Rf6Tg9Yh1Uj", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    here, joined = (sorted(r["text"] for r in secrets.mask_secrets(df, max_spared=n).collect()) for n in (secrets.MAX_SPARED, 0))
    assert here == joined == sorted([f"[SECRET] and then {v} alone", "[SECRET]", f"see {v} here", "[SECRET]", "[SECRET]"])


# 6 mixing
def deviations(slots, share):
    """The largest distance of any source from its share of the slots so far, while all sources last."""
    total, worst, had = sum(share.values()), 0, Counter()
    left = Counter(slots[t] for t in slots)
    for t in range(len(slots)):
        had[slots[t]] += 1
        left[slots[t]] -= 1
        worst = max(worst, *(abs(had[s] - w * (t + 1) / total) for s, w in share.items()))
        if not left[slots[t]]:
            break
    return worst, t + 1


def test_mixing_is_pfair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs, ["doc_id", "source"]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in pairs(docs))
    owner = {}
    for r in got:
        assert owner.setdefault(r["slot"], r["source"]) == r["source"]
        assert r["release"] <= r["slot"] < r["deadline"]
    assert sorted(owner) == list(range(len(owner)))
    worst, _ = deviations(owner, {r["source"]: r["share"] for r in got})
    assert worst < 1


def test_mixing_keeps_to_the_target(spark):
    """Half of all to one of 101 sources, over the whole run; then the rest among those that are left."""
    rows = spark.range(8000).selectExpr("id AS doc_id", "CASE WHEN id < 4000 THEN 'big' ELSE concat('s', id % 100) END AS source")
    w = spark.createDataFrame([("big", 0.5), *[(f"s{i}", 0.005) for i in range(100)]], "source string, weight double")
    got = mixing.mix(rows, ["doc_id", "source"], weights=w, block=2).collect()
    slots = {r["slot"]: r["source"] for r in got}
    worst, seen = deviations(slots, {"big": 0.5, **{f"s{i}": 0.005 for i in range(100)}})
    assert worst < 1.001 and seen > 3600
    assert sorted(slots) == list(range(4000)) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_mixing_small_schedule(spark):
    k = spark.createDataFrame([("a", 1, 10), ("b", 5, 50), ("c", 10, 100), ("d", 16, 160)], "source string, p long, blocks long")
    slots = {r["slot"]: r["source"] for r in mixing.pfair(k).collect()}
    assert sorted(slots) == list(range(320))
    for s, n in (("a", 1), ("b", 5), ("c", 10), ("d", 16)):
        had = 0
        for t in range(320):
            had += slots[t] == s
            assert abs(had - n * (t + 1) / 32) < 1


def test_mixing_edges(edge, spark, monkeypatch):
    got = mixing.mix(edge, edge.columns, prefix="m_").collect()
    assert len(got) == edge.count()
    w = spark.createDataFrame([("", 1.0), *[(f"s{i}", 2.0) for i in range(4)]], "source string, weight double")
    got = mixing.mix(edge, ["doc_id", "source"], weights=w).collect()
    assert {r["source"]: r["share"] for r in got}["s1"] == 2 * {r["source"]: r["share"] for r in got}[None]
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(edge, ["doc_id"], weights=w.where("source <> 's1'"))
    monkeypatch.setattr(mixing, "MAX_SLOTS", 7)  # blocks grow instead
    assert len({r["slot"] for r in mixing.mix(edge, ["doc_id"]).collect()}) <= 7 + 5


def test_mixing_takes_many_sources(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "concat('s', id % 300) AS source")
    got = mixing.mix(df, ["doc_id", "source"]).collect()
    assert len({r["doc_id"] for r in got}) == len(got) == 900
    assert len({r["slot"] for r in got}) == 300 and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_mixing_is_the_same_however_it_is_cut(spark, monkeypatch):
    """Far over ``MAX_SLOTS`` too, blocks stay at 4 rows and every place is that of the SQL."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = Counter(con.sql(mixing.ORACLE).fetchall())
    for slots in (1, 8):
        monkeypatch.setattr(mixing, "MAX_SLOTS", slots)
        assert Counter(map(tuple, mixing.op6_mixing(spark, SF).collect())) == want


def brute_pfair(sources):
    """Slot by slot: of the released blocks the one with the earliest deadline; shares anew at each end."""
    names, ps, bs = zip(*sorted(sources), strict=True)
    done, had, start, total, out = [0] * len(ps), [0] * len(ps), 0, sum(ps), []
    for t in range(sum(bs)):
        release = [start + (n - h) * total // p for n, h, p in zip(done, had, ps, strict=True)]
        deadline = [start + -(-(n - h + 1) * total // p) for n, h, p in zip(done, had, ps, strict=True)]
        d, j = min((deadline[j], j) for j in range(len(ps)) if done[j] < bs[j] and release[j] <= t)
        out.append((names[j], ps[j], done[j], t, release[j], d))
        done[j] += 1
        if done[j] == bs[j]:
            start, total, had = t + 1, total - ps[j], done[:]
    return out


@pytest.mark.parametrize(("slots", "parts"), [(16, (5, 9, 930, 977)), (64, (7, 7, 14, 21)), (1, (500, 713, 1021, 1499)), (1 << 12, (5, 9, 930, 977))])
def test_mixing_pieces_begin_as_the_fold_does(spark, monkeypatch, slots, parts):
    monkeypatch.setattr(mixing, "MAX_SLOTS", slots)
    rows = [(f"s{i}", parts[i % 4], 60 + 97 * i % 400) for i in range(9)]
    df = spark.createDataFrame(rows, "source string, p long, blocks long")
    assert sorted(map(tuple, mixing.pfair(df).collect()), key=lambda r: r[3]) == brute_pfair(rows)


# 7 SimHash
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text, n=4):
    w = [x.decode() for x in (text or "").translate(LOWER).encode().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, close):
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if close(nodes[i], nodes[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(nodes))]


def check_groups(got, rows, bits):
    fps = [brute_fingerprint(t) if len(t or "") < 1e5 else None for _, t in rows]
    long = {t: r["fp"] for r in got for d, t in rows if d == r["doc_id"] and len(t or "") >= 1e5}
    fps = [f if f is not None else long[t] % (1 << 64) for f, (_, t) in zip(fps, rows, strict=True)]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    low = defaultdict(lambda: None)
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            low[r] = d if low[r] is None else min(low[r], d)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((d, f, low[r]) for (d, _), f, r in zip(rows, fps, roots, strict=True))


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    check_groups(simhash.near_duplicates(df).collect(), pairs(df), 4)


@pytest.mark.parametrize(("layout", "bits"), [("small", 4), ("medium", 4), ("small", 5)])
def test_simhash_layouts_find_all_links(spark, layout, bits):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            x = int(b)
            for at in rng.choice(64, rng.integers(1, bits + 3), replace=False):
                x ^= 1 << int(at)
            fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f) for f in fps]
    df = spark.createDataFrame([(f, 0) for f in signed], "fp long, chk long")
    named = {r["node"]: r["component"] for r in components(simhash.links(df, bits, 128, layout)).collect()}
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    low = {}
    for f, r in zip(signed, roots, strict=True):
        low[r] = min(low.get(r, f), f)
    assert [named.get(f, f) for f in signed] == [low[r] for r in roots]


def test_simhash_dense_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    fps = sorted({a ^ (1 << i) ^ (1 << j) for a in (0, (1 << 40) - 1) for i in range(30) for j in range(30)})
    df = spark.createDataFrame([(f, 0) for f in fps], "fp long, chk long")
    found = simhash.links(df)
    assert found.count() < 200 * len(fps)
    assert components(found).select("component").distinct().count() == 2


def cosine(a, b):
    return sum(n * b[x] for x, n in a.items()) / max(1e-9, (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5)


def brute_similar(texts, similarity=0.8, n=5):
    """Counts of each text's shingles, and the pairs that are so similar; only pairs that share a shingle are looked at."""
    counts, where = [], defaultdict(list)
    for i, t in enumerate(texts):
        w = t.translate(LOWER).encode().split()
        counts.append(Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))))
        for g in counts[-1]:
            where[g].append(i)
    shared = {(a, b) for rows in where.values() for k, b in enumerate(rows) for a in rows[:k]}
    return counts, [p for p in shared if cosine(counts[p[0]], counts[p[1]]) >= similarity]


def groups_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("texts_at_once", [1024, 4])
def test_similar_groups(spark, monkeypatch, texts_at_once):
    """Links are exact; those that fingerprints do not propose are few. Small blocks take the way of large groups."""
    monkeypatch.setattr(simhash, "TEXTS", texts_at_once)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[^ ]'").orderBy("doc_id").collect()
    texts = list({r["text"]: r["doc_id"] for r in reversed(rows) if r["text"].split()}.items())
    df = spark.createDataFrame([(d, t) for t, d in texts], "doc_id long, text string")
    first, staged = simhash.similar_groups(df)
    got = {r["doc_id"]: r["first"]["id"] for r in staged.join(first, ["fp", "chk"]).collect()}
    ids = [d for _, d in texts]
    _, links = brute_similar([t for t, _ in texts])
    root = groups_of(len(ids), links)
    low = defaultdict(lambda: 1 << 60)
    for d, r in zip(ids, root, strict=True):
        low[r] = min(low[r], d)
    inside = {(d, low[r]) for d, r in zip(ids, root, strict=True)}
    assert all(root[ids.index(d)] == root[ids.index(f)] for d, f in got.items())  # no link that is not there
    assert sum(got[ids[a]] == got[ids[b]] for a, b in links) >= 0.9 * len(links) > 20
    assert sum((d, f) in inside for d, f in got.items()) >= 0.95 * len(ids)


def test_band_plan():
    for n in (10, 200_000, 15_000_000, 10**10):
        width, bands = simhash.band_plan(n, 0.8)
        assert n * (1 + width + width * (width - 1) / 2) / 2**width <= 2048 and bands >= 5
    a = simhash._shingle_hashes("a b c d e f a b c d e f", 5)
    assert simhash.cosine(a, a) == pytest.approx(1) and simhash.cosine(a, a[:0]) == 0


def test_dedup_keeps_texts_of_repeated_ids(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    rows = [(1, long[0], "x"), (1, long[1], "x"), (2, long[1] + " z", "x"), (3, long[2], "x"), (3, long[2], "y"), (None, long[0], "x"), (4, "", "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.dedup_stage(spark, df, SF).collect()), key=str)
    assert got == sorted([(1, long[0]), (1, long[1]), (3, long[2]), (None, long[0]), (4, ""), (5, "")], key=str)


def test_anchor_codes_cover():
    v = np.random.default_rng(0).integers(0, 1 << 32, 2000).astype(np.uint64)
    for code, radius in (("h", 1), ("g", 3)):
        own = simhash.anchor_of(v, code)
        assert np.bitwise_count(own ^ v).max() <= radius
        assert (simhash.anchor_of(own, code) == own).all()
    assert len(np.unique(simhash.anchor_of(np.arange(1 << 15, dtype=np.uint64), "h"))) == 1 << 11


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 502), (502, 501), (900, 900)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 502: 500}


# 8 Hamming
def test_hamming(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(-(1 << 62), 1 << 62, 30)
    codes = [int(c) ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 9), replace=False))) for c in rng.choice(centres, 3000)]
    codes[:900] = [codes[0]] * 900  # one code holds a third of the rows
    rows = spark.createDataFrame([*enumerate(codes), (5000, None)], "id long, code long")
    got = defaultdict(list)
    for r in hamming.top_k(rows, rows.where("id % 50 = 0"), 7).collect():
        got[r["query_id"]].append((r["rank"], r["distance"], r["id"]))
    for q in range(0, 3000, 50):
        want = sorted(((codes[q] ^ c) & ((1 << 64) - 1)).bit_count() * 10_000 + i for i, c in enumerate(codes))[:7]
        assert sorted(got[q]) == [(n + 1, w // 10_000, w % 10_000) for n, w in enumerate(want)]
    assert 5000 not in got


def test_hamming_shuffled_as_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.integers(0, 1 << 20, 400))], "id long, code long")
    found = lambda: sorted(map(tuple, hamming.top_k(rows, rows.where("id % 50 = 0"), 5).collect()))
    broadcast = found()
    monkeypatch.setattr(hamming, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(hamming, "TASK_PROBES", 64)
    assert found() == broadcast and len(broadcast) == 40


def test_hamming_few_rows(spark):
    rows = spark.createDataFrame([(1, 0), (50, 3), (50, 3)], "id long, code long")
    assert sorted(map(tuple, hamming.top_k(rows, rows.where("id = 1")).collect())) == [(1, 1, 1, 0), (1, 2, 50, 2), (1, 3, 50, 2)]
    assert hamming.top_k(rows.where("false"), rows.where("false")).count() == 0
    vectors = spark.createDataFrame([([1.0, -1.0, float("nan"), None],), (None,), ([],)], "e array<double>")
    assert [r[0] for r in vectors.select(hamming.sign_code(F.col("e"))).collect()] == [[5], None, [0]]


def test_hamming_wide_codes(spark):
    """Vectors of 200 dimensions; each query is found first, and no code is lost."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 200))
    v = base[rng.integers(0, 20, 1200)] * np.where(rng.random((1200, 200)) < 0.05, -1, 1)
    rows = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(v)], "id long, e array<double>, rank string").select("id", hamming.sign_code(F.col("e")).alias("code"), "rank")
    rounds = []
    got = defaultdict(list)
    for r in hamming.top_k(rows, rows.where("id % 50 = 0"), 5, rounds).collect():
        got[r["query_id"]].append((r["rank"], r["distance"], r["id"]))
    for q in range(0, 1200, 50):
        d = ((v > 0) != (v[q] > 0)).sum(axis=1)
        want = sorted(zip(d.tolist(), range(1200), strict=True))[:5]
        assert sorted(got[q]) == [(n + 1, a, b) for n, (a, b) in enumerate(want)]
    assert rounds[-1] == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_hamming_needs_no_scan(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    rounds = []
    hamming.top_k(rows, rows.where("id % 50 = 0"), 10, rounds)
    assert rounds[-1] == 0 and len(rounds) <= 4


# 9 token files
@pytest.mark.parametrize("width", [1, 7, 13, 16, 17, 31])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    data = tokenfile.pack_ids(ids, width)
    assert len(data) == -(-1001 * width // 8) and (tokenfile.unpack_ids(data, 1001, width) == ids).all()
    out = io.BytesIO()
    w = tokenfile.Writer(out, width, block_ids=100)
    cuts = [0, 3, 3, 250, 700, 1001]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        w.add(None if k == 2 else k, ids[a:b])
    w.close()
    r = tokenfile.Reader(io.BytesIO(out.getvalue()))
    assert [r.document(k).tolist() for k in range(5)] == [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    assert r.ids(95, 310).tolist() == ids[95:310].tolist() and r.there.tolist() == [1, 1, 0, 1, 1]
    with pytest.raises(ValueError, match="cut short"):
        tokenfile.Reader(io.BytesIO(out.getvalue()[:-3]))


def test_a_read_task_for_each_file(spark, docs):
    manifest = tokenfile.write_tokens(docs, new_folder(spark, "t"), files=5)
    assert manifest.count() == 5
    parts = tokenfile.read_documents(manifest).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 5
    assert vocabulary_of(public_tokenizers.path("word_bpe_49k.json")) == 49408


def test_width():
    assert [tokenfile.width_for(v) for v in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_token_files(request, spark, which):
    df = request.getfixturevalue(which)
    manifest = tokenfile.write_tokens(df, new_folder(spark, "t"), files=3)
    got = sorted(tokenfile.read_documents(manifest, with_ids=True).collect(), key=lambda r: r["start"])
    t = own_tokenizer("word_bpe_49k.json")
    want = Counter((d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, x in pairs(df))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))


# 10 toxicity
def test_toxicity_held_out(spark):
    out = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in out.items())
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    pos, neg = ([out[r["doc_id"]]["score"] for r in labels if r["toxic"] == t] for t in (1, 0))
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc > 0.75


def brute_clauses(text):
    """Matches of each clause by rules spelled out: (violent, denied, told, aimed) of every insult or threat."""
    out = []
    for clause in re.split(r"[.!?;:\n|]", text.lower()):
        found, deny, tell = [], False, False
        words_ = re.findall(r"[^\W\d_]+", clause)
        for w in words_:
            if w in toxicity.NEGATION:
                deny = True
            elif w in toxicity.REPORT:
                tell = True
            elif w in toxicity.THREAT or "=" + w in toxicity.SEEDS:
                found.append((w in toxicity.THREAT, deny, tell and not deny, any(x in toxicity.TARGET for x in words_)))
                deny = False
        if found:
            out.append(found)
    return out


def test_toxicity_grammar_against_rules():
    rng = np.random.default_rng(4)
    bits = ["you", "they", "not", "never", "said", "claims", "idiot", "scum", "kill", "burn", "tree", "blue", ".", "!", "\n", ":", "walks"]
    scorer = toxicity.Scorer(toxicity.SEEDS)
    for _ in range(2000):
        text = " ".join(rng.choice(bits, rng.integers(0, 25)))
        want = []
        for found in brute_clauses(text):
            sums = [0.0] * 12
            for v, d, t, a in found:
                sums[6 * a + 3 * v + (1 if d else 2 if t else 0)] += 1.0 if v else 3.0
            want.append(sums)
        assert scorer.clauses(text)[0] == want


def test_toxicity_grammar():
    f = lambda t: toxicity.Scorer(toxicity.SEEDS).features(t)[0]
    assert f("you are an idiot") > f("an idiot") > f("she said idiot") > f("a fine day") == f("") == f(None) == 0
    assert f("not an idiot") < f("an idiot") and f("you. an idiot") == f("an idiot") and f("idiot, you are") == f("you idiot")
    assert f("kill you") > f("kill") > 0
    assert toxicity.GRAMMAR.states == 8 and toxicity.compose().states == 1


#: For each transducer, clauses that only it tells apart: toxic ones and others.
TELLING = {
    "TARGETS": (["the idiot, you see", "you idiot"], ["the idiot, one sees. you walk", "you. idiot"]),
    "NEGATIONS": (["they are an idiot", "never here. an idiot"], ["they are not an idiot", "here never an idiot"]),
    "REPORTS": (["they said it. an idiot", "an idiot"], ["they said an idiot", "told an idiot"]),
    "THREATS": (["will burn and kill", "kill"], ["will turn and walk", "walk"]),
}


@pytest.mark.parametrize("name", TELLING)
def test_toxicity_needs_each_transducer(spark, name):
    """Learned from labels, the whole grammar tells the held-out rows; without the transducer it does not."""
    rng = np.random.default_rng(1)
    fill = lambda: " ".join(rng.choice(["tree", "blue", "stone", "water", "long"], 12)) + ". "
    rows = [(i, fill() + str(rng.choice(TELLING[name][1 - i % 2])) + ". " + fill(), i % 2) for i in range(600)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]

    def accuracy(grammar):
        model = toxicity.train(docs, labels, grammar=grammar)
        got = model.scores([r[1] for r in held], toxicity.Scorer(model.lexicon, grammar))
        return np.mean([(p >= 0.5) == bool(r[2]) for p, r in zip(got, held, strict=True)])

    parts = {n: getattr(toxicity, n) for n in ("INSULTS", "THREATS", "TARGETS", "NEGATIONS", "REPORTS")}
    without = [t for n, t in parts.items() if n != name]
    whole, less = accuracy(toxicity.GRAMMAR), accuracy(toxicity.compose(*without))
    assert whole > 0.95 and less < 0.8
    if name == "THREATS":
        assert toxicity.Scorer(toxicity.SEEDS, toxicity.compose(*without)).clauses("will kill you")[0] == []


def test_toxicity_bound_holds_after_the_join(spark):
    """One labelled id on many rows counts once."""
    docs = spark.createDataFrame([(1, f"you idiot {i}") for i in range(3000)] + [(2, "a fine day"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    seen = []
    plain = toxicity.stage
    toxicity.stage = lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1]
    try:
        toxicity.train(docs, labels, max_rows=50)
    finally:
        toxicity.stage = plain
    assert dict(seen)["toxic-rows"].count() <= 3


def test_toxicity_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(edge, toxicity.train(edge, none)).collect()
    assert len(got) == edge.count() and all(0 < r["score"] < 0.5 for r in got)
    by_text = defaultdict(set)
    for r, t in ((r, t) for r in got for d, t in pairs(edge) if d == r["doc_id"] and d is not None):
        by_text[t].add(r["score"])
    assert all(len(x) == 1 for x in by_text.values())  # equal texts, equal scores
    assert toxicity.score(edge.where("false"), toxicity.train(edge.where("false"), none)).count() == 0


# all
def test_empty_tables(spark, empty):
    assert quality.judge(empty, empty.columns, prefix="q_").count() == sharding.shard(empty).count() == packing.pack(empty).count() == 0
    assert secrets.find_secrets(empty).count() == secrets.mask_secrets(empty).count() == substrings.remove_repeats(empty).count() == 0
    assert mixing.mix(empty, ["doc_id"]).count() == simhash.near_duplicates(empty).count() == 0
    assert tokenfile.read_documents(tokenfile.write_tokens(empty, new_folder(spark, "t"))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    a, b = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    rows = lambda cols, x: sorted(tuple(str(r[cols.index(c)]) for c in names) for r in x)  # noqa: E731  pandas would make floats of whole numbers with nulls
    assert rows(a.columns, a.collect()) == rows(b.columns, b.fetchall())


CONTRACT = {
    "op1_host_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_substrings": "doc_id n_words n_removed kept_sha256",
    "op7_simhash": "doc_id fingerprint component_id",
    "op9_token_files": "doc_id start n_tokens ids_crc32",
    "op10_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, name):
    out = queries.queries()[name](spark, SF)
    want = CONTRACT[name].split()
    assert out.columns[: len(want)] == want
    if name != "op3_packing":
        assert out.count() == 200
    r = out.first()
    if name == "op5_substrings":
        assert len(r["kept_sha256"]) == 64
    if name == "op7_simhash":
        assert len(r["fingerprint"]) == 16
    if name == "op4_secrets":
        for r in out.collect():
            base = ",".join(x for x in r["spans"].split(",") if x and not x.startswith("owned"))
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_replicas_of_an_anchor_share_rows():
    import numpy as np

    from bitlab.llm import simhash

    keys = np.array([7, 5] * 100, np.uint64)
    got = simhash._pieces(keys, np.arange(200), np.arange(400).reshape(200, 2)).to_pydict()
    assert got["anchor"] == [5, 5, 7, 7] and [len(r) for r in got["rows"]] == [128, 72, 128, 72]
    assert sum(got["rows"][2:], []) == [x for i in range(0, 200, 2) for x in (2 * i, 2 * i + 1)]
