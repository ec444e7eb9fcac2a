"""Spelling variants, the conversation trie and shared lines against brute force, and at the edge."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import PASSAGE
from pyspark.sql import functions as F

from bitlab.llm import conversations, lines, variants

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 spelling variants
def brute_words(rows, min_count=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= min_count}


def near(a, b):
    """Exactly one code point inserted, left out or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n, factor=5):
    out = {}
    for w in n:
        close = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = (n[w], len(close), best if best and n[best] >= factor * n[w] else None)
    rows = set()
    for w, (k, close, form) in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        rows.add((w, k, close, form, n[form] if form else None, root))
    return rows


def groups(spark, n, **kw):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    return Counter(map(tuple, variants.variant_groups(df, **kw).collect()))


@pytest.mark.parametrize("which", ["edge", "docs"])
def test_noisy_words(request, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = {r["word"]: r["n"] for r in variants.noisy_words(df, min_count=2).collect()}
    assert got == brute_words(rows, 2)


def test_variants_of_documents(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = Counter(map(tuple, variants.op11_spelling_variants(spark, SF).select("word", "n", "n_near", "form", "form_n", "root").collect()))
    assert got == Counter(brute_groups(brute_words(rows))) and len(got) > 500


@pytest.mark.parametrize("block_words", [1 << 15, 40, 3])
def test_variants_random(spark, block_words):
    rnd = random.Random(block_words)
    n = {"".join(rnd.choices("abÿ", k=rnd.randint(2, 9))): rnd.choice([1, 2, 5, 30, 1000]) for _ in range(500)}
    n |= {"é" * k: 10**k for k in range(2, 9)} | {"x" * 5000: 7, "x" * 4999: 70, "x" * 4999 + "y": 70}
    assert groups(spark, n, block_words=block_words) == Counter(brute_groups(n))


def test_variants_hot_half(spark):
    # most words share one half, so its index is split and every query goes to all parts
    n = {f"common{a}{b}": 1 + (a == b) * 9 for a in "abcdefghijklm" for b in "abcdefghijklm"} | {"common": 100, "rest": 1}
    assert groups(spark, n, block_words=16) == Counter(brute_groups(n))


def test_variants_chain_and_ties(spark):
    n = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "zzzzzz": 2, "zzzzzx": 10, "zzzzzy": 10, "solo": 3}
    rows = {r[0]: r for r in groups(spark, n)}
    assert rows["aaaaaa"][3:] == ("aaaaab", 5, "aabbbb") and rows["zzzzzz"][3:] == ("zzzzzx", 10, "zzzzzx") and rows["solo"][2:] == (0, None, None, "solo")


def test_variants_index_alone():
    # both schemes of one pair of words, letter by letter
    index = variants.Index(["abcdef", "abcxef", "abcde", "abcdeff", "zzz"])
    q, w = index.one_error(["abcdef", "abcdefg", "zz", "abQdef"], __import__("numpy").array([3, 3, 1, 3]))
    assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (1, 3)]


def test_variants_edges(spark, edge, empty):
    assert variants.variant_groups(variants.noisy_words(empty)).count() == 0
    words = {r["word"] for r in variants.noisy_words(edge, min_count=1).collect()}
    assert "öl" not in words and "Ärger".replace("Ä", "ä") not in words and "x" * 5000 in words  # Ä stays as it is, and is too short
    with pytest.raises(ValueError, match="factor"):
        variants.variant_groups(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)


# 12 conversation trie
def brute_rebuilt(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(donor, [])[:h] + own[c][h:]
    return out


def brute_trie(rebuilt):
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = Counter()
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k))))
        out[(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in below), len(leaves), saved, sha(ends))] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(df):
    donor, head = F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return Counter(map(tuple, conversations.prefix_trie(*conversations.spliced(conversations.ordered_turns(df), donor, head)).select(*COLUMNS).collect()))


def test_trie_of_conversations(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    got = conversations.op12_conversation_trie(spark, SF)
    assert dict(got.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == brute_trie(brute_rebuilt(rows))


@pytest.mark.parametrize(("seed", "chunk", "piece"), [(1, 1024, 256), (2, 2, 2), (3, 3, 1)])
def test_trie_random(spark, monkeypatch, seed, chunk, piece):
    # few different turns, so that many prefixes, whole copies and proper prefixes arise; nulls, ties, missing donors, negative ids
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    monkeypatch.setattr(conversations, "PIECE", piece)
    rnd = random.Random(seed)
    rows = []
    for c in [x for x in range(-12, 60) if x % 7] + [5_000_000_000]:
        for t in range(rnd.choice([1, 2, 3, 9, 12])):
            rows.append((c, None if rnd.random() < 0.1 else t // rnd.choice([1, 1, 2]), rnd.choice(["user", "user", None]), rnd.choice(["a", "a", "a", "ü", "", None])))
    rows += [(None, 1, "user", "lost"), rows[3], rows[4]]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, depth string, p int").repartition(7)
    assert trie(df) == brute_trie(brute_rebuilt(rows))


def test_trie_copies_prefixes_and_long(spark):
    # a third of all are copies of one conversation; one is long enough for several chunks of running sums
    rows = [(5 * i, t, "user", f"t{t}") for i in range(40) for t in range(3)] + [(1000 + 5 * i, 0, "user", "t0") for i in range(9)]
    rows += [(7000, t, "user", f"t{t % 3}") for t in range(2500)] + [(7005, t, "user", f"t{t % 3}") for t in range(2501)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r[0], r[1]): r for r in trie(df)}
    assert len(got) == 2502 and got[0, 0][3:6] == (51, 1, 1) and got[0, 3][3] == 42 and got[0, 3][7] == sha(",".join(str(5 * i) for i in range(40)))
    assert got[7000, 2500][2:6] == (7000, 2, 1, 1) and got[7005, 2501][2:6] == (7000, 1, 0, 1)
    assert got[0, 0][6] == 2 * (50 + 41 + 41) + 2 * 2497


def test_trie_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie(empty) == Counter()
    lonely = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)  # its one turn goes, its donor is not there
    df = spark.createDataFrame([(lonely, 0, "user", "hello")], empty.schema)
    assert trie(df) == Counter([(lonely, 0, None, 1, 0, 1, 0, sha(str(lonely)))])


# 13 line dedup
def brute_lines(rows, min_docs=2):
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(WHITE))
    order = lambda d: lines.NO_ID if d is None else d
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(order(doc))
    out = Counter()
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(holders[key(x)]) < min_docs or min(holders[key(x)]) == order(doc)]
        out[doc, len(all_), len(all_) - len(kept), sha("\n".join(kept))] += 1
    return out


@pytest.mark.parametrize(("which", "min_docs"), [("edge", 2), ("docs", 2), ("docs", 4)])
def test_lines(request, which, min_docs):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["kept"])) for r in lines.drop_lines(df, min_docs=min_docs).collect())
    assert got == brute_lines(rows, min_docs)


def test_lines_cases(spark, empty):
    line = "A line of ten characters and more"
    rows = [(3, f"{line}\nown\n {line.upper()}\x0b"), (1, f"x\n\t{line.lower()}\r\n{line}"), (2, f"{line}\n{line}"), (2, "the other row of two\n" + line), (None, line), (None, f"{line}\n{PASSAGE}"), (None, PASSAGE),
            (4, ""), (5, None), (6, "\n\n"), (7, "short one\nshort one"), (8, "short one"), (9, "ÄÖÜ ÄÖÜ ÄÖÜ"), (10, "äöü äöü äöü"), (11, "\n".join([line] * 5000 + ["last"]))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, th string, drops string")
    got = lines.drop_lines(df).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["kept"])) for r in got) == brute_lines(rows)
    kept = {(r["doc_id"], r["n_lines"]): (r["n_dropped"], r["kept"]) for r in got}
    assert kept[3, 3] == (2, "own") and kept[1, 3][0] == 0 and kept[2, 2][0] in (1, 2) and kept[11, 5001] == (5000, "last") and kept[6, 3] == (0, "\n\n") and kept[9, 1][0] == 0
    assert lines.drop_lines(empty).count() == 0


def test_lines_stay_in_the_jvm(spark):
    plan = lines.op13_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
