"""The pipeline's stages against brute force on a whole small table, and on the cases at the edge."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
from test_llm import ASSIGN, brute_quality, brute_similar, groups_of, own_tokenizer, pairs

import corpus_pipeline
from bitlab.llm import mixing, packing, secrets

SF = "/root/testdata/sf0.001"


def brute_stages(rows):
    """The texts that the first three stages leave, by id: rules on each document, exact similarities, owners of values."""
    kept = [(d, t, s) for d, t, s in rows for b in [brute_quality(t)] if not (b[0] < 20 or 100 * b[4] > 30 * b[0] or 100 * b[2] > 10 * b[0])]
    _, links = brute_similar([t for _, t, _ in kept])
    left = [kept[i] for i, r in enumerate(groups_of(len(kept), links)) if r == i]
    owners, spans = defaultdict(set), {}
    for d, t, s in left:
        base = secrets.base_spans(t)
        spans[d] = sorted(base + secrets.free_values(t, base))
        for _, _, _, v in spans[d]:
            owners[v].add(s)
    out = {}
    for d, t, _ in left:
        at, text = 0, ""
        for a, k, b, v in spans[d]:
            live = any(secrets.live(k2, v2) for x in spans.values() for _, k2, _, v2 in x if v2 == v)
            if len(owners[v]) < 3 and live and (k < 3 or len(owners[v]) == 1):
                text += t[at:a] + "[SECRET]" if a >= at else ""
                at = max(at, b)
        out[d] = text + t[at:]
    return out


def test_pipeline(spark, docs):
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    want = brute_stages(rows)
    t = own_tokenizer("byte_bpe_50k.json")
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for d, text in want.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == d)
        assert sum(n for _, n, _ in mine) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in mine)


def test_stages_at_the_edge(spark, edge):
    texts = Counter(pairs(edge))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, edge, SF)
        assert out.columns == edge.columns and out.dtypes == edge.dtypes
        left = Counter(pairs(out))
        if name == "mixing":
            assert left == texts
        if name in ("quality", "near_duplicates"):
            assert not left - texts
        if name == "secrets":
            assert sum(left.values()) == sum(texts.values())
            assert all("04dbebab" not in (t or "") for _, t in left)
        if name == "near_duplicates":
            ids = [d for d, _ in left if d is not None]
            assert max(left.values()) == 1 and 6 not in ids and 5 in ids
        assert f(spark, edge.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, edge.where("false"), SF).count() == 0


def test_packing_follows_the_mixture(spark, docs, tmp_path):
    """Read back from files that lie in no order; the largest come first."""
    corpus_pipeline.STAGES[3][1](spark, docs, SF).repartition(7, "n_chars").write.parquet(str(tmp_path / "mixed"))
    slot = {r["doc_id"]: r["slot"] for r in mixing.mix(docs, ["doc_id"]).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.packing_stage(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = defaultdict(list)
    for r in got:
        parts[r["sequence_id"] >> 34].append(slot[r["doc_id"]])
    assert {r["doc_id"] for r in got} == set(slot) and len(parts) > 1
    order = [parts[p] for p in sorted(parts)]
    assert all(max(a) <= min(b) for a, b in pairwise(order))


def test_packing_in_order_numbers_windows_as_they_come(spark):
    rows = [(i, "w " * (1 + i * 37 % 400)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    got = packing.pack(df, window=256, open_windows=4, in_order=True, keep_ids=True).collect()
    first = {}
    for r in got:
        first[r["sequence_id"]] = min(first.get(r["sequence_id"], r["doc_id"]), r["doc_id"])
    body = [first[s] for s in sorted(first)[:-4]]  # the last ones are of windows still open at the end
    assert len(body) > 500 and body == sorted(body)
    for d in range(900):
        mine = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == d)
        assert all(a + n == b for (a, n), (b, _) in pairwise(mine)) and mine[0][0] == 0
        assert sum(n for _, n in mine) == next(r["doc_tokens"] for r in got if r["doc_id"] == d)
