"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into bands, over which a pair within ``max_bits`` spreads its
differing bits; one band then holds at most ``max_bits // bands`` of them. On each band a covering
code (a sum of perfect codes and free bits) gives the anchors: every band value lies within the
code's covering radius of its own anchor. Each fingerprint is replicated to the anchors within
radius plus threshold that can be a near value's own anchor; fingerprints that meet at an anchor
are compared on all 64 bits. No pair is missed, whatever the code.

``similar_groups`` goes on from there for shingle similarity: bands of more fingerprints, whose number
follows the corpus (``band_plan``), propose links, and exact similarities decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitlab.llm.common import join_hot, spare, stage
from bitlab.llm.components import components

#: Band layouts: the bands' widths and their code: a perfect Hamming code of 15 bits ("h") or the
#: perfect Golay code of 23 bits ("g"), with the rest as free bits.
LAYOUTS = {"small": ((21, 21, 22), "h"), "medium": ((32, 32), "g")}
#: Rows of two longs that are broadcast at most.
BROADCAST = 1 << 21
#: Stands for a null id, which is never the smallest.
NO_ID = (1 << 63) - 1
#: Generator polynomial of the binary Golay code (23, 12).
GOLAY = 0b110001110101
BLOCK = 8192
#: Fingerprints whose replicas are put together by anchor before they are shuffled, and replicas in one row: a replica then takes half the disk of a row of its own.
AT_ONCE, PIECE = 1 << 16, 64
#: Texts (of up to a thousand shingles; longer ones count more often) that one task compares at once.
TEXTS = 1024
#: Fingerprints of a text that is compared exactly; pairs beyond their bits are not looked at.
SKETCH = 8


def layout_for(n_fingerprints: int) -> str:
    """The layout whose number of anchors suits so many distinct fingerprints; both find the same links."""
    return "small" if n_fingerprints <= 1 << 21 else "medium"


def differing(similarity: float) -> float:
    """The share of fingerprint bits in which texts of that cosine similarity differ, on average."""
    return acos(similarity) / pi


def band_plan(n: int, similarity: float, recall: float = 0.98, met: int = 2048) -> tuple[int, int]:
    """(width, bands): so wide that a fingerprint meets about ``met`` unrelated others of ``n`` in a band, and
    so many bands that a pair of that similarity meets in one with probability ``recall``.

    A pair meets where at most two bits of a band differ: both sides go to all values one bit away.
    """
    width = next(w for w in range(13, 39) if w == 38 or n * (1 + w + comb(w, 2)) / 2**w <= met)
    q = differing(similarity)
    hit = sum(comb(width, d) * q**d * (1 - q) ** (width - d) for d in range(3))
    return width, ceil(log(1 - recall) / log(1 - hit))


def _remainder(v: int, poly: int, n: int) -> int:
    top = poly.bit_length() - 1
    for i in range(n - 1, top - 1, -1):
        if v >> i & 1:
            v ^= poly << (i - top)
    return v


@cache
def _golay_own() -> np.ndarray:
    """For each 23-bit value's syndrome (11 bits) the error pattern that leads to its codeword."""
    leader = np.zeros(2048, np.uint64)
    for w in range(4):
        for at in combinations(range(23), w):
            e = sum(1 << i for i in at)
            leader[_remainder(e, GOLAY, 23)] = e
    return leader


def _syndrome(v: np.ndarray, columns: list[int]) -> np.ndarray:
    s = np.zeros(v.shape, np.uint64)
    for i, c in enumerate(columns):
        s ^= (v >> np.uint64(i) & np.uint64(1)) * np.uint64(c)
    return s


def anchor_of(band: np.ndarray, code: str) -> np.ndarray:
    """The own anchor (nearest codeword; free bits as they are) of each band value."""
    if code == "h":
        s = _syndrome(band, list(range(1, 16)))
        return np.where(s > 0, band ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))), band)
    if code == "g":  # of the low 23 bits
        low = band & np.uint64((1 << 23) - 1)
        return band ^ _golay_own()[_syndrome(low, [_remainder(1 << i, GOLAY, 23) for i in range(23)]).astype(np.int64)]
    return band


def _replicate(fps: np.ndarray, layout: str, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, index of the fingerprint) for every anchor that a fingerprint goes to."""
    widths, code = LAYOUTS[layout]
    near = max_bits // len(widths)
    keys, who = [], []
    for b, width in enumerate(widths):
        band = fps >> np.uint64(sum(widths[:b])) & np.uint64((1 << width) - 1)
        flips = [sum(1 << i for i in at) for w in range(near + 1) for at in combinations(range(width), w)]
        out = np.stack([anchor_of(band ^ np.uint64(e), code) for e in flips], axis=1)
        out.sort(axis=1)
        first = np.ones(out.shape, bool)
        first[:, 1:] = out[:, 1:] != out[:, :-1]
        i, j = np.nonzero(first)
        keys.append(out[i, j] | np.uint64(b) << np.uint64(36))
        who.append(i)
    return np.concatenate(keys), np.concatenate(who)


def _flipped(words: np.ndarray, width: int, bands: range) -> tuple[np.ndarray, np.ndarray]:
    """(band and value, index of the row) for each of the bands' values and those one bit away; bands lie in ``words`` one after the other."""
    per = 64 // width
    flips = np.array([0, *(1 << i for i in range(width))], np.uint64)
    keys = [(words[:, b // per, None] >> np.uint64(b % per * width) & np.uint64((1 << width) - 1)) ^ flips | np.uint64(b) << np.uint64(38) for b in bands]
    return np.concatenate([k.ravel() for k in keys]), np.tile(np.repeat(np.arange(len(words)), width + 1), len(bands))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _majority(h: np.ndarray) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the lower-cased text, repeats included; fewer words make one shingle, none make none."""
    ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(ws) <= shingle:
        starts, ends = starts[:1], ends[-1:]
    n, digest = max(1, len(ws) - shingle + 1), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], np.uint64)


def text_fingerprints(texts: list[str | None], shingle: int, words: int = 1) -> np.ndarray:
    """A row per text of ``words`` 64-bit SimHashes: majority bits of its shingles' hashes, then of these hashes mixed anew; zero without words."""
    out = np.zeros((len(texts), words), np.uint64)
    for k, text in enumerate(texts):
        h = _shingle_hashes(text, shingle)
        for j in range(words if len(h) else 0):
            if j:
                h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            out[k, j] = _majority(h)
    return out


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): th tells apart the texts of one id."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, th, fp, chk, more) for every row: SimHashes of each whole text as signed longs, the first, the second (zero for one word) and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = text_fingerprints(part.column(2).to_pylist(), shingle, max(2, words) if words > 1 else 1).view(np.int64)
                chk = got[:, 1].copy() if words > 1 else np.zeros(len(got), np.int64)
                more = pa.array(got[:, 2:].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got[:, 0].copy()), pa.array(chk), more], names=["doc_id", "th", "fp", "chk", "more"])

    return _sources(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, fp long, chk long, more array<long>")


def node_of(fp: Column, chk: Column) -> Column:
    """A long that stands for both fingerprints: fp, with chk turned by one bit laid over it. Equal nodes are equal or near."""
    return fp.bitwiseXOR(F.call_function("shiftleft", chk, F.lit(1))).bitwiseXOR(F.call_function("shiftrightunsigned", chk, F.lit(63)))


def _close(fp: np.ndarray, chk: np.ndarray, a: slice, b: slice, max_bits: int, max_total: int) -> np.ndarray:
    bits = np.bitwise_count(fp[a, None] ^ fp[None, b])
    near = bits <= max_bits
    if max_total < 64 + max_bits:
        i, j = np.nonzero(near)
        near[i, j] = bits[i, j] + np.bitwise_count(chk[a][i] ^ chk[b][j]) <= max_total
    return near


def spanning_links(fp: np.ndarray, chk: np.ndarray, max_bits: int, max_total: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links within a run, compared in blocks; at most one less than its rows.

    Rows of equal ``known`` are connected already.
    """
    label, out = np.arange(len(fp)) if known is None else np.unique(known, return_inverse=True)[1], []
    if label.max() == 0:
        return out
    for i in range(0, len(fp), 256):
        rows = slice(i, i + 256)
        near = _close(fp, chk, rows, slice(i, None), max_bits, max_total)
        while (cross := near & (label[rows, None] != label[None, i:])).any():
            first = cross.argmax(axis=1)
            for x in np.flatnonzero(cross.any(axis=1)):
                a, b = label[i + x], label[i + first[x]]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
                    out.append((int(i + x), int(i + first[x])))
    return out


def links_in_runs(key: np.ndarray, fp: np.ndarray, chk: np.ndarray, max_bits: int, max_total: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (nodes, see ``node_of``) between rows of equal keys in sorted arrays.

    In runs of up to 64 rows closest pairs come first, so runs that share rows tend to give the same links.
    Rows of equal ``known`` are connected already and not linked again.
    """
    node = (fp ^ (chk << np.uint64(1) | chk >> np.uint64(63))).view(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([starts, [len(key)]]))
    short = np.flatnonzero(np.repeat(lengths, lengths) <= 64)
    k, f, c, who = key[short], fp[short], chk[short], node[short]
    group = None if known is None else known[short]
    close = [np.zeros((3, 0), np.int64)]
    for lag in range(1, min(len(k), int(lengths[lengths <= 64].max(initial=1)))):
        bits = np.bitwise_count(f[lag:] ^ f[:-lag])
        met = (k[lag:] == k[:-lag]) & (bits <= max_bits)
        hit = np.flatnonzero(met if group is None else met & (group[lag:] != group[:-lag]))
        total = bits[hit].astype(np.int64) + np.bitwise_count(c[lag:][hit] ^ c[:-lag][hit])
        near = total <= max_total
        close.append(np.stack([total[near], hit[near], hit[near] + lag]))
    pairs = np.concatenate(close, axis=1)
    pairs = pairs[:, np.lexsort((who[pairs[2]], who[pairs[1]], pairs[0]))]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    tree = []
    for x, y in pairs[1:].T.tolist():
        u, v = (find(x), find(y)) if group is None else (find(int(group[x])), find(int(group[y])))
        if u != v:
            root[v] = u
            tree.append((x, y))
    tree = np.array(tree, np.int64).reshape(-1, 2)
    a, b = [who[tree[:, 0]]], [who[tree[:, 1]]]
    for s, n in zip(starts[lengths > 64], lengths[lengths > 64], strict=True):
        if found := spanning_links(fp[s : s + n], chk[s : s + n], max_bits, max_total, None if known is None else known[s : s + n]):
            x = np.array(found)
            a.append(node[s + x[:, 0]])
            b.append(node[s + x[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def _gathered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, ``n`` at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            part = b.slice(0, n - sum(x.num_rows for x in held))
            held, b = [*held, part], b.slice(part.num_rows)
            if sum(x.num_rows for x in held) == n:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _nodes(fp: np.ndarray, chk: np.ndarray) -> np.ndarray:
    """``node_of`` signed words."""
    f, c = fp.view(np.uint64), chk.view(np.uint64)
    return (f ^ (c << np.uint64(1) | c >> np.uint64(63))).view(np.int64)


def _pieces(keys: np.ndarray, who: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """(anchor, rows): the ``rows`` of numbers ``who`` by their keys, end to end, up to ``PIECE`` of them in one list."""
    order = np.argsort(keys, kind="stable")
    key = keys[order].view(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    nth = np.arange(len(key)) - np.repeat(starts, np.diff([*starts, len(key)]))
    cut = np.flatnonzero(nth % PIECE == 0)
    ends = pa.array(np.append(cut, len(key)) * rows.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.ListArray.from_arrays(ends, pa.array(rows[who[order]].reshape(-1)))], names=["anchor", "rows"])


def links(distinct: DataFrame, max_bits: int = 4, max_total: int = 128, layout: str | None = None, bands: tuple[int, range] | None = None) -> DataFrame:
    """(a, b) links between the nodes (see ``node_of``) of ``distinct`` (fp, chk) that connect all close pairs.

    Close: at most ``max_bits`` bits of fp differ, and at most ``max_total`` of fp and chk together. Each
    anchor's fingerprints are compared in one sorted run; an anchor with over ``BLOCK`` of them is
    dealt out as pairs of blocks, each compared in its own place. Of long runs a spanning forest
    is returned, so links stay linear in the fingerprints while components stay exact.
    ``bands``: instead of a layout that meets every close pair, (width, which ones) of bands over all
    fingerprints of ``distinct`` (fp, chk, more); close pairs that meet in none of them are not linked.
    Fingerprints of equal ``known``, if ``distinct`` has that column, are connected already; they are not linked again.
    """
    told = ["known"] if "known" in distinct.columns else []
    layout = layout or (None if bands else layout_for(distinct.count()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, AT_ONCE if bands else 2048):
            fp, chk = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            also = [b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) ^ _nodes(fp, chk)] if told else []
            rows = np.stack([fp, chk, *also], axis=1)
            if bands:
                rest = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(fp), -1)
                words = np.column_stack([fp, chk, rest]).astype(np.int64).view(np.uint64)
                for band in bands[1]:
                    yield _pieces(*_flipped(words, bands[0], range(band, band + 1)), rows)
            else:
                yield _pieces(*_replicate(fp.view(np.uint64), layout, max_bits), rows)

    wide = 2 + len(told)
    placed = distinct.select("fp", "chk", *(["more"] if bands else []), *told).mapInArrow(spread, "anchor long, rows array<long>")  # cheaper told twice than written
    full = placed.groupBy("anchor").agg((F.sum(F.size("rows")) / wide).alias("count")).where(F.col("count") > BLOCK).select("anchor", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    dealt = placed.join(stage(full, "full-anchors"), "anchor", "left")
    # of n blocks, block i meets each block j, itself included, in the cell (min, max)
    own = lambda r: F.pmod(F.xxhash64(r[0], r[1]), F.col("blocks"))
    cell = lambda r, j: F.struct(F.xxhash64("anchor", F.least(own(r), j), F.greatest(own(r), j)).alias("key"), r.alias("rows"))
    single = F.transform(F.sequence(F.lit(0), (F.size("rows") / wide).cast("int") - 1), lambda i: F.slice("rows", i * wide + 1, F.lit(wide)))
    cells = F.flatten(F.transform(single, lambda r: F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: cell(r, j))))
    keys = F.when(F.col("blocks").isNull(), F.array(F.struct(F.col("anchor").alias("key"), "rows"))).otherwise(cells)
    runs = dealt.select(F.explode(keys).alias("x")).select("x.key", "x.rows").repartition("key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 + wide, 0), np.int64)

        def done(rows: np.ndarray) -> pa.RecordBatch:
            known = [rows[3] ^ _nodes(rows[1], rows[2])] if told else []
            x, y = links_in_runs(rows[0], rows[1].view(np.uint64), rows[2].view(np.uint64), max_bits, max_total, *known)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(p.copy()) for p in pairs], names=["a", "b"])

        for b in batches:
            key, n = b.column(0).to_numpy(zero_copy_only=False), np.diff(b.column(1).offsets.to_numpy()) // wide
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide).T
            rows = np.concatenate([held, np.vstack([np.repeat(key, n), values])], axis=1)
            last = np.flatnonzero(rows[0] != rows[0, -1])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
            if cut:
                yield done(np.ascontiguousarray(rows[:, :cut]))
            held = rows[:, cut:]
        if held.shape[1]:
            yield done(np.ascontiguousarray(held))

    return runs.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def _distinct(staged: DataFrame) -> DataFrame:
    """A row per (fp, chk): its smallest row's doc_id and th, the number of rows, node and more."""
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th"))
    rows = staged.groupBy("fp", "chk").agg(least.alias("least"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("more").alias("more"))
    return stage(rows.select("fp", "chk", "least", "first_id", "n", "more", node_of(F.col("fp"), F.col("chk")).alias("node")), "distinct-fp")


def _grouped(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``distinct`` with the component of its node, which is the node itself where it has no links."""
    named = components(edges).withColumnRenamed("node", "linked")
    return stage(distinct.join(named, F.col("node") == F.col("linked"), "left").select("fp", "chk", "least", "first_id", "n", "node", F.coalesce("component", "node").alias("component")), "grouped")


def _of_component(grouped: DataFrame, what: Column) -> DataFrame:
    """``grouped`` with the aggregate ``what`` over its component as column ``found``; large components are not sent to one task."""
    per = stage(grouped.groupBy("component").agg(what.alias("found"), F.count(F.lit(1)).alias("members")), "per-component")
    return join_hot(grouped, per, ["component"], "members", grouped.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, layout: str | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id that links of at most ``max_bits`` differing bits reach. Texts
    without words, and null texts, have fingerprint zero and link like any other. Rows of equal ids
    count as separate rows of one id; a null id is never the smallest unless all are null. An empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    staged = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = _distinct(staged)
    edges = stage(links(distinct, max_bits, layout=layout), "links")
    of_fp = _of_component(_grouped(distinct, edges), F.min("first_id")).select("fp", "chk", F.col("found").alias("component_id"), "n")
    return join_hot(staged.select("doc_id", "fp", "chk"), stage(of_fp, "of-fp"), ["fp", "chk"], "n", staged.count()).select("doc_id", "fp", "component_id")


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two texts' shingle counts, from their shingle hashes, repeats included; 0 without shingles."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float(n[i] @ m[j] / sqrt(float(n @ n) * float(m @ m))) if len(x) and len(y) else 0.0


def _reach(similarity: float, bits: int, deviations: float) -> int:
    """In so many bits texts of that similarity differ at most, but for what lies beyond so many standard deviations."""
    q = differing(similarity)
    return ceil(bits * q + deviations * sqrt(bits * q * (1 - q)))


def _exact_forest(sketches: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches are close and whose shingles are so similar; closest sketches first."""
    n, reach = len(sets), _reach(similarity, 64 * sketches.shape[1], 2.5)
    label, out, counts = np.arange(n), [], {}

    def counted(i: int) -> tuple[np.ndarray, np.ndarray, float]:
        if i not in counts:
            x, c = np.unique(sets[i], return_counts=True)
            counts[i] = x, c, sqrt(float(c @ c))
        return counts[i]

    below = -1
    for level in (reach // 3, 2 * reach // 3, reach):
        for k in range(0, n, 128):
            bits = np.zeros((min(128, n - k), n - k), np.int16)
            for w in range(sketches.shape[1]):
                bits += np.bitwise_count(sketches[k : k + 128, w, None] ^ sketches[None, k:, w])
            a, b = np.nonzero(np.triu((bits > below) & (bits <= level) & (label[k : k + 128, None] != label[None, k:]), 1))
            order = np.argsort(bits[a, b], kind="stable")
            for i, j in zip((a[order] + k).tolist(), (b[order] + k).tolist(), strict=True):
                if label[i] != label[j]:
                    (x, c, u), (y, d, v) = counted(i), counted(j)
                    _, e, f = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                    if float(c[e] @ d[f]) >= (similarity - 1e-9) * u * v:
                        out.append((i, j))
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
        below = level
    return out


def _exact_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of a spanning forest of the similar nodes among rows of equal ``key`` (key, node, sketch, shingles), which meet in one partition; a key has at most two blocks of texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sketches, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            found = _exact_forest(np.stack(sketches).view(np.uint64), sets, similarity) if len(nodes) > 1 else []
            x = np.array([(nodes[i], nodes[j]) for i, j in found], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["a", "b"])

        for b in batches:
            for k, node, sketch, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if k != key and key is not None:
                    yield done()
                    nodes, sketches, sets = [], [], []
                key = k
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sketches.append(sketch.values.to_numpy(zero_copy_only=False))
                    sets.append(h.values.to_numpy(zero_copy_only=False))
        if key is not None:
            yield done()

    return rows.sortWithinPartitions("key", "node").select("key", "node", "sketch", "shingles").mapInArrow(compare, "a long, b long")


def _verified(edges: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Those of the links (a, b) whose texts are so similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [cosine(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)) >= similarity - 1e-6 for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return edges.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _dealt(members: DataFrame) -> DataFrame:
    """(key, node) of the cells in which the ``members`` (component, node, known, weight) of each large component meet.

    ``known``: the group of which exact links are known already. Each group of at least ``TEXTS`` texts
    has blocks of its own, and the others share blocks; every block meets every other one of
    its component but those of its own group.
    """
    groups = members.groupBy("component", "known").agg(F.sum("weight").alias("n"))
    kind = F.when(F.col("n") >= TEXTS, F.col("known"))
    kinds = groups.select("component", kind.alias("kind"), "n").groupBy("component", "kind").agg(F.ceil(F.sum("n") / TEXTS).cast("int").alias("blocks"))
    before = Window.partitionBy("component").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)  # a row for each TEXTS texts at most
    kinds = stage(kinds.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int")), "kinds")
    at = stage(groups.select("component", "known", kind.alias("kind")), "kind-of")
    many = members.join(at, ["component", "known"]).select(F.col("component").alias("c"), "node", F.col("kind").alias("k"))
    own = many.join(kinds, (F.col("c") == F.col("component")) & F.col("k").eqNullSafe(F.col("kind"))).select("c", "node", "k", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("own"))
    others = kinds.select(F.col("component").alias("c"), F.col("kind").alias("k2"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("other"))
    met = own.join(others, "c").where(F.col("k").isNull() | ~F.col("k").eqNullSafe(F.col("k2")))
    return met.select(F.xxhash64("c", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node")


def _small(df: DataFrame) -> DataFrame:
    """A staged table of a few longs a row, broadcast if it has at most ``BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of texts of so similar shingles: a row per fingerprint with its group's smallest row, and the staged fingerprints.

    The similarity is what SimHash estimates, the cosine of shingle counts; a Jaccard similarity of 0.8 is a
    cosine of about 0.89, so all such pairs are meant too. Bits propose links, with two standard
    deviations to spare. All texts that proposed links connect are then compared: pairs whose 512 bits are close
    by their shingles, and only exact similarities join groups. Texts of equal 128 bits are one.
    """
    width, number = bands or band_plan(docs.count(), similarity)
    max_bits, max_total = _reach(similarity, 64, 2), _reach(similarity, 128, 2)
    staged = stage(fingerprints(docs, id_col, text_col, shingle, max(2, ceil(number / (64 // width)))), "fingerprints")
    distinct = _distinct(staged)
    # what the first band connects is not linked again at the anchors of the others
    proposed = stage(links(distinct, max_bits, max_total, bands=(width, range(1))), "links")
    if number > 1:
        first = stage(components(proposed).withColumnRenamed("node", "linked"), "first-band")
        told = distinct.join(_small(first), F.col("node") == F.col("linked"), "left").select("fp", "chk", "more", F.coalesce("component", "node").alias("known"))
        rest = links(stage(told, "told"), max_bits, max_total, bands=(width, range(1, number)))
        proposed = proposed.unionByName(stage(rest, "links"))
    linked = stage(components(proposed), "linked")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(2).to_pylist()
                sets = [np.sort(_shingle_hashes(t, shingle)).view(np.int64) for t in texts]
                sketches = text_fingerprints(texts, shingle, SKETCH).view(np.int64)
                cols = [part.column(0), part.column(1), pa.array(list(sketches), pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["component", "node", "sketch", "shingles"])

    texts = _sources(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th", "text")
    wanted = stage(linked.join(distinct.select("node", "least"), "node").select("component", "node", "least.id", F.col("least.th").alias("th")), "wanted")
    texts = texts.join(_small(wanted), ["id", "th"])
    if not staged.groupBy("doc_id", "th").count().where("count > 1").isEmpty():  # one of each repeated row
        texts = texts.groupBy("id", "th", "component", "node").agg(F.min("text").alias("text"))
    shingles = stage(texts.select("component", "node", "text").mapInArrow(shingled, "component long, node long, sketch array<long>, shingles array<long>"), "shingles")
    members = shingles.select("component", "node", (F.floor(F.size("shingles") / 1000) + 1).alias("weight"))
    sizes = stage(members.groupBy("component").agg(F.sum("weight").alias("size")), "sizes")
    large = stage(sizes.where(F.col("size") > TEXTS).select("component"), "large")  # a row for each TEXTS texts at most
    few = shingles.join(_small(large), "component", "left_anti").withColumnRenamed("component", "key").repartition("key")
    exact = [_exact_links(few, similarity)]
    if not large.isEmpty():
        # what the proposed links join for sure need not be compared pair by pair
        many = stage(shingles.join(_small(large), "component"), "many")
        sure = stage(_verified(proposed.join(many.select(F.col("node").alias("a")), "a"), many, similarity), "sure")
        known = components(sure).withColumnRenamed("component", "known")
        named = many.select("component", "node", (F.floor(F.size("shingles") / 1000) + 1).alias("weight")).join(known, "node", "left")
        dealt = _dealt(stage(named.select("component", "node", F.coalesce("known", "node").alias("known"), "weight"), "named"))
        exact += [sure, _exact_links(dealt.join(many.drop("component"), "node").repartition("key"), similarity)]
    found = exact[0]
    for x in exact[1:]:
        found = found.unionByName(x)
    grouped = _grouped(distinct, stage(found, "exact"))
    return _of_component(grouped, F.min("least")).select("fp", "chk", "n", F.col("found").alias("first")), staged


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    See ``similar_groups``: five-word shingles, similarity 0.8 or more. Rows of one id are told apart by
    their texts; of rows equal in both one stays, the first by a hash of all columns. Documents with a
    null id all stay, and so do those without words, whose fingerprint says nothing about them.
    """
    columns = docs.columns
    c_id, c_th, c_row, c_nth = spare(docs, "__id", "__th", "__row", "__nth")
    own, th = F.col("doc_id").cast("long"), F.xxhash64("text")
    same = (own == F.col(c_id)) & (th == F.col(c_th))
    told = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text")
    first, staged = similar_groups(told)
    rows = join_hot(staged.select("doc_id", "th", "fp", "chk"), stage(first, "first-rows"), ["fp", "chk"], "n", staged.count())
    gone = rows.where((F.col("doc_id") != F.col("first.id")) | (F.col("th") != F.col("first.th"))).select(F.col("doc_id").alias(c_id), F.col("th").alias(c_th)).distinct()
    kept = docs.join(_small(stage(gone, "duplicates")), same, "left_anti")
    # rows are told apart by (id, text) as a rule; only those that are not are dealt out
    again = staged.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias(c_id), F.col("th").alias(c_th))
    again = stage(again, "repeated")
    if again.isEmpty():
        return kept
    ones = kept.join(again, same, "left_semi").select(*columns, own.alias(c_id), th.alias(c_th), F.xxhash64(*columns).alias(c_row))
    nth = F.row_number().over(Window.partitionBy(c_id, c_th).orderBy(c_row))
    return kept.join(again, same, "left_anti").unionByName(ones.withColumn(c_nth, nth).where(F.col(c_nth) == 1).select(*columns))
