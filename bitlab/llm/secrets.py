"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for candidate values. Candidates' hashes are counted over the corpus by
distinct repositories and by distinct owners: a value that several owners have is a copied example,
one that looks live and belongs to a single owner is a credential of that owner.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitlab.llm.common import join_hot, one_per_row, spare, stage

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Free-standing values that only their ownership can tell: kept as spans of kind "owned" if live.
FREE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_HEX_RUN = bytes(49 if chr(i) in "0123456789abcdef" else 48 for i in range(256))
_FREE_RUN = bytes(49 if re.match(r"[A-Za-z0-9+/_-]", chr(i)) and i < 128 else 48 for i in range(256))
#: Words of documentation, not of live values.
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your|xxxx|test|0123456789|abcdef", re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str, min_entropy: float = 3.0) -> bool:
    """Letters and digits, of enough entropy, without the words of placeholders."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= min_entropy and not PLACEHOLDER.search(value)


def live(kind: int, value: str) -> bool:
    """Whether a candidate looks live; what is named a secret needs no digits."""
    return kind == 3 or (entropy(value) >= 2.5 and not PLACEHOLDER.search(value) if kind < 2 else looks_live(value))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the leftmost non-overlapping matches of each kind that are long enough, by start."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"1" * 16 in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def free_values(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Live-looking free-standing values that no base span touches."""
    if b"1" * 20 not in text.encode("utf-8", "surrogatepass").translate(_FREE_RUN):
        return []
    hit = lambda a, b: any(s < b and a < e for s, _, e, _ in base)
    return [(m.start(), 3, m.end(), m[0]) for m in FREE.finditer(text) if looks_live(m[0], 3.5) and not hit(m.start(), m.end())]


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One staged row per row of ``docs``: row, doc_id, repo, owner, th (a hash of the text) and its candidates.

    A candidate has start, kind, end (code points, end exclusive), its value's SHA-256 and whether
    it looks live. Values themselves are not stored.
    """
    cand = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string()), ("live", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part, out = b.slice(i, SLICE), []
                for text in part.column(1).to_pylist():
                    base = base_spans(text) if text else []
                    found = sorted(base + free_values(text, base)) if text else []
                    out.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "live": live(k, v)} for s, k, e, v in found])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(out, cand)], names=["doc_id", "repo", "owner", "th", "found"])

    src = one_per_row(docs, list(dict.fromkeys([id_col, text_col, repo_col, owner_col])))
    src = src.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    found = src.mapInArrow(run, "doc_id long, repo string, owner string, th long, found array<struct<start:long,kind:int,end:long,hash:string,live:boolean>>")
    return stage(found.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame, example_owners: int = 3, copies: int = 5) -> DataFrame:
    """Per candidate hash: n, n_repos, n_owners and its class.

    "example": at least ``example_owners`` distinct owners have it, or it does not look live, or
    two or more owners have it in ``copies`` or more repositories for each of them: widely copied. "owned": it looks live
    and one owner has it, in however many repositories. "shared": the rest. Distinct pairs are formed
    before counting, so a value in a third of all documents is pre-aggregated everywhere.
    """
    each = scanned.select("repo", "owner", F.explode("found").alias("c")).select("repo", "owner", "c.hash", "c.live")
    repos = each.groupBy("hash", "repo").agg(F.max("live").alias("live"), F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"), F.max("live").alias("live"), F.sum("n").alias("n"))
    owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= copies * F.col("n_owners")))
    kind = F.when(copied | ~F.col("live"), "example").when(F.col("n_owners") == 1, "owned").otherwise("shared")
    return repos.join(owners, "hash").select("hash", "n", "n_repos", "n_owners", kind.alias("class"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = 3) -> DataFrame:
    """One row per row of ``docs``: row, doc_id and ``spans``, an array of (start, kind, end, class) by start.

    All base spans stay, whatever their class; spans of kind "owned" are those free-standing values
    that live-look and belong to one owner. A null text is empty; null repositories or owners count
    as one; repeated rows come out once each; an empty table has no rows. Other columns of ``docs``,
    whatever their names, are not read.
    """
    scanned = scan(docs, id_col, text_col, repo_col, owner_col)
    classes = stage(ownership(scanned, example_owners), "ownership")
    each = scanned.select("row", F.explode("found").alias("c")).select("row", "c.start", "c.kind", "c.end", "c.hash")
    of_hash = classes.select("hash", "n", "class")
    known = join_hot(each, of_hash, ["hash"], "n", classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).where("kind < 3 OR class = 'owned'")
    spans = known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "class"))).alias("spans"))
    out = scanned.select(F.col("row").alias("row_"), "doc_id").join(spans, F.col("row_") == F.col("row"), "left")
    return out.select(F.col("row_").alias("row"), "doc_id", F.coalesce("spans", F.array().cast("array<struct<start:long,kind:int,end:long,class:string>>")).alias("spans"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a document is a repository and its source the owner."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    classes = F.array_join(F.transform("spans", lambda s: s["class"]), ",").alias("classes")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count(3), classes)


#: Rows whose texts are Python strings at a time.
SLICE = 256
#: So many hashes of values with several owners, at most, go to every executor; beyond, texts are joined with theirs.
MAX_SPARED = 200_000


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", mask: str = "[SECRET]", example_owners: int = 3, max_spared: int = MAX_SPARED) -> DataFrame:
    """``docs`` with every span that is no example replaced by ``mask``; other rows stay as they are.

    Values of one owner are told by their looks alone. Those of several owners, and the few that
    look live under one kind only, have their class by hash: up to ``max_spared`` of them are sent
    to the executors, else each document is joined with those of its own. Both ways decide by the
    same rule and mask the same. Rows keep their columns and the order of columns, whatever their
    names; null texts stay null.
    """
    scanned = scan(docs, id_col, text_col, repo_col, owner_col)
    classes = stage(ownership(scanned, example_owners), "ownership")
    c_doc, c_th, c_known = spare(docs, "__doc", "__th", "__known")
    each = scanned.where(F.size("found") > 0).select(F.col("doc_id").alias(c_doc), F.col("th").alias(c_th), F.explode("found").alias("c"))
    doubtful = each.groupBy(F.col("c.hash").alias("hash")).agg((F.min("c.live") != F.max("c.live")).alias("both"))
    special = stage(classes.join(doubtful, "hash").where("both OR n_owners > 1").select("hash", "class"), "spared")
    i = docs.columns.index(text_col)

    def apply(text: str, bad: Callable[[int, str], bool]) -> str:
        base = base_spans(text)
        out, at = [], 0
        for s, k, e, v in sorted(base + free_values(text, base)):
            if bad(k, v):
                if s >= at:
                    out += [text[at:s], mask]
                at = max(at, e)
        return "".join(out) + text[at:]

    def bad_by(known: dict[str, str]) -> Callable[[int, str], bool]:
        def bad(k: int, v: str) -> bool:
            kind = known.get(hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()) or ("owned" if live(k, v) else "example")
            return kind == "owned" or kind == "shared" and k < 3

        return bad

    def replaced(b: pa.RecordBatch, new: list[str | None]) -> pa.RecordBatch:
        cols = [*b.columns[: len(docs_names)]]
        cols[i] = pa.array(new, cols[i].type)
        return pa.RecordBatch.from_arrays(cols, names=docs_names)

    docs_names, schema = docs.columns, docs.schema
    if special.count() <= max_spared:
        known = docs.sparkSession.sparkContext.broadcast({r["hash"]: r["class"] for r in special.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bad = bad_by(known.value)
            for b in batches:
                for k in range(0, b.num_rows, SLICE):
                    part = b.slice(k, SLICE)
                    yield replaced(part, [t and apply(t, bad) for t in part.column(i).to_pylist()])

        return docs.mapInArrow(run, schema)
    own = each.join(special, F.col("c.hash") == F.col("hash")).groupBy(c_doc, c_th)
    per_doc = stage(own.agg(F.collect_set(F.struct("hash", "class")).alias(c_known)), "spared-by-doc")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                known = part.column(b.num_columns - 1).to_pylist()
                yield replaced(part, [t and apply(t, bad_by({h["hash"]: h["class"] for h in own or []})) for t, own in zip(part.column(i).to_pylist(), known, strict=True)])

    same = docs[id_col].cast("long").eqNullSafe(F.col(c_doc)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(c_th))
    joined = docs.join(per_doc, same, "left").drop(c_doc, c_th)
    return joined.mapInArrow(run_joined, schema)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking or not widely copied secrets masked; n_chars follows the text."""
    out = mask_secrets(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)
