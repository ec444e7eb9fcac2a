"""What the operators share: word rules, staged tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09-\x0D, in ASCII only.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


#: The folders of the run that this thread is in; see ``staged_run``.
_RUN: ContextVar[list[str] | None] = ContextVar("_RUN", default=None)
#: A key of more than 1 / HOT of all rows is hot, so there are fewer than HOT of them.
HOT = 4096


@cache
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="bitlab-")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, local sessions (tests) take a temporary folder and clusters the warehouse, unless
    that is a machine-local folder: each executor would write to its own disk, so that is an error.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if spark.conf.get("spark.master", "local").split("[")[0] == "local":
        return _own_root()
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if root.startswith(("file:", "/")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: the warehouse {root} is local to each machine")
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_root(spark)}/bitlab/{name}-{uuid.uuid4().hex}"
    if (run := _RUN.get()) is not None:
        run.append(path)
    return path


@contextmanager
def staged_run() -> Iterator[Callable[..., None]]:
    """Within it, folders that this thread stages belong to this run alone.

    Yields remove(spark, keep): deletes the run's folders so far but those named ``keep``, and no one else's.
    Only for results that have been written elsewhere: DataFrames that read the folders no longer work.
    """
    folders: list[str] = []

    def remove(spark: SparkSession, keep: str | None = None) -> None:
        stays = [p for p in folders if keep is not None and p.rsplit("/", 1)[-1].rpartition("-")[0] == keep]
        gone = [p for p in folders if p not in stays]
        folders[:] = stays
        for p in gone:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    token = _RUN.set(folders)
    try:
        yield remove
    finally:
        _RUN.reset(token)


def join_hot(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of ``per_key`` for each key; keys of many rows are not sent to one task.

    ``n``: the column of ``per_key`` with the key's number of rows, which is dropped; ``total``: of all
    rows. Keys of more than total / HOT rows are fewer than HOT: they are broadcast. Both tables
    may be read twice, so they should be staged.
    """
    limit = max(256, total // HOT)
    hot = per_key.where(F.col(n) > limit).drop(n)
    if total <= limit or hot.isEmpty():
        return rows.join(per_key.drop(n), keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(per_key.where(F.col(n) <= limit).drop(n), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage: what follows survives lost executors without recomputing, sees one fixed
    version of every row, and the planner knows the real size (so broadcasts are of checked size).
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row, however often the body uses it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WHITE_CLASS}+"), "")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def spare_prefix(df: DataFrame, prefix: str) -> str:
    """A prefix like ``prefix`` that no column of ``df`` begins with, in any case."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def one_per_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only ``columns``; columns missing from ``df`` are an error that names them."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)
