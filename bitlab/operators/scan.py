"""Finite-state rewriting of sequences far longer than a row, by scans over chunks.

A machine reads symbols one by one, keeps one of a few states and writes symbols. What a chunk does
is a map from the state before it to the state after it; maps compose, so the state in which each chunk
begins comes from a prefix pass over maps, and then every chunk is rewritten on its own. Maps are
composed in two levels, ``FAN`` chunks to a group and then groups, so no task sees more than a group's maps
and one map for each group of its sequence. Several machines run as one cascade, each on the output of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitlab.operators.chunks import FAN, SIZE, carried

#: Rows that are rewritten side by side, symbol by symbol.
ROWS = 512


class Machine(NamedTuple):
    """moves: for each state, symbol -> (next state, output); ends: for each state, what it still owes at the end. State 0 begins."""

    moves: tuple[dict[str, tuple[int, str]], ...]
    ends: tuple[str, ...]


class Cascade:
    """Machines one after the other; a state of the cascade has one state of each."""

    def __init__(self, layers: list[Machine]):
        self.layers = layers
        self.alphabet = list(layers[0].moves[0])
        self.states = [(0,) * len(layers)]
        moves: list[list[int]] = []
        for state in self.states:  # grows by what is reached
            moves.append([])
            for symbol in self.alphabet:
                after = self.feed(state, symbol)[0]
                if after not in self.states:
                    self.states.append(after)
                moves[-1].append(self.states.index(after))
        if len(self.states) > 256:
            raise ValueError(f"{len(self.states)} states are too many for one cascade")
        self.next = np.array([[*m, i] for i, m in enumerate(moves)], np.uint8)  # the last column is for padding

    def feed(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
        """The state after a symbol, and what the last machine writes."""
        after, text = [], symbol
        for layer, s in zip(self.layers, state, strict=True):
            out = ""
            for c in text:
                s, o = layer.moves[s][c]
                out += o
            after.append(s)
            text = out
        return tuple(after), text

    def end(self, state: tuple[int, ...]) -> str:
        """What the last machine still writes at the end."""
        text = ""
        for layer, s in zip(self.layers, state, strict=True):
            out = ""
            for c in text:
                s, o = layer.moves[s][c]
                out += o
            text = out + layer.ends[s]
        return text


def _codes(texts: list[str], alphabet: list[str]) -> np.ndarray:
    """A row of symbol numbers for each text, padded with ``len(alphabet)``."""
    table = np.full(256, 255, np.uint8)
    table[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    flat = table[np.frombuffer("".join(texts).encode("latin-1"), np.uint8)]
    if (flat == 255).any():
        raise ValueError(f"symbols other than {''.join(alphabet)}")
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(length.max(initial=0))), len(alphabet), np.uint8)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out


def _effects(texts: list[str], cascade: Cascade) -> list[bytes]:
    """Each text's map: the state after it for every state before it."""
    state = np.tile(np.arange(len(cascade.states), dtype=np.uint8), (len(texts), 1))
    for codes in _codes(texts, cascade.alphabet).T:
        state = cascade.next[state, codes[:, None]]
    return [s.tobytes() for s in state]


def _rewritten(texts: list[str], machine: Machine, before: np.ndarray, last: np.ndarray) -> list[str]:
    """The outputs of texts read from given states; those that are ``last`` get what their end state owes."""
    alphabet = list(machine.moves[0])
    wide = max(1, *(len(o) for m in machine.moves for _, o in m.values()))
    after = np.array([[*(m[c][0] for c in alphabet), i] for i, m in enumerate(machine.moves)], np.int64)
    writes = np.zeros((len(machine.moves), len(alphabet) + 1, wide), np.uint8)
    for i, m in enumerate(machine.moves):
        for j, c in enumerate(alphabet):
            writes[i, j, : len(m[c][1])] = np.frombuffer(m[c][1].encode("latin-1"), np.uint8)
    codes, state = _codes(texts, alphabet), before
    out = np.zeros((len(texts), codes.shape[1] * wide), np.uint8)
    for p in range(codes.shape[1]):
        out[:, p * wide : (p + 1) * wide] = writes[state, codes[:, p]]
        state = after[state, codes[:, p]]
    ends, whole = np.cumsum((out > 0).sum(axis=1)), out[out > 0].tobytes().decode("latin-1")
    return [whole[a:b] + (machine.ends[s] if z else "") for a, b, s, z in zip([0, *ends[:-1]], ends, state, last, strict=True)]


def _schema(df: DataFrame, columns: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + [T.StructField(k, t) for k, t in more])


def _ends(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[tuple], list[bool]]]:
    """Slices of at most ``ROWS`` sorted rows with their keys, the first ``n`` columns, and whether a row is the last of its key."""
    held: pa.RecordBatch | None = None
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            rows = part if held is None else pa.concat_batches([held, part])
            keys = list(zip(*(c.to_pylist() for c in rows.columns[:n]), strict=True))
            held = rows.slice(rows.num_rows - 1)
            if rows.num_rows > 1:
                yield rows.slice(0, rows.num_rows - 1), keys[:-1], [x != y for x, y in zip(keys, keys[1:])]  # noqa: B905
    if held is not None:
        yield held, [tuple(c[0].as_py() for c in held.columns[:n])], [True]


def _entries(turned: DataFrame, keys: list[str], cascade: Cascade) -> DataFrame:
    """(*keys, group, entry, final): the state in which each group of chunks begins, and whether it is its sequence's last."""
    up = [*keys, "group"]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = start = bytes(range(len(cascade.states)))
        for rows, _, last in _ends(batches, len(up)):
            maps, done = _effects(rows.column("text").to_pylist(), cascade), []
            for m, z in zip(maps, last, strict=True):
                now = bytes(m[s] for s in now)
                if z:
                    done.append(now)
                    now = start
            out = rows.filter(pa.array(last))
            yield pa.RecordBatch.from_arrays([*(out.column(c) for c in up), pa.array(done, pa.binary())], names=[*up, "map"])

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for rows, _, last in _ends(batches, len(keys)):
            states = []
            for m, z in zip(rows.column("map").to_pylist(), last, strict=True):
                states.append(state)
                state = 0 if z else m[state]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in up), pa.array(states, pa.int32()), pa.array(last)], names=[*up, "entry", "final"])

    maps = turned.repartition(*up).sortWithinPartitions(*up, "at").mapInArrow(totals, _schema(turned, up, ("map", T.BinaryType())))
    return maps.repartition(*keys).sortWithinPartitions(*up).mapInArrow(begins, _schema(turned, up, ("entry", T.IntegerType()), ("final", T.BooleanType())))


def rewrite(texts: DataFrame, layers: list[Machine], keys: tuple[str, ...] = ("seq_id",), index: str = "chunk", value: str = "text", backwards: bool = False) -> DataFrame:
    """(*keys, index, value, lengths): every chunk's output of the machines ``layers``; all chunks' outputs in order are the sequence's.

    texts: (*keys, index, value) with rows of bounded length whose order is that of ``index``, from 0. ``lengths`` has the length of
    each layer's output of the chunk. ``backwards`` reads, and writes, from the end of the sequence. Nulls are not allowed; a
    chunk may be empty; symbols that the first machine does not know are an error. ``texts`` is read several times, so it should be
    a written table. Where no sequence has more than one group of chunks, groups need no pass of their own.
    """
    cascade, keys = Cascade(layers), list(keys)
    up = [*keys, "group"]
    at = (-1 - F.col(index) if backwards else F.col(index)).cast("long")
    turned = texts.select(*keys, F.floor(at / FAN).alias("group"), at.alias("at"), (F.reverse(value) if backwards else F.col(value)).alias("text"))
    begun = turned.withColumn("entry", F.lit(None).cast("int")).withColumn("final", F.lit(None).cast("boolean"))
    if not turned.where(F.col("group") != (-1 if backwards else 0)).isEmpty():
        # a row before each group's chunks brings its state: after a join, Spark may leave out the repartition and then read the join's side as it lies
        begun = begun.unionByName(_entries(turned, keys, cascade).select(*up, F.lit(None).cast("long").alias("at"), F.lit("").alias("text"), "entry", "final"))

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ends = 0, True
        for rows, _, last in _ends(batches, len(up)):
            now, states, final = rows.column("text").to_pylist(), [], []
            for m, z, entry, end in zip(_effects(now, cascade), last, rows.column("entry").to_pylist(), rows.column("final").to_pylist(), strict=True):
                if entry is not None:
                    state, ends = entry, end
                states.append(state)
                final.append(z and ends)
                state, ends = (0, True) if z else (m[state], ends)
            of, lengths = np.array([cascade.states[s] for s in states], np.int64).reshape(-1, len(layers)), []
            for j, layer in enumerate(layers):
                now = _rewritten(now, layer, of[:, j], final)
                lengths.append(list(map(len, now)))
            out = [t[::-1] for t in now] if backwards else now
            cols = [rows.column(k) for k in [*keys, "at"]]
            written = pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array(list(map(list, zip(*lengths, strict=True))), pa.list_(pa.int64()))], names=[*keys, "at", value, "lengths"])
            yield written.filter(rows.column("entry").is_null())

    done = begun.repartition(*up).sortWithinPartitions(*up, "at").select(*up, "at", "text", "entry", "final")
    done = done.mapInArrow(output, _schema(begun, [*keys, "at"], (value, T.StringType()), ("lengths", T.ArrayType(T.LongType()))))
    return done.select(*keys, (-1 - F.col("at") if backwards else F.col("at")).alias(index), value, "lengths")


def texts_of(symbols: DataFrame, value: str = "sym", keys: tuple[str, ...] = ("seq_id",), size: int = SIZE) -> DataFrame:
    """(*keys, chunk, text): the symbols of each ``size`` positions as one text; positions may have gaps."""
    rows = F.sort_array(F.collect_list(F.struct("pos", F.col(value).cast("string").alias("v"))))
    packed = symbols.groupBy(*keys, F.floor(F.col("pos") / size).cast("long").alias("chunk")).agg(rows.alias("rows"))
    return packed.select(*keys, "chunk", F.array_join(F.transform("rows", lambda r: r["v"]), "").alias("text"))


def recut(texts: DataFrame, keys: tuple[str, ...] = ("seq_id",), size: int = SIZE) -> DataFrame:
    """(*keys, part, text): the sequence that texts (*keys, chunk, text) are in order, cut anew into parts of ``size`` symbols."""
    long = texts.where("text <> ''").withColumn("n", F.length("text").cast("long"))
    placed = carried(long, "chunk", {"n": "offset"}, keys=keys)
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("n") - 1) / size)
    each = placed.select(*keys, "offset", "text", F.explode(F.sequence(first, last)).alias("part"))
    begin = F.greatest(F.col("part") * size - F.col("offset"), F.lit(0))
    piece = F.substring("text", (begin + 1).cast("int"), ((F.col("part") + 1) * size - F.greatest(F.col("offset"), F.col("part") * size)).cast("int"))
    joined = F.sort_array(F.collect_list(F.struct("offset", piece.alias("piece"))))
    return each.groupBy(*keys, "part").agg(joined.alias("p")).select(*keys, "part", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))
