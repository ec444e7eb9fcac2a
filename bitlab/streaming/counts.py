"""Mergeable counts over streams of events, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitlab.sources.tables import is_one

#: Stands for a bit that has not come yet.
MISSING = 2


def windowed_ones(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, ones) by tumbling window of event time; later than ``late`` is left out."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(is_one(F.col("event_type"))).alias("ones"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "ones")


def user_transitions(events: DataFrame, order: int = 2) -> DataFrame:
    """(seq_id, ctx, nxt, n): each user's transitions so far, the last ``order`` bits being carried as state.

    Within a micro-batch events are taken by event_id; they must not arrive in an earlier batch than their predecessors (a
    user's ids have gaps, so nothing tells that one is missing). Where positions are known, ``position_transitions`` takes any order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("event_id")
        seen: dict[tuple[str, int], int] = {}
        for bit in rows["bit"]:
            if len(past) == order:
                seen[past, int(bit)] = seen.get((past, int(bit)), 0) + 1
            past = (past + str(bit))[-order:]
        state.update((past,))
        yield pd.DataFrame([(key[0], c, b, n) for (c, b), n in seen.items()], columns=["seq_id", "ctx", "nxt", "n"])

    keyed = events.select(F.col("user_id").cast("string").alias("seq_id"), "event_id", is_one(F.col("event_type")).alias("bit"))
    return keyed.groupBy("seq_id").applyInPandasWithState(step, "seq_id string, ctx string, nxt int, n long", "past string", "append", GroupStateTimeout.NoTimeout)


def position_transitions(bits: DataFrame, order: int = 2, size: int = 1024) -> DataFrame:
    """(seq_id, ctx, nxt, n): transitions of a stream of (seq_id, pos, bit), each counted once its last bit has come, in whatever order.

    Positions are dense, from 0. State is kept by chunk of ``size`` positions: which bits have come, those of the ``order``
    positions before the chunk included, which each bit near a chunk's end is sent to as well. A window whose bits are all there is counted in
    the batch that completes it; gaps wait as long as they last. Repeated bits count once. The state of a chunk whose bits have all come
    shrinks to a mark that it is done, so later repeats find nothing to count. Sums over all batches are those of the batch query.
    """
    wide = size + order

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, chunk = key
        have = np.frombuffer(state.get[0], np.uint8).copy() if state.exists else np.full(wide, MISSING, np.uint8)
        if not len(have):
            return
        fresh = np.zeros(wide, bool)
        for rows in batches:
            at = rows["pos"].to_numpy() - (chunk * size - order)
            fresh[at] |= have[at] == MISSING
            have[at] = rows["bit"].to_numpy()
        windows = np.lib.stride_tricks.sliding_window_view
        ready = windows(have != MISSING, order + 1).all(axis=1) & windows(fresh, order + 1).any(axis=1)
        found = pd.Series(["".join(map(str, w)) for w in windows(have, order + 1)[ready]]).value_counts()
        # the first chunk has no positions before its own
        done = (have[0 if chunk else order :] != MISSING).all()
        state.update((b"" if done else have.tobytes(),))
        yield pd.DataFrame({"seq_id": seq, "ctx": [w[:-1] for w in found.index], "nxt": [int(w[-1]) for w in found.index], "n": found.to_numpy()})

    own = F.floor(F.col("pos") / size).cast("long")
    to = F.when(F.col("pos") % size >= size - order, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = bits.select(F.col("seq_id").cast("string").alias("seq_id"), F.col("pos").cast("long").alias("pos"), F.col("bit").cast("int").alias("bit"), F.explode(to).alias("chunk"))
    return dealt.groupBy("seq_id", "chunk").applyInPandasWithState(step, "seq_id string, ctx string, nxt int, n long", "bits binary", "append", GroupStateTimeout.NoTimeout)
