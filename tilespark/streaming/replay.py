"""Streams: a replay buffer kept per key, and running means by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ring_buffer(pushes: DataFrame, capacity: int) -> DataFrame:
    """``pushes(key, seq, value)`` as a stream -> after each batch, the slots that changed: ``key, slot, seq, value``.

    The state of a key is the latest seq of each slot, so it is bounded by ``capacity``; late rows of an older seq change nothing.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs = list(state.get[0]) if state.exists else [-1] * capacity
        new: dict[int, tuple[int, float]] = {}
        for frame in frames:
            for seq, value in zip(frame["seq"], frame["value"]):
                slot = int(seq) % capacity
                if seq > seqs[slot]:
                    seqs[slot] = int(seq)
                    new[slot] = (int(seq), float(value))
        state.update((seqs,))
        yield pd.DataFrame([(key[0], s, q, v) for s, (q, v) in sorted(new.items())], columns=["key", "slot", "seq", "value"])

    return pushes.groupBy("key").applyInPandasWithState(run, "key string, slot int, seq long, value double", "seqs array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_means(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``events(ts, event_type, value)`` -> count and mean by tumbling window and type; windows close after the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
