"""The stateful forms of palisade.streaming.bodies for Structured Streaming.

Chunks of one key come in order of their index within a micro-batch; state is a few
hundred bytes a body, and is dropped when the body ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.config import Config

WINDOWS = "key string, idx long, is_last boolean, window binary"
STATE = "tail binary"


def overlapped(chunks: DataFrame, config: Config = Config(), timeout_ms: int | None = None) -> DataFrame:
    """chunks (key, idx, data, is_last) with window: the end of the chunk before, and the chunk.

    Only the last `overlap` bytes of a body are kept between chunks. With a timeout, what is
    kept of a body that has been silent so long is dropped; Spark then runs a batch at every
    trigger, with data or without."""
    overlap = config.overlap

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail = bytes(state.get[0]) if state.exists else b""
        # A key's chunks of one micro-batch; their order is theirs, not their arrival's.
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, data, last in zip(rows["idx"], rows["data"], rows["is_last"]):
            out.append((key[0], idx, bool(last), tail + bytes(data)))
            tail = b"" if last else bytes(data)[-overlap:]
        if bool(rows["is_last"].iloc[-1]):
            if state.exists:
                state.remove()
        else:
            state.update((tail,))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["key", "idx", "is_last", "window"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("key").applyInPandasWithState(step, WINDOWS, STATE, "append", timeout)


def windowed_counts(events: DataFrame, ts: str, *by: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; what is later than the watermark is left out."""
    from pyspark.sql import functions as F

    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"))
