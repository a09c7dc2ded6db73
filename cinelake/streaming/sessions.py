"""Anchored sessions over a stream of hits: a session lasts ``gap_us`` from its first hit, unlike a session window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "video long, start_us long, end_us long, n_hits long"


def streamed(hits: DataFrame, gap_us: int, delay: str = "10 minutes") -> DataFrame:
    """Closed sessions of ``hits`` (video, t_us, ts). Hits of a micro-batch are put in order; one that is late beyond ``delay``, or
    earlier than the open session, is not counted. A session ends where the next one starts, or ``gap_us`` after its last hit once
    the watermark is past that."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        start, last, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            done.append((key[0], start, last + gap_us, n))
            state.remove()
        else:
            for t in sorted(int(t) for batch in batches for t in batch["t_us"]):
                if start is None:
                    start, last, n = t, t, 1
                elif t - start > gap_us:
                    done.append((key[0], start, t, n))
                    start, last, n = t, t, 1
                elif t >= start:
                    last, n = max(last, t), n + 1
            state.update((start, last, n))
            state.setTimeoutTimestamp(max((last + gap_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["video", "start_us", "end_us", "n_hits"])

    return hits.withWatermark("ts", delay).groupBy("video").applyInPandasWithState(step, OUT, "start long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def maintained(arrivals: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``step`` on each micro-batch of new rows; a step must be safe to repeat. Returns the running query."""
    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
