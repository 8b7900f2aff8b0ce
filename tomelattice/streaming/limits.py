"""Admission by rate over a stream of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited_stream(events: DataFrame, key: str, time: str, id: str, most: int = 5, seconds: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """(key, id, admitted) for events of a stream: admitted with fewer than `most` admitted ones of the key in the last `seconds`.

    The state of a key are its last admitted times; it goes once the watermark, `late` behind the
    newest event, is a window past them.  Within a batch events are taken in time order, so the
    result is that of the batch operator if later batches don't bring earlier times; an event
    earlier than an admitted one is judged as if it came now.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id)}

    def fold(group, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        admitted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["_t", "_id"], kind="stable")
        out = []
        for t in rows["_t"]:
            admitted = [x for x in admitted if x > t - seconds]
            out.append(len(admitted) < most)
            if out[-1]:
                admitted.append(t)
        state.update((admitted,))
        end = int((max(admitted, default=rows["_t"].max()) + seconds) * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"_key": rows["_key"], "_id": rows["_id"], "admitted": out})

    rows = events.withWatermark(time, late).select(F.col(key).alias("_key"), F.col(id).alias("_id"), F.col(time), F.col(time).cast("double").alias("_t"))
    folded = rows.groupBy("_key").applyInPandasWithState(fold, f"_key {kinds[key]}, _id {kinds[id]}, admitted boolean", "admitted array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return folded.select(F.col("_key").alias(key), F.col("_id").alias(id), "admitted")
