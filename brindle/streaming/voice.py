"""Voice activity on a stream of levels: state for each call and channel."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.live import SEGMENT, VoiceActivity
from ..shipping import ship


def stream_segments(levels: DataFrame, limits: dict = SEGMENT, event_time: str = "ts", late: str = "10 seconds", idle_ms: int = 120_000) -> DataFrame:
    """call_id, channel, start_ms, end_ms of the speech in a stream of levels (call_id, channel, ts, ms, rms, chunk_ms).

    The state is the last levels, the noise floor, what is captured and the 300 ms before it, so a segment goes on
    across batches.  A channel silent in event time for ``idle_ms`` is at its end: its open segment is handed on and
    its state goes.  Levels of one batch are put in the order of time; those behind the watermark are dropped.
    """
    ship(levels.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        voice = VoiceActivity(**limits, state=json.loads(state.get[0]) if state.exists else None)
        if state.hasTimedOut:
            found = [voice.taken()]
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values("ms")
            found = [voice.hear(*row) for row in zip(pdf["ms"], pdf["rms"], pdf["chunk_ms"])]
            state.update((json.dumps(voice.now),))
            state.setTimeoutTimestamp(int(pdf[event_time].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame([(*key, *segment) for segment in found if segment], columns=["call_id", "channel", "start_ms", "end_ms"])

    schema = "call_id long, channel string, start_ms double, end_ms double"
    return levels.withWatermark(event_time, late).groupBy("call_id", "channel").applyInPandasWithState(run, schema, "voice string", "append", GroupStateTimeout.EventTimeTimeout)
