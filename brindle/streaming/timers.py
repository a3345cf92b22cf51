"""Event-time timers on live calls: what was not said by its deadline, and what left the screen.

Both keep state for each call with ``transformWithStateInPandas``; a timer fires when the watermark passes its
time, whether or not anything more is heard of the call, and fires once.  The state store must be RocksDB's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import vocabulary as V
from ..operators.live import ORDER, Suppressor, pattern, rendered
from ..shipping import ship

STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session with RocksDB as its state store; the store that it had comes back."""
    name, store = STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Kept(StatefulProcessor):
    """A processor with one JSON value of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "json string")

    def load(self) -> dict | None:
        return json.loads(self.kept.get()[0]) if self.kept.exists() else None

    def save(self, value: dict) -> None:
        self.kept.update((json.dumps(value),))

    def close(self) -> None:
        pass


class Deadlines(_Kept):
    """Fires for every required item that an agent has not said by its deadline."""

    def __init__(self, items: list[tuple[str, float, str]]):
        self.items = items

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        now = self.load()
        for pdf in rows:
            if now is None:  # the clock of a call starts with its first turn
                first = pdf.sort_values("ts").iloc[0]
                now = {"began": int(first["ts"].timestamp() * 1000) - int(first["call_time_s"] * 1000), "said": []}
                for wait in sorted({d for _, d, _ in self.items}):
                    self.handle.registerTimer(now["began"] + int(wait * 1000))
            for text, at in zip(*(pdf[pdf["speaker"] == "agent"][c] for c in ("text", "call_time_s"))):
                low = (text or "").lower()
                now["said"] += [n for n, wait, told in self.items if at < wait and n not in now["said"] and re.search(told, low)]
        self.save(now)
        yield pd.DataFrame(columns=["call_id", "item", "deadline_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, at = self.load(), expiredTimerInfo.getExpiryTimeInMs()
        due = [(key[0], n, wait) for n, wait, _ in self.items if now["began"] + int(wait * 1000) == at and n not in now["said"]]
        yield pd.DataFrame(due, columns=["call_id", "item", "deadline_s"])


def stream_gaps(turns: DataFrame, late: str = "10 seconds", require_payment: bool = False) -> DataFrame:
    """call_id, item and deadline_s of each required item not said in time (turns: call_id, speaker, text, call_time_s, ts).

    The rows that ``operators.live.compliance`` calls gaps, each as soon as the watermark is past the deadline.
    """
    ship(turns.sparkSession)
    items = [(n, float(d), pattern(w)) for n, d, w in V.CHECKLIST if require_payment or n != "no_payment_disclosure"]
    calls = turns.withWatermark("ts", late).groupBy("call_id")
    return calls.transformWithStateInPandas(Deadlines(items), "call_id long, item string, deadline_s double", "Append", "EventTime")


class Screen(_Kept):
    """Suppression whose shown texts leave the screen by a timer, or before it for a more important one."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold = Suppressor(self.load())
        pdf = pd.concat(list(rows)).sort_values(ORDER, kind="stable")
        out = []
        for seq, kind, text, confidence, at in zip(pdf["seq"], pdf["kind"], pdf["text"], pdf["confidence"], pdf["at"]):
            outcome = fold.decide(kind, text, confidence, at)
            out += [(key[0], None, *gone) for gone in fold.take_left()]
            out.append((key[0], seq, kind, outcome, at))
            if outcome == "emitted":
                self.handle.registerTimer(int((at + V.TIME_TO_LIVE_S) * 1000))
        self.save(fold.state())
        yield pd.DataFrame(out, columns=["call_id", "seq", "kind", "outcome", "at"]).astype({"seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold = Suppressor(self.load())
        fold.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self.save(fold.state())
        yield pd.DataFrame([(key[0], None, *gone) for gone in fold.take_left()], columns=["call_id", "seq", "kind", "outcome", "at"]).astype({"seq": "Int64"})


def stream_screen(rows: DataFrame, late: str = "10 seconds") -> DataFrame:
    """call_id, seq, kind, outcome and at: every signal's outcome, and of what was shown when and why it left (evicted, expired; without seq).

    rows: call_id, seq, kind, detail, confidence, ts; the clock ``at`` is the event time in seconds.
    """
    ship(rows.sparkSession)
    clocked = rendered(rows).withColumn("at", rows["ts"].cast("double"))
    return clocked.withWatermark("ts", late).groupBy("call_id").transformWithStateInPandas(Screen(), "call_id long, seq long, kind string, outcome string, at double", "Append", "EventTime")
