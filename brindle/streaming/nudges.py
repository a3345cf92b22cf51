"""Suppression on a stream of signals, and windowed counts with late data.

State is one ``Suppressor`` per call, kept by Spark and restored after a failure.  Signals of a
micro-batch are decided in event-time order; the watermark bounds how late a signal may come, and a
call's state goes when event time has passed it by ``idle``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.live import ORDER, Suppressor, decide_all, rendered
from ..shipping import ship

OUTCOME = "call_id long, seq long, kind string, outcome string"


def stream_suppress(rows: DataFrame, event_time: str = "ts", late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The streaming form of ``operators.live.suppress``; rows also carry an event time."""
    ship(rows.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(ORDER, kind="stable")
        fold = Suppressor(json.loads(state.get[0]) if state.exists else None)
        outcome = decide_all(fold, pdf)
        state.update((json.dumps(fold.state()),))
        state.setTimeoutTimestamp(int(pdf[event_time].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame({"call_id": key[0], "seq": pdf["seq"], "kind": pdf["kind"], "outcome": outcome})

    marked = rendered(rows).withWatermark(event_time, late)
    return marked.groupBy("call_id").applyInPandasWithState(run, OUTCOME, "fold string", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per tumbling window and type; streams drop what comes later than the watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Drains what the source holds into Parquet under ``folder`` (shared by all executors) and reads it back.

    Rows behind the watermark that the batches before have set are late.  With chained stateful operators
    allowed, Spark drops them one batch later only, so that is off here: a stream has one such operator.
    """
    conf, chained = stream.sparkSession.conf, "spark.sql.streaming.statefulOperator.allowMultiple"
    before = conf.get(chained)
    sink = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    conf.set(chained, "false")
    try:
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(chained, before)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


class Delivery:
    """Hands micro-batches to sinks, each batch to each sink once, whatever fails.

    A batch is first written under ``folder``; a sink that has taken it gets a mark of its own beside it.  What a
    sink failed to take is tried again before its next batch, in the order of batches, so a restart goes on where
    the marks end.  A sink is a function of (batch, number); where it can fail after it has written, it must
    overwrite what it wrote under that number, as ``numbered_parquet`` does.  No sink's failure keeps another
    from its rows.
    """

    def __init__(self, spark: SparkSession, sinks: dict[str, Callable[[DataFrame, int], None]], folder: str):
        self.spark, self.sinks, self.folder = spark, sinks, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.folder, *map(str, parts))))
        self._system = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts) -> list[str]:
        where = self._path(*parts)
        return [f.getPath().getName() for f in self._system.listStatus(where)] if self._system.exists(where) else []

    def open_batches(self, name: str) -> list[int]:
        """The numbers of whole batches that a sink has not taken."""
        done = set(map(int, self._names("taken", name)))
        kept = [int(n) for n in self._names("batches") if self._system.exists(self._path("batches", n, "_SUCCESS"))]
        return sorted(n for n in kept if n not in done)

    def replay(self) -> dict[str, str]:
        """Gives each sink what it has not taken; the errors of those that failed, by name."""
        failed = {}
        for name, sink in self.sinks.items():
            for number in self.open_batches(name):
                try:
                    sink(self.spark.read.parquet(f"{self.folder}/batches/{number}"), number)
                except Exception as error:  # noqa: BLE001 - sinks are isolated from each other
                    failed[name] = f"{number}: {error}"[:200]
                    break  # later batches of this sink wait for this one
                self._system.create(self._path("taken", name, number), True).close()
        return failed

    def __call__(self, batch: DataFrame, number: int) -> None:
        if not self._system.exists(self._path("batches", number, "_SUCCESS")):  # a batch that Spark gives again is there
            batch.write.mode("overwrite").parquet(f"{self.folder}/batches/{number}")
        self.replay()


def numbered_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a batch written twice leaves as written once."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def fan_out(stream: DataFrame, sinks: dict, folder: str, tries: int = 3) -> dict[str, str]:
    """Drains the stream into every sink; what is left to a failed sink is tried again, then told and kept for the next call."""
    delivery = Delivery(stream.sparkSession, sinks, f"{folder}/delivery")
    delivery.replay()
    stream.writeStream.foreachBatch(delivery).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    failed: dict[str, str] = {}
    for _ in range(tries):
        failed = delivery.replay()
        if not failed:
            break
    return failed
