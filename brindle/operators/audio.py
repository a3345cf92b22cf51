"""Call audio as tables: 16-bit little-endian PCM in binary columns, levels per chunk in rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from .live import VoiceActivity, voiced_segments

WIDTH, CHUNK_MS = 2, 200
# Limits of one utterance, in milliseconds, and the level that interrupts an agent.
UTTERANCE = {"hangover": 1100.0, "longest": 30_000.0, "shortest": 350.0}
BARGE_IN_RMS, ECHO_TAIL_MS = 0.055, 400.0


def mix_stereo(left: Column, right: Column) -> Column:
    """Two mono tracks as one stereo track; the shorter is filled with silence, half a sample at the end is left out."""

    @F.pandas_udf("binary")
    def mix(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a: bytes | None, b: bytes | None) -> bytes:
            n = max(len(a or b""), len(b or b"")) // WIDTH
            tracks = np.zeros((n, 2), "<i2")
            for column, pcm in enumerate((a or b"", b or b"")):
                samples = np.frombuffer(pcm.ljust(len(pcm) + len(pcm) % WIDTH, b"\0"), "<i2")[:n]
                tracks[: len(samples), column] = samples
            return tracks.tobytes()

        return pd.Series([one(a, b) for a, b in zip(left, right)])

    return mix(left, right)


def channel(pcm: Column, number: int, channels: int = 2) -> Column:
    """One channel of interleaved samples."""

    @F.pandas_udf("binary")
    def pick(pcm: pd.Series) -> pd.Series:
        whole = WIDTH * channels
        return pd.Series([None if x is None else np.frombuffer(x[: len(x) - len(x) % whole], "<i2")[number::channels].tobytes() for x in pcm])

    return pick(pcm)


def replay(recordings: DataFrame, rate: int = 16_000, channels: int = 2, speed: float = 1.0) -> DataFrame:
    """call_id, chunk, agent, customer and due_ms: a recording in chunks of 200 ms, each with the time it is due.

    recordings: call_id, pcm.  A mono recording is all the customer's.
    """
    size = int(rate * CHUNK_MS / 1000) * WIDTH * channels
    many = F.ceil(F.length("pcm") / size).cast("int")
    rows = recordings.filter(F.length("pcm") > 0).select("call_id", "pcm", F.explode(F.sequence(F.lit(0), many - 1)).alias("chunk"))
    rows = rows.withColumn("raw", F.substring("pcm", F.col("chunk") * size + 1, F.lit(size)))
    due = ((F.col("chunk") + 1) * F.lit(CHUNK_MS / speed)).alias("due_ms")
    sides = [channel(F.col("raw"), n).alias(name) for n, name in enumerate(("agent", "customer"))]
    if channels == 1:
        sides = [F.lit(b"").alias("agent"), F.col("raw").alias("customer")]
    return rows.select("call_id", "chunk", *sides, due)


def replay_stream(spark, folder: str, schema) -> DataFrame:
    """Chunks written as Parquet files, as a stream of one file per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def customer_levels(levels: DataFrame, tail_ms: float = ECHO_TAIL_MS) -> DataFrame:
    """Levels that are the customer's own: while the agent speaks, and ``tail_ms`` after, only loud ones.

    levels: call_id, ms, rms, chunk_ms, agent_speaking.
    """
    before = W.partitionBy("call_id").orderBy("ms").rowsBetween(W.unboundedPreceding, 0)
    last = F.max(F.when(F.col("agent_speaking"), F.col("ms") + F.col("chunk_ms"))).over(before)
    guarded = F.coalesce(F.col("ms") < last + tail_ms, F.lit(False))
    return levels.withColumn("guarded", guarded).filter(~F.col("guarded") | (F.col("rms") >= BARGE_IN_RMS)).drop("guarded")


class TurnVoice(VoiceActivity):
    """An utterance may reach its longest, and ends beyond it."""

    def full(self, length: float) -> bool:
        return length > self.longest


def utterances(levels: DataFrame) -> DataFrame:
    """call_id, start_ms, end_ms of a customer's utterances, with the sound just before each (300 ms at most).

    An utterance ends with 1.1 s of silence, or beyond 30 s; none is under 0.35 s or without speech, and one that a
    call's end cuts off is not answered.
    """
    ship(levels.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = voiced_segments(pdf.sort_values("ms"), TurnVoice(**UTTERANCE), at_end=False)
        return pd.DataFrame([(int(pdf["call_id"].iloc[0]), a, b) for a, b in found], columns=["call_id", "start_ms", "end_ms"])

    return customer_levels(levels).groupBy("call_id").applyInPandas(run, "call_id long, start_ms double, end_ms double")


def one_slot_queue(rows: DataFrame) -> DataFrame:
    """call_id, seq and began of every utterance: when its turn began, null where a newer one took its place.

    rows: call_id, seq, at, busy (how long its turn takes).  One utterance waits at most; it begins
    when the turn at hand ends.
    """
    ship(rows.sparkSession)

    def turns(pdf: pd.DataFrame) -> Iterator[tuple[int, float]]:
        free, waiting = -np.inf, None
        for seq, at, busy in zip(pdf["seq"], pdf["at"], pdf["busy"]):
            if waiting and at >= free:
                yield waiting[0], free
                free, waiting = free + waiting[1], None
            if at >= free:
                yield seq, at
                free = at + busy
            else:
                waiting = (seq, busy)
        if waiting:
            yield waiting[0], free

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "seq"])
        began = dict(turns(pdf))
        return pd.DataFrame({"call_id": pdf["call_id"], "seq": pdf["seq"], "began": [began.get(s) for s in pdf["seq"]]})

    return rows.groupBy("call_id").applyInPandas(run, "call_id long, seq long, began double")


def completion_order(segments: DataFrame) -> DataFrame:
    """call_id, seq, place and late: segments in the order in which their recognition ended.

    segments: call_id, seq, transcribed_ts.  A segment is late if one spoken after it was delivered before it.
    """
    w = W.partitionBy("call_id").orderBy("transcribed_ts", "seq")
    newest = F.max("seq").over(w.rowsBetween(W.unboundedPreceding, -1))
    return segments.select("call_id", "seq", F.row_number().over(w).alias("place"), F.coalesce(newest > F.col("seq"), F.lit(False)).alias("late"))
