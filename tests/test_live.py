"""The suppression contract, its batch and stream forms, and dialogue folds."""

import random

import pandas as pd
from pyspark.sql import functions as F

from brindle.operators import corpus, live, pages
from brindle.plans import calls, queries
from brindle.streaming import nudges, voice

DATA = "/root/testdata/sf0.001"


def decide(*rows):
    fold = live.Suppressor()
    return [fold.decide(*r) for r in rows]


def test_floors_duplicates_and_cooldown():
    assert decide(("frustration", "a", 0.5, 0)) == ["low_confidence"]
    assert decide(("buying_signal", "a", 0.7, 0), ("buying_signal", "a", 0.75, 1)) == ["low_confidence", "emitted"]
    assert decide(("risk", "a", 0.9, 0), ("risk", " A ", 0.9, 100)) == ["emitted", "duplicate"]
    assert decide(("risk", "a", 0.9, 0), ("risk", "b", 0.9, 44.9), ("risk", "c", 0.9, 45)) == ["emitted", "cooldown", "emitted"]
    assert decide(("risk", "a", 0.9, 0), ("compliance_gap", "b", 0.9, 1)) == ["emitted", "emitted"]


def test_capacity_eviction_and_expiry():
    full = [("missed_cross_sell", "a", 0.9, 0), ("callback_request", "b", 0.9, 1), ("competitor_mention", "c", 0.9, 2)]
    assert decide(*full, ("topic_shift", "d", 0.9, 3))[-1] == "screen_full"
    assert decide(*full, ("risk", "d", 0.9, 3))[-1] == "emitted"
    assert decide(*full, ("topic_shift", "d", 0.9, 90))[-1] == "emitted"  # the first expires at exactly 90 s
    assert decide(*full, ("topic_shift", "d", 0.9, 89.9))[-1] == "screen_full"


def test_batch_equals_stream(spark):
    stream = {tuple(r) for r in queries.queries()["stream_nudges"](spark, DATA).collect()}
    rows = calls.event_signals(spark, spark.read.parquet(f"{DATA}/events.parquet")).withColumn("at", F.unix_timestamp("ts") / 960.0).drop("ts")
    assert stream == {tuple(r) for r in live.suppress(rows).collect()}
    assert {r[3] for r in stream} >= {"emitted", "cooldown", "low_confidence"}


def test_voice_segments():
    def levels(spans):
        rms = [x for x, n in spans for _ in range(n)]
        return pd.DataFrame({"ms": [200.0 * i for i in range(len(rms))], "rms": rms, "chunk_ms": 200.0})

    def found(*spans):
        return list(live.voiced_segments(levels(spans), live.VoiceActivity(**live.SEGMENT)))

    assert found((0.001, 10), (0.2, 10), (0.001, 10)) == [(1900.0, 4800.0)]  # 300 ms before the second loud level, 800 ms after the last
    assert not found((0.001, 10), (0.2, 1), (0.001, 10))  # a lone transient
    assert len(found((0.001, 9), (0.2, 5), (0.001, 3), (0.2, 5), (0.001, 9))) == 1  # a short pause
    assert len(found((0.001, 9), (0.2, 5), (0.001, 8), (0.2, 5), (0.001, 9))) == 2
    assert not found((0.018, 20))  # a room's noise: under three times the first floor
    assert found((0.2, 120)) == [(0.0, 20_000.0)]  # what goes on after the longest is not heard again without a silence
    assert found((0.001, 10), (0.2, 3)) == [(1900.0, 2600.0)]  # the call's end ends it
    patient = live.VoiceActivity(hangover=8000.0, longest=9e9, shortest=400.0)
    assert not list(live.voiced_segments(levels([(0.001, 3), (0.2, 2), (0.001, 50)]), patient))  # under 8 % of it is loud


def test_voice_activity_on_a_stream(spark, tmp_path):
    """Batches that cut through segments give what the whole calls give; each channel has state of its own."""
    rng = random.Random(2)
    rows = [(c, ch, 200.0 * i, 0.3 * rng.random() ** 4, 200.0) for c in (1, 2) for ch in ("agent", "customer") for i in range(400)]
    schema = "call_id long, channel string, ms double, rms double, chunk_ms double"
    for n in range(8):
        part = [r for r in rows if 10_000 * n <= r[2] < 10_000 * (n + 1)]
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis((F.col("ms") + 1_700_000_000_000).cast("long")))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = nudges.run_available(voice.stream_segments(stream), f"{tmp_path}/sink").collect()
    want = {}
    for c in (1, 2):
        for ch in ("agent", "customer"):
            own = pd.DataFrame([r[2:] for r in rows if r[:2] == (c, ch)], columns=["ms", "rms", "chunk_ms"])
            want[c, ch] = list(live.voiced_segments(own, live.VoiceActivity(**live.SEGMENT), at_end=False))
    assert sum(map(len, want.values())) > 8
    assert {k: sorted((r.start_ms, r.end_ms) for r in got if (r.call_id, r.channel) == k) for k in want} == want


def test_chunks():
    table = [f"| row {n}: " + "x" * 60 for n in range(39)]
    made = corpus.pack("T", table)
    assert len(made) > 1 and all(c["atomic"] for c in made[:-1]) and "\n".join(c["text"] for c in made) == "\n".join(table)
    prose = corpus.pack("P", [f"Line {n} says a few words and a few more." for n in range(200)] + ["", " "])
    assert all(len(c["text"]) // 4 <= corpus.MAX_TOKENS for c in prose) and prose[1]["text"].startswith(prose[0]["text"][-240:])
    long = corpus.pack("L", ["One line.", " ".join(f"Sentence {n} says a few words." for n in range(400))])
    assert all(len(c["text"]) // 4 <= corpus.MAX_TOKENS for c in long) and not any(c["atomic"] for c in long)
    assert " ".join(c["text"] for c in long).replace("\n", " ").count("Sentence 399 says") == 1
    assert corpus.pack("S", [" ", "- rule_id: 1"]) == [{"heading": "S", "text": "- rule_id: 1", "atomic": True}] and corpus.pack("S", [""]) == []
    small = [{"heading": "A", "text": "x" * 200, "atomic": False}, {"heading": "A", "text": "y", "atomic": False}, {"heading": "B", "text": "z", "atomic": False}]
    assert [c["heading"] for c in corpus.join_runts(small)] == ["A", "B"]


def test_page_blocks():
    html = "<body><nav><li>menu</li></nav><main><h2>Q &amp; A</h2><button>How long does it take?</button><button>Read more</button><ul><li><p>Nested text</p></ul><p>One<p>Two <b>bold</main><p>outside</p>"
    assert pages.parse(html) == [("h2", "Q & A"), ("h4", "How long does it take?"), ("li", "Nested text"), ("p", "Nested text"), ("p", "One"), ("p", "Two bold")]


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    """Three micro-batches: what comes two hours behind the newest event is late, half an hour is not."""
    batches = [[("2024-01-02 12:00:00", 1.0)], [("2024-01-02 10:00:00", 10.0), ("2024-01-02 11:30:00", 100.0)], [("2024-01-05 00:00:00", 1000.0)]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([("a", t, v) for t, v in rows], "event_type string, ts string, value double")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = nudges.run_available(nudges.windowed_counts(stream, width="1 hour"), f"{tmp_path}/sink")
    assert sorted((r.start.hour, r.n, r.total) for r in got.collect()) == [(11, 1, 100.0), (12, 1, 1.0)]


def test_signals_that_would_show_the_same_words(spark):
    """Two cues of one kind with other evidence show one text, so the second is a duplicate however late it comes."""
    rows = [(1, 1, "frustration", "capek", 0.9, 0.0), (1, 2, "frustration", "fed up", 0.9, 50.0), (1, 3, "risk", "a fee", 0.9, 60.0), (1, 4, "risk", "a waiver", 0.9, 120.0), (2, 1, "frustration", "kesal", 0.9, 50.0)]
    df = spark.createDataFrame(rows, "call_id long, seq long, kind string, detail string, confidence double, at double")
    assert {(r.call_id, r.seq): r.outcome for r in live.suppress(df).collect()} == {(1, 1): "emitted", (1, 2): "duplicate", (1, 3): "emitted", (1, 4): "emitted", (2, 1): "emitted"}
