"""Timers of live calls, over several micro-batches."""

from pyspark.sql import functions as F

from brindle.functions import vocabulary as V
from brindle.operators import live
from brindle.plans import queries
from brindle.streaming import nudges, timers


def stream_of(spark, batches, schema, folder):
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000))
        df.coalesce(1).write.parquet(f"{folder}/in/{n}")
    typed = schema.replace("ts double", "ts timestamp")
    return spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def test_a_call_that_falls_silent_still_misses_its_deadlines(spark, tmp_path):
    turn = lambda call, at, text, speaker="agent": (call, speaker, text, float(at), 1000.0 * call + at)
    batches = [
        [turn(1, 0, "hello"), turn(1, 5, "I am an AI assistant"), turn(2, 0, "hi")],  # call 1 falls silent after 5 s
        [turn(2, 30, "this call is recorded"), turn(2, 50, "I am an AI assistant")],  # the second comes too late
        [turn(3, 0, "recorded, by an automated assistant"), turn(3, 1, "recorded", "customer")],
        [turn(9, 0, "what now")],
        [turn(90, 0, "much later")],
    ]
    stream = stream_of(spark, batches, "call_id long, speaker string, text string, call_time_s double, ts double", tmp_path)
    with timers.rocksdb(spark):
        got = nudges.run_available(timers.stream_gaps(stream), f"{tmp_path}/sink").collect()
    assert sorted((r.call_id, r.item, r.deadline_s) for r in got) == [(1, "recording_disclosure", 45.0), (2, "ai_disclosure", 45.0), (9, "ai_disclosure", 45.0), (9, "recording_disclosure", 45.0)]


def test_the_screen_tells_what_left_it_and_why(spark, tmp_path):
    kinds = ["topic_shift", "upsell", "missed_cross_sell", "frustration", "risk", "human_request", "payment_difficulty", "buying_signal"]
    kinds = [k for k in kinds if k in V.NUDGES]
    signal = lambda n, at: (1 + n % 2, n, kinds[n % len(kinds)], f"d{n}", 0.95, float(at))
    schema = "call_id long, seq long, kind string, detail string, confidence double, ts double"
    rows = [signal(n, 7 * n) for n in range(60)]
    batches = [rows[:20], rows[20:45], rows[45:], [(99, 0, "risk", "late", 0.9, 50_000.0)], [(98, 0, "risk", "late", 0.9, 90_000.0)]]
    with timers.rocksdb(spark):
        got = nudges.run_available(timers.stream_screen(stream_of(spark, batches, schema, tmp_path)), f"{tmp_path}/sink").filter("call_id < 90").collect()
    df = spark.createDataFrame(rows, schema).withColumn("at", F.col("ts") + 1_700_000_000).drop("ts")
    outcomes = {(r.seq, r.outcome) for r in live.suppress(df).collect()}
    assert {(r.seq, r.outcome) for r in got if r.seq is not None} == outcomes
    exits = [(r.call_id, r.kind, r.outcome, r.at) for r in got if r.seq is None]
    known = {tuple(r) for r in live.screen_exits(df).collect()}
    assert known <= set(exits) and {e[2] for e in exits} == {"evicted", "expired"}
    assert len(exits) == len(set(exits)) == sum(o == "emitted" for _, o in outcomes)  # each shown text leaves once
    report = live.engine_report(live.suppress(df), live.screen_exits(df)).first()
    assert report.considered == 60 and report.evicted == sum(e[2] == "evicted" for e in exits) and report.expired <= sum(e[2] == "expired" for e in exits)


def test_deadlines_of_a_table_of_several_files(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = lambda folder: sorted(map(tuple, queries.queries()["stream_compliance"](spark, folder).collect()))
    assert got(str(tmp_path)) == got("/root/testdata/sf0.001") != []
