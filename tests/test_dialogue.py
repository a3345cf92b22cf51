"""Dialogue, audio and build operators on cases that the tables' keys do not make."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brindle.operators import audio, dedupe, dialogue, metrics, records


def test_slots_by_declared_parsers(spark):
    said = [(1, "premium", "25k"), (1, "policy", "  P-1 "), (1, "cicilan", "dua juta"), (2, "gst_registered", "hmm"), (2, "city", " "), (2, "applicant_age", "200"), (2, "loan_purpose", "not provided"), (3, "other", "x")]
    rows = spark.createDataFrame(said, "call_id long, slot string, raw string")
    out = dialogue.normalise_slots(rows, F.lit("2026-08-01").cast("date"), {"premium": "amount", "policy": "text", "cicilan": "amount", "other": "no such parser"})
    assert {(r.call_id, r.slot): r.value for r in out.collect()} == {
        (1, "premium"): "25000", (1, "policy"): "P-1", (1, "cicilan"): "2000000", (2, "gst_registered"): None, (2, "city"): None, (2, "applicant_age"): None,
    }
    assert {r.call_id: r.unparsed for r in dialogue.unparsed(out).collect()} == {2: ["applicant_age", "city", "gst_registered"]}


def test_routes(spark):
    said = [
        (1, "agent", "Hello, may I go on?", None), (2, "customer", "no", "deny"), (3, "agent", "I see.", None), (4, "customer", "pardon?", "question"), (5, "customer", "fine, yes", "answer"), (6, "customer", "no", "deny"),
        (7, "customer", "leave me", "refuse"), (8, "customer", "weather?", "out_of_scope"), (9, "customer", "no!", "refuse"), (10, "customer", "still there?", "question"),
    ]
    rows = spark.createDataFrame([(1, n, w, t, i, False) for n, w, t, i in said] + [(2, 1, "customer", "say that again", "question", True)], "call_id long, seq long, speaker string, text string, intent string, answered boolean")
    got = {(r.call_id, r.seq): (r.route, r.phase, r.echo) for r in dialogue.route(rows).collect()}
    assert got == {
        (1, 2): ("consent_declined", "consent", None), (1, 4): ("repeat", "consent", "I see."), (1, 5): ("qualify", "qualification", None), (1, 6): ("qualify", "qualification", None),
        (1, 7): ("reassure", "qualification", None), (1, 8): ("decline", "qualification", None), (1, 9): ("close", "closed", None), (2, 1): ("answer", "qualification", None),
    }


def test_openings(spark):
    calls = spark.createDataFrame([(1, "Hello.", "May I?"), (2, "Hi.", "Yes?")], "call_id long, greeting string, consent string")
    pending = spark.createDataFrame([(1, 0, "ai_disclosure", "I am a machine."), (1, 1, "recording", "Recorded.")], "call_id long, place int, disclosure string, text string")
    parts = dialogue.opening_parts(calls, pending)
    assert sorted((r.call_id, r.part, r.text, tuple(r.ids)) for r in parts.collect()) == [
        (1, 1, "Hello. I am a machine.", ("ai_disclosure",)), (1, 2, "Recorded. May I?", ("recording",)), (2, 1, "Hi.", ()), (2, 2, "Yes?", ()),
    ]
    heard = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "call_id long, part int")  # the first caller interrupted the second part
    assert [tuple(r) for r in dialogue.given_disclosures(parts, heard).collect()] == [(1, "ai_disclosure")]


def test_summaries_and_fallbacks(spark):
    rows = spark.createDataFrame([("incomplete", ["a", "b"], [], []), ("reject", [], ["One.", "Two.", "Three.", "Four."], ["x"])], "d string, m array<string>, s array<string>, c array<string>")
    got = [r[0] for r in rows.select(dialogue.decision_summary(F.col("d"), F.col("m"), F.col("s"), F.col("c"))).collect()]
    assert got[0] == "Decision not possible yet. Still missing: a, b." and "One. Two. Three. Note these" in got[1] and got[1].endswith(": x.")
    said = spark.createDataFrame([("Well,  I do NOT know that, sorry.",), ("Sure.",)], "t string")
    assert [r[0] for r in said.select(dialogue.spoken_fallback(F.col("t"), ["I do not know that", ""])).collect()] == [True, False]


def test_source_labels_and_fallback_categories(spark):
    rows = spark.createDataFrame([("website", "http://x", "", "T"), ("website_pdf", "", "/f", "T"), ("crm_export", None, None, "T")], "k string, u string, p string, t string")
    got = [r[0] for r in rows.select(records.source_label(F.col("k"), F.col("u"), F.col("p"), F.col("t"))).collect()]
    assert got[:2] == ["website: http://x", "published PDF: /f"] and got[2].endswith(": T")
    kept = spark.createDataFrame([(1, "unclassified"), (2, "unclassified"), (3, "faq"), (4, "unclassified")], "record_id long, category string")
    told = spark.createDataFrame([(1, "policy"), (2, "poetry"), (3, "policy")], "record_id long, category string")
    assert {r.record_id: r.category for r in records.with_fallback(kept, told, ["policy"]).collect()} == {1: "policy", 2: "unclassified", 3: "faq", 4: "unclassified"}


def test_tracks(spark):
    left, right = np.array([1, -2, 3], "<i2").tobytes(), np.array([7], "<i2").tobytes()
    df = spark.createDataFrame([(bytearray(left), bytearray(right)), (bytearray(b"\x01\x02\x03"), None)], "l binary, r binary").select(audio.mix_stereo(F.col("l"), F.col("r")).alias("s"))
    rows = df.select("s", audio.channel(F.col("s"), 0).alias("a"), audio.channel(F.col("s"), 1).alias("b")).collect()
    assert np.frombuffer(rows[0].s, "<i2").tolist() == [1, 7, -2, 0, 3, 0] and bytes(rows[0].a) == left
    assert np.frombuffer(rows[1].s, "<i2").tolist() == [0x0201, 0]


def test_replay_of_mono_and_as_a_stream(spark, tmp_path):
    pcm = bytearray(np.arange(7000, dtype="<i2").tobytes())
    rows = audio.replay(spark.createDataFrame([(1, pcm)], "call_id long, pcm binary"), rate=16_000, channels=1, speed=2.0).orderBy("chunk").collect()
    assert [len(r.customer) // 2 for r in rows] == [3200, 3200, 600] and [r.due_ms for r in rows] == [100.0, 200.0, 300.0] and not any(r.agent for r in rows)
    for n in range(3):
        spark.createDataFrame([(1, n)], "call_id long, chunk int").coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    stream = audio.replay_stream(spark, str(tmp_path / "chunks"), "call_id long, chunk int")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and len(query.recentProgress) >= 3


def test_the_agent_does_not_hear_itself(spark):
    n = 60
    levels = pd.DataFrame({"call_id": 1, "ms": [200.0 * i for i in range(n)], "rms": [0.04 if 10 <= i < 25 else 0.2 if 35 <= i < 45 else 0.001 for i in range(n)], "chunk_ms": 200.0, "agent_speaking": [8 <= i < 26 for i in range(n)]})
    found = audio.utterances(spark.createDataFrame(levels)).collect()
    assert [(r.start_ms, r.end_ms) for r in found] == [(6900.0, 10_200.0)]  # only the customer's, from 0.3 s before the second loud level to 1.1 s (six levels) after the last


def test_one_utterance_waits(spark):
    rows = [(1, 1, 0.0, 10.0), (1, 2, 2.0, 5.0), (1, 3, 4.0, 5.0), (1, 4, 12.0, 1.0), (1, 5, 40.0, 1.0)]
    got = {r.seq: r.began for r in audio.one_slot_queue(spark.createDataFrame(rows, "call_id long, seq long, at double, busy double")).collect()}
    assert got[1] == 0 and got[3] == 10 and got[4] == 15 and got[5] == 40 and (got[2] is None or got[2] != got[2])


def test_greedy_merge_in_order(spark):
    """A chain: 2 joins 1, so 3, linked to 2 alone, survives, and 4 joins 3."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4), (10, 12), (11, 12), (10, 11)], "a long, b long")
    assert {r.seq: r.survivor for r in dedupe.greedy_merge(pairs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 10: 10, 11: 10, 12: 10}
    assert dedupe.greedy_merge(pairs.limit(0)).count() == 0


def test_the_key_index_misses_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    sigs = [int(x) for x in base]
    for x in base:
        flips = 0
        for bit in rng.permutation(64)[: int(rng.integers(1, 8))]:
            flips |= 1 << int(bit)
        sigs.append(int(np.array([np.uint64(int(x) & (2**64 - 1)) ^ np.uint64(flips)], np.uint64).view(np.int64)[0]))
    rows = spark.createDataFrame([(n, "en", s) for n, s in enumerate(sigs)], "seq long, language string, sig long")
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if bin((sigs[a] ^ sigs[b]) & (2**64 - 1)).count("1") <= dedupe.RADIUS}
    assert {(r.a, r.b) for r in dedupe.indexed_pairs(rows).collect()} == want and len(want) > 20


def test_edit_distance_of_words(spark):
    rows = spark.createDataFrame([("a b c d", "a x c"), ("", "a"), ("one two " * 300, "one three " * 300)], "reference string, hypothesis string")
    assert [r.wer for r in metrics.word_errors(rows).collect()] == [0.5, 1.0, 0.5]
