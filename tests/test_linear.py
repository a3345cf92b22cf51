"""Work that must stay in proportion to a text's matches."""

import time

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import corpus


def _seconds(spark, n):
    docs = spark.createDataFrame([(1, "call 98765-43210 or a@b.co, " * n)], "doc_id long, text string")
    began = time.perf_counter()
    row = corpus.scan_personal_data(docs).first()
    took = time.perf_counter() - began
    assert row.n_findings == 2 * n
    assert row.redacted == "call [PHONE_REDACTED] or [EMAIL_REDACTED], " * n
    return took


def test_many_matches_in_one_text(spark):
    _seconds(spark, 10)
    few, many = min(_seconds(spark, 5_000) for _ in range(2)), _seconds(spark, 10_000)
    assert many < 3 * few + 2 and many < 30


def test_places_and_pieces(spark):
    text = "é\U0001f600x" * 5000
    spans = [(0, 3), (4090, 4100), (0, 15_000), (8192, 8192), (4096, 8192), (14_999, 15_040)]
    df = spark.createDataFrame([(text, *s) for s in spans], "text string, a int, b int")
    got = df.withColumn("held", T.blocks(F.col("text"))).select("a", "b", T.between(F.col("held"), F.col("a"), F.col("b")).alias("part")).collect()
    assert all(r.part == text[r.a : r.b] for r in got)
    words = spark.createDataFrame([("ab c " * 700 + "é ab",), ("",), (None,)], "text string").withColumn("m", F.regexp_extract_all("text", F.lit("ab|c"), F.lit(0)))
    found = T.match_starts(words, {"s": ("m", "ab|c")}, "text").select("s").collect()
    assert [r.s for r in found[:2]] == [sorted([5 * n for n in range(700)] + [5 * n + 3 for n in range(700)] + [3502]), []]


def test_overlapping_spans_yield_to_the_first(spark):
    ends = [(n * 5, n % 3, n * 5 + (12 if n % 7 == 0 else 4), "pan") for n in range(400)]
    kept, at = [], 0
    for s in ends:
        if s[0] >= at:
            kept.append(s)
            at = s[2]
    rows = spark.createDataFrame([(ends,), ([],), (ends[1:5],)], f"spans array<{corpus._SPAN}>")
    assert [[tuple(x) for x in r.s] for r in rows.select(corpus._apart(F.col("spans")).alias("s")).collect()] == [kept, [], ends[1:5]]
