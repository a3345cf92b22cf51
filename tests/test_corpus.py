"""Corpus queries on rows that the shared tables do not hold."""

import itertools
import random

import duckdb
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import corpus, dedupe
from brindle.plans import oracles, queries

from .compare import duck_rows, spark_rows


def test_record_ids_beyond_a_thousand_chunks(spark, tmp_path):
    text = "\n".join(f"Line {n} " + "x" * 1500 for n in range(1300))
    spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [r.record_id for r in queries.queries()["chunk_documents"](spark, str(tmp_path)).collect()]
    long = [i for i in ids if i.startswith("1__")]
    first = int(min(long, key=lambda i: int(i[3:]))[3:])
    assert len(long) > 1000 and sorted(long) == sorted(f"1__{n:03d}" for n in range(first, first + len(long)))
    assert len(set(ids)) == len(ids)


def test_small_chunks_after_full_ones(spark, tmp_path):
    rows = [(n, " ".join(["Word" + "x" * 11 + "."] * (100 + n))) for n in range(4)]  # a chunk is full after 99
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = spark_rows(queries.queries()["chunk_documents"](spark, str(tmp_path)))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == duck_rows(db, oracles.oracle_sql()["chunk_documents"])
    assert len(got[1]) == len(rows)


def test_a_market_with_failed_runs_only_keeps_its_row(spark, tmp_path):
    events = "event_id long, user_id long, event_type string, value double"
    spark.createDataFrame([(5, 0, "a", 1.0), (6, 0, "b", 2.0), (10, 0, "b", 9.0)], events).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.queries()["mean_by_provider"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("a", None, None, None), ("b", 2.0, None, None)]


def test_headings_of_any_length(spark):
    head = "h" * ((1 << 20) + 9)
    row = corpus.sections(spark.createDataFrame([(1, f"## {head}\nbody")], "doc_id long, text string")).first()
    assert row.heading == head and row.body == "body"


def test_pairs_of_shared_signatures(spark):
    """Many records on few signatures, null languages among them, against all pairs."""
    chance, rows = random.Random(5), []
    base = [chance.getrandbits(64) for _ in range(8)]
    for seq in range(200):
        sig = base[chance.randrange(8)]
        for _ in range(chance.choice([0, 0, 1, 3, 6])):
            sig ^= 1 << chance.randrange(64)
        rows.append((seq, chance.choice(["en", "hi", None]), sig - (sig >> 63 << 64)))
    got = dedupe.indexed_pairs(spark.createDataFrame(rows, "seq long, language string, sig long")).collect()
    far = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = [(a, b, far(x, y)) for a, m, x in rows for b, n, y in rows if a < b and m == n is not None and far(x, y) <= 6]
    assert sorted(map(tuple, got)) == sorted(want)


def test_running_sums_of_long_arrays(spark):
    numbers = list(range(1000))
    row = spark.createDataFrame([(numbers, [])], "a array<int>, b array<int>").select(T.running_sums(F.col("a")).alias("a"), T.running_sums(F.col("b")).alias("b")).first()
    assert row.a == list(itertools.accumulate(numbers)) and row.b == []


def test_what_is_read_often_is_made_once(spark):
    """The lowered text of a category, and the names of two texts' words, stand once in their plans."""
    from brindle.operators import metrics

    df = spark.createDataFrame([("about", "loan emi " * 9, "website", "x")], "heading string, text string, kind string, doc string")
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    assert plan(df.select(corpus.category(*map(F.col, df.columns)).alias("c"))).count("lower(") == 1
    assert plan(df.select(corpus.product(F.col("text")).alias("c"))).count("lower(") == 1
    pairs = df.select(metrics.edit_distance(F.split("text", " "), F.split("heading", " ")).alias("d"))
    assert plan(pairs).count("array_distinct(") == 1 and pairs.first().d == 19


def test_an_amount_is_read_in_steps_made_once(spark):
    from brindle.functions import values as X

    said = [("2,5 juta", 2_500_000), ("1.200.000", 1_200_000), ("Rs. 3,00,000", 300_000), ("two crore", 20_000_000), ("no EMIs", 0), ("", None), ("later", None), (None, None)]
    out = spark.createDataFrame(said, "raw string, want long").select("want", X.amount(F.col("raw")).alias("got"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("trim(raw") == 1
    assert all(r.got == r.want for r in out.collect())


def test_dedupe_report_groups_no_texts_again(spark):
    from brindle.plans import corpus as plans

    plan = plans.dedupe_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # links alone decide what is left
