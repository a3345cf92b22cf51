import math

from brindle.llm import queries, topk

from .fixtures import DATA


def brute(rows, every, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in sorted(good):
        if i % every == 0:
            asked.setdefault(i, v)
    for q, qv in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op4_exact_topk(spark, DATA).collect())) == brute(rows, 50, 5)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]),
            (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [1.0]), (9, []), (50, [0.1, 0.1]), (50, [0.1, 0.1]), (100, [3e6, -3e6]), (150, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = sorted(map(tuple, topk.top_k(df, query_batch=2).collect()))
    assert got == brute(rows, 50, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def test_ties_and_bounds(spark):
    rows = [(i, [((i * 7919) % 13) / 13 - 0.5, ((i * 31) % 5) / 5 - 0.4] * 20) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute(rows, 50, 5)


def test_batches_of_queries(spark):
    rows = [(i, [((i * 7919) % 101) / 101 - 0.5, ((i * 31) % 7) / 7 - 0.4, (i % 3) / 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, every=20, query_batch=7).collect())) == brute(rows, 20, 5)
