"""Batches that reach the Python workers."""

import pandas as pd

from brindle.shipping import map_arrow, map_pandas


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.range(4000).selectExpr("repeat('x', 4096) as text").coalesce(1)
    told = rows.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes = lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    largest = map_pandas(rows, sizes, "n long").agg({"n": "max"}).first()[0]
    assert largest < 1000, told
    assert map_arrow(rows, lambda batches: (b for b in batches if b.num_rows > 1000), "text string").isEmpty()
