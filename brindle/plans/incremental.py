"""Three rounds of changes to a corpus made from ``orders``, carried through by change sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import incremental
from .registry import query, table

ROUNDS = 3
# an order enters in round k % 4, may go in round k % 11, and gets a new edition wherever k + round is divisible by 5
_SQL = """rounds as (select o_orderkey as k, o_custkey as c, r.r, r.r >= o_orderkey % 4 and not (o_orderkey % 11 between 1 and 3 and r.r >= o_orderkey % 11) as there,
  len(list_filter(range(1, r.r + 1), lambda s: (o_orderkey + s) % 5 = 0)) as edition from orders, (select unnest(range(4)) as r) r),
states as (select *, coalesce(lag(there) over w, false) as was, lag(edition) over w as old from rounds window w as (partition by k order by r))"""


def _snapshot(orders: DataFrame, n: int) -> DataFrame:
    k = F.col("o_orderkey")
    edition = sum((F.when((k + s) % 5 == 0, 1).otherwise(0) for s in range(1, n + 1)), F.lit(0)).cast("string")
    mail = F.when(k % 3 == 0, F.concat(F.lit(" from c"), F.col("o_custkey").cast("string"), F.lit("@mail.example")))
    text = F.concat(F.lit("Order "), k.cast("string"), F.lit(", edition "), edition, F.coalesce(mail, F.lit("")), F.lit(" stands"))
    there = (k % 4 <= n) & ~((k % 11).between(1, 3) & (k % 11 <= n))
    return orders.filter(there).select(k.alias("doc_id"), text.alias("text"))


@query(f"""with {_SQL}, entered as (select k, min(edition) as first from rounds where there group by k)
select k || ':0' as record_id, k as doc_id, '1.' || (edition - first) as version, k % 3 = 0 as has_pii,
 'Order ' || k || ', edition ' || edition || case when k % 3 = 0 then ' from [EMAIL_REDACTED]' else '' end || ' stands' as redacted from rounds join entered using (k) where r = 3 and there""")
def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records after three rounds: what a full build gives, with the versions that the changes made."""
    orders = table(spark, sf_dir, "orders")
    marks, records = incremental.full_build(_snapshot(orders, 0))
    for n in range(1, ROUNDS + 1):
        marks, records, _ = incremental.next_build(marks, cut(records), _snapshot(orders, n))
    return records.select("record_id", "doc_id", "version", "has_pii", "redacted")


@query(f"""with {_SQL} select r::int as round, case when not was then 'new' when not there then 'gone' when old <> edition then 'changed' else 'unchanged' end as kind, count(*) as n from states where r > 0 and (there or was) group by 1, 2""")
def change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each kind in each round's change set."""
    orders = table(spark, sf_dir, "orders")
    marks = [incremental.marks(_snapshot(orders, n)) for n in range(ROUNDS + 1)]
    counted = (incremental.change_set(*two).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(n).alias("round"), "kind", "n") for n, two in enumerate(zip(marks, marks[1:]), 1))
    return reduce(DataFrame.union, counted)
