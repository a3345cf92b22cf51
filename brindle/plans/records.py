"""Record, call and benchmark queries on synthesised inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import records
from .documents import sql_values, values
from .registry import case, query, sql_list, table

_RECORDS = [
    (1, "", "a__b", "Page 3", "tiny\nThis line tells what it is", "a / b", "page 3", "a / b - This line tells what it is"),
    (2, "Fees", "x", "Late fees", "body", "Fees", "section: Late fees", "Late fees"), (3, "Fees", "x", "", "body", "Fees", "", "Fees"), (4, "Fees", "x", "Page 12", "no", "Fees", "page 12", "Fees"),
]


@case(f"select id, title, locator, record_title, title || case when locator = '' then '' else ' | ' || locator end || ' | site' as citation from {sql_values([(r[0], r[5], r[6], r[7]) for r in _RECORDS], 'id, title, locator, record_title')}")
def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [r[:5] for r in _RECORDS], "id int, given string, slug string, heading string, content string")
    title, place = records.record_title(F.col("given"), F.col("slug")), records.locator(F.col("heading"))
    return rows.select(
        "id", title.alias("title"), place.alias("locator"), records.page_record_title(title, F.col("heading"), F.col("content")).alias("record_title"),
        records.citation(title, place, F.lit(""), F.lit("site")).alias("citation"),
    )


_PDFS = [
    (1, ["Page 1\nFair practices code\nmore text", "second"], "Fair practices code", ""), (2, ["", "  ", None], "", "extraction_failed"), (3, ["short\nA heading that fits here", ""], "A heading that fits here", "partial_extraction"),
    (4, ["Pricing grid for all\nv1 [text truncated in scan]"], "Pricing grid for all", "truncated_source"),
]


@case(f"select id, title, flag from {sql_values([(i, t, f) for i, _, t, f in _PDFS], 'id, title, flag')}")
def pdf_titles_and_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(i, p) for i, p, _, _ in _PDFS], "id int, pages array<string>")
    return rows.select("id", records.pdf_title(F.array_join("pages", "\n")).alias("title"), records.extraction_flag(F.col("pages")).alias("flag"))


@query("""select c_nationkey as q_id, string_agg('[' || c_custkey || '] ' || c_name || E'\\n' || c_mktsegment, E'\\n\\n' order by rank) as block
from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 4 group by 1""")
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    hits = table(spark, sf_dir, "customer").withColumn("rank", place).filter("rank <= 4")
    return records.source_block(hits.select(F.col("c_nationkey").alias("q_id"), "rank", F.col("c_custkey").cast("string").alias("record_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content")))


@query("""with o as (select o_custkey as k, true as ok, max(o_totalprice) as value from orders where o_orderstatus <> 'O' group by 1),
n as (select o_custkey as k, count(*) % 2 = 0 as ok, min(o_totalprice) as value from orders where o_orderstatus <> 'F' group by 1)
select k, case when n.k is null or not n.ok and o.k is not null then o.ok else n.ok end as ok, case when n.k is null or not n.ok and o.k is not null then o.value else n.value end as value from o full outer join n using (k)""")
def merge_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run over closed orders and a later one over open ones; those partly closed are in both."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    old = orders.filter("o_orderstatus <> 'O'").groupBy("k").agg(F.lit(True).alias("ok"), F.max("o_totalprice").alias("value"))
    new = orders.filter("o_orderstatus <> 'F'").groupBy("k").agg((F.count("*") % 2 == 0).alias("ok"), F.min("o_totalprice").alias("value"))
    return records.merge_ok(old, new, ["k"])


_K = list(V.NUDGES)


@query(f"""select event_id, case when contains(t, '{{detail}}') then replace(t, '{{detail}}', 'value ' || (event_id % 7) || '.') else t end as text
from (select event_id, {sql_list([V.NUDGES[k][2] for k in _K])}[1 + event_id % {len(_K)}] as t from events)""")
def nudge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(T.strings(_K), (F.col("event_id") % len(_K) + 1).cast("int"))
    detail = F.concat(F.lit("value "), (F.col("event_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", records.nudge_text(kind, detail).alias("text"))


@query("""with recursive s as (select user_id as call_id, floor(epoch(ts) / 3600)::double as "at", event_type as kind, value / 60 as confidence from events),
t as (select call_id, "at", row_number() over (partition by call_id order by "at") as n from (select distinct call_id, "at" from s)),
r as (select call_id, "at", n, "at" as last, true as kept from t where n = 1 union all
  select t.call_id, t."at", t.n, case when t."at" - r.last >= 6 then t."at" else r.last end, t."at" - r.last >= 6 from r join t on t.call_id = r.call_id and t.n = r.n + 1)
select call_id, "at", kind, least(1.0::double, confidence) as confidence from (select s.*, row_number() over (partition by s.call_id, s."at" order by confidence desc, kind) as k
  from s join r on r.call_id = s.call_id and r."at" = s."at" and kept where confidence >= 0.5) where k <= 5""")
def model_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("double")
    turns = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), hour.alias("at"), F.col("event_type").alias("kind"), (F.col("value") / 60).alias("confidence"))
    return records.model_signals(turns)


@query("select doc_id from documents where lang in ('en', 'de') or lang is null or doc_id % 10 = 0")
def language_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("doc_id") % 10 == 0, "unknown").otherwise(F.col("lang"))
    return records.heard(table(spark, sf_dir, "documents").select("doc_id", tag.alias("language")), ["en", "de"]).select("doc_id")


@query("""select distinct conv_id as call_id, d as disclosure from conversations, (select unnest(['ai', 'recording', 'payment']) as d) x
where not exists (select 1 from conversations c where c.conv_id = conversations.conv_id and case c.turn % 4 when 0 then 'ai' when 1 then 'recording' end = d)""")
def pending_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "call_id")
    required = turns.select("call_id").distinct().withColumn("disclosure", F.explode(T.strings(["ai", "recording", "payment"])))
    given = turns.select("call_id", F.when(F.col("turn") % 4 == 0, "ai").when(F.col("turn") % 4 == 1, "recording").alias("disclosure"))
    return records.pending_disclosures(required, given)


@query("""select user_id as call_id, event_id as seq, (event_id % 500)::double as asr_ms, (event_id % 500 + 250)::double as end_to_end_ms from events""")
def segment_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = lambda n: F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + n * 1000)
    told = F.col("event_id") % 500
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), F.col("ts").alias("audio_end_ts"), later(told).alias("transcribed_ts"), later(told + 250).alias("delivered_ts")
    )
    return records.segment_latency(rows)


@query("""select event_type as market, round(avg(case when user_id % 3 = 0 and ok then value end), 6) as p0, round(avg(case when user_id % 3 = 1 and ok then value end), 6) as p1, round(avg(case when user_id % 3 = 2 and ok then value end), 6) as p2
from (select *, event_id % 5 <> 0 as ok from events) group by 1""")
def mean_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("provider", F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")))
    return rows.groupBy(F.col("event_type").alias("market")).pivot("provider", ["p0", "p1", "p2"]).agg(F.round(F.avg(F.when(F.col("event_id") % 5 != 0, F.col("value"))), 6))
