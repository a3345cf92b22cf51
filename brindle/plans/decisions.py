"""Decisions, spoken values, dialogue checks and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as X
from ..functions import vocabulary as V
from ..operators import decide, metrics
from .documents import sql_values, values
from .registry import case, query, sql_list, table

_ENTITIES, _INDUSTRY = ["proprietorship", "llp", "trust", "private_limited", "partnership"], ["textiles", "crypto_trading", "food", "arms"]
_FACTS = f"""facts as (select c_custkey as applicant_id, {sql_list(_ENTITIES)}[1 + c_custkey % 5] as entity_type, {sql_list(_INDUSTRY)}[1 + c_custkey % 4] as industry,
  round(sum(o_totalprice) * 10)::bigint as turnover, round(max(o_totalprice) * 8)::bigint as amount, datediff('month', min(o_orderdate), timestamp '1998-12-01') as vintage,
  c_custkey % 7 as gap, c_custkey % 3 <> 0 as gst from customer left join orders on o_custkey = c_custkey group by 1, 2, 3, 7, 8)"""
_SLOTS = """long as (select applicant_id, unnest([{'slot': 'entity_type', 'v': entity_type, 'on': gap <> 1}, {'slot': 'industry', 'v': industry, 'on': true},
  {'slot': 'annual_turnover_inr', 'v': case when gap = 2 then null else turnover::varchar end, 'on': true}, {'slot': 'loan_amount_inr', 'v': amount::varchar, 'on': true},
  {'slot': 'business_vintage_months', 'v': vintage::varchar, 'on': gap <> 3}, {'slot': 'gst_registered', 'v': case when gst then 'true' else 'false' end, 'on': true}]) as s from facts),
  slots as (select applicant_id, s.slot as slot, s.v as actual from long where s."on")"""
_RULES = f"rules as (select * from {sql_values([(n, *r) for n, r in enumerate(V.RULES) if r[1] == 'unsecured_business_loan'], 'rule_no, rule_id, product, slot, operator, value, disposition, reason')})"


@query(f"""with {_FACTS}, {_SLOTS}, {_RULES}, fired as (select applicant_id, rule_no, rule_id, reason, case disposition when 'reject' then 2 when 'refer' then 1 else 0 end as level
  from slots join rules using (slot) where coalesce(actual, '') <> '' and case operator when 'in' then list_contains(string_split(value, '|'), actual) when 'eq' then actual = value
    when 'gte' then try_cast(actual as double) >= try_cast(value as double) when 'gt' then try_cast(actual as double) > try_cast(value as double)
    when 'lt' then try_cast(actual as double) < try_cast(value as double) when 'lte' then try_cast(actual as double) <= try_cast(value as double)
    else (try_cast(actual as double) between try_cast(split_part(value, '|', 1) as double) and try_cast(split_part(value, '|', 2) as double)) = (operator = 'between') end),
tops as (select applicant_id, max(level) as top from fired group by 1),
per as (select f.applicant_id, any_value(top) as top, list(reason order by rule_no) as reasons, list(rule_id order by rule_no) as rules from fired f join tops t on t.applicant_id = f.applicant_id and level = top group by 1),
full_ as (select f.*, coalesce(top, 0) as top, coalesce(reasons, []) as reasons, coalesce(rules, []) as rules,
  list_filter({sql_list(V.REQUIRED_SLOTS)}, lambda x: (x = 'entity_type' and gap = 1) or (x = 'business_vintage_months' and gap = 3)) as absent,
  list_filter({sql_list(V.REQUIRED_SLOTS)}, lambda x: (x = 'annual_turnover_inr' and (gap = 2 or turnover is null)) or (x = 'loan_amount_inr' and amount is null) or (x = 'business_vintage_months' and gap <> 3 and vintage is null)) as unknown
  from facts f left join per using (applicant_id))
select applicant_id, case when len(absent) > 0 then 'incomplete' when top = 2 then 'reject' when top = 1 or len(unknown) > 0 then 'refer' else 'pass' end as disposition,
 case when len(absent) > 0 then [] when top = 0 then list_concat(reasons, list_transform(unknown, lambda x: 'UNVERIFIED_' || upper(x))) else reasons end as reasons,
 case when len(absent) > 0 then [] else rules end as rules, case when len(absent) > 0 then absent else unknown end as missing,
 case when len(absent) > 0 then [] else list_filter([case when gap <> 2 and turnover <> 0 and amount <> 0 and amount > turnover then 'requested_amount_exceeds_annual_turnover' end,
   case when vintage > 600 then 'implausible_business_vintage' end, case when not gst and gap <> 2 and turnover > 4000000 then 'turnover_above_gst_threshold_but_not_registered' end], lambda x: x is not null) end as conflicts from full_""")
def qualify_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, key = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("c_custkey")
    last = F.lit("1998-12-01").cast("timestamp")
    since = (F.year(last) - F.year(F.min("o_orderdate"))) * 12 + F.month(last) - F.month(F.min("o_orderdate"))
    sums = orders.groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice") * 10).cast("long").alias("turnover"), F.round(F.max("o_totalprice") * 8).cast("long").alias("amount"), since.alias("vintage")
    )
    pick = lambda xs: F.element_at(T.strings(xs), (key % len(xs) + 1).cast("int"))
    entry = lambda k, v, on=F.lit(True): F.when(on, F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
    gap = key % 7
    slots = F.map_from_entries(
        F.array_compact(
            F.array(
                entry("entity_type", pick(_ENTITIES), gap != 1), entry("industry", pick(_INDUSTRY)), entry("annual_turnover_inr", F.when(gap != 2, F.col("turnover"))),
                entry("loan_amount_inr", F.col("amount")), entry("business_vintage_months", F.col("vintage"), gap != 3), entry("gst_registered", key % 3 != 0),
            )
        )
    )
    applicants = customer.join(sums, key == F.col("o_custkey"), "left").select(key.alias("applicant_id"), slots.alias("slots"))
    return decide.qualify(applicants, decide.rules(spark))


_MAPS = [(1, [], "business_name"), (2, ["business_name", "entity_type"], "industry"), (3, V.ASK_ORDER, None), (4, V.ASK_ORDER[:4] + V.ASK_ORDER[5:], "annual_turnover_inr")]


@case(f"select id, slot from {sql_values([(i, w) for i, _, w in _MAPS], 'id, slot')}")
def next_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [(i, {k: None for k in ks}) for i, ks, _ in _MAPS], "id int, slots map<string, string>")
    return rows.select("id", decide.next_slot(F.col("slots")).alias("slot"))


_AMOUNTS = [
    ("15 lakh", 1500000), ("Rs. 45,00,000", 4500000), ("1.2 crore", 12000000), ("two crore", 20000000), ("42 thousand", 42000), ("4.5 million", 4500000), ("none", 0),
    ("no existing EMIs", 0), ("satu juta dua ratus ribu", 1200000), ("1.200.000", 1200000), ("2,5 juta", 2500000), ("dua miliar", 2000000000), ("tatlong libo", 3000),
    ("isang libo limang daan", 1500), ("seratus ribu", 100000), ("saade teen lakh", 350000), ("", None), ("maybe later", None), (None, None), ("₱ 25k", 25000),
]


@case(f"select raw, amount::bigint as amount from {sql_values(_AMOUNTS, 'raw, amount')}")
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, [(r,) for r, _ in _AMOUNTS], "raw string").select("raw", X.amount(F.col("raw")).alias("amount"))


_DURATIONS = [("6 years", 72), ("18 months", 18), ("3.5 years", 42), ("saade teen saal", 42), ("since 2019", 92), ("2", 24), ("ten years", 120), ("dua tahun", None), ("5 tahun", 60), ("soon", None)]


@case(f"select raw, months::bigint as months from {sql_values(_DURATIONS, 'raw, months')}")
def parse_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2026-08-01").cast("date")
    return values(spark, [(r,) for r, _ in _DURATIONS], "raw string").select("raw", X.months(F.col("raw"), as_of).alias("months"))


_SAID = [
    ("yes", True, None, "yes", None), ("haan ji", True, None, "haan ji", None), ("opo", True, None, "opo", None), ("nahi", False, None, "nahi", None), ("belum", False, None, "belum", None), ("not yet", False, None, "not yet", None),
    ("no, right", True, None, "no, right", None), ("Pvt Ltd company", None, "private_limited", "Pvt Ltd company", None), ("sole proprietor since 1999", None, "proprietorship", "sole proprietor since 1999", None),
    ("an LLP", None, "llp", "an LLP", None), ("bitcoin desk", None, None, "crypto_trading", None), ("casino 45", None, None, "gambling", 45),
]


@case(f"select raw, flag, entity, industry, age::bigint as age from {sql_values(_SAID, 'raw, flag, entity, industry, age')}")
def parse_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return values(spark, [(r[0],) for r in _SAID], "raw string").select(
        "raw", X.flag(raw).alias("flag"), X.entity_type(raw).alias("entity"), X.industry(raw).alias("industry"), X.bounded_int(raw, 16, 99).alias("age")
    )


@query("""select o_orderkey, case when v >= 10000000 then s(v / 10000000) || ' crore rupees' when v >= 100000 then s(v / 100000) || ' lakh rupees' when v >= 1000 then floor(v / 1000)::bigint || ' thousand rupees' else v || ' rupees' end as spoken
from (select o_orderkey, floor(o_totalprice)::bigint * (o_orderkey % 300) as v from orders)""".replace("s(v / 10000000)", "regexp_replace(regexp_replace(printf('%.2f', round_even(v / 10000000, 2)), '0+$', ''), '\\.$', '')").replace("s(v / 100000)", "regexp_replace(regexp_replace(printf('%.2f', round_even(v / 100000, 2)), '0+$', ''), '\\.$', '')"))
def speak_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.floor("o_totalprice") * (F.col("o_orderkey") % 300)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.spoken_amount(value).alias("spoken"))


_INTENTS = ["question", "answer", "refuse", "unclear", "request_human", "question"]
_TURNS = f"""turns as (select conv_id, turn, lower(text || case when (conv_id + turn) % 41 = 0 then ' i will complain' else '' end) as low, {sql_list(_INTENTS)}[1 + (conv_id * 31 + turn * 7) % 6] as intent,
 case when (conv_id + turn) % 3 = 0 then 'frustrated' else 'neutral' end as sentiment, (conv_id * 7 + turn) % 3 <> 0 as low_confidence from conversations where role = 'user')"""


@query(f"""with {_TURNS}, i as (select *, sum((not low_confidence)::int) over w as li, sum((intent <> 'unclear')::int) over w as ui, sum((intent = 'refuse')::int) over w as refusals from turns window w as (partition by conv_id order by turn)),
s as (select *, sum(low_confidence::int) over (partition by conv_id, li order by turn) as ls, sum((intent = 'unclear')::int) over (partition by conv_id, ui order by turn) as us from i)
select conv_id, turn, case when intent = 'request_human' then 'explicit_request' when regexp_matches(low, '{V.DISTRESS}') then 'distress' when sentiment = 'frustrated' and ls >= 2 then 'distress'
 when ls >= 3 then 'repeated_low_confidence' when refusals >= 2 then 'repeated_refusal' when us >= 3 then 'repeated_unclear' end as reason from s""")
def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    c, t = F.col("conv_id"), F.col("turn")
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.concat("text", F.when((c + t) % 41 == 0, " I will complain").otherwise("")).alias("text"),
        F.element_at(T.strings(_INTENTS), ((c * 31 + t * 7) % 6 + 1).cast("int")).alias("intent"),
        F.when((c + t) % 3 == 0, "frustrated").otherwise("neutral").alias("sentiment"), ((c * 7 + t) % 3 != 0).alias("low"),
    )
    turns = decide.streak(turns, F.col("low"), "conv_id", "turn", "low_streak")
    turns = decide.streak(turns, F.col("intent") == "unclear", "conv_id", "turn", "unclear_streak")
    so_far = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    turns = turns.withColumn("refusals", F.sum((F.col("intent") == "refuse").cast("int")).over(so_far))
    reason = decide.escalation(*[F.col(x) for x in ("intent", "sentiment", "text", "low_streak", "refusals", "unclear_streak")])
    return turns.select("conv_id", "turn", reason.alias("reason"))


@query("""select o_orderkey, strftime(slot, '%A') || ' at ' || case when hour(slot) % 12 = 0 then 12 else hour(slot) % 12 end || case when hour(slot) < 12 then ' am' else ' pm' end as slot from (
 select o_orderkey, case when hour(t) >= 19 then date_trunc('day', t) + interval 34 hour when hour(t) < 8 then date_trunc('day', t) + interval 10 hour else t end as slot
 from (select o_orderkey, o_orderdate + to_hours(o_orderkey % 24) + interval 2 hour as t from orders))""")
def callback_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), "o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", decide.callback_slot(now).alias("slot"))


_COMMIT_TURNS = [
    ("a", 1, "nanti saya kabari ya", False), ("b", 1, "ok", False), ("b", 2, "tanggal 5", True), ("c", 1, "tanggal 5", False), ("d", 1, "tanggal 5 tapi nanti saya kabari", True),
    ("e", 1, "hmm", True), ("e", 2, "x", False), ("e", 3, "besok", False), ("f", 1, "nanti deh", False), ("f", 2, "nanti deh, lihat nanti", False),
]
_COMMITTED = [("a", "nanti saya kabari", None, "no_commitment"), ("b", "", "tanggal", ""), ("c", "", None, ""), ("d", "nanti saya kabari", None, "no_commitment"), ("e", "", None, ""), ("f", "nanti deh|lihat nanti", None, "no_commitment")]


@case(f"select call_id, refusals, commitment, outcome from {sql_values(_COMMITTED, 'call_id, refusals, commitment, outcome')}")
def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = values(spark, _COMMIT_TURNS, "call_id string, seq int, text string, probed boolean")
    out = decide.commitments(turns, V.CUSTOMER_CUES["soft_refusal"][1], ["tanggal", "besok", "lusa"])
    return out.select("call_id", F.array_join("soft_refusals", "|").alias("refusals"), "commitment", "outcome")


_DRAFTS = [
    (1, "It is 14.5 per cent", ["a"], ["a", "b"], "rate 14.5% p.a.", True, ""), (2, "Up to 75 lakh", ["a"], ["a"], "up to 50 lakh", False, "75"), (3, "5,000,000 rupees", ["a"], ["a"], "INR 5000000", True, ""),
    (4, "500 rupees", ["a"], ["a"], "clause 5", False, "500"), (5, "1 or 2 days", ["a"], ["a"], "soon", True, ""), (6, "Yes", [], ["a"], "yes", False, ""), (7, "Yes", ["z"], ["a"], "yes", False, ""),
]


@case(f"select id, answered, unsupported from {sql_values([(d[0], d[5], d[6]) for d in _DRAFTS], 'id, answered, unsupported')}")
def grounding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [d[:5] for d in _DRAFTS], "id int, answer string, used_ids array<string>, hit_ids array<string>, sources string")
    return decide.grounded(rows).select("id", "answered", F.array_join("unsupported", "|").alias("unsupported"))


@query("""select o_orderkey, 'LD-' || upper(right(md5(o_orderkey::varchar), 8)) as lead_id, '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' as slots from orders""")
def lead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("LD-"), F.upper(F.right(F.md5(F.col("o_orderkey").cast("string")), F.lit(8)))).alias("lead_id"), slots.alias("slots"))


@query("""select event_type, count(*) as n, min(ms) as min, round(quantile_cont(ms, 0.5), 6) as p50, round(quantile_cont(ms, 0.95), 6) as p95, max(ms) as max, round(avg(ms), 3) as mean
from (select event_type, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000.0::double as ms from events) where ms is not null group by 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = table(spark, sf_dir, "events").select("event_type", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000.0).alias("ms"))
    return metrics.latency(gaps.filter("ms is not null"), ["event_type"])


_WER = [(1, "a b c", "a b c", 0.0, ""), (2, "a b c d", "a x c", 0.5, "b d"), (3, "", "a", 1.0, ""), (4, "", "", 0.0, ""), (5, "Yes, it's fine", "yes its fine", 0.5, "it s"), (6, "one two", "zero one two three", 1.0, "")]


@case(f"select id, wer::double as wer, lost from {sql_values([(w[0], w[3], w[4]) for w in _WER], 'id, wer, lost')}")
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, [w[:3] for w in _WER], "id int, reference string, hypothesis string")
    return metrics.word_errors(rows).select("id", "wer", F.array_join("lost_words", " ").alias("lost"))
