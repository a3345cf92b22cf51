"""Dialogue and audio queries: slots, routes, openings, summaries, expectations, tracks and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import audio, dialogue
from .registry import query, sql_list, table

_SQL_SAID = """said as (select c_custkey as call_id, unnest([
  {'slot': 'business_name', 'value': c_name, 'seen': true},
  {'slot': 'annual_turnover_inr', 'value': case k % 4 when 0 then (n * 100000)::varchar when 3 then (n * 10000000)::varchar end, 'seen': k % 4 <> 1},
  {'slot': 'business_vintage_months', 'value': case k % 3 when 0 then (n * 12)::varchar when 1 then n::varchar end, 'seen': true},
  {'slot': 'gst_registered', 'value': case k % 3 when 0 then 'true' when 1 then 'false' end, 'seen': true},
  {'slot': 'applicant_age', 'value': case when k % 120 between 16 and 99 then (k % 120)::varchar end, 'seen': true},
  {'slot': 'credit_score', 'value': case when k % 1000 between 300 and 900 then (k % 1000)::varchar end, 'seen': true},
  {'slot': 'city', 'value': c_mktsegment, 'seen': true},
  {'slot': 'premium', 'value': (n * 1000)::varchar, 'seen': k % 5 <> 0}]) as s from (select *, c_custkey as k, c_custkey % 90 + 1 as n from customer)),
slots as (select call_id, s.slot as slot, s.value as value, s.value is not null as parsed from said where s.seen)"""


def said_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer said of ten slots; one of them has no parser."""
    k = F.col("c_custkey")
    n = (k % 90 + 1).cast("string")
    words = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    raw = {
        "business_name": words("  ", F.col("c_name"), " "), "shoe_size": F.lit("42"), "loan_purpose": F.lit(None).cast("string"),
        "annual_turnover_inr": F.when(k % 4 == 0, words(n, " lakh")).when(k % 4 == 1, "unknown").when(k % 4 == 2, "maybe later").otherwise(words(n, " crore")),
        "business_vintage_months": F.when(k % 3 == 0, words(n, " years")).when(k % 3 == 1, words(n, " months")).otherwise("soon"),
        "gst_registered": F.element_at(T.strings(["yes", "belum", "hmm"]), (k % 3 + 1).cast("int")), "applicant_age": words("I am ", (k % 120).cast("string")),
        "credit_score": (k % 1000).cast("string"), "city": words(F.col("c_mktsegment"), "  "), "premium": F.when(k % 5 == 0, "not provided").otherwise(words(n, " thousand")),
    }
    rows = F.array(*[F.struct(F.lit(s).alias("slot"), r.alias("raw")) for s, r in raw.items()])
    return table(spark, sf_dir, "customer").select(k.alias("call_id"), F.explode(rows).alias("s")).select("call_id", "s.*")


@query(f"with {_SQL_SAID} select * from slots")
def normalised_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.normalise_slots(said_slots(spark, sf_dir), F.lit("2026-08-01").cast("date"), {"premium": "amount"})


@query(f"with {_SQL_SAID} select call_id, list(slot order by slot) as unparsed from slots where not parsed group by 1")
def unparsed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.unparsed(normalised_slots(spark, sf_dir))


_Q = lambda s: s.replace("'", "''")
_HEADS = " ".join(f"when '{k}' then '{_Q(v)}'" for k, v in V.DECISION_HEADS.items())


@query(f"""select c_custkey, case when d = 'incomplete' then '{V.INCOMPLETE_HEAD}' || array_to_string(m, ', ') || '.' else case d {_HEADS} end || ' ' || array_to_string(m[1:3], ' ')
 || case when c_custkey % 3 = 0 then '{_Q(V.CONFLICT_HEAD)}' || 'too_new, too_large.' else '' end end as summary
from (select c_custkey, ['pass', 'refer', 'reject', 'incomplete'][1 + c_custkey % 4] as d, list_transform(range(c_custkey % 6), lambda i: 'm' || (c_custkey + i)) as m from customer)""")
def decision_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.filter(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i < k % 6, F.concat(F.lit("m"), (k + i).cast("string")))), lambda m: m.isNotNull())
    disposition = F.element_at(T.strings(["pass", "refer", "reject", "incomplete"]), (k % 4 + 1).cast("int"))
    conflicts = F.when(k % 3 == 0, T.strings(["too_new", "too_large"])).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", dialogue.decision_summary(disposition, said, said, conflicts).alias("summary"))


_WAYS = ["question", "objection", "refuse", "unclear", "deny", "out_of_scope", "answer", "question"]
_SQL_ROUTED = f"""t as (select conv_id as call_id, turn as seq, case role when 'user' then 'customer' else 'agent' end as speaker, text || case when (conv_id + turn) % 5 = 0 then ' Sorry, come again?' else '' end as text,
  {sql_list(_WAYS)}[1 + (conv_id * 13 + turn * 5) % {len(_WAYS)}] as intent, (conv_id + turn) % 2 = 0 as answered from conversations where role <> 'system'),
a as (select *, last_value(case when speaker = 'agent' then text end ignore nulls) over w as last_said from t window w as (partition by call_id order by seq rows between unbounded preceding and 1 preceding)),
b as (select *, case when intent in ('question', 'objection') and regexp_matches(text, '(?i){_Q(V.REPEAT_REQUEST)}') and coalesce(last_said, '') <> '' then last_said end as echo,
  coalesce(sum((intent = 'refuse')::int) over (partition by call_id order by seq rows between unbounded preceding and 1 preceding), 0) as before_ from a where speaker = 'customer'),
c as (select *, intent = 'refuse' and before_ = 1 as closes, echo is null and intent not in ('deny', 'unclear') and not (intent = 'refuse' and before_ = 1) as passes from b where before_ < 2),
r as (select *, coalesce(bool_or(passes) over (partition by call_id order by seq rows between unbounded preceding and 1 preceding), false) as agreed from c)"""


@query(f"""with {_SQL_ROUTED} select call_id, seq, case when echo is not null then 'repeat' when intent in ('question', 'objection') then 'answer' when closes then 'close' when intent = 'refuse' then 'reassure'
 when intent = 'out_of_scope' then case when answered then 'answer' else 'decline' end when intent = 'unclear' then 'clarify' when intent = 'deny' and not agreed then 'consent_declined' else 'qualify' end as route,
 case when closes then 'closed' when agreed or passes then 'qualification' else 'consent' end as phase, echo from r""")
def turn_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    turns = table(spark, sf_dir, "conversations").filter("role <> 'system'").select(
        c.alias("call_id"), t.alias("seq"), F.when(F.col("role") == "user", "customer").otherwise("agent").alias("speaker"),
        F.concat("text", F.when((c + t) % 5 == 0, " Sorry, come again?").otherwise("")).alias("text"),
        F.element_at(T.strings(_WAYS), ((c * 13 + t * 5) % len(_WAYS) + 1).cast("int")).alias("intent"), ((c + t) % 2 == 0).alias("answered"),
    )
    return dialogue.route(turns)


@query(f"""select conv_id, turn, case {sql_list(_WAYS)}[1 + (conv_id * 13 + turn * 5) % {len(_WAYS)}] when 'question' then {sql_list(V.INTENT_CATEGORIES['question'])} when 'objection' then {sql_list(V.INTENT_CATEGORIES['objection'])} end as categories from conversations""")
def search_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = F.element_at(T.strings(_WAYS), ((F.col("conv_id") * 13 + F.col("turn") * 5) % len(_WAYS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", dialogue.scope(intent).alias("categories"))


_DISCLOSED = [("ai_disclosure", "I am an automated assistant."), ("recording_disclosure", "This call is recorded."), ("no_payment_disclosure", "We never ask for a code.")]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of every customer's call; of the disclosures, those that a bit of the key leaves open are pending."""
    k = F.col("c_custkey")
    calls = table(spark, sf_dir, "customer").select(k.alias("call_id"), F.concat(F.lit("Hello "), "c_name", F.lit(".")).alias("greeting"), F.lit("May I go on?").alias("consent"))
    rows = F.array(*[F.when(F.shiftright(k, n).bitwiseAND(1) == 1, F.struct(F.lit(n).alias("place"), F.lit(d).alias("disclosure"), F.lit(t).alias("text"))) for n, (d, t) in enumerate(_DISCLOSED)])
    pending = table(spark, sf_dir, "customer").select(k.alias("call_id"), F.explode(F.array_compact(rows)).alias("d")).select("call_id", "d.*")
    return dialogue.opening_parts(calls, pending)


_SQL_PARTS = f"""p as (select c_custkey as call_id, c_name, list_filter([{', '.join(f"{{'n': {n}, 'd': '{d}', 't': '{t}'}}" for n, (d, t) in enumerate(_DISCLOSED))}], lambda x: (c_custkey >> x.n) & 1 = 1) as xs from customer),
parts as (select call_id, 1 as part, array_to_string(list_concat(['Hello ' || c_name || '.'], [x.t for x in xs if x.n = 0]), ' ') as text, [x.d for x in xs if x.n = 0] as ids from p union all
select call_id, 2, array_to_string(list_concat([x.t for x in xs if x.n > 0], ['May I go on?']), ' '), [x.d for x in xs if x.n > 0] from p)"""


@query(f"with {_SQL_PARTS} select * from parts")
def opening_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)


@query(f"with {_SQL_PARTS} select call_id, unnest(ids) as disclosure from parts where part <= call_id % 3")
def given_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some callers hear both parts of the opening, some the first, some hang up before it."""
    parts = _parts(spark, sf_dir)
    return dialogue.given_disclosures(parts, parts.filter(F.col("part") <= F.col("call_id") % 3).select("call_id", "part"))


@query("""select c_custkey as call_id, case when k % 2 = 0 then (k % 5 = 0) = (k % 3 = 0) end as escalated_ok, case when k % 3 = 0 then k % 4 = 1 end as disposition_ok,
 case when k % 5 = 0 then (k % 4 > 0) = (k % 7 = 0) end as soft_refusal_ok, case when k % 7 = 0 then (k % 11 = 0) = (k % 13 = 0) end as declined_ok, cast(null as boolean) as answered_ok,
 case when k % 4 <> 0 then k % 6 >= 3 end as disclosures_ok,
 coalesce(escalated_ok, true) and coalesce(disposition_ok, true) and coalesce(soft_refusal_ok, true) and coalesce(declined_ok, true) and coalesce(disclosures_ok, true) as all_pass from (select c_custkey, c_custkey as k from customer)""")
def persona_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    when = lambda n, value: F.when(k % n == 0, value)
    deferred, given = (F.slice(T.strings(xs), 1, n.cast("int")) for xs, n in ((["nanti deh", "lihat nanti", "diusahakan"], k % 4), (["ai", "recording", "payment", "x", "y"], k % 6)))
    calls = table(spark, sf_dir, "customer").select(
        k.alias("call_id"), (k % 5 == 0).alias("escalated"), F.element_at(T.strings(["pass", "refer", "reject", "incomplete"]), (k % 4 + 1).cast("int")).alias("disposition"), deferred.alias("soft_refusals"),
        (k % 11 == 0).alias("declined"), F.lit(None).cast("boolean").alias("answered"), given.alias("given"), when(2, k % 3 == 0).alias("want_escalated"), when(3, F.lit("refer")).alias("want_disposition"),
        when(5, k % 7 == 0).alias("want_soft_refusal"), when(7, k % 13 == 0).alias("want_declined"), F.lit(None).cast("boolean").alias("want_answered"),
        F.when(k % 4 != 0, T.strings(["payment", "ai"])).alias("want_disclosures"),
    )
    return dialogue.persona_checks(calls)


_PAD = "rpad(hex({0}), (4 * n)::int, '0')[1:4 * n]"


@query(f"""select c_custkey, lower(array_to_string(list_transform(range(n), lambda i: l[4 * i + 1:4 * i + 4] || r[4 * i + 1:4 * i + 4]), '')) as stereo, lower(l) as agent, lower(r) as customer
from (select c_custkey, n, {_PAD.format('c_name')} as l, {_PAD.format('s')} as r from (select c_custkey, c_name, c_mktsegment || c_mktsegment || c_custkey as s, greatest(strlen(c_name), strlen(s)) // 2 as n from customer))""")
def stereo_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tracks (any bytes) mixed and taken apart again."""
    left, right = F.encode("c_name", "utf-8"), F.encode(F.concat("c_mktsegment", "c_mktsegment", F.col("c_custkey").cast("string")), "utf-8")
    mixed = table(spark, sf_dir, "customer").select("c_custkey", audio.mix_stereo(left, right).alias("pcm"))
    plain = lambda c: F.lower(F.hex(c))
    return mixed.select("c_custkey", plain(F.col("pcm")).alias("stereo"), plain(audio.channel(F.col("pcm"), 0)).alias("agent"), plain(audio.channel(F.col("pcm"), 1)).alias("customer"))


@query("""with c as (select item_id as call_id, i as chunk, hex(text)[160 * i + 1:160 * (i + 1)] as h from (select item_id, repeat(text, 1 + (item_id % 5)::int) as text from benchmark), unnest(range((strlen(text) + 79) // 80)) r(i)),
s as (select call_id, chunk, list_transform(range(length(h) // 8), lambda j: h[8 * j + 1:8 * j + 8]) as xs from c)
select call_id, chunk, lower(array_to_string([x[1:4] for x in xs], '')) as agent, lower(array_to_string([x[5:8] for x in xs], '')) as customer, (chunk + 1) * 100.0::double as due_ms from s""")
def replay_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts taken as stereo recordings of 100 samples a second, replayed at twice the speed."""
    text = F.repeat("text", (1 + F.col("item_id") % 5).cast("int"))
    rows = audio.replay(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("call_id"), F.encode(text, "utf-8").alias("pcm")), rate=100, speed=2.0)
    return rows.select("call_id", "chunk", F.lower(F.hex("agent")).alias("agent"), F.lower(F.hex("customer")).alias("customer"), "due_ms")


@query("""with recursive u as (select user_id as call_id, event_id as seq, floor(epoch(ts) / 60) as clock, value * 40 as busy, row_number() over (partition by user_id order by floor(epoch(ts) / 60), event_id) as n from events),
f as (select distinct call_id, 0::bigint as n, -1e18::double as free, null::bigint as w, null::double as wb, null::bigint as s1, null::double as a1, null::bigint as s2, null::double as a2 from u
union all
select call_id, n, case when idle then clock + busy else ready end, case when idle then null else seq end, case when idle then null else busy end, case when drained then w end, case when drained then free end, case when idle then seq end, case when idle then clock end
from (select *, clock >= ready as idle from (select u.*, f.w, f.wb, f.free, f.w is not null and u.clock >= f.free as drained, case when drained then f.free + f.wb else f.free end as ready from f join u on u.call_id = f.call_id and u.n = f.n + 1))),
began as (select call_id, s1 as seq, a1 as began from f where s1 is not null union all select call_id, s2, a2 from f where s2 is not null
  union all select call_id, w, free from (select *, row_number() over (partition by call_id order by n desc) as k from f) where k = 1 and w is not null)
select u.call_id, u.seq, began from u left join began b on b.call_id = u.call_id and b.seq = u.seq""")
def turn_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as utterances: while one is answered, one waits at most and the newest takes the place."""
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("double")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), minute.alias("at"), (F.col("value") * 40).alias("busy"))
    return audio.one_slot_queue(rows)


@query("""with s as (select user_id as call_id, row_number() over (partition by user_id order by ts, event_id) as seq, ts + to_seconds((event_id * 7919 % 90000)::bigint) as done from events)
select call_id, seq, row_number() over w as place, coalesce(max(seq) over (partition by call_id order by done, seq rows between unbounded preceding and 1 preceding) > seq, false) as late from s window w as (partition by call_id order by done, seq)""")
def completed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    micros = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") * 7919 % 90000) * 1_000_000)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), place.alias("seq"), micros.alias("transcribed_ts"))
    return audio.completion_order(rows)


def vad_sql(hangover: float, full: str, shortest: float, at_end: bool) -> str:
    """Speech (call_id, start_ms, end_ms) in ``levels`` (call_id, ms, rms, width of 200), one level after another, as ``found``.

    State: levels heard (recent, floor_), speaking with its loud and quiet times, what is captured (start, total, voiced),
    and before that the number k of levels since the last capture with whether the last two were at speech level.
    """
    last = f" union all select call_id, start, upto, total, voiced from (select *, row_number() over (partition by call_id order by n desc) as r from fold) where r = 1 and cap" if at_end else ""
    return f"""numbered as (select *, row_number() over (partition by call_id order by ms) as n from levels),
fold as (select distinct call_id, 0::bigint as n, []::double[] as recent, 0.008::double as floor_, false as speaking, 0.0::double as loud, 0.0::double as quiet, false as cap, 0.0::double as start, 0.0::double as total,
  0.0::double as voiced, 0 as k, false as p1, false as p2, 0.0::double as upto, false as taken, 0.0::double as a, 0.0::double as len, 0.0::double as said from numbered
union all
select call_id, n, recent, floor_, speaking, loud, quiet, cap1 and not done, start1, total1, voiced1, case when done then 0 when cap1 then k else k + 1 end, case when cap1 then p1 else heard end, case when cap1 then p2 else p1 end,
  upto, done, start1, total1, voiced1
from (select *, cap1 and (ends or total1 {full}) as done from (
  select *, case when begins then ms - lead else start end as start1, case when cap1 then case when begins then lead else total end + width else 0.0 end as total1,
    case when cap1 then case when begins then (case when k >= 1 and p1 then 200.0 else 0.0 end) + (case when k >= 2 and p2 then 100.0 else 0.0 end) else voiced end + case when heard then width else 0.0 end else 0.0 end as voiced1
  from (select *, cap or begins as cap1, least(300.0, 200.0 * k)::double as lead, rms >= 0.010 as heard, (spoke or begins) and not ends as speaking,
      case when hot then loud0 + width when spoke and not ends then loud0 else 0.0 end as loud from (
    select *, hot and not spoke and loud0 + width >= 250 as begins, not hot and spoke and quiet >= {hangover} as ends from (
      select *, case when hot then 0.0 else quiet0 + width end as quiet, case when low is null then floor0 when low > floor0 then least(low, floor0 * 1.5::double + 0.0001::double) else low end as floor_ from (
        select *, case when len(recent) >= 30 then least(greatest(list_sort(recent)[1 + floor(len(recent) * 0.15::double)::int], 0.004::double), 0.060::double) end as low from (
          select l.call_id, l.n, l.ms, l.rms, l.width, l.ms + l.width as upto, list_append(f.recent, l.rms)[-60:] as recent, f.floor_ as floor0, l.rms > greatest(f.floor_ * 3.0::double, 0.010::double) as hot,
            f.speaking as spoke, f.loud as loud0, f.quiet as quiet0, f.cap, f.start, f.total, f.voiced, f.k, f.p1, f.p2
          from fold f join numbered l on l.call_id = f.call_id and l.n = f.n + 1)))))))),
found as (select call_id, a as start_ms, b as end_ms from (select call_id, a, upto as b, len as total, said as voiced from fold where taken{last}) t(call_id, a, b, total, voiced) where total >= {shortest} and voiced / total >= 0.08)"""


_LEVELS = """levels as (select user_id % 8 as call_id, row_number() over (partition by user_id % 8 order by ts, event_id) * 200.0::double as ms, value / 1500 as rms, 200.0::double as width, event_type = 'view' as speaking from events)"""


@query(f"with recursive {_LEVELS.replace('levels as', 'every_ as')}, guarded as (select *, max(case when speaking then ms + width end) over (partition by call_id order by ms) as last from every_), levels as (select call_id, ms, rms, width from guarded where not coalesce(ms < last + {audio.ECHO_TAIL_MS}, false) or rms >= {audio.BARGE_IN_RMS}), {vad_sql(1100.0, '> 30000', 350.0, False)} select * from found")
def turn_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.col("user_id") % 8
    place = F.row_number().over(W.partitionBy(call).orderBy("ts", "event_id"))
    levels = table(spark, sf_dir, "events").select(
        call.alias("call_id"), (place * 200.0).alias("ms"), (F.col("value") / 1500).alias("rms"), F.lit(200.0).alias("chunk_ms"), (F.col("event_type") == "view").alias("agent_speaking")
    )
    return audio.utterances(levels)
