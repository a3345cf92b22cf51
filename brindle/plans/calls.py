"""Live-call queries on conversations and events."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..lineage import shared_folder
from ..operators import live
from ..streaming import nudges, timers
from .dialogue import vad_sql
from .documents import values
from .registry import case, query, sql_list, table

_PHRASES = ["I need another truck", "we will expand soon", "i cannot pay this is ridiculous", "hdfc offered less", "call me tomorrow", "for my kids", "you said guaranteed and promise you", "this call is recorded", "I am an AI assistant", "nothing", "real person please", "nanti saya kabari"]
_CALLS = f"""calls as (select conv_id as call_id, turn as seq, case role when 'user' then 'customer' else 'agent' end as speaker,
 text || ' ' || {sql_list(_PHRASES)}[1 + (conv_id * 5 + turn * 3) % {len(_PHRASES)}] as text, turn * 12.0::double as call_time_s from conversations where role <> 'system')"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(table(spark, sf_dir, "conversations"))


def said(turns: DataFrame) -> DataFrame:
    """Turns of ``conversations`` as turns of calls, each with a phrase that some detector hears."""
    c, t = F.col("conv_id"), F.col("turn")
    phrase = F.element_at(T.strings(_PHRASES), ((c * 5 + t * 3) % len(_PHRASES) + 1).cast("int"))
    return turns.filter("role <> 'system'").select(
        c.alias("call_id"), t.alias("seq"), F.when(F.col("role") == "user", "customer").otherwise("agent").alias("speaker"),
        F.concat("text", F.lit(" "), phrase).alias("text"), (t * F.lit(12.0)).alias("call_time_s"),
    )


_Q = lambda s: s.replace("'", "''")
_SQL_CUES = [(n, "missed_cross_sell", 0.75, live.pattern(w)) for n, w in V.CROSS_SELL.items()] + [(k, k, c, live.pattern(w)) for k, (c, w) in V.CUSTOMER_CUES.items()]


@query(f"""with {_CALLS}, cue as (select * from (values {', '.join(f"('{d}', '{k}', {c}::double, '{_Q(p)}')" for d, k, c, p in _SQL_CUES)}) t(detail, kind, confidence, p))
select call_id, seq, call_time_s, kind, detail, confidence, regexp_extract(lower(text), p) as evidence from calls, cue where speaker = 'customer' and regexp_matches(lower(text), p)
union all select call_id, seq, call_time_s, 'risky_statement', 'risky_statement', 0.9, unnest(regexp_extract_all(lower(text), '{_Q(live.pattern(V.RISKY_STATEMENTS))}')) from calls where speaker = 'agent'""")
def call_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.signals(calls(spark, sf_dir))


@query("""with t as (select conv_id as call_id, turn as seq, 'q' || (turn // 6) as plain from conversations where role <> 'system' and turn % 2 = 1)
select call_id, seq from (select *, lag(plain, 1) over w as a, lag(plain, 2) over w as b from t window w as (partition by call_id order by seq)) where plain = a and plain = b""")
def repeated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    speaker = F.when((F.col("role") != "system") & (F.col("turn") % 2 == 1), "customer").otherwise("other")
    text = F.concat(F.lit(" Q! "), F.floor(F.col("turn") / 6).cast("string"), F.lit("?"))
    text = F.regexp_replace(text, "Q! ", "Q")
    return live.repeated_questions(turns.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), speaker.alias("speaker"), text.alias("text")))


@query("""with t as (select conv_id as call_id, turn as seq, case when role = 'user' then 'customer' else 'agent' end as speaker, ' ' || first_value(text) over (partition by conv_id, role, turn // 8 order by turn) || case turn % 3 when 0 then '?!' when 1 then ' ' else '...' end as text from conversations),
p as (select call_id, seq, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) as plain from t where speaker = 'customer')
select call_id, seq from (select *, lag(plain, 1) over w as a, lag(plain, 2) over w as b from p window w as (partition by call_id order by seq)) where plain <> '' and plain = a and plain = b""")
def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who say the same words again, with other marks: each turn repeats the first of its eight."""
    first = F.first("text").over(W.partitionBy("conv_id", "role", F.floor(F.col("turn") / 8)).orderBy("turn"))
    mark = F.when(F.col("turn") % 3 == 0, "?!").when(F.col("turn") % 3 == 1, " ").otherwise("...")
    speaker = F.when(F.col("role") == "user", "customer").otherwise("agent")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), speaker.alias("speaker"), F.concat(F.lit(" "), first, mark).alias("text"))
    return live.repeated_questions(turns)


@query(f"""with {_CALLS}, item as (select * from (values {', '.join(f"('{n}', {d}::double, '{_Q(live.pattern(w))}')" for n, d, w in V.CHECKLIST if n != 'no_payment_disclosure')}) t(item, deadline, p)),
s as (select call_id, item, any_value(deadline) as deadline, min(case when speaker = 'agent' and regexp_matches(lower(text), p) then call_time_s end) as said_at from calls, item group by 1, 2)
select call_id, item, said_at, said_at is null or said_at >= deadline as gap from s""")
def compliance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.compliance(calls(spark, sf_dir))


@query(f"""with {_CALLS}, item as (select * from (values {', '.join(f"('{n}', {d}::double, '{_Q(live.pattern(w))}')" for n, d, w in V.CHECKLIST if n != 'no_payment_disclosure')}) t(item, deadline_s, p)),
s as (select call_id, item, deadline_s, min(case when speaker = 'agent' and regexp_matches(lower(text), p) then call_time_s end) as said_at from calls, item group by 1, 2, 3)
select call_id, item, deadline_s from s where said_at is null or said_at >= deadline_s""")
def stream_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines of calls by timers on a stream; after each call a sign of life a day later moves the watermark past them all."""
    # a pattern: it reads a table that is a file, which a stream does not take by its name, as well as one that is a folder of files
    stream = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parque[t]")
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    rows = said(stream).withColumn("ts", at(F.col("call_id") * 60 + F.col("call_time_s")))
    marks = F.array(F.struct("call_id", "speaker", "text", "call_time_s", "ts"), F.struct((-1 - F.col("call_id") % 1024).alias("call_id"), F.lit("clock").alias("speaker"), F.lit("").alias("text"), F.lit(0.0).alias("call_time_s"), at(F.lit(86_400) + F.col("call_id") * 60).alias("ts")))
    gaps = timers.stream_gaps(rows.select(F.explode(marks).alias("m")).select("m.*"))
    with timers.rocksdb(spark):
        return nudges.run_available(gaps, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").filter("call_id >= 0")


_KINDS, _TYPES = list(V.NUDGES), ["click", "view", "purchase", "signup", "logout"]


def event_signals(spark: SparkSession, events: DataFrame, stream: bool = False) -> DataFrame:
    """Events as signals: a call per user, a kind per event type, confidence by value, 15 s apart."""
    kinds = F.create_map(*[F.lit(x) for i, t in enumerate(_TYPES) for x in (t, _KINDS[i * 3])])
    kind = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.element_at(T.strings(_KINDS), (F.crc32("event_type") % len(_KINDS) + 1).cast("int")))
    return events.select(
        F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("v"), (F.col("event_id") % 9).cast("string")).alias("detail"),
        F.least(F.lit(1.0), F.col("value") / 60).alias("confidence"), F.col("ts").cast("timestamp").alias("ts"), *([] if stream else []),
    )


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_signals(spark, table(spark, sf_dir, "events"))
    place = F.row_number().over(W.partitionBy("call_id").orderBy("ts", "seq"))
    return rows.withColumn("at", place * 15.0)


def _fold_sql(at: str) -> str:
    """The suppression fold as a recursive query over each call's signals; ``at`` is the clock."""
    kinds = {t: _KINDS[zlib.crc32(t.encode()) % len(_KINDS)] for t in ("error", "refund", "search")} | dict(zip(_TYPES, _KINDS[::3]))
    rules = ", ".join(f"('{t}', '{k}', {V.NUDGES[k][0]}, '{V.NUDGES[k][1]}', '{_Q(V.NUDGES[k][2])}', {max(V.CONFIDENCE_FLOOR, V.KIND_FLOORS.get(k, 0))})" for t, k in kinds.items())
    return f"""with recursive rule(event_type, kind, priority, topic, template, floor_) as (values {rules}),
clocked as (select user_id as call_id, event_id as seq, event_type, value, ({at})::double as clock from events),
sig as (select call_id, seq, clock, kind, priority, topic, floor_, least(1.0::double, value / 60) as confidence, kind || '|' || lower(replace(template, '{{detail}}', 'v' || (seq % 9))) as mark,
  row_number() over (partition by call_id order by clock, seq) as n from clocked join rule using (event_type)),
fold as (select distinct call_id, 0::bigint as n, 0::bigint as seq, '' as kind, '' as outcome, 0 as evicted, 0 as expired, []::varchar[] as shown, []::struct(g varchar, free double)[] as topics, []::struct(p int, e double)[] as screen from sig
union all
select call_id, n, seq, kind, outcome, case when outcome = 'emitted' and len(held) >= {V.MAX_ACTIVE} then 1 else 0 end, len(screen) - len(held), case when outcome = 'emitted' then list_append(shown, mark) else shown end,
  case when outcome = 'emitted' then list_append(list_filter(topics, lambda x: x.g <> topic), {{'g': topic, 'free': clock + {V.COOLDOWN_S}}}) else topics end,
  case when outcome = 'emitted' then list_append(case when len(held) >= {V.MAX_ACTIVE} then held[2:] else held end, {{'p': priority, 'e': -(clock + {V.TIME_TO_LIVE_S})}}) else held end
from (select *, case when confidence < floor_ then 'low_confidence' when list_contains(shown, mark) then 'duplicate'
    when len(list_filter(topics, lambda x: x.g = topic and clock < x.free)) > 0 then 'cooldown'
    when len(held) >= {V.MAX_ACTIVE} and priority >= held[1].p then 'screen_full' else 'emitted' end as outcome
  from (select s.*, f.shown, f.topics, f.screen, list_sort(list_filter(f.screen, lambda x: -x.e > s.clock), 'DESC') as held from fold f join sig s on s.call_id = f.call_id and s.n = f.n + 1))),
outcomes as (select call_id, seq, kind, outcome from fold where n > 0)"""


_PLACES = "row_number() over (partition by user_id order by ts, event_id) * 15.0"


@query(_fold_sql(_PLACES) + " select * from outcomes")
def nudge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.suppress(_timed(spark, sf_dir).drop("ts"))


@query(_fold_sql(_PLACES) + """ select count(*) as considered, count(*) filter (outcome = 'emitted') as emitted, count(*) filter (outcome = 'low_confidence') as low_confidence,
 count(*) filter (outcome = 'duplicate') as duplicate, count(*) filter (outcome in ('cooldown', 'screen_full')) as cooldown, count(*) filter (outcome = 'screen_full') as screen_full,
 round(1 - count(*) filter (outcome = 'emitted') / count(*), 6) as suppression_rate from outcomes""")
def suppression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.suppression_report(live.suppress(_timed(spark, sf_dir).drop("ts")))


@query(_fold_sql(_PLACES) + """ select count(*) as considered, count(*) filter (outcome = 'emitted') as emitted, count(*) filter (outcome = 'low_confidence') as below_threshold, count(*) filter (outcome = 'duplicate') as duplicate,
 count(*) filter (outcome in ('cooldown', 'screen_full')) as cooldown, sum(evicted)::bigint as evicted, sum(expired)::bigint as expired, round(100.0 * (count(*) - count(*) filter (outcome = 'emitted')) / greatest(1, count(*)), 1) as suppression_rate_pct from fold where n > 0""")
def screen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the screen showed, held back, took off for something more important and let expire."""
    rows = _timed(spark, sf_dir).drop("ts")
    return live.engine_report(live.suppress(rows), live.screen_exits(rows))


@query(_fold_sql("floor(epoch(ts)) / 960.0") + " select * from outcomes")
def stream_nudges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outcomes from a file stream with keyed state (clock: the event time in 12-hour steps)."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = event_signals(spark, stream, stream=True)
    rows = rows.withColumn("at", F.unix_timestamp("ts") / 960.0)
    return nudges.run_available(nudges.stream_suppress(rows), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


_TRUTH = "select user_id as call_id, [%s, %s] as expected, [%s] as forbidden, 3 + user_id %% 5 as max_nudges from events group by 1" % tuple(f"'{_KINDS[i]}'" for i in (0, 3, 9))


@query(_fold_sql(_PLACES) + f""", truth as ({_TRUTH}), shown as (select call_id, list_sort(list(distinct kind)) as kinds, count(*) as n from outcomes where outcome = 'emitted' group by 1),
both_ as (select call_id, list_sort(list_filter(expected, lambda x: not list_contains(coalesce(kinds, []), x))) as missed, list_sort(list_filter(forbidden, lambda x: list_contains(coalesce(kinds, []), x))) as forbidden_shown,
  list_sort(list_filter(coalesce(kinds, []), lambda x: not list_contains(expected, x))) as unexpected, coalesce(n, 0) <= max_nudges as few from truth left join shown using (call_id))
select call_id, missed, forbidden_shown, unexpected, len(missed) = 0 and len(forbidden_shown) = 0 and few as passed from both_""")
def live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call's outcomes against what was expected of it."""
    outcomes = live.suppress(_timed(spark, sf_dir).drop("ts"))
    truth = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id")).distinct().select(
        "call_id", T.strings([_KINDS[0], _KINDS[3]]).alias("expected"), T.strings([_KINDS[9]]).alias("forbidden"), (3 + F.col("call_id") % 5).alias("max_nudges")
    )
    return live.score_calls(outcomes, truth)


@case("""select call_id, missed, forbidden_shown, unexpected, passed from (values (1, []::varchar[], []::varchar[], ['frustration'], true), (2, ['soft_refusal'], []::varchar[], []::varchar[], false), (3, []::varchar[], ['risk'], ['risk'], false)) t(call_id, missed, forbidden_shown, unexpected, passed)""")
def live_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = values(spark, [(1, "compliance_gap", "emitted"), (1, "frustration", "emitted"), (1, "risk", "cooldown"), (3, "risk", "emitted")], "call_id int, kind string, outcome string")
    truth = values(spark, [(1, ["compliance_gap"], ["risk"], 3), (2, ["soft_refusal"], [], 1), (3, [], ["risk"], 2)], "call_id int, expected array<string>, forbidden array<string>, max_nudges int")
    return live.score_calls(shown, truth)


@query("select sink, event_type, count(*) as n, round(sum(value), 4) as total from events, (values ('audit'), ('board')) s(sink) group by 1, 2")
def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events handed to two sinks, one of which fails at first: each ends with each row once."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    write, failures = {name: nudges.numbered_parquet(f"{folder}/{name}") for name in ("audit", "board")}, iter([True, True])

    def board(batch: DataFrame, number: int) -> None:
        if next(failures, False):
            raise ConnectionError("the board is away")
        write["board"](batch, number)

    failed = nudges.fan_out(stream, {"audit": write["audit"], "board": board}, folder)
    if failed:
        raise RuntimeError(str(failed))
    both = [spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("sink"), "event_type", "value") for name in write]
    return both[0].union(both[1]).groupBy("sink", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nudges.windowed_counts(table(spark, sf_dir, "events"))


@query("""select user_id, min(ts) as start, count(*) as n from (select user_id, ts, sum(opened) over (partition by user_id order by ts, event_id) as session from (
 select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hour then 0 else 1 end as opened from events)) group by user_id, session""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


@query("""select conv_id, turn, array_to_string(list(role || ':' || length(text)) over (partition by conv_id order by turn rows between 7 preceding and current row), ' ') as recent from conversations""")
def rolling_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-7, 0)
    said = F.concat("role", F.lit(":"), F.length("text").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(said).over(w), " ").alias("recent"))


@query(f"""with recursive levels as (select user_id as call_id, row_number() over (partition by user_id order by ts, event_id) * 200.0::double as ms, value / 1500 as rms, 200.0::double as width from events),
{vad_sql(800.0, '>= 20000', 400.0, True)} select * from found""")
def vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    levels = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), (place * 200.0).alias("ms"), (F.col("value") / 1500).alias("rms"), F.lit(200.0).alias("chunk_ms"))
    return live.segments(levels)


@query("""select user_id, round(sqrt(avg((value * 100) * (value * 100))) / 32768, 9) as rms, round(max(value * 100) / 32768, 9) as peak, avg((value >= 30)::int) >= 0.08 as has_speech from events group by 1""")
def audio_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") * 100
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.sqrt(F.avg(x * x)) / 32768, 9).alias("rms"), F.round(F.max(x) / 32768, 9).alias("peak"), (F.avg((F.col("value") >= 30).cast("int")) >= 0.08).alias("has_speech")
    )
