"""A call's dialogue as tables: slots, routing, scopes, openings, summaries and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as X
from ..functions import vocabulary as V


def parsed_value(parser: Column, raw: Column, as_of: Column) -> Column:
    """What a parser, given by name, reads in a customer's words; as text, null if it reads nothing."""
    cut = lambda n: F.nullif(F.substring(F.btrim(raw), 1, n), F.lit(""))
    readers = {
        "text": cut(80), "city": cut(60), "amount": X.amount(raw), "months": X.months(raw, as_of), "bool": X.flag(raw), "entity_type": X.entity_type(raw),
        "industry": X.industry(raw), "age": X.bounded_int(raw, 16, 99), "credit_score": X.bounded_int(raw, 300, 900), "int": X.bounded_int(raw, 0, 100_000),
    }
    return F.coalesce(*[F.when(parser == name, value.cast("string")) for name, value in readers.items()])


def normalise_slots(said: DataFrame, as_of: Column, declared: dict[str, str] | None = None) -> DataFrame:
    """call_id, slot, value and parsed of every slot that was said; rows: call_id, slot, raw.

    A market may declare its own slots' parsers by name.  Slots without a parser, and those left
    unsaid, give no row; words that a parser cannot read give a row without a value.
    """
    parsers = {**V.SLOT_PARSERS, **(declared or {})}
    names = F.create_map(*[F.lit(x) for pair in parsers.items() for x in pair])
    rows = said.withColumn("parser", F.try_element_at(names, F.col("slot")))
    rows = rows.filter(F.col("parser").isin(*V.PARSERS) & ~F.coalesce("raw", F.lit("")).isin(*V.UNSAID))
    value = parsed_value(F.col("parser"), F.col("raw"), as_of)
    return rows.select("call_id", "slot", value.alias("value")).withColumn("parsed", F.col("value").isNotNull())


def unparsed(slots: DataFrame) -> DataFrame:
    """call_id and the slots, in order, whose words could not be read."""
    return slots.filter("not parsed").groupBy("call_id").agg(F.array_sort(F.collect_list("slot")).alias("unparsed"))


def decision_summary(disposition: Column, missing: Column, messages: Column, conflicts: Column) -> Column:
    """The one line that an agent may paraphrase: a verdict, up to three messages, contradictions to ask about."""
    heads = F.create_map(*[F.lit(x) for pair in V.DECISION_HEADS.items() for x in pair])
    asked = F.concat(F.lit(V.CONFLICT_HEAD), F.array_join(conflicts, ", "), F.lit("."))
    told = F.concat(F.try_element_at(heads, disposition), F.lit(" "), F.array_join(F.slice(messages, 1, 3), " "), F.when(F.size(conflicts) > 0, asked).otherwise(""))
    return F.when(disposition == "incomplete", F.concat(F.lit(V.INCOMPLETE_HEAD), F.array_join(missing, ", "), F.lit("."))).otherwise(told)


def scope(intent: Column) -> Column:
    """The categories that a search for this intent may look into; null where all are open."""
    return F.coalesce(*[F.when(intent == name, T.strings(kinds)) for name, kinds in V.INTENT_CATEGORIES.items()])


def asks_again(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + V.REPEAT_REQUEST)


def route(turns: DataFrame) -> DataFrame:
    """call_id, seq, route, phase and echo of every customer turn; rows: call_id, seq, speaker, text, intent, answered.

    A request to repeat echoes what the agent said last.  The second refusal closes the call, and
    what comes later is not routed.  Consent ends with the first turn that is neither a refusal of
    it, nor unclear, nor a request to repeat.  What is out of scope is declined only where the
    knowledge base had no answer.
    """
    before = W.partitionBy("call_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("call_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    intent, asks = F.col("intent"), F.col("intent").isin("question", "objection")
    told = turns.withColumn("last_said", F.last(F.when(F.col("speaker") == "agent", F.col("text")), ignorenulls=True).over(before))
    told = told.filter("speaker = 'customer'")
    told = told.withColumn("echo", F.when(asks & asks_again(F.col("text")) & (F.coalesce("last_said", F.lit("")) != ""), F.col("last_said")))
    refused = F.sum((intent == "refuse").cast("int"))
    told = told.withColumn("refused", refused.over(so_far)).withColumn("gone", F.coalesce(refused.over(before), F.lit(0)) >= 2).filter("not gone")
    closes = (intent == "refuse") & (F.col("refused") >= 2)
    passes = F.col("echo").isNull() & ~intent.isin("deny", "unclear") & ~closes
    told = told.withColumn("agreed", F.coalesce(F.max(passes).over(before), F.lit(False)))
    way = (
        F.when(F.col("echo").isNotNull(), "repeat").when(asks, "answer").when(closes, "close").when(intent == "refuse", "reassure")
        .when(intent == "out_of_scope", F.when(F.coalesce("answered", F.lit(False)), "answer").otherwise("decline")).when(intent == "unclear", "clarify")
        .when((intent == "deny") & ~F.col("agreed"), "consent_declined").otherwise("qualify")
    )
    phase = F.when(closes, "closed").when(F.col("agreed") | passes, "qualification").otherwise("consent")
    return told.select("call_id", "seq", way.alias("route"), phase.alias("phase"), "echo")


def opening_parts(calls: DataFrame, pending: DataFrame, first: str = "ai_disclosure") -> DataFrame:
    """call_id, part, text and ids: the opening in two utterances that a caller may interrupt between.

    calls: call_id, greeting, consent; pending: call_id, place, disclosure, text (not yet given).  The
    disclosure named ``first`` goes with the greeting, the others with the question for consent.
    """
    rows = pending.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("place", "disclosure", "text"))).alias("all"))
    none = F.array().cast("array<struct<place: int, disclosure: string, text: string>>")
    both = calls.join(rows, "call_id", "left").withColumn("all", F.coalesce("all", none))
    lead, rest = F.filter("all", lambda d: d["disclosure"] == first), F.filter("all", lambda d: d["disclosure"] != first)
    line = lambda head, part, tail: F.concat_ws(" ", head, F.transform(part, lambda d: d["text"]), tail)
    part = lambda n, text, part: F.struct(F.lit(n).alias("part"), text.alias("text"), F.transform(part, lambda d: d["disclosure"]).alias("ids"))
    empty = F.lit(None).cast("string")
    made = F.array(part(1, line(F.col("greeting"), lead, empty), lead), part(2, line(empty, rest, F.col("consent")), rest))
    return both.select("call_id", F.explode(made).alias("p")).select("call_id", "p.*")


def given_disclosures(parts: DataFrame, heard: DataFrame) -> DataFrame:
    """call_id and disclosure of what was delivered: only parts that the caller heard (call_id, part) count."""
    return parts.join(heard.select("call_id", "part").distinct(), ["call_id", "part"]).select("call_id", F.explode("ids").alias("disclosure")).distinct()


def persona_checks(calls: DataFrame) -> DataFrame:
    """call_id, a column for each expectation (null where none was stated) and all_pass.

    calls: escalated, disposition, soft_refusals, declined, answered, given with the expectations
    want_escalated, want_disposition, want_soft_refusal, want_declined, want_answered, want_disclosures.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    facts = {
        "escalated": F.coalesce("escalated", F.lit(False)), "disposition": F.coalesce("disposition", F.lit("")), "soft_refusal": some(F.col("soft_refusals")),
        "declined": F.coalesce("declined", F.lit(False)), "answered": F.coalesce("answered", F.lit(False)),
    }
    held = {name: F.when(F.col(f"want_{name}").isNotNull(), F.col(f"want_{name}") == fact) for name, fact in facts.items()}
    held["disclosures"] = F.when(F.col("want_disclosures").isNotNull(), F.size(F.array_except("want_disclosures", F.coalesce("given", F.array().cast("array<string>")))) == 0)
    rows = calls.select("call_id", *[c.alias(f"{name}_ok") for name, c in held.items()])
    return rows.withColumn("all_pass", F.forall(F.array(*[f"{name}_ok" for name in held]), lambda x: F.coalesce(x, F.lit(True))))


def spoken_fallback(text: Column, fallbacks: list[str]) -> Column:
    """Whether an agent's turn holds the start (40 characters) of one of the lines that decline a question."""
    low = F.regexp_replace(F.btrim(F.lower(text)), r"\s+", " ")
    starts = [f[:40].lower().strip() for f in fallbacks]
    return F.exists(T.strings([s for s in starts if s]), lambda s: F.contains(low, s))
