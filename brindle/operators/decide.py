"""Decisions from rules that are data, and checks on dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


def rules(spark: SparkSession, product: str = "unsecured_business_loan") -> DataFrame:
    """The rule table with its order; a fixed, small dimension."""
    rows = [(n, *r) for n, r in enumerate(V.RULES) if r[1] == product]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, product string, slot string, operator string, value string, disposition string, reason string")


def holds(operator: Column, value: Column, actual: Column) -> Column:
    """Whether a rule holds for a slot's value; unreadable numbers and nulls never do."""
    said = F.lower(F.btrim(actual))
    number = lambda c: c.try_cast("double")
    low, high = number(F.split_part(value, F.lit("|"), F.lit(1))), number(F.split_part(value, F.lit("|"), F.lit(2)))
    n, v = number(actual), number(value)
    inside = (n >= low) & (n <= high)
    test = (
        F.when(operator == "in", F.array_contains(F.split(F.lower(value), r"\|"), said)).when(operator == "eq", said == F.lower(F.btrim(value)))
        .when(operator == "gte", n >= v).when(operator == "gt", n > v).when(operator == "lt", n < v).when(operator == "lte", n <= v)
        .when(operator == "between", inside).when(operator == "outside", ~inside)
    )
    return F.coalesce(test, F.lit(False))


def conflicts(slots: Column) -> Column:
    """Names of the arithmetic contradictions in a slot map."""
    n = lambda k: F.try_element_at(slots, F.lit(k)).try_cast("double")
    turnover, amount, vintage, emi = n("annual_turnover_inr"), n("loan_amount_inr"), n("business_vintage_months"), n("existing_emi_inr")
    some = lambda c: c.isNotNull() & (c != 0)
    return F.array_compact(
        F.array(
            F.when(some(turnover) & some(amount) & (amount > turnover), "requested_amount_exceeds_annual_turnover"),
            F.when(vintage > 600, "implausible_business_vintage"),
            F.when(some(turnover) & some(emi) & (emi * 12 > turnover), "existing_obligations_exceed_turnover"),
            F.when((F.try_element_at(slots, F.lit("gst_registered")) == "false") & (turnover > 4_000_000), "turnover_above_gst_threshold_but_not_registered"),
        )
    )


def qualify(applicants: DataFrame, rule_table: DataFrame) -> DataFrame:
    """applicant_id, disposition, reasons, rules, missing and conflicts of every slot map.

    A required slot that is absent makes the file incomplete; one that is present without a value
    leaves it decidable, but never as a pass.
    """
    required = T.strings(V.REQUIRED_SLOTS)
    value = lambda k: F.try_element_at("slots", k)
    said = applicants.select("applicant_id", F.explode_outer("slots").alias("slot", "actual"))
    fired = said.join(F.broadcast(rule_table), "slot").filter((F.coalesce("actual", F.lit("")) != "") & holds(F.col("operator"), F.col("value"), F.col("actual")))
    level = F.when(F.col("disposition") == "reject", 2).when(F.col("disposition") == "refer", 1).otherwise(0)
    fired = fired.groupBy("applicant_id").agg(F.array_sort(F.collect_list(F.struct("rule_no", level.alias("level"), "rule_id", "reason"))).alias("fired"))
    out = applicants.join(fired, "applicant_id", "left").withColumns(
        {
            "absent": F.filter(required, lambda s: ~F.map_contains_key("slots", s)),
            "unknown": F.filter(required, lambda s: F.map_contains_key("slots", s) & (F.coalesce(value(s), F.lit("")) == "")),
        }
    )
    top = F.coalesce(F.array_max(F.transform("fired", lambda r: r["level"])), F.lit(0))
    out = out.withColumn("top", top).withColumn("chosen", F.coalesce(F.filter("fired", lambda r: r["level"] == F.col("top")), F.filter("fired", lambda _: F.lit(False))))
    incomplete, demoted = F.size("absent") > 0, (F.col("top") == 0) & (F.size("unknown") > 0)
    none = F.array().cast("array<string>")
    names = lambda f: F.coalesce(F.transform("chosen", lambda r: r[f]), none)
    marks = F.when(demoted, F.transform("unknown", lambda s: F.concat(F.lit("UNVERIFIED_"), F.upper(s)))).otherwise(none)
    return out.select(
        "applicant_id",
        F.when(incomplete, "incomplete").when((F.col("top") == 1) | demoted, "refer").when(F.col("top") == 2, "reject").otherwise("pass").alias("disposition"),
        F.when(incomplete, none).otherwise(F.concat(names("reason"), marks)).alias("reasons"),
        F.when(incomplete, none).otherwise(names("rule_id")).alias("rules"),
        F.when(incomplete, F.col("absent")).otherwise(F.col("unknown")).alias("missing"),
        F.when(incomplete, none).otherwise(conflicts(F.col("slots"))).alias("conflicts"),
    )


def next_slot(slots: Column) -> Column:
    """The first slot in asking order that was never asked (null when all were)."""
    return F.get(F.filter(T.strings(V.ASK_ORDER), lambda s: ~F.map_contains_key(slots, s)), F.lit(0))


def streak(df: DataFrame, condition: Column, key: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: how many rows in a row, up to this one, meet the condition."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    island = F.sum(F.when(condition, 0).otherwise(1)).over(w)
    flagged = df.withColumn("_island", island).withColumn("_hit", condition.cast("int"))
    inside = W.partitionBy(key, "_island").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return flagged.withColumn(name, F.sum("_hit").over(inside).cast("long")).drop("_island", "_hit")


def escalation(intent: Column, sentiment: Column, text: Column, low_streak: Column, refusals: Column, unclear_streak: Column) -> Column:
    """The first trigger that applies, or null."""
    return (
        F.when(intent == "request_human", "explicit_request").when(F.lower(text).rlike(V.DISTRESS), "distress")
        .when((sentiment == "frustrated") & (low_streak >= 2), "distress").when(low_streak >= 3, "repeated_low_confidence")
        .when(refusals >= 2, "repeated_refusal").when(unclear_streak >= 3, "repeated_unclear")
    )


def callback_slot(now: Column) -> Column:
    """Two hours on, within 8 to 19 h: later moves to ten the next day, earlier to ten."""
    then = now + F.expr("interval 2 hours")
    day = F.date_trunc("day", then)
    slot = F.when(F.hour(then) >= 19, day + F.expr("interval 34 hours")).when(F.hour(then) < 8, day + F.expr("interval 10 hours")).otherwise(then)
    hour = F.when(F.hour(slot) % 12 == 0, 12).otherwise(F.hour(slot) % 12)
    return F.concat(F.date_format(slot, "EEEE"), F.lit(" at "), hour.cast("string"), F.when(F.hour(slot) < 12, " am").otherwise(" pm"))


def commitments(turns: DataFrame, deferrals: list[str], dates: list[str]) -> DataFrame:
    """call_id, soft_refusals and commitment from turns (call_id, seq, text, probed).

    A date counts only in the turn that answers the one probe, and only without a deferral in it.
    """
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.btrim("text")), r"\s+", " "), F.lit(" "))
    told = turns.withColumn("low", low)
    found = lambda xs: F.filter(T.strings(xs), lambda m: F.contains(F.col("low"), m))
    told = told.withColumn("deferred", found(deferrals)).withColumn("dated", found(dates))
    answer = F.when(F.col("probed") & (F.size("deferred") == 0), F.get("dated", F.lit(0)))
    per = told.withColumn("answer", answer).groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "deferred"))).alias("all"), F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("seq"))).alias("commitment")
    )
    said = F.array_distinct(F.flatten(F.transform("all", lambda x: x["deferred"])))
    outcome = F.when((F.size("soft_refusals") > 0) & F.col("commitment").isNull(), "no_commitment").otherwise("")
    return per.select("call_id", said.alias("soft_refusals"), "commitment").withColumn("outcome", outcome)


def unsupported_numbers(answer: Column, sources: Column, lenient: bool = False) -> Column:
    """Numbers of the answer that do not occur in its sources (1, 2 and 3 claim nothing)."""
    plain = F.replace(sources, F.lit(","), F.lit(""))
    token = lambda x: F.replace(x, F.lit(","), F.lit(""))

    def bad(x: Column) -> Column:
        missing = ~token(x).isin(V.SAFE_NUMBERS) & ~F.contains(plain, token(x))
        if lenient:
            short = F.rtrim(F.rtrim(token(x), F.lit("0")), F.lit("."))
            missing = missing & ~((short != "") & F.contains(plain, short))
        return missing

    return F.filter(F.regexp_extract_all(answer, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), bad)


def grounded(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Adds unsupported, cited and answered: numbers must be in the sources and a cited id among the hits."""
    df = df.withColumn("unsupported", unsupported_numbers(F.col("answer"), F.col("sources"), lenient))
    df = df.withColumn("cited", F.array_intersect("used_ids", "hit_ids"))
    return df.withColumn("answered", (F.size("unsupported") == 0) & (F.size("cited") > 0))
