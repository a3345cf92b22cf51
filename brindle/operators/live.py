"""Signals in calls, and the suppression that decides which of them an agent sees.

Signal detection is column expressions, the same on a batch and on a stream.  Suppression is one
pure fold per call (``Suppressor``), used by a grouped map on batches and by keyed state on
streams, so both give the same outcomes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..shipping import ship
from .records import nudge_text

SIGNAL = "struct<kind: string, detail: string, confidence: double, evidence: string>"


def pattern(items: Iterable[str]) -> str:
    return r"\b(" + "|".join(items) + r")\b"


def _cue(low: Column, items, kind: str, detail: str, confidence: float) -> Column:
    evidence = F.regexp_extract(low, pattern(items), 0)
    return F.when(evidence != "", F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), F.lit(confidence).alias("confidence"), evidence.alias("evidence")))


def turn_signals(speaker: Column, text: Column) -> Column:
    """The signals of one turn: one per family of a customer's cues, one per risky phrase of an agent."""
    low = F.lower(text)
    cues = [_cue(low, words, "missed_cross_sell", name, 0.75) for name, words in V.CROSS_SELL.items()]
    cues += [_cue(low, words, kind, kind, confidence) for kind, (confidence, words) in V.CUSTOMER_CUES.items()]
    risky = F.regexp_extract_all(low, F.lit(pattern(V.RISKY_STATEMENTS)), F.lit(0))
    said = F.transform(risky, lambda m: F.struct(F.lit("risky_statement").alias("kind"), F.lit("risky_statement").alias("detail"), F.lit(0.9).alias("confidence"), m.alias("evidence")))
    return F.when(speaker == "agent", said).otherwise(F.array_compact(F.array(*cues))).cast(f"array<{SIGNAL}>")


def signals(turns: DataFrame) -> DataFrame:
    """turns (call_id, seq, speaker, text, call_time_s) to one row per signal."""
    return turns.select("call_id", "seq", "call_time_s", F.explode(turn_signals(F.col("speaker"), F.col("text"))).alias("s")).select("call_id", "seq", "call_time_s", "s.*")


def repeated_questions(turns: DataFrame) -> DataFrame:
    """Customer turns that say what the two customer turns before them said."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""), r"\s+", " "))
    said = turns.filter("speaker = 'customer'").withColumn("plain", plain)
    w = W.partitionBy("call_id").orderBy("seq")
    same = (F.col("plain") != "") & (F.lag("plain", 1).over(w) == F.col("plain")) & (F.lag("plain", 2).over(w) == F.col("plain"))
    return said.withColumn("same", same).filter("same").select("call_id", "seq")


def compliance(turns: DataFrame, require_payment: bool = False) -> DataFrame:
    """call_id, item, said_at and gap: whether an agent said each required item by its deadline.

    Every call is swept at its end, so an item never said is a gap whatever the call's length.
    """
    items = [i for i in V.CHECKLIST if require_payment or i[0] != "no_payment_disclosure"]
    low = F.lower("text")
    said = [F.min(F.when((F.col("speaker") == "agent") & low.rlike(pattern(words)), F.col("call_time_s"))).alias(name) for name, _, words in items]
    per = turns.groupBy("call_id").agg(*said)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("said_at"), F.lit(d).alias("deadline")) for n, d, _ in items])).alias("i")
    out = per.select("call_id", rows).select("call_id", "i.*")
    return out.select("call_id", "item", "said_at", (F.col("said_at").isNull() | (F.col("said_at") >= F.col("deadline"))).alias("gap"))


class Suppressor:
    """What one call's agent is shown: each signal in event time has the first outcome that holds for it.

    The state is what was shown (marks of rendered texts), when each topic group is free again, and the
    screen as (priority, end of showing, kind).  What leaves the screen is told once: evicted for a more
    important text, or expired at its end.
    """

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.shown: set[str] = set(state.get("shown", ()))
        self.free: dict[str, float] = dict(state.get("free", {}))
        self.screen: list[tuple[int, float, str]] = [tuple(x) for x in state.get("screen", ())]
        self.left: list[tuple[str, str, float]] = []

    def state(self) -> dict:
        return {"shown": sorted(self.shown), "free": self.free, "screen": self.screen}

    def expire(self, now: float) -> None:
        """Takes from the screen what has been shown for its time."""
        self.left += [(kind, "expired", end) for _, end, kind in self.screen if end <= now]
        self.screen = [x for x in self.screen if x[1] > now]

    def take_left(self) -> list[tuple[str, str, float]]:
        """(kind, evicted or expired, at) of what left the screen since this was last asked."""
        out, self.left = self.left, []
        return out

    def decide(self, kind: str, text: str, confidence: float, now: float) -> str:
        """``text`` is the rendered text: two signals that would show the same words are duplicates."""
        priority, group, _ = V.NUDGES.get(kind, (5, kind, ""))
        mark = hashlib.md5(f"{kind}|{' '.join(text.lower().split())}".encode()).hexdigest()[:12]
        self.expire(now)
        # least important first, and of equal ones the earliest
        self.screen.sort(key=lambda x: (-x[0], x[1]))
        full = len(self.screen) >= V.MAX_ACTIVE
        tests = {
            "low_confidence": confidence < max(V.CONFIDENCE_FLOOR, V.KIND_FLOORS.get(kind, 0.0)),
            "duplicate": mark in self.shown,
            "cooldown": now < self.free.get(group, -math.inf),
            "screen_full": full and priority >= self.screen[0][0],
        }
        outcome = next((name for name, holds in tests.items() if holds), "emitted")
        if outcome == "emitted":
            self.left += [(x[2], "evicted", now) for x in self.screen[: int(full)]]
            self.screen = [*self.screen[int(full) :], (priority, now + V.TIME_TO_LIVE_S, kind)]
            self.free[group] = now + V.COOLDOWN_S
            self.shown.add(mark)
        return outcome


ORDER = ["at", "seq", "kind", "text"]


def rendered(rows: DataFrame) -> DataFrame:
    """Signals with the text that an agent would be shown."""
    return rows.withColumn("text", F.coalesce(nudge_text(F.col("kind"), F.coalesce("detail", F.lit(""))), F.lit("")))


def decide_all(fold: Suppressor, pdf: pd.DataFrame) -> list[str]:
    """The outcomes of signals in ``ORDER``."""
    return [fold.decide(*row) for row in zip(pdf["kind"], pdf["text"], pdf["confidence"], pdf["at"])]


def suppress(rows: DataFrame) -> DataFrame:
    """call_id, seq, kind and outcome of every signal (call_id, seq, kind, detail, confidence, at)."""
    ship(rows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER, kind="stable")
        return pdf.assign(outcome=decide_all(Suppressor(), pdf))[["call_id", "seq", "kind", "outcome"]]

    return rendered(rows).groupBy("call_id").applyInPandas(run, "call_id long, seq long, kind string, outcome string")


def screen_exits(rows: DataFrame) -> DataFrame:
    """call_id, kind, reason and at of every text that left the screen by the time of its call's last signal: evicted or expired."""
    ship(rows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = Suppressor()
        decide_all(fold, pdf.sort_values(ORDER, kind="stable"))
        return pd.DataFrame([(pdf["call_id"].iloc[0], *gone) for gone in fold.take_left()], columns=["call_id", "kind", "reason", "at"])

    return rendered(rows).groupBy("call_id").applyInPandas(run, "call_id long, kind string, reason string, at double")


def engine_report(outcomes: DataFrame, exits: DataFrame) -> DataFrame:
    """One row: signals considered, the six counters of the screen, and the share suppressed in percent."""
    n = lambda c, *names: F.sum(F.col(c).isin(*names).cast("int")).cast("long")
    decided = outcomes.agg(F.count("*").alias("considered"), n("outcome", "emitted").alias("emitted"), n("outcome", "low_confidence").alias("below_threshold"), n("outcome", "duplicate").alias("duplicate"), n("outcome", "cooldown", "screen_full").alias("cooldown"))
    gone = exits.agg(F.coalesce(n("reason", "evicted"), F.lit(0)).alias("evicted"), F.coalesce(n("reason", "expired"), F.lit(0)).alias("expired"))
    rate = F.round(100 * (F.col("considered") - F.col("emitted")) / F.greatest(F.lit(1), F.col("considered")), 1).alias("suppression_rate_pct")
    return decided.crossJoin(gone).select("*", rate)  # one row each


def suppression_report(outcomes: DataFrame) -> DataFrame:
    """Counts per outcome, and the share suppressed; a full screen counts as cooldown too."""
    n = lambda *names: F.sum(F.col("outcome").isin(*names).cast("int")).cast("long")
    return outcomes.agg(
        F.count("*").alias("considered"), n("emitted").alias("emitted"), n("low_confidence").alias("low_confidence"), n("duplicate").alias("duplicate"),
        n("cooldown", "screen_full").alias("cooldown"), n("screen_full").alias("screen_full"), F.round(1 - n("emitted") / F.count("*"), 6).alias("suppression_rate"),
    )


def score_calls(outcomes: DataFrame, truth: DataFrame) -> DataFrame:
    """Expected, missed, forbidden and unexpected kinds of each call against what was shown."""
    shown = outcomes.filter("outcome = 'emitted'").groupBy("call_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("n"))
    both = truth.join(shown, "call_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>"))).withColumn("n", F.coalesce("n", F.lit(0)))
    both = both.withColumn("missed", F.array_sort(F.array_except("expected", "kinds"))).withColumn("forbidden_shown", F.array_sort(F.array_intersect("forbidden", "kinds")))
    both = both.withColumn("unexpected", F.array_sort(F.array_except("kinds", "expected")))
    ok = (F.size("missed") == 0) & (F.size("forbidden_shown") == 0) & (F.col("n") <= F.col("max_nudges"))
    return both.select("call_id", "missed", "forbidden_shown", "unexpected", ok.alias("passed"))


# How speech is told from noise; times in milliseconds, levels as a share of full scale.
FLOOR_START, FLOOR_LEAST, FLOOR_MOST, FLOOR_PLACE, FLOOR_LEVELS = 0.008, 0.004, 0.060, 0.15, 60
SPEECH_LEVEL, SPEECH_RATIO, SPEECH_SHARE, SPEECH_BEGINS, PREROLL_MS = 0.010, 3.0, 0.08, 250.0, 300.0
#: Of segments on a live call: silence that ends one, its longest and shortest.
SEGMENT = {"hangover": 800.0, "longest": 20_000.0, "shortest": 400.0}


class VoiceActivity:
    """Speech in one channel's levels, one after another in time order; its state is small and goes into JSON.

    A level counts as speech if it is above three times the noise floor and 0.010.  The floor, read before the
    level moves it, is the 15th percentile of the last 60 levels, at least half of them, within 0.004 to 0.060; it
    rises by 1.5 times plus 0.0001 at most and falls freely.  A segment begins once 250 ms were loud, with the
    300 ms before it, and ends after ``hangover`` of silence, which it includes, or when it reaches ``longest``;
    a voice that goes on after that is heard again only after a silence.  Segments under ``shortest``, and those
    of which less than 8 % is at 0.010 or more, are no speech.
    """

    def __init__(self, hangover: float, longest: float, shortest: float, state: dict | None = None):
        self.hangover, self.longest, self.shortest = hangover, longest, shortest
        self.now = state or {"recent": [], "floor": FLOOR_START, "speaking": False, "loud": 0.0, "quiet": 0.0, "before": [], "held": None}

    def _above(self, level: float) -> bool:
        """Whether a level is above the threshold; then it moves the floor."""
        now = self.now
        above = level > max(now["floor"] * SPEECH_RATIO, SPEECH_LEVEL)
        now["recent"] = [*now["recent"], level][-FLOOR_LEVELS:]
        n = len(now["recent"])
        if 2 * n >= FLOOR_LEVELS:
            target = min(max(sorted(now["recent"])[int(n * FLOOR_PLACE)], FLOOR_LEAST), FLOOR_MOST)
            now["floor"] = min(target, now["floor"] * 1.5 + 1e-4) if target > now["floor"] else target
        return above

    def hear(self, ms: float, level: float, width: float) -> tuple[float, float] | None:
        """(start, end) of a segment that this level completes."""
        now, before = self.now, self.now["speaking"]
        if self._above(level):
            now["loud"], now["quiet"] = now["loud"] + width, 0.0
            now["speaking"] = before or now["loud"] >= SPEECH_BEGINS
        else:
            now["quiet"] += width
            now["speaking"] = before and now["quiet"] < self.hangover
            now["loud"] = now["loud"] if now["speaking"] else 0.0
        piece = [width, width if level >= SPEECH_LEVEL else 0.0]
        if now["speaking"] and not before:
            lead = sum(w for w, _ in now["before"])
            now["held"] = [ms - lead, ms, lead, sum(v for _, v in now["before"])]
        if now["held"] is None:
            now["before"] = self._tail([*now["before"], piece])
            return None
        start, _, length, voiced = now["held"]
        now["held"] = [start, ms + width, length + piece[0], voiced + piece[1]]
        over = before and not now["speaking"]
        return self.taken() if over or self.full(length + width) else None

    def full(self, length: float) -> bool:
        return length >= self.longest

    @staticmethod
    def _tail(pieces: list) -> list:
        """The last 300 ms of the pieces, the first of them cut."""
        out, room = [], PREROLL_MS
        for width, voiced in reversed(pieces):
            if room > 0:
                share = min(width, room)
                out.insert(0, [share, voiced and share])
                room -= share
        return out

    def taken(self) -> tuple[float, float] | None:
        """The segment held, if it is speech; a call's end takes it as it is."""
        held = self.now["held"]
        self.now["held"], self.now["before"] = None, []
        if held is None:
            return None
        start, end, length, voiced = held
        return (start, end) if length >= self.shortest and voiced / length >= SPEECH_SHARE else None


def voiced_segments(levels: pd.DataFrame, voice: VoiceActivity, at_end: bool = True) -> Iterator[tuple[float, float]]:
    """(start, end) of speech in one channel's levels (ms, rms, chunk_ms), in time order; ``at_end``: the open one too."""
    found = [voice.hear(*row) for row in zip(levels["ms"], levels["rms"], levels["chunk_ms"])]
    return filter(None, [*found, voice.taken() if at_end else None])


def segments(levels: DataFrame) -> DataFrame:
    """call_id, start_ms, end_ms of the speech in each call's levels (call_id, ms, rms, chunk_ms); a call's end ends its last."""
    ship(levels.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = voiced_segments(pdf.sort_values("ms"), VoiceActivity(**SEGMENT))
        return pd.DataFrame([(int(pdf["call_id"].iloc[0]), a, b) for a, b in found], columns=["call_id", "start_ms", "end_ms"])

    return levels.groupBy("call_id").applyInPandas(run, "call_id long, start_ms double, end_ms double")
