"""Latency and error-rate metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def latency(samples: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """n, min, p50, p95, max and mean of each group, with linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.round(p[0], 6).alias("p50"), F.round(p[1], 6).alias("p95"), F.max(value).alias("max"), F.round(F.avg(value), 3).alias("mean")
    )


def merged(*samples: DataFrame) -> DataFrame:
    """The samples of several collectors as one table."""
    out = samples[0]
    for more in samples[1:]:
        out = out.unionByName(more)
    return out


def pooled(summaries: DataFrame, by: list[str]) -> DataFrame:
    """``latency`` of groups of which only summaries are left (n, min, p50, p95, max): an approximation.

    Each summary stands for max(1, n // 2) samples at its median, max(1, n // 4) at its 95th
    percentile, and its extremes.  Where the samples are at hand, ``latency`` of all is exact.
    """
    times = lambda c, n: F.array_repeat(F.col(c).cast("double"), F.greatest(F.lit(1), F.floor(F.col("n") / n)).cast("int"))
    ends = F.array(F.col("min").cast("double"), F.col("max").cast("double"))
    return latency(summaries.select(*by, F.explode(F.concat(times("p50", 2), times("p95", 4), ends)).alias("ms")), by)


def spoken_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")


#: The first sign that a word stands for in ``edit_distance``; all signs from here on are one character each.
_FIRST_SIGN = 0x10000


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word arrays.

    Each distinct word of the two becomes one sign, so that the distance of strings, which runs in
    compiled code with two rows of the table, is that of the words.  There are a million signs, more than
    words whose table could be worked through; beyond them the distance is an error, not a guess.
    """
    sign = lambda place: F.decode(F.unhex(F.lpad(F.hex(place - 1 + _FIRST_SIGN), 8, "0")), "UTF-32")
    places = lambda names: F.map_from_entries(F.transform(names, lambda w, n: F.struct(w.alias("w"), sign(n + 1).alias("sign"))))
    signs = lambda words, of: F.array_join(F.transform(words, lambda w: F.element_at(of, w)), "")

    def distance(names: Column) -> Column:
        told = T.once(places(names), lambda of: F.levenshtein(signs(a, of), signs(b, of)))
        return F.when(F.size(names) <= 0x110000 - _FIRST_SIGN, told).otherwise(F.raise_error(F.lit("more than a million distinct words")).cast("int"))

    # the words' names are gathered once, not again for each word; equal arrays need no table
    return F.when(a == b, F.lit(0)).otherwise(T.once(F.array_distinct(F.concat(a, b)), distance))


def word_errors(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Adds wer (to six places; 1 or 0 for an empty reference) and lost_words (repeats kept)."""
    df = pairs.withColumn("_ref", spoken_words(F.col(reference))).withColumn("_hyp", spoken_words(F.col(hypothesis)))
    wer = F.when(F.size("_ref") == 0, F.when(F.size("_hyp") == 0, 0.0).otherwise(1.0)).otherwise(F.round(edit_distance(F.col("_ref"), F.col("_hyp")) / F.size("_ref"), 6))
    return df.withColumn("wer", wer).withColumn("lost_words", F.filter("_ref", lambda w: ~F.array_contains("_hyp", w))).drop("_ref", "_hyp")
