"""Labels, locators, titles and merges of records; disclosures and checks of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


def record_id(doc_id: Column, number: Column) -> Column:
    """The document's id and the chunk's number, of three digits at least."""
    return F.concat(doc_id.cast("string"), F.lit("__"), F.format_string("%03d", number))


def source_label(source_type: Column, url: Column, path: Column, title: Column) -> Column:
    """How a record names its source, by the kind of it."""
    site, pdf = (F.lit(V.SOURCE_LABELS[k]) for k in ("website", "website_pdf"))
    return (
        F.when(source_type == "website", F.concat(site, F.coalesce(url, F.lit(""))))
        .when(source_type == "website_pdf", F.concat(pdf, F.coalesce(F.nullif(url, F.lit("")), path, F.lit(""))))
        .otherwise(F.concat(F.lit(V.OTHER_SOURCE_LABEL), F.coalesce(title, F.lit(""))))
    )


def skip_reason(flag: Column, text: Column) -> Column:
    """Why a document is left out: a missing page, a failed extraction or no text; null for all others."""
    blank = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")) == ""
    return F.when(flag.isin("soft_404", "extraction_failed"), flag).when(blank, F.coalesce(F.nullif(flag, F.lit("")), F.lit("empty")))


def kept_and_skipped(documents: DataFrame, flag: str = "quality_flag", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents to build from, and those left out with a reason."""
    told = documents.withColumn("reason", skip_reason(F.col(flag), F.col(text)))
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def with_fallback(records: DataFrame, assigned: DataFrame, allowed: list[str]) -> DataFrame:
    """Categories that rules left open, taken from a model's cached answers (record_id, category).

    Only allowed names count; what has no answer, or another name, stays unclassified.
    """
    known = assigned.filter(F.col("category").isin(*allowed)).groupBy("record_id").agg(F.max("category").alias("told"))
    told = F.when(F.col("category") == "unclassified", F.coalesce("told", F.lit("unclassified"))).otherwise(F.col("category"))
    return records.join(known, "record_id", "left").withColumn("category", told).drop("told")


def record_title(title: Column, slug: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.replace(slug, F.lit("__"), F.lit(" / ")))


def pdf_title(text: Column) -> Column:
    """The first line of 8 to 90 characters that does not name a page; "" without one."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x))
    good = F.filter(lines, lambda x: F.length(x).between(8, 90) & ~F.lower(x).startswith("page "))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def extraction_flag(pages: Column) -> Column:
    """extraction_failed if no page has text, partial if some have none, truncated_source if the text says so."""
    empty = F.size(F.filter(pages, lambda p: F.btrim(F.coalesce(p, F.lit(""))) == ""))
    cut = F.exists(pages, lambda p: F.coalesce(F.contains(F.lower(p), F.lit("[text truncated")), F.lit(False)))
    return F.when(empty == F.size(pages), "extraction_failed").when(empty > 0, "partial_extraction").when(cut, "truncated_source").otherwise("")


def locator(heading: Column, chunk: Column | None = None) -> Column:
    """"page n" for a page heading, else the section's name, else the chunk's number (if told)."""
    n = F.regexp_extract(heading, r"^Page (\d+)$", 1)
    plain = F.lit("") if chunk is None else F.concat(F.lit("chunk "), chunk.cast("string"))
    return F.when(n != "", F.concat(F.lit("page "), n)).when(heading == "", plain).otherwise(F.concat(F.lit("section: "), heading))


def page_record_title(doc_title: Column, heading: Column, content: Column) -> Column:
    """A page's record is titled by the document and its first telling line, if it has one; others by their heading."""
    told = F.get(F.filter(F.split(content, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" #|-"))) > 12), F.lit(0))
    first = F.substring(T.clean_heading(F.btrim(told, F.lit(" #|-"))), 1, 70)
    paged = F.when(first.isNotNull(), F.concat(doc_title, F.lit(" - "), first)).otherwise(doc_title)
    return F.when(heading.rlike(r"^Page \d+$"), paged).otherwise(F.coalesce(F.nullif(heading, F.lit("")), doc_title))


def citation(title: Column, locator_: Column, url: Column, source: Column) -> Column:
    parts = F.array(title, locator_, F.coalesce(F.nullif(url, F.lit("")), source))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " | ")


def source_block(hits: DataFrame, longest: int = 1200) -> DataFrame:
    """q_id and the block of its hits as "[id] title", then the content, in rank order."""
    part = F.concat(F.lit("["), F.col("record_id"), F.lit("] "), F.col("title"), F.lit("\n"), F.substring("content", 1, longest))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits.groupBy("q_id").agg(F.array_join(F.transform(rows, lambda x: x["part"]), "\n\n").alias("block"))


def merge_ok(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win, except that an earlier success stays where the new row failed (columns ok, value)."""
    left, right = old.select(*keys, F.struct("ok", "value").alias("o")), new.select(*keys, F.struct("ok", "value").alias("n"))
    both = left.join(right, keys, "full_outer")
    keep_old = F.col("n").isNull() | (F.coalesce(F.col("o.ok"), F.lit(False)) & ~F.coalesce(F.col("n.ok"), F.lit(False)))
    kept = F.when(keep_old, F.col("o")).otherwise(F.col("n"))
    return both.select(*keys, kept["ok"].alias("ok"), kept["value"].alias("value"))


def nudge_text(kind: Column, detail: Column) -> Column:
    templates = F.create_map(*[F.lit(x) for k, (_, _, t) in V.NUDGES.items() for x in (k, t)])
    return T.fill_template(F.coalesce(F.try_element_at(templates, kind), F.lit("{detail}")), detail)


def model_signals(turns: DataFrame, debounce: float = 6.0, most: int = 5, least: float = 0.5) -> DataFrame:
    """A model's signals (call_id, at, kind, confidence): asked at most every ``debounce`` seconds, the
    best ``most`` of each asking, confidences of ``least`` or more, at most 1.

    Whether an asking happens depends on the last one that did, so it is a fold over a call's times.
    """
    times = turns.groupBy("call_id").agg(F.array_sort(F.collect_set("at")).alias("times"))
    start = F.struct(F.lit(-1e18).alias("last"), F.array().cast("array<double>").alias("kept"))
    fold = F.aggregate(
        "times", start,
        lambda a, t: F.when(t - a["last"] >= debounce, F.struct(t.alias("last"), F.concat(a["kept"], F.array(t)).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    asked = times.select("call_id", F.explode(fold).alias("at"))
    rows = turns.join(asked, ["call_id", "at"]).filter(F.col("confidence") >= least)
    place = F.row_number().over(W.partitionBy("call_id", "at").orderBy(F.desc("confidence"), "kind"))
    return rows.withColumn("n", place).filter(F.col("n") <= most).select("call_id", "at", "kind", F.least(F.lit(1.0), "confidence").alias("confidence"))


def heard(segments: DataFrame, languages: list[str]) -> DataFrame:
    """Segments in an expected language; an unknown one passes."""
    tag = F.lower(F.coalesce("language", F.lit("")))
    return segments.filter(tag.isin("", "unknown", *languages))


def pending_disclosures(required: DataFrame, given: DataFrame) -> DataFrame:
    """Required disclosures (call_id, disclosure) that a call has not given yet."""
    return required.join(given, ["call_id", "disclosure"], "left_anti")


def segment_latency(segments: DataFrame) -> DataFrame:
    """Recogniser and end-to-end latency in milliseconds from event timestamps."""
    ms = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1000
    return segments.select("call_id", "seq", ms("audio_end_ts", "transcribed_ts").alias("asr_ms"), ms("audio_end_ts", "delivered_ts").alias("end_to_end_ms"))
