"""Building records from ``documents``: normalising, skipping, labelling, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import corpus, metrics, records
from .registry import query, sql_list, table


def sql_rewrite(text: str, pattern: str, made: str) -> str:
    """DuckDB: ``text`` with every match m of ``pattern`` replaced by ``made``, or kept where that is null."""
    return f"""array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'), list_transform(regexp_extract_all({text}, '{pattern}'), lambda m: coalesce({made}, m))), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"""


_P = V.DATE_PATTERNS
_MONTH = "case lower(left({0}, 3)) " + " ".join(f"when '{m[:3]}' then '{n}'" for n, m in enumerate(T.MONTHS, 1)) + " end"
_NAMED = f"(length({{0}}) = 3 or list_contains({sql_list(T.MONTHS)}, lower({{0}})))"


def _sql_iso(kind: str) -> str:
    group = lambda n: f"regexp_extract(m, '{_P[kind]}', {n})"
    y, m, d = {"dmy": (3, 2, 1), "ymd": (1, 2, 3), "mdy": (3, 1, 2), "dmonthy": (3, 2, 1)}[kind]
    month = group(m)
    if kind in ("mdy", "dmonthy"):
        month = f"case when {_NAMED.format(group(m))} then {_MONTH.format(group(m))} end"
    return f"strftime(try_cast({group(y)} || '-' || lpad({month}, 2, '0') || '-' || lpad({group(d)}, 2, '0') as date), '%Y-%m-%d')"


def _count(text: str, kind: str) -> str:
    return f"len(list_filter(regexp_extract_all({text}, '{_P[kind]}'), lambda m: {_sql_iso(kind)} is not null))"


_SUFFIXES = [" From 01-04-2026 to 2025/10/15.", " Since April 1, 2026 or 3rd Jun 2027; not 31-02-2026.", " Due 7/8/2025, not May 45, 2026.", ""]
_DATED = f"(select doc_id, coalesce(text, '') || {sql_list(_SUFFIXES)}[1 + doc_id % 4] as t0 from documents)"


@query(f"""with a as (select doc_id, {sql_rewrite('t0', _P['dmy'], _sql_iso('dmy'))} as t1 from {_DATED}), b as (select doc_id, {_count('t1', 'ymd')} as n1, {sql_rewrite('t1', _P['ymd'], _sql_iso('ymd'))} as t2 from a),
c as (select doc_id, n1 + {_count('t2', 'mdy')} as n2, {sql_rewrite('t2', _P['mdy'], _sql_iso('mdy'))} as t3 from b)
select doc_id, (n2 + {_count('t3', 'dmonthy')})::bigint as dates, md5({sql_rewrite('t3', _P['dmonthy'], _sql_iso('dmonthy'))}) as text_md5 from c""")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each with a sentence that holds dates."""
    text = F.concat(F.coalesce("text", F.lit("")), F.element_at(T.strings(_SUFFIXES), (F.col("doc_id") % 4 + 1).cast("int")))
    rows = T.with_iso_dates(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text", "dates")
    return rows.select("doc_id", "dates", F.md5("text").alias("text_md5"))


_MONEY = [" Pay Rs. 50 lakh or INR 2.5 Cr now.", " Fees of Rs 1,500 and ₹2500 apply.", " In 2024 we had 3000 customers.", " Rs 12,00,000, then rs.3 crore"]
_MONEY_TOLD = [" Pay Rs. 50 lakh (INR 5000000) or INR 2.5 Cr (INR 25000000) now.", " Fees of Rs 1,500 (INR 1500) and ₹2500 (INR 2500) apply.", " In 2024 we had 3000 customers.", " Rs 12,00,000, (INR 1200000) then rs.3 crore (INR 30000000)"]


@query(f"""select doc_id, [2, 2, 0, 2][1 + doc_id % 4]::bigint as amounts, md5(coalesce(text, '') || {sql_list(_MONEY_TOLD)}[1 + doc_id % 4]) as text_md5 from documents""")
def document_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each with a sentence about money; the texts themselves name no rupees."""
    text = F.concat(F.coalesce("text", F.lit("")), F.element_at(T.strings(_MONEY), (F.col("doc_id") % 4 + 1).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", T.amounts_in(F.col("text")).alias("amounts"), F.md5(T.annotate_amounts(F.col("text"))).alias("text_md5"))


_TERM_CASES = ", ".join(f"case when regexp_matches(s, '{T.alternation(a)}') then '{k}' end" for k, a in V.TERMS.items())


@query(f"select doc_id, list_filter([{_TERM_CASES}], lambda x: x is not null) as terms from (select doc_id, lower(coalesce(text, '')) as s from documents)")
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.canonical_terms(F.coalesce("text", F.lit(""))).alias("terms"))


_HITS = lambda ks: " + ".join(f"contains(b, '{k}')::int" for k in ks)
_CATEGORY = " ".join(
    "when contains(heading, '?') then 'faq'" if name == "faq" else f"when ({_HITS(ks)}) >= 2 or (({_HITS(ks)}) = 1 and length(b) < 400) then '{name}'" for name, ks in V.CATEGORIES.items()
)
_PRODUCT = "[" + ", ".join(f"{{'n': {_HITS(ks)}, 't': {-i}, 'name': '{name}'}}" for i, (name, ks) in enumerate(V.PRODUCTS.items())) + "]"
_ASKED = "select doc_id, case when doc_id % 9 = 0 then 'What is it?' else source end as heading, lang, lower(coalesce(heading, '') || E'\\n' || coalesce(text, '')) as b from documents"


@query(f"""select doc_id, case when lang = 'es' then 'lead_record' {_CATEGORY} else 'unclassified' end as category, case when (list_sort({_PRODUCT}, 'DESC')[1]).n > 0 then (list_sort({_PRODUCT}, 'DESC')[1]).name else '' end as product from ({_ASKED})""")
def document_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and product keywords over whole texts, headed by their source (or a question)."""
    heading = F.coalesce(F.when(F.col("doc_id") % 9 == 0, "What is it?").otherwise(F.col("source")), F.lit(""))
    kind, text = F.when(F.col("lang") == "es", "crm_export").otherwise("website"), F.coalesce("text", F.lit(""))
    category = corpus.category(heading, text, kind, F.lit("x"))
    return table(spark, sf_dir, "documents").select("doc_id", category.alias("category"), corpus.product(F.concat(heading, F.lit("\n"), text)).alias("product"))


_FLAGS = ["", "thin_content", "soft_404", "extraction_failed", "partial_extraction"]
_SQL_FLAG = f"{sql_list(_FLAGS)}[1 + doc_id % {len(_FLAGS)}]"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 3, F.lit(" \n")).otherwise(F.col("text"))
    flag = F.element_at(T.strings(_FLAGS), (F.col("doc_id") % len(_FLAGS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), flag.alias("quality_flag"), "lang", "source")


_SQL_SKIPPED = f"""(select *, case when flag in ('soft_404', 'extraction_failed') then flag when trim(coalesce(body, ''), E' \\t\\n\\r') = '' then case when flag = '' then 'empty' else flag end end as reason
 from (select *, {_SQL_FLAG} as flag, case when doc_id % 7 = 3 then E' \\n' else text end as body from documents))"""


@query(f"select doc_id, reason from {_SQL_SKIPPED} where reason is not null")
def skipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.kept_and_skipped(_flagged(spark, sf_dir))[1].select("doc_id", "reason")


@query(f"select doc_id, flag from {_SQL_SKIPPED} where reason is null")
def kept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin, partial and truncated documents stay."""
    return records.kept_and_skipped(_flagged(spark, sf_dir))[0].select("doc_id", F.col("quality_flag").alias("flag"))


@query(f"""select page_id, case page_id % 3 when 0 then 'website: ' || url when 1 then 'published PDF: ' || case when page_id % 2 = 0 then url else '/files/' || page_id end else '{V.OTHER_SOURCE_LABEL}' || 'T' || page_id end as label from pages""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    kind = F.element_at(T.strings(["website", "website_pdf", "internal_handbook"]), (i % 3 + 1).cast("int"))
    url = F.when((i % 3 == 1) & (i % 2 == 1), "").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", records.source_label(kind, url, F.concat(F.lit("/files/"), i.cast("string")), F.concat(F.lit("T"), i.cast("string"))).alias("label"))


_ALLOWED = ["product", "policy", "unclassified"]


@query("""select doc_id, case when lang <> 'en' then lang when doc_id % 3 = 0 then 'unclassified' when doc_id % 4 = 0 then 'product' when doc_id % 4 = 1 then 'policy' else 'unclassified' end as category from documents""")
def category_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers for two thirds of the documents; one answer in four is no category."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    told = F.element_at(T.strings(["product", "policy", "poetry", "unclassified"]), (i % 4 + 1).cast("int"))
    assigned = docs.filter(i % 3 != 0).select(i.alias("record_id"), told.alias("category"))
    rows = docs.select(i.alias("record_id"), F.when(F.col("lang") == "en", "unclassified").otherwise(F.col("lang")).alias("category"))
    return records.with_fallback(rows, assigned, _ALLOWED).select(F.col("record_id").alias("doc_id"), "category")


@query("select l_orderkey, l_linenumber, l_orderkey || '__' || case when l_partkey < 1000 then lpad(l_partkey::varchar, 3, '0') else l_partkey::varchar end as record_id from lineitem")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", records.record_id(F.col("l_orderkey"), F.col("l_partkey")).alias("record_id"))


@query("select doc_id, greatest(1, length(coalesce(text, '')) // 4)::bigint as tokens from documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


_MAIL = V.PII_PATTERNS["email"]


@query(f"""select count(*) as documents_in, count(reason) as documents_skipped, count(*) filter (reason is null) as records, count(*) filter (reason is null and regexp_matches(body, '{_MAIL}')) as pii_records,
 (sum(case when reason is null then [2, 2, 0, 2][1 + doc_id % 4] else 0 end))::bigint as amounts_annotated, to_json(map_from_entries(list_sort(list((l, n)) filter (l is not null and n > 0)))) as languages
from (select *, count(*) filter (reason is null) over (partition by lang) as n, case when row_number() over (partition by lang order by doc_id) = 1 then lang end as l from {_SQL_SKIPPED})""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about a build: what came in, what was left out, what was found and changed."""
    priced = F.concat("text", F.element_at(T.strings(_MONEY), (F.col("doc_id") % 4 + 1).cast("int")))
    docs = _flagged(spark, sf_dir).withColumn("priced", priced)
    return corpus.build_report(docs, "quality_flag", "text", "priced", "lang")


_GAPS = """(select event_type, user_id % 5 as run, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000.0::double as ms from events)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000.0
    return table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("run"), gap.alias("ms")).filter("ms is not null")


@query(f"""select event_type, count(*) as n, min(ms) as min, round(quantile_cont(ms, 0.5), 6) as p50, round(quantile_cont(ms, 0.95), 6) as p95, max(ms) as max, round(avg(ms), 3) as mean
from (select event_type, ms from {_GAPS} where ms is not null union all select event_type, ms * 2 from {_GAPS} where run = 1 and ms is not null) group by 1""")
def merged_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two collectors in one summary."""
    one = _gaps(spark, sf_dir)
    return metrics.latency(metrics.merged(one.drop("run"), one.filter("run = 1").select("event_type", (F.col("ms") * 2).alias("ms"))), ["event_type"])


@query(f"""with s as (select event_type, run, count(*) as n, min(ms) as lo, round(quantile_cont(ms, 0.5), 6) as p50, round(quantile_cont(ms, 0.95), 6) as p95, max(ms) as hi from {_GAPS} where ms is not null group by 1, 2),
x as (select event_type, unnest(list_concat([lo, hi], list_concat(list_transform(range(greatest(1, n // 2)), lambda i: p50), list_transform(range(greatest(1, n // 4)), lambda i: p95)))) as ms from s)
select event_type, count(*) as n, min(ms) as min, round(quantile_cont(ms, 0.5), 6) as p50, round(quantile_cont(ms, 0.95), 6) as p95, max(ms) as max, round(avg(ms), 3) as mean from x group by 1""")
def pooled_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of five runs pooled as if they were samples."""
    return metrics.pooled(metrics.latency(_gaps(spark, sf_dir), ["event_type", "run"]), ["event_type"])
