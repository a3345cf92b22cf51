"""Normalisation of text, on tables and on strings made from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from .registry import case, query, sql_list, table


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    text = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({names})"


_SCRIPT_SAMPLES = [
    (-1, "नमस्ते दुनिया"), (-2, "வணக்கம் உலகம் hello"), (-3, "a" * 200 + "नम"), (-4, "مرحبا بالعالم"), (-5, "ನಮಸ್ಕಾರ తెలుగు తెలుగు"),
    (-6, "ગુજરાતી"), (-7, "ਪੰਜਾਬੀ"), (-8, "বাংলা ভাষা"), (-9, ""), (-10, "x" * 18 + "न" + "y"),
]
_RANGE = "len(regexp_extract_all(s, '[\\x{{{}}}-\\x{{{}}}]'))"


@query(
    f"""with t as (select doc_id, coalesce(text, '') as text from documents union all select * from {sql_values(_SCRIPT_SAMPLES, 'doc_id, text')}),
    s as (select doc_id, substr(text, 1, 4000) as s from t),
    n as (select doc_id, s, unnest([{', '.join("{'name': '" + k + "', 'n': " + _RANGE.format(*r) + ", 'at': length(regexp_extract(s, '(?s)^[^\\x{" + r[0] + "}-\\x{" + r[1] + "}]*'))}" for k, r in V.SCRIPTS.items())}]) as o from s),
    b as (select doc_id, any_value(s) as s, first(o order by o.n desc, o.at) as o from n group by doc_id)
    select doc_id, case when o.n / greatest(length(s), 1) > 0.05 then o.name else 'en' end as language from b"""
)
def language_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.union(values(spark, _SCRIPT_SAMPLES, "doc_id long, text string"))
    return rows.select("doc_id", T.script_language(F.col("text")).alias("language"))


@query(
    """select o_orderkey, 'from ' || strftime(o_orderdate, '%Y-%m-%d') || ' until ' || case o_orderkey % 5 when 4 then '31-02-2026' else strftime(o_orderdate, '%Y-%m-%d') end || '.' as text from orders"""
)
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    shown = (
        F.when(kind == 0, F.date_format(d, "dd-MM-yyyy")).when(kind == 1, F.date_format(d, "yyyy/M/d")).when(kind == 2, F.date_format(d, "MMMM d, yyyy"))
        .when(kind == 3, F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMM yyyy"))).otherwise(F.lit("31-02-2026"))
    )
    text = F.concat(F.lit("from "), F.date_format(d, "d/M/yyyy"), F.lit(" until "), shown, F.lit("."))
    return T.with_iso_dates(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text")


@query(
    """select o_orderkey, case o_orderkey % 4
      when 0 then 'limit Rs. ' || n || ' lakh (INR ' || (n * 100000) || ') only'
      when 1 then 'limit INR ' || n || '.5 Cr (INR ' || cast((n + 0.5) * 10000000 as bigint) || ') only'
      when 2 then 'pay Rs ' || n || ',00,000 (INR ' || n || '00000) now'
      else 'customers ' || n || '000 and years ' || n || '5' end as text
    from (select o_orderkey, cast(floor(o_totalprice / 1000) + 1 as bigint) as n from orders)"""
)
def annotate_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.floor(F.col("o_totalprice") / 1000) + 1).cast("long").cast("string")
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("limit Rs. "), n, F.lit(" lakh only"))).when(kind == 1, F.concat(F.lit("limit INR "), n, F.lit(".5 Cr only")))
        .when(kind == 2, F.concat(F.lit("pay Rs "), n, F.lit(",00,000 now"))).otherwise(F.concat(F.lit("customers "), n, F.lit("000 and years "), n, F.lit("5")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.annotate_amounts(text).alias("text"))


_ALIASES = [a for xs in V.TERMS.values() for a in xs]
_TERM_CASES = ", ".join(f"case when regexp_matches(s, '{T.alternation(a)}') then '{k}' end" for k, a in V.TERMS.items())


@query(
    f"""select p_partkey, list_filter([{_TERM_CASES}], lambda x: x is not null) as terms
    from (select p_partkey, lower(p_name || ' ' || {sql_list(_ALIASES)}[1 + p_partkey % {len(_ALIASES)}] || case when p_partkey % 3 = 0 then 's' else '' end || ' Tenor') as s from part)"""
)
def canonical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = F.element_at(T.strings(_ALIASES), (F.col("p_partkey") % len(_ALIASES) + 1).cast("int"))
    text = F.concat("p_name", F.lit(" "), alias, F.when(F.col("p_partkey") % 3 == 0, "s").otherwise(""), F.lit(" Tenor"))
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_terms(text).alias("terms"))


_HEADINGS = [
    (1, "## FAQ: how it works?", "how it works?"), (2, "  - Who   can apply :", "Who can apply"), (3, "ELIGIBILITY RULES", "Eligibility Rules"),
    (4, "Frequently Asked Questions - Fees", "Fees"), (5, "KYC", "KYC"), (6, "#•|Loan amount|", "Loan amount"), (7, "FAQs", ""),
]


@case(f"select id, heading from {sql_values([(i, w) for i, _, w in _HEADINGS], 'id, heading')}")
def clean_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, [(i, h) for i, h, _ in _HEADINGS], "id int, raw string").select("id", T.clean_heading(F.col("raw")).alias("heading"))


_HEARD = [
    (1, "Thank you.", True), (2, "[BLANK_AUDIO]", True), (3, "...", True), (4, "yes", False), (5, "(soft music)", True), (6, None, True),
    (7, "ご視聴ありがとうございました", True), (8, "мы здесь", True), (9, "I need fifty lakh", False), (10, "Terima kasih!", True),
]


@case(f"select id, silent from {sql_values([(i, s) for i, _, s in _HEARD], 'id, silent')}")
def silence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, [(i, t) for i, t, _ in _HEARD], "id int, text string").select("id", T.is_silence(F.col("text"), "latin").alias("silent"))


_ANSWERS = [
    (1, 'Sure: ```json\n{"a": 1}\n``` done', '{"a": 1}'), (2, '{"b": [1, 2]}', '{"b": [1, 2]}'), (3, 'so {"c": 2} is it', '{"c": 2}'),
    (4, "list [1, 2, 3] end", "[1, 2, 3]"), (5, "nothing here", None),
]


@case(f"select id, found from {sql_values([(i, w) for i, _, w in _ANSWERS], 'id, found')}")
def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, [(i, t) for i, t, _ in _ANSWERS], "id int, text string").select("id", T.recovered_json(F.col("text")).alias("found"))


@query(
    r"""select doc_id, md5(trim(regexp_replace('“' || text || '” – it’s', '[ \t]+', ' ', 'g'))) as raw_md5,
    replace(replace(replace(replace(trim(regexp_replace(regexp_replace('“' || text || '” – it’s', '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \t\n\r'), '“', '"'), '”', '"'), '’', ''''), '–', '-') as text
    from documents where text is not null"""
)
def plain_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = lambda c: F.concat(F.lit("“"), c, F.lit("” – it’s"))
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    raw = F.md5(F.trim(F.regexp_replace(framed(F.col("text")), r"[ \t]+", " ")))
    return docs.select("doc_id", raw.alias("raw_md5"), T.plain_marks(framed(F.col("text"))).alias("text"))


@query("""select doc_id, section, heading, trim(string_agg(case when not is_head then line end, E'\\n' order by n), E' \\t\\n\\r') as body from (
  select doc_id, n, line, starts_with(line, '## ') as is_head, sum(starts_with(line, '## ')::int) over (partition by doc_id order by n)::bigint as section,
    max(case when starts_with(line, '## ') then trim(substr(line, 4)) end) over (partition by doc_id, sec) as h0, coalesce(h0, '') as heading
  from (select *, sum(starts_with(line, '## ')::int) over (partition by doc_id order by n) as sec from (
    select doc_id, i as n, case when i % 4 = 2 then '## part ' || i else parts[i + 1] end as line
    from (select doc_id, string_split(text, E'\\n') as parts from documents where text is not null), unnest(range(len(parts))) r(i))))
group by all having coalesce(trim(string_agg(case when not is_head then line end, E'\\n' order by n), E' \\t\\n\\r'), '') <> ''""".replace("group by all", "group by doc_id, section, heading"))
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import corpus

    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 2, F.concat(F.lit("## part "), i.cast("string"))).otherwise(x))
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return corpus.sections(docs)


@query(r"""select doc_id, len(s) as n_sentences, list_max(list_transform(s, lambda x: length(x))) as longest, s[1] as first
from (select doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', E'\\1\x01\\2', 'g'), chr(1)) as s from documents where text is not null)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return docs.select(
        "doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"), F.get("s", F.lit(0)).alias("first")
    )
