"""Parsers and checks on words made from the tables' keys, so that SQL can compute what they should read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as X
from ..functions import vocabulary as V
from ..operators import corpus, decide, metrics, records
from .registry import query, sql_list, table

_UNITS, _TENS = ["satu", "dua", "tiga", "empat", "lima", "enam", "tujuh", "delapan", "sembilan"], ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def _pick(items: list[str], n) -> F.Column:
    return F.element_at(T.strings(items), (n % len(items) + 1).cast("int"))


def _words(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"""select o_orderkey, case k % 12 when 0 then n * 100000 when 1 then n * 100000 when 2 then n * 10000000 + 5000000 when 3 then d * 10000000 when 4 then n * 1000 when 5 then n * 1000000 + 500000
 when 6 then 0 when 7 then d * 1000000 + e * 100000 when 8 then n * 1000000 when 9 then n * 1000000 + 500000 when 10 then null else d * 1000 end::bigint as amount
from (select o_orderkey, o_orderkey as k, o_orderkey // 12 % 90 + 1 as n, o_orderkey // 12 % 9 + 1 as d, o_orderkey // 108 % 9 + 1 as e from orders)""")
def spoken_amounts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    step = lambda n: F.floor(k / n)
    n, d, e = step(12) % 90 + 1, step(12) % 9, step(108) % 9
    forms = [
        _words(n, " lakh"), _words("Rs. ", n, ",00,000"), _words(n, ".5 crore"), _words(_pick(_TENS, d), " crore"), _words(n, " thousand"), _words(n, ".5 million"),
        F.lit("no existing EMIs"), _words(_pick(_UNITS, d), " juta ", _pick(_UNITS, e), " ratus ribu"), _words(n, ".000.000"), _words(n, ",5 juta"), F.lit("maybe later"), _words(_pick(_UNITS, d), " ribu"),
    ]
    raw = F.coalesce(*[F.when(k % len(forms) == i, form) for i, form in enumerate(forms)])
    return table(spark, sf_dir, "orders").select("o_orderkey", X.amount(raw).alias("amount"))


@query("""select o_orderkey, case k % 7 when 0 then n * 12 when 1 then n when 2 then n * 12 + 6 when 3 then (2026 - (1990 + n % 30)) * 12 + 8 when 4 then n * 12 when 5 then (n % 9 + 1) * 12 end::bigint as months
from (select o_orderkey, o_orderkey as k, o_orderkey // 7 % 40 + 1 as n from orders)""")
def spoken_durations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = F.floor(k / 7) % 40 + 1
    forms = [_words(n, " years"), _words(n, " months"), _words(n, ".5 yrs"), _words("since ", 1990 + n % 30), n.cast("string"), _words(_pick(_TENS, n % 9), " years"), F.lit("soon")]
    raw = F.coalesce(*[F.when(k % len(forms) == i, form) for i, form in enumerate(forms)])
    return table(spark, sf_dir, "orders").select("o_orderkey", X.months(raw, F.lit("2026-08-01").cast("date")).alias("months"))


_KINDS = [(kind, alias) for kind, aliases in V.ENTITIES.items() for alias in aliases[:1]]
_TRADES = [(kind, aliases[0]) for kind, aliases in V.INDUSTRIES.items()]


@query(f"""select c_custkey, case when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false end as flag, {sql_list([k for k, _ in _KINDS])}[1 + c_custkey % {len(_KINDS)}] as entity,
 case when c_custkey % 2 = 0 then {sql_list([k for k, _ in _TRADES])}[1 + c_custkey % {len(_TRADES)}] else trim(c_mktsegment) end as industry, case when c_custkey % 150 between 16 and 99 then c_custkey % 150 end::bigint as age from customer""")
def spoken_flags_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    flag = _pick(["haan ji", "not yet", "perhaps"], k)
    entity = _words("we are a ", _pick([a for _, a in _KINDS], k), " since 1999")
    industry = F.when(k % 2 == 0, _words("some ", _pick([a for _, a in _TRADES], k))).otherwise(_words("  ", F.col("c_mktsegment"), " "))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.flag(flag).alias("flag"), X.entity_type(entity).alias("entity"), X.industry(industry).alias("industry"), X.bounded_int(_words("I am ", k % 150, " years"), 16, 99).alias("age")
    )


@query("""select p_partkey, case k % 5 when 0 then n when 1 then 'Part ' || n when 2 then n || '?' when 3 then n || ' 7' else 'Parts Of ' || p_partkey end as heading
from (select p_partkey, p_partkey as k, regexp_replace(trim(p_name), '\\s+', ' ', 'g') as n from part)""")
def part_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    forms = [_words("## FAQ: ", F.col("p_name"), " :"), _words(" - Part   ", F.col("p_name"), " |"), _words("Frequently Asked Questions - ", F.col("p_name"), "?"), _words("#•", F.col("p_name"), "\t7"), _words("PARTS OF ", k)]
    raw = F.coalesce(*[F.when(k % len(forms) == i, form) for i, form in enumerate(forms)])
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_heading(raw).alias("heading"))


@query(f"""select conv_id, turn, case (conv_id + turn) % 5 when 0 then true when 1 then not contains(text, ']') when 2 then true when 3 then true
 else trim(text) = '' or list_contains({sql_list(V.SILENCE)}, lower(trim(regexp_replace(trim(text), '[.,!?…]+$', '')))) end as silent from conversations""")
def silent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") + F.col("turn")
    said = F.when(k % 5 == 0, "Thank you for watching!").when(k % 5 == 1, F.concat(F.lit("["), "text", F.lit("]"))).when(k % 5 == 2, " ... ").when(k % 5 == 3, "ขอบคุณครับ").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_silence(said, "latin").alias("silent"))


@query("""select event_id, case event_id % 5 when 3 then '[' || event_id || ', 2]' when 4 then null else props end as found from events""")
def recovered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    said = (
        F.when(k % 5 == 0, _words("Sure: ```json\n", F.col("props"), "\n``` as asked")).when(k % 5 == 1, _words(" ", F.col("props"), "\n")).when(k % 5 == 2, _words("it is ", F.col("props"), " I think"))
        .when(k % 5 == 3, _words("numbers ", "[", k, ", 2]", " only")).otherwise(_words("no answer to ", k))
    )
    return table(spark, sf_dir, "events").select("event_id", T.recovered_json(said).alias("found"))


@query(f"""select c_custkey, list_filter({sql_list(V.ASK_ORDER)}, lambda s: (c_custkey >> (list_position({sql_list(V.ASK_ORDER)}, s) - 1)) & 1 = 0)[1] as slot from customer""")
def next_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    known = F.map_from_entries(F.array_compact(F.array(*[F.when(F.shiftright(k, n).bitwiseAND(1) == 1, F.struct(F.lit(s).alias("key"), F.lit("x").alias("value"))) for n, s in enumerate(V.ASK_ORDER)])))
    return table(spark, sf_dir, "customer").select("c_custkey", decide.next_slot(known).alias("slot"))


_SOFT, _DATES = V.CUSTOMER_CUES["soft_refusal"][1], ["tanggal", "besok", "lusa"]
_ENDS = ["", " nanti saya kabari", " tanggal 5", " besok, lihat nanti", " lusa"]


@query(f"""with t as (select conv_id, turn, ' ' || lower(regexp_replace(trim(text || {sql_list(_ENDS)}[1 + (conv_id * 3 + turn) % {len(_ENDS)}]), '\\s+', ' ', 'g')) || ' ' as low, (conv_id + turn) % 4 < 2 as probed from conversations where role = 'user'),
f as (select *, list_filter({sql_list(_SOFT)}, lambda m: contains(low, m)) as soft, list_filter({sql_list(_DATES)}, lambda m: contains(low, m)) as dated from t),
a as (select *, case when probed and len(soft) = 0 then dated[1] end as answer from f), s as (select conv_id, m, min((turn, i)) as first_at from (select conv_id, turn, unnest(soft) as m, generate_subscripts(soft, 1) as i from f) group by 1, 2),
o as (select conv_id, string_agg(m, '|' order by first_at) as refusals from s group by 1),
c as (select conv_id, arg_max(answer, turn) filter (answer is not null) as commitment from a group by 1)
select conv_id, coalesce(refusals, '') as refusals, commitment, case when refusals is not null and commitment is null then 'no_commitment' else '' end as outcome from c left join o using (conv_id)""")
def call_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        c.alias("call_id"), t.alias("seq"), F.concat("text", _pick(_ENDS, c * 3 + t)).alias("text"), ((c + t) % 4 < 2).alias("probed")
    )
    out = decide.commitments(turns, _SOFT, _DATES)
    return out.select(F.col("call_id").alias("conv_id"), F.array_join("soft_refusals", "|").alias("refusals"), "commitment", "outcome")


@query(r"""select o_orderkey, k % 3 > 0 and (k % 4 > 0 or k % 1000 = 1) as answered, case when k % 4 = 0 and k % 1000 <> 1 and not contains(source, n || '7') then n || '7' else '' end as unsupported
from (select o_orderkey, o_orderkey as k, floor(o_totalprice)::bigint::varchar as n, 'rate ' || n || ' of ' || o_orderkey as source from orders)""".replace("k % 3 > 0 and (k % 4 > 0 or k % 1000 = 1)", "k % 3 > 0 and not (k % 4 = 0 and not contains(source, n || '7'))").replace(" and k % 1000 <> 1", ""))
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that give a number of their source, or one with a digit too many; cited ids may be none of the hits."""
    k, n = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    grouped = F.format_number(n, 0)
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 4 == 0, _words("1 of 2: ", n, "7")).otherwise(_words("It is ", grouped, " or so")).alias("answer"),
        F.when(k % 3 == 0, F.array(F.lit("z"))).otherwise(F.array(F.lit("a"))).alias("used_ids"), T.strings(["a", "b"]).alias("hit_ids"), _words("rate ", n, " of ", k).alias("sources"),
    )
    return decide.grounded(rows).select("o_orderkey", "answered", F.array_join("unsupported", "|").alias("unsupported"))


_HEARD = "regexp_replace(regexp_replace(lower({0}), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
_LIST = "list_filter(string_split(" + _HEARD + ", ' '), lambda w: w <> '')"
_SIGNS = "array_to_string(list_transform({0}, lambda w: chr(list_position(d, w)::int)), '')"


def word_error_sql(pairs: str) -> str:
    """``n`` (id, r, h, wer) from ``pairs`` (id, r, h).

    DuckDB measures strings by bytes, so up to 120 distinct words go by signs of one byte; pairs with more go
    through the table of distances row by row, the least of each row carried on by a running minimum.
    """
    return f"""pairs as ({pairs}), words as (select *, list_distinct(list_concat(r, h)) as d from pairs),
rw as (select id, unnest(r) as w, unnest(range(1, len(r) + 1)) as i, len(r) as m from words where len(d) > 120),
hw as (select id, unnest(h) as w, unnest(range(1, len(h) + 1)) as j from words where len(d) > 120),
cells as (select id, 0::bigint as i, unnest(range(len(h) + 1)) as v, unnest(range(len(h) + 1)) as j from words where len(d) > 120
 union all select id, i + 1, min(t - j) over (partition by id order by j) + j, j from (
  select c.id, c.i, c.j, least(c.v + 1, coalesce(lag(c.v) over (partition by c.id order by c.j) + (rw.w is distinct from hw.w)::bigint, c.v + 1)) as t
  from cells c join rw on rw.id = c.id and rw.i = c.i + 1 left join hw on hw.id = c.id and hw.j = c.j)),
n as (select words.*, case when len(r) = 0 then case when len(h) = 0 then 0 else 1 end::double
  else round(case when len(d) > 120 then c.v else levenshtein({_SIGNS.format('r')}, {_SIGNS.format('h')}) end / len(r), 6) end as wer
 from words left join cells c on c.id = words.id and c.i = len(r) and c.j = len(h))"""


_BENCHMARK_ERRORS = word_error_sql(f"""select item_id as id, {_LIST.format('text')} as r, {_LIST.format("regexp_replace(text, '[aeiou]{2}', 'e', 'g')")} as h from benchmark""")


@query("with recursive " + word_error_sql(f"""select (conv_id, turn) as id, {_LIST.format('text')} as r, {_LIST.format("regexp_replace(text, '[aeiou]{2}', 'e', 'g') || case when turn % 3 = 0 then ' and more' else '' end")} as h from conversations""")
 + " select id[1] as conv_id, id[2] as turn, wer, array_to_string(list_filter(r, lambda w: not list_contains(h, w)), ' ') as lost from n")
def turn_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.concat(F.regexp_replace("text", "[aeiou]{2}", "e"), F.when(F.col("turn") % 3 == 0, " and more").otherwise(""))
    rows = metrics.word_errors(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("reference"), heard.alias("hypothesis")))
    return rows.select("conv_id", "turn", "wer", F.array_join("lost_words", " ").alias("lost"))


@query("""select p_partkey, case when k % 3 = 0 then 'brand / ' || k else p_brand end as title, case k % 4 when 0 then 'page ' || k when 1 then '' else 'section: ' || p_type end as locator,
 case k % 4 when 0 then title || case when length(made) > 12 then ' - ' || left(made, 70) else '' end when 1 then title else p_type end as record_title, array_to_string(list_filter([title, locator, case when k % 2 = 0 then 'http://x/' || k else 'site' end], lambda x: x <> ''), ' | ') as citation
from (select *, p_partkey as k, p_name || case when p_partkey % 8 = 0 then ' of our own make' else '' end as made from part)""")
def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = records.record_title(F.when(k % 3 == 0, "").otherwise(F.col("p_brand")), _words("brand__", k))
    heading = F.when(k % 4 == 0, _words("Page ", k)).when(k % 4 == 1, "").otherwise(F.col("p_type"))
    place = records.locator(heading)
    url = F.when(k % 2 == 0, _words("http://x/", k)).otherwise("")
    return table(spark, sf_dir, "part").select(
        "p_partkey", title.alias("title"), place.alias("locator"), records.page_record_title(title, heading, _words("tiny\n# ", F.col("p_name"), F.when(k % 8 == 0, " of our own make").otherwise(""))).alias("record_title"), records.citation(title, place, url, F.lit("site")).alias("citation")
    )


@query("""select doc_id, coalesce(list_filter(list_transform(string_split(t, E'\\n'), lambda x: trim(x)), lambda x: length(x) between 8 and 90 and not starts_with(lower(x), 'page '))[1], '') as title,
 case when doc_id % 6 = 0 then 'extraction_failed' when doc_id % 6 = 1 or trim(coalesce(text, ''), ' ') = '' then 'partial_extraction' when doc_id % 6 = 2 then 'truncated_source' else '' end as flag
from (select *, array_to_string(list_filter(case when doc_id % 6 = 0 then ['', ' '] when doc_id % 6 = 1 then [text, ''] when doc_id % 6 = 2 then ['Page 1', text, 'end [TEXT TRUNCATED]'] else [text, 'Page 2'] end, lambda x: x is not null), E'\\n') as t from documents)""")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as the pages of a PDF, with empty and cut pages among them."""
    i, text = F.col("doc_id") % 6, F.col("text")
    pages = F.when(i == 0, F.array(F.lit(""), F.lit(" "))).when(i == 1, F.array(text, F.lit(""))).when(i == 2, F.array(F.lit("Page 1"), text, F.lit("end [TEXT TRUNCATED]"))).otherwise(F.array(text, F.lit("Page 2")))
    return table(spark, sf_dir, "documents").select("doc_id", records.pdf_title(F.array_join(pages, "\n")).alias("title"), records.extraction_flag(pages).alias("flag"))


_PII = [
    ("write to u{k}@mail.co.in now", "write to [EMAIL_REDACTED] now", "email"), ("call +91 98765 4{d} please", "call [PHONE_REDACTED] please", "phone_in"), ("PAN ABCPX{f}Z given", "PAN [PAN_REDACTED] given", "pan"),
    ("not a PAN ABCDX{f}Z here", "not a PAN ABCDX{f}Z here", ""), ("id 2345 6789 0124 ok", "id [AADHAAR_REDACTED] ok", "aadhaar"), ("id 2345 6789 0123 ok", "id 2345 6789 0123 ok", ""),
    ("account number: 123456789{d}", "[ACCOUNT_REDACTED]", "bank_account"), ("turnover 987654{d}", "turnover 987654{d}", ""), ("full_name: Asha Rao Devi", "full_name: [NAME_REDACTED]", "person_name"),
    ("code HDFC0ABC123 or 22ABCDE1234F1Z5", "code [IFSC_REDACTED] or [GSTIN_REDACTED]", "gstin,ifsc"),
]


@query(f"""select c_custkey, replace(replace(replace(r, '{{k}}', k), '{{f}}', f), '{{d}}', d) as redacted, kinds from (select c_custkey, c_custkey::varchar as k, lpad((c_custkey % 10000)::varchar, 4, '0') as f, lpad((c_custkey % 10000)::varchar, 4, '1') as d,
 {sql_list([r for _, r, _ in _PII])}[1 + c_custkey % {len(_PII)}] as r, {sql_list([k for _, _, k in _PII])}[1 + c_custkey % {len(_PII)}] as kinds from customer)""")
def pii_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of personal data, with safe words and wrong check digits among them."""
    k = F.col("c_custkey")
    text = _pick([t for t, _, _ in _PII], k)
    for mark, made in (("{k}", k.cast("string")), ("{f}", F.lpad((k % 10000).cast("string"), 4, "0")), ("{d}", F.lpad((k % 10000).cast("string"), 4, "1"))):
        text = F.replace(text, F.lit(mark), made)
    found = corpus.scan_personal_data(table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text")))
    return found.select(F.col("doc_id").alias("c_custkey"), "redacted", F.array_join("kinds", ",").alias("kinds"))


@query("with recursive " + _BENCHMARK_ERRORS + " select id as item_id, wer, len(list_filter(r, lambda w: not list_contains(h, w))) as n_lost from n")
def benchmark_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and themselves with vowels lost."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"), F.regexp_replace("text", "[aeiou]{2}", "e").alias("hypothesis"))
    return metrics.word_errors(rows).select("item_id", "wer", F.size("lost_words").cast("long").alias("n_lost"))


@query("with recursive " + _BENCHMARK_ERRORS + " select id as item_id, wer, len(list_filter(r, lambda w: not list_contains(h, w)))::int as n_lost from n")
def wer_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_word_errors(spark, sf_dir).withColumn("n_lost", F.col("n_lost").cast("int"))
