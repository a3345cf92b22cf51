"""Source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..lineage import cut, shared_folder
from ..sources import files, web
from .registry import query, table

_HOST = r"regexp_extract(url, '^https?://([^/]+)', 1)"
_PATH = r"regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/]*', ''), '[?#].*$', '')"


@query(f"""select page_id, substr(case when n = '' then 'index' else n end, 1, 120) as slug from (select page_id, regexp_replace(replace(trim({_PATH}, '/'), '/', '__'), '[^A-Za-z0-9_.-]', '-', 'g') as n from pages)""")
def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.slug(F.col("url")).alias("slug"))


@query(r"""select url from (select regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as url, min(page_id) as first_at from pages where url not like '%/de/%' group by 1) order by first_at limit 200""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url><url><loc>"), F.col("url"), F.lit("/</loc></url>"))
    return web.sitemap_urls(table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), xml.alias("xml")), exclude="/de/")


@query(f"""select page_id from pages where not ({_PATH} like '/fr%' and {_HOST} like '%.com') """)
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://[^/]*", ""), "[?#].*$", "")
    urls = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rules = urls.filter("host like '%.com'").select(F.col("host").alias("rule_host"), F.lit("/fr").alias("prefix")).distinct()
    return web.allowed(urls, rules).select("page_id")


_ROBOTS = "# who may read\nUser-agent: Other\nDisallow: /\n\nUser-agent: *\nDisallow: /fr # but\nAllow: /fr/*5\nDisallow: /*.html$\n"
_ROBOTS_COM = "\nSitemap: x\nUser-agent: Elsewhere\nUser-agent: CorpusBot\nDisallow: /en/6\nAllow: /en/67$\nAllow: /en/6*9\nDisallow:\n"


@query(f"""with u as (select page_id, {_HOST} as host, {_PATH} as path from pages), rule as (select * from (values
 (true, '/en/6', '^/en/6', false), (true, '/en/67$', '^/en/67$', true), (true, '/en/6*9', '^/en/6.*9', true), (false, '/fr', '^/fr', false), (false, '/fr/*5', '^/fr/.*5', true), (false, '/*.html$', '^/.*\\.html$', false)) t(com, pattern, regex, allow))
select page_id, coalesce((select max((length(pattern), allow)) from rule where com = (host like '%.com') and regexp_matches(path, regex))[2], true) as allowed from u""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under their hosts' robots.txt: groups of agents, wildcards and ends, the longest pattern first."""
    host, path = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://[^/]*", ""), "[?#].*$", "")
    urls = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    texts = urls.select("host").distinct().withColumn("text", F.concat(F.lit(_ROBOTS), F.when(F.col("host").endswith(".com"), _ROBOTS_COM).otherwise("")))
    return web.judged(urls, web.robots_rules(texts, "corpusbot")).select("page_id", "allowed")


_WORDS = V.PDF_LANGUAGES + V.PDF_KEYWORDS + ["brochure", "logo"]


@query(f"""select p_partkey, url, not regexp_matches(lower(url), '{'|'.join(V.PDF_LANGUAGES)}') and regexp_matches(lower(url), '{'|'.join(V.PDF_KEYWORDS)}') as relevant
from (select p_partkey, 'https://x.org/' || [{', '.join(f"'{w}'" for w in _WORDS)}][1 + p_partkey % {len(_WORDS)}] || '-' || [{', '.join(f"'{w}'" for w in _WORDS)}][1 + p_partkey * 11 % {len(_WORDS)}] || '.PDF' as url from part)""")
def pdf_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n: F.element_at(F.array(*map(F.lit, _WORDS)), (n % len(_WORDS) + 1).cast("int"))
    key = F.col("p_partkey")
    url = F.concat(F.lit("https://x.org/"), pick(key), F.lit("-"), pick(key * 11), F.lit(".PDF"))
    return table(spark, sf_dir, "part").select("p_partkey", url.alias("url")).withColumn("relevant", web.pdf_relevant(F.col("url")))


@query(f"""with f as (select {_HOST} as host, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"''#?]+)', 1)) as href from pages)
select distinct host, case when starts_with(href, '/') then href when regexp_matches(href, '^https?://') then regexp_replace(href, '^https?://[^/]+', '') else '/' || href end as path, lower(href) like '%.pdf' as is_pdf
from f where not regexp_matches(href, '^https?://') or regexp_extract(href, '^https?://([^/]+)', 1) = host""")
def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "html"))


@query("""select 'suppliers' as heading, '| s_suppkey: ' || s_suppkey || case when s_suppkey % 3 = 0 then '' else '; s_name: ' || trim(s_name) end as line from supplier""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" ")))
    return files.csv_lines(table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("s_name")), "suppliers")


def _folder(spark: SparkSession, name: str) -> str:
    cut(spark.range(1))  # makes sure of a shared folder
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("select doc_id, lang, coalesce(length(text), 0)::bigint as n from documents where lang = 'fr'")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by language, read back for one: the filter prunes the other partitions."""
    path = _folder(spark, "index")
    files.write_index(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, ["lang"])
    return spark.read.parquet(path).filter("lang = 'fr'").select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))


@query("select doc_id::varchar as doc_id, lang as title, text from documents where text is not null")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "jsonl")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    files.append_leads(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("title"), "text"), path)
    return files.read_jsonl(spark, path, files.DOCUMENT).select("doc_id", "title", "text")


@query("""select o_orderkey as id, case when o_orderstatus <> 'F' then 'new' else 'old' end as state from orders""")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is in the old table; those still open or partly so come again in the new one."""
    orders = table(spark, sf_dir, "orders")
    old, new = orders.select(F.col("o_orderkey").alias("id"), F.lit("old").alias("state")), orders.filter("o_orderstatus <> 'F'")
    return files.keep_latest(old, new.select(F.col("o_orderkey").alias("id"), F.lit("new").alias("state")), "id")


@query("select doc_id, lang, md5(coalesce(text, '')) as text_md5 from documents where doc_id in (0, 7, 42, 199)")
def index_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by id from an index laid out by id: all files but those of the ids' buckets are skipped."""
    path = _folder(spark, "records")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text", "lang")
    files.write_records(docs, path)
    found = files.read_records(spark, path, [0, 7, 42, 199])
    return found.select(F.col("record_id").alias("doc_id"), "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("select doc_id, trim(lower(lang)) as lang, n_chars from documents")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record set under its stamp, read back."""
    folder = _folder(spark, "snapshots")
    files.write_snapshot(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), folder, "20260801T000000")
    return spark.read.parquet(f"{folder}/versions/20260801T000000")


@query(f"""with f as (select page_id, url, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"''#]*)', 1)) as href from pages),
r as (select {_HOST} as own, case when regexp_matches(href, '^https?://') then href when starts_with(href, '//') then regexp_extract(url, '^(https?:)', 1) || href when starts_with(href, '/') then regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
  else regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href end as target from f where href <> '' and not regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') or regexp_matches(href, '^https?://'))
select distinct own as host, regexp_replace(target, '/+$', '') as url, regexp_matches(lower(target), '\\.pdf$') as is_pdf from r where regexp_extract(target, '^https?://([^/?#]+)', 1) = own and not contains(target, '/the')""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links against each page's own address, without those of a pattern that the crawl leaves out."""
    return web.resolved_links(table(spark, sf_dir, "pages").select("url", "html"), exclude="/the")


@query("""select 'docs/' || (page_id % 3) || '/' || page_id as doc_id, url, length(html) as n from pages where page_id % 4 <> 1 and html is not null""")
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of pages and their files: entries without a path, or whose file is not there, give no row."""
    pages = table(spark, sf_dir, "pages")
    folder = _folder(spark, "raw")
    path = F.concat(F.lit("docs/"), (F.col("page_id") % 3).cast("string"), F.lit("/"), F.col("page_id").cast("string"))
    stored = pages.filter("page_id % 4 <> 1 and html is not null").select(path.alias("path"), "html")
    stored.write.parquet(folder)
    manifest = pages.select("url", F.when(F.col("page_id") % 8 != 5, path).alias("html_path"))
    return files.manifest_scan(manifest, spark.read.parquet(folder)).select(F.col("path").alias("doc_id"), "url", F.length("html").cast("long").alias("n"))


_CELLS = "'| n_nationkey: ' || n_nationkey || '; n_name: ' || n_name || '; n_regionkey: ' || n_regionkey"


@query(f"""select 'nations' as doc_id, 'Nations' as title, '## Nations' || chr(10) || string_agg({_CELLS}, chr(10) order by n_nationkey) as text, 'crm_export' as source_type, 'IN' as market from nation
union all select 'handbook', 'Handbook', 'Head' || chr(10) || string_agg('* ' || r_name || ' is one', chr(10) order by r_regionkey), 'internal_handbook', 'PH' from region
union all select 's' || s_suppkey, s_name, 'Supplier ' || s_name, 'jsonl', 'ID' from supplier""")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of a table with personal data, a handbook, a file of documents and one that is missing, as one table of documents."""
    folder = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).sortWithinPartitions("n_nationkey").write.option("header", True).csv(f"{folder}/nations")
    line = F.concat(F.lit("* "), "r_name", F.lit(" is  one \t"))
    book = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", line.alias("line")))).alias("x"))  # five regions
    book.select(F.concat(F.lit("Head \n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))).write.text(f"{folder}/handbook")
    docs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc_id"), F.col("s_name").alias("title"), F.concat(F.lit("Supplier "), "s_name").alias("text"))
    docs.write.json(f"{folder}/documents")
    registry = [
        {"id": "nations", "title": "Nations", "kind": "csv_pii", "path": f"{folder}/nations"}, {"id": "handbook", "title": "Handbook", "kind": "markdown", "path": f"{folder}/handbook", "market": "PH"},
        {"id": "documents", "kind": "jsonl", "path": f"{folder}/documents", "market": "ID"}, {"id": "gone", "kind": "csv", "path": f"{folder}/gone"},
    ]
    return files.read_sources(spark, registry)
