"""Retrieval over ``documents`` (questions: the first twelve words of each benchmark item)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..lineage import cut, shared_folder
from ..operators import index
from ..operators import search as S
from .registry import query, sql_list, table

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_TERMS = f"list_filter({_WORDS}, lambda w: length(w) > 1 and not list_contains({sql_list(V.STOPWORDS)}, w))"
_BASE = f"""
with questions as (
  select item_id as q_id, array_to_string({_WORDS.format('text')}[1:12], ' ') as question from benchmark
), asked as (
  select q_id, term, count(*) as q_tf
  from (select q_id, unnest({_TERMS.format('question')}) as term from questions) group by 1, 2
), listed as (
  select doc_id, {_TERMS.format("coalesce(text, '')")} as terms from documents
), size as (
  select count(*) as n, sum(len(terms))::double / count(*) as avgdl from listed
), postings as (
  select doc_id, dl, term, count(*) as tf
  from (select doc_id, len(terms) as dl, unnest(terms) as term from listed) group by 1, 2, 3
), idfs as (
  select term, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf
  from (select term, count(*) as df from postings group by 1), size
), bm as (
  select q_id, doc_id, round(sum(q_tf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) as score
  from postings join asked using (term) join idfs using (term), size group by 1, 2
), lexical as (
  select * from (select q_id, doc_id, score, row_number() over (partition by q_id order by score desc, doc_id) as rank from bm where score > 0)
  where rank <= 50
)"""
_DENSE = """, units as (
  select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y)))) as v from embeddings
), cosines as (
  select q.vec_id as q_id, d.vec_id as doc_id, round(list_inner_product(d.v, q.v), 6) as cosine
  from units d, units q where q.vec_id in (select item_id from benchmark)
), dense as (
  select * from (select q_id, doc_id, cosine, row_number() over (partition by q_id order by cosine desc, doc_id) as rank from cosines) where rank <= 50
), fused as (
  select coalesce(l.q_id, d.q_id) as q_id, coalesce(l.doc_id, d.doc_id) as doc_id, l.rank as lexical_rank, d.rank as dense_rank,
    round(coalesce(1.0::double / (60 + l.rank), 0) + coalesce(1.0::double / (60 + d.rank), 0), 9) as rrf
  from lexical l full outer join dense d on l.q_id = d.q_id and l.doc_id = d.doc_id
), best as (
  select * from (select *, row_number() over (partition by q_id order by rrf desc, lexical_rank nulls last, dense_rank nulls last, doc_id) as rank from fused) where rank <= 4
), weights as (
  select q_id, term, coalesce(idf, (select max(idf) from idfs where term in (select term from asked)), 1.0) as w from asked left join idfs using (term)
), cover as (
  select q_id, doc_id, round(sum(w) / any_value(total), 6) as coverage
  from postings join weights using (term) join (select q_id, sum(w) as total from weights group by 1) using (q_id) group by 1, 2
), scored as (
  select b.*, coalesce(coverage, 0) as coverage,
    round(case when cosine is null then coalesce(coverage, 0)
      else 0.6 * least(greatest((cosine - 0.45) / 0.35, 0), 1) + 0.4 * coalesce(coverage, 0) end, 6) as score
  from best b left join cover using (q_id, doc_id) left join cosines using (q_id, doc_id)
)"""
_HYBRID = _BASE + _DENSE


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 12), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), first.alias("question"))


def _asked(spark, sf_dir):
    q = questions(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    with_vector = q.join(vectors.select(F.col("doc_id").alias("q_id"), F.col("embedding").alias("q_vector")), "q_id", "left")
    return q, vectors, with_vector


@query(_HYBRID + " select q_id, rank, doc_id, lexical_rank, dense_rank, rrf, coverage, score, max(case when rank = 1 then score end) over (partition by q_id) >= 0.35 as confident from scored")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vectors, asked = _asked(spark, sf_dir)
    return S.search(table(spark, sf_dir, "documents").select("doc_id", "text"), asked, vectors)


@query(_BASE + " select q_id, rank, doc_id, score from lexical where rank <= 4")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.question_terms(questions(spark, sf_dir), "q_id", "question")
    found, _ = S.lexical(table(spark, sf_dir, "documents").select("doc_id", "text"), asked, 4)
    return found.select("q_id", "rank", "doc_id", "score")


@query(_BASE + " select q_id, rank, doc_id, score from lexical")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical channel from a written index, of which only the asked terms' buckets and the blocks that may matter are read."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return index.Index(spark, path).lexical(questions(spark, sf_dir)).select("q_id", "rank", "doc_id", "score")


_EARLIER, _LATER = "doc_id % 5 <> 0", "doc_id % 11 <> 3"


@query(_BASE.replace("from documents", f"from (select doc_id, case when doc_id % 7 = 2 then text || ' the loan terms changed once more' else text end as text from documents where {_LATER})") + " select q_id, rank, doc_id, score from lexical")
def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of four fifths of the documents, carried through a change: new ones enter, some are changed, some go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.write(docs.filter(_EARLIER), f"{path}/1")
    later = docs.filter(_LATER).withColumn("text", F.when(F.col("doc_id") % 7 == 2, F.concat("text", F.lit(" the loan terms changed once more"))).otherwise(F.col("text")))
    changed = later.filter(f"not ({_EARLIER}) or doc_id % 7 = 2")
    index.apply(spark, f"{path}/1", f"{path}/2", changed, docs.filter(f"{_EARLIER} and (doc_id % 7 = 2 or not ({_LATER}))"))
    return index.Index(spark, f"{path}/2").lexical(questions(spark, sf_dir)).select("q_id", "rank", "doc_id", "score")


@query(_BASE + " select term, count(*) as df, sum(tf)::bigint as cf, round(max(ln(1 + (n - (select count(*) from postings p2 where p2.term = postings.term) + 0.5) / ((select count(*) from postings p2 where p2.term = postings.term) + 0.5))), 6) as idf from postings, size group by term")
def corpus_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    per_term = S.term_table(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    size = docs.agg(F.count("*").alias("n"))  # the texts are read once, for their terms
    return per_term.crossJoin(F.broadcast(size)).select("term", "df", "cf", F.round(S.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(_HYBRID + " select q_id, rank, doc_id, cosine from dense where rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vectors, asked = _asked(spark, sf_dir)
    return S.nearest(vectors, asked, 10).select("q_id", "rank", "doc_id", "cosine")


@query(_HYBRID + " select q_id, doc_id, lexical_rank, dense_rank, rrf from fused")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, vectors, asked = _asked(spark, sf_dir)
    terms = S.question_terms(q, "q_id", "question")
    lexical, _ = S.lexical(table(spark, sf_dir, "documents").select("doc_id", "text"), terms, 50)
    dense = S.nearest(vectors, asked, 50)
    return S.fuse(lexical, dense).select("q_id", "doc_id", "lexical_rank", "dense_rank", "rrf")


@query(_BASE + """, top as (select max(idf) as top from idfs where term in (select term from asked)),
w as (select q_id, term, coalesce(idf, top, 1.0) as w from asked left join idfs using (term), top)
select l.q_id, l.doc_id, round(sum(w) / any_value(total), 6) as coverage
from lexical l join postings using (doc_id) join w on w.q_id = l.q_id and w.term = postings.term
join (select q_id, sum(w) as total from w group by 1) t on t.q_id = l.q_id where l.rank <= 10 group by 1, 2""")
def coverage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.question_terms(questions(spark, sf_dir), "q_id", "question")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, idfs = S.lexical(docs, asked, 10)
    hits = cut(found.select("q_id", "doc_id"))
    return hits.join(S.coverage_of(hits, docs, idfs, asked), ["q_id", "doc_id"])


@query(_BASE + """, hits as (select q_id, rank, d.text, d.lang as category, score from lexical join documents d using (doc_id) where rank <= 4),
tests as (select q_id, string_split(question, ' ')[1:3] as must, case when q_id % 5 = 0 then ['e'] else ['qqq'] end as forbid,
  case when q_id % 7 = 0 then 'de' else 'xx' end as forbid_category, q_id % 3 <> 0 as expected from questions),
per as (select t.q_id, any_value(expected) as expected,
  bool_or(coalesce(len(list_filter(forbid, lambda x: contains(lower(text), x))) > 0 or category = forbid_category, false)) as bad,
  min(case when len(list_filter(must, lambda x: contains(lower(text), x))) > 0 then rank end) as first_evidence,
  bool_or(coalesce(score > 20, false)) as confident
  from tests t left join hits using (q_id) group by 1)
select q_id, first_evidence, confident, case when bad then 'incorrect' when not expected then case when confident then 'incorrect' else 'correct' end
  when first_evidence is null then 'incorrect' when first_evidence = 1 and confident then 'correct' else 'partially correct' end as verdict from per""")
def retrieval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    asked = S.question_terms(q, "q_id", "question")
    found, _ = S.lexical(docs.select("doc_id", "text"), asked, 4)
    hits = found.join(docs.select("doc_id", "text", F.col("lang").alias("category")), "doc_id")
    hits = hits.select("q_id", "rank", "text", "category", (F.col("score") > 20).alias("confident"))
    tests = q.select(
        "q_id", F.slice(F.split("question", " "), 1, 3).alias("must_contain_any"),
        F.when(F.col("q_id") % 5 == 0, F.array(F.lit("e"))).otherwise(F.array(F.lit("qqq"))).alias("forbid_any"),
        F.when(F.col("q_id") % 7 == 0, "de").otherwise("xx").alias("forbid_category"), (F.col("q_id") % 3 != 0).alias("expect_confident"),
    )
    return S.verdicts(hits, tests)


_CATEGORIES = [f"src{n}" for n in range(8)]
_RECORDS = """records as (select *, coalesce(source, '') || ' ' || coalesce(text, '') || ' ["' || lang || '"]' as indexed, case when doc_id % 3 = 0 then 'PH' when doc_id % 3 = 1 then '' else 'IN' end as market,
  case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then 'loan' else 'lease' end as product, not contains(coalesce(text, ''), '@') as allowed from documents)"""
_FILTERED = _BASE.replace("coalesce(text, '')", "indexed").replace("from documents", "from records where allowed").replace("with questions as", f"with {_RECORDS}, questions as", 1)
_FILTERED = _FILTERED.replace("), lexical as (", f"""), fitting as (select bm.* from bm join records r using (doc_id) where (q_id % 3 <> 0 or r.lang = 'en') and (q_id % 4 <> 0 or case when market = '' then 'IN' else market end = 'IN')
    and (q_id % 5 <> 0 or list_contains({sql_list(_CATEGORIES)}, coalesce(r.source, ''))) and (q_id % 2 <> 0 or product in ('', 'loan'))
), lexical as (""").replace("from bm where score > 0", "from fitting where score > 0")


def filtered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: what is indexed, what the filters ask, and whether an address blocks them."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", S.indexed_text(F.col("source"), F.col("text"), F.array("lang")).alias("text"), F.col("lang").alias("language"), F.col("source").alias("category"),
        F.when(i % 3 == 0, "PH").when(i % 3 == 1, "").otherwise("IN").alias("market"), F.when(i % 4 == 0, "").when(i % 4 == 1, "loan").otherwise("lease").alias("product"),
        (~F.contains(F.coalesce("text", F.lit("")), F.lit("@"))).alias("retrieval_allowed"),
    )


def filtered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q_id")
    return questions(spark, sf_dir).withColumns({
        "q_language": F.when(q % 3 == 0, "en"), "q_market": F.when(q % 4 == 0, "IN").otherwise(""), "q_categories": F.when(q % 5 == 0, T.strings(_CATEGORIES)), "q_product": F.when(q % 2 == 0, "loan"),
    })


@query(_FILTERED + """, w as (select q_id, term, coalesce(idf, (select max(idf) from idfs where term in (select term from asked)), 1.0) as w from asked left join idfs using (term)),
 cover as (select q_id, doc_id, round(sum(w) / any_value(total), 6) as coverage from postings join w using (term) join (select q_id, sum(w) as total from w group by 1) using (q_id) group by 1, 2),
 top as (select l.q_id, l.rank, l.doc_id, l.rank as lexical_rank, round(1.0::double / (60 + l.rank), 9) as rrf, coverage, coverage as score from lexical l left join cover using (q_id, doc_id) where l.rank <= 4)
select q_id, rank, doc_id, lexical_rank, null::int as dense_rank, rrf, coverage, score, max(case when rank = 1 then score end) over (partition by q_id) >= 0.35 as confident from top""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that ask for a language, a market, kinds or a product, without vectors (the lexical channel alone)."""
    return S.search(filtered_records(spark, sf_dir), filtered_questions(spark, sf_dir))
