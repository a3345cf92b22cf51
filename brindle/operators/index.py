"""An inverted index kept as tables, read by bucket and block.

``write`` lays postings out by a hash of their term (a folder for each bucket) and, inside, by term and
block: all documents of one hash of the id are a block, the same for every term.  A row holds one term's
postings in one block as an array, and beside it how many documents hold the term, the most often it stands
in one, and the shortest one's length: with these BM25 cannot be exceeded, whatever the corpus statistics
become, and they are read without the postings.  Texts move once, to their block, where all its rows are made;
these move once, to their bucket.  Texts are not needed again.

``lexical`` reads the buckets of the asked terms only.  The bounds of a question's terms add up to a bound for
each block; a few blocks of the highest bounds are scored first, which gives a score that the k-th best
reaches at least; then only the blocks whose bound reaches it are read.  The rows are those of a full search.

``apply`` carries a change set through: postings of changed and gone documents leave, those of new texts enter,
and the numbers of documents, of terms, and each term's number of documents follow by adding and subtracting.

Defined results: null texts hold no term but count as documents; repeated ids count once for each row (a
change of such an id takes all its rows, and names them all); questions without a known term give no rows; an empty corpus none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import map_arrow
from . import search as S

#: Buckets of terms, at most, and documents for each.
MOST_BUCKETS, BUCKET_DOCS = 256, 20_000
#: Documents of one block, on average, and blocks that are scored before the others are bounded.
BLOCK_DOCS, FIRST_BLOCKS = 64, 8
#: Terms that go to every task, at most.
MOST_SENT = 100_000


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _block(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int")


def _rows_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each term and block of whole blocks' documents (block, doc_id, text in lower case), which are sorted by both."""
    docs = pa.Table.from_batches(parts).combine_chunks()
    terms, length = S.terms_of(docs.column("text").combine_chunks())
    ids = docs.column("doc_id").combine_chunks()
    # rows of one id and length are one document of the postings
    row_id = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first, doc = np.unique(row_id * (length.max() + 1) + length, return_index=True, return_inverse=True)
    coded = pc.dictionary_encode(terms)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    met, tf = np.unique(code * len(first) + np.repeat(doc, length), return_counts=True)
    code, held = met // len(first), first[met % len(first)]
    block = docs.column("block").to_numpy()[held]
    new = np.ones(len(met), bool)
    new[1:] = (np.diff(code) != 0) | (np.diff(block) != 0)  # documents are in the order of blocks
    at = np.flatnonzero(new)
    ends = np.append(at, len(met)).astype(np.int32)
    p = pa.StructArray.from_arrays([ids.take(pa.array(held)), pa.array(tf), pa.array(length[held].astype(np.int32))], ["doc_id", "tf", "dl"])
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[at])), pa.array(block[at]), pa.ListArray.from_arrays(pa.array(ends), p)], ["term", "block", "p"])


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_rows_of`` as blocks come to their end; one that a batch cuts waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        if waiting and waiting[-1].column("block")[0].as_py() != block[-1]:
            last = int(np.searchsorted(block, block[-1]))
            yield _rows_of([*waiting, batch.slice(0, last)])
            waiting = [batch.slice(last)]
        elif waiting or not (last := int(np.searchsorted(block, block[-1]))):
            waiting.append(batch)
        else:
            yield _rows_of([batch.slice(0, last)])
            waiting = [batch.slice(last)]
    if waiting:
        yield _rows_of(waiting)


def _postings(docs: DataFrame, blocks: int) -> DataFrame:
    """term, block and p, the postings of the term's documents in the block."""
    laid = docs.select("doc_id", _block(F.col("doc_id"), blocks).alias("block"), F.coalesce("text", F.lit("")).alias("text"))
    laid = laid.repartition("block").sortWithinPartitions("block", "doc_id")
    schema = f"term string, block int, p array<struct<doc_id:{dict(docs.dtypes)['doc_id']},tf:bigint,dl:int>>"
    return map_arrow(laid.select("doc_id", "block", F.lower("text").alias("text")), _by_block, schema)


def _totals(docs: DataFrame) -> DataFrame:
    """One row: documents and their terms."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "terms": [len(S.terms_of(batch.column("text"))[0])]})

    counted = map_arrow(docs.select(F.lower("text").alias("text")), run, "n long, terms long")
    return counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "terms")))


def write(docs: DataFrame, path: str, blocks: int | None = None) -> None:
    """Writes the index of ``docs`` (doc_id, text) under ``path``."""
    totals = cut(_totals(docs))
    n = totals.first().n
    blocks, buckets = blocks or max(1, n // BLOCK_DOCS), min(MOST_BUCKETS, max(4, n // BUCKET_DOCS))
    bucket, part = _part(buckets)
    laid = _postings(docs, blocks).repartition(bucket, part).select(bucket, "term", "block", *_bounds(), "p")
    _save(laid.sortWithinPartitions("bucket", "term", "block"), totals, path, blocks, buckets)


def _part(buckets: int) -> tuple[Column, Column]:
    """A term's bucket and a fourth of the blocks: where a row of postings moves, once."""
    return _bucket(F.col("term"), buckets).alias("bucket"), (F.col("block") % 4).alias("part")


def _bounds() -> tuple[Column, Column, Column]:
    """Of a row of postings, made after its move: documents, the most often the term stands in one, the shortest one's length."""
    return F.size("p").cast("long").alias("df"), F.array_max("p.tf").alias("most_tf"), F.array_min("p.dl").alias("least_dl")


def _save(laid: DataFrame, totals: DataFrame, path: str, blocks: int, buckets: int) -> None:
    laid.write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    totals.withColumns({"blocks": F.lit(blocks), "buckets": F.lit(buckets)}).write.mode("errorifexists").parquet(f"{path}/totals")


def apply(spark: SparkSession, path: str, target: str, changed: DataFrame, before: DataFrame) -> None:
    """Writes to ``target`` the index at ``path`` after a change.

    ``changed``: doc_id and text of new and changed documents; ``before``: doc_id and text, as they were, of changed and gone ones.
    Only these texts are cut.  What a term loses and gains in a block meets its postings in the one move of them all;
    terms and blocks that nothing touches are copied as they are.
    """
    totals, held = spark.read.parquet(f"{path}/totals").first(), spark.read.parquet(f"{path}/postings")
    blocks = totals.blocks
    kind = held.schema["p"].dataType
    of = lambda rows, name, p=F.col("p"): rows.select("term", "block", *(p.cast(kind).alias(n) if n == name else F.lit(None).cast(kind).alias(n) for n in ("was", "gone", "added")))
    ids_alone = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), F.lit(None).cast("long").alias("tf"), F.lit(None).cast("int").alias("dl")))
    moved = of(held, "was").union(of(_postings(before, blocks), "gone", ids_alone)).union(of(_postings(changed, blocks), "added"))
    # one row of each kind at most, so the greatest is that row
    met = moved.select("*", *_part(totals.buckets)).repartition("bucket", "part").groupBy("bucket", "part", "term", "block").agg(*(F.max(n).alias(n) for n in ("was", "gone", "added")))
    none = F.array().cast(kind)
    was = F.coalesce("was", none)
    left = F.when(F.col("gone").isNull(), was).otherwise(F.filter(was, lambda x: ~F.exists("gone", lambda g: g["doc_id"].eqNullSafe(x["doc_id"]))))
    made = met.select("bucket", "term", "block", F.sort_array(F.concat(left, F.coalesce("added", none))).alias("p")).filter(F.size("p") > 0)
    made = made.select("bucket", "term", "block", *_bounds(), "p")
    more, less = _totals(changed), _totals(before)
    sums = more.crossJoin(less.select(F.col("n").alias("n0"), F.col("terms").alias("terms0")))  # one row each
    _save(made, sums.select((F.lit(totals.n) + F.col("n") - F.col("n0")).alias("n"), (F.lit(totals.terms) + F.col("terms") - F.col("terms0")).alias("terms")), target, blocks, totals.buckets)


def _small(terms: DataFrame) -> DataFrame:
    """The terms of some questions (a written table), by broadcast unless they are many."""
    return F.broadcast(terms) if terms.count() <= MOST_SENT else terms


class Index:
    """An index opened for searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.spark = path, spark
        self.totals = spark.read.parquet(f"{path}/totals").first()
        self.avgdl = self.totals.terms / self.totals.n if self.totals.n else 0.0

    def _of(self, table: str, asked: DataFrame) -> DataFrame:
        """The rows of the asked terms' buckets; folders of others are not opened."""
        buckets = [r.b for r in asked.select(_bucket(F.col("term"), self.totals.buckets).alias("b")).distinct().collect()]  # MOST_BUCKETS at most
        return self.spark.read.parquet(f"{self.path}/{table}").filter(F.col("bucket").isin(buckets))

    def _share(self, tf: Column, dl: Column) -> Column:
        return tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * dl / F.lit(self.avgdl)))

    def idfs(self, asked: DataFrame) -> DataFrame:
        """term and idf of the asked terms that the corpus holds."""
        heads = self._of("postings", asked).join(asked.select("term").distinct(), "term", "left_semi")
        return heads.groupBy("term").agg(F.sum("df").alias("df")).select("term", S.idf(F.lit(self.totals.n), F.col("df")).alias("idf"))

    def bounds(self, asked: DataFrame, idfs: DataFrame) -> DataFrame:
        """q_id, block and bound: no document of the block scores more for the question."""
        most = F.col("q_tf") * F.col("idf") * self._share(F.col("most_tf"), F.col("least_dl"))
        heads = self._of("postings", asked).select("term", "block", "most_tf", "least_dl").join(_small(asked.join(idfs, "term")), "term")
        return heads.groupBy("q_id", "block").agg(F.sum(most).alias("bound"))

    def scores(self, asked: DataFrame, idfs: DataFrame, chosen: DataFrame) -> DataFrame:
        """q_id, doc_id and score of the documents in the chosen (q_id, block)."""
        wanted = asked.join(idfs, "term").join(chosen.select("q_id", "block"), "q_id")
        # postings of other terms stay where they are
        of_terms = self._of("postings", asked).select("term", "block", "p").join(_small(idfs).select("term"), "term", "left_semi")
        found = of_terms.join(wanted, ["term", "block"]).select("q_id", "q_tf", "idf", F.explode("p").alias("p")).select("q_id", "q_tf", "idf", "p.*")
        score = F.round(F.sum(F.col("q_tf") * F.col("idf") * self._share(F.col("tf"), F.col("dl"))), 6)
        return found.groupBy("q_id", "doc_id").agg(score.alias("score")).filter("score > 0")

    def chosen(self, asked: DataFrame, idfs: DataFrame, k: int, first: int = FIRST_BLOCKS) -> DataFrame:
        """The (q_id, block) that can hold one of the k best, and with ``read`` whether they were scored first."""
        bounds = cut(self.bounds(asked, idfs))
        early = S.ranked(bounds.withColumnRenamed("block", "doc_id"), first, "bound").select("q_id", F.col("doc_id").alias("block"))
        least = S.ranked(self.scores(asked, idfs, early), k).filter(F.col("rank") == k).select("q_id", F.col("score").alias("least"))
        return bounds.join(least, "q_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))

    def lexical(self, questions: DataFrame, k: int = 50) -> DataFrame:
        """q_id, doc_id, score and rank of the k best documents by BM25; ``questions``: q_id, question."""
        asked = cut(S.question_terms(questions, "q_id", "question"))
        idfs = cut(self.idfs(asked))
        return S.ranked(self.scores(asked, idfs, self.chosen(asked, idfs, k)), k)
