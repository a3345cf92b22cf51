"""Builds that follow a change set: only new and changed documents are chunked and scanned.

A build is two tables: ``marks`` (doc_id, mark), the hash of each document as it was read, and ``records``
(record_id, doc_id, chunk, checksum, version, has_pii, redacted).  The marks of two snapshots meet by document
and give the change set; the records of documents that it does not name are taken over as they are.
``operators.index.apply`` carries the search index through the same change set.

Defined results: null texts are documents without records; a document that comes back after it was gone starts at
version 1.0; repeated ids in a snapshot count as one document if their texts agree, and as one of them otherwise (the
greatest mark is compared, all their chunks are records); an empty snapshot empties the build; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut
from . import corpus

KINDS = ("new", "changed", "gone", "unchanged")


def marks(docs: DataFrame) -> DataFrame:
    """doc_id and mark of every document (doc_id, text)."""
    return docs.groupBy("doc_id").agg(F.max(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("mark"))


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id and kind (new, changed, gone, unchanged) from the marks of two snapshots."""
    both = before.select("doc_id", F.col("mark").alias("was")).join(after.select("doc_id", F.col("mark").alias("is")), "doc_id", "full_outer")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") != F.col("is"), "changed").otherwise("unchanged")
    return both.select("doc_id", kind.alias("kind"))


def records_of(docs: DataFrame) -> DataFrame:
    """The records of documents, at no version yet: one pass over documents dealt out evenly, since the work on a row is long and
    the partitions of a scan or a join are made by bytes, too few of them for short texts."""
    dealt = docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = corpus.chunks(dealt).select("doc_id", "chunk", "text", T.content_hash(F.col("text")).alias("checksum"))
    scanned = corpus.scan_personal_data(made, keep=("chunk", "checksum"))
    record_id = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("record_id")
    return scanned.select(record_id, "doc_id", "chunk", "checksum", "has_pii", "redacted")


def full_build(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marks, records) of a first snapshot."""
    return marks(docs), records_of(docs).withColumn("version", F.lit("1.0"))


def next_build(old_marks: DataFrame, old_records: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, records, change set) of the next snapshot.

    A record whose checksum changed gets the next minor version, one that is new 1.0, one that stayed keeps its own.
    """
    new_marks = cut(marks(docs))
    changes = cut(change_set(old_marks, new_marks))
    of = lambda *kinds: changes.filter(F.col("kind").isin(*kinds)).select("doc_id")
    fresh = records_of(docs.join(of("new", "changed"), "doc_id", "left_semi"))
    earlier = old_records.join(of("changed"), "doc_id", "left_semi").select("record_id", F.col("checksum").alias("old_checksum"), F.col("version").alias("old_version"))
    versioned = fresh.join(earlier, "record_id", "left").withColumn("version", corpus.next_version(F.col("old_version"), F.col("checksum") != F.col("old_checksum")))
    kept = old_records.join(of("changed", "gone"), "doc_id", "left_anti")
    return new_marks, kept.unionByName(versioned.drop("old_checksum", "old_version")), changes
