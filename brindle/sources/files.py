"""File readers and sinks of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tidy_inline

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "title", "text", "source_type", "market")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def csv_lines(df: DataFrame, label: str) -> DataFrame:
    """Rows of a table as "| header: value; ..." lines, empty cells left out, under one heading."""
    cells = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in df.columns]), lambda x: x.isNotNull())
    return df.select(F.lit(label).alias("heading"), F.concat(F.lit("| "), F.array_join(cells, "; ")).alias("line"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files: white space tidied line by line, at most one empty line between others, none around the text."""
    lines = F.split("value", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    text = F.regexp_replace(F.array_join(F.transform(lines, tidy_inline), "\n"), r"\n{3,}", "\n\n")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.btrim(text, F.lit(" \t\n")).alias("text"))


def csv_document(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A CSV file as one text: its label as a heading, then a line for each row, in file order."""
    table = spark.read.option("header", True).csv(path)
    lines = csv_lines(table, label).withColumn("n", F.monotonically_increasing_id())
    rows = lines.groupBy("heading").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows"))
    return rows.select(F.concat(F.lit("## "), "heading", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


def read_sources(spark: SparkSession, registry: list[dict]) -> DataFrame:
    """Union of the registered sources: kind csv, csv_pii, markdown, jsonl or pdf_text; market IN unless said; missing files skipped.

    A table with personal data (csv_pii) is a CRM export, other tables internal ones.  Of a PDF the text
    that another provider has extracted is read (whole text files).
    """
    out = spark.createDataFrame([], DOCUMENT)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for entry in registry:
        where = hadoop(entry["path"])
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            continue
        meta = [F.lit(entry["id"]).alias("doc_id"), F.lit(entry.get("title", entry["id"])).alias("title")]
        kind = {"csv": "internal_table", "csv_pii": "crm_export", "markdown": "internal_handbook", "pdf_text": "internal_pdf"}.get(entry["kind"], entry["kind"])
        tail = [F.lit(kind).alias("source_type"), F.lit(entry.get("market", "IN")).alias("market")]
        if entry["kind"] in ("csv", "csv_pii"):
            found = csv_document(spark, entry["path"], entry.get("title", entry["id"])).select(*meta, "text", *tail)
        elif entry["kind"] in ("markdown", "pdf_text"):
            found = read_markdown(spark, entry["path"]).select(*meta, "text", *tail)
        elif entry["kind"] == "jsonl":
            found = read_jsonl(spark, entry["path"], DOCUMENT).select("doc_id", "title", "text", *tail)
        else:
            raise ValueError(f"{entry['id']}: unknown kind {entry['kind']}")
        out = out.unionByName(found)
    return out


def write_index(records: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the index, laid out by ``by``, so that searches prune partitions."""
    records.write.mode("overwrite").partitionBy(*by).parquet(path)


#: Ranges of record ids of an index laid out for reads by id.
BUCKETS = 64


def write_records(records: DataFrame, path: str, key: str = "record_id") -> None:
    """Replaces an index laid out by a hash of the record's id, so that a read by id opens one folder."""
    records.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_records(spark: SparkSession, path: str, ids: list, key: str = "record_id") -> DataFrame:
    """The records of the given ids; partitions of other ids are not opened."""
    buckets = [r.b for r in spark.createDataFrame([(str(i),) for i in ids], "id string").select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(buckets) & F.col(key).isin(ids)).drop("bucket")


def manifest_scan(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """url, path and html of manifest entries (url, html_path) whose file is stored (path, html)."""
    entries = manifest.filter("coalesce(html_path, '') <> ''").select("url", F.col("html_path").alias("path"))
    return entries.join(stored.filter("html is not null"), "path")


def write_snapshot(records: DataFrame, folder: str, stamp: str) -> None:
    records.write.mode("errorifexists").parquet(f"{folder}/versions/{stamp}")


def append_leads(leads: DataFrame, path: str) -> None:
    leads.write.mode("append").json(path)


def pdf_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Binary files that start as a PDF does; their text is another provider's work."""
    return spark.read.format("binaryFile").load(path).filter(F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF"))


def keep_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: the new row wins; rows only in one side stay."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_turn")))).filter("_n = 1").drop("_turn", "_n")
