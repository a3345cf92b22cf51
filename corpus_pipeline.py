"""The training-data pipeline: five operators in turn over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and
reads it again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, lines, mixing, quality, similar
from brindle.llm.storage import materialize
from brindle.shipping import spread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier, trained on ``docs``, rejects go.

    Null and empty texts get the share of good rows in the sample and stay; repeated rows share their fate;
    an empty table gives an empty one, and without labels every document stays.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that many sources share stay where they stand first; no document goes.

    Null texts stay null, an empty table gives an empty one, and equal rows are told apart by their order.
    """
    out = lines.remove_boilerplate(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group linked by five-word shingles and a similarity of 0.8 the row of the smallest id stays.

    A null id comes after every other, and an id with several texts stays with each text that its group has it first for.
    Texts without words (null, empty) are one group; of equal rows one stays; an empty table gives an empty one.
    """
    return similar.one_of_each_group(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows share their fate; an empty table gives an empty one.
    """
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: what each document gives to the mix, in training order.

    Null and empty texts give no words and keep their row; a null source is one of its own, the last;
    repeated rows are rows of their own; an empty table gives no rows.
    """
    return mixing.allocate(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no form for the trained classifier and the linked groups; tests/llm hold brute-force versions.
ORACLE_SQL = None
