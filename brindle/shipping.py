"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch; long rows then come a few at a time.
BATCH_BYTES = 2 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="brindle-")) / "brindle_source.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(target))
    _sent.add(context.applicationId)


def _given_back(function: Callable) -> Callable:
    """``function``, after which the worker hands its free memory back: Spark keeps workers for later tasks."""

    def run(batches: Iterable) -> Iterator:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return run


def _bounded(spark: SparkSession) -> None:
    """The package at hand in the workers, and batches bounded by bytes as well as by rows.

    A worker's memory then does not depend on how long the rows are; a setting of the user's own stays.
    """
    ship(spark)
    if spark.conf.get(_LIMIT) == _DEFAULT:  # with a default of its own, get() would not tell the one of Spark
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand in the workers and bounded batches."""
    _bounded(df.sparkSession)
    return df.mapInArrow(_given_back(function), schema)


def map_pandas(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInPandas`` with the package at hand in the workers and bounded batches."""
    _bounded(df.sparkSession)
    return df.mapInPandas(_given_back(function), schema)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its scan gives fewer (small files of one row group).

    Large tables have more partitions than cores and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
