"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, tuple[object, object]] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="brindle-checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def write(df: DataFrame, name: str = "step") -> str:
    """Writes ``df`` as Parquet under the shared folder; its path.  Removed when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made[path] = (target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so later steps neither recompute it nor
    depend on an executor that may be lost."""
    path = write(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing will read any more."""
    for df in tables:
        system, target = _made.pop(_paths.pop(df))
        system.delete(target, True)


def discard() -> None:
    """Deletes the tables written; results not yet read need them."""
    while _made:
        system, target = _made.popitem()[1]
        try:
            system.delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone
            return


atexit.register(discard)
