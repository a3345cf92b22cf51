"""Cross-site boilerplate lines by distinct-site spread (operator 5).

A line is a text's part between line feeds, without spaces, tabs and carriage returns at its ends.
For each line hash a HyperLogLog sketch of the sites (``source``) that hold it merges by
aggregation.  Sketches whose estimate lies within the error band around ``min_sites`` get an exact
distinct count; lines clearly below stay, lines clearly above are boilerplate.  A boilerplate line
is kept where it stands first (smallest document id, then line number) and removed elsewhere, so
no passage vanishes from the corpus.

The lines found travel to the workers if there are at most ``most_broadcast`` of them (24 bytes
each); beyond that the line numbers to remove are found by joins and only they are shuffled.

Defined results: blank lines are never removed; null texts stay null (0 lines); a null site counts
as no site; repeated rows are treated alike; documents whose every line goes keep their row with
an empty text; the longest texts are cut into their lines whole; an empty table gives an empty result;
other columns, whatever their names, are kept by ``remove_boilerplate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from . import kernels
from .components import attach
from .storage import materialize

MIN_SITES, LG_BUCKETS = 5, 12
#: Lines near or above the threshold that are broadcast to count their sites.
MOST_SPREAD = 500_000
_EDGE = " \t\r"
#: Three standard errors of the sketch.
BAND = 3 * 1.04 / (1 << LG_BUCKETS) ** 0.5


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line_no", "line"),
    )
    rows = rows.select("doc_id", "site", "line_no", F.btrim("line", F.lit(_EDGE)).alias("line")).filter("line <> ''")
    return rows.select("doc_id", "site", "line_no", F.xxhash64("line").alias("hash"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """hash, first_doc, first_line and times of every line that stands on at least ``min_sites`` sites."""
    lines = _lines(docs, id_col, text_col, site_col)
    band = max(1.0, BAND * min_sites)
    spread = lines.groupBy("hash").agg(F.hll_sketch_agg("site", LG_BUCKETS).alias("sketch"))
    spread = spread.select(F.col("hash").alias("wide"), F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialize(spread.filter(F.col("sites") >= min_sites - band), "spread")
    near = F.col("sites") <= min_sites + band
    if spread.count() <= MOST_SPREAD:  # 16 bytes each; then a line that every page holds is no task's key
        spread = F.broadcast(spread)
    wide = lines.join(spread, F.col("hash") == F.col("wide"))
    found = wide.groupBy("hash").agg(
        F.max("sites").alias("sites"),
        F.countDistinct(F.when(near, F.col("site"))).alias("exact"),
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times"),
    )
    sure = F.when(near, F.col("exact") >= min_sites).otherwise(True)
    return materialize(
        found.filter(sure).select("hash", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"), "times"),
        "boilerplate",
    )


class _Known:
    """The boilerplate lines as sorted arrays."""

    def __init__(self, table: pa.Table):
        hashes = table.column("hash").to_numpy()
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.docs = [table.column("first_doc")[int(i)].as_py() for i in order]
        self.lines = table.column("first_line").to_numpy()[order]

    def strip(self, doc: int | None, text: bytes) -> tuple[bytes, int, int]:
        """(text without boilerplate, its lines before, lines removed)."""
        parts = text.split(b"\n")
        if not len(self.hashes):
            return text, len(parts), 0
        trimmed = [p.strip(_EDGE.encode()) for p in parts]
        found = np.array([xxhash.xxh64_intdigest(p, 42) for p in trimmed], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        drop = {
            n for n in np.flatnonzero(self.hashes[at] == found).tolist()
            if trimmed[n] and not (self.docs[at[n]] == doc and self.lines[at[n]] == n)
        }
        return (b"\n".join(p for n, p in enumerate(parts) if n not in drop) if drop else text), len(parts), len(drop)


def _free(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _by_broadcast(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_Known(known.select("hash", "first_doc", "first_line").toArrow()))
    place = docs.columns.index(text_col)
    counts = _free(docs.columns, "lines_before", "lines_removed")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = shared.value.strip
        for batch in kernels.small_batches(batches, text_col):
            column = batch.column(place)
            valid = column.is_valid().to_pylist()
            ids = batch.column(id_col).to_pylist()
            out = [strip(d, t) if ok else (None, 0, 0) for d, t, ok in zip(ids, kernels.text_bytes(column), valid)]
            texts, before, removed = zip(*out)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            columns += [pa.array(before, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *counts])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *[T.StructField(name, T.LongType()) for name in counts]]))


def _by_join(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """The same by joins on line hash, then on (document, text): for any number of lines."""
    text_key, its_doc, its_key, drop, before, removed = _free(docs.columns, "text_key", "its_doc", "its_key", "drop_lines", "lines_before", "lines_removed")
    keyed = docs.withColumn(text_key, F.xxhash64(F.col(text_col).cast("string")))
    rows = keyed.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_key).alias("key"),
        F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line_no", "line"),
    )
    rows = rows.withColumn("line", F.btrim("line", F.lit(_EDGE))).filter("line <> ''")
    rows = rows.withColumn("hash", F.xxhash64("line")).drop("line")
    hit = attach(rows, known, "hash", "times").filter(
        ~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line")))
    )
    drops = hit.groupBy(F.col("doc").alias(its_doc), F.col("key").alias(its_key)).agg(F.collect_set("line_no").alias(drop))
    out = keyed.join(drops, keyed[id_col].cast("long").eqNullSafe(F.col(its_doc)) & (F.col(text_key) == F.col(its_key)), "left")
    parts = F.split(F.col(text_col).cast("string"), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, n: ~F.array_contains(drop, n)), "\n")
    return out.withColumns(
        {
            text_col: F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept),
            before: F.coalesce(F.size(parts), F.lit(0)).cast("long") * F.col(text_col).isNotNull().cast("long"),
            removed: F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long"),
        }
    ).drop(text_key, its_doc, its_key, drop)


def _stripped(docs, min_sites, id_col, text_col, site_col, most_broadcast) -> DataFrame:
    known = boilerplate(docs, min_sites, id_col, text_col, site_col)
    if known.count() <= most_broadcast:
        return _by_broadcast(docs, known, id_col, text_col)
    return _by_join(docs, known, id_col, text_col, site_col)


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
    site_col: str = "source", most_broadcast: int = 1_000_000,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; all rows and columns stay."""
    return _stripped(docs, min_sites, id_col, text_col, site_col, most_broadcast).select(*docs.columns)


def line_report(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text",
    site_col: str = "source", most_broadcast: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(site_col).cast("string").alias("source"))
    out = _stripped(rows, min_sites, "doc_id", "text", "source", most_broadcast)
    return out.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_removed").alias("n_removed"), "text")
