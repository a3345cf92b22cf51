"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import forget, materialize


SALTS = 8


def salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def copied(table: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return table.withColumn("salt", F.explode(F.array(*[F.lit(n) for n in range(SALTS)])))


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node of every node in ``links`` (two BIGINT columns ``a`` and ``b``).

    Each round takes the smallest label among neighbours (a partial aggregate, so a hub costs one
    row per task) and then the label's own label, which halves the remaining depth.  A label that
    half a component carries, and a node with as many links, are one key each: the table with one
    row a key is copied ``SALTS`` times and the other dealt over the copies, so no task holds more
    than its share.  Labels are written to the shared folder each round, and those of the round
    before removed.  Returns ``node``, ``label``; no rows for no links.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        "links",
    )
    held = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    labels = held
    for _ in range(max_rounds):
        known = copied(labels.select(F.col("node").alias("a"), "label"))
        told = both.withColumn("salt", salt("b")).join(known, ["a", "salt"]).groupBy(F.col("b").alias("told_node")).agg(F.min("label").alias("told"))
        near = labels.join(told, F.col("node") == F.col("told_node"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "told").alias("label")
        )
        near = materialize(near, "near")
        # only labels' own rows are looked up, and a label is a node of its component
        tops = near.select("label").distinct()
        above = copied(near.join(tops.withColumnRenamed("label", "node"), "node").select(F.col("node").alias("label"), F.col("label").alias("up")))
        new = near.withColumn("salt", salt("node")).join(above, ["label", "salt"]).select("node", "old", F.least("label", "up").alias("label"))
        new = materialize(new, "labels")
        forget(held, near)
        held, labels = new, new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            forget(both)
            return labels
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def attach(rows: DataFrame, table: DataFrame, key: str, copies: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key, with how many of ``rows`` have it in ``copies``).

    Keys that hold over 1 / ``share`` of the rows, fewer than ``share`` of them, meet their rows by broadcast,
    the others by a shuffle, so a key of a third of all rows is not one task's work.
    """
    total = table.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("n")).first().n
    hot = F.col(copies) * share > total
    often, rare = table.filter(hot).drop(copies), table.filter(~hot).drop(copies)
    met = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(rare, key)
    return met.unionByName(rest)
