"""Mixing sources to target weights along a time-varying curriculum (operator 8).

Sources, in code-point order with null last, take the ``schedules`` in turn.  A schedule is the
source's weight at the start and at the end of training, linear between; its integral is the
source's weight (3, 1 and 2 by default).  The sources share ``share`` (150 %) of all words by
weight; none gets more than ``most`` (2) times its words, and the excess is shared again by weight
until none is above.  That is one level L with target = min(weight x L, most x words).

Inside a source the documents queue in the order of a hash of their id.  Whole passes over the
queue come first, then a last pass over its beginning; the document where the target is met is
taken in part, so a source's taken words are its rounded target.  The word that stands at fraction
u of the source's demand is due at the time t with F(t) = u, F being the integral of the schedule
up to t over the whole integral; inverting F gives each copy of a document its training position.
The result is range-sorted by position.

Everything is DataFrame expressions.  The running sums over a source are split by ranges of the
hash, so a source with a third of all rows is spread over many tasks.

Defined results: null texts have size 0, the longest are counted whole; documents of size 0 are taken
0 times; a null source is a source, sorted last; among documents of one hash the smaller id, then the
smaller size, is first in the queue; equal positions are sorted by id; repeated rows are documents of
their own; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

SCHEDULES = ((3.0, 3.0), (0.5, 1.5), (3.0, 1.0))
WORD = r"[^\x20\x09-\x0D]++"
_HASH_BITS = 60


def ranked(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``rank`` 0, 1, 2 ... by ``key`` (null last), without one task seeing all rows."""
    parts = df.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "ranges")
    counts = parts.groupBy("part").count()
    before = F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row for each partition
    counts = counts.select(F.col("part").alias("own_part"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col(key).asc_nulls_last()))
    return (
        parts.withColumn("inside", inside)
        .join(F.broadcast(counts), F.col("part") == F.col("own_part"))  # one row for each partition
        .withColumn("rank", F.col("inside") + F.col("before") - 1)
        .drop("part", "own_part", "inside", "before")
    )


def source_targets(sizes: DataFrame, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, first_weight, last_weight and target of every source."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.col("rank") % len(schedules)
    first = F.element_at(F.array(*[F.lit(float(a)) for a, _ in schedules]), (turn + 1).cast("int"))
    last = F.element_at(F.array(*[F.lit(float(b)) for _, b in schedules]), (turn + 1).cast("int"))
    weight = (F.col("first_weight") + F.col("last_weight")) / 2
    sources = ranked(per_source, "source").withColumn("first_weight", first).withColumn("last_weight", last)
    sources = materialize(sources.withColumn("weight", weight).drop("rank"), "sources")
    cap = F.col("source_size") * F.lit(most)
    level, capped = 0.0, -1
    while True:  # each round caps at least one more source; two numbers come back from each
        above = F.col("weight") * F.lit(level) > cap
        got = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.sum(F.when(above, 1).otherwise(0)).alias("capped"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if got.capped == capped or not got.open:
            break
        level, capped = (got["all"] * share - got.fixed) / got.open, got.capped
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).drop("weight")


def due(fraction: F.Column, first: F.Column, last: F.Column) -> F.Column:
    """The time in 0 .. 1 by which a linear schedule has delivered ``fraction`` of its integral."""
    bend = (last - first) / (first + last)
    steep = (-(1 - bend) + F.sqrt((1 - bend) * (1 - bend) + 4 * bend * fraction)) / (2 * bend)
    return F.round(F.when(first == last, fraction).otherwise(steep), 9)


def allocate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, rows_per_range: int = 50_000,
) -> DataFrame:
    """A row for each document: its size, source_size, target, taken words, and the positions of
    its first and second copy (null if there is none), range-sorted by the first."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.conv(F.substring(F.md5(F.col(id_col).cast("long").cast("string")), 1, _HASH_BITS // 4), 16, 10).cast("long")
    sizes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        size.alias("size"), F.coalesce(order, F.lit(0)).alias("place"),
    )
    sizes = materialize(sizes, "sizes")
    ranges = max(64, -(-sizes.count() // rows_per_range))
    sizes = sizes.withColumn("range", F.floor(F.col("place") / F.lit((1 << _HASH_BITS) / ranges)).cast("int"))
    targets = source_targets(sizes, schedules, share, most)
    by_range = sizes.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    by_range = by_range.select("source", "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    starts = by_range.join(targets, by_range.source.eqNullSafe(targets.source)).select(
        by_range.source.alias("s"), F.col("range").alias("r"), "ahead", "source_size", "first_weight", "last_weight", "target"
    )
    inside = F.sum("size").over(
        W.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    )
    rows = sizes.withColumn("within", F.coalesce(inside, F.lit(0)))
    rows = rows.join(starts, rows.source.eqNullSafe(F.col("s")) & (rows.range == F.col("r")))
    total = F.round("target").cast("long")
    rows = rows.withColumn("total", total).withColumn("before", F.col("ahead") + F.col("within"))
    passes = F.when(F.col("source_size") > 0, F.expr("total div source_size")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("passes", passes).withColumn("rest", F.col("total") - F.col("passes") * F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    rows = rows.withColumn("part", part).withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))

    def position(copy: int) -> F.Column:
        held = (F.col("size") > 0) & ((F.col("passes") > copy) | ((F.col("passes") == copy) & (F.col("part") > 0)))
        at = (F.col("before") + F.lit(copy) * F.col("source_size")) / F.col("total")
        return F.when(held, due(at, F.col("first_weight"), F.col("last_weight")))

    return rows.select(
        "doc_id", "size", "source_size", "target", "taken",
        position(0).alias("position"), position(1).alias("second_position"),
    ).orderBy("position", "doc_id")
