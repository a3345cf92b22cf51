"""Target-distribution importance resampling with hashed n-gram features (operator 13).

A text's words are the runs of digits, ASCII letters (A-Z lower-cased) and characters above ASCII;
its features are all runs of 1 to ``most_words`` consecutive words, joined by one space, repeats
counted.  A feature's bucket is its crc32 modulo ``buckets``.  The corpus and the target texts give
two counts for each bucket; a bucket's gain is the logarithm of how much likelier the target holds
it (add-one smoothing), in thousandths, rounded down.  A document's weight is the floored mean of
the gains over its features.  Adding a Gumbel number, made from a hash of the id, to the weight and
taking the highest scores draws documents without replacement in proportion to e^(weight / 1000).

The steps, all of them DataFrame expressions: each text is cut and hashed once, its bucket numbers
are written with a row number; exploded buckets are counted (combined before the shuffle); the gain
table has one row for each bucket, so it is broadcast (at most ``buckets`` rows); gains are summed
for each row, again combined before the shuffle; rows are range-sorted by score and written with
their place in their partition, and a partition's offset, the sum of the counts before it, makes
the rank.  No task sees all rows, and only one count for each partition is joined by broadcast.

Defined results: null and empty texts, and texts without words, have no features and weight 0, and
are never drawn; the longest texts are cut whole; of equal scores the smaller id comes first, a null
id last; a null id is hashed as the empty string; repeated rows are rows of their own, each with its
own rank; an empty target gives every bucket its smoothed gain; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

# Fixed value: a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def grams(found: Column, most_words: int) -> Column:
    """All runs of 1 to ``most_words`` consecutive words of an array of words."""

    def runs(n: int) -> Column:
        joined = F.transform(found, lambda _, i: F.when(i <= F.size(found) - n, F.concat_ws(" ", *[F.get(found, i + k) for k in range(n)])))
        return F.array_compact(joined)

    return F.concat(found, *map(runs, range(2, most_words + 1)))


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def features(texts: DataFrame, buckets: int, most_words: int, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """row, doc_id (with ``id_col``), n_words and the bucket numbers of every text, written to the shared folder."""
    ids = [F.col(id_col).cast("long").alias("doc_id")] if id_col else []
    rows = texts.select(F.monotonically_increasing_id().alias("row"), *ids, words(F.col(text_col)).alias("words"))
    made = F.transform(grams(F.col("words"), most_words), lambda g: bucket_of(g, buckets))
    return materialize(rows.select("row", *(["doc_id"] if id_col else []), F.size("words").alias("n_words"), made.alias("buckets")), "features")


def bucket_counts(made: DataFrame, name: str) -> DataFrame:
    return made.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain of every bucket that the corpus holds; ``corpus`` and ``target`` are from ``features``."""
    ours, theirs = bucket_counts(corpus, "s"), bucket_counts(target, "t")
    totals = ours.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(theirs.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))  # one row each
    both = ours.join(theirs, "bucket", "left").withColumn("t", F.coalesce("t", F.lit(0))).crossJoin(F.broadcast(totals))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, rounded down, that depends on the seed and the id alone."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(corpus: DataFrame, gain: DataFrame) -> DataFrame:
    """row, doc_id, n_words, n_features and weight of every text of ``features``."""
    each = corpus.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    summed = each.join(F.broadcast(gain), "bucket", "left").groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    mean = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(F.lit(0)).cast("long")
    return summed.select("row", "doc_id", "n_words", "n_features", mean.alias("weight"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, most_words: int = 1,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it was not drawn.

    Of the N documents with at least ``least_words`` words, floor(percent x N / 100) are drawn.
    """
    spark = docs.sparkSession
    corpus = features(docs, buckets, most_words, id_col, text_col)
    gain = gains(corpus, features(target, buckets, most_words, None, target_text), buckets)
    scored = weights(corpus, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("short", F.col("n_words") < least_words)
    order = [F.col("short"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features")]  # documents that cannot be drawn come last
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(placed.select("doc_id", "n_features", "weight", "score", "short", F.monotonically_increasing_id().alias("place")), "placed")
    part = F.shiftright("place", _PLACE_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("short"), 0).otherwise(1)).alias("able"))
    earlier = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    drawn = F.floor(F.sum("able").over(W.partitionBy()) * percent / 100)
    counts = counts.select("part", earlier.alias("earlier"), drawn.alias("drawn"))
    rank = F.col("earlier") + F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(counts), "part")  # one row for each partition
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).cast("long").alias("rank"))
