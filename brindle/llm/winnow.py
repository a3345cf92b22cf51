"""Document fingerprints by winnowing (operator 12), by DataFrame expressions only.

A text is cut into tokens: runs of up to eight code points without white space.  The hash of every
run of ``gram`` consecutive tokens is taken as the run rolls on by one token; of every ``window``
consecutive hashes the smallest is kept, the rightmost of equal ones, with its position.  So any
two texts that share ``gram + window - 1`` tokens in a row share a kept hash, and no shared run
under ``gram`` tokens counts.

A hash takes 32 bits and stands above the position, counted backwards, in one long: the least long
of a window is then the smallest hash and, of equal ones, the rightmost.  Each text is read once for
its tokens, once for its hashes and once for its windows, in arrays of its own row: nothing is
exploded, sorted or shuffled for it, and the work is linear in the text's length.

``followed`` pairs each document with the next by descending id without a global window.  Ids are cut
into bins by approximate quantiles (a bounded number); an id that fills several bins is cut by a hash
of its texts.  Texts move once, to their bin; the first row of every bin is also sent to the bin
before it, so each row finds its next in its own bin.

Defined results: null counts as empty; a text without tokens has an empty fingerprint; one of fewer
than ``gram`` tokens has one hash, of all of them, and one of fewer than ``window`` hashes keeps one;
two empty fingerprints are alike (1.0), an empty and another not at all (0.0).  A text takes
memory in proportion to its length, whole.  Null ids come after all others; rows of one id follow each other by a
hash of their texts, then by text; a single document is its own next; repeated rows give repeated
rows; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens of one hash, and hashes of one window.
GRAM, WINDOW = 4, 8
# Fixed value: a token.
TOKEN = r"[^\x20\x09-\x0D]{1,8}+"
_HASH, _PLACES = (1 << 32) - 1, (1 << 31) - 1
#: Bins of ids: at least, and at most (the driver holds a few numbers for each).
LEAST_BINS, MOST_BINS, ROWS_OF_BIN = 256, 10_000, 2_000


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprint as longs, in the order of positions: hash << 31 | (2^31 - 1 - position)."""
    whole = lambda t: F.when((F.size(t) > 0) & (F.size(t) < gram), F.array(F.array_join(t, " "))).otherwise(t)
    many = lambda t: F.greatest(F.size(t) - gram + 1, F.least(F.size(t), F.lit(1)))

    def hashes(t: Column) -> Column:
        packed = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(_HASH)), 31).bitwiseOR(F.lit(_PLACES).cast("long") - i)
        return F.transform(t, lambda x, i: F.when(i < many(t), packed(F.xxhash64(x, *[F.get(t, i + k) for k in range(1, gram)]), i)))

    def kept(t: Column) -> Column:
        least = _once(hashes(t), lambda h: F.transform(h, lambda x, i: F.least(x, *[F.get(h, i + k) for k in range(1, window)])))
        return F.slice(least, F.lit(1), F.greatest(many(t) - window + 1, F.least(many(t), F.lit(1))))

    tokens = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(_once(_once(tokens, whole), kept))


def hashes_of(found: Column) -> Column:
    """The distinct hashes of ``marks``."""
    return F.array_distinct(F.transform(found, lambda v: F.shiftright(v, 31)))


def told(found: Column) -> Column:
    """``marks`` as text: hash (eight hex digits) and token position of each, comma-joined."""
    one = lambda v: F.concat(F.lpad(F.lower(F.hex(F.shiftright(v, 31))), 8, "0"), F.lit(":"), (F.lit(_PLACES).cast("long") - v.bitwiseAND(F.lit(_PLACES).cast("long"))).cast("string"))
    return F.array_join(F.transform(found, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    both, common = F.size(a) + F.size(b), F.size(F.array_intersect(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(common / (both - common))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and marks (hash, position) of every text; positions count tokens from 0."""
    one = lambda v: F.struct(F.shiftright(v, 31).alias("hash"), (F.lit(_PLACES).cast("long") - v.bitwiseAND(F.lit(_PLACES).cast("long"))).cast("int").alias("position"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.transform(marks(F.col(text_col), gram, window), one).alias("marks"))


def _count(bounds: Column, n: int, value: Column, equal: bool) -> Column:
    """How many of ``n`` sorted bounds lie below ``value`` (or at it, with ``equal``), by halving."""
    steps = [1 << p for p in reversed(range(n.bit_length()))]
    below = lambda at: (F.get(bounds, at) <= value) if equal else (F.get(bounds, at) < value)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.coalesce(below(at + step - 1), F.lit(False)), at + step).otherwise(at))


def _bin(doc_id: Column, mix: Column, bounds: list[int], bins_of_null: int) -> Column:
    """The bin of a row; higher ids, and of one id higher hashes, never have a lower bin."""
    share = lambda m: F.least(F.floor(mix / F.lit(float(1 << 63)) * m), m - 1)
    empty = share(F.lit(bins_of_null)) - bins_of_null
    if not bounds:
        return empty.cast("int")
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    spans = F.struct(_count(held, len(bounds), doc_id, False).alias("lt"), _count(held, len(bounds), doc_id, True).alias("le"))
    placed = _once(spans, lambda s: F.when(s["le"] - s["lt"] < 2, s["le"].cast("long")).otherwise(s["lt"] + 1 + share(s["le"] - s["lt"])))
    return F.when(doc_id.isNull(), empty).otherwise(placed).cast("int")


def followed(docs: DataFrame, made: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null as empty), what ``made`` computes from the text, and all but the id again as next_... of the next document.

    The next document is that of the next smaller id; after the last comes the first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mix", F.shiftrightunsigned(F.xxhash64("text"), 1))
    total, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    bins = min(MOST_BINS, max(LEAST_BINS, total // ROWS_OF_BIN))
    places = [n / bins for n in range(1, bins)]
    bounds = rows.agg(F.percentile_approx("doc_id", places, 20 * bins)).first()[0] if known else []
    rows = rows.withColumn("bin", _bin(F.col("doc_id"), F.col("mix"), bounds, max(1, round(bins * (total - known) / max(total, 1)))))
    firsts = rows.groupBy("bin").agg(F.max(F.struct("doc_id", "mix")).alias("first")).orderBy(F.desc("bin")).collect()  # a row for each bin
    before = [(r.bin, firsts[n - 1].bin, r.first.doc_id, r.first.mix) for n, r in enumerate(firsts)]
    edges = spark.createDataFrame(before, "bin int, before int, first_id long, first_mix long")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mix") == F.col("first_mix"))
    own, guest = F.struct(F.col("bin").alias("bin"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("bin"), F.lit(True).alias("guest"))
    sent = rows.join(F.broadcast(edges), "bin").select("doc_id", "text", "mix", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = sent.select("doc_id", "text", "mix", "to.bin", "to.guest").repartition(parts, "bin").select("*", *[c.alias(name) for name, c in made.items()])
    order = W.partitionBy("bin").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("mix"), F.desc("text"))
    named = ["text", *made]
    return held.select("doc_id", *named, "guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in named]).filter(~F.col("guest")).drop("guest")


def digest(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next document.

    The edited text has its last third (rounded down) replaced by as many first code points of the next document.
    """
    rows = followed(docs, {"marks": marks(F.col("text"), gram, window), "n_chars": F.length("text").cast("long")}, id_col, text_col)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "marks", hashes_of(F.col("next_marks")).alias("next_hashes"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "marks", hashes_of(F.col("marks")).alias("hashes"), "next_hashes", F.sha2("edited", 256).alias("edited_sha256"), marks(F.col("edited"), gram, window).alias("edited_marks"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", told(F.col("marks")).alias("fingerprint"), told(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes_of(F.col("edited_marks"))).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
