"""SimHash near-duplicate groups of a stated similarity, with pigeonring filtering (operator 6).

Two texts are linked when the sets of their word shingles (five words, A-Z lower-cased) have a Jaccard
similarity of 0.8 or more; a group is a connected component of links.  Texts of that similarity differ
in some 15 % of the bits of a SimHash, too many for the index of ``simhash.py``, so here

1. texts with equal shingle sets form one class, and only classes go on;
2. each class gets a SimHash of 256 bits and 24 bucket keys, each drawn from 4 minima of rehashed
   shingles (a pair of similarity 0.8 shares no key with probability (1 - 0.8^4)^24 = 3e-6);
3. every member of a bucket is paired with the bucket's smallest class: as many pairs as members.
   A pair that has the similarity is a link;
4. members of a bucket that still holds several components then meet within a task, bucket by bucket,
   with their shingle sets: only one link for each joined component leaves it, never the pairs;
5. a pair passes the pigeonring test on the 256 bits, 32 segments of 8 and radius 80 (a chain whose
   every prefix of l segments differs in at most floor(80 l / 32) bits), then the full Hamming check.
   A pair of similarity 0.8 differs in 39 bits on average, 49 at most for short texts: 80 is five
   standard deviations away;
6. what is left is verified by the exact similarity.

Long values never gather on one task: groups of equal texts are counted by partial aggregates, buckets
are joined by key with their smallest class, a class with many partners is dealt out by a salt, and a
bucket of many rows or shingles is cut into blocks whose pairs go to separate tasks.

Defined results: texts without words (null, empty, white space) are one class; a text of fewer words
than a shingle is one shingle; repeated rows fall in one class, and an id with several texts keeps a row
for each; an empty table gives no rows; other columns are ignored.  Rows with a null id take no part in
``similar_groups``; in ``one_of_each_group`` they are rows like others, whose id comes after every other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import kernels
from .components import attach, connected_components
from .simhash import bit_votes
from .storage import materialize

WIDTH, SIMILARITY = 5, 0.8
BANDS, MINIMA = 24, 4
BITS, SEGMENTS, RADIUS = 256, 32, 80
#: Differing bits allowed in a chain's first 1, 2, ... 32 segments.
BUDGETS = np.array([RADIUS * n // SEGMENTS for n in range(1, SEGMENTS + 1)])
#: Partners of one class that are verified by one task.
PARTNERS = 256
#: Rows of one or two numbers that may be broadcast (some 20 MB).
MOST_BROADCAST = 1 << 18
#: Rows, and shingles of them, of one block of a bucket.
MEMBERS, SHINGLES = 2048, 1 << 22

_PRINTS = [f"f{n}" for n in range(BITS // 64)]
_SALTS = kernels.mix64(np.arange(1, len(_PRINTS) + 1, dtype=np.uint64))
_FACTORS = kernels.mix64(np.arange(101, 101 + BANDS * MINIMA, dtype=np.uint64)) | np.uint64(1)
_PIECE = 1 << 10
#: Shingles looked up at once.
_FLAT = 1 << 18


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = kernels.hash_words(text)[0]
    return np.unique(kernels.shingle_hashes(words, min(width, len(words)))) if len(words) else words


def sketch(shingles: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Class id, SimHash (four BIGINT) and bucket keys of a shingle set."""
    cid = np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64)
    votes = np.zeros((len(_PRINTS), 64), np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _PIECE):
        part = shingles[at : at + _PIECE]
        votes += [bit_votes(kernels.mix64(part ^ salt)) for salt in _SALTS]
        np.minimum(least, (_FACTORS[:, None] * part[None, :]).min(axis=1), out=least)
    prints = np.packbits((2 * votes > len(shingles)).astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()
    rows = least.reshape(BANDS, MINIMA)
    keys = np.arange(BANDS, dtype=np.uint64)
    for n in range(MINIMA):
        keys = kernels.mix64(keys * np.uint64(0x100000001B3) + rows[:, n])
    return int(cid), prints, keys.view(np.int64)


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "text"):
            sets = [shingle_set(x, width) for x in kernels.text_bytes(batch.column("text"))]
            found = [sketch(x) for x in sets]
            prints, keys = np.array([x[1] for x in found]), np.concatenate([x[2] for x in found])
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([x[0] for x in found], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, prints.T.copy()), pa.ListArray.from_arrays(ends, pa.array(keys))],
                ["doc_id", "row", "cid", "n", *_PRINTS, "keys"],
            )

    return map_arrow(rows.select("doc_id", "row", "text"), run, "doc_id long, row long, cid long, n long, " + "".join(f"{f} long, " for f in _PRINTS) + "keys array<long>")


def ring_holds(segments: np.ndarray) -> np.ndarray:
    """Whether some chain of the ring keeps within its budget at every length; rows of differing bits per segment."""
    ok = np.zeros(len(segments), bool)
    ring = np.concatenate((segments, segments), axis=1).astype(np.int32)
    for start in range(SEGMENTS):
        rest = np.flatnonzero(~ok & (ring[:, start] <= BUDGETS[0]))
        ok[rest] = (np.cumsum(ring[rest, start : start + SEGMENTS], axis=1) <= BUDGETS).all(axis=1)
    return ok


def near_prints(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows (four BIGINT each) lie within RADIUS: the ring test first, then the full distance."""
    segments = np.bitwise_count(np.ascontiguousarray(x ^ y).view(np.uint8).reshape(len(x), SEGMENTS))
    ok = ring_holds(segments)
    ok[ok] = segments[ok].sum(axis=1, dtype=np.int64) <= RADIUS
    return ok


def _pruned(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs with near fingerprints; ``pairs`` has them as a_f0 ... and b_f0 ..."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.stack([batch.column(f"{side}_{f}").to_numpy() for f in _PRINTS], axis=1) for side in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(near_prints(x, y)))

    return map_arrow(pairs, run, "a long, b long")


def _with_prints(pairs: DataFrame, classes: DataFrame, side: str) -> DataFrame:
    found = classes.select(F.col("cid").alias(side), *[F.col(f).alias(f"{side}_{f}") for f in _PRINTS])
    return pairs.join(found, side)


def _small(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``table``, marked for broadcast if it has at most ``most`` rows (of a number or two), so that texts stay where they are."""
    return F.broadcast(table) if table.count() <= most else table


def _sets(ids: DataFrame, rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """cid and shingles (the set's bytes) of the classes in ``ids`` (cid, distinct); only their first texts are read out."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "text"):
            found = [shingle_set(x, width) for x in kernels.text_bytes(batch.column("text"))]
            cids = [int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64)) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["cid", "shingles"]
            )

    wanted = materialize(classes.join(ids, "cid").select(F.col("first.row").alias("row")).distinct(), "wanted")
    texts = rows.join(_small(wanted), "row", "left_semi").select("text")
    return materialize(map_arrow(texts, sets, "cid long, shingles binary").dropDuplicates(["cid"]), "sets")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = _sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), rows, classes, width)
    loads = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")), "loads")
    many = loads.filter("salts > 1")
    dealt = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    firsts = found.join(loads, F.col("cid") == F.col("a")).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("shingles").alias("a_set")
    )
    seconds = found.select(F.col("cid").alias("b"), F.col("shingles").alias("b_set"))
    both = dealt.select("a", "b", "salt").join(firsts, ["a", "salt"]).join(seconds, "b").select("a", "b", "a_set", "b_set")
    return map_arrow(both, alike, "a long, b long")


def _buckets(classes: DataFrame) -> DataFrame:
    """key, cid and the smallest class (a) of every member of a bucket with more than one."""
    rows = classes.select(F.explode("keys").alias("key"), "cid")
    heads = rows.groupBy("key").agg(F.min("cid").alias("a"), F.count("*").alias("members")).filter("members > 1")
    return materialize(rows.join(heads.select("key", "a"), "key"), "buckets")


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest class."""
    return buckets.filter("a <> cid").select("a", F.col("cid").alias("b")).distinct()


def _overlaps(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles of ``one`` stand in each of ``sets`` (sorted, distinct, none empty but where all are)."""
    ends = np.cumsum([len(x) for x in sets])
    if not len(one) or not ends[-1]:
        return np.zeros(len(sets), np.int64)
    found, at = [], 0
    while at < len(sets):  # a bounded number of shingles at a time, one set at least
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - len(sets[at]) + _FLAT, side="right")))
        flat = np.concatenate(sets[at:stop])
        there = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        sums = np.concatenate(([0], np.cumsum(there)))
        sizes = np.array([len(x) for x in sets[at:stop]])
        last = np.cumsum(sizes)
        found.append(sums[last] - sums[last - sizes])
        at = stop
    return np.concatenate(found)


def links_of_block(cids: np.ndarray, labels: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], left: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join all components which similar texts of one bucket connect: one link for each that is joined.

    Rows up to ``left`` are compared with the rest (with each other, if there is no rest).  Pairs of one
    component, told by ``labels``, need no test; the others pass the bound by sizes, the pigeonring test,
    the full Hamming check and the exact similarity.
    """
    labels, found = labels.copy(), []
    sizes = np.array([len(x) for x in sets])
    alone = left == len(cids)
    for i in range(left):
        at = np.arange(i + 1 if alone else left, len(cids))
        at = at[labels[at] != labels[i]]
        at = at[np.minimum(sizes[at], sizes[i]) >= similarity * np.maximum(sizes[at], sizes[i])]
        if len(at):
            at = at[near_prints(prints[at], prints[i])]
        if not len(at):
            continue
        common = _overlaps(sets[i], [sets[j] for j in at])
        for j in at[common >= similarity * (sizes[at] + sizes[i] - common)]:
            if labels[j] != labels[i]:
                found.append((int(cids[i]), int(cids[j])))
                labels[labels == labels[j]] = labels[i]
    return found


def _links_of_blocks(similarity: float):
    """A mapInArrow function: rows sorted by (key, x, y, side), one pair of blocks after another, to links (a, b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for part in held for v in part.column("shingles")]  # views, no copies
            rows = pa.Table.from_batches(held).drop_columns("shingles")
            held.clear()
            sides = rows.column("side").to_numpy()
            left = len(sides) if rows.column("x")[0] == rows.column("y")[0] else int((sides == 0).sum())
            if len(sides) < 2 or not left:
                return
            prints = np.stack([rows.column(f).to_numpy() for f in _PRINTS], axis=1)
            found = links_of_block(rows.column("cid").to_numpy(), rows.column("label").to_numpy(), prints, sets, left, similarity)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")], axis=1)
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), len(places)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if held and tuple(places[start]) != last:
                    yield from close()
                last = tuple(places[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from close()

    return run


def _other_links(rows: DataFrame, classes: DataFrame, buckets: DataFrame, labels: DataFrame, width: int, similarity: float, members: int, shingles: int) -> DataFrame:
    """Links between members of one bucket whose components differ.

    Members of a bucket that still holds several components travel with their shingle sets to the task
    of their bucket, where they are compared, verified and joined; at most one link for each component
    leaves.  A bucket of more than ``members`` rows or ``shingles`` shingles is cut into blocks, and
    every pair of blocks has a task.
    """
    known = buckets.select("key", "cid").join(classes.select("cid", "n"), "cid").join(labels, F.col("cid") == F.col("node"), "left")
    known = known.select("key", "cid", "n", F.coalesce("label", "cid").alias("label"))
    parts = known.groupBy("key", "label").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles")).filter("parts > 1")
    blocks = F.greatest(F.ceil(F.col("members") / members), F.ceil(F.col("shingles") / shingles)).cast("int")
    dealt = known.drop("n").join(mixed.select("key", blocks.alias("blocks")), "key").join(classes.select("cid", *_PRINTS), "cid")
    dealt = materialize(dealt, "mixed")
    sets = _sets(dealt.select("cid").distinct(), rows, classes, width)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid", "key"), "blocks").cast("int"))
    dealt = dealt.join(sets, "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "cid", "label", *_PRINTS, "shingles",
    )
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")
    return map_arrow(dealt, _links_of_blocks(similarity), "a long, b long")


def _row_hash(columns: list[str]) -> F.Column:
    """One number for equal rows; nulls are told from all texts."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def _grouped(rows: DataFrame, width: int, similarity: float, members: int = MEMBERS, shingles: int = SHINGLES) -> tuple[DataFrame, DataFrame]:
    """doc_id and class (cid) of every row, and cid, group and smallest row (no id, doc_id, row) of every class.

    ``rows`` has doc_id, text and row, a hash that tells rows of different texts or ids apart.
    """
    own = materialize(_sketches(rows, width), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    firsts = own.groupBy("cid").agg(first, F.count("*").alias("copies"), *[F.first(f).alias(f) for f in ("n", *_PRINTS)], F.first("keys").alias("keys"))
    classes = materialize(firsts, "classes")

    buckets = _buckets(classes)
    met = _with_prints(_with_prints(_first_pairs(buckets), classes, "b"), classes, "a")
    tried = materialize(_pruned(met), "pairs")
    links = materialize(_verified(tried, rows, classes, width, similarity), "linked")
    labels = connected_components(links)

    more = materialize(_other_links(rows, classes, buckets, labels, width, similarity, members, shingles), "linked")
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    groups = classes.join(labels, F.col("cid") == F.col("node"), "left").select("cid", "first", "copies", F.coalesce("label", "cid").alias("group"))
    return own, materialize(groups, "groups")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY,
    members: int = MEMBERS, shingles: int = SHINGLES,
) -> DataFrame:
    """doc_id and component_id (smallest id reachable) of every row with an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("doc_id is not null").withColumn("row", _row_hash(["doc_id", "text"]))
    own, groups = _grouped(rows, width, similarity, members, shingles)
    best = groups.groupBy("group").agg(F.min("first.doc_id").alias("component_id"), F.count("*").alias("size"))
    known = materialize(attach(groups, best, "group", "size").select("cid", "component_id", "copies"), "known")
    return attach(own.select("doc_id", "cid"), known, "cid", "copies").select("doc_id", "component_id")


def one_of_each_group(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` (with doc_id and text) for each group: that of the smallest id, a null id only
    where the group has no other; among several rows of that id the one with the smallest hash."""
    columns = docs.columns
    rows = docs.withColumn("row", _row_hash(columns))
    own, groups = _grouped(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "row"), width, similarity)
    firsts = groups.groupBy("group").agg(F.min("first").alias("first"))
    firsts = firsts.select(F.col("first.doc_id").alias("kept_id"), F.col("first.row").alias("kept_row"))
    keys = own.groupBy("doc_id", "row").agg(F.count("*").alias("times"))
    told = keys.join(firsts, (F.col("row") == F.col("kept_row")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left")
    told = materialize(told.select(F.col("doc_id").alias("its_id"), F.col("row").alias("its_row"), "times", F.col("kept_row").isNotNull().alias("kept")), "told")

    its = (F.col("row") == F.col("its_row")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
    gone, twice = told.filter("not kept"), told.filter("kept and times > 1")
    few = gone.count() <= MOST_BROADCAST  # few rows to leave out: then the texts stay where they are
    out = rows.join(F.broadcast(gone), its, "left_anti") if few else rows.join(told.filter("kept"), its, "left_semi")
    if not twice.isEmpty():
        twice = _small(twice)
        out = out.join(twice, its, "left_anti").unionByName(out.join(twice, its, "left_semi").dropDuplicates(["doc_id", "row"]))
    return out.select(*columns)
