"""SimHash near-duplicate groups with pigeonring candidate filtering (operator 6).

A text's fingerprint has 64 bits: the majority, bit by bit, over the XXH64 values of its word
shingles.  Fingerprints that differ in at most 3 bits are linked, and a group is a connected
component of links.

Candidates come from the pigeonring principle.  Cut the fingerprint into a ring of 8 segments of
8 bits.  If two fingerprints differ in at most 3 bits, some segment starts a chain whose every
prefix of length l has at most floor(3 l / 8) differing bits: 0, 0, 1, 1, 1, 2, 2, 3.  So from
that start two whole segments agree, and the next three hold at most one difference, which leaves
one 12-bit half of them equal.  That gives 16 index keys of 28 equal bits (8 starts x 2 halves)
which together miss no pair.  Pairs that share a key must pass the whole chain test from that
start before the full Hamming check.

Cost: one Python pass over the texts, then only fingerprints move: 16 rows of 16 bytes for each
distinct fingerprint, sorted by key.  Links leave a bucket as a star per group, never as all pairs.
A bucket of more than ``max_bucket`` fingerprints is cut into blocks whose pairs go to separate tasks.

Defined results: null and empty texts (and texts of white space) have fingerprint zero and are
linked like any other; rows with a null id keep their row and do not name a component; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored.
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
from .storage import materialize

SEGMENTS, SEGMENT_BITS, RADIUS = 8, 8, 3
#: Differing bits allowed in a chain's first 1, 2, ... 8 segments.
BUDGETS = np.array([RADIUS * n // SEGMENTS for n in range(1, SEGMENTS + 1)])
KEY_BITS = 28

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_SLOT = (np.arange(8) * 256)[None, :]


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit set (bit 0 first)."""
    slots = (hashes.view(np.uint8).reshape(-1, 8) + _BYTE_SLOT).ravel()
    counts = np.bincount(slots, minlength=2048).reshape(8, 256)
    return np.einsum("pv,vb->pb", counts, _BYTE_BITS).ravel()


def fingerprint(text: bytes, width: int = 3, seed: int = 42, piece: int = 1 << 16) -> int:
    """SimHash of one text.  Shingles are hashed in pieces, so memory stays small for long texts."""
    words = text.lower().split()  # bytes.lower and bytes.split know ASCII only, as wanted
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), piece):
        found = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + piece], stops[at : at + piece])]
        votes += bit_votes(np.array(found, np.uint64))
    bits = (2 * votes > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row (doc_id, fp) for each row of ``docs``; fp is the fingerprint as a signed BIGINT."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "text"):
            found = [fingerprint(x, width) for x in kernels.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, fp long")


def _rotated(x: np.ndarray, segments: np.ndarray) -> np.ndarray:
    left = (segments * SEGMENT_BITS).astype(np.uint64)
    return (x << left) | (x >> ((np.uint64(64) - left) & np.uint64(63)))


_ONES = _BYTE_BITS.sum(axis=1)


def chain_holds(difference: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from segment ``start`` keeps within its budget at every length."""
    ring = _rotated(difference, start).astype(">u8").view(np.uint8).reshape(-1, SEGMENTS)
    return (np.cumsum(_ONES[ring], axis=1) <= BUDGETS).all(axis=1)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same groups as the links (a, b), as one link from each node to its group's smallest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def _verified(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    difference = x ^ y
    ok = chain_holds(difference, start)
    ok[ok] = _popcount(difference[ok]) <= RADIUS
    return ok


def linked_in_buckets(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that share a key; ``keys`` is sorted.  Compares row i with i + 1, i + 2, ..."""
    found_a, found_b = [], []
    rows = np.arange(len(keys) - 1)
    step = 1
    while len(rows):
        rows = rows[rows + step < len(keys)]
        rows = rows[keys[rows] == keys[rows + step]]
        ok = rows[_verified(fps[rows], fps[rows + step], keys[rows] >> np.uint64(KEY_BITS + 1))] if len(rows) else rows
        found_a.append(fps[ok])
        found_b.append(fps[ok + step])
        step += 1
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _star(np.concatenate(found_a), np.concatenate(found_b))


def _links_of_sorted(batches: Iterable[pa.RecordBatch], max_bucket: int) -> Iterator[pa.RecordBatch]:
    """Streams rows (key, fp) sorted by key; yields (key, a, b): a link where key is null, else one
    fingerprint ``a`` of a bucket that is too large to compare here."""
    held_keys, held = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        first = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        size = np.repeat(np.diff(first), np.diff(first))
        large = size > max_bucket
        many = (size > 1) & ~large
        a, b = linked_in_buckets(keys[many], fps[many])
        tags = [None] * len(a) + keys[large].view(np.int64).tolist()
        a, b = np.concatenate((a, fps[large])), np.concatenate((b, fps[large]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tags, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "a", "b"]
        )

    def as_large(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(x.view(np.int64)) for x in (keys, fps, fps)]
        return pa.RecordBatch.from_arrays(columns, ["key", "a", "b"])

    flooded = None  # the key whose bucket has outgrown this task: its rows go on as they come
    for batch in batches:
        keys = np.concatenate((held_keys, batch.column("key").to_numpy().view(np.uint64)))
        fps = np.concatenate((held, batch.column("fp").to_numpy().view(np.uint64)))
        if flooded is not None:
            n = int(np.searchsorted(keys, flooded, side="right"))
            yield as_large(keys[:n], fps[:n])
            keys, fps = keys[n:], fps[n:]
            flooded = None if len(keys) else flooded
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield from out(keys[:cut], fps[:cut])
        held_keys, held = keys[cut:], fps[cut:]
        if len(held) > max_bucket:
            flooded = held_keys[-1]
            yield as_large(held_keys, held)
            held_keys, held = held_keys[:0], held[:0]
    yield from out(held_keys, held)


def _links_of_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (key, x, y, side, fp) sorted by all; yields the links across each pair of blocks."""
    current, parts = None, {}

    def out() -> Iterator[pa.RecordBatch]:
        if current is None:
            return
        key, x, y = current
        left = np.array(parts.get(0, []), np.int64).view(np.uint64)
        right = left if x == y else np.array(parts.get(1, []), np.int64).view(np.uint64)
        a, b = [], []
        start = np.uint64(key) >> np.uint64(KEY_BITS + 1)
        for one in left:
            near = right[_popcount(right ^ one) <= RADIUS]
            near = near[near != one]
            if len(near):
                ok = near[_verified(near, np.full(len(near), one), np.full(len(near), start))]
                a.append(np.full(len(ok), one))
                b.append(ok)
        if a:
            a, b = _star(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        for key, x, y, side, fp in zip(*(batch.column(n).to_pylist() for n in ("key", "x", "y", "side", "fp"))):
            if (key, x, y) != current:
                yield from out()
                current, parts = (key, x, y), {}
            parts.setdefault(side, []).append(fp)
    yield from out()


def _ring_keys(fp: str = "fp") -> F.Column:
    """The 16 keys of a fingerprint: (start, half) above 28 bits, as an array of BIGINT."""
    keys = []
    for start in range(SEGMENTS):
        left = start * SEGMENT_BITS
        ring = F.col(fp) if not left else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))
        near = F.shiftrightunsigned(ring, 36)
        far = F.shiftleft(F.shiftrightunsigned(ring, 48), 12).bitwiseOR(
            F.shiftrightunsigned(ring, 24).bitwiseAND(F.lit(0xFFF).cast("long"))
        )
        keys += [F.lit((2 * start + half) << KEY_BITS).cast("long").bitwiseOR(k) for half, k in enumerate((near, far))]
    return F.array(*keys)


def fingerprint_links(distinct: DataFrame, max_bucket: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within RADIUS bits.

    ``distinct`` has one row per fingerprint (``fp`` BIGINT).
    """
    dealt = distinct.select(F.explode(_ring_keys()).alias("key"), "fp")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(map_arrow(dealt, lambda it: _links_of_sorted(it, max_bucket), "key long, a long, b long"), "ring")
    links = found.filter("key is null").select("a", "b")
    large = found.filter("key is not null").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return links
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / max_bucket).cast("int").alias("blocks"))
    cut = large.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    pairs = cut.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select(
        "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "fp",
    )
    pairs = pairs.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "fp")
    return links.union(map_arrow(pairs, _links_of_blocks, "a long, b long"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bucket: int = 4096
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every row."""
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    labels = connected_components(fingerprint_links(distinct.select("fp"), max_bucket))
    grouped = distinct.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", "copies", F.coalesce("label", "fp").alias("group_fp")
    )
    grouped = materialize(grouped, "grouped")
    firsts = grouped.groupBy("group_fp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    known = materialize(attach(grouped, firsts, "group_fp", "size").select("fp", "component_id", "copies"), "known")
    return attach(fps, known, "fp", "copies").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
