"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 2).

For every document and benchmark item the question is whether some window of the document, as
long in words as the item, has a weighted similarity of 0.8 or more to it.  The similarity is the
sum of minima over the sum of maxima of the two multisets of five-word shingles (words lower-cased
in A-Z; an item of fewer words is one shingle of its own length).

1. A window needs 0.8 of its shingles, or of the item's if they are more, among those of the items to
   reach the similarity, so only such windows are fingerprinted.  Nothing is lost by that.
2. Each such window gets a SimHash of its shingles, from running sums of bit votes.
3. Fingerprints are looked up in a multi-index: 8 blocks of 8 bits.  Within ``RADIUS`` bits (23)
   at least one block has at most two differing bits.  Each item stands in the postings of a block's
   value and of the 36 values within two bits of it, so eight look-ups name every item within the
   radius; the full Hamming distance then decides.  A similarity of 0.8 differs in 10 bits on
   average, with a deviation of 3.
4. Survivors are verified by the exact similarity.

Items travel to the workers in batches of a fixed number of words (``batch_words``), one pass over
the documents for each batch.  The driver holds one batch at a time: with more than one, the rows of
each pass are written to the shared folder before the next is read.  Documents are never shuffled.

Defined results: null and empty texts and items, and items with a null id, match nothing; a document
shorter than an item is one window; the longest texts are hashed whole, in pieces; among windows of
one similarity the first counts; repeated rows give repeated rows, and repeated items repeated matches;
an empty benchmark or table gives no rows; other columns, whatever their names, are ignored by
``contaminations`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import kernels
from .storage import materialize, write

WIDTH, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= RADIUS // BLOCKS
#: The values within two bits of each value of a block, one row each.
_NEIGHBOURS = np.nonzero(_NEAR)[1].reshape(256, -1)
_CHUNK = 4096


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _window_fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of shingles[s : s + n] for every s of ``starts`` (sorted)."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = int(np.searchsorted(starts, starts[at] + _CHUNK))
        part = starts[at:stop]
        low = part[0]
        sums = np.zeros((part[-1] + n - low + 1, 64), np.int32)
        np.cumsum(_bits(shingles[low : part[-1] + n]), axis=0, out=sums[1:])
        votes = sums[part - low + n] - sums[part - low]
        out[at:stop] = np.packbits((2 * votes > n).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
        at = stop
    return out


class HammingIndex:
    """Fingerprints of items by the values of their blocks; names all within RADIUS of a fingerprint."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        own = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BLOCKS)
        slots = (_NEIGHBOURS[own] + (np.arange(BLOCKS) * 256)[None, :, None]).reshape(len(prints), -1)
        order = np.argsort(slots.ravel(), kind="stable")
        self.postings = (order // max(1, slots.shape[1])).astype(np.int32)
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(slots.ravel(), minlength=BLOCKS * 256))))

    def near(self, one: np.uint64) -> np.ndarray:
        """Numbers of the fingerprints within RADIUS bits of ``one``."""
        slots = np.array([one]).view(np.uint8).astype(np.int64) + np.arange(BLOCKS) * 256
        named = np.unique(np.concatenate([self.postings[self.ends[x] : self.ends[x + 1]] for x in slots]))
        return named[np.bitwise_count(self.prints[named] ^ one) <= RADIUS]


class ItemIndex:
    """The items of one batch: shingle table, fingerprints and Hamming blocks by item length."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.lengths: dict[int, list[int]] = defaultdict(list)
        self.ids, self.counts, self.sizes, prints = [], [], [], []
        by_shingle: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            words = kernels.hash_words(text)[0]
            if not len(words):
                continue
            width, k = min(WIDTH, len(words)), len(self.ids)
            shingles = kernels.shingle_hashes(words, width)
            self.ids.append(item_id)
            self.sizes.append(len(shingles))
            self.counts.append(Counter(shingles.tolist()))
            prints.append(_window_fingerprints(shingles, np.zeros(1, np.int64), len(shingles))[0])
            self.lengths[len(words)].append(k)
            for s in set(shingles.tolist()):
                by_shingle[width][s].add(len(words))
        prints = np.array(prints, np.uint64)
        self.blocks = {n: HammingIndex(prints[items]) for n, items in self.lengths.items()}
        self.tables = {}
        for width, found in by_shingle.items():
            keys = np.array(sorted(found), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.tables[width] = (keys, seen, [sorted(found[int(x)]) for x in keys])

    def _hits(self, shingles: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the shingles that some item has, and their places in the table."""
        keys, seen, _ = self.tables[width]
        at = np.flatnonzero(seen[(shingles & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(keys, shingles[at]), len(keys) - 1)
        ok = keys[place] == shingles[at]
        return at[ok], place[ok]

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item id, best similarity, first word, words) of every item that a window reaches."""
        best: dict[int, tuple[float, int, int]] = {}
        for width in self.tables:
            shingles = kernels.shingle_hashes(words, width)
            at, place = self._hits(shingles, width)
            if len(at):
                self._windows(shingles, width, at, place, best)
        return [(self.ids[k], *found) for k, found in sorted(best.items())]

    def _windows(self, shingles, width, at, place, best) -> None:
        names = self.tables[width][2]
        for length in sorted({x for p in set(place.tolist()) for x in names[p]}):
            n = min(length - width + 1, len(shingles))
            last = len(shingles) - n
            lows, highs = np.clip(at - n + 1, 0, last), np.clip(at, 0, last)
            cover = np.zeros(last + 2, np.int32)
            np.add.at(cover, lows, 1)
            np.add.at(cover, highs + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            marks = np.zeros(len(shingles) + 1, np.int64)
            marks[at + 1] = 1
            shared = np.cumsum(marks)
            common = shared[starts + n] - shared[starts]
            starts = starts[common >= SIMILARITY * max(n, length - width + 1)]  # else the similarity is lower
            if not len(starts):
                continue
            prints = _window_fingerprints(shingles, starts, n)
            items = self.lengths[length]
            for start, one in zip(starts.tolist(), prints):
                for j in self.blocks[length].near(one).tolist():
                    k = items[j]
                    score = self._similarity(k, shingles[start : start + n])
                    if score >= SIMILARITY and (k not in best or score > best[k][0]):
                        best[k] = (score, start, n + width - 1)

    def _similarity(self, k: int, window: np.ndarray) -> float:
        own = self.counts[k]
        common = sum(min(n, own[s]) for s, n in Counter(window.tolist()).items() if s in own)
        return common / (len(window) + self.sizes[k] - common)

    def of_texts(self, texts: list[bytes]) -> Iterator[list[tuple[int, float, int, int]]]:
        """The matches of each text.  Texts are hashed together; only those that share a shingle go on."""
        for first, end, data, offsets in kernels.joined_blocks(texts):
            words, begins, _ = kernels.hash_words(data)
            bound = np.searchsorted(begins, offsets)
            hit = np.zeros(end - first, bool)
            for width in self.tables:
                at, _ = self._hits(kernels.shingle_hashes(words, width), width)
                doc = np.searchsorted(bound, at, side="right") - 1
                hit[doc[at + width <= bound[doc + 1]]] = True
            for n in range(end - first):
                yield self.matches(words[bound[n] : bound[n + 1]]) if hit[n] else []


_indexes: dict[str, ItemIndex] = {}


def _index(name: str, items: list[tuple[int, bytes]]) -> ItemIndex:
    """The batch's index, built once in each worker process; the one before is dropped."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = ItemIndex(items)
    return _indexes[name]


def item_batches(items: DataFrame, id_col: str, text_col: str, batch_words: int) -> Iterator[tuple[list[tuple[int, bytes]], bool]]:
    """The items in batches of about ``batch_words`` words (an item is never cut), and whether a batch is the
    last.  Rows come to the driver one partition at a time and only the batch at hand is kept."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out, size = [], 0
    for row in rows.filter("id is not null and text is not null").orderBy("id", "text").toLocalIterator():
        words = len(row.text.split())
        if size + words > batch_words and out:
            yield out, False
            out, size = [], 0
        out.append((row.id, row.text.encode()))
        size += words
    yield out, True


def contaminations(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", batch_words: int = 1_000_000,
) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words of every document and item that match."""
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def of_batch(batch_items: list[tuple[int, bytes]]) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(name, batch_items)
            for batch in kernels.small_batches(batches, "text"):
                found = index.of_texts(kernels.text_bytes(batch.column("text")))
                out = [(d, *m) for d, ms in zip(batch.column("doc_id").to_pylist(), found) for m in ms]
                names = ["doc_id", "item_id", "similarity", "start_word", "n_words"]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        return map_arrow(rows, run, schema)

    written: list[str] = []
    for batch_items, last in item_batches(items, item_id_col, item_text_col, batch_words):
        found = of_batch(batch_items)
        if last and not written:
            return found
        written.append(write(found, "leaks"))
    return docs.sparkSession.read.schema(schema).parquet(*written)


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", batch_words: int = 1_000_000,
) -> DataFrame:
    """The rows of ``docs``, all columns kept, of which no window matches an item."""
    out = docs
    for batch_items, last in item_batches(items, item_id_col, item_text_col, batch_words):

        def run(batches: Iterable[pa.RecordBatch], batch_items=batch_items, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(name, batch_items)
            for batch in kernels.small_batches(batches, text_col):
                found = index.of_texts(kernels.text_bytes(batch.column(text_col)))
                yield batch.filter(pa.array([not m for m in found], pa.bool_()))

        out = map_arrow(out, run, out.schema)
        if not last:
            out = materialize(out, "clean")
    return out
