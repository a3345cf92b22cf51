"""Quality by nearest-neighbour voting among labelled latent-semantic vectors (operator 10).

A text becomes a vector of weighted term shares.  Its terms are its words (A-Z lower-cased) and pairs
of neighbouring words, hashed into LEXICAL columns, and the *shapes* of its words (runs of letters,
of capitals and of digits shrink to one sign, marks stay), pairs of neighbouring shapes, and a sign
for a word that repeats the one before it, hashed into SHAPES columns; the shares of the shapes sum to
one, those of the words to LEXICAL_WEIGHT.  The square roots of the shares, times the inverse document frequency, are projected on the
leading singular directions of a labelled sample (latent semantic analysis) and scaled to length one.

The sample's vectors are broadcast.  Each document takes exact cosines to all of them, in blocks,
keeps the k nearest (equal ones by sample order) and averages their labels weighted by similarity.

The sample is bounded (``sample``, 4,000 by default): labelled rows whose crc32(id as text) mod 5
is not 0, those with the smallest hashed ids.  Labels, language, source and id are never inputs.

Defined results: null and empty texts, and texts similar to nothing, get the sample's share of
label 1; the longest texts are read whole, in pieces; without labelled rows every score is 0.5; of a
labelled id with several texts the one with the smallest hash is learned; equal cosines go by sample
order; repeated rows give repeated rows; an empty table gives no rows; other columns, whatever their
names, are ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import kernels
from .toxicity import labelled_sample

SHAPES, LEXICAL, DIMENSIONS, NEIGHBOURS, ACCEPT = 2048, 4096, 32, 15, 0.3
BINS = SHAPES + LEXICAL
#: Sum of the shares of the lexical terms, where those of the shapes sum to one.
LEXICAL_WEIGHT = 0.25
#: Texts whose dense term rows are held at once, however short they are.
_ROWS = 128

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
_SHAPE[9:14] = 32
_SHRINKS = np.zeros(256, bool)
_SHRINKS[[ord("A"), ord("a"), ord("0"), 32]] = True
_REPEAT = SHAPES - 1


def term_shares(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For groups of texts, a row for each: the share of every hashed term among its terms."""
    for first, end, data, offsets in kernels.joined_blocks(texts, most=_ROWS):
        n = end - first
        plain, begins, _ = kernels.hash_words(data)
        doc = np.searchsorted(offsets, begins, side="right") - 1
        same = np.flatnonzero((plain[1:] == plain[:-1]) & (doc[1:] == doc[:-1]))
        raw = _SHAPE[np.frombuffer(data, np.uint8)]
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != raw[:-1]) | ~_SHRINKS[raw[1:]]
        # capitals count as a sign of their own: hash_words would lower-case "A"
        shape = np.where(raw == ord("A"), 1, raw).astype(np.uint8)[keep]
        words = kernels.hash_words(shape.tobytes())[0]
        inside = doc[1:] == doc[:-1]

        def columns(words: np.ndarray, size: int) -> list[np.ndarray]:
            pairs = kernels.shingle_hashes(words, 2)[inside]
            return [(x % np.uint64(size)).astype(np.int64) for x in (words, pairs)]

        looks, told = columns(words, SHAPES - 1), [SHAPES + x for x in columns(plain, LEXICAL)]
        rows = np.concatenate((doc, doc[1:][inside], doc[same], doc, doc[1:][inside]))
        terms = np.concatenate((*looks, np.full(len(same), _REPEAT), *told))
        counts = np.bincount(rows * BINS + terms, minlength=n * BINS).reshape(n, BINS).astype(np.float32)
        for part, weight in ((counts[:, :SHAPES], 1.0), (counts[:, SHAPES:], LEXICAL_WEIGHT)):
            part *= weight / np.maximum(part.sum(1, keepdims=True), 1)
        yield counts


class NeighbourModel:
    """Term weights, projection, and the labelled sample's vectors."""

    def __init__(self, idf: np.ndarray, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int):
        self.idf, self.projection, self.vectors, self.labels, self.neighbours = idf, projection, vectors, labels, neighbours
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def embed(self, shares: np.ndarray) -> np.ndarray:
        x = (np.sqrt(shares) * self.idf) @ self.projection
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vote(self, shares: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(shares), self.prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        for at in range(0, len(shares), block):
            cosine = np.round(self.embed(shares[at : at + block]) @ self.vectors.T, 6)  # equal vectors stay equal
            if k < cosine.shape[1]:
                floor = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
                sure = cosine > floor
                tied = (cosine == floor) & (np.cumsum(cosine == floor, axis=1) <= k - sure.sum(1, keepdims=True))
                cosine = np.where(sure | tied, cosine, 0)
            weight = np.maximum(cosine, 0).astype(float)
            total = weight.sum(1)
            some = total > 1e-9
            out[at : at + block][some] = (weight @ self.labels)[some] / total[some]
        return np.clip(out, 0, 1)

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([self.vote(s) for s in term_shares(texts)]) if texts else np.zeros(0)


def fit(shares: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> NeighbourModel:
    """Latent directions of the sample by a randomised range finder with a fixed seed."""
    if not len(labels):
        return NeighbourModel(np.ones(BINS, np.float32), np.zeros((BINS, 1), np.float32), np.zeros((0, 1), np.float32), labels, neighbours)
    idf = np.log((1 + len(shares)) / (1 + (shares > 0).sum(0))).astype(np.float32) + np.float32(1)
    x = np.sqrt(shares)
    x *= idf
    probe = np.random.default_rng(7).standard_normal((BINS, dimensions + 8)).astype(np.float32)
    q = np.linalg.qr(x @ probe)[0]
    for _ in range(4):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    v = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dimensions].T.astype(np.float32)
    del x
    model = NeighbourModel(idf, v, np.zeros((0, dimensions), np.float32), labels.astype(float), neighbours)
    model.vectors = np.concatenate([model.embed(shares[at : at + _ROWS]) for at in range(0, len(shares), _ROWS)])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> NeighbourModel:
    """Fits on the labelled sample; its term shares reach the driver sparsely, its texts never do."""
    usable = labels.filter(F.crc32(F.col(id_col).cast("long").cast("string")) % 5 != 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "text"):
            terms, values = [], []
            for shares in term_shares(kernels.text_bytes(batch.column("text"))):
                for row in shares:
                    held = np.flatnonzero(row).astype(np.int32)
                    terms.append(held.tobytes())
                    values.append(row[held].tobytes())
            columns = [batch.column("id"), batch.column("label"), pa.array(terms, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "term", "share"])

    rows = map_arrow(labelled_sample(docs, usable, label, sample, id_col, text_col), run, "id long, label int, term binary, share binary").collect()
    rows.sort(key=lambda r: (r.id, r.label, r.term, r.share))
    shares = np.zeros((len(rows), BINS), np.float32)
    for n, r in enumerate(rows):
        shares[n, np.frombuffer(r.term, np.int32)] = np.frombuffer(r.share, np.float32)
    return fit(shares, np.array([min(1, max(0, r.label)) for r in rows], float))


def scores(docs: DataFrame, model: NeighbourModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, "text"):
            found = shared.value.of_texts(kernels.text_bytes(batch.column("text")))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= ACCEPT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: NeighbourModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, that the classifier accepts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small_batches(batches, text_col):
            yield batch.filter(pa.array(shared.value.of_texts(kernels.text_bytes(batch.column(text_col))) >= ACCEPT))

    return map_arrow(docs, run, docs.schema)
