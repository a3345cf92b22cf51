"""Exact top-k inner products by columnar branch and bound (operator 4).

Components become floor(256 x) and scores are integer inner products.  Candidates are laid out by
dimension.  For a query, scores accumulate over one block of dimensions after another; after each
block a candidate's score can still grow by at most |rest of query| x |rest of candidate|
(Cauchy-Schwarz on the remaining mass), and those that cannot reach the k-th best score so far are
removed by compacting the survivors.  Equal bounds survive, so ties are decided exactly, to the
smaller id.

Queries go to the workers in batches of about ``query_batch`` vectors, which bounds what is broadcast
and what the driver holds: one batch at a time.  Each batch is one pass over the candidates, in
blocks, and a task hands on k rows for each query.  With more than one batch, the results of each
are written to the shared folder before the next is read.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do
rows with a null id; rows that share the query's id count as its own; vectors of another length
than the query's are no candidates; repeated rows are candidates of their own; with fewer than k
candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .storage import write

SCALE, DIM_BLOCK, CHUNK = 256, 16, 8192


def _by_length(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, one row per vector) for every vector length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    starts = vectors.offsets.to_numpy()[:-1] - vectors.offsets.to_numpy()[0]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield ids[rows], flat[(starts[rows][:, None] + np.arange(d)[None, :])].reshape(len(rows), int(d))


def _numbers(x: np.ndarray, other: float) -> np.ndarray:
    """As doubles where all sums stay exact, else as Python integers."""
    if x.size == 0 or float(np.abs(x).max()) * other * max(1, x.shape[-1]) < 2**52:
        return x
    return np.array([[int(v) for v in row] for row in x], object)


class QueryBatch:
    """Queries of one length and the best k candidates that a task has met for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.blocks = [(a, min(a + DIM_BLOCK, vectors.shape[1])) for a in range(0, vectors.shape[1], DIM_BLOCK)] or [(0, 0)]
        self.rest = self._rests(vectors)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def _rests(self, v: np.ndarray) -> list[np.ndarray]:
        """Euclidean norm of the dimensions after each block."""
        return [np.sqrt((v[:, b:].astype(float) ** 2).sum(1)) for _, b in self.blocks]

    def scan(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        top = float(np.abs(self.vectors).max()) if self.vectors.size else 0.0
        columns = np.ascontiguousarray(_numbers(vectors, top).T)
        queries = self.vectors if columns.dtype != object else _numbers(self.vectors, 2.0**60)
        rest = self._rests(vectors)
        for q in range(len(self.ids)):
            self._one(q, queries[q], ids, columns, rest)

    def _one(self, q: int, query: np.ndarray, ids: np.ndarray, columns: np.ndarray, rest: list[np.ndarray]) -> None:
        scores, names = self.best[q]
        alive = None
        floor = scores.min() if len(scores) >= self.k else None
        if floor is None:  # the first candidates give the first bound
            alive = np.flatnonzero(ids != self.ids[q])
            head = alive[: 16 * self.k]
            if len(head) >= self.k:
                floor = np.sort(query @ columns[:, head])[-self.k]
        partial = None
        for (a, b), mine, theirs in zip(self.blocks, self.rest, rest):
            if partial is None:
                partial = query[a:b] @ columns[a:b]
                if alive is not None:
                    partial = partial[alive]
                else:
                    alive = np.arange(len(ids))
            else:
                partial = partial + query[a:b] @ columns[a:b, alive]
            if floor is not None:
                reach = mine[q] * theirs[alive]
                near = partial + reach * (1 + 1e-9) + 1e-3 >= floor
                alive, partial = alive[near], partial[near]
        own = ids[alive] != self.ids[q]
        scores, names = np.concatenate((scores, partial[own])), np.concatenate((names, ids[alive][own]))
        if len(scores) > self.k:
            order = np.lexsort((names, -scores))[: self.k]
            scores, names = scores[order], names[order]
        self.best[q] = (scores, names)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_batch: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    number = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), number.alias("v")).filter("vec_id is not null and v is not null").filter(good)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))).cast("double")).alias("v"))
    asked = rows.filter(F.col("vec_id") % every == 0)
    batches = max(1, -(-asked.count() // query_batch))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def of_batch(number: int) -> tuple[DataFrame, Broadcast]:
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == number)
        shared = spark.sparkContext.broadcast(part.toArrow().combine_chunks().sort_by("vec_id"))  # about query_batch vectors

        def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value.combine_chunks()
            queries: dict[int, QueryBatch] = {}
            if table.num_rows:
                column = table.column("v").chunk(0)
                for ids, v in _by_length(table.column("vec_id").to_numpy(), column):
                    queries[v.shape[1]] = QueryBatch(*_distinct(ids, v), k)
            for batch in it:
                for at in range(0, batch.num_rows, CHUNK):
                    piece = batch.slice(at, CHUNK)
                    for ids, v in _by_length(piece.column("vec_id").to_numpy(), piece.column("v")):
                        if v.shape[1] in queries:
                            queries[v.shape[1]].scan(ids, v)
            for q in queries.values():
                asked_ids = np.repeat(q.ids, [len(s) for s, _ in q.best])
                scores = [int(x) for s, _ in q.best for x in s]
                names = [int(x) for _, n in q.best for x in n]
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids, pa.int64()), pa.array(names, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

        found = map_arrow(rows, run, "query_id long, vec_id long, score long")
        return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), shared

    if batches == 1:
        return of_batch(0)[0]
    paths: list[str] = []
    for number in range(batches):
        found, shared = of_batch(number)
        paths.append(write(found, "nearest"))
        shared.destroy()
    return spark.read.schema(found.schema).parquet(*paths)


def _distinct(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A repeated query id is asked once, with its first vector in value order."""
    order = np.lexsort((*v.T[::-1], ids)) if v.shape[1] else np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    return ids[first], v[first]
