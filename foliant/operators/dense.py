"""Exact nearest vectors by inner product, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.expr import l2_normalize

FOUND = "q string, id string, score double"
BROADCAST_BYTES = 64 << 20  # queries up to this size are sent to the vectors
KEPT = 1 << 23  # scores of hits that a task keeps


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(k: int, threshold: float, kept: np.ndarray | None = None):
    """The ``k`` best of a block of vectors for each query.  ``kept``, a row of ``k`` scores a query from the least, has the best of the blocks before, below which
    nothing is given out; it is brought up to date."""

    def work(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out_q: list[int] = []
        at: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.sort_by("id")
            x, names = _matrix(vectors["v"]), queries["q"].to_pylist()
            y = _matrix(queries["v"])
            for first in range(0, len(names), 256):
                s = np.round(y[first : first + 256] @ x.T, 9)
                for i, row in enumerate(s, first):
                    least = threshold if kept is None else max(threshold, kept[i, 0])
                    if least == threshold and len(row) > 4 * k:
                        least = max(threshold, np.partition(row, len(row) - k)[len(row) - k])
                    near = np.flatnonzero(row >= least)
                    best = near[np.lexsort((near, -row[near]))][:k]
                    if kept is not None and len(best):
                        kept[i] = np.sort(np.concatenate([kept[i], row[best]]))[-k:]
                    out_q += [names[i]] * len(best)
                    at.append(best)
                    scores.append(row[best])
        rows = np.concatenate(at) if at else np.zeros(0, np.int64)
        return pa.table({"q": pa.array(out_q, pa.string()), "id": vectors["id"].take(pa.array(rows)), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    return work


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of ``rows`` rows, the last one smaller."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= rows:
            held.append(b.slice(0, rows - n))
            yield pa.Table.from_batches(held)
            b, held, n = b.slice(rows - n), [], 0
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if n:
        yield pa.Table.from_batches(held)


def nearest_blocks(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0, vector_rows: int = 8192, query_rows: int = 2048, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``q, id, score``: candidates for the ``k`` nearest of each query (``q string, v``) among the vectors
    (``id string, v``), both normalised here; the ``k`` best of each block of vectors come back, scores
    rounded to 9 decimals, and those below the threshold stay out; a task that holds several blocks leaves out what its blocks before surpass, so that what it
    gives out grows but with the logarithm of their number.  Queries of up to ``broadcast_bytes``
    go to the vectors, which stay where they are; more meet them in blocks, of which a task holds one of
    each, whatever their numbers.  Null vectors take no part."""
    v = vectors.where("id is not null and v is not null").select("id", l2_normalize("v").alias("v"))
    q = queries.where("q is not null and v is not null").select("q", l2_normalize("v").alias("v"))
    n, size = q.agg(F.count("*"), F.sum(8 * F.size("v") + F.octet_length("q"))).first()
    if (size or 0) <= broadcast_bytes:
        held = vectors.sparkSession.sparkContext.broadcast(q.toArrow())  # checked above

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = np.full((n, k), -np.inf) if n * k <= KEPT else None
            best = _best(k, threshold, kept)
            for block in _blocks(batches, vector_rows):
                yield from best(block, held.value).to_batches()

        return v.mapInArrow(search, FOUND)
    n_v, n_q = max(1, -(-v.count() // vector_rows)), max(1, -(-n // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = v.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_v)).alias("vb"), every(n_q).alias("qb"))
    right = q.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(n_q)).alias("qb"), every(n_v).alias("vb"))
    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(_best(k, threshold), FOUND)
