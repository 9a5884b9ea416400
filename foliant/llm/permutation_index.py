"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``length`` nearest pivots in order.  The index is cut into shards
of about ``shard_rows`` vectors (dealt by a hash of vec_id, so copies of one vector spread); a shard
posts its vectors in one inverted file a pivot, with the pivot's place in the vector's order.  Queries
go through their own pivots' files, rank the vectors by the footrule distance of the two orders over
these pivots (one that a vector lacks stands one past the end) and rerank in that order, a ``rerank``
share of the shard at a time, by the inner product of the original vectors in double precision, until
three such blocks in a row bring nothing among the shard's nearest; equal distances are never parted.
The shards' nearest are merged.

Pivots are ``pivots`` vectors, each the farthest from those before it, of eight times as many distinct
ones that are first in the order of a hash (the bounded sample the index is fitted on), so that a large
group of near copies does not take up the pivots.

What is saved is exact products only where the vectors form groups: the share of a shard that is
reranked follows the data.  Shards are not skipped, because on vectors without clear groups the files
of a query's nearest pivots hold its neighbours only when half of them are opened (README has figures).

Vectors that are null, zero, hold null or non-finite components, or are not of the most frequent length
take no part, nor do rows with a null vec_id.  Ties go to the smaller vec_id; a repeated vec_id is a
candidate as often as it occurs, except for queries of that id, and one query (its least vector, where
they differ).  Wide vectors need memory for ``shard_rows`` and ``query_rows`` of them in a task.  Other
columns are ignored.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import table

SAMPLE = 8  # vectors looked at for a pivot
IDLE = 3  # blocks in a row without a new neighbour that end a search
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding array<double>`` of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null")
    fine = v.where("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    width = fine.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return fine.join(F.broadcast(width.select("n")), F.size("embedding") == F.col("n"), "left_semi")  # one row


def choose_pivots(vectors: DataFrame, pivots: int) -> np.ndarray:
    """At most ``pivots`` distinct vectors.  The hashes are looked for first, so that only the vectors
    of the sample are shuffled."""
    hashed = vectors.select(F.xxhash64("embedding").alias("h"), "embedding")
    least = hashed.select("h").distinct().orderBy("h").limit(SAMPLE * pivots)
    rows = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("embedding").alias("embedding")).orderBy("h").collect()  # SAMPLE * pivots hashes
    sample = np.array([r["embedding"] for r in rows], float)
    away, at, chosen = np.full(len(sample), np.inf), 0, []
    while len(chosen) < min(pivots, len(sample)):
        chosen.append(at)
        away = np.minimum(away, ((sample - sample[at]) ** 2).sum(1))
        away[at] = -1.0
        at = int(away.argmax())
    return sample[chosen]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def permutations(vectors: DataFrame, pivots: np.ndarray, length: int) -> DataFrame:
    """``vec_id, embedding, pivots array<int>``: each vector with its nearest pivots in order."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)  # the bounded sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("embedding"))
                near = np.argsort(-(x @ held.value.T), axis=1, kind="stable")[:, :length].astype(np.int32)
                yield pa.record_batch({"vec_id": b.column("vec_id"), "embedding": b.column("embedding"), "pivots": pa.array(list(near), pa.list_(pa.int32()))})

    return vectors.mapInArrow(work, "vec_id long, embedding array<double>, pivots array<int>")


def _search(k: int, rerank: float):
    def work(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if shard.num_rows and queries.num_rows:
            shard = shard.sort_by("vec_id")
            ids, x, perm = shard["vec_id"].to_numpy(), matrix(shard["embedding"]), matrix(shard["pivots"])
            n, length = perm.shape
            # The shard's inverted files: for each pivot its place in the order of every vector.
            files = np.full((int(max(perm.max(), matrix(queries["pivots"]).max())) + 1, n), length, np.int16)
            files[perm, np.arange(n)[:, None]] = np.arange(length, dtype=np.int16)
            places = np.arange(length, dtype=np.int16)[:, None]
            away = np.empty((length, n), np.int16)
            total = np.int16 if length * length < 1 << 15 else np.int32  # holds the largest distance
            step = max(k, int(np.ceil(rerank * n)))
            longest = float(np.sqrt((x * x).sum(1).max()))
            for q, y, own in zip(queries["vec_id"].to_pylist(), matrix(queries["embedding"]), matrix(queries["pivots"])):
                np.take(files, own, axis=0, out=away, mode="clip")
                np.subtract(away, places, out=away)
                np.abs(away, out=away)
                far = away.sum(0, dtype=total)
                order = np.argsort(far, kind="stable")
                far = far[order]
                # Products of a block in one call; what stands within its rounding of the k-th best is
                # kept, and multiplied row by row at the end, so that equal vectors have equal scores.
                slack = 4 * np.finfo(float).eps * len(y) * longest * float(np.sqrt((y * y).sum()))
                found, score, least = np.zeros(0, np.int64), np.zeros(0), -np.inf
                upto, idle = 0, 0
                while upto < n and idle < IDLE:
                    end = int(np.searchsorted(far, far[min(n, upto + step) - 1], "right"))
                    near = order[upto:end]
                    near = near[ids[near] != q]
                    product = x[near] @ y
                    up = product >= least - slack
                    upto, idle = end, 0 if up.any() else idle + 1
                    found, score = np.concatenate([found, near[up]]), np.concatenate([score, product[up]])
                    if len(found) > k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        stay = score >= least - slack
                        found, score = found[stay], score[stay]
                score = (x[found] * y).sum(1)
                first = np.lexsort((ids[found], -score))[:k]
                out_q += [q] * len(first)
                out_v.append(ids[found[first]])
                out_s.append(score[first])
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    return work


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, length: int = 128, rerank: float = 0.1, shard_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` nearest of the other vectors.

    Queries meet shards in blocks: a shard goes to every block of ``query_rows`` queries, a block to
    every shard, and a task holds one of each."""
    data = usable(vectors)
    chosen = choose_pivots(data, pivots)
    if not len(chosen):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = table(permutations(data, chosen, length), "permutations")
    single = usable(queries).where(F.size("embedding") == chosen.shape[1]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = table(permutations(single, chosen, length), "queries")
    n_shards, n_blocks = max(1, -(-index.count() // shard_rows)), max(1, -(-asked.count() // query_rows))
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.select("*", shard.alias("shard"), every(n_blocks).alias("block"))
    right = asked.select("*", block.alias("block"), every(n_shards).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k, rerank), RESULT)
    # The filter on the rank cuts what each task has found before the shuffle; no task gathers all shards' rows.
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
