"""Exact nearest vectors from compressed copies: full vectors are read only where a bound lets them be among the nearest.

Beside its unit vectors an index has their codes, one signed byte a dimension, with the scale and the length of
what the code leaves out.  By Cauchy-Schwarz a product with a unit query lies within that length of the product with the
code, so codes give each vector a lower and an upper bound.  A vector whose upper bound is below the query's k-th best
lower bound can't be among its k nearest; the others, few, are multiplied in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.expr import l2_normalize
from foliant.functions.store import table
from foliant.operators.dense import BROADCAST_BYTES, FOUND, nearest_blocks

QUERY_ROWS = 256
ROOM = 1e-5  # for what single-precision products and rounded scores are off


@dataclass
class VectorIndex:
    """``codes`` (id, code, scale, off) and ``full`` (id, v), both of unit vectors."""

    codes: DataFrame
    full: DataFrame


def write_vectors(vectors: DataFrame, path: str) -> VectorIndex:
    """Write an index of ``vectors`` (id, v) under ``path`` and read it back.  Null ids and vectors take no part; a zero vector stays zero."""
    spark = vectors.sparkSession
    unit = vectors.where("id is not null and v is not null").select(F.col("id").cast("string").alias("id"), l2_normalize("v").alias("v"))
    unit.write.mode("overwrite").parquet(f"{path}/full")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, scales, off = [], [], []
            for v in b.column("v"):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
                scale = float(np.abs(x).max(initial=0.0)) / 127 or 1.0
                code = np.rint(x / scale).astype(np.int8)
                codes.append(code.tobytes())
                scales.append(scale)
                off.append(float(np.sqrt(((x - code * scale) ** 2).sum())))
            yield pa.record_batch({"id": b.column("id"), "code": pa.array(codes, pa.binary()), "scale": pa.array(scales, pa.float64()), "off": pa.array(off, pa.float64())})

    full = spark.read.parquet(f"{path}/full")
    full.mapInArrow(encode, "id string, code binary, scale double, off double").write.mode("overwrite").parquet(f"{path}/codes")
    return read_vectors(spark, path)


def read_vectors(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/full"))


def _candidates(held, k: int, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y = held.value
        best = np.full((len(names), k), -np.inf, np.float32)  # the k best lower bounds so far, worst first
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                if not len(names) or not b.num_rows:
                    continue
                x = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1).astype(np.float32)
                scale = b.column("scale").to_numpy().astype(np.float32)
                off = b.column("off").to_numpy().astype(np.float32) + np.float32(ROOM)
                # Products of 256 queries at a time, so that a task's memory does not grow with the queries.
                for first in range(0, len(names), QUERY_ROWS):
                    near = (y[first : first + QUERY_ROWS] @ x.T) * scale
                    low, high = near - off, near + off
                    joined = np.concatenate((best[first : first + QUERY_ROWS], low), 1)
                    best[first : first + QUERY_ROWS] = np.partition(joined, joined.shape[1] - k, axis=1)[:, -k:]
                    q, i = np.nonzero(high >= np.maximum(best[first : first + QUERY_ROWS].min(1), np.float32(threshold))[:, None])
                    ids = b.column("id").take(pa.array(i))
                    yield pa.record_batch({"q": pa.array(q + first, pa.int64()), "id": ids, "low": pa.array(low[q, i], pa.float32()), "high": pa.array(high[q, i], pa.float32())})

    return work


def pruned_nearest(index: VectorIndex, queries: DataFrame, k: int, threshold: float = -1.0, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``q, id, score``: the ``k`` nearest of each query (``q string, v``), as ``nearest_blocks`` finds them (scores rounded to 9 decimals, ties to the
    smaller id, none below the threshold); and ``q, n_full``: how many vectors were multiplied in full for it.  Queries
    of more than ``broadcast_bytes`` go the way of ``nearest_blocks``, where all are."""
    asked = queries.where("q is not null and v is not null").select("q", l2_normalize("v").alias("v"))
    n, size = asked.agg(F.count("*"), F.sum(8 * F.size("v") + F.octet_length("q"))).first()
    if (size or 0) > broadcast_bytes:
        found = nearest_blocks(index.full, queries, k, threshold)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
        return found, asked.select("q", F.lit(index.full.count()).cast("long").alias("n_full"))
    rows = asked.toArrow()  # checked above
    names = rows["q"].to_pylist()
    y = np.array(rows["v"].to_pylist(), float) if names else np.zeros((0, 0))
    sc = asked.sparkSession.sparkContext
    coarse, exact = sc.broadcast((names, y.astype(np.float32))), sc.broadcast((names, y))
    found = table(index.codes.mapInArrow(_candidates(coarse, k, threshold), "q long, id string, low float, high float"), "candidates")
    # Ranked over all tasks, with the cut made in each task first.
    w = Window.partitionBy("q").orderBy(F.desc("low"))
    least = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy("q").agg(F.when(F.count("*") == k, F.min("low")).alias("least"))
    left = found.join(least, "q").where("least is null or high >= least").select("q", "id")
    met = left.join(index.full, "id")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y = exact.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                if b.num_rows:
                    q = b.column("q").to_numpy()
                    x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    score = np.round(np.einsum("nd,nd->n", y[q], x), 9)
                    yield pa.record_batch({"q": pa.array([names[i] for i in q.tolist()], pa.string()), "id": b.column("id"), "score": pa.array(score)})

    scored = table(met.select("q", "id", "v").mapInArrow(multiply, FOUND), "scores")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = scored.where(F.col("score") >= threshold).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return best, scored.groupBy("q").agg(F.count("*").alias("n_full"))
