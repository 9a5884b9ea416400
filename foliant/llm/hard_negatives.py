"""Hard negatives by a vertical scan of columnar dimensions (BOND).

Vectors become whole numbers, floor(``scale`` * x), and lie in shards, dimension by dimension, the rows of a
label together.  An anchor reads a shard's dimensions in the descending order of its own magnitudes; after
every step the least and the greatest that the dimensions still unread can add (from their minima and
maxima in the shard) bound each candidate's score, and candidates that can no longer matter leave the bitmap:

* positives: those whose upper bound is below the k-th best lower bound among the anchor's label;
* negatives, once the positives of all shards are known: those that fit into no positive's window, or
  whose upper bound is below that of enough candidates which are sure to lie in it.

What is left has exact scores when all dimensions are read.  Shards' results are cut by rank before they
are shuffled, so that no task gathers what grows with the number of shards.

Rows with a null vec_id, label or vector, with null or non-finite components, or with vectors not of the
most frequent length take no part; a zero vector does.  Ties go to the smaller vec_id.  A repeated vec_id is
a candidate as often as it occurs, except for anchors of that id, and is one anchor (its least vector and
label, where they differ).  Components are cut at +-2^27 after scaling, so that scores of up to 256 dimensions fit a long.  An
anchor without positives, or whose windows are empty, has no rows.  Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import table
from foliant.llm.permutation_index import matrix

STEP = 8  # dimensions read between two looks at the bounds
MOST = 1 << 27


def whole_vectors(vectors: DataFrame, scale: int = 256, wide: int | None = None) -> DataFrame:
    """``vec_id, label, v array<int>`` of the rows that take part; of length ``wide``, or of the most frequent."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    v = v.where("vec_id is not null and label is not null and embedding is not null").where("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    if wide is None:
        found = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        wide = found["n"] if found else 0
    v = v.where(F.size("embedding") == wide)
    cut = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * scale))).cast("int")
    return v.select("vec_id", "label", F.transform("embedding", cut).alias("v"))


class Scan:
    """Some columns (dimensions x rows) with their minima and maxima."""

    def __init__(self, columns: np.ndarray):
        self.columns, self.low, self.high = columns, columns.min(1, initial=MOST), columns.max(1, initial=-MOST)

    def run(self, anchor: np.ndarray, alive: np.ndarray, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows left of the bitmap ``alive`` and their exact scores; ``stays`` says for lower and upper
        bounds which rows can still matter."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.stack((a * self.low[order], a * self.high[order]))
        # What the dimensions after each place can add at least and at most.
        after = [np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(0), ends.max(0))]
        at = np.flatnonzero(alive)
        score = np.zeros(len(at), np.int64)
        for first in range(0, len(a), STEP):
            for d in range(first, min(first + STEP, len(a))):
                if a[d]:
                    column = self.columns[order[d]]
                    score += a[d] * (column if len(at) == len(column) else column[at])
            read = min(first + STEP, len(a))
            keep = stays(score + after[0][read], score + after[1][read])
            if not keep.all():
                alive[at[~keep]] = False
                at, score = at[keep], score[keep]
            if not len(at):
                break
        return at, score


def nearest_stay(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)

    return stays


def windows_stay(windows: list[tuple[int, int]], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), bool)
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            floor = max(least, int(np.partition(sure, len(sure) - k)[len(sure) - k])) if len(sure) >= k else least
            out |= (high >= floor) & (low <= most)
        return out

    return stays


def _shard(shard: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_ids, labels and columns of a shard, rows by label and vec_id."""
    shard = shard.sort_by([("label", "ascending"), ("vec_id", "ascending")])
    return shard["vec_id"].to_numpy(), shard["label"].to_numpy(), np.ascontiguousarray(matrix(shard["v"]).T.astype(np.int64))


def _positives(k: int):
    def work(shard: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if shard.num_rows and anchors.num_rows:
            ids, labels, columns = _shard(shard)
            scans: dict[int, tuple[np.ndarray, Scan]] = {}
            for q, label, y in zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), matrix(anchors["v"]).astype(np.int64)):
                if label not in scans:
                    own = slice(*np.searchsorted(labels, [label, label + 1]))
                    scans[label] = ids[own], Scan(columns[:, own])
                names, scan = scans[label]
                at, score = scan.run(y, names != q, nearest_stay(k))
                for i in np.lexsort((names[at], -score))[:k]:
                    found.append((q, int(names[at[i]]), int(score[i])))
        return pa.table({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(("anchor_id", "positive_id", "positive_score"))})

    return work


def _negatives(k: int, least: int, most: int, share: int):
    def work(shard: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple[int, ...]] = []
        if shard.num_rows and anchors.num_rows:
            ids, labels, columns = _shard(shard)
            scan = Scan(columns)
            for q, label, y, positives in zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), matrix(anchors["v"]).astype(np.int64), anchors["positives"].to_pylist()):
                # least * p <= share * n <= most * p, in whole numbers
                windows = [(-(-least * p["positive_score"] // share), most * p["positive_score"] // share) for p in positives]
                if not any(a <= b for a, b in windows):
                    continue
                at, score = scan.run(y, (labels != label) & (ids != q), windows_stay([w for w in windows if w[0] <= w[1]], k))
                order = np.lexsort((ids[at], -score))
                at, score = at[order], score[order]
                for p, (a, b) in zip(positives, windows):
                    for i in np.flatnonzero((score >= a) & (score <= b))[:k]:
                        found.append((q, p["positive_id"], p["place"], p["positive_score"], int(ids[at[i]]), int(score[i])))
        names = ("anchor_id", "positive_id", "place", "positive_score", "negative_id", "negative_score")
        return pa.table({n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(names)})

    return work


def _ranked(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """Rows of the ``k`` first places; the filter on the rank also cuts each task's rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100), scale: int = 256, shard_rows: int = 8192, anchor_rows: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.  ``anchors`` are rows of the same kind as ``vectors``;
    each has its ``positives`` best rows of the same label and, for each of these, the first ``negatives``
    of other labels with window[0] * positive <= window[2] * negative <= window[1] * positive.

    Anchors meet shards in blocks: a task holds one shard and one block of anchors."""
    data = table(whole_vectors(vectors, scale), "vectors")
    n, wide = data.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = whole_vectors(anchors, scale, wide or 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    asked = table(asked.select("vec_id", "a.label", "a.v"), "anchors")
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-asked.count() // anchor_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    shards = data.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).alias("shard"), every(n_blocks).alias("block")).groupBy("shard", "block")
    blocks = lambda a: a.select("*", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).alias("block"), every(n_shards).alias("shard")).groupBy("shard", "block")

    near = shards.cogroup(blocks(asked)).applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    near = _ranked(near, ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives, "place")
    held = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "positive_id", "positive_score"))).alias("positives"))  # at most ``positives``
    known = asked.join(held, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    out = shards.cogroup(blocks(known)).applyInArrow(_negatives(negatives, *window), "anchor_id long, positive_id long, place long, positive_score long, negative_id long, negative_score long")
    out = _ranked(out, ["anchor_id", "place"], [F.desc("negative_score"), F.asc("negative_id")], negatives, "rank")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM c WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN c USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
