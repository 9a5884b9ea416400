"""BM25 over postings in blocks with bounds: exact top hits without reading what can't be among them.

Chunks are dealt to blocks of up to ``size`` as they lie, the same for all terms.  An index has three tables: ``entries``, the counts of
terms of a chunk beside its block, ``bounds`` (term, block and the greatest weight that a chunk of the block has for the term) and ``terms``
(term, df).  A sub-query adds up its terms' bounds for every block that holds one of them, scores the blocks with the
highest sums, and so has a score that its last hit must reach; of the other blocks it scores those whose sum reaches that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.constants import B, K1, TOP_K
from foliant.functions.expr import ranked
from foliant.functions.store import table
from foliant.operators.index import PART, Bm25Stats, by_chunk, by_term, slices
from foliant.operators.retrieve import SLICE, SUB, _scored, asked_by_term, products
from foliant.operators.segment import WORDS, Words

TABLES = ["terms", "bounds", "entries"]
SIZE = 64  # chunks of a block


def _weight(tf, dl, avgdl: float, k1: float, b: float):
    """What a posting adds to a score, but for the term's idf and its number in the query; of columns or arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass
class Blocks:
    """An index read back; ``size``, ``k1`` and ``b`` are those it was written with."""

    terms: DataFrame
    bounds: DataFrame
    entries: DataFrame
    stats: Bm25Stats
    size: int = SIZE
    k1: float = K1
    b: float = B

    def weight(self) -> Column:
        return _weight(F.col("tf"), F.col("dl"), self.stats.avgdl or 1.0, self.k1, self.b)


def write_blocks(postings: DataFrame, stats: Bm25Stats, path: str, size: int = SIZE, k1: float = K1, b: float = B) -> Blocks:
    """Write the three tables under ``path`` and read them back.  ``postings`` are ``chunk_id, term, tf, dl``, or ``chunk_id, dl, terms`` of ``search_counts``, a row a
    chunk, which are written where they lie.  What is moved are the bounds, a row for each term of a block."""
    spark = postings.sparkSession
    rows = postings if "terms" in postings.columns else by_chunk(postings)
    rows = rows.withColumn("block", F.expr(f"monotonically_increasing_id() div {size}"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/entries")
    most = _bounds(spark.read.parquet(f"{path}/entries"), stats.avgdl or 1.0, k1, b)
    # A block that is cut by a slice has several rows of a term; blocks stay together, for the sums over their terms.
    most = most.repartition("block").groupBy("term", "block").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
    most.sortWithinPartitions("block", "term").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/bounds")
    spark.read.parquet(f"{path}/bounds").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    return read_blocks(spark, path, stats, size, k1, b)


def _bounds(entries: DataFrame, avgdl: float, k1: float, b: float) -> DataFrame:
    """``term, block, most, n`` of every slice of the entries: the greatest weight of the term in the block, and how many chunks have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column("terms")).to_numpy(zero_copy_only=False)
            for at, upto in slices(sizes, PART):
                rows = whole.slice(at, upto - at)
                held = rows.column("terms").flatten()
                tf, names = held.field("tf").to_numpy(), held.field("term").dictionary_encode()
                dl = rows.column("dl").to_numpy().repeat(sizes[at:upto]) if "dl" in rows.schema.names else held.field("dl").to_numpy()
                blocks, of = np.unique(rows.column("block").to_numpy(), return_inverse=True)
                key = of.repeat(sizes[at:upto]) * max(1, len(names.dictionary)) + names.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                if not len(first):
                    continue
                most = np.maximum.reduceat(_weight(tf, dl, avgdl, k1, b)[order], first)
                block, place = np.divmod(key[order[first]], len(names.dictionary))
                yield pa.record_batch({"term": names.dictionary.take(pa.array(place)), "block": pa.array(blocks[block]), "most": pa.array(most), "n": pa.array(np.diff(first, append=len(order)))})

    return entries.select("block", *[c for c in entries.columns if c in ("dl", "terms")]).mapInArrow(work, "term string, block long, most double, n long")


def read_blocks(spark: SparkSession, path: str, stats: Bm25Stats, size: int = SIZE, k1: float = K1, b: float = B) -> Blocks:
    return Blocks(*[spark.read.parquet(f"{path}/{t}") for t in TABLES], stats, size, k1, b)


def _reach(index: Blocks, asked: DataFrame, sent) -> DataFrame:
    """``request_id, sub_id, _q, block, reach``: the sums of bounds of every (sub-query, block) with a term, in parts that are to be added up; ``_q`` is the sub-query's number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, start, sub, qtf, keys = sent.value
        for whole in batches:
            place = pc.fill_null(pc.index_in(whole.column("term"), value_set=names), -1).to_numpy()
            known = np.flatnonzero(place >= 0)
            place, most, block = place[known], whole.column("most").to_numpy()[known], whole.column("block").to_numpy()[known]
            n = np.diff(start)[place]
            for at, upto in slices(n, SLICE):
                own, times = products(place[at:upto], start), n[at:upto]
                # A term of negative idf can only take away: its bound is 0.
                gain = np.maximum(qtf[own] * np.repeat(idf[place[at:upto]] * most[at:upto], times), 0.0)
                blocks, of = np.unique(block[at:upto], return_inverse=True)
                cell, where = np.unique(np.repeat(of, times) * len(keys) + sub[own], return_inverse=True)
                of, q = np.divmod(cell, max(1, len(keys)))
                out = keys.take(pa.array(q)).append_column("_q", pa.array(q, pa.int32()))
                yield from out.append_column("block", pa.array(blocks[of])).append_column("reach", pa.array(np.bincount(where, gain, len(cell)))).combine_chunks().to_batches()

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in asked.select(*SUB).schema]
    return index.bounds.select("term", "block", "most").mapInArrow(work, f"{', '.join(kinds)}, _q int, block long, reach double")


def _wanted(index: Blocks, blocks: DataFrame, n_sub: int, sent_bytes: int = 64 << 20) -> DataFrame:
    """``block, wanted``: the blocks of which some sub-query (``_q``) wants the scores, with a bit for each; sent to the entries up to ``sent_bytes``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                bits = np.zeros((b.num_rows, n_sub), np.uint8)
                bits[np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("q")).to_numpy()), b.column("q").flatten().to_numpy()] = 1
                yield pa.record_batch({"block": b.column("block"), "wanted": pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())})

    out = blocks.groupBy("block").agg(F.collect_list("_q").alias("q")).mapInArrow(work, "block long, wanted binary")
    return F.broadcast(out) if -(-index.stats.n // index.size) * (n_sub // 8 + 32) <= sent_bytes else out


def _joined_scores(index: Blocks, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``request_id, sub_id, chunk_id, score`` of every chunk of the given (sub-query, block) that holds a term."""
    wanted = blocks.select(*SUB, "block").join(asked, SUB)
    met = wanted.join(by_term(index.entries, "block"), ["term", "block"])
    return met.groupBy(*SUB, "chunk_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * index.weight()), 9).alias("score"))


def block_search(index: Blocks, queries: DataFrame, limit: int = 2 * TOP_K, first: int | None = None, tokenizer: Words = WORDS, broadcast_terms: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The rows of ``bm25_search`` (request_id, sub_id, chunk_id, score, bm25_rank), and ``request_id, sub_id, n_blocks, n_read``: how many blocks hold a
    term of the sub-query, and how many were scored.  ``first`` blocks are scored to find the least
    score of a hit, by default as many as hold some times ``limit`` chunks.  Up to ``broadcast_terms`` sub-query terms go to the bounds and to the entries, and with
    them which blocks each sub-query wants; a slice of entries gives out its ``limit`` best of a sub-query.  More meet bounds and entries by term and block."""
    first = max(8, -(-4 * limit // index.size)) if first is None else first
    cut = tokenizer.add(queries.select(*SUB, "query"), "query", "_t")
    terms = cut.select(*SUB, F.explode("_t").alias("term")).groupBy(*SUB, "term").agg(F.count("*").alias("qtf"))
    asked = table(terms.join(index.terms, "term").select(*SUB, "term", "qtf", index.stats.idf(F.col("df")).alias("idf")), "asked")
    if asked.count() <= broadcast_terms:
        sent = index.entries.sparkSession.sparkContext.broadcast(asked_by_term(asked))
        reach = _reach(index, asked, sent).repartition(*SUB)
        scores = lambda blocks: _scored(index.entries.join(_wanted(index, blocks, len(sent.value[-1])), "block"), asked, limit, index.k1, index.b, index.stats.avgdl or 1.0, sent)
    else:
        gain = F.greatest(F.col("qtf") * F.col("idf") * F.col("most"), F.lit(0.0))
        reach = asked.join(index.bounds, "term").select(*SUB, F.lit(None).cast("int").alias("_q"), "block", gain.alias("reach"))
        scores = lambda blocks: _joined_scores(index, asked, blocks)
    order = Window.partitionBy(*SUB).orderBy(F.desc("reach"), "block")
    reach = reach.groupBy(*SUB, "_q", "block").agg(F.sum("reach").alias("reach")).withColumn("_n", F.row_number().over(order))
    reach = table(reach, "reach")
    scored = table(scores(reach.where(F.col("_n") <= first)).where("score > 0"), "scores")
    least = ranked(scored, SUB, "score", "chunk_id", limit, "_r").where(F.col("_r") == limit).select(*SUB, F.col("score").alias("least"))
    met = reach.join(table(least, "least"), SUB, "left")
    # Sums of bounds and scores are rounded apart: a little room, so that no tie is lost.
    more = (F.col("_n") > first) & F.expr("reach > 0 and reach >= coalesce(least, 0) - 1e-6")
    rest = table(met.where(more).select(*SUB, "_q", "block"), "other-blocks")
    hits = scored.unionByName(scores(rest).where("score > 0"))
    share = met.groupBy(*SUB).agg(F.count("*").alias("n_blocks"), F.sum(((F.col("_n") <= first) | more).cast("long")).alias("n_read"))
    return ranked(hits, SUB, "score", "chunk_id", limit, "bm25_rank"), share
