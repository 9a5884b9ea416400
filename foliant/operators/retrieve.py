"""Retrieval for batches of requests: sub-queries, three search paths, fusion, merging, contexts.

Scores are rounded to 9 decimals before they rank anything and ties go to the smaller id, so that
neither the order of summation nor the partitioning shows in a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.constants import B, DENSE_TYPE, FRAGMENT, HYBRID_TYPE, K1, QUESTION_TYPE, RRF_K, RULE_LINE, THRESHOLD, TOP_K, UNKNOWN
from foliant.functions.expr import ordered_join, ranked
from foliant.functions.store import table
from foliant.operators.dense import nearest_blocks
from foliant.operators.index import Bm25Stats, by_chunk, by_term, slices, term_stats, with_terms
from foliant.operators.model import fill_template
from foliant.operators.pruned import VectorIndex, pruned_nearest
from foliant.operators.segment import WORDS, Words

SUB = ["request_id", "sub_id"]
REWRITE = "struct<question:string,broadened_question:array<string>,keyword:array<string>>"


def parse_rewrites(rows: DataFrame, response: str = "response") -> DataFrame:
    """``request_id, question, broadened_question, keyword`` of every answer that is JSON with a question;
    missing lists are empty."""
    parsed = rows.withColumn("_v", F.try_parse_json(F.col(response))).where("_v is not null").withColumn("_r", F.from_json(response, REWRITE)).where("_r.question is not null")
    empty = F.array().cast("array<string>")
    return parsed.select("request_id", "_r.question", F.coalesce("_r.broadened_question", empty).alias("broadened_question"), F.coalesce("_r.keyword", empty).alias("keyword"))


def expand_queries(requests: DataFrame, path: str) -> DataFrame:
    """``request_id, sub_id, query``: the question and its broader forms for the paths text and question,
    the keywords and the broader forms for the path keyword."""
    first = F.col("keyword") if path == "keyword" else F.array("question")
    return requests.select("request_id", F.posexplode(F.concat(first, "broadened_question")).alias("sub_id", "query"))


def instruct_query(query: Column, task: str | None) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery:"), query) if task else query


def dense_search(vectors: DataFrame | VectorIndex, queries: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD, fetch: int = 5) -> DataFrame:
    """``request_id, chunk_id, retrieval_score, rank, retrieval_type``.  ``vectors``: chunk_id, embedding, or an index whose ids are chunk_ids;
    ``queries``: request_id, sub_id, embedding.  Of each sub-query's ``fetch * top_k`` nearest those at the
    threshold or above count; a chunk has its best score over the sub-queries.  Both sides are
    normalised, so the score is a cosine."""
    best = _nearest(_by_id(vectors), queries, fetch * top_k, threshold)
    best = best.groupBy("request_id", F.col("id").alias("chunk_id")).agg(F.max("score").alias("retrieval_score"))
    return ranked(best, ["request_id"], "retrieval_score", "chunk_id", top_k).withColumn("retrieval_type", F.lit(DENSE_TYPE))


def _by_id(vectors: DataFrame | VectorIndex) -> DataFrame | VectorIndex:
    return vectors if isinstance(vectors, VectorIndex) else vectors.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))


def _nearest(vectors: DataFrame | VectorIndex, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """``request_id, sub_id, id, score, rank`` of each sub-query's nearest."""
    # A sub-query's key as JSON, which gives back any request_id, whatever signs it holds.
    asked = queries.select(F.to_json(F.struct(*SUB)).alias("q"), F.col("embedding").alias("v"))
    if isinstance(vectors, VectorIndex):
        found, _ = pruned_nearest(vectors, asked, k, threshold)
    else:
        found = nearest_blocks(vectors.withColumn("id", F.col("id").cast("string")), asked, k, threshold)
    found = ranked(found, ["q"], "score", "id", k)
    key = F.from_json("q", queries.select(*SUB).schema)
    return found.select(*[key[c].alias(c) for c in SUB], "id", "score", "rank")


def question_search(questions: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD, fetch: int = 5, index: VectorIndex | None = None) -> DataFrame:
    """Dense search over question vectors (question_id, chunk_id, question, embedding): each chunk with
    its best question over all sub-queries, joined to the chunk ids that exist.  With an ``index`` whose ids are question_ids, ``questions`` need no embedding."""
    named = index or questions.select(F.col("question_id").cast("string").alias("id"), F.col("embedding").alias("v"))
    found = _nearest(named, queries, fetch * top_k, threshold)
    by = found.join(questions.select(F.col("question_id").cast("string").alias("id"), "question_id", "chunk_id", "question"), "id")
    w = Window.partitionBy("request_id", "chunk_id").orderBy(F.col("score").desc(), "question_id", "sub_id")
    best = by.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    best = best.select("request_id", "chunk_id", F.col("question").alias("matched_question"), F.col("score").alias("retrieval_score"))
    return ranked(best, ["request_id"], "retrieval_score", "chunk_id", top_k).withColumn("retrieval_type", F.lit(QUESTION_TYPE))


def bm25_search(postings: DataFrame, stats: Bm25Stats, queries: DataFrame, limit: int = 2 * TOP_K, k1: float = K1, b: float = B, broadcast_terms: int = 200_000, tokenizer: Words = WORDS) -> DataFrame:
    """``request_id, sub_id, chunk_id, score, bm25_rank``: positive scores, the ``limit`` best of each
    sub-query.  Queries are cut by the ``tokenizer`` that cut the chunks.  ``postings`` are ``chunk_id, term, tf, dl``, or ``chunk_id, dl, terms`` of
    ``search_counts``, a row a chunk.  Up to ``broadcast_terms`` sub-query terms go
    to the chunks, which are scored in slices where they lie (postings are dealt by chunk first), and of each slice only the ``limit`` best of a sub-query leave it.  More meet the postings by term, the terms that many chunks hold apart
    from the rest; the scores are then shuffled by (sub-query, chunk), which is even however common a term
    is."""
    cut = tokenizer.add(queries.select(*SUB, "query"), "query", "_t")
    terms = table(cut.select(*SUB, F.explode("_t").alias("term")).groupBy(*SUB, "term").agg(F.count("*").alias("qtf")), "query-terms")
    few = terms.count() <= broadcast_terms
    sent = F.broadcast if few else lambda df: df  # counted above
    whole = "terms" in postings.columns
    each = by_term(postings) if whole else postings
    df = term_stats(each.join(sent(terms.select("term").distinct()), "term", "left_semi"))
    asked = terms.join(sent(df), "term")
    if few:
        # Postings are dealt by chunk, some thousand chunks a task.
        parts = min(20_000, max(1, -(-stats.n // 4096)))
        rows = postings if whole else by_chunk(postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").repartition(parts, "chunk_id"))
        scores = _scored(rows, asked.withColumn("idf", stats.idf(F.col("df"))), limit, k1, b, stats.avgdl or 1.0)
    else:
        weight = stats.idf(F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats.avgdl or 1.0)))
        met = with_terms(each, table(asked, "query-terms"), stats.n)
        scores = met.select(*SUB, "chunk_id", (F.col("qtf") * weight).alias("w")).groupBy(*SUB, "chunk_id").agg(F.round(F.sum("w"), 9).alias("score")).where("score > 0")
    return ranked(scores, SUB, "score", "chunk_id", limit, "bm25_rank")


SLICE = 1 << 20  # scores, and products that add up to them, that a task holds at a time


def asked_by_term(asked: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """Of ``asked`` (request_id, sub_id, term, qtf, idf; of bounded size): the distinct terms, their idf, where the sub-queries of each begin, the numbers of these sub-queries and
    their qtf, and the keys of the sub-queries by number."""
    got = asked.select(*SUB, "term", "qtf", "idf").toArrow().combine_chunks()
    names = got["term"].unique().sort()
    term = pc.index_in(got["term"], value_set=names).to_numpy()
    code = [got[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) for c in SUB]
    _, first, sub = np.unique(code[0] * (len(got) + 1) + code[1], return_index=True, return_inverse=True)
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(len(names) + 1))
    idf = np.zeros(len(names))
    idf[term] = got["idf"].to_numpy()
    return names, idf, start, sub[order], got["qtf"].to_numpy()[order], got.select(SUB).take(pa.array(first))


def products(place: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where the sub-queries of each of these terms stand, one after another."""
    n = np.diff(start)[place]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[place] - ends + n, n)


def _scored(rows: DataFrame, asked: DataFrame, limit: int, k1: float, b: float, avgdl: float, sent=None) -> DataFrame:
    """``request_id, sub_id, chunk_id, score``: of every slice of chunks (``chunk_id, terms``, with ``dl`` beside or within the terms) the ``limit`` best positive scores of each
    sub-query, ties by chunk_id.  ``asked``: request_id, sub_id, term, qtf, idf, few enough to be sent (``sent``: their broadcast ``asked_by_term``, if it is there).  Where rows have ``wanted``,
    the bits of the sub-queries by number, only these are scored."""
    held = rows.sparkSession.sparkContext.broadcast(asked_by_term(asked)) if sent is None else sent

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, start, sub, qtf, keys = held.value
        n_sub, n_asked = len(keys), np.diff(start)
        for whole in batches:
            sizes = pc.list_value_length(whole.column("terms")).to_numpy(zero_copy_only=False)
            entries = whole.column("terms").flatten()
            tf = entries.field("tf").to_numpy()
            dl = whole.column("dl").to_numpy(zero_copy_only=False).repeat(sizes) if "dl" in whole.schema.names else entries.field("dl").to_numpy()
            place = pc.fill_null(pc.index_in(entries.field("term"), value_set=names), -1).to_numpy()
            row = np.repeat(np.arange(whole.num_rows), sizes)
            # By term, so that chunks of the same counts get the same sum.
            by = np.lexsort((place, row))
            by = by[place[by] >= 0]
            row, place, tf, dl = row[by], place[by], tf[by], dl[by]
            weight = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            n = n_asked[place]
            first = np.empty(whole.num_rows, np.int64)
            first[pc.array_sort_indices(whole.column("chunk_id"), null_placement="at_start").to_numpy()] = np.arange(whole.num_rows)
            for at, upto in slices(np.maximum(n_sub, np.bincount(row, n, whole.num_rows).astype(np.int64)), SLICE):
                e = slice(*np.searchsorted(row, [at, upto]))
                own = products(place[e], start)
                cell, part = np.repeat(row[e] - at, n[e]) * n_sub + sub[own], qtf[own] * np.repeat(weight[e], n[e])
                if "wanted" in whole.schema.names:
                    bits = np.frombuffer(b"".join(whole.column("wanted").slice(at, upto - at).to_pylist()), np.uint8).reshape(upto - at, -1)
                    keep = np.unpackbits(bits, axis=1, count=n_sub).reshape(-1)[cell] == 1
                    cell, part = cell[keep], part[keep]
                s = np.bincount(cell, part, (upto - at) * n_sub)
                s = np.round(s, 9).reshape(-1, n_sub).T
                least = np.partition(s, -limit, axis=1)[:, -limit][:, None] if s.shape[1] > limit else 0.0
                q, at_row = np.nonzero((s > 0) & (s >= least))
                by = np.lexsort((first[at + at_row], -s[q, at_row], q))
                q, at_row = q[by], at_row[by]
                best = np.arange(len(q)) - np.searchsorted(q, q) < limit
                q, at_row = q[best], at_row[best]
                out = keys.take(pa.array(q)).combine_chunks()
                yield from out.append_column("chunk_id", whole.column("chunk_id").take(pa.array(at + at_row))).append_column("score", pa.array(s[q, at_row])).to_batches()

    kinds = [f"{c} {asked.schema[c].dataType.simpleString()}" for c in SUB]
    return rows.mapInArrow(work, f"{', '.join(kinds)}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score double")


def rrf_fuse(bm25: DataFrame, dense: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal ranks of both legs added up; a chunk keeps its best sub-query.  ``bm25`` has bm25_rank,
    ``dense`` embedding_rank, both by request_id, sub_id, chunk_id; a missing leg adds nothing."""
    both = bm25.select(*SUB, "chunk_id", "bm25_rank").join(dense.select(*SUB, "chunk_id", "embedding_rank"), [*SUB, "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("original_rrf_score", F.round(part("bm25_rank") + part("embedding_rank"), 9)).withColumn("rrf_k", F.lit(k))
    w = Window.partitionBy("request_id", "chunk_id").orderBy(F.desc("original_rrf_score"), "sub_id")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def minmax_scores(fused: DataFrame, score: str = "original_rrf_score") -> DataFrame:
    """``retrieval_score``: the score between the request's least (0) and greatest (1); 1 where all are
    equal.  To be taken over all fused chunks, before the cut to top_k."""
    w = Window.partitionBy("request_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return fused.withColumn("retrieval_score", F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def hybrid_search(postings: DataFrame, stats: Bm25Stats, vectors: DataFrame | VectorIndex, queries: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD, tokenizer: Words = WORDS) -> DataFrame:
    """Keyword path: BM25 and dense ranks (2 * top_k each) fused, normalised and cut to ``top_k``.
    ``queries``: request_id, sub_id, query, embedding."""
    words = bm25_search(postings, stats, queries, 2 * top_k, tokenizer=tokenizer)
    near = _nearest(_by_id(vectors), queries, 2 * top_k, threshold)
    near = near.select(*SUB, F.col("id").alias("chunk_id"), F.col("rank").alias("embedding_rank"))
    fused = minmax_scores(rrf_fuse(words, near))
    return ranked(fused, ["request_id"], "retrieval_score", "chunk_id", top_k).withColumn("retrieval_type", F.lit(HYBRID_TYPE))


PATHS = ["text", "keyword", "question"]


def merge_paths(hits: DataFrame) -> DataFrame:
    """One row a request and chunk.  ``hits``: request_id, path, rank, chunk_id, retrieval_score,
    retrieval_type.  The record is that of the first path that has the chunk (text, keyword, question),
    ``retrieved_from_paths`` maps every path to its score, ``position`` is the order of appearance."""
    order = F.array_position(F.array(*[F.lit(p) for p in PATHS]), F.col("path")).cast("int")
    rows = hits.withColumn("_o", order)
    first = F.min(F.struct("_o", "rank", "retrieval_score", "retrieval_type", "path")).alias("_f")
    paths = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_o", "path", "retrieval_score"))), lambda x: F.struct(x["path"], x["retrieval_score"]))).alias("retrieved_from_paths")
    merged = rows.groupBy("request_id", "chunk_id").agg(first, paths)
    w = Window.partitionBy("request_id").orderBy("_f._o", "_f.rank", "chunk_id")
    return merged.select("request_id", F.row_number().over(w).alias("position"), "chunk_id", "_f.retrieval_score", "_f.retrieval_type", "retrieved_from_paths")


def preview(merged: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with text, path names and scores."""
    rows = merged.join(chunks.select("chunk_id", "text"), "chunk_id")
    return rows.select("request_id", "position", "chunk_id", "text", F.map_keys("retrieved_from_paths").alias("paths"), F.map_values("retrieved_from_paths").alias("scores"))


def filter_useful(merged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates whose verdict is useful; anything else, and none at all, drops them.  Order kept."""
    return merged.join(verdicts.where("verdict = 'useful'").select("request_id", "chunk_id"), ["request_id", "chunk_id"], "left_semi")


def assemble_context(useful: DataFrame, chunks: DataFrame, heading: str = FRAGMENT) -> DataFrame:
    """``request_id, context, chunk_ids``: numbered fragments in order, each under its heading, joined by a
    rule line; fields that a chunk lacks are shown as unknown."""
    have = set(chunks.columns)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if c in have else F.lit(UNKNOWN)
    facts = chunks.select("chunk_id", shown("doc_name").alias("_d"), shown("author").alias("_a"), shown("page_number").alias("_p"), F.coalesce("text", F.lit("")).alias("_t"))
    at = F.row_number().over(Window.partitionBy("request_id").orderBy("position"))
    rows = useful.select("request_id", "position", "chunk_id").withColumn("_n", at).join(facts, "chunk_id")
    title = fill_template(heading, n=F.col("_n"), doc_name=F.col("_d"), author=F.col("_a"), page_number=F.col("_p"), chunk_id=F.col("chunk_id"))
    rows = rows.withColumn("_piece", F.concat(title, "_t"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_n", "chunk_id"))), lambda x: x["chunk_id"])
    return rows.groupBy("request_id").agg(ordered_join(F.col("_n"), "_piece", RULE_LINE).alias("context"), ids.alias("chunk_ids"))


def request_outcomes(requests: DataFrame, merged: DataFrame, useful: DataFrame) -> DataFrame:
    """``request_id, n_candidates, n_useful, outcome``."""
    count = lambda df, name: df.groupBy("request_id").agg(F.count("*").alias(name))
    out = requests.select("request_id").distinct().join(count(merged, "_c"), "request_id", "left").join(count(useful, "_u"), "request_id", "left")
    out = out.select("request_id", F.coalesce("_c", F.lit(0)).alias("n_candidates"), F.coalesce("_u", F.lit(0)).alias("n_useful"))
    outcome = F.when(F.col("n_candidates") == 0, "no_context_found").when(F.col("n_useful") == 0, "no_context_found_after_usefulness").otherwise("completed")
    return out.withColumn("outcome", outcome)


def retrieval_stats(hits: DataFrame, merged: DataFrame, useful: DataFrame) -> DataFrame:
    """``request_id, stage, n``: hits of each path, unique candidates, and those kept."""
    parts = [hits.groupBy("request_id", F.concat(F.lit("path_"), "path").alias("stage")).agg(F.count("*").alias("n"))]
    parts += [df.groupBy("request_id").agg(F.count("*").alias("n")).select("request_id", F.lit(name).alias("stage"), "n") for df, name in ((merged, "unique"), (useful, "useful"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
