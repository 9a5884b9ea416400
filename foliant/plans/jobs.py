"""The three workloads end to end: corpus to chunks, chunks to index, requests to contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.constants import CHUNK_SIZE, MIN_LENGTH, OVERLAP, THRESHOLD, TOP_K
from foliant.functions.store import table
from foliant.operators import answers, index, model, responses, retrieve, windows
from foliant.operators.chunking import chunk_pages
from foliant.operators.html import chapters_to_text
from foliant.operators.pages import split_pages
from foliant.operators.segment import WORDS, Words
from foliant.sources import files

Model = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], list[list[float]]]


def prepare_texts(spark: SparkSession, path: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_LENGTH) -> DataFrame:
    """Text files of a folder to chunks, without a shuffle."""
    return chunk_pages(split_pages(files.read_text_corpus(spark, path)), size, overlap, least)


def prepare_books(spark: SparkSession, path: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_LENGTH) -> DataFrame:
    """EPUB books of a folder to chunks.  Every chapter is a page of its title, and what follows a marker
    sign inside it a page of its own; ``page_ord`` is the chapter's place in the book and the page's in
    the chapter, so books need not be put together first."""
    chapters = chapters_to_text(files.read_epub(spark, path), keep=["doc_name", "item_no"])
    pages = split_pages(chapters.drop("title")).withColumn("page_ord", F.shiftleft(F.col("item_no").cast("long"), 20) + F.col("page_ord")).drop("item_no")
    return chunk_pages(pages, size, overlap, least)


def _attempts(rows: DataFrame, call: Model, parse, open_: str, most: int, path: str, key: list[str]) -> DataFrame:
    """Calls until nothing is open or the attempts are used up.  Answers stand in a table under ``path``, a
    version an attempt, so that a run that is started again asks only for what has no answer there."""
    done = None
    for attempt in range(1, most + 1):
        got = parse(answers.ask(rows, call, f"{path}/answers", f"attempt {attempt}")).withColumn("attempt", F.lit(attempt))
        got = table(got, "attempts")
        done = got if done is None else done.unionByName(got)
        again = got.where(open_).select(*key)
        if again.isEmpty():
            break
        rows = rows.join(again, key, "left_semi")
    return done


def first_rows(chunks: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` chunks in the order of documents, pages and chunks; all without a limit."""
    return chunks if limit is None else chunks.orderBy("doc_name", "page_ord", "chunk_no").limit(limit)


def repair(chunks: DataFrame, call: Model, template: str, path: str, attempts: int = 5, limit: int | None = None) -> DataFrame:
    """Middle chunks of every document repaired with their neighbours in sight."""
    key = ["doc_name", "page_ord", "chunk_no"]
    chunks = first_rows(chunks, limit)
    asked = model.build_requests(windows.context_windows(chunks), template, "repair").select(*key, "request")
    tried = _attempts(asked, call, responses.parse_refinement, "status = 'json_decode_error'", attempts, path, key)
    one = tried.withColumn("_key", F.struct(*key))
    good = responses.resolve_attempts(one, "_key", attempts)
    return responses.apply_refinements(chunks.withColumn("_key", F.struct(*key)), good, "_key").drop("_key")


def annotate(chunks: DataFrame, call: Model, template: str, path: str, attempts: int = 3, limit: int | None = None) -> DataFrame:
    """Meaningful chunks with phrases and questions."""
    key = ["doc_name", "page_ord", "chunk_no"]
    chunks = first_rows(chunks, limit)
    asked = model.build_requests(chunks, template, "annotation").select(*key, "request")
    tried = _attempts(asked, call, responses.parse_annotations, "not valid", attempts, path, key)
    first = responses.first_valid(tried.withColumn("_key", F.struct(*key)), "_key", attempts)
    return responses.annotate_chunks(chunks.withColumn("_key", F.struct(*key)), first, "_key").drop("_key")


def build_index(chunks: DataFrame, embed: Embedder, path: str, limit: int | None = None, tokenizer: Words = WORDS) -> dict[str, DataFrame]:
    """Index tables under ``path``, read back; ``limit`` makes a bounded trial build.  Chunks are written
    first, and the other tables made of what was written; ``answer`` needs the same ``tokenizer``."""
    spark = chunks.sparkSession
    rows = index.select_indexable(chunks)
    if limit is not None:
        rows = rows.orderBy("doc_name", "chunk_id").limit(limit)
    files.write_index({"chunks": rows}, path)
    rows = spark.read.parquet(f"{path}/chunks")
    vectors = model.embed_texts(rows.select("chunk_id", "text"), embed).select("chunk_id", "embedding")
    questions = model.embed_texts(index.question_index(rows), embed, "question", 1024).withColumn("question_id", F.concat_ws("#", "chunk_id", F.col("pos").cast("string")))
    phrases = model.embed_texts(index.phrase_dictionary(rows), embed, "phrase", 2048)
    files.write_index({"vectors": vectors, "postings": index.build_postings(rows, tokenizer=tokenizer), "questions": questions, "phrases": phrases}, path)
    return files.read_index(spark, path)


def answer(tables: dict[str, DataFrame], requests: DataFrame, embed: Embedder, verdicts: DataFrame | None = None, top_k: int = TOP_K, threshold: float = THRESHOLD, tokenizer: Words = WORDS) -> dict[str, DataFrame]:
    """``requests``: request_id, question, broadened_question, keyword.  Gives merged candidates, the
    useful ones, contexts and outcomes; without verdicts every candidate is useful.  The three searches
    run once, when this is called; what is given out reads their results."""
    postings, chunks = tables["postings"], tables["chunks"]
    stats = index.bm25_stats(chunks, postings)
    texts = model.embed_texts(retrieve.expand_queries(requests, "text"), embed, "query")
    words = model.embed_texts(retrieve.expand_queries(requests, "keyword"), embed, "query")
    paths = {
        "text": retrieve.dense_search(tables["vectors"], texts, top_k, threshold),
        "keyword": retrieve.hybrid_search(postings, stats, tables["vectors"], words, top_k, threshold, tokenizer),
        "question": retrieve.question_search(tables["questions"], texts, chunks, top_k, threshold),
    }
    hits = None
    for name, df in paths.items():
        one = df.select("request_id", F.lit(name).alias("path"), "rank", "chunk_id", "retrieval_score", "retrieval_type")
        hits = one if hits is None else hits.unionByName(one)
    hits = table(hits, "hits")
    merged = table(retrieve.merge_paths(hits), "merged")
    useful = merged if verdicts is None else retrieve.filter_useful(merged, verdicts)
    return {
        "hits": hits,
        "merged": merged,
        "useful": useful,
        "contexts": retrieve.assemble_context(useful, chunks),
        "outcomes": retrieve.request_outcomes(requests, merged, useful),
    }
