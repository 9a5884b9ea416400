import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.expr import dot
from foliant.operators import chat, index, retrieve, rules
from foliant.plans.jobs import answer, build_index
from foliant.sources import files


def _plain_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    cut = lambda t: [x for x in t.split() if len(x) > 1]
    toks = {d: cut(t) for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    return {d: sum(idf.get(q, 0) * t.count(q) * (k1 + 1) / (t.count(q) + k1 * (1 - b + b * len(t) / avg)) for q in cut(query)) for d, t in toks.items()}


def test_bm25_against_plain_python(spark):
    rng = random.Random(2)
    words = ["the", "of", "sun", "moon", "star", "sky", "a", "night", "day"]
    docs = {f"c{k:02d}": " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for k in range(30)}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id string, text string")
    postings = index.build_postings(chunks)
    stats = index.bm25_stats(chunks, postings)
    queries = spark.createDataFrame([(1, 0, "the sun sun"), (1, 1, "night a"), (2, 0, "absent")], "request_id int, sub_id int, query string")
    got = {(r.request_id, r.sub_id, r.chunk_id): (r.score, r.bm25_rank) for r in retrieve.bm25_search(postings, stats, queries, 8).collect()}
    want = {}
    for r, s, q in [(1, 0, "the sun sun"), (1, 1, "night a")]:
        ranked = sorted(((round(v, 9), c) for c, v in _plain_bm25(docs, q).items() if round(v, 9) > 0), key=lambda x: (-x[0], x[1]))[:8]
        want |= {(r, s, c): (v, k) for k, (v, c) in enumerate(ranked, 1)}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-8) for k in want)


def test_bm25_of_many_queries_equals_that_of_few(spark, rows):
    rng = random.Random(3)
    words = ["the"] * 20 + [f"w{k}" for k in range(40)]
    chunks = spark.createDataFrame([(f"c{k:03d}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(120)], "chunk_id string, text string")
    postings = index.build_postings(chunks)
    stats = index.bm25_stats(chunks, postings)
    queries = spark.createDataFrame([(k, 0, " ".join(rng.choice(words) for _ in range(4))) for k in range(30)], "request_id int, sub_id int, query string")
    few, many = (retrieve.bm25_search(postings, stats, queries, 5, broadcast_terms=n) for n in (200_000, 0))
    assert len(rows(few)) > 100 and rows(few) == rows(many)


def _vectors(spark, n, dim=6, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x, spark.createDataFrame([(f"c{k:03d}", [float(v) for v in row]) for k, row in enumerate(x)], "chunk_id string, embedding array<double>")


def test_dense_search_equals_expressions(spark):
    x, vectors = _vectors(spark, 90)
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (1, 1, [0.0, 2.0, 0.0, 0.0, 0.0, 0.0]), (2, 0, [0.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "request_id int, sub_id int, embedding array<double>")
    got = {(r.request_id, r.chunk_id): (r.retrieval_score, r["rank"]) for r in retrieve.dense_search(vectors, queries, 5, 0.2).collect()}
    unit = lambda c: F.transform(c, lambda v: v / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, w: s + w * w)))
    twin = vectors.crossJoin(queries.withColumnRenamed("embedding", "q")).select("request_id", "chunk_id", F.round(dot(unit(F.col("q")), unit(F.col("embedding"))), 9).alias("s")).where("s >= 0.2")
    best = {}
    for r in twin.groupBy("request_id", "chunk_id").agg(F.max("s").alias("s")).collect():
        best.setdefault(r.request_id, []).append((-r.s, r.chunk_id))
    want = {(q, c): (pytest.approx(-s, abs=1e-8), k) for q, v in best.items() for k, (s, c) in enumerate(sorted(v)[:5], 1)}
    assert got == want


def test_dense_blocks_do_not_matter(spark, rows):
    from foliant.operators.dense import nearest_blocks

    _, vectors = _vectors(spark, 50)
    v = vectors.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id < 'c010'").select(F.col("id").alias("q"), "v")
    from foliant.functions.expr import ranked

    one, *others = (ranked(nearest_blocks(v, q, 4, vector_rows=a, query_rows=b, broadcast_bytes=c), ["q"], "score", "id", 4) for a, b, c in ((1000, 1000, 1 << 20), (7, 3, 1 << 20), (7, 3, 0), (1000, 1000, 0)))
    assert len(rows(one)) == 40 and all(rows(one) == rows(x) for x in others)
    plan = nearest_blocks(v, q, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # vectors stay where they are


def test_rrf_minmax_and_ties(spark):
    bm = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (2, 0, "z", 1)], "request_id int, sub_id int, chunk_id string, bm25_rank int")
    dn = spark.createDataFrame([(1, 0, "b", 1), (1, 1, "c", 1)], "request_id int, sub_id int, chunk_id string, embedding_rank int")
    fused = retrieve.rrf_fuse(bm, dn)
    got = {(r.request_id, r.chunk_id): (r.original_rrf_score, r.bm25_rank, r.embedding_rank) for r in fused.collect()}
    assert got == {(1, "a"): (round(1 / 61, 9), 1, None), (1, "b"): (round(1 / 61 + 1 / 62, 9), 2, 1), (1, "c"): (round(1 / 61, 9), None, 1), (2, "z"): (round(1 / 61, 9), 1, None)}
    norm = {(r.request_id, r.chunk_id): r.retrieval_score for r in retrieve.minmax_scores(fused).collect()}
    assert norm == {(1, "a"): 0.0, (1, "b"): 1.0, (1, "c"): 0.0, (2, "z"): 1.0}


def test_question_search_takes_the_best_over_all_sub_queries(spark):
    q = spark.createDataFrame([(1, "a", "q1", [1.0, 0.0]), (2, "a", "q2", [0.0, 1.0]), (3, "gone", "q3", [1.0, 0.0])], "question_id long, chunk_id string, question string, embedding array<double>")
    subs = spark.createDataFrame([(1, 0, [0.9, 0.1]), (1, 1, [0.5, 0.5])], "request_id int, sub_id int, embedding array<double>")
    chunks = spark.createDataFrame([("a",)], "chunk_id string")
    assert [(r.chunk_id, r.matched_question) for r in retrieve.question_search(q, subs, chunks).collect()] == [("a", "q1")]


def _hits(spark):
    data = [(1, "text", 1, "a", 0.9, "t"), (1, "keyword", 1, "b", 1.0, "k"), (1, "keyword", 2, "a", 0.4, "k"), (1, "question", 1, "c", 0.7, "q"), (1, "question", 2, "b", 0.6, "q"), (2, "question", 1, "a", 0.5, "q")]
    return spark.createDataFrame(data, "request_id int, path string, rank int, chunk_id string, retrieval_score double, retrieval_type string")


def test_merge_filter_context_outcomes(spark):
    merged = retrieve.merge_paths(_hits(spark))
    got = [(r.request_id, r.position, r.chunk_id, r.retrieval_score, r.retrieved_from_paths) for r in merged.orderBy("request_id", "position").collect()]
    assert got == [(1, 1, "a", 0.9, {"text": 0.9, "keyword": 0.4}), (1, 2, "b", 1.0, {"keyword": 1.0, "question": 0.6}), (1, 3, "c", 0.7, {"question": 0.7}), (2, 1, "a", 0.5, {"question": 0.5})]
    verdicts = spark.createDataFrame([(1, "c", "useful"), (1, "a", "useful"), (1, "b", "useless")], "request_id int, chunk_id string, verdict string")
    useful = retrieve.filter_useful(merged, verdicts)
    chunks = spark.createDataFrame([("a", "doc", None, "A"), ("c", None, 3, "C")], "chunk_id string, doc_name string, page_number int, text string")
    ctx = retrieve.assemble_context(useful, chunks).first()
    assert ctx.chunk_ids == ["a", "c"]
    assert ctx.context == "【相关片段 1 (文档: doc, 作者: 未知, 页码: 未知, 块ID: a)】\nA\n\n---\n\n【相关片段 2 (文档: 未知, 作者: 未知, 页码: 3, 块ID: c)】\nC"
    asked = spark.createDataFrame([(1,), (2,), (3,)], "request_id int")
    assert {tuple(r) for r in retrieve.request_outcomes(asked, merged, useful).collect()} == {(1, 3, 2, "completed"), (2, 1, 0, "no_context_found_after_usefulness"), (3, 0, 0, "no_context_found")}
    stats = {(r.request_id, r.stage): r.n for r in retrieve.retrieval_stats(_hits(spark), merged, useful).collect()}
    assert stats[1, "unique"] == 3 and stats[1, "path_keyword"] == 2 and stats[1, "useful"] == 2
    shown = retrieve.preview(merged, chunks).where("request_id = 1 and chunk_id = 'a'").first()
    assert (shown.paths, shown.scores) == (["text", "keyword"], [0.9, 0.4])


def test_rewrites_and_queries(spark):
    df = spark.createDataFrame([(1, '{"question": "q", "broadened_question": ["b"], "keyword": ["k"]}'), (2, "no"), (3, '{"question": "r"}')], "request_id int, response string")
    r = retrieve.parse_rewrites(df)
    assert sorted(tuple(x) for x in retrieve.expand_queries(r, "text").collect()) == [(1, 0, "q"), (1, 1, "b"), (3, 0, "r")]
    assert sorted(tuple(x) for x in retrieve.expand_queries(r, "keyword").collect()) == [(1, 0, "k"), (1, 1, "b")]
    one = spark.range(1).select(retrieve.instruct_query(F.lit("x"), "task").alias("a"), retrieve.instruct_query(F.lit("x"), None).alias("b")).first()
    assert tuple(one) == ("Instruct: task\nQuery:x", "x")


def test_keywords(spark):
    chunks = spark.createDataFrame([("a", "sun sun moon"), ("b", "moon star")], "chunk_id string, text string")
    p = index.build_postings(chunks)
    got = rules.tfidf_keywords(p, index.bm25_stats(chunks, p), 1)
    assert {(r.chunk_id, r.term) for r in got.collect()} == {("a", "sun"), ("b", "star")}


def test_history(spark):
    data = [(1, k, ["user", "assistant", "system"][k % 3], f"m{k}") for k in range(25)] + [(2, 0, "system", "s")]
    turns = spark.createDataFrame(data, "conv_id int, turn int, role string, text string")
    recent = chat.recent_history(turns)
    assert sorted(r.turn for r in recent.collect()) == [k for k in range(5, 25) if k % 3 < 2]
    text = {r.conv_id: r.history for r in chat.format_history(recent, turns).collect()}
    assert text[2] == "[对话历史]\n" and text[1].startswith("[对话历史]\nuser: m6\nassistant: m7\n") and text[1].endswith("user: m24\n")
    rows = chat.history_messages(recent.where("turn > 20")).withColumns({"user_query": F.lit("u"), "context": F.lit("c"), "broadened_question": F.array(F.lit("x"), F.lit("y"))})
    m = chat.generator_messages(rows, "sys").first().messages
    assert [x.role for x in m] == ["system", "assistant", "user", "assistant", "user", "user", "tool", "assistant"][0:1] + [x.role for x in m[1:-3]] + ["user", "tool", "assistant"]
    assert m[-1].content.endswith("x, y") and m[-2].content.endswith("\nc") and m[0].content == "sys"


def test_templates(spark):
    df = spark.createDataFrame([("h", "q", "t", ["a", "b"])], "history string, question string, text string, questions array<string>")
    assert chat.rewrite_requests(df, "{context}/{question}").first().request == "h/q"
    assert chat.judge_requests(df, "{knowledge_content}/{questions}").first().request == "t/a\nb"


def test_index_and_answer_end_to_end(spark, tmp_path):
    def embed(texts):
        return [[float(len(x)), float(x.count("s")), 1.0] for x in texts]

    data = [("a", "sun and sky and stars", ["sun"], ["what is the sun?"]), ("b", "moon over water", ["moon"], ["where is the moon?"]), ("c", "bread with butter", ["bread"], [])]
    chunks = spark.createDataFrame(data, "chunk_id string, text string, keyword_summaries array<string>, generated_questions array<string>")
    with pytest.raises(FileNotFoundError, match="chunks, vectors, postings, phrases, questions"):
        files.read_index(spark, str(tmp_path / "none"))
    tables = build_index(chunks, embed, str(tmp_path / "index"))
    assert files.missing_tables(spark, str(tmp_path / "index")) == []
    requests = spark.createDataFrame([(1, "sun sky", ["stars"], ["sun"])], "request_id long, question string, broadened_question array<string>, keyword array<string>")
    out = answer(tables, requests, embed)
    assert out["outcomes"].first().outcome == "completed"
    assert "a" in out["contexts"].first().chunk_ids
    assert build_index(chunks, embed, str(tmp_path / "trial"), limit=1)["chunks"].count() == 1
