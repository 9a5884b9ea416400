import pytest
from pyspark.sql import functions as F

from foliant.operators import index, model, responses, rules
from foliant.functions.expr import l2_normalize
from foliant.plans.jobs import annotate, repair


def _parse(spark, answers):
    df = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "id int, response string")
    return [(r.status, r.refined_text) for r in responses.parse_refinement(df).orderBy("id").collect()]


def test_parse_refinement(spark):
    good = '{"optimized_chunk_B_text": " x "}'
    assert _parse(spark, [good, f"```json\n{good}\n```", "{broken", '{"a": 1}', '{"optimized_chunk_B_text": 3}', "", None]) == [
        ("success", "x"), ("success", "x"), ("json_decode_error", None), ("missing_key", None), ("missing_key", None), ("empty_content", None), ("empty_content", None),
    ]


def test_resolve_and_apply(spark):
    bad = "json_decode_error"
    data = [("a", k, bad, None) for k in range(1, 5)] + [("a", 5, "success", "fixed")] + [("b", k, bad, None) for k in range(1, 6)] + [("b", 6, "success", "late")] + [("c", 1, "missing_key", None), ("c", 2, "success", "no")]
    attempts = spark.createDataFrame(data, "chunk_id string, attempt int, status string, refined_text string")
    got = responses.resolve_attempts(attempts)
    assert {(r.chunk_id, r.attempt, r.status) for r in got.collect()} == {("a", 5, "success"), ("b", 5, bad), ("c", 1, "missing_key")}
    chunks = spark.createDataFrame([(c, "old") for c in "abcd"], "chunk_id string, text string")
    assert {tuple(r) for r in responses.apply_refinements(chunks, got).collect()} == {("a", "fixed"), ("b", "old"), ("c", "old"), ("d", "old")}


def _answer(ok, extra=""):
    return '{"is_meaningful": %s, "reason_if_not_meaningful": "", "keyword_summaries": ["k"], "generated_questions": ["q?"]%s}' % ("true" if ok else "false", extra)


def test_annotations(spark):
    data = [("a", 1, "junk"), ("a", 2, _answer(True)), ("b", 1, _answer(False)), ("c", 1, '{"is_meaningful": true}'), ("c", 2, "x"), ("c", 3, "y"), ("c", 4, _answer(True)), ("e", 1, _answer(True)), ("f", 1, f"```json\n{_answer(True)}\n```")]
    first = responses.first_valid(responses.parse_annotations(spark.createDataFrame(data, "chunk_id string, attempt int, response string")))
    chunks = spark.createDataFrame([("a", "text"), ("b", "text"), ("c", "text"), ("e", " "), ("f", "text")], "chunk_id string, text string")
    assert [(r.chunk_id, r.keyword_summaries, r.generated_questions, r.is_meaningful) for r in responses.annotate_chunks(chunks, first).collect()] == [("a", ["k"], ["q?"], True)]
    assert tuple(responses.annotation_stats(chunks, first).first()) == (5, 3, 1, 2, 2, 0.6)


def test_model_calls(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id int, request string")
    assert {(r.id, r.response) for r in model.apply_model(df, lambda xs: [x.upper() for x in xs], batch=1).collect()} == {(1, "A"), (2, None), (3, None)}
    emb = model.embed_texts(df.withColumnRenamed("request", "text"), lambda xs: [[float(len(x)), 1.0] for x in xs])
    assert {(r.id, tuple(r.embedding) if r.embedding else None) for r in emb.collect()} == {(1, (1.0, 1.0)), (2, (1.0, 1.0)), (3, None)}


def test_models_must_answer_every_request(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, request string").coalesce(1)
    for call in (lambda: model.apply_model(df, lambda xs: xs[:1]), lambda: model.embed_texts(df, lambda xs: [[1.0]], "request")):
        with pytest.raises(Exception, match="1 answers to 3 requests"):
            call().collect()


def test_requests(spark):
    df = spark.createDataFrame([("{text_b}", "B", None)], "text_a string, text string, text_c string")
    assert model.build_requests(df, "[{text_a}|{text_b}|{text_c}]", "repair").first().request.startswith("[{text_b}|B|N/A")


def test_jobs_repair_and_annotate(spark, tmp_path):
    data = [("d", 0, 1, "1", 1, "alpha", "d_p1_c1"), ("d", 1, 2, "2", 1, "beta", "d_p2_c1"), ("d", 2, 3, "3", 1, "gamma", "d_p3_c1")]
    chunks = spark.createDataFrame(data, "doc_name string, page_ord int, page_number int, page_label string, chunk_no int, text string, chunk_id string")
    out = repair(chunks, lambda xs: ['{"optimized_chunk_B_text": "%s"}' % x.replace("|", "-") for x in xs], "{text_a}|{text_b}|{text_c}", str(tmp_path / "r"))
    assert [r.text for r in out.orderBy("page_ord").collect()] == ["alpha", "alpha-beta-gamma", "gamma"]
    kept = annotate(chunks, lambda xs: [_answer("beta" not in x) for x in xs], "{chunk_id}: {text}", str(tmp_path / "a"))
    assert sorted(r.text for r in kept.collect()) == ["alpha", "gamma"]
    first = annotate(chunks, lambda xs: [_answer(True) for _ in xs], "{text}", str(tmp_path / "l"), limit=2)
    assert sorted(r.text for r in first.collect()) == ["alpha", "beta"]


def test_select_indexable(spark):
    data = [(0, "a", " x ", True, None), (1, None, "y", None, None), (2, "c", " 　", None, None), (3, "d", "z", False, None), (4, None, "w", True, ["k"])]
    df = spark.createDataFrame(data, "at int, chunk_id string, text string, is_meaningful boolean, keyword_summaries array<string>")
    got = index.select_indexable(df, "at").orderBy("at").collect()
    assert [(r.chunk_id, r.text, r.doc_name, r.page_number, r.keyword_summaries, r.generated_questions) for r in got] == [("a", "x", "unknown_doc", -1, [], []), ("auto_id_1", "y", "unknown_doc", -1, [], []), ("auto_id_2", "w", "unknown_doc", -1, ["k"], [])]


def test_numbers_of_chunks_without_id(spark):
    """Ids follow the order over all ranges, whatever the partitions."""
    df = spark.range(5000).selectExpr("id * 7 as at", "case when id % 2 = 0 then concat('c', id) end as chunk_id", "'text' as text")
    for n in (1, 7):
        got = {r["at"]: r.chunk_id for r in index.select_indexable(df.repartition(n), "at").collect()}
        assert got == {7 * k: f"auto_id_{k}" if k % 2 else f"c{k}" for k in range(5000)}


def test_phrases_questions_and_checks(spark):
    df = spark.createDataFrame([("a", [" p ", "p", " ", None], ["q", " q ", ""]), ("a", ["r s"], [])], "chunk_id string, keyword_summaries array<string>, generated_questions array<string>")
    assert sorted(r.phrase for r in index.phrase_dictionary(df).collect()) == ["p", "r s"]
    assert {tuple(r) for r in index.phrase_index(index.phrase_dictionary(df)).collect()} == {("p", "p", 1, 1), ("r s", "r", 1, 2), ("r s", "s", 1, 2)}
    questions = index.question_index(df)
    assert sorted((r.chunk_id, r.pos, r.question) for r in questions.collect()) == [("a", 0, "q"), ("a", 1, "q")]
    vectors = spark.createDataFrame([("z",)], "chunk_id string")
    bad = {r.check_name: r.n for r in index.check_index(df, vectors, questions, questions.where("pos = 0")).collect()}
    assert bad == {"chunk_without_id": 0, "duplicate_chunk_id": 1, "chunk_without_vector": 2, "vector_without_chunk": 1, "question_without_vector": 1, "vector_without_question": 0, "question_without_chunk": 0}


def test_index_checks_of_odd_keys(spark):
    """Nulls in keys, repeats on both sides and empty tables, against the rules counted one by one in Python."""
    chunks = [None, None, "a", "a", "b", "c"]
    vectors = ["a", "a", "c", "x", None]
    questions = [("a", 0), ("a", 1), ("a", 1), ("q", 0), (None, 0), ("b", None)]
    held = [("a", 1), ("a", 1), ("a", 7), ("b", None), (None, 0)]
    frame = lambda rows, kind: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], kind)
    args = [frame(chunks, "chunk_id string"), frame(vectors, "chunk_id string"), frame(questions, "chunk_id string, pos int"), frame(held, "chunk_id string, pos int")]
    got = {r.check_name: (r.n, r.example) for r in index.check_index(*args).collect()}
    assert got == {
        "chunk_without_id": (2, None), "duplicate_chunk_id": (1, "a"), "chunk_without_vector": (1, "b"), "vector_without_chunk": (2, "x"),
        "question_without_vector": (4, "a"), "vector_without_question": (3, "a"), "question_without_chunk": (2, "q"),
    }
    assert {r.n for r in index.check_index(*[a.where("false") for a in args]).collect()} == {0}
    plan = index.check_index(*args)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 4 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_lookup_in_a_chunk_table_moves_no_text(spark):
    chunks = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") % 2000).cast("string")).alias("chunk_id"), F.col("id").alias("at"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    held = index.write_chunk_table(chunks, "chunk_table", 8)
    hits = spark.createDataFrame([("c5", 1), ("c1999", 2), ("none", 3), ("c5", 4), (None, 5)], "chunk_id string, hit int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = index.lookup(hits, held, "at")
        assert sorted(tuple(r) for r in out.collect()) == [("c1999", 2, "text 1999"), ("c5", 1, "text 2005"), ("c5", 4, "text 2005")]
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        lines = plan.split("\n")
        depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
        at = next(k for k, x in enumerate(lines) if "FileScan" in x)
        above, least = [], depth(lines[at])
        for x in reversed(lines[:at]):
            if depth(x) < least:
                above.append(x)
                least = depth(x)
        assert "Exchange" in plan and not any("Exchange" in x for x in above), above
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE chunk_table")


def test_lookup_takes_the_last(spark):
    chunks = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 3, "x")], "chunk_id string, at int, text string")
    hits = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert [tuple(r) for r in index.lookup(hits, chunks, "at").collect()] == [("a", "new")]


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert sorted(r.v for r in df.select(l2_normalize("v").alias("v")).collect()) == [[0.0, 0.0], [0.6, 0.8]]


def test_meaningful_rule(spark):
    df = spark.createDataFrame([("This is a whole sentence with words.",), ("Fig. 3.2",), ("1 2 3 4 5 6 7 8 9 10 11 12 a b c d",), (None,), (" ",)], "text string")
    assert [r[0] for r in df.select(rules.is_meaningful_rule()).collect()] == [True, False, False, False, False]
