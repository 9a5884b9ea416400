"""Tokens of unspaced scripts, and one tokenizer for index and queries."""

import itertools
import math
import random

from pyspark.sql import functions as F

from foliant.operators import index, retrieve
from foliant.operators.segment import UNSPACED, Segmenter, Words, learn_lexicon, ngram_counts, viterbi


def _all_cuts(run):
    for bits in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        out, at = [], 0
        for k, b in enumerate(bits, 1):
            if b:
                out.append(run[at:k])
                at = k
        yield [*out, run[at:]] if run else []


def test_viterbi_is_the_best_of_all_cuts():
    rng = random.Random(1)
    for _ in range(150):
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
        cost, longest, unknown = Segmenter(1, words).costs()
        run = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        price = lambda cut: sum(cost.get(w, unknown if len(w) == 1 else math.inf) for w in cut)
        least = min(map(price, _all_cuts(run)))
        best = [c for c in _all_cuts(run) if price(c) <= least + 1e-9]
        got = viterbi(run, cost, longest, unknown)
        assert got in best and got == max(best, key=lambda c: list(map(len, c)))  # ties: longer words first


def test_lexicon_of_a_corpus(spark):
    """Words that stand together are learned, chance neighbours are not; against counts in Python."""
    rng = random.Random(2)
    vocabulary = ["数据", "学习", "机器", "图书馆", "天气", "计算机"]
    texts = ["".join(rng.choice(vocabulary) for _ in range(40)) + "。abc" for _ in range(60)] + [None, "", "no such script"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {}
    for t in texts:
        for run in (t or "").split("。"):
            chars = [c for c in run if c > "㐀"]
            for k in range(1, 5):
                for i in range(len(chars) - k + 1):
                    w = "".join(chars[i : i + k])
                    want[w] = want.get(w, 0) + 1
    assert {r.word: r.n for r in ngram_counts(df).collect()} == want
    got = {r.word: r.n for r in learn_lexicon(df, cohesion=1.5).collect()}
    assert set(vocabulary) <= set(got) and all(got[w] == want[w] for w in got)
    cutter = Segmenter.read(learn_lexicon(df, cohesion=1.5))
    tokens = cutter.add(df.where("text is not null").limit(60)).select("tokens").collect()
    share = sum(t in vocabulary for r in tokens for t in r.tokens) / sum(len(r.tokens) for r in tokens)
    assert share > 0.9
    assert learn_lexicon(df.where("false")).count() == 0


def test_a_lexicon_that_is_too_large_is_refused(spark):
    words = spark.range(20).select(F.col("id").cast("string").alias("word"), F.lit(1).cast("long").alias("n"))
    assert len(Segmenter.read(words, most=20).words) == 20
    try:
        Segmenter.read(words, most=19)
    except ValueError:
        return
    raise AssertionError


def test_mixed_scripts_and_odd_rows(spark):
    cutter = Segmenter(2, {"数据": 9, "学习": 5, "据学": 1, "คน": 3})
    df = spark.createDataFrame([(1, "深度数据学习 deep-learning 数据x9", "k"), (2, None, "k"), (3, "", "k"), (4, "คนคน", "k"), (5, "。，!", "k")], "id long, text string, tokens string")
    got = {r.id: r.tokens for r in cutter.add(df).collect()}
    assert got == {1: ["数据", "学习", "deep", "learning", "数据", "x9"], 2: None, 3: [], 4: ["คน", "คน"], 5: []}
    assert Words().add(df).columns == df.columns
    assert {r.id: r.tokens for r in Words(3).add(df).collect()}[1] == ["深度数据学习", "deep", "learning", "数据x9"]


def test_chinese_chunks_are_found(spark):
    """One tokenizer for index and query finds words inside unspaced texts; the default one does not."""
    chunks = spark.createDataFrame([("a", "机器学习需要数据"), ("b", "今天天气很好"), ("c", "图书馆有很多书"), ("d", "数据和天气"), ("e", "别的事情"), ("f", "plain words")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q:1", 0, "天气怎么样"), ("q:2", 0, "学习数据")], "request_id string, sub_id int, query string")
    cutter = Segmenter(2, {w: 5 for w in ("机器", "学习", "需要", "数据", "今天", "天气", "很好", "图书馆", "很多")})

    def hits(tokenizer):
        postings = index.build_postings(chunks, tokenizer=tokenizer)
        out = retrieve.bm25_search(postings, index.bm25_stats(chunks, postings), asked, tokenizer=tokenizer)
        return {(r.request_id, r.chunk_id) for r in out.collect()}

    assert hits(Words()) == set()
    assert {("q:1", "b"), ("q:2", "a")} <= hits(cutter) and ("q:1", "c") not in hits(cutter)


def test_request_ids_of_any_form(spark):
    """String ids with colons, quotes and spaces stay apart in dense, question and hybrid search."""
    ids = ["sess:1", "sess:2", 'a "b"', "a:b:c", "{}", ""]
    vectors = spark.createDataFrame([(f"c{k}", [1.0 if k == j else 0.0 for j in range(6)]) for k in range(6)], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, 0, "words here", [1.0 if k == j else 0.0 for j in range(6)]) for k, i in enumerate(ids)], "request_id string, sub_id int, query string, embedding array<double>")
    want = {(i, f"c{k}") for k, i in enumerate(ids)}
    assert {(r.request_id, r.chunk_id) for r in retrieve.dense_search(vectors, queries).collect()} == want
    questions = vectors.select(F.monotonically_increasing_id().alias("question_id"), "chunk_id", F.lit("?").alias("question"), "embedding")
    assert {(r.request_id, r.chunk_id) for r in retrieve.question_search(questions, queries, vectors).collect()} == want
    chunks = spark.createDataFrame([(f"c{k}", f"text {k}") for k in range(6)], "chunk_id string, text string")
    postings = index.build_postings(chunks)
    got = retrieve.hybrid_search(postings, index.bm25_stats(chunks, postings), vectors, queries)
    assert {(r.request_id, r.chunk_id) for r in got.collect()} == want and dict(got.dtypes)["request_id"] == "string"
    stamped = queries.withColumn("request_id", F.timestamp_seconds(F.length("request_id")))
    assert dict(retrieve.dense_search(vectors, stamped).dtypes)["request_id"] == "timestamp"


def test_script_ranges_read_alike(spark):
    """Java and Python agree on which code points belong to an unspaced script."""
    import re

    chars = [chr(c) for c in [*range(0x0E00, 0x0F00), *range(0x1000, 0x10A0), *range(0x1780, 0x1800), *range(0x3000, 0x3100), *range(0x33F0, 0x3410), *range(0x4DB0, 0x4E10), *range(0x9FF0, 0xA010), *range(0xF8F0, 0xFB10)]]
    got = spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(f"[{UNSPACED}]")).collect()
    assert [r.c for r in got] == [c for c in chars if re.match(f"[{UNSPACED}]", c)]
