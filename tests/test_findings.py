"""What a review of the queries on larger tables found: a small case of each."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.functions.expr import ranked
from foliant.operators import dense, index, markup, pruned, retrieve, rules, windows
from foliant.operators.segment import Segmenter, segment_by_table
from foliant.plans.oracle import ORACLE_SQL
from foliant.plans.queries import QUERIES


def _write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _same(spark, path, name):
    """The query's rows, held against its twin."""
    con = duckdb.connect()
    for p in path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.name[:-8]} AS SELECT * FROM '{p}/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(path)).select(*columns).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
    return got


def test_titles_cut_within_a_reference(spark, tmp_path):
    pages = [(k, f"https://a.b/{k}", f"<html><h1>one &amp; two {end}</h1><p>x &lt; y {end}</p></html>") for k, end in enumerate(["&amp", "&am", "&", "&&amp;&amp", "&lt", "&amp;amp", "&nbsp"])]
    _write(spark, tmp_path, pages=(pages, "page_id long, url string, html string"))
    for name in ("chapters_to_text", "assemble_books", "split_pages", "chunk_ids", "conversion_report"):
        assert _same(spark, tmp_path, name)


def test_closed_references_alone():
    cases = {"a &amp b &#66; &#x43; &#66 &eacute; &nosuch; &notit; &copy": "a &amp b B C &#66 é &nosuch; &notit; &copy", "x&&amp;&am": "x&&&am", "<i title='a&amp'>y</i>": "y"}
    for text, want in cases.items():
        assert markup.read_chapter(f"<h1>t</h1><p>{text}</p>", bare=False) == ("t", [want])


def test_a_lexicon_of_any_size(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))): rng.randint(1, 50) for _ in range(150)}
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) + rng.choice(["", ". xyz", "zz12"]) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate([*texts, texts[0], "", None, "zz"])], "k int, text string")
    lexicon = spark.createDataFrame(list(words.items()), "word string, n long")
    for held in (lexicon, lexicon.where("false")):
        want = Segmenter.read(held, least=1, script="a-c").add(rows)
        got = segment_by_table(rows, held, least=1, script="a-c", longest=5)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_rare_words_of_a_large_vocabulary(spark, tmp_path):
    """The least frequent words, last in the alphabet, of a vocabulary of more than 200,000 are known too."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(w) for w in itertools.islice(itertools.product(letters, repeat=4), 200_000)]
    docs = [(k, " ".join(vocabulary[k::40] * 3)) for k in range(40)] + [(40, "zzzebra zzzebra")]
    _write(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(1, "zzzebra")], "item_id long, text string"))
    assert [r.word for r in QUERIES["segment_words"](spark, str(tmp_path)).collect()] == ["zzzebra"]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_terms_are_counted_where_the_chunk_lies(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "Dd", "x", "é1"]) for _ in range(rng.randint(0, 30))) for _ in range(50)]
    texts[3] = "aa bb " * 200_000  # more than are counted together
    chunks = spark.createDataFrame([*enumerate([*texts, None])], "chunk_id long, text string")
    got = index.build_postings(chunks)
    assert _exchanges(got) == 0
    tokens = {k: [w for w in (t or "").split() if len(w) > 1] for k, t in enumerate([*texts, None])}
    want = {(k, w, n, len(ts)) for k, ts in tokens.items() for w, n in Counter(ts).items()}
    assert {tuple(r) for r in got.collect()} == want
    twice = {tuple(r) for r in index.build_postings(chunks.unionByName(chunks)).collect()}
    assert twice == {(k, w, 2 * n, dl) for k, w, n, dl in want}


def test_phrases_are_counted_where_the_chunk_lies(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a ", "b ", "c  ", "B ", ", ", ". ", "dd "]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    chunks = spark.createDataFrame([*enumerate([*texts, None, ""])], "chunk_id long, text string")
    got = rules.phrase_candidates(chunks, 4)
    assert _exchanges(got) == 0
    want = Counter()
    for k, t in enumerate(texts):
        for run in re.split(r"[,.]", t.lower()):
            w = run.split()
            for size in (2, 3, 4):
                for i in range(len(w) - size + 1):
                    want[k, " ".join(w[i : i + size]), size] += 1
    assert {tuple(r) for r in got.collect()} == {(*key, n) for key, n in want.items()}
    twice = rules.phrase_candidates(chunks.unionByName(chunks), 4)
    assert {tuple(r) for r in twice.collect()} == {(*key, 2 * n) for key, n in want.items()}
    assert rules.phrase_labels(chunks.unionByName(chunks)).count() > 0


def test_best_terms_do_not_depend_on_what_is_sent(spark):
    rng = random.Random(9)
    words = [f"t{k}" for k in range(60)]
    rows = [(f"c{k}", [(w, rng.randint(1, 3)) for w in rng.sample(words, rng.randint(0, 25))]) for k in range(80)]
    counted = spark.createDataFrame(rows, "chunk_id string, terms array<struct<term:string,tf:bigint>>")
    facts = [(w, rng.randint(1, 40), rng.choice([0.0, 0.5, 1.0, 2.0])) for w in words[:50]]
    each = {w: e for w, _, e in facts}
    table = spark.createDataFrame(facts, "term string, df long, each double")
    for floor in (False, True):
        want = set()
        for c, terms in rows:
            weighed = sorted((-n * each[w], w) for w, n in terms if w in each and (not floor or each[w] > 0))
            want |= {(c, w, r + 1, -x) for r, (x, w) in enumerate(weighed[:5])}
        for most in (0, 1, 20, 1000):
            assert {tuple(r) for r in index.top_terms(counted, table, 5, most, floor).collect()} == want, most


def test_many_queries_take_bounded_memory():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(3000, 8)).astype(np.float32)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    codes = rng.integers(-127, 128, (4096, 8)).astype(np.int8)
    scale = 1 / np.linalg.norm(codes.astype(float), axis=1)
    b = pa.record_batch({"id": [f"v{i}" for i in range(4096)], "code": pa.array([c.tobytes() for c in codes], pa.binary()), "scale": scale, "off": np.zeros(4096)})
    tracemalloc.start()
    seen = Counter()
    for out in pruned._candidates(SimpleNamespace(value=(list(range(3000)), y)), 5, -1.0)([b]):
        seen.update(out["q"].to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) == 3000 and min(seen.values()) >= 5
    assert peak < 80e6, peak


def test_windows_move_texts_once(spark):
    """The rows of a window, three texts wide, are not shuffled again to meet the neighbours beyond their run."""
    rows = [(None if d == 0 else f"d{d}", p if p % 5 else None, p, f"t{d}-{p}" if p % 7 else None) for d in range(6) for p in range([3, 60, 1, 2, 25, 9][d])]
    chunks = spark.createDataFrame(rows, "doc_name string, page_number int, page_ord int, text string")
    whole = windows.context_windows(chunks, ["page_number", "page_ord"], middle_only=False)
    cut = windows.context_windows(chunks, ["page_number", "page_ord"], middle_only=False, span=7)
    assert cut.columns == whole.columns
    assert sorted(cut.collect(), key=repr) == sorted(whole.collect(), key=repr)
    assert "SortMergeJoin" not in cut._jdf.queryExecution().executedPlan().toString()


def _search_case(rng, n):
    words = ["w0"] * 9 + [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    texts[n // 2 :] = texts[: n - n // 2]  # copies tie
    rows = [(f"c{k}", t) for k, t in enumerate(texts)] + [("none", None), ("blank", " . ")]
    queries = [(f"r:{k}", s, " ".join(rng.choice([*words, "absent"]) for _ in range(rng.randint(0, 9)))) for k in range(5) for s in range(2)]
    return rows, queries


def _bm25(rows, queries, limit, k1=1.5, b=0.75):
    """By its definition, chunk by chunk; the sums are exact."""
    tokens = {c: [w for w in re.findall(r"\w+", t or "") if len(w) > 1] for c, t in rows}
    df = Counter(w for ts in tokens.values() for w in set(ts))
    raw = {w: math.log(len(rows) - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor, avgdl = 0.25 * sum(raw.values()) / len(raw), sum(map(len, tokens.values())) / len(rows)
    for r, s, q in queries:
        scores = []
        for c, ts in tokens.items():
            tf = Counter(ts)
            parts = [n * (floor if raw[w] < 0 else raw[w]) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ts) / avgdl)) for w, n in Counter(q.split()).items() if tf[w]]
            scores.append((-round(math.fsum(parts), 9), c))
        yield from ((r, s, c, -x, k + 1) for k, (x, c) in enumerate(sorted(y for y in scores if y[0] < 0)[:limit]))


def test_chunks_are_scored_where_they_lie(spark, monkeypatch):
    """Counted chunks are scored without a shuffle, from one reading of the texts; only the best of a slice leave it."""
    rng = random.Random(11)
    rows, asked = _search_case(rng, 150)
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame(asked, "request_id string, sub_id int, query string")
    terms = queries.select(F.explode(F.split("query", " ")).alias("term"))
    counted, parts = index.search_counts(chunks, terms)
    postings = index.build_postings(chunks)
    stats, whole = index.bm25_stats(chunks, parts), index.bm25_stats(chunks, postings)
    assert (stats.n, stats.avgdl) == (whole.n, whole.avgdl) and math.isclose(stats.floor, whole.floor)
    sent, joined = index.search_counts(chunks, terms, most=0)
    assert math.isclose(index.bm25_stats(chunks, joined).floor, whole.floor)
    want = list(_bm25(rows, asked, 7))
    assert want
    near = lambda rows: sorted((r, s, c, round(x, 7), k) for r, s, c, x, k in rows)
    for slice_ in (1, 300, 1 << 20):
        monkeypatch.setattr(retrieve, "SLICE", slice_)
        for p in (counted, postings, sent):
            assert near(map(tuple, retrieve.bm25_search(p, stats, queries, 7).collect())) == near(want), slice_
    for p in (counted, postings):  # more terms than are sent
        assert near(map(tuple, retrieve.bm25_search(p, stats, queries, 7, broadcast_terms=0).collect())) == near(want)
    facts = queries.select("request_id", "sub_id", F.explode(F.split("query", " ")).alias("term")).groupBy("request_id", "sub_id", "term").agg(F.count("*").alias("qtf")).withColumn("idf", F.lit(1.0))
    out = retrieve._scored(counted.coalesce(1), facts, 7, 1.5, 0.75, stats.avgdl)
    assert _exchanges(out) == 0 and out.groupBy("request_id", "sub_id").count().where("count > 7").isEmpty()


def test_counts_of_repeated_chunks_are_put_together(spark):
    rows, asked = _search_case(random.Random(12), 40)
    twice = spark.createDataFrame(rows + rows, "chunk_id string, text string")
    queries = spark.createDataFrame(asked, "request_id string, sub_id int, query string")
    counted, parts = index.search_counts(twice, queries.select(F.explode(F.split("query", " ")).alias("term")))
    postings = index.build_postings(twice)
    assert {tuple(r) for r in index.by_term(counted).collect()} == {tuple(r) for r in postings.collect() if any(r.term in q.split() for _, _, q in asked)}
    assert {(r.term, r.df, r.tf) for r in parts.collect()} == {(r.term, r.df, r.tf) for r in index.term_stats(postings, counts=True).collect()}


def test_blocks_of_a_task_give_out_what_others_do_not_surpass(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 1)
    x[200:] = x[:200]  # copies tie
    x[0] = x[200] = 1.0
    vectors = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").coalesce(1)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(x[:20] + 0.05)], "q string, v array<double>")
    best = lambda df: sorted(map(tuple, ranked(df, ["q"], "score", "id", 5).collect()))
    for threshold in (-1.0, 0.5):
        whole = dense.nearest_blocks(vectors, queries, 5, threshold)
        cut = dense.nearest_blocks(vectors, queries, 5, threshold, vector_rows=25)
        assert best(cut) == best(whole) == best(dense.nearest_blocks(vectors, queries, 5, threshold, vector_rows=25, query_rows=7, broadcast_bytes=0))
    assert cut.count() < 20 * 5 * 16 / 2
