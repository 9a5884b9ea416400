"""Bounded samples, batches by bytes, long texts with very many spans, repeated rows."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.llm import private_data, quality_trees, toxicity
from foliant.llm.common import by_size
from foliant.llm.labelled import sample


def test_sample_of_a_doc_id_that_stands_often(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") < 19_000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = sample(docs, labels, "toxic", 2000).collect()
    assert len(got) == len({r.doc_id for r in got}) == 1001
    assert {r.doc_id: r.text for r in got}[1] == "text 0"
    got = sample(docs, labels, "toxic", 100).collect()
    assert len(got) == 200 and sum(r.label for r in got) == 100


def test_batches_by_size():
    texts = ["a" * 10, None, "b" * 100, "c" * 1000, "", "é" * 30, "d"]
    b = pa.record_batch({"text": pa.array(texts), "k": pa.array(range(7))})
    parts = list(by_size(iter([b, b.slice(0, 0)]), most=120, rows=3))
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6]]
    assert [p.num_rows for p in by_size(iter([b]), rows=2)] == [2, 2, 2, 1]


def test_statistics_in_pieces_equal_those_of_whole_texts(monkeypatch):
    """Counts are added up over windows and words over pieces: the same numbers, at two bytes a byte."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab C!#9|é中\n\t ") for _ in range(rng.randint(0, 3000))) for _ in range(40)] + ["", "x" * 5000]
    whole = quality_trees.statistics(texts)
    alone = np.concatenate([quality_trees.statistics([x]) for x in texts])
    pieces = quality_trees._pieces
    monkeypatch.setattr(quality_trees, "_pieces", lambda x: pieces(x, 50))
    assert all("".join(quality_trees._pieces(x)) == x for x in texts)
    cut = np.concatenate([quality_trees.statistics([x]) for x in texts])
    assert (whole == alone).all() and (whole == cut).all()
    k = texts.index(max(texts, key=len))
    assert np.isclose(whole[0, quality_trees.STATISTICS.index("log_words")], np.log1p(len(re.findall(r"[^\x20\x09-\x0D]+", texts[0])))) and whole[k, 0] == np.log1p(1)


def test_many_long_texts_are_scored_in_small_batches(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Lorem ipsum dolor! "), 10_500).alias("text"), F.lit(1).alias("stats"))  # 200 kB each
    trees = quality_trees.fit(np.random.default_rng(1).random((50, 20)), np.arange(50) % 2.0)
    got = quality_trees.score(docs.coalesce(2), trees).agg(F.count("*"), F.countDistinct("score")).first()
    assert tuple(got) == (1000, 1)


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "one two", 7), (1, "one two", 8), (None, "one two", 9), (2, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    trees = quality_trees.fit(np.random.default_rng(1).random((50, 20)), np.arange(50) % 2.0)
    model = toxicity.fit(["good words here", "bad grumpf here"] * 5, [0, 1] * 5)
    for out in (quality_trees.score(docs, trees), toxicity.score(docs, model)):
        got = out.collect()
        assert out.columns == ["doc_id", "score"] and len(got) == 4
        assert len({r.score for r in got if r.doc_id != 2}) == 1
    assert quality_trees.score(docs.where("false"), trees).count() == 0


def test_running_folds(spark):
    import itertools

    rng = random.Random(2)
    rows = [([rng.randint(-50, 50) for _ in range(n)],) for n in (0, 1, 255, 256, 257, 1500)]
    df = spark.createDataFrame(rows, "v array<int>")
    for r in df.select("v", private_data.running(F.col("v"), lambda a, b: a + b).alias("s"), private_data.running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("g")).collect():
        assert r.s == list(itertools.accumulate(r.v)) and r.g == list(itertools.accumulate(r.v, max))


def test_very_many_spans_in_one_text(spark):
    """40,000 mails, and as many candidates, in one text: a task of seconds, with Python's places."""
    n = 40_000
    mails, keys = "mail ab@c.de, " * n, "k3y4a5b6c7d8e9f0 and " * n
    docs = spark.createDataFrame([(1, mails), (2, keys), (3, ("10.0.0.1 token: abcd1234efgh5678 " + "x@y.zz ") * 2000), (3, "")], "doc_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.n > 0): r for r in private_data.base_spans(docs).select("doc_id", *[F.transform(k, lambda s: s["start"]).alias(k) for k in ("email", "ip", "candidates")], (F.size("email") + F.size("candidates")).alias("n")).collect()}
    assert time.time() - began < 120
    assert got[1, True].email == [m.start() for m in re.finditer(r"ab@", mails)]
    assert got[2, True].candidates == [m.start() for m in re.finditer("k3y4", keys)]
    three = got[3, True]
    assert len(three.ip) == len(three.email) == len(three.candidates) == 2000 and three.candidates[1] - three.candidates[0] == 40
    assert got[3, False].email == [] == got[3, False].candidates


def test_candidates_apart_from_base_spans(spark):
    """Against every pair of spans: those that overlap a base span go, the others stay in order."""
    rng = random.Random(9)
    bits = ["a@b.cd", "1.2.3.4", "abcd1234efgh5678", "token=s3cret99", "key: me@x.yz1234567890ab", "+49 30 1234567", "4111 1111 1111 1111", "and", "pin 4821", "x1y2z3a4b5c6@d.ef"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = private_data._found(docs, private_data.PATTERNS | {"candidate": private_data.CANDIDATE, "named": private_data.NAMED}).drop("text")
    base = found.select("doc_id", *[F.filter(k, private_data.CHECKS[k]).alias(k) for k in private_data.PATTERNS], "candidate", F.transform("named", private_data._value).alias("named"))
    raw = {r.doc_id: r for r in base.collect()}
    for r in private_data.base_spans(docs).collect():
        q = raw[r.doc_id]
        fixed = [(s.start, s.end) for k in private_data.PATTERNS for s in q[k]]
        apart = lambda spans, others: [(s.start, s.end) for s in spans if not any(a < s.end and s.start < b for a, b in others)]
        one = apart(q.candidate, fixed)
        two = apart(q.named, fixed + one)
        assert [(s.start, s.end) for s in r.candidates] == sorted(one + two)


def test_a_line_of_all_blocks_and_a_row_of_all_rows(spark, monkeypatch):
    """Shards that all blocks ask are copied and full blocks cut: no group holds many times what it should, and the lines are right."""
    from foliant.llm import line_dedup

    common, row = "the line that all documents hold", "a row that stands very often\nthe line that all documents hold"
    rows = [(k, f"{common}\nthe own line of document {k}") for k in range(2000)] + [(5000, row)] * 3000 + [(6000, row)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    beside = line_dedup._beside
    monkeypatch.setattr(line_dedup, "_beside", lambda df, numbers, key, name: seen.append((key, {r[1] for r in numbers.collect()})) or beside(df, numbers, key, name, 0 if key == "shard" else 100))
    out = line_dedup.dedup_lines(docs, block_docs=20, block_bytes=1 << 30, shard_lines=50).groupBy("doc_id", "text", "n_lines", "n_dropped").count().collect()
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped): r["count"] for r in out}
    want = {(k, rows[k][1] if k == 0 else f"the own line of document {k}", 2, int(k > 0)): 1 for k in range(2000)}
    assert got == want | {(5000, "a row that stands very often", 2, 1): 3000, (6000, "", 2, 2): 1}
    assert [k for k, _ in seen] == ["shard", "shard", "block", "block"] and max(seen[0][1]) >= 2 and max(seen[2][1]) >= 3000 // 80
