"""Search over blocks with bounds: the rows of the full search, with fewer blocks read."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import impacts, index, retrieve


@pytest.mark.parametrize("size, first", [(4, None), (4, 2), (64, 8), (1000, 1)])
def test_blocks_give_the_full_search(spark, tmp_path, size, first):
    rng = random.Random(3)
    common, rare = [f"w{k}" for k in range(12)], [f"rare{k}" for k in range(300)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    texts[40:60] = [texts[40]] * 20  # ties
    chunks = spark.createDataFrame([(f"c{k:03}", t) for k, t in enumerate([*texts, "", None])], "chunk_id string, text string")
    asked = [("a:1", 0, "rare1 rare2 rare3 rare4 w0 w1 w2"), ("a:1", 1, texts[40]), ("b", 0, "w0"), ("b", 1, "nothing here"), ("b", 2, None), ("c", 0, "rare7 rare7 rare8 rare9 w3 w3 w3")]
    queries = spark.createDataFrame(asked, "request_id string, sub_id int, query string")
    postings = index.build_postings(chunks)
    stats = index.bm25_stats(chunks, postings)
    held = impacts.write_blocks(postings, stats, str(tmp_path / "index"), size)
    got, share = impacts.block_search(held, queries, 10, first)
    want = retrieve.bm25_search(postings, stats, queries, 10)
    key = lambda df: sorted(tuple(r) for r in df.select("request_id", "sub_id", "bm25_rank", "chunk_id", "score").collect())
    assert key(got) == key(want) and len(key(got)) > 20
    read = {(r.request_id, r.sub_id): (r.n_blocks, r.n_read) for r in share.collect()}
    assert all(n <= m for m, n in read.values())
    if size == 4 and first is None:
        assert read["a:1", 0][1] < 0.5 * read["a:1", 0][0] and read["c", 0][1] < 0.5 * read["c", 0][0], read
    assert {r.term: r.df for r in held.terms.collect()} == {r.term: r.df for r in index.term_stats(postings).collect()}


def test_blocks_of_nothing(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "two three")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, 0, "two one")], "request_id long, sub_id int, query string")
    postings = index.build_postings(chunks)
    empty = impacts.write_blocks(postings.where("false"), index.bm25_stats(chunks.where("false"), postings.where("false")), str(tmp_path / "none"))
    assert impacts.block_search(empty, queries)[0].count() == 0
    held = impacts.write_blocks(postings, index.bm25_stats(chunks, postings), str(tmp_path / "some"))
    assert impacts.block_search(held, queries.where("false"))[0].count() == 0


def test_entries_are_scored_where_they_lie(spark, tmp_path, monkeypatch):
    """Counted chunks become blocks, bounds and scores without a move of an entry, whatever slices they are cut into."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 30)]) for _ in range(rng.randint(1, 50))) for _ in range(300)]
    chunks = spark.createDataFrame([(f"c{k:03}", t) for k, t in enumerate([*texts, None])], "chunk_id string, text string").repartition(3)
    asked = [("a", 0, "w1 w1 w29"), ("a", None, "w2 w3"), (None, 0, "w2 w3"), ("b", 0, " ".join(words)), ("c", 0, "none")]
    queries = spark.createDataFrame(asked, "request_id string, sub_id int, query string")
    counted, parts = index.search_counts(chunks, queries.select(F.explode(F.split("query", " ")).alias("term")))
    stats = index.bm25_stats(chunks, parts)
    key = lambda df: sorted(((r.request_id, r.sub_id, r.bm25_rank, r.chunk_id, r.score) for r in df.collect()), key=repr)
    want = key(retrieve.bm25_search(counted, stats, queries, 5))
    assert len(want) == 20
    for n, part in enumerate((7, 1 << 18)):
        monkeypatch.setattr(impacts, "PART", part)
        monkeypatch.setattr(impacts, "SLICE", part)
        held = impacts.write_blocks(counted, stats, str(tmp_path / f"index{n}"), 8)
        hits, share = impacts.block_search(held, queries, 5, 2)
        assert key(hits) == want
        assert all(2 <= r.n_read <= r.n_blocks for r in share.collect())
        most = {(r.term, r.block): (r.n, round(r.most, 9)) for r in held.bounds.collect()}
        rows = index.by_term(held.entries, "block").withColumn("w", held.weight()).groupBy("term", "block").agg(F.count("*").alias("n"), F.max("w").alias("most"))
        assert most == {(r.term, r.block): (r.n, round(r.most, 9)) for r in rows.collect()}
        assert held.bounds.count() == len(most) and {r.n for r in held.entries.groupBy("block").agg(F.count("*").alias("n")).collect()} <= set(range(9))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "explode" not in plan.lower()
    joined = impacts.block_search(held, queries.where("request_id is not null and sub_id is not null"), 5, 2, broadcast_terms=0)[0]
    assert [r[:4] for r in key(joined)] == [r[:4] for r in want if None not in r[:2]]
