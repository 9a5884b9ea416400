"""Search by codes and bounds: the rows of the full products, with few of them made."""

import numpy as np
import pytest

from foliant.functions.expr import ranked
from foliant.operators import pruned, retrieve
from foliant.operators.dense import nearest_blocks


def _frames(spark, x, q):
    vectors = spark.createDataFrame([(f"v{k:05}", v.tolist()) for k, v in enumerate(x)] + [("null", None), (None, x[0].tolist()), ("zero", [0.0] * x.shape[1])], "id string, v array<double>")
    return vectors, spark.createDataFrame([(f"q:{k}", v.tolist()) for k, v in enumerate(q)] + [("none", None)], "q string, v array<double>")


@pytest.mark.parametrize("threshold", [-1.0, 0.3])
def test_pruned_equals_full(spark, tmp_path, threshold):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 32))
    x[100:400] = x[100]  # ties
    x[400:900] = x[400] + 1e-3 * rng.normal(size=(500, 32))  # closer together than codes can tell
    q = np.concatenate((rng.normal(size=(20, 32)), x[[100, 400, 5]], -x[:1]))
    vectors, queries = _frames(spark, x * rng.uniform(0.1, 9, (6000, 1)), q)
    found, full = pruned.pruned_nearest(pruned.write_vectors(vectors, str(tmp_path / "index")), queries, 10, threshold)
    want = ranked(nearest_blocks(vectors, queries, 10, threshold), ["q"], "score", "id", 10)
    key = lambda df: sorted((r.q, r.id, r.score) for r in df.collect())
    assert key(found) == key(want) and len(key(found)) > 20
    n = {r.q: r.n_full for r in full.collect()}
    assert n["q:21"] >= 500 and sorted(n.values())[len(n) // 2] < 300  # of 6,001


def test_bounds_hold(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 16))
    vectors, _ = _frames(spark, x, x[:1])
    index = pruned.write_vectors(vectors, str(tmp_path / "index"))
    full = {r.id: np.array(r.v) for r in index.full.collect()}
    for r in index.codes.collect():
        code = np.frombuffer(r.code, np.int8) * r.scale
        assert np.sqrt(((full[r.id] - code) ** 2).sum()) <= r.off + 1e-12


def test_pruned_small_empty_and_many(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 4))
    vectors, queries = _frames(spark, x, x[:2])
    index = pruned.write_vectors(vectors, str(tmp_path / "index"))
    want = sorted((r.q, r.id) for r in ranked(nearest_blocks(vectors, queries, 20), ["q"], "score", "id", 20).collect())
    assert sorted((r.q, r.id) for r in pruned.pruned_nearest(index, queries, 20)[0].collect()) == want and len(want) == 16
    found, full = pruned.pruned_nearest(index, queries, 3, broadcast_bytes=0)
    assert sorted((r.q, r.id) for r in found.collect()) == sorted((r.q, r.id) for r in pruned.pruned_nearest(index, queries, 3)[0].collect())
    assert {r.n_full for r in full.collect()} == {8}
    assert pruned.pruned_nearest(index, queries.where("false"), 3)[0].count() == 0
    none = pruned.write_vectors(vectors.where("false"), str(tmp_path / "none"))
    assert pruned.pruned_nearest(none, queries, 3)[0].count() == 0
    asked = spark.createDataFrame([("r:1", 0, x[0].tolist())], "request_id string, sub_id int, embedding array<double>")
    assert retrieve.dense_search(index, asked, 1).first().chunk_id == "v00000"
    questions = spark.createDataFrame([(f"v{k:05}", f"c{k}", "?") for k in range(7)], "question_id string, chunk_id string, question string")
    assert retrieve.question_search(questions, asked, questions.select("chunk_id"), 1, index=index).first().chunk_id == "c0"
