"""Nearest neighbours, toxicity, quality trees, mixing and near-duplicates."""

import random
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing, near_dup, permutation_index, quality_trees, toxicity


def _vectors(spark, n=3000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))).round(3)
    x[50:150] = x[50]  # one very common vector
    rows = [(k, [float(v) for v in r], "z") for k, r in enumerate(x)]
    odd = [(n, None, "z"), (n + 1, [0.0] * dim, "z"), (n + 2, [float("nan")] * dim, "z"), (n + 3, [None] + [1.0] * (dim - 1), "z"), (n + 4, [1.0] * 3, "z"), (n + 5, [float("inf")] * dim, "z"), (None, [1.0] * dim, "z")]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, shard string")


def test_permutation_index(spark):
    x, vectors = _vectors(spark)
    out = permutation_index.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=10, shard_rows=1500, query_rows=100, rerank=0.2, pivots=64, length=32).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-9)
    assert sorted(got) == list(range(0, 3000, 20)) and all(len(v) == 10 for v in got.values())
    recall = []
    for q, v in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:10]
        recall.append(len(set(best) & {i for i, _ in v}) / 10)
        assert [i for i, _ in v] == [i for i, _ in sorted(v, key=lambda p: (-p[1], p[0]))]
    assert np.mean(recall) >= 0.9
    tied = [i for i, _ in got[60] if 50 <= i < 150]
    assert len(tied) > 2 and tied == [k for k in range(50, 150) if k != 60][: len(tied)]  # ties to the smaller id


@pytest.mark.parametrize("copies", [0, 8192])
def test_permutation_index_full_shards(spark, tmp_path, copies):
    """Recall on three full shards, without and with a third of the rows near copies of one vector."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3 * 8192, 32))
    x[:copies] = x[0] + 0.05 * rng.normal(size=(copies, 32))
    x = x[rng.permutation(len(x))]
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float64()))}), tmp_path / "vectors.parquet")
    vectors = spark.read.parquet(str(tmp_path / "vectors.parquet"))
    got = defaultdict(set)
    for r in permutation_index.nearest(vectors, vectors.where("vec_id % 200 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    assert len(got) == 123
    recall = []
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(found & set(np.argsort(-s)[:20].tolist())) / 20)
    print(f"recall with {copies} near copies: {np.mean(recall):.4f}")
    assert np.mean(recall) >= 0.98


def test_permutation_index_small_and_empty(spark):
    _, vectors = _vectors(spark)
    few = vectors.where("vec_id < 3")
    out = permutation_index.nearest(few, few.where("vec_id = 0"), k=10)
    assert [r["rank"] for r in out.orderBy("rank").collect()] == [1, 2]
    assert permutation_index.nearest(few.where("false"), few, k=10).count() == 0
    assert permutation_index.nearest(few, few.where("false"), k=10).count() == 0


def test_permutation_index_repeated_ids_and_wide_vectors(spark):
    """A query that occurs twice has its neighbours once; a repeated candidate counts as often as it occurs."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 3000))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    vectors = spark.createDataFrame([*rows, rows[0], rows[20], rows[7]], "vec_id long, embedding array<double>")
    out = permutation_index.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=41).orderBy("query_id", "rank").collect()
    for q in (0, 20):
        got = [r.vec_id for r in out if r.query_id == q]
        s = x @ x[q]
        want = sorted([k for k in [*range(40), 0, 20, 7] if k != q], key=lambda k: (-s[k], k))
        assert got == want and [r["rank"] for r in out if r.query_id == q] == list(range(1, len(want) + 1))


def test_permutation_index_recall_on_embeddings(spark):
    """The registered query against brute force on the given vectors."""
    from foliant.llm.queries import QUERIES

    got = defaultdict(set)
    for r in QUERIES["op1_permutation_index"](spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    recall = []
    for q, found in got.items():
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        recall.append(len(found & set(ids[np.argsort(-s, kind="stable")[:20]].tolist())) / 20)
    assert len(got) == 100 and np.mean(recall) >= 0.95


def _toxic_texts(n, seed):
    rng = random.Random(seed)
    syllables = ["ba", "ro", "ti", "ne", "lu", "sa", "mo", "ker", "lin", "dus"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, marks = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randint(20, 160))]
        bad = k % 3 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "grumpfhead" + rng.choice(["", "s", "er", "ing"])
        texts.append(" ".join(w))
        marks.append(int(bad))
    return texts, marks


def test_toxicity(spark):
    texts, marks = _toxic_texts(900, 1)
    model = toxicity.fit(texts[:600], marks[:600])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts[600:] + ["ba ro grumpfheadz ti ne lu sa", "", "!!! 12"])] + [(9999, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(m) for k, m in enumerate(marks[600:])]) > 0.95
    assert got[300] > 0.5 > got[301]  # a misspelling never seen; an empty text
    assert got[301] == got[302] == got[9999] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(docs.where("false"), model).count() == 0
    leet = toxicity.score_batch(["ba ro gr8mpfhead ti ne lu sa", "ba ro grumpfhe@d$ ti ne lu sa", "ba ro ti ne lu sa", " ".join(["ba ro ti"] * 30_000 + ["grumpfhead"])], toxicity._Words(model))
    assert (leet[[0, 1, 3]] > leet[2]).all()  # digits and signs inside words; the end of a long text
    alone = toxicity.fit(["a", "b"], [1, 1])
    assert 1 / (1 + np.exp(-alone.bias)) > 0.99


def test_toxicity_sample_is_bounded(spark):
    texts, marks = _toxic_texts(300, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks)] + [(0, 1), (None, 1), (77, None)], "doc_id long, toxic int")
    from foliant.llm.labelled import sample

    got = sample(docs, labels, "toxic", 40).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 40, 1: 40}


def test_trees_find_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = quality_trees.fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    assert quality_trees.fit(x[:10], np.ones(10)).score(x)[0] > 0.99
    assert quality_trees.fit(x[:0], y[:0]).score(x)[0] == 0.5


def test_quality_scores(spark):
    rng = random.Random(4)
    texts, marks = [], []
    for k in range(400):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        bad = k % 2
        texts.append(" ".join(x.upper() + "!" if bad and rng.random() < 0.6 else x for x in w))
        marks.append(1 - bad)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks) if k < 300], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_trees.score(docs, quality_trees.train(docs, labels)).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(m) for k, m in enumerate(marks)][300:]) > 0.97
    assert got[500] == got[501] and len(got) == 403
    assert quality_trees.statistics([]).shape == (0, len(quality_trees.STATISTICS))


def _mixed(spark):
    rng = random.Random(5)
    kinds = {"en": ["the", "with", "why", "okay"], "de": ["über", "größe", "zwölf", "können"], "fr": ["été", "très", "français", "où"]}
    rows = []
    for k in range(300):
        lang = "en" if k % 10 < 6 else "de" if k % 10 < 9 else "fr"
        rows.append((k, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randint(15, 60))), lang, "r"))
    return rows, spark.createDataFrame([*rows, (1000, None, "en", "r"), (1001, "", "en", "r"), (None, "the why", "en", "r")], "doc_id long, text string, lang string, rate string")


def test_mixing_meets_the_targets(spark):
    rows, docs = _mixed(spark)
    labelled = docs.where("doc_id % 3 <> 0").select("doc_id", F.col("lang").alias("domain"))
    out = mixing.mix(docs, labelled, {"en": 0.4, "de": 0.3, "fr": 0.3}).collect()
    assert len(out) == len(rows) + 3 and min(r.rate for r in out) >= 0.999
    lang = {k: x for k, _, x, _ in rows}
    assert np.mean([r.domain == lang[r.doc_id] for r in out if r.doc_id in lang]) > 0.97
    total = np.zeros(3)
    for r in out:
        total += r.rate * r.n_tokens * np.array(r.posterior)
        assert abs(sum(r.posterior) - 1) < 1e-9
    assert np.allclose(total / total.sum(), [0.3, 0.4, 0.3], atol=2e-3)  # de, en, fr


def test_rates_equal_a_plain_solver(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    t = rng.integers(0, 90, 200)
    df = spark.createDataFrame([(int(n), [float(v) for v in r]) for n, r in zip(t, p)], "n_tokens long, posterior array<double>")
    steps = mixing.fit_rates(df, ["a", "b", "c"], {"a": 0.9, "b": 0.08, "c": 0.02}, total=2000.0, most_steps=25, close=0.0)
    rate = np.array([r[0] for r in df.select(mixing._rate([F.col("posterior")[k] for k in range(3)], steps)).collect()])
    want, n = np.ones(200), (t[:, None] * p).sum(0)
    for _ in range(25):
        miss = np.array([1800.0, 160.0, 40.0]) - (want * t) @ p
        want = np.maximum(0, want + p @ (miss / n))
    assert np.allclose(rate, want) and rate.min() >= 0
    goal = np.array([1800, 160, 40])
    assert np.square((rate * t) @ p - goal).sum() < 0.2 * np.square(n - goal).sum()


def test_mixing_without_labels_or_targets(spark):
    _, docs = _mixed(spark)
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    for known, goal in ((labelled.where("false"), {"en": 1.0}), (labelled, {}), (labelled, {"xx": 1.0})):
        assert {r.rate for r in mixing.mix(docs, known, goal).collect()} == {1.0}
    assert mixing.mix(docs.where("false"), labelled, {"en": 1.0}).count() == 0
    took = spark.range(20000).select(mixing.copies(F.lit(1.25), F.col("id")).alias("n")).agg(F.avg("n")).first()[0]
    assert took == pytest.approx(1.25, abs=0.02)


def _near_brute(texts, width, percent):
    sets = {}
    for d, x in texts.items():
        w = (x or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.fixture(scope="module")
def families():
    """Copies, near copies that drift away from each other, a passage that all share, short texts."""
    rng = random.Random(7)
    words = [a + b for a in ("ka", "lo", "mi", "re", "su", "ta") for b in ("n", "st", "lor", "v", "dim", "x")]
    shared = [rng.choice(words) for _ in range(40)]
    texts, n = {}, 0
    for f in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(60, 140))]
        for k in range(rng.choice([2, 5, 60])):
            w = list(base)
            for _ in range(k % 9):
                w[rng.randrange(len(w))] = rng.choice(words)
            if k % 4 == 0:
                base = w  # drift: later copies come from this one
            texts[n] = " ".join(w if k % 5 else [x.upper() for x in w])
            n += 1
    for _ in range(30):
        texts[n] = " ".join(shared + [rng.choice(words) for _ in range(40)])
        n += 1
    for x in ("", None, "two words", "Two Words", "one", " one\n", "a b c", "a b c d"):
        texts[n] = x
        n += 1
    for _ in range(25):
        texts[n] = texts[3]
        n += 1
    return texts


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 256), (3, 85, 6), (5, 80, 256)])
def test_near_duplicates(spark, families, monkeypatch, width, percent, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    docs = spark.createDataFrame([(d, x, 1) for d, x in families.items()] + [(None, families[0], 1)], "doc_id long, text string, component long")
    out = near_dup.near_duplicates(docs.repartition(3), width, percent).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got.pop(None)[1:] == (None, True)
    assert got == _near_brute(families, width, percent)


def test_near_duplicates_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (0, "a b c d e f")], schema)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(twice).collect()) == [(0, 0, True), (1, 0, False), (1, 0, False)]


def test_near_duplicates_repeated_ids(spark):
    """Rows of one doc_id with different texts: every text keeps its links, and the rows are one document."""
    words = lambda k: [f"w{k}x{i}" for i in range(60)]
    rows = []
    for k in range(20):
        a, b, c = 40 * k, 40 * k + 2, 40 * k + 1
        p, q = words(2 * k), words(2 * k + 1)
        rows += [(a, " ".join(p)), (a, " ".join(q)), (b, " ".join(p + ["end"])), (c, " ".join(q + ["end"]))]
        rows += [(a + 10, " ".join(["v"] + p[::-1])), (a + 12, " ".join(p[::-1])), (a + 12, " ".join(q[::-1])), (a + 11, " ".join(["v"] + q[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    want = {(40 * k + d, 40 * k + low, d == low) for k in range(20) for low, ds in ((0, (0, 1, 2)), (10, (10, 11, 12))) for d in ds}
    assert got == want


def test_hashes_do_not_depend_on_what_a_worker_has_met():
    """One-byte words hashed in a fresh process, and after longer words in the same one."""
    code = (
        "from foliant.llm.near_dup import shingle_sets, word_hashes\n"
        "texts = ['a b c d e f g h', 'x', 'b a']\n"
        "show = lambda: [s.tolist() for s in shingle_sets(texts, 3)] + [word_hashes(texts)[0].tolist()]\n"
        "first = show()\n"
        "shingle_sets(['words of any length ' + 'z' * 5000], 3)\n"
        "assert show() == first\n"
        "print(first)\n"
    )
    fresh = [subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout for _ in range(2)]
    assert fresh[0] == fresh[1]
    texts = ["a b c d e f g h", "x", "b a"]
    near_dup.shingle_sets(["another history " * 50], 3)
    assert fresh[0].strip().splitlines()[-1] == str([s.tolist() for s in near_dup.shingle_sets(texts, 3)] + [near_dup.word_hashes(texts)[0].tolist()])


def test_near_duplicates_of_one_byte_words(spark):
    """Against brute force; rows lie so that some partitions hold one-byte words only.  Ten times the same."""
    rng = random.Random(10)
    texts = {}
    for k in range(40):
        w = [rng.choice("abcdefghij") for _ in range(30)]
        texts[3 * k], texts[3 * k + 1] = " ".join(w), " ".join([*w, "k"])
        texts[3 * k + 2] = " ".join(f"{x}{x}long" for x in w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = _near_brute(texts, 3, 85)
    for n in (1, 13):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs.repartition(n), 3, 85).collect()}
        assert got == want
    four = {1: "a b c d e f g h", 2: "a b c d e f g h", 3: "words that are longer than these", 4: "words that are longer than these"}
    docs = spark.createDataFrame(list(four.items()), "doc_id long, text string").repartition(4).persist()
    for _ in range(10):
        assert docs.sparkSession.createDataFrame(near_dup.sketches(docs, 3, 4).select("doc_id", "set_a", "set_b").toPandas()).select("set_a", "set_b").distinct().count() == 2
    docs.unpersist()


def test_large_families_meet_in_windows(spark, monkeypatch):
    """A family of several blocks, its sets of very different sizes: links between neighbouring windows stay."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    texts = {k: " ".join(base[: rng.randint(100, 400)]) for k in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 5, 80).collect()}
    assert got == _near_brute(texts, 5, 80)


def test_long_texts_and_ties_of_near_duplicates(spark):
    """A text of 200,000 words beside its near copy; one changed word of many leaves them linked."""
    long = " ".join(f"v{k % 70_000}" for k in range(200_000))
    docs = spark.createDataFrame([(5, long), (6, long + " end"), (7, long), (8, "short text here")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == {(5, 5), (6, 5), (7, 5), (8, 8)}


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    s = near_dup.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.08


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in near_dup.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_toxicity_scores_against_plain_python():
    """One word, window and text at a time."""
    texts, marks = _toxic_texts(200, 5)
    model = toxicity.fit(texts, marks, epochs=30, whole_epochs=10)

    def plain(text):
        words = toxicity._WORD.findall(text.lower())
        tops = []
        for at in range(0, max(1, len(words)), toxicity.WINDOW):
            held = set(words[at : at + toxicity.WINDOW])
            logits = [float(np.mean(model.gram[b])) if len(b := toxicity.ngrams([w])[1]) else 0.0 for w in held]
            tops.append(sum(logits) / (len(held) + toxicity.SMOOTH))
        return 1 / (1 + np.exp(-(max(tops) + model.bias)))

    asked = [*texts[:40], "", "a", "!!! ...", "h4te a$$ ba ro " * 200]
    assert np.allclose(toxicity.score_batch(asked, toxicity._Words(model)), [plain(x) for x in asked], atol=1e-5)


def test_flattened_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(13)
    x = rng.random((600, 4)).round(2)
    trees = quality_trees.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), trees=25)

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.column[at] >= 0:
                at = trees.below[at] if row[trees.column[at]] <= trees.cut[at] else trees.above[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    new = rng.random((200, 4)).round(2)
    assert np.allclose(trees.score(new), [walk(r) for r in new])
    assert len(set(trees.score(new).round(6))) > 10


def test_statistics_of_documents_against_plain_python():
    texts = ["Ab c! 12\n\nab c ab\nab c ab", "", "   ", "ÀÉ漢字 |#|", "word " * 3000, "same\nsame\nSAME"]
    got = quality_trees.statistics(texts)
    for x, row in zip(texts, got):
        s = dict(zip(quality_trees.STATISTICS, row))
        words, lines = x.encode().lower().split(), [y for y in x.split("\n") if y.strip()]
        assert s["log_words"] == pytest.approx(np.log1p(len(words)))
        assert s["distinct_words"] == pytest.approx(len(set(words)) / np.sqrt(max(1, len(words))))
        assert s["duplicate_lines"] == pytest.approx((len(lines) - len(set(lines))) / max(1, len(lines)))
        assert s["upper"] == pytest.approx(sum("A" <= c <= "Z" for c in x) / max(1, len(x)))
        assert s["bang"] == pytest.approx(x.count("!") / max(1, len(x)))
        assert s["top_word"] == pytest.approx(max([words.count(w) for w in set(words)], default=0) / max(1, len(words)))
