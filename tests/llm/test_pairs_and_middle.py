"""Graphs of near vectors, hard negatives and fill-in-middle, against brute force and on odd rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import fill_middle, hard_negatives, small_world

SCHEMA = "vec_id long, label int, embedding array<double>, node string, v string, rank string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def _components(n, pairs):
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def _cosines(x):
    y = x / np.sqrt((x * x).sum(1))[:, None]
    return y @ y.T


@pytest.mark.parametrize("shard_rows, ef", [(4096, 32), (400, 16)])
def test_small_world(spark, shard_rows, ef):
    """Chains, a large family at the threshold and exact copies in a sea of others: no link is lost or made."""
    rng = np.random.default_rng(5)
    n, dim = 2400, 24
    x = rng.normal(size=(n, dim))
    x[100:500] = x[100] + 0.2 * rng.normal(size=(400, dim))  # a family, its cosines on both sides of the threshold
    x[600:640] = x[600]  # exact copies
    for k in range(700, 740):
        x[k] = x[k - 1] + 0.3 * rng.normal(size=dim)  # a chain
    label = (np.arange(n) % 2).tolist()
    label[100:740] = [1] * 640
    got = {r.vec_id: r for r in small_world.near_vectors(_frame(spark, [(k, label[k], x[k].tolist()) for k in range(n)]), shard_rows=shard_rows, ef=ef).collect()}
    s = _cosines(x)
    a, b = np.nonzero((s >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :]))
    pairs = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if i != j]
    count, least = defaultdict(int), _components(n, pairs)
    for i, _ in pairs:
        count[i] += 1
    assert len(got) == n and len(pairs) > 10_000
    assert sum(r.n_links for r in got.values()) >= 0.99 * len(pairs)
    assert all(got[k].n_links <= count[k] for k in range(n))
    assert [got[k].component_id for k in range(n)] == least
    assert all(got[k].kept == (least[k] == k) for k in range(n))


def test_small_world_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one, two, wide = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0]
    rows = [(1, 0, one), (2, 0, [2.0, 0.0, -0.0]), (2, 0, two), (3, 0, two), (4, 1, one), (5, None, one), (6, 0, None), (7, 0, [0.0] * 3), (8, 0, [nan, 1.0, 0.0]), (9, 0, [inf, 0.0, 0.0]), (10, 0, [None, 1.0, 0.0]), (11, 0, wide), (12, 0, [3.0, 0.0]), (13, 0, []), (14, 0, [1e-300, 0.0, 0.0]), (15, 0, [1e300, 1e295, 0.0]), (None, 0, one)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in small_world.near_vectors(_frame(spark, rows)).collect()), key=str)
    # 2 stands twice, with different vectors: one component; 14 and 15 are multiples of 1 but for rounding.
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 1, 1, False), (3, 1, 1, False), (14, 3, 1, False), (15, 3, 1, False), (4, 0, 4, True), (11, 1, 11, True), (12, 1, 11, False)]
    want += [(k, 0, k, True) for k in (5, 6, 7, 8, 9, 10, 13)] + [(None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert small_world.near_vectors(_frame(spark, rows).where("false")).count() == 0


def test_graph_reaches_isolated_pairs():
    """The audit widens beams until the graph of one shard answers as the whole product does."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 48))
    x[1::50] = x[0::50] + 0.1 * rng.normal(size=x[0::50].shape)
    x /= np.sqrt((x * x).sum(1))[:, None]
    layers = small_world.build(x.astype(np.float32))
    assert [layer.n for layer in layers] == [188, 3000] and all((layer.near[: layer.n] < layer.n).all() for layer in layers)
    q = x[::3]
    want = q @ x.T >= 0.93
    got = small_world.links(layers, x, q, 0.93, 16, 0.95, False)
    assert not (got & ~want).any() and (got & want).sum() >= 0.99 * want.sum()


def _brute_negatives(rows, is_anchor):
    width = defaultdict(int)
    whole = [(i, la, [int(np.floor(256 * float(c))) for c in v]) for i, la, v in rows if i is not None and la is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    for _, _, v in whole:
        width[len(v)] += 1
    wide = min((k for k in width), key=lambda k: (-width[k], k), default=0)
    whole = [r for r in whole if len(r[2]) == wide]
    anchors = {}
    for i, la, v in whole:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (la, v)), (la, v))
    out = []
    for q, (la, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, other) for i, other, w in whole if i != q)
        for s, p, other in [r for r in scored if r[2] == la][:5]:
            fits = [(n, i) for n, i, other in scored if other != la and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(q, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [10_000, 70])
def test_hard_negatives(spark, shard_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 20)).round(2)
    x[40:90] = x[40]  # ties
    x[90:140] = x[40] + 0.3 * rng.normal(size=(50, 20))
    rows = [(k, int(rng.integers(0, 4)), x[k].tolist()) for k in range(400)]
    rows += [rows[20], (20, 1, x[3].tolist()), rows[333], (None, 1, x[0].tolist()), (401, None, x[0].tolist()), (402, 1, None), (403, 1, [0.0] * 20), (404, 1, [float("nan")] * 20), (405, 1, [1.0, 2.0]), (406, 1, [None, *x[0].tolist()[1:]])]
    df = _frame(spark, rows)
    out = hard_negatives.hard_negatives(df, df.where("vec_id % 20 = 0"), shard_rows=shard_rows, anchor_rows=8 if shard_rows < 100 else 4096)
    got = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == _brute_negatives(rows, lambda i: i % 20 == 0) and len(got) > 100


def test_hard_negatives_few_and_none(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [0.5, 0.5]), (50, 3, [0.25, 1.0])]
    df = _frame(spark, rows)
    # The only positive of 0 lies behind it: no whole number fits its window.  50 has no positive.
    assert hard_negatives.hard_negatives(df, df.where("vec_id % 50 = 0")).collect() == []
    assert hard_negatives.hard_negatives(df.where("false"), df).collect() == []
    assert hard_negatives.hard_negatives(df, df.where("false")).collect() == []


def test_bounds_let_candidates_go():
    """Candidates leave the bitmap before all dimensions are read, and never one that counts."""
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (64, 5000))
    x[:8] *= 8  # dimensions that decide
    anchor = x[:, 7].copy()
    seen = []
    stays = hard_negatives.nearest_stay(5)
    at, score = hard_negatives.Scan(x).run(anchor, np.ones(5000, bool), lambda low, high: seen.append(len(low)) or stays(low, high))
    assert seen[1] < 5000 and seen[-1] < 500
    assert sorted(zip(-score, at))[:5] == sorted(zip(-(anchor @ x), range(5000)))[:5]


def _form(text, key, plain=10, spm=20):
    h = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain:
        return len(text), "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rng = random.Random(6)
    letters = "abcdefgh \n<>PSMéß中文𝔘́"
    passage = "".join(rng.choice(letters) for _ in range(5000))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["x" * 40_000, "中" * 30_000, "é" * 9 + passage, passage, passage + "<", "<", "<P", "P>", "<P>", "a<M>b", None, "", passage * 40]
    rows = [(k, t, "a", "b") for k, t in enumerate(texts)] + [(None, "no id", "a", "b"), (3, texts[3], "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, output string")
    got = fill_middle.fill_in_middle(docs)
    back = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored().alias("back")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in back), key=key) == sorted(((d, *_form(t or "", f"1:{'' if d is None else d}"), t or "") for d, t, *_ in rows), key=key)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0


def test_signs_across_chunks(monkeypatch):
    """With chunks of a byte or two, signs and code points that chunks cut through are still seen."""
    monkeypatch.setattr(fill_middle, "SHIFT", 1)
    monkeypatch.setattr(fill_middle, "WIDTH", 2)
    rng, memo = random.Random(1), fill_middle.Chunks(1000)
    for _ in range(400):
        text = "".join(rng.choice("<<PSM>>é中a") for _ in range(rng.randint(0, 12)))
        (ends,) = fill_middle.chunk_ends([text.encode()])
        n, form, a, b, output = fill_middle.transform(text.encode(), ends.tolist(), "k", memo, 0, 50)
        assert (n, form, a, b, output.decode()) == _form(text, "k", 0, 50)


def test_chunks_are_found_wherever_a_passage_stands():
    rng = random.Random(2)
    passage = bytes(rng.randrange(97, 123) for _ in range(60_000))
    cut = lambda text: {text[a:b] for a, b in zip([0, *ends], ends)} if (ends := fill_middle.chunk_ends([text])[0].tolist()) else set()
    one, other = cut(passage), cut(b"something else before: " * 7 + passage + b" and after")
    assert len(one) > 20 and len(one & other) >= len(one) - 2
    assert all(len(x) <= fill_middle.LONGEST for x in cut(b"a" * 50_000))
