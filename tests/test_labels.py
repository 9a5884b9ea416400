"""Labels of several words, and running headers and footers, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliant.operators import index, rules


def test_phrase_labels(spark):
    texts = ["Near duplicate detection is near duplicate detection. Duplicate detection!", "near duplicate pages, and more", "the vector index of the vector index", "vector index; near duplicate detection", "", None, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    tf = Counter()
    for d, t in enumerate(texts):
        for run in re.split(r"[^\w ]+", (t or "").lower()):
            w = run.split()
            tf.update((d, " ".join(w[i : i + k])) for k in (2, 3) for i in range(len(w) - k + 1))
    f, docs = Counter(), Counter()
    for (_, p), n in tf.items():
        f[p] += n
        docs[p] += 1
    f = {p: n for p, n in f.items() if n >= 2}
    above = defaultdict(set)
    for p in f:
        w = p.split()
        if len(w) == 3:
            above[" ".join(w[:2])].add(p)
            above[" ".join(w[1:])].add(p)
    each = {p: math.log2(len(p.split()) + 1) * (n - (sum(f[b] for b in above[p]) / len(above[p]) if above[p] else 0)) / n * math.log(len(texts) / docs[p]) for p, n in f.items()}
    want = set()
    for d in range(len(texts)):
        best = sorted((-round(n * each[p], 9), p) for (x, p), n in tf.items() if x == d and each.get(p, 0) * n > 1e-9)[:5]
        want |= {(d, p, k, round(-w, 6)) for k, (w, p) in enumerate(best, 1)}
    got = {(r.chunk_id, r.phrase, r["rank"], round(r.weight, 6)) for r in rules.phrase_labels(df).collect()}
    assert got == want
    assert {p for d, p, k, _ in got if d == 0 and k == 1} == {"near duplicate detection"}
    assert rules.phrase_labels(df.where("false")).count() == 0


def test_running_heads_go_and_prose_stays(spark):
    pages = []
    for k in range(1, 13):
        body = f"Prose of page {k}.\nThe middle line of all pages\nMore prose {'x' * k}."
        pages.append(("book", k, f"A Title  \n{'Chapter %d' % (k // 4)}\n\n{body}\n- {k} -"))
    pages[4] = ("book", 5, "Prose first on this page.\nA Title\nmore")  # the title stands inside: it stays
    pages += [("other", k, f"line {'abc'[k]}\nsame end") for k in range(3)] + [("other", 9, None), (None, 1, "x\ny"), ("short", 1, "A Title"), ("heads", 1, "H 1"), ("heads", 2, "H 2"), ("heads", 3, "H 3")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "doc_name string, page_ord int, text string, line string")
    heads = {(r.doc_name, r.place, r.line) for r in rules.running_heads(df).collect()}
    assert {("book", 1, "A Title"), ("book", 2, "Chapter #"), ("book", -1, "- # -"), ("other", -1, "same end"), ("heads", 1, "H #"), ("heads", -1, "H #")} <= heads
    out = {(r.doc_name, r.page_ord): r.text for r in rules.drop_running_heads(df).collect()}
    assert rules.drop_running_heads(df).columns == df.columns and len(out) == len(pages)
    assert out["book", 1] == "Prose of page 1.\nThe middle line of all pages\nMore prose x."
    assert out["book", 5] == "Prose first on this page.\nA Title\nmore"
    assert out["other", 2] == "line c" and out["other", 9] is None and out[None, 1] == "x\ny" and out["short", 1] == "A Title"
    assert out["heads", 2] == ""


def test_phrases_that_stand_once_stay_where_they_are(spark, monkeypatch):
    """Bits of marks leave out what occurs too seldom and nothing else; numbers packed in parts are those of rows."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join([*(rng.choice(words) for _ in range(40)), rng.choice(["the vector index", "near duplicate pages", "é ü"]), "." if k % 2 else ""]) for k in range(200)]
    chunks = spark.createDataFrame([*enumerate([*texts, texts[0], None, "", "one"])], "chunk_id long, text string").repartition(3)
    labels = [tuple(r) for r in rules.phrase_labels(chunks).orderBy("chunk_id", "rank").collect()]
    rows = [tuple(r) for r in rules.phrase_candidates(chunks).collect()]
    total = Counter()
    for _, phrase, _, tf in rows:
        total[phrase] += tf
    for held in (64, 1 << 19):
        monkeypatch.setattr(rules, "HELD", held)
        monkeypatch.setattr(index, "HELD", held)
        for least in (2, 3):
            often = {x for x in rows if total[x[1]] >= least}
            bits = spark.sparkContext.broadcast(rules.repeated_marks(chunks, 3, least, 1 << 24))
            kept = {tuple(r) for r in rules.phrase_candidates(chunks, repeated=bits).collect()}
            assert often <= kept and len(kept - often) < 0.02 * len(rows) < len(rows) - len(often)
            weights = {tuple(r) for r in rules.phrase_weights(rules.phrase_candidates(chunks, repeated=bits, numbers=True), least).collect()}
            assert weights == {tuple(r) for r in rules.phrase_weights(rules.phrase_candidates(chunks), least).collect()} and len(weights) == len({x[1] for x in often})
        assert [tuple(r) for r in rules.phrase_labels(chunks).orderBy("chunk_id", "rank").collect()] == labels
    whole = rules.counted_phrases(chunks)
    facts = rules.phrase_weights(rules.phrase_candidates(chunks)).select(F.col("phrase").alias("term"), "df", F.col("c_value").alias("each"))
    best = lambda df: sorted(map(tuple, df.collect()))
    assert best(index.top_terms(whole, facts, 4, 0)) == best(index.top_terms(chunks.select("chunk_id", rules._runs().alias("runs")), facts, 4, 7, counter=rules.phrase_counter()))
