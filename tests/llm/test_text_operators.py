"""Token counts, SentencePiece, line dedup, quality rules and private data against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import line_dedup, private_data, quality_rules, sentence_pieces, token_counts
from foliant.llm.common import scratch

P = pytest.importorskip("public_tokenizers")
BITS = ["a", "The", "house", " ", "  ", "\n", "\t", "▁", "é", "漢", "😀", "<s>", "</s>", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", ",", ".", "\x00", "\x1c", "　", "é", "Σ", "don't", "123", "\r\n", "\xa0", "\x85", "<0x41>", "İ", "!!", "ſ"]


def _texts(n, seed=1, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["x" * 3000, " ".join(["word"] * 5000), "é" * 200]


def _docs(spark, texts):
    """With an extra column that clashes with inner names, a null text and a null doc_id."""
    rows = [(k, t, k, "b") for k, t in enumerate(texts)] + [(len(texts), None, 0, "b"), (None, "text of no document", 0, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, block long, words string")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path, cache = P.path("word_bpe_49k.json"), scratch(spark, "cache")
    texts = _texts(400) + ["same text"] * 3 + [" same \n text "]
    docs = _docs(spark, texts)
    out = token_counts.count_tokens(docs, path, cache, limit=20)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()}
    t = Tokenizer.from_file(path)
    for k, x in enumerate(texts):
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert got[k] == (len(x.encode()), n, n > 20), repr(x)
    assert got[len(texts)] == (0, 0, False) and None in got
    held = spark.read.parquet(cache)
    n = held.count()
    assert n == held.select("digest").distinct().count() < len(texts)
    again = token_counts.count_tokens(_docs(spark, texts + ["one more"]), path, cache, limit=20)
    assert again.count() == len(texts) + 3
    assert spark.read.parquet(cache).count() == n + 1  # only the new text was encoded
    empty = token_counts.count_tokens(docs.where("false"), path, cache)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0


def test_token_counts_of_other_tokenizers(spark):
    """A tokenizer that keeps white space gets whole texts, and texts that differ in it are not one."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    assert token_counts.drops_space(P.path("word_bpe_49k.json")) and not token_counts.drops_space(path)
    texts = ["two words", "two  words", " two words\n\n", "Two Words", "", "x" * 3000, *_texts(60, 3)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(_docs(spark, texts), path, scratch(spark, "cache")).collect()}
    t = Tokenizer.from_file(path)
    assert [got[k] for k in range(len(texts))] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_token_counts_find_earlier_texts(spark):
    path, cache = P.path("word_bpe_49k.json"), scratch(spark, "cache")
    token_counts.add_counts(_docs(spark, ["a text", "another"]), path, cache)
    poisoned = spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long"))
    poisoned.write.parquet(cache + "-held")
    docs = _docs(spark, ["a text", "A text", "new"])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path, cache + "-held").collect()}
    assert got[0] == 77 and got[1] == 2 and got[2] == 1  # what is held is not encoded again


def test_sentence_pieces(spark):
    path = P.path("piece_bpe_32k.model")
    texts = _texts(500, 2)
    got = {r.doc_id: r for r in sentence_pieces.round_trip(_docs(spark, texts), path, with_ids=True).collect()}
    lib = sentence_pieces.vocabulary(path).lib
    for k, x in enumerate(texts):
        ids = lib.encode(x, add_eos=True)
        assert got[k].ids == ids, repr(x)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert all(r.agrees for r in got.values())
    assert got[len(texts)].ids == [lib.eos_id()]
    assert sentence_pieces.round_trip(_docs(spark, texts).where("false"), path).count() == 0


def test_agenda_of_one_chunk_equals_that_of_many():
    v = sentence_pieces.vocabulary(P.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    chunks = list({"▁" + "".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 30))) for _ in range(500)})
    assert v.merge_all(chunks) == {c: v.merge(c) for c in chunks}


def _lines_brute(texts, least=10):
    keys, owner = {}, {}
    for d, x in texts.items():
        keys[d] = [y.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)}) for y in (x or "").split("\n")]
        for k in set(keys[d]):
            if len(k) >= least:
                owner.setdefault(k, []).append(d)
    out = {}
    for d, x in texts.items():
        stay = [len(k) < least or len(owner[k]) < 2 or min(owner[k]) == d for k in keys[d]]
        out[d] = ("\n".join(y for y, s in zip((x or "").split("\n"), stay) if s), len(stay), stay.count(False))
    return out


@pytest.mark.parametrize("block", [1000, 7])
def test_line_dedup(spark, block):
    rng = random.Random(4)
    pool = ["A common line of text", "  a COMMON line of text\t", "short", "", "ÀÉ line ten", "àé line ten", "nine chr.", "another shared line", "　wide spaces here　", "漢字漢字漢字漢字漢字"]
    texts = {k: "\n".join(rng.choice([*pool, f"own line number {k} {rng.random()}"]) for _ in range(rng.randint(0, 9))) for k in range(60)}
    texts |= {100: None, 101: "", 102: texts[5], 103: "the hot line of all\n" * 2}
    texts |= {k: "the hot line of all" for k in range(200, 260)}
    docs = spark.createDataFrame([(d, x, "q", "y") for d, x in texts.items()] + [(None, "A common line of text", "q", "y")], "doc_id long, text string, n_lines string, block string")
    out = line_dedup.dedup_lines(docs.repartition(5), block_docs=block, block_bytes=500 if block == 7 else 1 << 20, shard_lines=10 if block == 7 else 1 << 17).collect()
    want = _lines_brute(texts)
    got = {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in out}
    assert got.pop(None) == ("A common line of text", 1, 0)
    assert got == want
    assert {r.block for r in out} == {"y"}


def test_line_dedup_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "a line of some length"), (1, "a line of some length")], schema)
    assert [r.n_dropped for r in line_dedup.dedup_lines(twice).collect()] == [0, 0]
    shared = "a line of some length"
    rows = [(None, shared + "\n"), (None, None), (4, shared), (4, "other text of four\n" + shared), (9, shared), (9, "\n".join([shared] * 50_000 + ["long"]))]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, (r.text or "")[:30]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(None, 2, 0, shared + "\n"), (None, 1, 0, ""), (4, 1, 0, shared), (4, 2, 0, "other text of four\na line of s"), (9, 1, 1, ""), (9, 50_001, 50_000, "long")], key=repr)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    a[:2500] = a[0]  # equal halves are told apart by the others
    levels = line_dedup.build_hash(a, b)
    assert sorted(line_dedup.index_of(levels, a, b)) == list(range(5000))
    assert sum(map(len, levels)) < 6 * 5000
    assert line_dedup.build_hash(a[:0], b[:0]) == []


def _statistics_brute(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab", "c", " ", " ", "\n", "#", "|", "é", "\t", "　", "😀", "x y z "]) for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["a b c " * 4000, "", " \n "]
    docs = _docs(spark, texts)
    got = {r.doc_id: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.text_statistics(docs).collect()}
    assert got[len(texts)] == (0, 0, 0, 0, 0)
    for k, x in enumerate(texts):
        assert got[k] == _statistics_brute(x), repr(x)


def test_rules_are_learned_and_emitted(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "ero", "ilin", "oma")]
    texts, marks = [], []
    for k in range(400):
        base = [rng.choice(words) for _ in range(80)]
        bad = k % 4
        if bad == 0:
            base = [w + "***" for w in base]
        elif bad == 1:
            base = [w.upper() + "!!" for w in base]
        texts.append(" ".join(base))
        marks.append(int(bad > 1))
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks) if k < 320], "doc_id long, quality int")
    out = quality_rules.judge(docs, labels).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert len(out) == len(texts) + 2 and not kept[len(texts)] and {r.words for r in out} == {"b"}
    assert np.mean([kept[k] == bool(m) for k, m in enumerate(marks)][320:]) > 0.97
    none = quality_rules.judge(docs, labels.where("quality = 1")).collect()
    assert all(r.kept for r in none if r.doc_id is not None and r.doc_id < 400)
    assert quality_rules.judge(docs.where("false"), labels).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    v = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def _spans_brute(x):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, x or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(q) <= 255 for q in m[0].split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_private_base_spans(spark):
    rng = random.Random(8)
    bits = ["1", "2", "55", "192", "0255", ".", "..", "@", "a", "b.c", "-", " ", "+", "(", ")", "_", "%", "é", "😀", "4111 1111 1111 1111", "\n", "x@y.z", "+1 (555) 010-9999", "10.0.0.1", "6011000990139424"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["1" * 50_000, "a." * 30_000 + "@", "1 " * 20_000]
    got = private_data.base_spans(_docs(spark, texts)).select("doc_id", private_data._names(list(private_data.PATTERNS)).alias("s"))
    got = {r.doc_id: r.s for r in got.collect()}
    assert got[len(texts)] == ""
    for k, x in enumerate(texts):
        assert got[k] == _spans_brute(x), repr(x[:80])


def test_private_added_spans(spark):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f'some words token = "{hexa(40)}" and more' for _ in range(60)] + [f"words password={hexa(18)} more" for _ in range(60)] + [f"order number/{rng.randint(10**12, 10**13)} here" for _ in range(60)] + ["plain words only"] * 40
    out = private_data.private_spans(_docs(spark, texts)).collect()
    n = {r.doc_id: len(r.secret) for r in out}
    assert np.mean([n[k] == 1 for k in range(120)]) > 0.95
    assert sum(n[k] for k in range(120, 220)) == 0
    more = texts + ['the password: "tr0ub-4dor&3", then words', "pin 48213 for it", "the key is here and the token economy", "session=abc-123-def-456-ghi"] * 12
    for r in private_data.private_spans(_docs(spark, more)).where("doc_id >= 220").collect():
        found = [s.text for s in r.secret]
        if r.doc_id < len(more):
            assert [s.start for s in r.secret] == sorted(s.start for s in r.secret) and all(more[r.doc_id][s.start : s.end] == s.text for s in r.secret)
            assert found in ([["tr0ub-4dor&3"]] if r.doc_id % 4 == 0 else [["48213"], []] if r.doc_id % 4 == 1 else [[]] if r.doc_id % 4 == 2 else [["abc-123-def-456-ghi"]])
    one = next(r for r in out if r.doc_id == 0).secret[0]
    assert texts[0][one.start : one.end] == one.text
    assert private_data.private_spans(_docs(spark, ["no candidates"])).select(F.sum(F.size("secret"))).first()[0] == 0
    assert private_data.private_spans(_docs(spark, texts).where("false")).count() == 0
