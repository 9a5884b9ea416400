"""The registered queries and the pipeline on the smallest tables."""

import glob
import hashlib
import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from foliant.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

COLUMNS = {
    "op1": ["query_id", "rank", "vec_id", "score"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op4": ["doc_id", "held_out", "score", "predicted"],
    "op5": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op6": ["doc_id", "rate"],
    "op7": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op9": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10": ["doc_id", "n_shingles", "component_id", "kept"],
    "op11": ["vec_id", "n_links", "component_id", "kept"],
    "op12": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, DIR)
    assert set(COLUMNS[re.match(r"op\d+", name)[0]]) <= set(out.columns)
    n = out.count()
    if name.startswith("op12_"):
        assert 0 < n <= 10 * 5 * 3
    else:
        assert n == {"op1": 25 * 20, "op11": 500}.get(name.split("_")[0], spark.read.parquet(f"{DIR}/documents.parquet").count())
    assert entry.queries()[name] is QUERIES[name]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DIR).toPandas()[list(want.columns)]
    value = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, (float, int)) else str(v)
    show = lambda df: sorted(tuple(map(value, r)) for r in df.astype(object).itertuples(index=False, name=None))
    assert show(got) == show(want)


def test_pipeline(spark):
    import corpus_pipeline as cp
    from foliant.llm.common import documents, table

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dup", "mixing", "sentence_pieces"]
    docs = documents(spark, DIR)
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        before = docs
        docs = table(stage(spark, docs, DIR), name)
        seen.append((before, docs))
        if name != "sentence_pieces":
            assert docs.columns == columns and docs.schema == before.schema
    texts = [{r.doc_id: r.text for r in b.collect()} for b, _ in seen]
    assert set(texts[1]) < set(texts[0]) and set(texts[2]) <= set(texts[1]) and set(texts[3]) <= set(texts[2]) and set(texts[4]) == set(texts[3])
    key = lambda y: y.strip(" \t\r\x0b\f").translate({c: c + 32 for c in range(65, 91)})
    first: dict[str, int] = {}
    for d, x in sorted(texts[1].items()):
        for y in x.split("\n"):
            first.setdefault(key(y), d)
    left = lambda d: [y for y in texts[1][d].split("\n") if key(y) and (len(key(y)) < 10 or first[key(y)] == d)]
    assert set(texts[1]) - set(texts[2]) == {d for d in texts[1] if not left(d)}  # emptied, and only these
    assert all(x.strip() for x in texts[2].values())
    lines: dict[str, int] = {}
    for d, x in sorted(texts[2].items()):
        for y in x.split("\n"):
            k = y.strip(" \t\r\x0b\f").translate({c: c + 32 for c in range(65, 91)})
            if len(k) >= 10:
                assert lines.setdefault(k, d) == d
    import sentencepiece
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in docs.collect():
        assert r.ids == lib.encode(texts[4][r.doc_id], add_eos=True)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(r.ids).encode()).hexdigest()
    run = entry.queries()["pipeline"](spark, DIR)
    assert sorted(map(str, run.select("doc_id", "ids_sha256").collect())) == sorted(map(str, docs.select("doc_id", "ids_sha256").collect()))


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing columns, an empty table."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(14)
    prose = lambda n: " ".join(rng.choice(["the", "and", "of", "it"]) if rng.random() < 0.3 else "".join(rng.choice("aeioumnrstl") for _ in range(rng.randint(3, 8))) for _ in range(n))
    one, other, long = prose(120), prose(120), prose(60_000)
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, one, "en", "s", 5), (3, one, "en", "s", 5), (4, long, "de", "s", 9), (None, other, "fr", "s", 7), (5, one, "en", "s", 5), (6, " \n ", "en", "s", 3)]
    docs = spark.createDataFrame([(*r, "k", "b", "c", "d") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, rate string, _own_kept string, _OWN__rate string")
    got = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        if name != "sentence_pieces":
            assert out.columns == docs.columns and out.schema == docs.schema
        got[name] = sorted((r.doc_id for r in out.collect()), key=str)
        if name != "near_dup":  # tested on an empty table elsewhere
            assert stage(spark, docs.where("false"), DIR).count() == 0
    everything = sorted((r[0] for r in rows), key=str)
    assert not {1, 2, 6} & set(got["quality_rules"])
    assert got["line_dedup"] == sorted([1, 2, 3, 3, 4, 6, None], key=str)  # 5 holds nothing of its own
    assert got["near_dup"] == sorted([1, 2, 3, 3, 4, 6, None], key=str)
    assert set(got["mixing"]) == set(everything)
    assert got["sentence_pieces"] == everything
