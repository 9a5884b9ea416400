"""Answers that survive a killed run, failures and repeated requests; counters of calls show what was sent."""

import os
import time
import uuid

from pyspark.sql import functions as F

from foliant.operators import answers
from foliant.plans import jobs


def _model(folder, broken=""):
    """A model that notes every request that it answers, and fails where a request holds ``broken``."""

    def call(asked):
        if broken and any(broken in x for x in asked):
            with open(os.path.join(folder, f"fail-{uuid.uuid4().hex}"), "w"):
                pass
            raise RuntimeError("out of order")
        with open(os.path.join(folder, f"call-{uuid.uuid4().hex}"), "w") as f:
            f.write("\n".join(asked))
        return [x.upper() for x in asked]

    return call


def _sent(folder):
    return [line for n in os.listdir(folder) if n.startswith("call-") for line in open(os.path.join(folder, n)).read().split("\n")]


def test_distinct_misses_are_sent_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([(k, f"r{k % 7}", "x", "y") for k in range(100)] + [(100, None, "x", "y"), (101, " ", "x", "y"), (102, "", "x", "y")], "id int, request string, response string, digest string")
    call, store = _model(tmp_path / "calls"), str(tmp_path / "store")
    out = answers.ask(rows, call, store, batch=3)
    assert out.columns == ["id", "request", "digest", "response"]
    assert {r.id: r.response for r in out.collect()} == {k: f"R{k % 7}" for k in range(100)} | {100: None, 101: None, 102: None}
    assert sorted(_sent(tmp_path / "calls")) == [f"r{k}" for k in range(7)]
    more = rows.unionByName(rows.limit(1).withColumn("request", F.lit("new")))
    assert answers.ask_missing(more, call, store, batch=3) == 1
    assert answers.ask_missing(more, call, store) == 0
    assert answers.ask_missing(rows, call, store, version="another model") == 7
    assert answers.ask(rows.where("false"), call, str(tmp_path / "none")).count() == 0


def test_a_killed_run_repeats_no_answered_request(spark, tmp_path):
    """The job dies in one batch; what the other tasks answered is in the table and not asked again."""
    (tmp_path / "calls").mkdir()
    rows = spark.range(200).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request"))
    store, flag = str(tmp_path / "store"), tmp_path / "dies"
    flag.write_text("")
    good = _model(tmp_path / "calls")

    def dying(asked):
        if "r77" in asked and flag.exists():
            time.sleep(4)  # others get on meanwhile
            os._exit(1)  # the worker is gone, as if the machine were
        return good(asked)

    try:
        answers.ask_missing(rows, dying, store, batch=5)
        raise AssertionError("the job should have failed")
    except Exception as e:
        assert "should have failed" not in str(e)
    before = _sent(tmp_path / "calls")
    held = answers.read_store(spark, store).count()
    assert 0 < held <= len(before) and len(before) < 200
    kept = {bytes(r.digest) for r in answers.answers(spark, store, "1").collect()}
    flag.unlink()
    for p in (tmp_path / "calls").iterdir():
        p.unlink()
    out = answers.ask(rows, dying, store, batch=5)
    assert out.where("response = upper(request)").count() == 200
    import hashlib

    again = _sent(tmp_path / "calls")
    assert len(again) == len(set(again)) == 200 - held and not kept & {hashlib.sha256(x.encode()).digest() for x in again}


def test_failures_wait_and_are_asked_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([(f"r{k}",) for k in range(10)], "request string")
    store = str(tmp_path / "store")
    out = answers.ask(rows, _model(tmp_path / "calls", "r3"), store, batch=1, tries=3, wait=0.01)
    got = {r.request: r.response for r in out.collect()}
    assert got.pop("r3") is None and got == {f"r{k}": f"R{k}" for k in range(10) if k != 3}
    assert len([n for n in os.listdir(tmp_path / "calls") if n.startswith("fail-")]) == 3
    lost = answers.failures(spark, store).collect()
    assert [(r.error, r.n) for r in lost] == [("RuntimeError: out of order", 1)]
    out = answers.ask(rows, _model(tmp_path / "calls"), store, batch=1)
    assert out.where("response is null").count() == 0 and answers.failures(spark, store).count() == 0
    assert sorted(_sent(tmp_path / "calls")) == sorted(f"r{k}" for k in range(10))
    short = answers._patient(lambda asked: asked[1:], ["a", "b"], 2, 0.0, 0.0)
    assert short == ([None, None], "ValueError: the model gave 1 answers to 2 requests")


def test_a_repair_started_again_calls_nobody(spark, tmp_path):
    """Repairs under the same path: the second run takes every answer, of every attempt, from the table."""
    (tmp_path / "calls").mkdir()
    chunks = spark.createDataFrame([("d", 1, k, 1, f"text {k}") for k in range(6)], "doc_name string, page_number int, page_ord int, chunk_no int, text string")
    note = _model(tmp_path / "calls")

    def call(asked):
        note([x.replace("\n", " ") for x in asked])
        return ["{broken" if "B text 3" in x else '{"optimized_chunk_B_text": "fixed"}' for x in asked]

    run = lambda: sorted((r.page_ord, r.text) for r in jobs.repair(chunks, call, "A {text_a} B {text_b} C {text_c}", str(tmp_path / "run"), attempts=3).collect())
    first = run()
    assert first == [(0, "text 0"), (1, "fixed"), (2, "fixed"), (3, "text 3"), (4, "fixed"), (5, "text 5")]
    n = len(_sent(tmp_path / "calls"))
    assert n == 4 + 2
    assert run() == first and len(_sent(tmp_path / "calls")) == n
