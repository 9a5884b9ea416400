"""Answers of models that survive a restart: requests by digest, an append-only table, misses asked once.

The table has ``digest, version, response, error``.  A request whose digest has a response under the same version
is never sent again, by this run or a later one.  What is missing is made distinct, dealt to tasks of one
batch each, and a task's answers become part of the table when that task ends, not when the job does; a
run that is killed loses the batches that were under way.  A batch that fails is tried again after a
wait that doubles; if all tries fail its requests are put down with the error, have no response, and are asked again by the next run.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.constants import MODEL_BATCH
from foliant.functions.expr import strip
from foliant.functions.store import exists

STORE = "digest binary, version string, response string, error string"


def request_digest(request: Column | str = "request") -> Column:
    return F.unhex(F.sha2(F.col(request).cast("binary") if isinstance(request, str) else request.cast("binary"), 256))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All that was ever put down; empty where nothing was."""
    return spark.read.schema(STORE).parquet(path) if exists(spark, path) else spark.createDataFrame([], STORE)


def answers(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``digest, response``: one row a request that has an answer.  Where two runs asked the same, the
    smaller response counts, whichever came first."""
    held = read_store(spark, path).where((F.col("version") == version) & F.col("response").isNotNull())
    return held.groupBy("digest").agg(F.min("response").alias("response"))


def _patient(model: Callable[[list[str]], list], asked: list[str], tries: int, wait: float, most_wait: float) -> tuple[list, str | None]:
    """The answers, or the error of the last try."""
    for k in range(tries):
        try:
            out = model(asked)
            if len(out) != len(asked):
                raise ValueError(f"the model gave {len(out)} answers to {len(asked)} requests")
            return list(out), None
        except Exception as e:  # whatever a caller's function raises
            error = f"{type(e).__name__}: {e}"[:2000]
            if k + 1 < tries:
                # Not all tasks at once again.
                time.sleep(min(most_wait, wait * 2**k) * (0.5 + random.random() / 2))
    return [None] * len(asked), error


def ask_missing(rows: DataFrame, model: Callable[[list[str]], list[str]], path: str, version: str = "1", request: str = "request", batch: int = MODEL_BATCH, tries: int = 4, wait: float = 1.0, most_wait: float = 60.0) -> int:
    """Send the distinct requests that have no answer yet; returns how many there were.  Blank and null ones are not sent."""
    spark = rows.sparkSession
    live = rows.select(F.col(request).cast("string").alias("request")).where(strip(F.coalesce("request", F.lit(""))) != "")
    keyed = live.select(request_digest().alias("digest"), "request")
    # Found missing by digest, before a text is shuffled twice.
    missing = keyed.select("digest").distinct().join(answers(spark, path, version), "digest", "left_anti")
    n = missing.count()
    if not n:
        return 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                got, error = _patient(model, b.column("request").to_pylist(), tries, wait, most_wait)
                lost = [error if x is None else None for x in got]
                yield pa.record_batch({"digest": b.column("digest"), "response": pa.array(got, pa.string()), "error": pa.array(lost, pa.string())})

    distinct = keyed.join(missing, "digest", "left_semi").groupBy("digest").agg(F.min("request").alias("request"))
    dealt = distinct.repartition(-(-n // batch), "digest")
    found = dealt.mapInArrow(work, "digest binary, response string, error string")
    out = found.select("digest", F.lit(version).alias("version"), "response", "error").where("response is not null or error is not null")
    # With this committer a task's file is in its place when the task ends.
    out.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return n


def ask(rows: DataFrame, model: Callable[[list[str]], list[str]], path: str, version: str = "1", request: str = "request", response: str = "response", **how) -> DataFrame:
    """Rows with the model's answers, from the table at ``path``, which gains those it lacks.  Blank and null requests
    and those that failed answer null.  ``version`` names the model, so that another one's answers
    are not taken for its own."""
    ask_missing(rows, model, path, version, request, **how)
    held = answers(rows.sparkSession, path, version).withColumnsRenamed({"digest": "_digest", "response": "_response"})
    met = rows.withColumn("_asked", request_digest(request)).join(held, F.col("_asked") == F.col("_digest"), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns if c != response], F.col("_response").alias(response))


def failures(spark: SparkSession, path: str, version: str = "1") -> DataFrame:
    """``digest, error`` of requests without an answer, and how often (``n``) they failed."""
    lost = read_store(spark, path).where((F.col("version") == version) & F.col("error").isNotNull())
    return lost.groupBy("digest").agg(F.max("error").alias("error"), F.count("*").alias("n")).join(answers(spark, path, version), "digest", "left_anti")
