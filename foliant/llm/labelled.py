"""Bounded samples of labelled documents for the classifiers that are fitted in numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import text_of


def remainder(n: int, col: str = "doc_id"):
    """crc32 of the doc_id as text, modulo n; null where doc_id is null."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label``: at most ``rows`` labelled documents of either class, first in the
    order of a hash.  Only these (their number is the bound) are broadcast to the documents.  A doc_id
    that occurs with several texts has the least of them, so that there are no more texts than ids."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.where("label = 0").orderBy(*order).limit(rows).unionByName(known.where("label = 1").orderBy(*order).limit(rows))
    inner = docs.select(F.col("doc_id").cast("long"), text_of().cast("string").alias("text"))
    return inner.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
