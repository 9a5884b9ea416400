"""What the training-data operators share: input columns, shared scratch tables, worker memos."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.store import scratch, table  # noqa: F401

#: ASCII white space, as a character list for btrim and as a regular-expression class.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hex_sha(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def by_size(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 1000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``rows`` rows and ``most`` bytes of text at most; a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).tolist()
        at, held = 0, 0
        for k, n in enumerate(size):
            if k > at and (k - at == rows or held + n > most):
                yield b.slice(at, k - at)
                at, held = k, 0
            held += n
        yield b.slice(at)


class Memo(dict):
    """A dict that a Python worker keeps between tasks; emptied when it would outgrow ``most`` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def room(self, more: int) -> None:
        if len(self) + more > self.most:
            self.clear()
