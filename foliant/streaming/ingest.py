"""New text files to chunks as they arrive: the batch operators on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.functions.constants import CHUNK_SIZE, MIN_LENGTH, OVERLAP
from foliant.functions.expr import strip
from foliant.operators.chunking import chunk_pages
from foliant.operators.pages import split_pages


def stream_chunks(spark: SparkSession, path: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_LENGTH) -> DataFrame:
    """Chunks of every ``*.txt`` file that comes into a folder, each file once."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").load(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    docs = raw.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("doc_name"), F.col("value").alias("text")).where(strip("text") != "")
    return chunk_pages(split_pages(docs), size, overlap, least)


def write_stream(chunks: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append chunks to a Parquet table; ``once`` takes what is there and ends."""
    out = chunks.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
