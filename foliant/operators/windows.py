"""Neighbouring chunks of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.store import table

MOST_RUNS = 20_000


def context_windows(chunks: DataFrame, order: list[str] | None = None, middle_only: bool = True, span: int = 50_000) -> DataFrame:
    """Chunks with ``text_a`` and ``text_c``, the texts before and after in reading order: numbered
    pages first, then the order of pages and chunks.  By default only chunks with both, which leaves
    out documents of fewer than three.

    The chunks of all documents are cut, in the whole order, into ranges of about ``span`` rows (MOST_RUNS ranges at most), by
    splitters that Spark takes from a sample.  A document's rows of one range are a run, sorted by itself, so that a long
    document or page is many tasks; the first and last rows of the runs that cut a document, two rows a run at most, are put beside
    each other and sent to the rows as the runs' outer neighbours."""
    order = order or ["page_number", "page_ord", "chunk_no"]
    ends = [F.col(c).asc_nulls_last() for c in order]
    runs = min(MOST_RUNS, max(1, -(-chunks.count() // span)))
    # Written, so that no later look at the rows cuts them elsewhere.
    rows = chunks.withColumn("_run", F.lit(0))
    if runs > 1:
        rows = table(chunks.repartitionByRange(runs, F.col("doc_name").asc_nulls_last(), *ends).withColumn("_run", F.spark_partition_id()), "runs")
    inner = Window.partitionBy("doc_name", "_run").orderBy(*ends)
    box = F.struct(F.col("text").alias("t"))
    near = rows.withColumns({"_a": F.lag(box).over(inner), "_c": F.lead(box).over(inner)})
    if runs == 1:
        out = near.select(*[c for c in chunks.columns if c not in ("text_a", "text_c")], F.col("_a.t").alias("text_a"), F.col("_c.t").alias("text_c"))
        return out.where("text_a is not null and text_c is not null") if middle_only else out
    place = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    # Of each cut between two runs at most one document lies on both sides: these are few, and their edges go to the rows.
    longer = rows.groupBy("doc_name").agg(F.min("_run").alias("_x"), F.max("_run").alias("_y")).where("_x < _y").select("doc_name")
    cut = rows.join(F.broadcast(longer), rows["doc_name"].eqNullSafe(longer["doc_name"]), "left_semi")
    edges = cut.groupBy("doc_name", "_run").agg(F.min_by(box, place).alias("_first"), F.max_by(box, place).alias("_last"))
    outer = Window.partitionBy("doc_name").orderBy("_run")
    edges = edges.select(F.col("doc_name").alias("_d"), F.col("_run").alias("_r"), F.lag("_last").over(outer).alias("_before"), F.lead("_first").over(outer).alias("_after"))
    met = near.join(F.broadcast(edges), near["doc_name"].eqNullSafe(edges["_d"]) & (near["_run"] == edges["_r"]), "left")
    out = met.select(*[near[c] for c in chunks.columns if c not in ("text_a", "text_c")], F.coalesce("_a", "_before")["t"].alias("text_a"), F.coalesce("_c", "_after")["t"].alias("text_c"))
    return out.where("text_a is not null and text_c is not null") if middle_only else out
