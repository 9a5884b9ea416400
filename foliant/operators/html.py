"""Chapters and books: HTML to marked text, chapters to documents, the conversion report."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.constants import MARK_CLOSE, MARK_OPEN
from foliant.functions.expr import ordered_join
from foliant.operators.markup import read_chapter


def read_chapters(chapters: DataFrame, html: str = "html", keep: list[str] | None = None, bare: bool = True) -> DataFrame:
    """The columns ``keep`` (by default all) with ``title`` and ``lines``: the text of the first heading of the highest level there
    is (null without headings or HTML), and that of every paragraph outside of it, both stripped.  Elements are closed as HTML has it:
    an unclosed paragraph ends where the next paragraph or block begins or the element around it ends.  Without ``bare``, character
    references that lack their semicolon (a text that was cut within one) stay as they stand."""
    names = [c for c in chapters.columns if c not in ("title", "lines")] if keep is None else keep

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                found = [(None, None) if x is None else read_chapter(x, bare) for x in b.column("html").to_pylist()]
                yield pa.record_batch({"row": b.column("row"), "title": pa.array([t for t, _ in found], pa.string()), "lines": pa.array([x for _, x in found], pa.list_(pa.string()))})

    packed = chapters.select(F.struct(F.lit(0).alias("_"), *names).alias("row"), F.col(html).cast("string").alias("html"))
    out = packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}, title string, lines array<string>")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "title", "lines")


def chapters_to_text(chapters: DataFrame, html: str = "html", keep: list[str] | None = None, bare: bool = True) -> DataFrame:
    """Rows with a title, with ``title`` and ``text``: the marked title, a blank line and every paragraph
    on a line of its own.  Chapters whose title is missing or blank are dropped; null HTML counts as
    missing."""
    names = [c for c in chapters.columns if c not in ("title", "text")] if keep is None else keep
    out = read_chapters(chapters, html, names, bare).where("title <> ''")
    lines = F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), "")
    return out.select(*names, "title", F.concat(F.lit(MARK_OPEN), "title", F.lit(MARK_CLOSE + "\n\n"), lines).alias("text"))


def assemble_books(chapters: DataFrame) -> DataFrame:
    """``doc_name, text``: chapter texts of a document joined in item order.  One string a book; where
    only chunks are wanted, chapters can be split and chunked without this shuffle."""
    return chapters.groupBy("doc_name").agg(ordered_join(F.col("item_no"), "text", "").alias("text"))


def conversion_report(inputs: DataFrame, books: DataFrame) -> DataFrame:
    """``doc_name, status``: converted, or failed where no text came out."""
    done = books.where("text <> ''").select("doc_name", F.lit(True).alias("_done"))
    return inputs.select("doc_name").distinct().join(done, "doc_name", "left").select("doc_name", F.when(F.col("_done"), "converted").otherwise("failed").alias("status"))
