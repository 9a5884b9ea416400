"""Pages to chunks by a priority list of separators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.constants import CHUNK_SIZE, MIN_LENGTH, OVERLAP, SEPARATORS
from foliant.functions.expr import strip
from foliant.operators.pages import with_chunk_id


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator, which stays at the start of the piece after it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces joined up to ``size`` characters, the next chunk beginning with what of the
    last fits into ``overlap``."""
    first, total = 0, 0
    for k, p in enumerate(pieces):
        if total + len(p) > size and k > first:
            yield "".join(pieces[first:k])
            while total > overlap or (total and total + len(p) > size):
                total -= len(pieces[first])
                first += 1
        total += len(p)
    if first < len(pieces):
        yield "".join(pieces[first:])


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: list[str] | None = None) -> list[str]:
    """Stripped chunks of a text.  The first separator that occurs cuts it; pieces below ``size`` are
    packed, longer ones are cut again by the separators after that, or stand as they are when none is
    left."""
    separators = SEPARATORS if separators is None else separators
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    left, out, short = separators[at + 1 :], [], []
    for p in [*_pieces(text, separators[at]), None]:
        if p is not None and len(p) < size:
            short.append(p)
            continue
        out += [c for x in _pack(short, size, overlap) if (c := x.strip())]
        short = []
        if p is not None:
            out += split_text(p, size, overlap, left) if left else [p]
    return out


def chunk_pages(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = MIN_LENGTH, separators: list[str] | None = None) -> DataFrame:
    """Chunks of every page: the page's columns with ``chunk_no`` (from 1 on each page, counted before
    short chunks are left out), ``chunk_id`` and the stripped ``text``.  No shuffle: a page is cut
    where it lies.  Null texts give no chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [split_text(x, size, overlap, separators) if x else [] for x in b.column("text").to_pylist()]
            yield pa.record_batch({"row": b.column("row"), "parts": pa.array(cut, pa.list_(pa.string()))})

    others = [c for c in pages.columns if c not in ("text", "chunk_no", "chunk_id")]
    packed = pages.select(F.struct(*others).alias("row"), "text")
    cut = packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}, parts array<string>")
    rows = cut.select("row.*", F.posexplode("parts").alias("_at", "_part"))
    kept = rows.select(*others, (F.col("_at") + 1).alias("chunk_no"), strip("_part").alias("text")).where(F.length("text") >= least)
    return with_chunk_id(kept)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """``doc_name, n_chunks``, and the total under a null name."""
    return chunks.rollup("doc_name").agg(F.count("*").alias("n_chunks"))
