"""Documents to pages by markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.constants import MARK_CLOSE, MARK_OPEN, UNNAMED_PAGE
from foliant.functions.expr import SPACE, strip

MARK = f"{MARK_OPEN}{SPACE}*[^{MARK_CLOSE}]+{SPACE}*{MARK_CLOSE}"
LABEL = f"{MARK_OPEN}{SPACE}*([^{MARK_CLOSE}]+?){SPACE}*{MARK_CLOSE}"


def split_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a page that has text: ``page_ord`` (order in the document), ``page_number`` (null where
    the label is no whole number), ``page_label`` and the stripped ``text``.

    Without a marker the document is page 1; text before the first marker is page 0; every marker owns
    the text up to the next.  A marker with nothing but white space has the unnamed label; two signs
    with nothing between are no marker.  Labels with underscores, full-width digits or more than 32
    bits stay labels.  Null texts give no page."""
    others = [c for c in docs.columns if c not in (text, "page_ord", "page_number", "page_label")]
    parts = docs.where(F.col(text).isNotNull()).select(*others, F.split(text, MARK, -1).alias("_parts"), F.regexp_extract_all(text, F.lit(LABEL), F.lit(1)).alias("_labels"))
    zipped = F.arrays_zip("_parts", F.concat(F.array(F.lit(None).cast("string")), "_labels"))
    rows = parts.select(*others, (F.size("_labels") > 0).alias("_marked"), F.posexplode(zipped.cast("array<struct<part:string,label:string>>")).alias("page_ord", "_page"))
    label = strip("_page.label")
    label = F.when(F.col("_page.label").isNull(), F.when(F.col("_marked"), "0").otherwise("1")).when(label == "", UNNAMED_PAGE).otherwise(label)
    out = rows.select(*others, "page_ord", label.alias("page_label"), strip("_page.part").alias(text))
    return out.where(F.col(text) != "").select(*others, "page_ord", F.expr("try_cast(page_label as int)").alias("page_number"), "page_label", text)


def with_chunk_id(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` from document, page and the number of the chunk on its page."""
    shown = F.coalesce(F.col("page_number").cast("string"), F.col("page_label"))
    return chunks.withColumn("chunk_id", F.concat("doc_name", F.lit("_p"), F.translate(shown, " /\\", "___"), F.lit("_c"), F.col("chunk_no").cast("string")))
