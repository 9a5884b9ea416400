"""Text, EPUB and JSON sources; Parquet index tables."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from foliant.functions.expr import strip
from foliant.functions.store import exists

CHUNK = StructType([StructField(c, t) for c, t in (("doc_name", StringType()), ("page_number", StringType()), ("chunk_id", StringType()), ("text", StringType()))])
ENRICHED = StructType([*CHUNK.fields, StructField("keyword_summaries", ArrayType(StringType())), StructField("generated_questions", ArrayType(StringType())), StructField("is_meaningful", BooleanType())])
INDEX_TABLES = ["chunks", "vectors", "postings", "phrases", "questions"]


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name, text`` of every ``*.txt`` file of a folder (not of folders in it).  Blank files and
    files that are not UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").load(path)
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("_name"), "content").where("is_valid_utf8(cast(content as string))")
    named = rows.select(F.url_decode(F.replace(F.col("_name"), F.lit("+"), F.lit("%2B"))).alias("doc_name"), F.decode("content", "utf-8").alias("text"))
    return named.where(strip("text") != "")


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name`` of the text files that are not UTF-8."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return raw.where("not is_valid_utf8(cast(content as string))").select(F.element_at(F.split("path", "/"), -1).alias("doc_name"))


def _epub_items(data: bytes) -> list[str]:
    """The HTML documents of an EPUB in the order of its manifest."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        root = next(x.attrib["full-path"] for x in box.iter() if x.tag.endswith("rootfile"))
        book = ElementTree.fromstring(z.read(root))
        kinds = ("application/xhtml+xml", "text/html")
        items = [x.attrib["href"] for x in book.iter() if x.tag.endswith("}item") and x.attrib.get("media-type") in kinds and "nav" not in x.attrib.get("properties", "").split()]
        return [z.read(posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(h)))).decode("utf-8", "replace") for h in items]


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name, item_no, html``: one row a document item of every EPUB of a folder; a file that is no
    EPUB gives one row without HTML, so that the conversion report can name it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, numbers, bodies = [], [], []
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    items: list[str | None] = list(_epub_items(data))
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    items = [None]
                for k, html in enumerate(items):
                    names.append(unquote(p.rpartition("/")[2]))
                    numbers.append(k)
                    bodies.append(html)
            yield pa.record_batch({"doc_name": pa.array(names, pa.string()), "item_no": pa.array(numbers, pa.int64()), "html": pa.array(bodies, pa.string())})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path)
    return raw.select("path", "content").mapInArrow(work, "doc_name string, item_no long, html string")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_text(html: str) -> str:
    """The text of a piece of HTML with every entity decoded."""
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.parts)


def read_chunks(spark: SparkSession, path: str, enriched: bool = False) -> DataFrame:
    """Chunks of files that hold a JSON array each, or of what ``write_chunks`` wrote as JSON, a chunk a
    line.  ``page_number`` may be a number or a label there; it comes back as ``page_number int`` (null
    for labels) and ``page_label``."""
    whole = not exists(spark, f"{path.rstrip('/')}/_SUCCESS")
    rows = spark.read.schema(ENRICHED if enriched else CHUNK).option("multiLine", str(whole).lower()).json(path)
    return rows.withColumnRenamed("page_number", "page_label").withColumn("page_number", F.expr("try_cast(page_label as int)").cast(IntegerType()))


def write_chunks(chunks: DataFrame, path: str, form: str = "json") -> None:
    """Replaces what is there; the job's commit makes the new files visible together."""
    chunks.write.mode("overwrite").format(form).save(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table each; postings are laid out by term, so that a search reads few row groups."""
    for name, df in tables.items():
        df = df.repartitionByRange("term").sortWithinPartitions("term") if name == "postings" else df
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def missing_tables(spark: SparkSession, path: str, names: list[str] = INDEX_TABLES) -> list[str]:
    return [n for n in names if not exists(spark, f"{path.rstrip('/')}/{n}/_SUCCESS")]


def read_index(spark: SparkSession, path: str, names: list[str] = INDEX_TABLES) -> dict[str, DataFrame]:
    """The tables by name; FileNotFoundError lists every one that is missing."""
    if gone := missing_tables(spark, path, names):
        raise FileNotFoundError(f"index at {path} lacks: {', '.join(gone)}")
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
