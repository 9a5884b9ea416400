"""The training-corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents.  Columns of any name pass through all but the last; an empty table
gives an empty one; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import SPACES, documents, table
from foliant.llm.line_dedup import dedup_lines
from foliant.llm.mixing import TARGETS, copies, language_labels, mix
from foliant.llm.near_dup import near_duplicates
from foliant.llm.quality_rules import COUNTED, judge
from foliant.llm.sentence_pieces import round_trip


def _aside(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the columns whose names a stage needs for its own renamed, and how to get the
    columns of ``docs`` back."""
    free = "_own"
    while any(c.lower().startswith(f"{free}_") for c in docs.columns):
        free += "_"
    names = {c: f"{free}_{c}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go, nulls and empty texts among them (no
    words).  Repeated rows are judged alike; without labels the base rules alone decide."""
    inner, back = _aside(docs, [*COUNTED, "base_failed", "kept"])
    return judge(inner, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of shared lines go, and with them documents of which no word is left: all they held stands
    in a smaller doc_id.  ``n_chars`` follows the text.  Nulls and documents without a word before stay
    as they are, as do rows with a null doc_id."""
    inner, back = _aside(docs, ["n_lines", "n_dropped"])
    out = dedup_lines(inner).where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(SPACES))) > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*back)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the smallest doc_id stays, with all its
    rows.  Nulls, documents without words and rows with a null doc_id are in no group."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains below their target weight are repeated as their rates ask; no rate is
    below 1 but for the fit's tolerance, and no document goes, nulls and empty texts (no tokens) included."""
    inner, back = _aside(docs, ["n_tokens", "posterior", "domain", "rate", "n_copies"])
    times = F.greatest(F.lit(1), copies(F.col("rate"), F.col("doc_id")))
    rated = mix(inner, language_labels(spark, sf_dir), TARGETS).withColumn("n_copies", times)
    return rated.select(*inner.columns, F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("n_copies")).select(*back)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digests that show the round trip.  Nulls and empty texts have the end id alone."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dup", near_dup),
    ("mixing", mixing),
    ("sentence_pieces", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned rules, rates and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
