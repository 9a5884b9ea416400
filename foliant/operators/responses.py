"""Parsing of model responses, retries, and merging results back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.constants import ANNOTATION_ATTEMPTS, REPAIR_ATTEMPTS
from foliant.functions.expr import strip

ANNOTATION = "struct<is_meaningful:boolean,reason_if_not_meaningful:string,keyword_summaries:array<string>,generated_questions:array<string>>"
FIELDS = ["is_meaningful", "reason_if_not_meaningful", "keyword_summaries", "generated_questions"]


def _unfenced(c: Column) -> Column:
    """Without a json fence, if the content starts with one."""
    c = strip(c)
    return F.when(F.startswith(c, F.lit("```json")), strip(F.regexp_replace(F.substr(c, F.lit(8)), r"```$", ""))).otherwise(c)


def parse_refinement(rows: DataFrame, response: str = "response", field: str = "optimized_chunk_B_text") -> DataFrame:
    """``status`` and ``refined_text``: success; empty_content for a null or blank response; missing_key
    where the JSON has no such string; json_decode_error where it is no JSON."""
    body = _unfenced(F.col(response))
    parsed = rows.withColumn("_v", F.try_parse_json(body)).withColumn("_b", body)
    kind = F.expr(f"schema_of_variant(try_variant_get(_v, '$.{field}', 'variant'))")
    value = F.when(kind == "STRING", F.expr(f"try_variant_get(_v, '$.{field}', 'string')"))
    status = F.when(F.coalesce(F.col("_b"), F.lit("")) == "", "empty_content").when(F.col("_v").isNull(), "json_decode_error").when(value.isNull(), "missing_key").otherwise("success")
    return parsed.withColumn("status", status).withColumn("refined_text", F.when(status == "success", strip(value))).drop("_v", "_b")


def resolve_attempts(attempts: DataFrame, key: str = "chunk_id", most: int = REPAIR_ATTEMPTS) -> DataFrame:
    """One row a chunk: the first attempt that is no json_decode_error (only that is retried), else the
    last of the ``most`` attempts allowed.  Columns: key, attempt, status, refined_text."""
    rows = attempts.where(F.col("attempt") <= most)
    w = Window.partitionBy(key).orderBy((F.col("status") == "json_decode_error").cast("int"), F.when(F.col("status") == "json_decode_error", -F.col("attempt")).otherwise(F.col("attempt")))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "attempt", "status", "refined_text")


def apply_refinements(chunks: DataFrame, resolved: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with the repaired text where an attempt succeeded; every row stays."""
    good = resolved.where("status = 'success'").groupBy(key).agg(F.first("refined_text").alias("_refined"))
    out = chunks.join(good, key, "left")
    return out.withColumn("text", F.coalesce("_refined", "text")).select(*chunks.columns)


def parse_annotations(rows: DataFrame, response: str = "response") -> DataFrame:
    """``valid`` and the struct ``annotation``: a JSON object with all four fields, no fence allowed."""
    parsed = rows.withColumn("_v", F.try_parse_json(F.col(response)))
    there = [F.expr(f"try_variant_get(_v, '$.{f}', 'variant')").isNotNull() for f in FIELDS]
    valid = F.coalesce(there[0] & there[1] & there[2] & there[3], F.lit(False))
    return parsed.withColumn("valid", valid).withColumn("annotation", F.when(valid, F.from_json(response, ANNOTATION))).drop("_v")


def first_valid(attempts: DataFrame, key: str = "chunk_id", most: int = ANNOTATION_ATTEMPTS) -> DataFrame:
    """``key, annotation``: the first valid of the attempts allowed, null where none is; every kind of
    failure is retried."""
    good = F.when(F.col("valid"), F.col("attempt"))
    return attempts.where(F.col("attempt") <= most).groupBy(key).agg(F.min_by("annotation", good).alias("annotation"))


def annotate_chunks(chunks: DataFrame, annotations: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Meaningful chunks with their lists; failed, blank and not meaningful ones are dropped."""
    out = chunks.where(strip(F.coalesce("text", F.lit(""))) != "").join(annotations.where("annotation.is_meaningful"), key)
    lists = [F.coalesce(F.col(f"annotation.{f}"), F.array().cast("array<string>")).alias(f) for f in FIELDS[2:]]
    return out.select(*[c for c in chunks.columns if c not in (*FIELDS,)], *lists, F.lit(True).alias("is_meaningful"))


def annotation_stats(chunks: DataFrame, annotations: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: calls, success, meaningful, not_meaningful, failed and success_rate.  A blank chunk is
    answered without a call and counts as a success that is not meaningful."""
    rows = chunks.select(key, (strip(F.coalesce("text", F.lit(""))) == "").alias("_blank")).join(annotations, key, "left")
    done = F.col("_blank") | F.col("annotation").isNotNull()
    meaningful = ~F.col("_blank") & F.coalesce(F.col("annotation.is_meaningful"), F.lit(False))
    got = rows.agg(F.count("*").alias("calls"), F.count_if(done).alias("success"), F.count_if(meaningful).alias("meaningful"), F.count_if(done & ~meaningful).alias("not_meaningful"), F.count_if(~done).alias("failed"))
    return got.withColumn("success_rate", F.round(F.col("success") / F.greatest("calls", F.lit(1)), 6))
