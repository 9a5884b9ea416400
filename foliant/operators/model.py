"""Requests to models and batched calls of user-supplied functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.constants import MODEL_BATCH


def fill_template(template: str, **fields: Column) -> Column:
    """The template with each ``{name}`` replaced; what a field holds is not filled again."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + n + "}"), n) for n in fields if "{" + n + "}" in rest), default=None)
        if at is None:
            break
        parts += [F.lit(rest[: at[0]]), F.coalesce(fields[at[1]].cast("string"), F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts, F.lit(rest)) if parts else F.lit(template)


def build_requests(rows: DataFrame, template: str, kind: str = "annotation", first: str = "N/A (start of the document)", last: str = "N/A (end of the document)") -> DataFrame:
    """``request`` for a repair (fields text_a, text_b, text_c; ``first`` and ``last`` stand for what the
    ends of a document lack) or an annotation (fields chunk_id, text)."""
    if kind == "repair":
        fields = {"text_a": F.coalesce("text_a", F.lit(first)), "text_b": F.col("text"), "text_c": F.coalesce("text_c", F.lit(last))}
    else:
        fields = {"chunk_id": F.col("chunk_id"), "text": F.col("text")}
    return rows.withColumn("request", fill_template(template, **fields))


def _answers(model: Callable[[list[str]], list], asked: list[str]) -> list:
    """What the model says to a batch: one answer for each request, or an error."""
    out = model(asked) if asked else []
    if len(out) != len(asked):
        raise ValueError(f"the model gave {len(out)} answers to {len(asked)} requests")
    return out


def apply_model(rows: DataFrame, model: Callable[[list[str]], list[str]], request: str = "request", response: str = "response", batch: int = MODEL_BATCH) -> DataFrame:
    """Rows with the model's answers, in batches.  Blank and null requests are not sent and answer null.
    Write the result before joining it, so that later retries do not call the model again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                asked = b.column("request").to_pylist()
                live = [k for k, x in enumerate(asked) if x and x.strip()]
                answers: list[str | None] = [None] * len(asked)
                for k, x in zip(live, _answers(model, [asked[k] for k in live]), strict=True):
                    answers[k] = x
                yield pa.record_batch({"row": b.column("row"), "response": pa.array(answers, pa.string())})

    packed = rows.select(F.struct("*").alias("row"), F.col(request).cast("string").alias("request"))
    out = packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}, response string")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != response], F.col("response").alias(response))


def embed_texts(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 128) -> DataFrame:
    """Rows with ``embedding array<float>`` of the stripped text; null texts have no vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                texts = b.column("text").to_pylist()
                live = [k for k, x in enumerate(texts) if x is not None]
                vectors: list[list[float] | None] = [None] * len(texts)
                for k, v in zip(live, _answers(model, [texts[k] for k in live]), strict=True):
                    vectors[k] = [float(x) for x in v]
                yield pa.record_batch({"row": b.column("row"), "embedding": pa.array(vectors, pa.list_(pa.float32()))})

    packed = rows.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    out = packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}, embedding array<float>")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != "embedding"], "embedding")
